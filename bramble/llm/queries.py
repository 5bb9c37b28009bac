"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm import bpe, chat, decontam, exact_dedup, minhash, quality, suffix_tree, token_files, url_filter, warc
from bramble.llm.common import bounded_batches, table

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
TRICKY_CHAT = r"\### Assistant: </turn> ok"


def tokenizer_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page and reads the archives back."""
    bounded_batches(spark)
    index = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, record_type, CASE WHEN record_type = 'revisit' THEN first END AS refers_to,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest
FROM (SELECT *, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type FROM g)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes the ids again."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path(), decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document to token files and reads them back."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read(token_files.write(docs, tokenizer_path(), end_id=2))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 of 100 three-word shingles."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, minhash.Params(words=3, percent=85))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(t, i, i + 2), ' ') AS s
       FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 1, 2))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; one in seven is held out of the training."""
    bounded_batches(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # each round is stored; its shuffle can go
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = suffix_tree.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, reads it back and returns digests of turns and loss text."""
    turns = [F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(TRICKY_CHAT).alias("text")) for i, role in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.inline(F.array(*turns)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.parse_chats(chat.format_chats(rows))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
s AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS flat,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         string_agg('### ' || CASE WHEN role = 'system' THEN 'System' WHEN role = 'user' THEN 'User' WHEN role = 'assistant' THEN 'Assistant'
           WHEN role IN ('System', 'User', 'Assistant') THEN '%=' || role
           ELSE replace(replace(replace(replace(role, '%', '%25'), '#', '%23'), '<', '%3C'), ':', '%3A') END || ': '
           || replace(replace(replace(replace(text, '%', '%25'), '#', '%23'), '<', '%3C'), ':', '%3A') || ' </turn>' || chr(10), '') AS formatted,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(flat) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       length(formatted) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM s
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
k AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
             arg_max(r_verdict, length(r_host || r_path)) AS verdict
      FROM k JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
      GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""

def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the labels outside the held-out fold."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return quality.fit(docs, labels.select("doc_id", "quality").filter(learn))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; one label in five is held out."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("best_match").cast("bigint").alias("best_match"))


# Of 12 tokens with two substitutions at most, one of three parts of four is whole: no masks are needed to find every window.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM benchmark),
dw AS (SELECT doc_id, s, list_slice(t, s, s + 11) AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) - 10)) AS s FROM d WHERE len(t) >= 12)),
bw AS (SELECT item_id, list_slice(t, s, s + 11) AS w FROM (SELECT item_id, t, unnest(range(1, len(t) - 10)) AS s FROM b WHERE len(t) >= 12)),
dp AS (SELECT *, unnest([1, 5, 9]) AS part FROM dw), bp AS (SELECT *, unnest([1, 5, 9]) AS part FROM bw),
hit AS (SELECT DISTINCT doc_id, item_id, s, len(list_filter(range(1, 13), lambda i: dp.w[i] = bp.w[i])) AS match
        FROM dp JOIN bp ON dp.part = bp.part AND list_slice(dp.w, dp.part, dp.part + 3) = list_slice(bp.w, bp.part, bp.part + 3)),
brief AS (SELECT item_id, t FROM b WHERE len(t) BETWEEN 5 AND 11),
whole AS (SELECT doc_id, s, list_slice(t, s, s + l - 1) AS w FROM (SELECT doc_id, t, l, unnest(range(1, len(t) - l + 2)) AS s FROM d JOIN (SELECT DISTINCT len(t) AS l FROM brief) ON len(d.t) >= l)),
every AS (SELECT doc_id, item_id, s, match FROM hit WHERE match >= 10 UNION ALL SELECT doc_id, item_id, s, len(w) FROM whole JOIN brief ON w = t)
SELECT doc_id, item_id, count(DISTINCT s) AS n_windows, max(match) AS best_match FROM every GROUP BY doc_id, item_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_chat_format": op6_chat_format,
    "op7_token_files": op7_token_files,
    "op8_url_filter": op8_url_filter,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_decontamination": op10_decontamination,
}
SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_minhash": OP4_SQL, "op6_chat_format": OP6_SQL, "op8_url_filter": OP8_SQL, "op10_decontamination": OP10_SQL}
