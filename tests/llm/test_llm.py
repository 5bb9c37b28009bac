"""Edge cases, brute force and round trips of the corpus operators on small data."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bramble.llm import bpe, chat, decontam, exact_dedup, minhash, quality, queries, suffix_tree, token_files, url_filter, warc
from bramble.llm.common import bounded_batches
from tests.oracle import SF, compare

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(autouse=True)
def batches(spark):
    bounded_batches(spark)


def docs(spark, rows, extra=True):
    """Documents with clashing extra columns."""
    schema = "doc_id long, text string"
    if not extra:
        return spark.createDataFrame(rows, schema)
    clash = "score double, ids string, src int, kept string, digest int, path string, host string, n int, a int, bucket int"
    return spark.createDataFrame([(*r, 1.5, "x", 7, "y", 3, "p", "h", 1, 2, 3) for r in rows], f"{schema}, {clash}")


ODD = [(1, None), (2, ""), (3, LONG), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (None, None), (6, "A  \t\n"), (7, "日本語 <|endoftext|> é\u0301 🙂"), (8, LONG)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


# --- WARC
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, offset int, path string, payload string")


def test_warc_round_trip(spark):
    rows = [(3, "http://a/1", "same"), (1, "http://b/ x\r\ny", "same"), (2, None, None), (9, "", ""), (None, "u", "same"), (4, "é", "日本" * 50_000), (1, "again", "same"), (None, None, "alone")]
    index = warc.write(pages(spark, [(*r, 1, "p", "q") for r in rows]))
    assert set(index.columns) >= {"offset", "length", "url", "digest"}
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(index).collect()), key=str)
    firsts = {"same": 1, "": 2, "日本" * 50_000: 4, "alone": None}
    want = []
    for page, _, html in rows:
        body = html or ""
        first = firsts[body]
        revisit = page != first
        want.append((page, "revisit" if revisit else "response", first if revisit else None, len(body.encode()), base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()))
    assert got == sorted(want, key=str)
    some = warc.read(index.filter("page_id = 4")).collect()
    assert [r.payload.decode() for r in some] == ["日本" * 50_000]


def test_warc_empty_and_damaged(spark):
    index = warc.write(pages(spark, []))
    assert index.count() == 0 and warc.read(index).count() == 0
    good = warc.pack(1, "u", b"abc", None, warc.digest(b"abc"))
    assert warc.unpack(good).payload == b"abc"
    with pytest.raises(ValueError):
        warc.unpack(warc.pack(1, "u", b"abc", None, warc.digest(b"abd")))


def test_warc_reads_are_joined():
    reads = list(warc._ranges([("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP_BYTES, 5), ("a", 10**9, 5), ("b", 0, 1)]))
    assert [len(r[3]) for r in reads] == [3, 1, 1]


# --- exact duplicates
@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_golomb(n):
    v = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n).astype(np.uint64))
    k, code = exact_dedup.golomb_encode(v)
    assert (exact_dedup.golomb_decode(len(v), k, code) == v).all()
    if n == 3000:
        assert len(code) < 48 / 8 * n * 0.85


def test_exact_duplicates(spark):
    rows = [*ODD, *[(100 + i, "copy") for i in range(500)]]
    got = exact_dedup.duplicate_groups(docs(spark, rows).repartition(7)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    left = exact_dedup.drop_duplicates(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    assert {r.doc_id for r in left.collect()} == {2, 5, 6, 7, 8, 599, None}


def test_exact_duplicates_are_dropped_by_row(spark):
    """Rows that repeat id and text leave one; an id that lost one text keeps its other."""
    rows = [(1, "a"), (1, "a"), (1, "a"), (0, "a"), (5, "b"), (9, "b"), (5, "c"), (5, "c"), (3, "alone"), (4, None), (4, ""), (2, "")]
    left = exact_dedup.drop_duplicates(docs(spark, rows))
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "a"), (3, "alone"), (4, ""), (5, "c"), (9, "b")]
    assert left.columns == docs(spark, rows).columns
    unique = [(1, "a"), (5, "b"), (9, "b"), (5, "c")]
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_duplicates(docs(spark, unique)).collect()) == [(1, "a"), (5, "c"), (9, "b")]


def test_golomb_codes_are_as_short_for_any_number_of_owners():
    v = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 200_000).astype(np.uint64))
    bits = []
    for owners in (8, 2000):
        owner = (v * np.uint64(owners) >> np.uint64(48)).astype(np.int64)
        total = 0
        for o in range(owners):
            part = v[owner == o]
            least = exact_dedup.least_of(o, owners)
            k, code = exact_dedup.golomb_encode(part, least)
            assert (exact_dedup.golomb_decode(len(part), k, code, least) == part).all()
            total += 8 * len(code)
        bits.append(total / len(v))
    assert abs(bits[0] - bits[1]) < 1 and bits[0] < np.log2((1 << 48) / len(v)) + 2.5


SPLIT = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def split_joins(spark):
    """As on a cluster, where these sizes are larger."""
    old = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(df):
    """Of the rows of all tasks, in the largest; every column is read, as it counts for the sizes by which Spark splits."""
    rows = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.xxhash64(*df.columns))).collect()]
    return max(rows) / sum(rows)


def test_hot_keys_are_split(spark, split_joins):
    """Half of all rows have one text, payload or url: no task gets them all."""
    n = 40_000
    half = spark.range(n).repartition(20).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    assert largest_share(exact_dedup.duplicate_groups(half)) < 0.3
    pages = half.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), F.when(F.col("doc_id") % 2 == 0, "x").otherwise(F.col("doc_id").cast("string"))).alias("url"), F.col("text").alias("html"))
    assert largest_share(url_filter.judge_urls(pages, url_filter.rules_frame(spark, [("org", "/", "block")]))) < 0.3
    assert largest_share(url_filter.judge_urls(pages.withColumn("url", F.when(F.col("page_id") % 2 == 0, F.col("url"))), url_filter.rules_frame(spark, [("org", "/", "block")]))) < 0.4
    archives = warc.write(pages).groupBy("path").count().collect()
    assert max(r["count"] for r in archives) < 0.3 * n


def test_exact_duplicates_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_SUSPECTS", -1)
    monkeypatch.setattr(exact_dedup, "SOURCE_ROWS", 3)
    got = {r.doc_id: r.keep_id for r in exact_dedup.duplicate_groups(docs(spark, [(i, str(i % 5)) for i in range(40)])).collect()}
    assert got == {i: 35 + i % 5 for i in range(40)}
    assert exact_dedup.duplicate_groups(docs(spark, [])).count() == 0


# --- BPE and token files
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_is_the_library(spark):
    rng = random.Random(4)
    parts = ["a", "aa", " ", "  ", "\n", "'s", "é", "中", "🙂", "<|endoftext|>", "<|endo", "12", "!", "\u00a0", "\u0085", "\x1c", "tttt", " the", "="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = [*ODD, *enumerate(texts, 1000)]
    tok = library()
    got = bpe.encode(docs(spark, rows), PATH, decoded="decoded").collect()
    assert len(got) == len(rows) and "src" in got[0].asDict()
    for r in got:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tok.decode(want, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(docs(spark, []), PATH).count() == 0


def test_decode(spark):
    rows = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None), (4, [50256]), (5, [163])], "doc_id long, ids array<int>")
    tok = library()
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()}
    assert got == {1: "Hello world", 2: "", 3: None, 4: "<|endoftext|>", 5: tok.decode([163], skip_special_tokens=False)}


def test_both_patterns_split_alike():
    """All pairs of the first 256 characters, and random strings of them."""
    rng = random.Random(2)
    c = bpe.Codec(bpe.read_spec(PATH))
    texts = ["".join(chr(a) + chr(b) for b in range(256)) for a in range(256)] + ["".join(chr(rng.choice([32, 32, 39, 115, 108, rng.randrange(256)])) for _ in range(60)) for _ in range(3000)]
    for t in texts:
        assert c.first_pattern.findall(t) == c.pattern.findall(t)


def test_unknown_options_raise():
    import json

    spec = json.loads(bpe.read_spec(PATH))
    token = spec["added_tokens"][0]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [token | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="not handled"):
            bpe.Codec(json.dumps(spec | change))


def test_token_files(spark):
    tok = library()
    rows = [r for r in ODD if r[0] is not None]
    index = token_files.write(docs(spark, rows), PATH, end_id=2)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(index).collect())
    want, start = [], 0
    for i, t in sorted((i, t or "") for i, t in rows):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.read(token_files.write(docs(spark, []), PATH, end_id=2)).count() == 0
    assert token_files.read(token_files.write(docs(spark, [(None, "b"), (None, "a")]), PATH, end_id=2)).count() == 2


def test_token_files_roll(spark):
    """Small files: the same rows, in order, from many files; extreme and null ids."""
    rows = [(i, f"text {i} " * (i % 9)) for i in range(60)] + [(-(2**63), "least"), (2**63 - 1, "most"), (None, "none")]
    want = sorted(map(tuple, token_files.read(token_files.write(docs(spark, rows), PATH, end_id=2)).collect()), key=str)
    index = token_files.write(docs(spark, rows), PATH, end_id=2, frame_bytes=64, file_docs=4)
    assert index.count() > 15 and {r.n_docs for r in index.collect()} <= {1, 2, 3, 4}
    got = sorted(map(tuple, token_files.read(index).collect()), key=str)
    assert got == want and [r[0] for r in sorted(got, key=lambda r: r[1])][:2] == [None, -(2**63)]


def test_only_wanted_frames_are_read(tmp_path):
    from bramble.llm import files

    uri = f"file://{tmp_path}/x.tok"
    w = token_files.Writer(files.open_new(uri), 4)
    lists = [np.arange(i * 7, i * 7 + 30_000) for i in range(20)]
    for i, ids in enumerate(lists):
        w.add(i, ids)
    w.close()
    import zstandard

    r = token_files.Reader(files.open_old(uri))
    assert len(r.frames) > 4
    assert [x.tolist() for x in r.read([3, 4, 17])] == [lists[i].tolist() for i in (3, 4, 17)] and r.decompressed <= 3
    raw = bytearray((tmp_path / "x.tok").read_bytes())
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == np.concatenate(lists).tolist()  # any zstandard reader can read it all
    raw[int(r.frames[0, 0]) // 2] ^= 255
    (tmp_path / "y.tok").write_bytes(raw)
    with pytest.raises(Exception):
        list(token_files.Reader(files.open_old(f"file://{tmp_path}/y.tok")).read([0]))


# --- near duplicates
def brute_near(rows, p):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(p.words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= p.percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("seed,p", [(1, minhash.Params(3, 85)), (2, minhash.Params(5, 80)), (3, minhash.Params(1, 60))])
def test_near_duplicates_against_brute_force(spark, seed, p):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([2, 4, 8, 30, 120]))]
        for _ in range(12):  # chains of edits: links between members that the first text does not have
            rows.append((len(rows), " ".join(base)))
            base = [rng.choice(words) if rng.random() < 0.03 else w for w in base]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, LONG), (1006, LONG + "end"), (1007, "one two"), (1008, "ONE  two")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), p).collect()}
    assert got == brute_near(rows, p)


def test_near_duplicates_around_the_threshold(spark):
    """Copies of one text with so many edits that about half of all pairs are links."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(100)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rng.randrange(10)):
            at, kind = rng.randrange(len(text)), rng.random()
            text[at : at + (kind < 0.7)] = [] if kind < 0.2 else [rng.choice(words)]
        rows.append((i, " ".join(text)))
    for p in (minhash.Params(3, 85), minhash.Params(5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), p).collect()}
        assert got == brute_near(rows, p)
        assert 3 < len({r[1] for r in got.values()}) < 250


def test_near_duplicates_are_dropped_by_row(spark):
    """A doc_id with two texts loses only the copy; rows that repeat leave one; one row of each component stays."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, "something else altogether here"), (9, text + " more"), (7, text.upper()), (3, "quite another one of its own"), (3, "quite another one of its own"), (None, text), (4, None), (4, "")]
    rows += [(6, "something else altogether here"), (6, text + " and more")]
    left = minhash.drop_near_duplicates(docs(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(3, rows[4][1]), (4, ""), (4, None), (5, "something else altogether here"), (5, text), (None, text)], key=str)
    assert left.columns == docs(spark, rows).columns
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows)).filter("doc_id IS NOT NULL").collect()}
    assert got == {(5, 36, 5), (5, 1, 5), (9, 37, 5), (7, 36, 5), (3, 2, 3), (4, 0, 4), (6, 1, 5), (6, 38, 5)}
    unique = [(5, text), (5, "something else altogether here"), (9, text)]
    assert sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs(spark, unique)).collect()) == sorted(unique[:2])


def test_near_duplicates_edges(spark):
    got = sorted(map(tuple, minhash.near_duplicates(docs(spark, ODD)).collect()), key=str)
    assert [r for r in got if r[0] is None] == [(None, 0, None, True), (None, 1, None, True)]
    assert got.count((5, 1, 4, False)) == 2 and (6, 1, 4, False) in got and (8, 3, 3, False) in got
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    left = minhash.drop_near_duplicates(docs(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, "z"), (None, "z")]))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "None"] and "bucket" in left.columns


def test_densification_is_even():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 7).astype(np.uint64) * 2)
    counts = Counter(minhash.signature(h, 464).tolist())
    assert len(counts) == len(set(h.tolist())) and max(counts.values()) < 464 * 0.25


# --- language model
def test_scores_against_plain_sums(spark):
    rng = random.Random(0)
    en, xx = ["the", "of", "and", "cat", "dog", "house"], ["der", "und", "haus", "katze", "ein"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else xx) for _ in range(60))) for i in range(120)]
    rows += ODD
    held = lambda i: i is not None and i % 7 == 2
    got = suffix_tree.score(docs(spark, rows), F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))).collect()
    assert len(got) == len(rows)
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*(t or "").encode().lower().split(), None])
    base, model = 0.0, 0.0
    for r in got:
        want = [(len(w), sum(c[x] > 0 for x in w), round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for w in texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, round(r.base_score, 5)) in want and r.train_tokens == n
        if held(r.doc_id):
            base, model = base + r.base_score, model + r.score
    assert model > base


def plain_tree(texts, depth):
    """Counts of all contexts and which of them are retained, with dictionaries; returns P(word | the words before)."""
    n, follow, base = Counter(), {}, Counter()
    for words in texts:
        x = [b"<s>", *words, b"</s>"]
        base.update(x[1:])
        for i in range(1, len(x)):
            for k in range(1, min(i, depth) + 1):
                follow.setdefault(tuple(x[i - k : i]), Counter())[x[i]] += 1
    n_all, types = sum(base.values()), len(base)
    kept = set()
    for s, after in follow.items():
        n, shorter = sum(after.values()), follow[s[1:]] if s[1:] else base
        below = sum(shorter.values())
        gain = sum(c * (np.log(c / n) - np.log(shorter[w] / below)) for w, c in after.items())
        if n >= suffix_tree.least_count(len(s)) and gain >= suffix_tree.PENALTY * len(after):
            kept.add(s)

    def p(before, word):
        q = (base[word] + 1) / (n_all + types + 1)
        x = [b"<s>", *before]
        for k in range(1, min(len(x), depth) + 1):
            if (s := tuple(x[-k:])) in kept:
                after = follow[s]
                q = (after[word] + len(after) * q) / (sum(after.values()) + len(after))
        return q

    return p, kept, base


def tree_rows():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows, base = [], [rng.choice(words) for _ in range(80)]
    for i in range(60):
        if i % 6 == 0:  # text of its own, else copies with edits: long contexts, some with one next symbol
            base = [rng.choice(words[: 3 + i // 2]) for _ in range(80)]
        rows.append((i, " ".join(rng.choice([*words, f"new{i}"]) if rng.random() < 0.07 else w for w in base)))
    return [*rows, (200, rows[8][1]), (201, "only here"), (202, rows[9][1]), (300, ""), (301, None), (302, "W0 w1  W2")]


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_scores_against_a_plain_tree(spark, monkeypatch, depth):
    """Every score of the distributed tree, for training and held-out texts, over many blocks and owners."""
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 2000)
    rows = tree_rows()
    learned = lambda i: i % 7 != 2
    got = suffix_tree.score(docs(spark, rows).repartition(3), F.col("doc_id") % 7 != 2, depth=depth).collect()
    split = {i: (t or "").encode().lower().split() for i, t in rows}
    p, kept, _ = plain_tree([w for i, w in split.items() if learned(i)], depth)
    assert {len(s) for s in kept} == set(range(1, depth + 1)) or depth == 6 and max(map(len, kept)) >= 4
    for r in got:
        x = [*split[r.doc_id], b"</s>"]
        assert abs(r.score - sum(np.log10(p(x[:i], w)) for i, w in enumerate(x))) < 1e-9
    assert len(got) == len(rows)


def test_scores_are_probabilities(spark):
    """After any words the probabilities of all known words, the end and one unseen word add up to 1."""
    rows = tree_rows()
    _, _, base = plain_tree([(t or "").encode().lower().split() for _, t in rows], 1)
    words = [w.decode() for w in base if w != b"</s>"]
    asked = [rows[1][1].split()[:j] for j in (0, 1, 2, 7, 40)] + [["unheard", "of"], rows[1][1].split()[:9] + ["unheard"]]
    extra = [(1000 + 1000 * j + i, " ".join([*before, w])) for j, before in enumerate(asked) for i, w in enumerate([*words, "quite-unseen"])]
    extra += [(900 + j, " ".join(before)) for j, before in enumerate(asked)]
    # A text's score has its end as well: P(word) is that of the prefix with the word, both without their ends.
    got = {r.doc_id: r.score for r in suffix_tree.score(docs(spark, rows + extra), F.col("doc_id") < 900).collect()}
    p, _, _ = plain_tree([(t or "").encode().lower().split() for _, t in rows], suffix_tree.DEPTH)
    for j, before in enumerate(asked):
        x = [w.encode() for w in before]
        end = 10 ** (got[900 + j] - sum(np.log10(p(x[:i], w)) for i, w in enumerate(x)))
        total = end
        for i, w in enumerate([*words, "quite-unseen"]):
            y = [*x, w.encode()]
            total += 10 ** (got[1000 + 1000 * j + i] - np.log10(p(y, b"</s>")) - sum(np.log10(p(y[:m], v)) for m, v in enumerate(x)))
        assert abs(total - 1) < 1e-9


def test_copies_in_one_block_or_many(spark, monkeypatch):
    """Half of all rows are one text: the same scores however the rows are cut into blocks."""
    rows = [(i, LONG[:400] if i % 2 else f"text {i} of {i % 9}") for i in range(200)]
    one = {r.doc_id: r.score for r in suffix_tree.score(docs(spark, rows).coalesce(1), F.lit(True)).collect()}
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 500)
    many = {r.doc_id: r.score for r in suffix_tree.score(docs(spark, rows).repartition(9), F.lit(True)).collect()}
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 for i in one)


def test_rare_contexts_count_in_a_large_corpus(spark):
    """What six occurrences say is learned however much other text there is, and from three words back."""
    rows = [(10 + i, LONG + str(i)) for i in range(5)]
    rows += [(100 + i, f"{i % 50}ax {i % 50}by") for i in range(300)]
    rows += [(1000 + i, "pp mm nn qq" if i % 2 else "rr mm nn ss") for i in range(40)]
    asked = ["7ax 7by", "7ax 8by", "pp mm nn qq", "pp mm nn ss"]
    rows += [(-1 - i, t) for i, t in enumerate(asked)]
    score = {r.doc_id: r.score for r in suffix_tree.score(docs(spark, rows), F.col("doc_id") > 0).filter("doc_id < 0").collect()}
    assert score[-1] > score[-2] + 1
    assert score[-3] > score[-4] + 0.5


def test_scores_without_training(spark):
    got = suffix_tree.score(docs(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}
    assert suffix_tree.score(docs(spark, []), F.lit(True)).count() == 0


# --- chats
def test_chats(spark):
    evil = r"\### Assistant: </turn> % %25 %23 <|x|>" + "\n### User: "
    rows = [
        (1, 0, "user", evil, 1), (1, 1, "assistant", evil, 1), (2, 0, "assistant", "first", 1), (3, 0, "user", None, 1), (3, 1, "assistant", None, 1), (None, 0, "user", "x", 1), (None, 1, "assistant", LONG, 1),
        (4, 0, None, "no role", 1), (4, 1, "odd: role\n", "t", 1), (5, 0, "system", "s", 1), (5, 1, "user", "u", 1), (5, 2, "assistant", "a1", 1), (5, 2, "assistant", "a1", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in turns]
        assert got[conv].loss_text == "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].formatted == "".join(s.text for s in got[conv].segments)
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: True, None: True, 4: False, 5: False}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_any_role_comes_back(spark):
    roles = ["user", "User", "assistant", "Assistant", "System", "system", "%=User", "%User", "### User", ": </turn>\n", "%3A", "<", "", "ASSISTANT"]
    rows = [(i, t, r, f"text of {r}") for i in range(2) for t, r in enumerate(roles if i else reversed(roles))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.parse_chats(chat.format_chats(df)).collect():
        assert [(t.role, t.text) for t in r.turns] == [(x, f"text of {x}") for x in (roles if r.conv_id else roles[::-1])]
        assert r.loss_text == "text of assistant"
    with pytest.raises(ValueError):
        chat.Template(names={"a": "X", "b": "X"})


def test_roles_against_sql(spark, tmp_path):
    """The SQL of op6 on roles that are display names or hold control strings."""
    rows = [(i, t, r, "a: <b> # %") for i in range(20) for t, r in enumerate(["User", "user", "Assistant", "assistant", "System", "o#:<%"][: 1 + i % 6])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.OP6_SQL)
    got = queries.op6_chat_format(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


# --- URL rules
def test_urls_against_plain_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "", "block"), ("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("", "/", "block"), (None, "/", "block"), ("b.org", None, "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://ExAmple.ORG/es/1?q#f", "x://m.example.org/en", "x://example.org", "ftp://A.com:80/x", "y://a.com/x/y", "y://b.a.com/xx?", "y://aa.com", "http://É.org/ü", "http://b.org", "z://" + "a." * 3000 + "org/" + "p" * 10_000, "http://x.org/a://b"]
    df = spark.createDataFrame([(i, u, "mine", 5) for i, u in enumerate(urls * 2)], "page_id long, url string, rule string, prefix int")
    got = url_filter.judge_urls(df, url_filter.rules_frame(spark, rules)).collect()
    assert len(got) == 2 * len(urls) and "prefix" in got[0].asDict()

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = rest
        for c in "/?#":
            raw = raw.split(c)[0]
        path = rest[len(raw) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in raw)
        fit = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        return (host, path, *(max(fit)[3:] if fit else (None, "allow")))

    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url)
    assert url_filter.judge_urls(df, url_filter.rules_frame(spark, [("q", "/", "block")]).limit(0), default="block").filter("verdict = 'block' AND rule IS NULL").count() == len(got)
    assert url_filter.judge_urls(df.limit(0), url_filter.rules_frame(spark, rules)).count() == 0


def test_native_plans_have_no_python(spark):
    for name in ("op6_chat_format", "op8_url_filter", "op10_decontamination"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan], name


# --- quality
def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op9_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == got.quality).mean()) > 0.97
    assert got[got.quality == 1].predicted.mean() > 0.99


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (99, 1), (4, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs(spark, ODD), labels)
    got = quality.score(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    same = {round(r.score, 12) for r in got if not r.text}
    assert len(same) == 1
    none = quality.fit(docs(spark, ODD), labels.limit(0))
    assert {r.score for r in quality.score(docs(spark, ODD), none).collect()} == {0.5}
    assert quality.score(docs(spark, []), model).count() == 0


def plain_additive(x, y, rounds, rate, leaves, n_pairs, pair_rounds):
    """The model of fit_matrix by loops over rows, bins and all splits; returns the probability of a row."""
    rows, d = len(x), x.shape[1]
    share = sum(y) / rows
    start = np.log(share / (1 - share))
    z = [start] * rows
    place = lambda v, e: sum(v >= b for b in e)
    prob = lambda t: 1 / (1 + np.exp(-t))
    borders = lambda f, n: sorted(set(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1]).tolist()))
    fine, coarse = [borders(f, 32) for f in range(d)], [borders(f, 8) for f in range(d)]
    bins = [[place(v, fine[f]) for v in x[:, f]] for f in range(d)]
    cells = [[place(v, coarse[f]) for v in x[:, f]] for f in range(d)]
    tables = [[0.0] * (len(e) + 1) for e in fine]

    def sums(inside):
        g = sum(y[r] - prob(z[r]) for r in range(rows) if inside(r))
        h = sum(prob(z[r]) * (1 - prob(z[r])) for r in range(rows) if inside(r))
        return g, h

    worth = lambda s: s[0] ** 2 / (s[1] + 1)
    leaf = lambda s: s[0] / (s[1] + 1)
    for _ in range(rounds):
        for f in range(d):
            by_bin = [sums(lambda r, b=b: bins[f][r] == b) for b in range(len(tables[f]))]  # noqa: B023
            total = lambda a, b: (sum(s[0] for s in by_bin[a:b]), sum(s[1] for s in by_bin[a:b]))  # noqa: B023, E731
            parts = [(0, len(by_bin))]
            while len(parts) < leaves:
                options = [(worth(total(a, c)) + worth(total(c, b)) - worth(total(a, b)), -a, -c, (a, b), c) for a, b in parts for c in range(a + 1, b)]
                if not options or (best := max(options))[0] <= 1e-9:
                    break
                (a, b), c = best[3:]
                parts = sorted([p for p in parts if p != (a, b)] + [(a, c), (c, b)])
            for a, b in parts:
                v = rate * leaf(total(a, b))
                for k in range(a, b):
                    tables[f][k] += v
                for r in range(rows):
                    if a <= bins[f][r] < b:
                        z[r] += v

    def cross(i, j):
        every, best = sums(lambda r: True), (0.0, None, None, None)
        for a in range(1, len(coarse[i]) + 1):
            for b in range(1, len(coarse[j]) + 1):
                four = {(p, q): sums(lambda r, p=p, q=q: (cells[i][r] >= a) == p and (cells[j][r] >= b) == q) for p in (False, True) for q in (False, True)}  # noqa: B023
                gain = sum(map(worth, four.values())) - worth(every)
                if gain > best[0] + 1e-12:
                    best = (gain, a, b, {k: leaf(s) for k, s in four.items()})
        return best

    chosen = sorted((-cross(i, j)[0], i, j) for i in range(d) for j in range(i + 1, d))[:n_pairs]
    crossed = {(i, j): [] for g, i, j in chosen if g < 0}
    for _ in range(pair_rounds):
        for i, j in crossed:
            gain, a, b, four = cross(i, j)
            if four:
                crossed[i, j].append((a, b, four))
                for r in range(rows):
                    z[r] += rate * four[cells[i][r] >= a, cells[j][r] >= b]

    def score(row):
        t = start + sum(tables[f][place(row[f], fine[f])] for f in range(d))
        for (i, j), steps in crossed.items():
            t += sum(rate * four[place(row[i], coarse[i]) >= a, place(row[j], coarse[j]) >= b] for a, b, four in steps)
        return prob(t)

    return score


def test_classifier_against_a_plain_model():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((70, 3)), 2)
    y = ((x[:, 0] + 0.3 * rng.random(70) > 0.6) ^ (x[:, 1] > 0.7) & (x[:, 2] > 0.4)).astype(float)
    args = {"rounds": 4, "rate": 0.3, "leaves": 3, "n_pairs": 2, "pair_rounds": 3}
    model, plain = quality.fit_matrix(x, y, **args), plain_additive(x, y, **args)
    new = np.vstack([x, rng.random((30, 3)) * 1.4 - 0.2])
    assert model.pairs and np.abs(model.score(new) - np.array([plain(r) for r in new])).max() < 1e-9


def test_pairwise_tables_catch_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, quality.N_FEATURES))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    m = quality.fit_matrix(x, y, rounds=10, pair_rounds=40)
    assert (0, 3) in [(i, j) for i, j, *_ in m.pairs] and ((m.score(x) > 0.5) == y).mean() > 0.9


# --- decontamination
def test_leaks_with_substitutions(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [make(rng.randint(14, 60)) for _ in range(12)]
    rows, leaky = [], set()
    for i in range(120):
        body = make(rng.randint(5, 300))
        if i % 3 == 0:
            item = list(items[i % 12])
            if i % 2:
                item[len(item) // 2] = "other"
            at = rng.randrange(len(body))
            body[at:at] = item
            leaky.add(i)
        rows.append((i, " ".join(body).upper() + "."))
    bench = spark.createDataFrame([(k, ", ".join(x), 1, "t") for k, x in enumerate(items)] + [(90, None, 1, "t"), (91, "too short", 1, "t")], "item_id long, text string, doc_id int, key string")
    got = decontam.contaminated(docs(spark, rows), bench).collect()
    assert {r.doc_id for r in got} == leaky
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 12) for i in leaky}
    left = decontam.drop_contaminated(docs(spark, rows + ODD), bench)
    assert left.count() == len(rows) + len(ODD) - len(leaky) and left.columns == docs(spark, rows).columns
    assert decontam.contaminated(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontam.contaminated(docs(spark, []), bench).count() == 0


def test_leaks_against_plain_windows(spark):
    """Any two or three substitutions, wherever they lie, against all windows compared without masks."""
    rng = random.Random(3)
    item = [f"w{i}" for i in range(15)]
    rows = []
    for i in range(15):
        for j in range(i + 1, 15):
            for more in (None, rng.randrange(15)):
                rows.append((len(rows), ["zz" if k in (i, j, more) else w for k, w in enumerate(item)]))
    rows.append((len(rows), [f"no{k}" if k % 6 == 5 else f"v{k}" for k in range(40)]))
    items = {1: item, 2: [f"v{k}" for k in range(40)]}
    want = set()
    for d, words in rows:
        for b, other in items.items():
            best = [max(sum(x == y for x, y in zip(words[s : s + 12], other[e : e + 12])) for e in range(len(other) - 11)) for s in range(len(words) - 11)]
            if (n := sum(x >= 10 for x in best)) > 0:
                want.add((d, b, n, max(best)))
    bench = spark.createDataFrame([(b, " ".join(x)) for b, x in items.items()], "item_id long, text string")
    got = decontam.contaminated(docs(spark, [(d, " ".join(x)) for d, x in rows]), bench).collect()
    assert len(want) > 105 and {(r.doc_id, r.item_id, r.n_windows, r.best_match) for r in got} == want


def test_short_items(spark):
    """Items of 5 to 11 tokens hit where all their tokens stand together, and no shorter ones."""
    items = {1: "one two three four", 2: "one two three four five", 3: "a b c d e f g h i j k", 4: "a b c d e f g h i j k l", 5: "p q r s t u v"}
    rows = [(1, "one two three four five"), (2, "x ONE, two three four FIVE! y"), (3, "one two three four 5"), (4, "a b c d e f g h i j k"), (5, "z a b c d e f g h i j k l"), (6, "p q r s t u w"), (7, "p q"), (8, None)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_windows, r.best_match) for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 2, 1, 5), (2, 2, 1, 5), (4, 3, 1, 11), (5, 3, 1, 11), (5, 4, 1, 12)}
    assert {r.doc_id for r in decontam.drop_contaminated(docs(spark, rows), bench).collect()} == {3, 6, 7, 8}


def test_leaks_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", -1)
    text = " ".join(f"t{i}" for i in range(20))
    got = decontam.contaminated(docs(spark, [(1, "x " + text), (None, text), (2, "y")]), spark.createDataFrame([(7, text)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_windows) for r in got} == {(1, 7, 9), (None, 7, 9)}
