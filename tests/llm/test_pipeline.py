import pytest

import __spark_entry__ as entry
import corpus_pipeline
from bramble.llm import minhash
from tests.llm.test_llm import brute_near, library
from tests.oracle import SF


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out, as a list of (name, before, after)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["quality", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() < before.count()


def test_quality_keeps_clean_documents(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = before.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    assert good.join(after, "doc_id", "left_anti").count() <= 0.02 * good.count()


def test_dedup_stages_against_brute_force(stages):
    _, before, after = stages[1]
    last = {}
    for r in before.collect():
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(last.values())
    _, before, after = stages[2]
    want = brute_near([(r.doc_id, r.text) for r in before.collect()], minhash.Params(5, 80))
    assert {r.doc_id for r in after.collect()} == {i for i, r in want.items() if r[2]}


def test_last_stage(spark, stages):
    tok = library()
    for r in stages[4][2].join(stages[3][2].select("doc_id", "text"), "doc_id").collect():
        assert r.ids == tok.encode(r.text, add_special_tokens=False).ids


def test_registered(spark, stages):
    assert entry.queries()["pipeline"](spark, SF).count() == stages[4][2].count()
    assert {f"op{i}_" for i in range(1, 11)} <= {n.split("_")[0] + "_" for n in entry.queries()}


TEXT = " ".join(f"word{i}" for i in range(40))
#: doc_id and text: nulls, empty and very long texts, repeated rows, ids with several texts, near copies.
ODD = [
    (1, None), (2, ""), (3, "lorem ipsum dolor " * 30_000), (5, "a"), (5, "a text of its own"), (9, "a"), (9, "a"), (4, TEXT), (4, TEXT), (6, TEXT + " more"), (6, "not at all alike, this one"),
    (None, "a"), (None, None), (7, TEXT.upper()), (8, "日本語 🙂"), (8, "日本語 🙂"),
]


def odd(spark, rows):
    """Documents with columns that the operators use as well."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, score double, ids string, decoded string, text_hash int, component int, kept string, n_tokens string, key int, h int, _body string"
    return spark.createDataFrame([(*r, "en", "web", 1, 0.5, "x", "y", 1, 2, "z", "n", 3, 4, "b") for r in rows], schema)


def pairs(df):
    return sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)


def test_stages_on_odd_rows(spark):
    stages, docs = dict(corpus_pipeline.STAGES), odd(spark, ODD)
    text = lambda r: r[1] or ""
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == docs.columns and set(pairs(kept)) <= {(i, t or "") for i, t in ODD}
    for r in set(pairs(kept)):  # a row stays or goes with its copies
        assert pairs(kept).count(r) == [(i, t or "") for i, t in ODD].count(r)

    last = {}
    for r in ODD:
        if r[0] is not None:
            last[text(r)] = max(last.get(text(r), r[0]), r[0])
    exact = stages["exact_dedup"](spark, docs, SF)
    nulls = [(None, "a"), (None, "")]
    assert exact.columns == docs.columns and pairs(exact) == sorted([*((i, t) for t, i in last.items()), *nulls], key=str)

    near = stages["near_dedup"](spark, docs, SF)
    want = [(1, ""), (2, ""), (3, ODD[2][1]), (5, "a"), (5, "a text of its own"), (4, TEXT), (6, "not at all alike, this one"), *nulls, (8, "日本語 🙂")]
    assert near.columns == docs.columns and pairs(near) == sorted(want, key=str)

    left = stages["decontamination"](spark, docs, SF)
    assert left.columns == docs.columns and pairs(left) == sorted(((i, t or "") for i, t in ODD), key=str)

    tok = library()
    ids = stages["bpe"](spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.ids, r.n_tokens) for r in ids) == sorted((str(i), x, len(x)) for i, t in ODD if (x := tok.encode(t or "", add_special_tokens=False).ids) is not None)


def test_stages_on_no_rows(spark):
    docs = odd(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert after.count() == 0 and (name == "bpe" or after.columns == docs.columns)


def test_unique_texts_stay(spark):
    """One id on two texts, through both duplicate stages in turn."""
    docs = odd(spark, [(5, "a"), (5, "unique"), (9, "a")])
    for name in ("exact_dedup", "near_dedup"):
        docs = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert pairs(docs) == [(5, "unique"), (9, "a")]


def test_run_on_odd_tables(spark, tmp_path):
    """All stages over a small folder of tables, and over one whose documents are empty."""
    for name, rows in (("some", ODD), ("none", [])):
        odd(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} <= {i for i, _ in rows} and (rows or not got)
