from pathlib import Path

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_stages_keep_clean_documents_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len({*ids}) == len({text[i] for i in ids}) and 0.6 * len(text) < len(ids) < len(text)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_dedup_stages_with_repeated_and_null_ids(spark):
    a, b, c = ("".join(f"{x}{k} " for k in range(60)) for x in "abc")
    near = c.replace("c3 ", "d3 ")
    data = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, near), (None, near + "."), (3, None), (None, ""), (4, "one"), (4, "two")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars int")
    once = corpus_pipeline.exact_stage(spark, docs, SF)
    rows = sorted(((r.doc_id, r.text) for r in once.collect()), key=str)
    assert rows == sorted([(1, a), (None, b), (2, c), (2, near), (None, near + "."), (3, None), (4, "one"), (4, "two")], key=str)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, once, SF).collect()]
    assert len(left) == 6 and sum(t in (c, near, near + ".") for _, t in left) == 1
    assert {(4, "one"), (4, "two"), (1, a), (None, b), (3, None)} <= {*left}


def test_each_stage_with_odd_rows_and_without_rows(spark):
    """Null ids and texts, repeated rows, very long and empty texts, columns of other names: no stage fails, clean rows stay."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id").orderBy("doc_id").limit(6).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first().text
    data = [(9001, good[0]), (9001, good[0]), (None, good[1]), (9002, None), (None, None), (9003, ""), (9004, good[2] + " " + item + " " + good[3]), (9005, (good[4] + " ") * 300), (9006, good[5]), (9006, "quite another text of the same id " * 3)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in data], "doc_id long, text string, lang string, source string, n_chars int, key string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        rows = out.collect()
        if name == "tokenize":
            assert len(rows) == len(data) and all(r.n_tokens == len(r.ids) // 4 for r in rows)
            continue
        left = [(r.doc_id, r.text) for r in rows]
        assert out.columns == corpus_pipeline.COLUMNS and {x for x in left} <= {x for x in data}, name
        if name in ("exact_dedup", "near_dedup"):
            assert left.count((9001, good[0])) == 1 and {(None, good[1]), (9006, good[5]), (9006, data[-1][1]), (9004, data[6][1])} <= {*left}, name
        if name == "decontaminate":
            assert len(left) == len(data) - 1 and (9004, data[6][1]) not in left
