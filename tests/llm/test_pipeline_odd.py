"""The pipeline on empty tables, nulls, repeated rows and columns of clashing names."""

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, columns=COLUMNS):
    spark.createDataFrame(docs, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_empty(spark, tmp_path):
    assert write(spark, tmp_path, [], []).count() == 0


def test_odd_rows(spark, tmp_path):
    """Without labels nothing is rejected: one row of each text and id, all nulls, as often as the mixture draws them."""
    base = "one plain sentence of some words that stands here for a document and goes on for a while"
    docs = [(1, None, "en", "a"), (None, None, None, None), (2, "", "en", "a"), (3, base, "en", "a"), (3, base, "en", "a"), (4, base, "de", "b"), (None, base + " other", None, "a"), (5, "word " * 30_000, "en", "a")]
    docs = [(i, t, lang, source, len(t or ""), "x", 1, "y", 2.5) for i, t, lang, source in docs]
    got = write(spark, tmp_path, docs, [], COLUMNS + ", tw_id string, mix_key int, node string, h double")
    rows = got.collect()
    assert {r.doc_id for r in rows} <= {1, 2, 3, 5, None} and all(r.n_tokens >= 0 for r in rows)
    single = write(spark, tmp_path / "one", [d[:5] for d in docs], [(1, 1, 0), (2, None, None), (None, 1, 1), (9, 1, 1)])
    assert single.columns == got.columns
