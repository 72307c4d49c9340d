"""The stages of the pipeline one after the other, on planted rows."""

import hashlib

import corpus_pipeline
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture
def planted(spark, tmp_path):
    long = [f"w{i}" for i in range(100)]
    near = [*long[:50], "other", *long[51:]]
    bad, clean = "you idiot, you stupid moron scum", [f"a fine day number {i} on the river" for i in range(20)]
    rows = [(None, bad), (None, "no id but clean words here today"), (1, bad), (2, " ".join(long)), (3, " ".join(near)), (4, "my password: Qw9mZ2kLp0vRt7 it is"), (4, "my password: Qw9mZ2kLp0vRt7 it is")]
    rows += [(20 + i, x) for i, x in enumerate(clean)]
    kept = sorted([rows[1][1], rows[3][1], "my password: <secret> it is", *clean])
    labels = [(1, 0, 1)] + [(20 + i, 1, 0) for i in range(20)]
    return tables(spark, tmp_path, [(k, t, "en", f"s{(k or 0) % 2}", len(t)) for k, t in rows], labels), kept


def test_stages_and_run(spark, planted):
    sf, kept = planted
    docs = corpus_pipeline.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.settle(stage(spark, docs, sf), "test")
    assert sorted(r["text"] for r in docs.collect()) == kept
    known = {hashlib.sha256(t.encode()).hexdigest() for t in kept}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(known & {x for x in r if isinstance(x, str)} for r in rows)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0
