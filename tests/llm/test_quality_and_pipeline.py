"""The classifier on held-out rows, and the pipeline against stage-by-stage expectations."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from photonflow.llm import quality
from tests.llm.helpers import edge_docs, empty_docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    rows = quality.op1(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(rows.doc_id, rows.held_out))
    test = rows[rows.held_out & rows.quality.notna()]
    assert (test.predicted == test.quality).mean() > 0.95


def test_score_does_not_depend_on_ids_or_held_out_labels(spark, tables):
    docs, labels = tables
    base = {r["doc_id"]: r["score"] for r in quality.op1(docs, labels).collect()}
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}).repartition(5)
    again = {r["doc_id"]: r["score"] for r in quality.op1(other, flipped).collect()}
    assert base.keys() == again.keys() and all(abs(base[k] - again[k]) < 1e-9 for k in base)


def test_column_equals_rules(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    stats = quality.statistics(F.col("text"))
    names = list(stats)
    rows = quality.score(docs, model, "text").select("_score", *(c.alias(k) for k, c in stats.items())).toPandas()
    x = rows[names].to_numpy(float)
    assert np.isfinite(x).all()
    z = np.full(len(x), model.bias)
    for rule, w in model.rules:
        z += w * rule.holds(x, names)
    for n, w, lo, hi, mean, dev in model.linear:
        z += w * (np.clip(x[:, names.index(n)], lo, hi) - mean) / dev
    assert np.allclose(1 / (1 + np.exp(-z)), rows["_score"])


def test_lasso_leaves_out_noise():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=2000) > 0).astype(float)
    _, w = quality.lasso_logistic(x, y, penalty=0.02)
    assert w[0] > 0.5 > -0.5 > w[1] and np.abs(w[2:]).max() < 0.1 and (w == 0).any()


def test_quality_edges(spark, tables):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.op1(docs, none).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.5}
    one = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (1, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.op1(docs, one).count() == docs.count()
    assert quality.op1(empty_docs(spark), one).count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_pipeline(spark, tables, encoding_of):
    docs, _ = tables
    assert len(corpus_pipeline.STAGES) == 5
    counts, now = [docs.count()], docs
    from photonflow.llm.common import cut

    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, SF), name)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        counts.append(now.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0
    want = {r["doc_id"]: r["text"] for r in now.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, t in want.items():
        ids = encoding_of(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.fixture(scope="module")
def encoding_of():
    import public_tokenizers as p
    import tiktoken

    from photonflow.llm import bpe

    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(p.path(bpe.VOCABULARY)), special_tokens={}).encode_ordinary


def test_stages_on_edges(spark, tmp_path):
    docs = edge_docs(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, empty_docs(spark), str(tmp_path)).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
