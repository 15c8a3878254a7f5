import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwire.llm import quality_classifier as C
from tripwire.llm.queries import QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op2_quality_classifier"](spark, SF).toPandas().set_index("doc_id")


def test_every_document_has_a_score(scored, texts_sf):
    assert sorted(scored.index) == sorted(texts_sf.doc_id)
    assert ((scored.score >= 0) & (scored.score <= 1)).all()
    assert (scored.predicted == (scored.score >= 0.3)).all()
    assert [bool(h) for h in scored.held_out] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.index]


def test_held_out_quality(scored):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    held = scored[scored.held_out].join(labels, how="inner")
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean()
    assert auc > 0.97 and (good >= 0.3).mean() > 0.98 and (bad < 0.3).mean() > 0.7


def test_score_is_the_sparse_dot_product(make_docs):
    rng = np.random.default_rng(1)
    w = rng.normal(size=C.SLOTS + 1)
    texts = [None, "", "One one two!!", "ß😀 42 a_b", "x " * 30_000]
    got = [r.score for r in C.score(make_docs(texts).withColumn("label", F.lit("clash")), w).orderBy("doc_id").collect()]
    want = []
    for t in texts:
        toks = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t or "")
        h = [zlib.crc32(x.encode()) for x in toks]
        keys = [x * 0x9E3779B97F4A7C15 for x in h] + [a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F for a, b in zip(h, h[1:])]
        keys += [C.TWIN for a, b in zip(h, h[1:]) if a == b]
        count = {}
        for k in keys:
            count[k % 2**64 >> 46] = count.get(k % 2**64 >> 46, 0) + 1
        norm = sum(np.log1p(c) ** 2 for c in count.values()) ** 0.5
        s = w[-1] + sum(w[k] * np.log1p(c) / norm for k, c in count.items())
        want.append(1 / (1 + np.exp(-s)))
    assert got == pytest.approx(want)


def test_ftrl_update_follows_the_published_rule():
    m = C.Ftrl(0.5, 1.0, 0.1, 0.2)
    z = n = 0.0
    for x, y in [(1.0, 1), (2.0, 0), (0.5, 1), (1.5, 1)]:
        w = 0.0 if abs(z) <= 0.1 else -(z - (0.1 if z > 0 else -0.1)) / ((1.0 + n**0.5) / 0.5 + 0.2)
        g = (1 / (1 + np.exp(-w * x)) - y) * x
        z += g - ((n + g * g) ** 0.5 - n**0.5) / 0.5 * w
        n += g * g
        m.learn(np.array([7]), np.array([x]), y)
        assert (m.z[7], m.n[7]) == pytest.approx((z, n))


def test_labels_that_teach_nothing(spark, make_docs):
    docs = make_docs(["a b", None, "c"])
    none = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert not C.train(docs, none, "quality").any()
    assert [r.score for r in C.score(docs, C.train(docs, none, "quality")).collect()] == [0.5] * 3
    assert C.score(make_docs([]), C.train(make_docs([]), none.limit(0), "quality")).count() == 0
    absent = none.select((F.col("doc_id") + 900).alias("doc_id"), F.lit(1).alias("quality"))
    assert not C.train(docs, absent, "quality").any()
    one = C.train(docs, docs.select("doc_id", F.lit(1).alias("quality")), "quality")
    assert all(r.score > 0.5 for r in C.score(docs, one).collect())


def test_bounded_sample_and_shards(spark, make_docs):
    docs = make_docs([("good plain text" if i % 2 else "b@d !!! ###") + f" {i}" for i in range(400)])
    labelled = docs.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    labels = labelled.select("doc_id", "quality")
    w = C.train(docs, labels, "quality", max_rows=200, shard_rows=60)
    got = C.score(labelled, w).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
    again = C.train(docs.repartition(3), labels, "quality", max_rows=200, shard_rows=60)
    assert np.array_equal(w, again)
