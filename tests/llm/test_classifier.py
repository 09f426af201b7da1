import zlib

import numpy as np
import pyarrow as pa

from countweave.llm import arrays, classifier

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = classifier.op10_quality_classifier(spark, SF).collect()
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    test = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    good = [p for p, q in test if q == 1]
    bad = [p for p, q in test if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_linear_time_identity():
    rnd = np.random.default_rng(0)
    block = next(arrays.blocks(pa.array(["a b c a\n#x\n#x", "", None, "One TWO 3!! " * 40])))
    x = classifier.features(block)
    width = classifier.BUCKETS + len(classifier.STATISTICS)
    m = classifier.Machine(0.3, rnd.normal(size=width), rnd.normal(size=(width, 4)))
    for i, got in enumerate(m.margin(x)):
        p, v = x.place[x.first[i]:x.first[i + 1]], x.value[x.first[i]:x.first[i + 1]]
        pairs = sum(m.factor[p[a]] @ m.factor[p[b]] * v[a] * v[b] for a in range(len(p)) for b in range(a))
        assert abs(got - (m.bias + m.weight[p] @ v + pairs)) < 1e-3 * max(1, abs(got))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (2, "", 1), (2, "", 1), (3, "w " * 50_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = classifier.scored(docs, classifier.fit(docs, labels)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    assert classifier.drop_rejected(docs, labels).columns == docs.columns
    assert classifier.scored(docs.limit(0), classifier.fit(docs.limit(0), labels.limit(0))).collect() == []
