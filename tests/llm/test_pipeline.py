import re

from pyspark.sql import functions as F

import corpus_pipeline
from countweave.llm import classifier, queries, simhash
from countweave.llm.store import keep, table
from verification import compare

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_searches(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            rows = docs.collect()
            assert all(r == before[r.doc_id] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
            kept.append({r.doc_id for r in rows})
    scores = {r.id: r.score for r in classifier.scored(table(spark, SF, "documents"), classifier.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))).collect()}
    assert kept[0] == {i for i, s in scores.items() if s >= 0.3}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or "") for i in kept[0]}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    assert kept[1] == set(first.values())
    near = {r.id: r.component for r in simhash.near_duplicates(table(spark, SF, "documents").where(F.col("doc_id").isin(list(kept[1])))).collect()}
    assert kept[2] == set(near.values())
    assert kept[3] <= kept[2] and len(kept[3]) > 0.6 * len(kept[2])
    packed = docs.collect()
    assert {r.doc_id for r in packed} == kept[3]


def test_queries_agree_with_sql(spark):
    assert len(queries.QUERIES) == 13
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF).toPandas()
        said = compare.differs(got, compare.connect(SF).sql(sql).df())
        assert said is None, (name, said)
