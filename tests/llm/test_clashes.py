"""Tables whose own columns are called what the operators call theirs."""

from pyspark.sql import functions as F

from countweave.llm import classifier, exact, mixing, simhash

NAMES = ["copies", "__n", "__gone", "__id", "__y", "__text", "id", "y", "n", "row", "own", "of", "digest", "stays", "component", "text_sha256"]


def documents(spark):
    rows = [(i, f"words of the text number {i // 2} and {i // 2 * 7} more of them", "en", "src0") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in NAMES])


def same_rows(got, docs, ids):
    assert got.columns == docs.columns
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[0] for r in rows) == sorted(ids) and all(r == want[r[0]] for r in rows)


def test_exact_copies(spark):
    docs = documents(spark)
    same_rows(exact.drop_copies(docs), docs, range(0, 60, 2))


def test_near_copies(spark):
    docs = documents(spark)
    kept = [r.id for r in simhash.near_duplicates(docs).where("id = component").collect()]
    same_rows(simhash.keep_one(docs), docs, kept)


def test_mixing(spark):
    docs = documents(spark)
    options = dict(levels={"source": F.col("source")}, weights={}, budget_share=0.5, max_epochs=1, seed=1)
    ids = [r.id for r in mixing.mixed(docs, **options).where("copies > 0").collect()]
    same_rows(mixing.take(docs, **options), docs, ids)


def test_classifier(spark):
    docs = documents(spark)
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(1).alias("id"), F.lit("a").alias("text"))
    plain = classifier.fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    clashing = classifier.fit(docs, labels)
    score = lambda m: [r.score for r in classifier.scored(docs, m).orderBy("id").collect()]
    assert score(plain) == score(clashing)
    assert classifier.drop_rejected(docs, labels).columns == docs.columns
