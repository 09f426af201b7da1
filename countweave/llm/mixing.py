"""Mixing sources to target weights over a tree of levels, for example domain, language, source.

The token budget goes down the tree. At each node the children share their parent's budget in
proportion to their weights; a child that has less than its share gives all it has, and what
it lacks goes to its siblings. Only what all siblings together cannot supply is missing above, where the
parent's own siblings take it. A leaf with budget b and supply t gives every document
b // t times, and of one more epoch, in an order drawn from (seed, epoch, id), the longest
prefix that fits the rest.

All token arithmetic is on whole numbers. Leaves and nodes are tables of a row each. A leaf's last
epoch is cut by sums over slices of its order, about SLICE documents each, so only the
one slice that holds the cut is put in order, however large the leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep, table

SLICE = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _whole(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def _weight(path: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[path].cast("long"), F.lit(1).cast("long"))


def shared_out(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """nodes (parents, node, weight, capacity, budget of the parent) with `share`, what each node gets.

    Children short of supply come first in the order capacity / weight, so they are a prefix; the
    others split what is left in proportion, rounded down. Weight 0 gets nothing.
    """
    live = F.col("weight") > 0
    siblings = Window.partitionBy(*parents, live).orderBy(F.try_divide("capacity", "weight"), "node")
    before = F.coalesce(F.sum("capacity").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(siblings.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy(*parents, live)
    marked = nodes.select("*", (_whole("capacity") * _whole(after) <= _whole(F.col("budget") - before) * _whole("weight")).alias("short"))
    left = F.col("budget") - F.sum(F.when(F.col("short"), F.col("capacity")).otherwise(0)).over(whole)
    weight = F.sum(F.when(F.col("short"), 0).otherwise(F.col("weight"))).over(whole)
    return marked.withColumn("left", left).withColumn("open", weight).withColumn(
        "share", F.when(~live, F.lit(0)).when(F.col("short"), F.col("capacity"))
        .otherwise(F.expr("CAST(CAST(left AS DECIMAL(19,0)) * CAST(weight AS DECIMAL(19,0)) div open AS BIGINT)"))
    ).drop("short", "left", "open")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, int], budget: Column,
                 max_epochs: int) -> DataFrame:
    """leaves (levels, supply, n_docs) with `share`: tokens to take from each leaf."""
    leaves = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("supply")).select(budget.cast("long").alias("budget"))
    above, parents = total, []
    for level in levels:
        own = [*parents, level]
        sums = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("node", F.col(level)) \
            .withColumn("weight", _weight(F.concat_ws("/", *own), weights))
        nodes = sums.join(above, parents) if parents else sums.join(F.broadcast(above))  # a row with the total
        above = shared_out(nodes, parents).select(*own, F.col("share").alias("budget"))
        parents = own
    return leaves.join(above.withColumnRenamed("budget", "share"), levels)


def mixed(docs: DataFrame, levels: dict[str, Column], weights: dict[str, int], budget_share: float = 0.8,
          max_epochs: int = 1, seed: int = 0, id_column: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """One row per row of docs: id, row, the levels, n_tokens and copies (0: not chosen).

    levels: names and columns from the root down; null is the value "". weights: by path of values
    joined with "/", 1 where none is given. budget_share: of all tokens there are. tokens: words of `text`
    unless given. Rows without tokens are chosen where the cut lies behind them. Repeated rows each
    have their place, one behind the other; null ids are an id of their own, last among equals.
    An empty table gives no rows. Other columns are not read.
    """
    names = list(levels)
    inner = [f"__l{i}" for i in range(len(names))]
    tokens = n_words(F.col("text")) if tokens is None else tokens
    rows = keep(docs.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                            *[F.coalesce(levels[n].cast("string"), F.lit("")).alias(i) for n, i in zip(names, inner)],
                            tokens.alias("n_tokens")))
    leaves = keep(rows.groupBy(*inner).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs")))
    budget = F.floor(F.col("supply") * budget_share)
    shares = leaf_budgets(leaves, inner, weights, budget, max_epochs).withColumn(
        "epochs", F.when(F.col("supply") > 0, F.expr("share div supply")).otherwise(F.lit(0))).select(
        *inner, "epochs", (F.col("share") - F.col("epochs") * F.col("supply")).alias("rest"),
        F.ceil(F.col("n_docs") / SLICE).alias("n_slices"))
    shares = keep(shares)
    drawn = rows.join(shares, inner).withColumn(
        "draw", F.md5(F.concat_ws(":", F.lit(seed), "epochs", F.coalesce(F.col("id").cast("string"), F.lit("")))))
    at = F.conv(F.substring("draw", 1, 7), 16, 10).cast("long")
    drawn = keep(drawn.withColumn("slice", F.shiftright(at * F.col("n_slices"), 28)))
    slices = drawn.groupBy(*inner, "slice", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*inner).orderBy("slice"))
    cuts = slices.select(*inner, "slice", "rest", "n", upto.alias("upto")).where("upto > rest").groupBy(*inner).agg(
        F.min("slice").alias("cut"), F.min(F.col("upto")).alias("upto"), F.min_by("n", "slice").alias("n")) \
        .select(*inner, "cut", (F.col("upto") - F.col("n")).alias("before"))
    placed = drawn.join(keep(cuts), inner, "left")  # a row a leaf: sent whole where small, else a plain join
    whole = placed.where("cut IS NULL OR slice <> cut").withColumn("chosen", F.expr("cut IS NULL OR slice < cut"))
    order = Window.partitionBy(*inner, "slice").orderBy("draw", F.col("id").asc_nulls_last(), "row")
    some = placed.where("slice = cut").withColumn(
        "chosen", F.col("before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("rest"))
    return whole.unionByName(some).select(
        "id", "row", *[F.col(i).alias(n) for n, i in zip(names, inner)], "n_tokens",
        (F.col("epochs") + F.col("chosen").cast("long")).alias("copies"))


def take(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as it was chosen, all its columns as they are; ids must be unique."""
    name = options.get("id_column", "doc_id")
    chosen = mixed(docs, **options).where("copies > 0").select("id", "copies")
    # a row travels as one struct, so no column of docs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), docs[name].cast("long").alias("own"))
    left = rows.join(chosen, F.col("own").eqNullSafe(F.col("id")))
    return left.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


#: The tree of the given documents: sources belong to domains.
DOMAIN = """CASE WHEN source IN ('src10', 'src11', 'src12', 'src13', 'src14') THEN 'books'
 WHEN source IN ('src15', 'src16', 'src17', 'src18', 'src19') THEN 'reference' ELSE 'web' END"""
WEIGHTS = {"web": 5, "books": 3, "reference": 2, "web/en": 5, "web/de": 2, "web/fr": 2, "web/es": 1,
           "books/en": 3, "reference/en": 4, "web/en/src0": 6, "web/de/src0": 2, "web/fr/src0": 2}


def document_levels() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"), document_levels(), WEIGHTS, budget_share=0.75, max_epochs=3, seed=17)
    return found.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "copies")


def _level_sql(level: int, names: list[str], weights: dict[str, int]) -> str:
    own, up = names[:level], names[:level - 1]
    path = " || '/' || ".join(own)
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items() if k.count("/") == level - 1)
    weight = f"CASE {path} {cases} ELSE 1 END" if cases else "1"
    cols, by = ", ".join(own), f"PARTITION BY {', '.join(up)}" if up else ""
    source = f"JOIN s{level - 1} USING ({', '.join(up)})" if up else ", top"
    return f"""
n{level} AS (SELECT {cols}, CAST(sum(supply) * {{epochs}} AS HUGEINT) AS capacity, CAST({weight} AS HUGEINT) AS weight FROM leaf GROUP BY {cols}),
m{level} AS (SELECT n.*, budget, capacity * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
   <= (budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS short
  FROM n{level} n {source} WINDOW o AS ({by} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {names[level - 1]})),
s{level} AS (SELECT {cols}, CASE WHEN short THEN capacity ELSE
   (budget - sum(CASE WHEN short THEN capacity ELSE 0 END) OVER ({by})) * weight
   // sum(CASE WHEN short THEN 0 ELSE weight END) OVER ({by}) END AS budget FROM m{level}),"""


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {DOMAIN} AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS supply FROM d GROUP BY ALL),
top AS (SELECT CAST(floor(sum(supply) * 0.75) AS HUGEINT) AS budget FROM leaf),
{''.join(_level_sql(k, ['domain', 'lang', 'source'], WEIGHTS) for k in (1, 2, 3)).format(epochs=3)}
e AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs, budget, supply
  FROM leaf JOIN s3 USING (domain, lang, source)),
r AS (SELECT d.*, epochs, budget - epochs * supply AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('17:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epochs + CAST(upto <= rest AS INT) AS BIGINT) AS copies FROM r
"""
