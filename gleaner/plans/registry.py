"""Name -> query and SQL, and the inputs that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Items picked by the greedy queries, and budget factors of the nested subsets.
BUDGET = 10
KS = (1, 5, 10, 15)


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(col: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ vectors


def items(spark, sf_dir) -> DataFrame:
    """All embeddings; the label stands for the site."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("site")
    )


def pool(spark, sf_dir) -> DataFrame:
    return items(spark, sf_dir).filter(F.col("site") != 0)


def target(spark, sf_dir) -> DataFrame:
    return items(spark, sf_dir).filter(F.col("site") == 0)


def slices(spark, sf_dir) -> DataFrame:
    """Five slices per subject."""
    return items(spark, sf_dir).select(
        F.expr("item_id div 5").alias("subject_id"), (F.col("item_id") % 5).cast("int").alias("slice_idx"), "vec", "site"
    )


def gradients(df: DataFrame) -> DataFrame:
    """The same vectors with seven different lengths."""
    return df.withColumn("vec", F.transform("vec", lambda x: x * (1 + F.col("item_id") % 7)))


#: SQL: all items with length, and with unit vectors split into pool and target.
SQL_ITEMS = """items AS (
  SELECT item_id, site, v, list_transform(v, lambda x: x / greatest(nrm, 1e-8)) AS u FROM (
    SELECT vec_id AS item_id, label AS site, embedding::DOUBLE[] AS v,
           sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings)),
pool AS (SELECT * FROM items WHERE site <> 0),
q AS (SELECT * FROM items WHERE site = 0)"""

#: The same with the seven lengths of ``gradients``.
SQL_GRADIENTS = """items AS (
  SELECT item_id, site, v, list_transform(v, lambda x: x / greatest(nrm, 1e-8)) AS u FROM (
    SELECT item_id, site, v, sqrt(list_inner_product(v, v)) AS nrm FROM (
      SELECT vec_id AS item_id, label AS site,
             list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS v FROM embeddings))),
pool AS (SELECT * FROM items WHERE site <> 0),
q AS (SELECT * FROM items WHERE site = 0)"""


def sql_mean(source: str, column: str = "v", name: str = "center") -> str:
    """CTE with one row: the mean vector ``c`` of a table's vectors."""
    return (
        f"{name} AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM "
        f"(SELECT unnest({column}) AS x, generate_subscripts({column}, 1) AS i FROM {source}) GROUP BY i))"
    )


#: SQL: cosines of every pool item with every target item.
SQL_PAIRS = "pairs AS (SELECT p.item_id, q.item_id AS q_id, list_inner_product(p.u, q.u) AS s FROM pool p, q)"


def sql_greedy(score: str, first: str | None = None, budget: int = BUDGET, tie: int = 12) -> str:
    """Recursive CTE ``g``: each step picks the pool item with the largest ``score``.

    ``score`` may use ``vs`` (picked vectors of column v), ``us`` (unit ones), ``step``
    (picks so far) and the item's ``v`` and ``u``; ``first`` is a select of item_id, v, u, s
    for a first pick of its own.
    """
    base = (
        f"SELECT 1 AS step, [f.item_id] AS ids, [f.v] AS vs, [f.u] AS us, f.item_id AS item_id, f.s::DOUBLE AS s FROM ({first}) f"
        if first
        else "SELECT 0 AS step, []::BIGINT[] AS ids, []::DOUBLE[][] AS vs, []::DOUBLE[][] AS us, NULL::BIGINT AS item_id, NULL::DOUBLE AS s"
    )
    return f"""g AS (
  {base}
  UNION ALL
  SELECT step + 1, list_append(ids, b.id), list_append(vs, b.v), list_append(us, b.u), b.id, b.s FROM (
    SELECT step, ids, vs, us, arg_min({{'id': item_id, 'v': v, 'u': u, 's': s}}, {{'k': -round(s, {tie}), 'id': item_id}}) AS b FROM (
      SELECT g.step, g.ids, g.vs, g.us, p.item_id, p.v, p.u, {score} AS s
      FROM g, pool p{', center' if 'center.c' in score else ''} WHERE g.step < {budget} AND NOT list_contains(g.ids, p.item_id))
    GROUP BY step, ids, vs, us))"""


# ------------------------------------------------------------------ scores


def scores(spark, sf_dir) -> DataFrame:
    """Three scores per customer: balance, number of orders (many ties), money spent."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_acctbal").alias("acctbal"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(
        F.count("o_orderkey").cast("double").alias("n_orders"), F.sum("o_totalprice").alias("spend")
    )
    wide = customer.join(orders, "item_id")
    return wide.select(
        "item_id", F.explode(F.create_map(*[
            x for m in ("acctbal", "n_orders", "spend") for x in (F.lit(m), F.round(m, 2))
        ])).alias("method", "score")
    )


def partial_scores(spark, sf_dir) -> DataFrame:
    """Scores that do not cover the same items: balance is known above zero only."""
    return scores(spark, sf_dir).filter((F.col("method") != "acctbal") | (F.col("score") > 0))


SQL_SCORES = """scores AS (
  WITH o AS (SELECT o_custkey AS item_id, count(o_orderkey)::DOUBLE AS n_orders, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1),
  w AS (SELECT c_custkey AS item_id, round(c_acctbal, 2) AS acctbal, n_orders, spend FROM customer JOIN o ON c_custkey = item_id)
  SELECT item_id, 'acctbal' AS method, acctbal AS score FROM w
  UNION ALL SELECT item_id, 'n_orders', n_orders FROM w
  UNION ALL SELECT item_id, 'spend', spend FROM w)"""

SQL_PARTIAL = SQL_SCORES + ",\npart AS (SELECT * FROM scores WHERE method <> 'acctbal' OR score > 0)"
