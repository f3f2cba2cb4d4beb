"""Readers and writers: given tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.operators.scores import rank_normalize
from gleaner.operators.search import append_generation
from gleaner.operators.selection import rds_max
from gleaner.plans.registry import KS, SQL_ITEMS, SQL_PAIRS, SQL_SCORES, items, pool, query, r6, scores, table, target
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources import readers, writers


def _folder(spark, name: str) -> str:
    """A new folder in the place that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/gleaner-{name}-{uuid.uuid4().hex}"


@query("read_embeddings", "SELECT vec_id::VARCHAR AS item_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings")
def read_embeddings(spark, sf):
    path = _folder(spark, "jsonl")
    rows = items(spark, sf).select(F.col("item_id").cast("string").alias("image"), F.col("vec").alias("embedding"))
    rows.write.json(path)
    found = readers.read_embeddings(spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return found.select("item_id", F.size("vec").cast("long").alias("n"), (F.round(total, 4) + 0.0).alias("total"))


@query("read_embedding_map", """SELECT vec_id::VARCHAR AS item_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM embeddings""")
def read_embedding_map(spark, sf):
    """Each key is written twice, first with a wrong vector: the last line counts."""
    path = _folder(spark, "map")
    rows = items(spark, sf).select(F.col("item_id").cast("string").alias("image"), F.col("vec").alias("embedding"))
    old = rows.withColumn("embedding", F.transform("embedding", lambda x: x + 1))
    twice = rows.withColumn("o", F.lit(1)).unionByName(old.withColumn("o", F.lit(0)))
    twice.repartition("image").sortWithinPartitions("image", "o").drop("o").write.json(path)
    return readers.read_embedding_map(spark, path).select("item_id", r6(F.col("vec")[0]).alias("first"))


@query("read_id_list", "SELECT doc_id::VARCHAR AS item_id FROM documents")
def read_id_list(spark, sf):
    path = _folder(spark, "ids")
    table(spark, sf, "documents").select(F.concat(F.lit("  "), F.col("doc_id"), F.lit(" \n"))).write.text(path)
    return readers.read_id_list(spark, path)


@query("score_store", f"""WITH {SQL_SCORES}, r AS (SELECT method, item_id, rank() OVER (PARTITION BY method ORDER BY score DESC) AS first,
      count(*) OVER (PARTITION BY method, score) AS ties, count(*) OVER (PARTITION BY method) AS n FROM scores)
    SELECT method, item_id, round(1 - (first - 1 + (ties - 1) / 2.0::DOUBLE) / (n - 1), 6) + 0.0 AS score FROM r""")
def score_store(spark, sf):
    """Normalised scores of two repeats; one repeat is read back by partition pruning."""
    path = _folder(spark, "scores")
    known = rank_normalize(scores(spark, sf)).withColumn("repeat", F.explode(F.array(F.lit(1), F.lit(2))))
    writers.write_scores(known, path)
    return readers.read_aligned_scores(spark, path, repeat=2).select("method", "item_id", r6("score").alias("score"))


@query("detect_repeats", "SELECT unnest([1, 2, 3]) AS repeat")
def detect_repeats(spark, sf):
    path = _folder(spark, "repeats")
    writers.write_scores(scores(spark, sf).withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))), path)
    return readers.detect_repeats(readers.read_scores(spark, path), "spend")


@query("subset_store", f"""WITH {SQL_ITEMS}, {SQL_PAIRS}, sc AS (SELECT item_id, max(s) AS s FROM pairs GROUP BY 1),
    ranked AS (SELECT row_number() OVER (ORDER BY s DESC, item_id) AS rank, item_id FROM sc)
    SELECT 'rds_max' AS method, k, 20 * k AS budget, rank, item_id FROM ranked, (SELECT unnest([1, 5, 10, 15]) AS k) WHERE rank <= 20 * k""")
def subset_store(spark, sf):
    path = _folder(spark, "subsets")
    writers.write_subsets(rds_max(pool(spark, sf), target(spark, sf), 20 * max(KS)).ranking, "rds_max", KS, 20, path)
    return spark.read.parquet(path).select("method", "k", "budget", "rank", "item_id")


@query("selection_store", f"""WITH {SQL_ITEMS}, {SQL_PAIRS} SELECT item_id, round(max(s), 6) + 0.0 AS score FROM pairs GROUP BY 1""")
def selection_store(spark, sf):
    path = _folder(spark, "selection")
    writers.write_selection(rds_max(pool(spark, sf), target(spark, sf), 20), path)
    return writers.read_selection(spark, path).scores.select("item_id", r6("score").alias("score"))


@query("selection_ranking", f"""WITH {SQL_ITEMS}, {SQL_PAIRS}, sc AS (SELECT item_id, max(s) AS s FROM pairs GROUP BY 1)
    SELECT 'rds_max' AS method, 20 AS budget, row_number() OVER (ORDER BY s DESC, item_id) AS rank, item_id, round(s, 6) + 0.0 AS gain FROM sc
    ORDER BY s DESC, item_id LIMIT 20""")
def selection_ranking(spark, sf):
    """Ranking, method and budget of a stored selection."""
    path = _folder(spark, "ranking")
    writers.write_selection(rds_max(pool(spark, sf), target(spark, sf), 20), path)
    found = writers.read_selection(spark, path)
    return found.ranking.select(F.lit(found.method).alias("method"), F.lit(found.budget).alias("budget"), "rank", "item_id", r6("gain").alias("gain"))


@query("selected_ids", f"""WITH {SQL_ITEMS}, {SQL_PAIRS}, sc AS (SELECT item_id, max(s) AS s FROM pairs GROUP BY 1)
    SELECT row_number() OVER (ORDER BY s DESC, item_id) - 1 AS position, item_id::VARCHAR AS item_id FROM sc ORDER BY s DESC, item_id LIMIT 20""")
def selected_ids(spark, sf):
    """A selection as one JSON object whose list gives the order; the second of two possible keys is used."""
    path = _folder(spark, "selected")
    picks = rds_max(pool(spark, sf), target(spark, sf), 20).ranking
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("id"))))
    picks.agg(F.transform(listed, lambda x: x["id"]).alias("selected")).coalesce(1).write.json(path)
    found = readers.read_selected_ids(spark, path)
    return found.select(F.col("position").cast("long").alias("position"), "item_id")


@query("site_lists", "SELECT label::VARCHAR AS site, vec_id::VARCHAR AS subject_id FROM embeddings")
def site_lists(spark, sf):
    """One text file per site, named after it."""
    folder = _folder(spark, "sites")
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = items(spark, sf).select(F.col("site").cast("string").alias("site"), F.col("item_id").cast("string").alias("line"))
    rows.repartition("site").write.partitionBy("site").text(f"{folder}-parts")
    files.mkdirs(jvm.Path(folder))
    for part in files.globStatus(jvm.Path(f"{folder}-parts/site=*/part-*")):  # one file per site
        site = part.getPath().getParent().getName().removeprefix("site=")
        files.rename(part.getPath(), jvm.Path(f"{folder}/{site}.txt"))
    return readers.read_site_lists(spark, folder)


@query("search_history", """SELECT year(o_orderdate) - 1992 AS gen, count(*) AS n, round(max(o_totalprice), 2) AS best FROM orders GROUP BY 1""")
def search_history(spark, sf):
    """All generations stored one after another, some of them twice as after a crash, and then read back."""
    path = _folder(spark, "history")
    orders = table(spark, sf, "orders").select(
        (F.year("o_orderdate") - 1992).cast("int").alias("gen"), F.col("o_orderkey").alias("cand"), F.col("o_totalprice").alias("fitness")
    )
    generations = [r.gen for r in orders.select("gen").distinct().orderBy("gen").collect()]
    for gen in [*generations, *generations[::3]]:
        append_generation(orders.filter(F.col("gen") == gen), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("gen").cast("long").alias("gen")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("fitness"), 2).alias("best"))


@query("vector_store", "SELECT count(*) AS n_items, 64 AS dim FROM embeddings")
def vector_store(spark, sf):
    path = _folder(spark, "vectors")
    writers.write_vectors(items(spark, sf).select("item_id", "vec"), path)
    found = readers.read_vectors(spark, path, f"{path}_info")
    return found.agg(F.count(F.lit(1)).alias("n_items"), F.max(F.size("vec")).alias("dim"))


def _bundle(spark, sf):
    """Sites as splits: label 0 trains, 1 validates and 2 tests the target, the rest is source."""
    names = {0: "target_train", 1: "target_val", 2: "target_test"}
    split = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("site")], F.lit("source_train"))
    return items(spark, sf).withColumn("split", split)


@query("target_all", "SELECT vec_id AS item_id, label AS site FROM embeddings WHERE label IN (0, 1, 2)")
def target_all(spark, sf):
    return readers.split_bundle(_bundle(spark, sf), "target_all").select("item_id", "site")


@query("all_union", "SELECT vec_id AS item_id, label AS site FROM embeddings")
def all_union(spark, sf):
    return readers.split_bundle(_bundle(spark, sf), "all_union").select("item_id", "site")


@query("source_train", "SELECT vec_id AS item_id, label AS site FROM embeddings WHERE label > 2")
def source_train(spark, sf):
    return readers.split_bundle(_bundle(spark, sf), "source_train").select("item_id", "site")
