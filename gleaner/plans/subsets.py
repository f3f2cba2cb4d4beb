"""Splits, samples and manifests over customers, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import evaluate, manifest, splits
from gleaner.plans.registry import KS, query, r6, slices, table


def subjects(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("stratum"))


def membership(spark, sf):
    """Customers by nation; those of the Middle East belong to no site."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = nation.filter(F.col("r_name") != "MIDDLE EAST").select("n_nationkey", F.col("n_name").alias("site"))
    return table(spark, sf, "customer").join(known, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "site", F.col("c_custkey").alias("subject_id")
    )


def sourced(spark, sf):
    """Orders' customers per order priority: a subject can be listed at several sites."""
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("site"), F.col("o_custkey").alias("subject_id")).distinct()


SQL_MEMBERS = """membership AS (SELECT n_name AS site, c_custkey AS subject_id FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST')"""
SQL_SITED = f"{SQL_MEMBERS}, sited AS (SELECT c_custkey AS subject_id, coalesce(site, 'UNKNOWN') AS site FROM customer LEFT JOIN membership ON c_custkey = subject_id)"


@query("attach_site", f"WITH {SQL_SITED} SELECT subject_id, site FROM sited")
def attach_site(spark, sf):
    return splits.attach_site(subjects(spark, sf).select("subject_id"), membership(spark, sf))


@query("attach_site_first", """SELECT c_custkey AS subject_id, coalesce(min(o_orderpriority), 'UNKNOWN') AS site
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def attach_site_first(spark, sf):
    return splits.attach_site(subjects(spark, sf).select("subject_id"), sourced(spark, sf))


@query("site_distribution", f"WITH {SQL_SITED} SELECT site, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM sited), 6) AS pct FROM sited GROUP BY 1")
def site_distribution(spark, sf):
    found = evaluate.site_distribution(subjects(spark, sf), membership(spark, sf))
    return found.select("site", "n", r6("pct").alias("pct"))


@query("source_pool_file", "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def source_pool_file(spark, sf):
    return splits.source_pool(sourced(spark, sf), ["1-URGENT", "2-HIGH"], "file")


@query("source_pool_subject", """SELECT DISTINCT o_custkey AS subject_id FROM orders
    WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))""")
def source_pool_subject(spark, sf):
    return splits.source_pool(sourced(spark, sf), ["1-URGENT", "2-HIGH"], "subject")


_SPLIT = """sp AS (SELECT c_custkey AS subject_id, CASE WHEN r <= 500 THEN 'train' WHEN r <= 700 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('2025:' || c_custkey), c_custkey) AS r FROM customer))"""


def _split(spark, sf):
    return splits.three_way_split(subjects(spark, sf).select("subject_id"), 500, 200)


@query("three_way_split", f"WITH {_SPLIT} SELECT * FROM sp")
def three_way_split(spark, sf):
    return _split(spark, sf)


@query("target_set", f"WITH {_SPLIT} SELECT * FROM sp WHERE split IN ('train', 'val')")
def target_set(spark, sf):
    return splits.target_set(_split(spark, sf))


_STRATA = """st AS (SELECT c_custkey AS subject_id, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment
      ORDER BY md5('2025:' || c_custkey), c_custkey) AS r FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    n AS (SELECT round_even(60 * avg((stratum = 'BUILDING')::INT), 0)::INT AS take FROM st),
    t AS (SELECT take, round_even(45 * take / 60.0::DOUBLE, 0)::INT AS tr FROM n),
    sp AS (SELECT subject_id, stratum, CASE WHEN r <= CASE WHEN stratum = 'BUILDING' THEN tr ELSE 45 - tr END THEN 'train'
      WHEN r <= CASE WHEN stratum = 'BUILDING' THEN take ELSE 60 - take END THEN 'val' ELSE 'test' END AS split FROM st, t)"""


def _stratified(spark, sf):
    return splits.stratified_split(subjects(spark, sf), ["BUILDING", "MACHINERY"], 60, 45)


@query("stratified_split", f"WITH {_STRATA} SELECT subject_id, stratum, split FROM sp")
def stratified_split(spark, sf):
    return _stratified(spark, sf).select("subject_id", "stratum", "split")


@query("split_summary", f"WITH {_STRATA} SELECT split, stratum, count(*) AS n FROM sp GROUP BY ROLLUP (split, stratum)")
def split_summary(spark, sf):
    return splits.split_summary(_stratified(spark, sf))


@query("random_budgets", """WITH o AS (SELECT seed, c_custkey AS subject_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || c_custkey), c_custkey) AS rank
      FROM customer, (SELECT unnest([0, 1, 2]) AS seed))
    SELECT seed, k, 30 * k AS budget, subject_id, rank FROM o, (SELECT unnest([1, 5, 10, 15]) AS k) WHERE rank <= 30 * k""")
def random_budgets(spark, sf):
    found = splits.random_budgets(subjects(spark, sf).select("subject_id"), [0, 1, 2], KS, 30)
    return found.select("seed", "k", "budget", "subject_id", "rank")


@query("sample_subjects", """SELECT l_orderkey AS subject_id, count(*) AS n FROM lineitem WHERE l_orderkey IN
    (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY md5('0:' || l_orderkey), l_orderkey LIMIT 15) GROUP BY 1""")
def sample_subjects(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("subject_id"))
    return splits.sample_subjects(lines, 15).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("cap_slices", """SELECT subject_id, slice_idx FROM (SELECT vec_id // 5 AS subject_id, vec_id % 5 AS slice_idx, row_number() OVER (
    PARTITION BY vec_id // 5 ORDER BY md5('0:' || (vec_id // 5) || '/' || (vec_id % 5)), vec_id % 5) AS r FROM embeddings) WHERE r <= 3""")
def cap_slices(spark, sf):
    return splits.cap_slices(slices(spark, sf), 3).select("subject_id", F.col("slice_idx").cast("long").alias("slice_idx"))


def _flagged(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("is_foreground"))


@query("sample_weights", """WITH n AS (SELECT count(*) FILTER (toxic = 1) AS fg, count(*) FILTER (toxic <> 1) AS bg FROM labels)
    SELECT doc_id AS item_id, round(CASE WHEN toxic = 1 THEN 0.33::DOUBLE / fg ELSE (1 - 0.33::DOUBLE) / bg END, 9) AS weight FROM labels, n""")
def sample_weights(spark, sf):
    return splits.sample_weights(_flagged(spark, sf)).select("item_id", F.round("weight", 9).alias("weight"))


@query("weighted_sample", """WITH f AS (SELECT doc_id AS item_id, toxic = 1 AS fg, row_number() OVER (PARTITION BY toxic = 1 ORDER BY doc_id) AS r,
      count(*) OVER (PARTITION BY toxic = 1) AS n FROM labels),
    d AS (SELECT i AS draw, ('0x' || md5('0:' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.33 AS fg,
      ('0x' || md5('1:' || i)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT count(*) FROM labels))) AS i))
    SELECT draw, item_id, d.fg AS is_foreground FROM d JOIN f ON d.fg = f.fg AND f.r = floor(u * n) + 1""")
def weighted_sample(spark, sf):
    flagged = _flagged(spark, sf)
    return splits.weighted_sample(flagged, flagged.count())


# ------------------------------------------------------------------ joins and manifests


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source")


def labelled(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic")


@query("filter_ids", "SELECT doc_id AS item_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_ids(spark, sf):
    return manifest.filter_ids(documents(spark, sf), labelled(spark, sf))


@query("filter_report", "SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS requested, count(*) AS kept FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_report(spark, sf):
    return manifest.filter_report(documents(spark, sf), labelled(spark, sf))


@query("filter_subjects", """WITH s AS (SELECT (vec_id // 5)::VARCHAR AS subject_id, (vec_id // 5) || '_slice' || (vec_id % 5) AS slice_name FROM embeddings),
    ids AS (SELECT s_suppkey::VARCHAR AS id FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT p_partkey || '_slice0' FROM part)
    SELECT subject_id, slice_name FROM s WHERE subject_id IN (SELECT id FROM ids) OR slice_name IN (SELECT id FROM ids)""")
def filter_subjects(spark, sf):
    subject = F.col("subject_id").cast("string")
    named = slices(spark, sf).select(subject.alias("subject_id"), F.concat_ws("_slice", subject, "slice_idx").alias("slice_name"))
    ids = table(spark, sf, "supplier").filter(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").cast("string").alias("id"))
    first = table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("_slice0")).alias("id"))
    return manifest.filter_subjects(named, ids.unionByName(first))


@query("pair_images_labels", "SELECT doc_id AS item_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def pair_images_labels(spark, sf):
    return manifest.pair_images_labels(documents(spark, sf), labelled(spark, sf))


@query("missing_pairs", """SELECT doc_id AS item_id, 'image' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def missing_pairs(spark, sf):
    return manifest.unpaired(documents(spark, sf), labelled(spark, sf))


@query("match_images", """WITH l AS (SELECT doc_id || '_seg' AS name FROM documents), i AS (SELECT doc_id::VARCHAR AS name FROM labels)
    SELECT l.name, replace(l.name, '_seg', '') AS image_name, i.name IS NOT NULL AS matched FROM l LEFT JOIN i ON i.name = replace(l.name, '_seg', '')""")
def match_images(spark, sf):
    names = documents(spark, sf).select(F.concat(F.col("item_id").cast("string"), F.lit("_seg")).alias("name"))
    images = labelled(spark, sf).select(F.col("item_id").cast("string").alias("name"))
    return manifest.match_images(names, images).select("name", "image_name", "matched")


def inventory(spark, sf):
    """Files: every document in its source folder, labelled ones also compressed in a first folder."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    plain = documents(spark, sf).select(
        F.col("item_id").alias("case_id"), F.col("source").alias("dir"), number.alias("dir_priority"),
        F.when(F.col("lang") == "en", ".npy").otherwise(".npz").alias("ext"),
    )
    packed = labelled(spark, sf).select(
        F.col("item_id").alias("case_id"), F.lit("labelled").alias("dir"), F.lit(3).alias("dir_priority"), F.lit(".npz").alias("ext")
    )
    return plain.unionByName(packed)


SQL_INVENTORY = """inv AS (SELECT doc_id AS case_id, source AS dir, regexp_extract(source, '(\\d+)$', 1)::INT AS p,
      CASE WHEN lang = 'en' THEN '.npy' ELSE '.npz' END AS ext FROM documents
    UNION ALL SELECT doc_id, 'labelled', 3, '.npz' FROM labels)"""


def _cases(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))


@query("resolve_sources", f"""WITH {SQL_INVENTORY} SELECT case_id, dir, ext FROM (SELECT *, row_number() OVER (PARTITION BY case_id
    ORDER BY p, CASE ext WHEN '.npy' THEN 1 ELSE 2 END, dir) AS r FROM inv) WHERE r = 1""")
def resolve_sources(spark, sf):
    return manifest.resolve_sources(_cases(spark, sf), inventory(spark, sf))


@query("todo_anti", """SELECT doc_id AS case_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en')""")
def todo_anti(spark, sf):
    """Done: a document, a label and an English text."""
    docs = documents(spark, sf)
    outputs = [
        docs.select(F.col("item_id").alias("case_id"), F.lit("image").alias("kind")),
        labelled(spark, sf).select(F.col("item_id").alias("case_id"), F.lit("label").alias("kind")),
        docs.filter(F.col("lang") == "en").select(F.col("item_id").alias("case_id"), F.lit("properties").alias("kind")),
    ]
    done = outputs[0].unionByName(outputs[1]).unionByName(outputs[2])
    return manifest.pending(_cases(spark, sf), done, ["image", "label", "properties"])


@query("missing_report", """SELECT count(*) AS requested, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS found,
    count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM documents""")
def missing_report(spark, sf):
    return manifest.missing_report(documents(spark, sf), labelled(spark, sf), "item_id")


_MANIFEST = f"""WITH {SQL_INVENTORY}, asked AS (SELECT doc_id AS case_id, 'selected' AS role, 'train' AS split FROM documents WHERE lang IN ('en', 'fr')
    UNION ALL SELECT doc_id, 'target_train', 'train' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'target_val', 'val' FROM labels WHERE quality = 0),
    src AS (SELECT case_id, dir FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p, dir) AS r FROM inv WHERE ext = '.npy') WHERE r = 1),
    man AS (SELECT a.case_id, role, split, dir, dir IS NOT NULL AS linked FROM asked a LEFT JOIN src USING (case_id))"""


def _manifest(spark, sf):
    docs, labels = documents(spark, sf), labelled(spark, sf)
    selected = docs.filter(F.col("lang").isin("en", "fr")).select(F.col("item_id").alias("case_id"))
    train, val = (labels.filter(F.col("quality") == v).select(F.col("item_id").alias("case_id")) for v in (1, 0))
    return manifest.build_manifest(selected, train, val, inventory(spark, sf))


@query("manifest", f"{_MANIFEST} SELECT case_id, role, split, dir, linked FROM man")
def build_manifest(spark, sf):
    return _manifest(spark, sf)


@query("manifest_counts", f"""{_MANIFEST} SELECT coalesce(role, 'all') AS role, count(*) AS n_cases, count(*) FILTER (linked) AS n_linked
    FROM man GROUP BY ROLLUP (role)""")
def manifest_counts(spark, sf):
    return manifest.manifest_counts(_manifest(spark, sf))


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("subject_id"), F.col("l_linenumber").alias("z"), F.col("l_returnflag").alias("domain"),
        F.col("l_linestatus").alias("split"), (F.col("l_suppkey") % 4).cast("int").alias("label"),
    )


@query("subset_slices", """SELECT l_orderkey AS subject_id, l_linenumber AS z, l_returnflag AS domain FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderpriority = '1-URGENT'""")
def subset_slices(spark, sf):
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("subject_id"))
    return manifest.subset_slices(urgent, _lines(spark, sf)).select("subject_id", "z", "domain")


@query("missing_ids", "SELECT o_orderkey AS subject_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_ids(spark, sf):
    return manifest.missing_ids(table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject_id")), _lines(spark, sf))


@query("training_rows", """SELECT l_orderkey AS subject_id, l_linenumber AS z, 'source' AS origin FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderpriority = '1-URGENT' AND l_linestatus = 'F' UNION ALL SELECT l_orderkey, l_linenumber, 'target' FROM lineitem WHERE l_linestatus <> 'F'""")
def training_rows(spark, sf):
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("subject_id"))
    lines = _lines(spark, sf)
    done = F.col("split") == "F"
    return manifest.training_rows(urgent, lines.filter(done), lines.filter(~done)).select("subject_id", "z", "origin")


@query("domain_union", """SELECT l_orderkey AS subject_id, l_linenumber AS z, l_returnflag AS domain FROM lineitem
    WHERE l_returnflag = 'A' AND l_linestatus = 'F'
    UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
      AND (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_suppkey % 4 > 0)""")
def domain_union(spark, sf):
    lines = _lines(spark, sf)
    domains = [{"name": "A", "split": "F"}, {"name": "R", "split": "F", "skip_empty": True}]
    return manifest.domain_union(lines, domains, lines).select("subject_id", "z", "domain")
