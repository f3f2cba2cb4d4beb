"""Label and image operators.

Label voxels are order lines: subject = order, slice = line number, label = supplier mod 4.
Images are the embeddings: four vectors make the channels of a case, each an 8 x 8 image.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import aggregate, voxels as V
from gleaner.plans.registry import items, query, r6, table


def labels(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("subject_id"), F.col("l_linenumber").alias("z"), (F.col("l_suppkey") % 4).cast("int").alias("label")
    )


SQL_LABELS = "vox AS (SELECT l_orderkey AS subject_id, l_linenumber AS z, (l_suppkey % 4)::INT AS label FROM lineitem)"


def images(spark, sf):
    """Small values become 0, as outside the body of a scan."""
    rows = items(spark, sf).select(
        F.expr("item_id div 4").alias("subject_id"), F.lit(0).alias("z"), (F.col("item_id") % 4).cast("int").alias("channel"),
        F.posexplode("vec").alias("at", "value"),
    )
    return rows.select(
        "subject_id", "z", F.expr("at div 8").cast("int").alias("y"), (F.col("at") % 8).alias("x"), "channel",
        F.when(F.abs("value") < 0.1, 0.0).otherwise(F.col("value")).alias("value"),
    )


SQL_IMAGES = """vox AS (SELECT vec_id // 4 AS subject_id, 0 AS z, (i - 1) // 8 AS y, (i - 1) % 8 AS x, vec_id % 4 AS channel,
    CASE WHEN abs(v) < 0.1 THEN 0 ELSE v END AS value FROM (
      SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def _out(df, *drop):
    return df.select(*[r6(c).alias(c) if c == "value" else F.col(c).cast("long").alias(c) for c in df.columns if c not in drop])


_COLS = "subject_id, z, y, x, channel, round({}, 6) + 0.0 AS value"


# ------------------------------------------------------------------ labels


@query("drop_empty_slices", f"WITH {SQL_LABELS} SELECT DISTINCT subject_id, z FROM vox WHERE label > 0")
def drop_empty_slices(spark, sf):
    vox = labels(spark, sf)
    return V.drop_empty_slices(vox.select("subject_id", "z").distinct(), vox)


@query("foreground_slices", f"""WITH {SQL_LABELS} SELECT subject_id, z, count(*) FILTER (label > 0) AS n_positive, true AS is_foreground
    FROM vox GROUP BY 1, 2 HAVING count(*) FILTER (label > 0) >= 2""")
def foreground_slices(spark, sf):
    return V.foreground_slices(labels(spark, sf), 2)


@query("foreground_flags", f"""WITH {SQL_LABELS} SELECT subject_id, z, count(*) FILTER (label > 0) AS n_positive,
    count(*) FILTER (label > 0) >= 2 AS is_foreground FROM vox GROUP BY 1, 2""")
def foreground_flags(spark, sf):
    return V.foreground_slices(labels(spark, sf), 2, include_all=True)


@query("label_qc", """SELECT l_orderkey AS subject_id, count(DISTINCT l_linenumber) AS n_bad, max(l_linenumber) AS worst FROM lineitem
    WHERE l_linenumber NOT BETWEEN 0 AND 3 GROUP BY 1""")
def label_qc(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("subject_id"), F.col("l_linenumber").alias("label"))
    bad = V.label_range(lines)
    return bad.select("subject_id", F.size("bad_labels").cast("long").alias("n_bad"), F.element_at("bad_labels", -1).alias("worst"))


@query("label_values", "SELECT l_linenumber AS label, count(*) AS n, l_linenumber BETWEEN 0 AND 3 AS valid FROM lineitem GROUP BY 1")
def label_values(spark, sf):
    return V.label_values(table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("label")))


def _odd_labels(spark, sf):
    """Labels from -2 to 4."""
    return labels(spark, sf).withColumn("label", F.col("z") - 3)


@query("label_remap", """SELECT l_orderkey AS subject_id, l_linenumber AS z,
    CASE WHEN l_linenumber - 3 < 0 THEN 0 WHEN l_linenumber - 3 = 4 THEN 3 ELSE l_linenumber - 3 END AS label FROM lineitem""")
def label_remap(spark, sf):
    return V.remap_labels(_odd_labels(spark, sf), {4: 3}, negative_to=0)


@query("label_remap_report", """SELECT count(*) AS fixed_files, sum(n)::BIGINT AS fixed_pixels FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    WHERE l_linenumber - 3 < 0 OR l_linenumber - 3 = 4 GROUP BY 1, 2)""")
def label_remap_report(spark, sf):
    return V.remap_report(_odd_labels(spark, sf), {4: 3}, negative_to=0)


@query("slice_distribution", f"""WITH {SQL_LABELS}, s AS (SELECT subject_id, z, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 2) AS b FROM vox GROUP BY 1, 2)
    SELECT count(*) AS total_slices, count(*) FILTER (a = 0 AND b = 0) AS background_only, count(*) FILTER (a > 0 AND b = 0) AS first_only,
      count(*) FILTER (b > 0) AS second_slices, sum(a)::BIGINT AS first_pixels, sum(b)::BIGINT AS second_pixels,
      round(sum(b) / (sum(a) + sum(b))::DOUBLE, 6) AS second_ratio FROM s""")
def slice_distribution(spark, sf):
    return V.slice_distribution(labels(spark, sf)).withColumn("second_ratio", r6("second_ratio"))


@query("no_positive_subjects", f"""WITH {SQL_LABELS} SELECT subject_id, count(DISTINCT z) AS n_slices FROM vox GROUP BY 1 HAVING NOT bool_or(label = 2)""")
def no_positive_subjects(spark, sf):
    return V.negative_subjects(labels(spark, sf))


@query("slice_names", """SELECT (vec_id // 5)::VARCHAR AS subject_id, (vec_id % 5)::INT AS slice_idx, (vec_id // 5) || '_slice' || (vec_id % 5) AS slice_name FROM embeddings""")
def slice_names(spark, sf):
    path = F.concat(F.lit("/data/labels/"), F.expr("item_id div 5"), F.lit("_slice"), F.col("item_id") % 5, F.lit(".npy"))
    return V.slice_names(items(spark, sf).select(path.alias("path")))


# ------------------------------------------------------------------ intensities


@query("minmax_image", f"""WITH {SQL_IMAGES}, m AS (SELECT subject_id, z, min(value) AS lo, max(value) AS hi FROM vox GROUP BY 1, 2)
    SELECT {_COLS.format('(value - lo) / (hi - lo + 1e-8)')} FROM vox JOIN m USING (subject_id, z)""")
def minmax_image(spark, sf):
    return _out(V.minmax_image(images(spark, sf)))


@query("channel_standardize", f"""WITH {SQL_IMAGES}, m AS (SELECT subject_id, z, channel, min(value) AS lo, max(value) AS hi FROM vox GROUP BY 1, 2, 3)
    SELECT {_COLS.format("(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END - ([0.485, 0.456, 0.406]::DOUBLE[])[channel % 3 + 1]) / ([0.229, 0.224, 0.225]::DOUBLE[])[channel % 3 + 1]")}
    FROM vox JOIN m USING (subject_id, z, channel)""")
def channel_standardize(spark, sf):
    return _out(V.channel_standardize(images(spark, sf)))


_ZSCORE = """WITH {images}, m AS (SELECT subject_id, channel, avg(value) {f} AS m, stddev_pop(value) {f} AS s FROM vox GROUP BY 1, 2)
    SELECT {cols} FROM vox JOIN m USING (subject_id, channel)"""


@query("zscore_nonzero", _ZSCORE.format(images=SQL_IMAGES, f="FILTER (value > 0)", cols=_COLS.format("coalesce((value - m) / greatest(s, 1e-8), value)")))
def zscore_nonzero(spark, sf):
    return _out(V.zscore_channels(images(spark, sf)))


@query("zscore_all", _ZSCORE.format(images=SQL_IMAGES, f="", cols=_COLS.format("(value - m) / greatest(s, 1e-8)")))
def zscore_all(spark, sf):
    return _out(V.zscore_channels(images(spark, sf), nonzero_only=False))


@query("zscore_case", f"""WITH {SQL_IMAGES}, m AS (SELECT subject_id, coalesce(avg(value) FILTER (value > 0 AND channel < 3), 0) AS m,
      coalesce(stddev_pop(value) FILTER (value > 0 AND channel < 3), 1) AS s FROM vox GROUP BY 1)
    SELECT {_COLS.format('CASE WHEN s > 0 THEN (value - m) / s ELSE value - m END')} FROM vox JOIN m USING (subject_id)""")
def zscore_case(spark, sf):
    return _out(V.zscore_case(images(spark, sf)))


@query("select_phase", f"WITH {SQL_IMAGES} SELECT {_COLS.format('value')} FROM vox WHERE channel = 1")
def select_phase(spark, sf):
    return _out(V.select_phase(images(spark, sf)))


@query("replicate_channel", f"""WITH {SQL_IMAGES} SELECT subject_id, z, y, x, c AS channel, round(value, 6) + 0.0 AS value
    FROM vox, (SELECT unnest([0, 1, 2]) AS c) WHERE channel = 1""")
def replicate_channel(spark, sf):
    return _out(V.replicate_channel(V.select_phase(images(spark, sf)), 3))


# ------------------------------------------------------------------ geometry

_BOX = """box AS (SELECT subject_id, coalesce(min(z) FILTER (value <> 0), 0) AS z_lo, coalesce(max(z) FILTER (value <> 0), max(z)) + 1 AS z_hi,
    coalesce(min(y) FILTER (value <> 0), 0) AS y_lo, coalesce(max(y) FILTER (value <> 0), max(y)) + 1 AS y_hi,
    coalesce(min(x) FILTER (value <> 0), 0) AS x_lo, coalesce(max(x) FILTER (value <> 0), max(x)) + 1 AS x_hi FROM vox GROUP BY 1)"""


def _sparse(spark, sf):
    """Few voxels stay above 0, so that the boxes differ."""
    return images(spark, sf).withColumn("value", F.when(F.abs("value") < 0.3, 0.0).otherwise(F.col("value")))


SQL_SPARSE = SQL_IMAGES.replace("abs(v) < 0.1", "abs(v) < 0.3")


@query("crop_bbox", f"WITH {SQL_SPARSE}, {_BOX} SELECT * FROM box")
def crop_bbox(spark, sf):
    return _out(V.nonzero_bbox(_sparse(spark, sf)))


@query("crop_to_nonzero", f"""WITH {SQL_SPARSE}, {_BOX} SELECT subject_id, z - z_lo AS z, y - y_lo AS y, x - x_lo AS x, channel, round(value, 6) + 0.0 AS value
    FROM vox JOIN box USING (subject_id) WHERE y >= y_lo AND y < y_hi AND x >= x_lo AND x < x_hi""")
def crop_to_nonzero(spark, sf):
    return _out(V.crop_to_nonzero(_sparse(spark, sf)))


@query("uncrop", f"WITH {SQL_SPARSE}, {_BOX} SELECT {_COLS.format('value')} FROM vox WHERE value <> 0")
def uncrop(spark, sf):
    """Cropping and placing back keeps every nonzero voxel where it was."""
    vox = _sparse(spark, sf)
    box = V.nonzero_bbox(vox)
    return _out(V.uncrop(V.crop_to_nonzero(vox, box).filter(F.col("value") != 0), box))


@query("nearest_resize", f"""WITH {SQL_IMAGES}, o AS (SELECT yy AS y, xx AS x, floor(yy * 8 / 13.0::DOUBLE)::INT AS sy, floor(xx * 8 / 5.0::DOUBLE)::INT AS sx
      FROM (SELECT unnest(range(13)) AS yy), (SELECT unnest(range(5)) AS xx))
    SELECT subject_id, z, o.y, o.x, channel, round(value, 6) + 0.0 AS value FROM vox JOIN o ON vox.y = sy AND vox.x = sx""")
def nearest_resize(spark, sf):
    return _out(V.nearest_resize(images(spark, sf), (8, 8), (13, 5)))


@query("mean_pool", f"""WITH {SQL_IMAGES} SELECT subject_id, z, channel AS dim, round(avg(value), 6) + 0.0 AS value FROM vox GROUP BY 1, 2, 3""")
def mean_pool(spark, sf):
    pooled = aggregate.mean_pool(images(spark, sf), ["subject_id", "z"])
    return _out(pooled.select("subject_id", "z", F.posexplode("vec").alias("dim", "value")))
