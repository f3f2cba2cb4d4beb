"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors form one class. Classes are dealt to their nearest centroids, several each, so that
   the shards overlap; a large shard is cut into blocks.
2. In every block each vector gets few but diverse neighbours (robust pruning: a candidate is left out when a
   neighbour already chosen is clearly nearer to it than the vector is). The lists that a vector has from
   its shards are united: a flat graph without levels.
3. Every vector is searched for in the blocks of its shards: a greedy search from the medoids, which then goes on
   from all vectors in range, and a little beyond, until it meets no new one. Cosines are computed
   in double precision, so a found link is a checked link. A pair counts in the first shard it shares.
4. A sample of vectors is compared with all rows in blocks. While the recall a vector, averaged over the lower
   half of them, lies below what is asked for, the search is run again with twice the overlap.

Tasks send counts and a spanning forest of the links that they found, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.kernels import matrix
from gleaner.llm.graph import components
from gleaner.llm.scratch import Scratch

#: Vectors that centroids are fitted to (the first by hash), and the largest number of centroids.
SAMPLE, CENTROIDS = 20_000, 1024
SHARD, BLOCK = 1000, 2000
OVERLAP, LEAST_RECALL, AUDITED = 4, 0.99, 1000
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
MEDOIDS, BEAM, SLACK = 8, 8, 0.15
_QUERIES = 128  # searched at once in a task


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit_centroids(x: np.ndarray, k: int, steps: int = 10, seed: int = 5) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors."""
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(steps):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        empty = ~np.abs(sums).max(axis=1).astype(bool)
        sums[empty] = centers[empty]
        centers = unit(sums)
    return centers


def robust_prune(x: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbours of each of the unit vectors, -1 where there are fewer."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int32)
    near = min(CANDIDATES, n - 1)
    if near < 1:
        return out
    s = x @ x.T
    np.fill_diagonal(s, -2)
    cand = np.argpartition(-s, near - 1, axis=1)[:, :near]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(s, cand, 1), axis=1, kind="stable"), 1)
    own = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, cand, 1), 0))
    alive, rows = np.ones(cand.shape, bool), np.arange(n)
    np.fill_diagonal(s, 1)
    for r in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        chosen = cand[rows, first]
        out[some, r] = chosen[some]
        alive[rows, first] = False
        between = np.sqrt(np.maximum(2 - 2 * s[chosen[:, None], cand], 0))
        alive &= ALPHA * between > own
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """The most central vector, then those farthest from all chosen before."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    best = x @ x[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(x)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, least: float, own: np.ndarray | None = None) -> np.ndarray:
    """(queries, n) whether a vector in range was met; ``own`` is the place of each query among ``x``."""
    q, n = len(queries), len(x)
    sims = np.full((q, n), -2.0)
    expanded = np.zeros((q, n), bool)
    start = medoids(x)
    sims[:, start] = queries @ x[start].T
    if own is not None:
        sims[np.arange(q), own] = 1.0

    def expand(who: np.ndarray, node: np.ndarray) -> None:
        expanded[who, node] = True
        near = graph[node]
        who, near = np.repeat(who, near.shape[1]), near.ravel()
        new = near >= 0
        who, near = who[new], near[new]
        new = sims[who, near] < -1.5
        codes = np.unique(who[new].astype(np.int64) * n + near[new])
        who, near = codes // n, codes % n
        sims[who, near] = np.einsum("ij,ij->i", queries[who], x[near])

    for _ in range(12):  # greedy: the best open vectors of each query
        width = min(BEAM, n)
        best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        who = np.repeat(np.arange(q), width)
        best = best.ravel()
        todo = ~expanded[who, best] & (sims[who, best] > -1.5)
        if not todo.any():
            break
        expand(who[todo], best[todo])
    while True:  # all in range, and a little beyond
        who, node = np.nonzero((sims >= least - SLACK) & ~expanded)
        if not len(who):
            return sims >= least
        expand(who, node)


def _build(key, table):
    x = matrix(table.column("unit"))
    node = table.column("node").to_numpy()
    near = robust_prune(x)
    lists = [node[row[row >= 0]] for row in near]
    return pa.table({"node": pa.array(node), "near": pa.array(lists, pa.list_(pa.int64()))})


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among n vectors."""
    parent = np.arange(n)
    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[max(i, j)] = min(i, j)
            out.append((int(i), int(j)))
    return out


def _search(least: float):
    def run(key, table):
        shard, left, right = (k.as_py() for k in key)
        x, node, size = matrix(table.column("unit")), table.column("node").to_numpy(), table.column("n").to_numpy()
        shards, block = matrix(table.column("shards")).astype(np.int64), table.column("block").to_numpy()
        place = {v: i for i, v in enumerate(node.tolist())}
        width = max([1, *map(len, table.column("near").to_pylist())])
        graph = np.full((len(node), width), -1, np.int32)
        for i, near in enumerate(table.column("near").to_pylist()):
            here = [place[v] for v in near if v in place]
            graph[i, : len(here)] = here
        links = np.zeros(len(node), np.int64)
        joined: list[tuple[int, int]] = []
        sides = [(left, right)] if left == right else [(left, right), (right, left)]
        met = np.zeros((len(node), len(node)), bool)
        for source, goal in sides:
            q, t = np.flatnonzero(block == source), np.flatnonzero(block == goal)
            if not len(q) or not len(t):
                continue
            local = np.full(len(node) + 1, -1)
            local[t] = np.arange(len(t))
            inner = local[graph[t]]  # edges that leave the block are cut
            for at in range(0, len(q), _QUERIES):
                part = q[at : at + _QUERIES]
                found = range_search(x[part], x[t], inner, least, local[part] if left == right else None)
                i, j = np.nonzero(found)
                met[part[i], t[j]] = True
        met |= met.T
        np.fill_diagonal(met, False)
        for i in range(len(node)):
            j = i + 1 + np.flatnonzero(met[i, i + 1 :])
            if len(j):
                common = (shards[j][:, :, None] == shards[i][None, None, :]).any(axis=2)
                first = np.where(common, shards[j], np.iinfo(np.int64).max).min(axis=1)
                mine = j[first == shard]
                links[i] += size[mine].sum()
                links[mine] += size[i]
        a, b = np.nonzero(np.triu(met))
        joined = _forest(a, b, len(node))
        some = np.flatnonzero(links)
        a, b = (np.array(v, np.int64) for v in (zip(*joined) if joined else ([], [])))
        return pa.table({
            "a": pa.array(np.concatenate((node[some], node[a]))),
            "b": pa.array(np.concatenate((node[some], node[b]))),
            "links": pa.array(np.concatenate((links[some], np.zeros(len(a), np.int64)))),
        })

    return run


def _deal(centers: np.ndarray, overlap: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(1)))
            s = x @ centers.T
            best = np.argpartition(-s, overlap - 1, axis=1)[:, :overlap].astype(np.int32)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            lists = pa.ListArray.from_arrays(np.arange(0, best.size + 1, overlap, dtype=np.int32), pa.array(np.sort(best, axis=1).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, batch.column(2), lists], names=["node", "unit", "n", "shards"])

    return run


def _one_pass(classes: DataFrame, centers: np.ndarray, overlap: int, least: float, scratch: Scratch) -> DataFrame:
    """Rows ``a, b, links``: a spanning forest of links, and counts (where a = b)."""
    overlap = min(overlap, len(centers))
    tag = f"overlap-{overlap}"
    dealt = scratch.save(classes.mapInArrow(_deal(centers, overlap), "node long, unit array<double>, n long, shards array<int>"), f"dealt-{tag}")
    rows = dealt.withColumn("shard", F.explode("shards"))
    sizes = rows.groupBy("shard").count().select("shard", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "shard")  # at most CENTROIDS rows
    rows = scratch.save(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), f"rows-{tag}")
    lists = rows.select("shard", "block", "node", "unit").groupBy("shard", "block").applyInArrow(_build, "node long, near array<long>")
    graph = scratch.save(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"graph-{tag}")
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(graph, "node")
    pairs = pairs.select("node", "unit", "n", "shards", "near", "block", "shard", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    found = pairs.groupBy("shard", "left", "right").applyInArrow(_search(least), "a long, b long, links long")
    found = scratch.save(found, f"found-{tag}")
    scratch.drop(f"dealt-{tag}", f"rows-{tag}", f"graph-{tag}")
    return found


def _true_links(sample: np.ndarray, least: float):
    """How many vectors are in range of each sampled one, by comparing all rows in blocks."""

    def run(batches):
        total = np.zeros(len(sample), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, n = unit(matrix(batch.column(1))), batch.column(2).to_numpy()
                for at in range(0, len(x), 2000):
                    total += ((sample @ x[at : at + 2000].T) >= least) @ n[at : at + 2000]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sample), dtype=np.int32)), pa.array(total)], names=["i", "links"])

    return run


def _recalls(drawn: DataFrame, classes: DataFrame, links: DataFrame, least: float) -> np.ndarray:
    """Found over true links of each drawn vector that has any, at most ``AUDITED`` by hash; too many count like too few."""
    sample = drawn.orderBy(F.xxhash64("node"), "node").limit(AUDITED).toArrow()
    if not sample.num_rows:
        return np.zeros(0)
    x, node = unit(matrix(sample.column("vec"))), sample.column("node").to_numpy()
    true = classes.select("node", "vec", "n").mapInArrow(_true_links(x, least), "i int, links long").groupBy("i").agg(F.sum("links").alias("links")).toPandas()
    wanted = np.zeros(len(node), np.int64)
    wanted[true["i"].to_numpy()] = true["links"].to_numpy()
    wanted -= sample.column("n").to_numpy()  # without the class itself
    ids = classes.sparkSession.createDataFrame([(int(v),) for v in node], "a long")
    found = links.filter("links > 0").join(F.broadcast(ids), "a").groupBy("a").agg(F.sum("links").alias("links")).collect()
    by_node = {r.a: r.links for r in found}
    got = np.array([by_node.get(int(v), 0) for v in node])
    some = (wanted > 0) | (got > 0)
    return np.minimum(got, wanted)[some] / np.maximum(got, wanted)[some]


def audit(classes: DataFrame, links: DataFrame, least: float) -> float:
    """Average share of its true links that a sampled vector has, over the half of the vectors with the lowest shares.

    Each vector counts the same, whatever the size of its group. The sample is of ids divisible by 100 or, when
    none of these has a link, of all.
    """
    for drawn in (classes.filter("node % 100 = 0"), classes):
        recalls = np.sort(_recalls(drawn, classes, links, least))
        if len(recalls):
            return float(recalls[: -(-len(recalls) // 2)].mean())
    return 1.0


def near_vectors(vectors: DataFrame, least: float = 0.9, overlap: int = OVERLAP, recall: float = LEAST_RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do those of
    another length than the most frequent one (of equally frequent ones the longest). Rows
    that share id and vector count once as a link. A row without id has null as its component and is
    kept. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("vec", lambda v: v != 0)
    rows = scratch.save(rows.withColumn("vec", F.when(~bad, F.col("vec"))), "vectors")
    usable = rows.filter("vec IS NOT NULL AND vec_id IS NOT NULL")
    length = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    out = rows.select("vec_id")
    if length is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usable = usable.filter(F.size("vec") == length.d).distinct()
    classes = scratch.save(usable.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")).select("node", "vec", "n"), "classes")
    n = classes.count()
    sample = unit(matrix(classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow().column("vec")))
    centers = fit_centroids(sample, min(max(-(-n // SHARD), 1), CENTROIDS, len(sample)))
    while True:
        found = _one_pass(classes, centers, overlap, least, scratch)
        links = found.filter("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
        if overlap >= len(centers) or audit(classes, links, least) >= recall:
            break
        overlap *= 2
    of_class = scratch.save(usable.join(classes, "vec").select("vec_id", "node", "n"), "of-class")
    # An id with several vectors ties their classes.
    ties = of_class.groupBy("vec_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("vec_id")
    ties = of_class.join(ties, "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    roots = scratch.save(components(found.filter("a <> b").select("a", "b").union(ties), scratch, "tree"), "roots")
    per_class = classes.select("node", "n").join(links.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    per_class = scratch.save(
        per_class.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root")), "per-class"
    )
    per_id = of_class.join(per_class, "node").groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("root").alias("component_id"))
    per_id = scratch.save(per_id, "per-id")
    scratch.drop("classes", "roots", "per-class", "of-class")
    joined = out.join(per_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
