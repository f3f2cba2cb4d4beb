"""Valuation and selection methods.

Every method returns a :class:`Selection`: ``ranking`` (rank, item, gain) of the picked
items and ``scores`` for every pool item, picked items first. Ties always go to the
lowest id.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.ordering import WINDOW_LIMIT, first_rows, row_number
from gleaner.functions.kernels import distances, id_values, matrix, nearest_distance, row_slices, vector_array
from gleaner.functions.vectors import hash_order, hash_uniform, l2_normalize, norm
from gleaner.operators.aggregate import centroid_array, gram_array
from gleaner.operators.facility import facility_location
from gleaner.operators.greedy import (
    TIE_DECIMALS,
    DistanceSum,
    FarthestFirst,
    LeastAligned,
    MeanMatching,
    Pick,
    ResidualMatching,
    cached_pool,
    greedy,
    identity,
    pool_values,
    unit,
)
from gleaner.operators.scores import full_scores, order_scores, rank_all, top_budget
from gleaner.operators.similarity import (
    exp_mass,
    exp_weighted,
    max_similarity,
    nearest_items,
    sum_positive,
    with_similarity,
)
from gleaner.session import discard, freeze, stored


@dataclass
class Selection:
    """Picked items in order, and a score for every pool item computed when first asked for."""

    ranking: DataFrame
    make_scores: Callable[[], DataFrame]
    method: str
    budget: int
    meta: dict = field(default_factory=dict)

    @cached_property
    def scores(self) -> DataFrame:
        return self.make_scores()


@dataclass(frozen=True)
class Method:
    run: Callable[..., Selection]
    needs: frozenset


_METHODS: dict[str, Method] = {}


def register(name: str, *needs: str):
    """Add a method; ``needs`` names the inputs it cannot run without."""

    def add(fn):
        _METHODS[name] = Method(fn, frozenset(needs))
        return fn

    return add


def methods() -> list[str]:
    return sorted(_METHODS)


def get_method(name: str) -> Method:
    if name not in _METHODS:
        raise ValueError(f"{name!r} is not among the available methods: {', '.join(methods())}")
    return _METHODS[name]


def select(name: str, budget: int, **inputs) -> Selection:
    """Run a registered method after checking that its inputs are there."""
    method = get_method(name)
    missing = sorted(n for n in method.needs if inputs.get(n) is None)
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return method.run(budget=budget, **{k: v for k, v in inputs.items() if v is not None})


# ------------------------------------------------------------------ helpers


def _ranking(pool: DataFrame, picks: Sequence[Pick], weights=None, id: str = "item_id") -> DataFrame:
    fields = [
        T.StructField("rank", T.LongType()),
        T.StructField(id, pool.schema[id].dataType),
        T.StructField("gain", T.DoubleType()),
    ]
    rows = [(i + 1, p.item, None if p.gain is None else float(p.gain)) for i, p in enumerate(picks)]
    if weights is not None:
        fields.append(T.StructField("weight", T.DoubleType()))
        rows = [r + (float(w),) for r, w in zip(rows, weights)]
    return pool.sparkSession.createDataFrame(rows, T.StructType(fields))


def _pool_budget(pool: DataFrame, budget: int) -> int:
    """The budget, or the pool size where that is smaller; reads no more than ``budget`` rows."""
    return min(budget, pool.select("item_id").limit(budget).count())


def _start_item(pool: DataFrame, start, seed: int):
    """The given start item, or a random one by hash."""
    rows = pool.filter(F.col("item_id") == F.lit(start)) if start is not None else pool.orderBy(
        hash_order("item_id", seed), "item_id"
    )
    first = rows.select("item_id", "vec").limit(1).collect()
    if not first:
        raise ValueError(f"start item {start!r} is not in the pool")
    return first[0]["item_id"], np.array(first[0]["vec"], dtype=np.float64)


def _gain_scores(pool: DataFrame, ranking: DataFrame) -> DataFrame:
    """Score = gain for picked items, 0 for all others."""
    return (
        pool.select("item_id")
        .join(ranking.select("item_id", "gain"), "item_id", "left")
        .select(
            "item_id",
            F.coalesce("gain", F.lit(0.0)).alias("score"),
            F.col("gain").isNotNull().alias("selected"),
        )
    )


def _unpicked(values: DataFrame, ranking: DataFrame) -> DataFrame:
    return values.join(ranking.select("item_id"), "item_id", "left_anti")


def _with_picked(ranking: DataFrame, budget: int, rest: DataFrame) -> DataFrame:
    """Order-based scores of the picked items joined by the given scores of all others."""
    picked = order_scores(ranking, "budget", budget).withColumn("selected", F.lit(True))
    return picked.unionByName(rest.withColumn("selected", F.lit(False)))


def _stack(picks: Sequence[Pick]) -> np.ndarray:
    return np.stack([p.vec for p in picks])


# ------------------------------------------------------------------ random


@register("random", "pool")
def random_select(pool: DataFrame, budget: int, seed: int = 42, **_) -> Selection:
    """Seeded random order; unselected items get a random score below 0.5/budget."""
    budget = _pool_budget(pool, budget)
    ranking = first_rows(pool.select("item_id"), budget, [hash_order("item_id", seed), F.col("item_id")]).select(
        "rank", "item_id", F.lit(None).cast("double").alias("gain")
    )

    def scores():
        rest = _unpicked(pool, ranking).select(
            "item_id", (hash_uniform("item_id", seed + 1) * F.lit(0.5 / budget)).alias("score")
        )
        return _with_picked(ranking, budget, rest)

    return Selection(ranking, scores, "random", budget, {"seed": seed})


# ------------------------------------------------------------------ geometric greedy


@register("kcenter", "pool", "query")
def kcenter_query(pool: DataFrame, query: DataFrame, budget: int, **_) -> Selection:
    """Farthest-first traversal that starts at the item nearest the query centroid."""
    with cached_pool(pool) as data:
        picks = greedy(data, FarthestFirst(centroid_array(query)), budget)
    budget = len(picks)
    ranking = _ranking(pool, picks)
    points = _stack(picks)

    def scores():
        return full_scores(pool_values(pool, lambda x: nearest_distance(x, points)), ranking, budget)

    return Selection(ranking, scores, "kcenter", budget)


def _from_start(pool, rule_of, budget, start, seed, prepare):
    """Greedy from a start item whose own gain is the best value after it is picked."""
    with cached_pool(pool) as data:
        item, vec = _start_item(data, start, seed)
        first = Pick(item, prepare(vec[None, :])[0], 0.0)
        picks = greedy(data, rule_of(first.vec), max(budget, 2), [first])
    if len(picks) > 1:
        picks[0].gain = picks[1].gain
    return picks[:budget]


def kcenter_pool(
    pool: DataFrame, max_rank: int, normalize: bool = False, start=None, seed: int = 0
) -> Selection:
    """Farthest-first traversal of the pool alone; score = distance at the pick."""
    prepare = unit(1e-12, "add") if normalize else identity

    def rule(vec):
        return FarthestFirst(vec, prepare, [vec])

    picks = _from_start(pool, rule, max_rank, start, seed, prepare)
    ranking = _ranking(pool, picks)
    return Selection(ranking, lambda: _gain_scores(pool, ranking), "kcenter_pool", len(picks), {"seed": seed})


def diversity_distsum(
    pool: DataFrame, max_rank: int, normalize: bool = False, start=None, seed: int = 0
) -> Selection:
    """Each step adds the item with the largest sum of distances to the picks."""
    prepare = unit(1e-12, "add") if normalize else identity
    picks = _from_start(pool, lambda vec: DistanceSum([vec], prepare), max_rank, start, seed, prepare)
    ranking = _ranking(pool, picks)
    return Selection(ranking, lambda: _gain_scores(pool, ranking), "diversity_distsum", len(picks), {"seed": seed})


@register("diversity", "pool")
def diversity_cosine(pool: DataFrame, budget: int, start=None, seed: int = 42, **_) -> Selection:
    """Each step adds the item whose smallest absolute cosine to the picks is smallest."""
    prepare = unit(1e-8, "max")
    with cached_pool(pool) as data:
        item, vec = _start_item(data, start, seed)
        first = Pick(item, prepare(vec[None, :])[0], 0.0)
        picks = greedy(data, LeastAligned([first.vec]), budget, [first])
    budget = len(picks)
    ranking = _ranking(pool, picks)
    points = _stack(picks)

    def scores():
        spread = pool_values(
            pool, lambda x: 1.0 - np.minimum(np.abs(x @ points.T).min(axis=1), 1.0), prepare=prepare
        )
        rest = _unpicked(spread, ranking).select(
            "item_id", (F.col("value") * F.lit(0.5 / budget)).alias("score")
        )
        return _with_picked(ranking, budget, rest)

    return Selection(ranking, scores, "diversity", budget, {"seed": seed})


@register("herding", "pool", "query")
def herding(pool: DataFrame, query: DataFrame, budget: int, **_) -> Selection:
    """Each step adds the item that brings the mean of the picks nearest the query mean."""
    target = centroid_array(query)
    with cached_pool(pool) as data:
        longest = data.agg(F.max(norm(F.col("vec")))).first()[0] or 0.0
        picks = greedy(data, MeanMatching(target, longest), budget)
    budget = len(picks)
    ranking = _ranking(pool, picks)

    def scores():
        values = freeze(pool_values(pool, lambda x: distances(x, target[None, :])[:, 0]))
        rest = _unpicked(values, ranking)
        far = rest.agg(F.max("value")).scalar()
        closeness = F.when(far > 0, (1.0 - F.col("value") / far) * F.lit(0.5 / budget)).otherwise(F.lit(0.0))
        return _with_picked(ranking, budget, rest.select("item_id", closeness.alias("score")))

    return Selection(ranking, scores, "herding", budget)


# ------------------------------------------------------------------ k-means


def kmeans_centers(items: DataFrame, k: int, seed: int = 0, n_init: int = 10, max_iter: int = 300) -> np.ndarray:
    """The best of ``n_init`` distributed k-means fits; at most ``k`` centers.

    Spark's estimator chooses each fit's first centers; the steps of all fits then share their passes over the items.
    """
    if k == 1:  # the estimator wants two clusters or more
        return centroid_array(items)[None, :]
    points = items.select(array_to_vector("vec").alias("features")).persist()
    try:
        starts = [KMeans(k=k, seed=seed + attempt, maxIter=0).fit(points).clusterCenters() for attempt in range(n_init)]
    finally:
        points.unpersist()
    with cached_pool(items) as data:
        return _lloyd(data, [np.array([np.asarray(c) for c in s]) for s in starts], max_iter)


#: A fit ends when no center moves farther (Spark's default).
KMEANS_TOL = 1e-4


def _lloyd(items: DataFrame, fits: list[np.ndarray], max_iter: int) -> np.ndarray:
    """The cheapest of several fits after Lloyd's steps from their starts; a pass over the items moves all fits that still run."""
    running = list(range(len(fits))) if max_iter > 0 else []
    for _ in range(max_iter):
        sums = _cluster_sums(items, [fits[f] for f in running])
        still = []
        for f, (n, total, _) in zip(running, sums):
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], fits[f])
            if ((new - fits[f]) ** 2).sum(axis=1).max() > KMEANS_TOL**2:
                still.append(f)
            fits[f] = new
        running = still
        if not running:
            break
    costs = [cost for _, _, cost in _cluster_sums(items, fits)]
    return fits[int(np.argmin(costs))]


def _cluster_sums(items: DataFrame, fits: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each fit its clusters' sizes and vector sums, and its cost: one pass, a task sends one row a cluster."""
    ends = np.cumsum([0, *[len(c) for c in fits]])
    centers = np.concatenate(fits)
    squares = np.einsum("ij,ij->i", centers, centers)

    def sums(batches):
        n, cost, total = np.zeros(len(centers), dtype=np.int64), np.zeros(len(centers)), np.zeros(centers.shape)
        for batch in batches:
            whole = matrix(batch.column("vec"))
            for rows in row_slices(len(whole)):
                x = whole[rows]
                d2 = np.einsum("ij,ij->i", x, x)[:, None] + squares - 2.0 * (x @ centers.T)
                member = np.zeros(d2.shape)
                for a, b in zip(ends, ends[1:]):
                    member[np.arange(len(x)), a + d2[:, a:b].argmin(axis=1)] = 1.0
                n += member.sum(axis=0).astype(np.int64)
                cost += (member * np.maximum(d2, 0.0)).sum(axis=0)
                total += member.T @ x
        if n.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(cost), vector_array(total)], names=["at", "n", "cost", "vec"]
            )

    found = items.select("vec").mapInArrow(sums, "at int, n long, cost double, vec array<double>").toArrow()
    at, n, cost, total = np.asarray(found.column("at")), np.zeros(len(centers), dtype=np.int64), np.zeros(len(centers)), np.zeros(centers.shape)
    np.add.at(n, at, np.asarray(found.column("n")))
    np.add.at(cost, at, np.asarray(found.column("cost")))
    np.add.at(total, at, matrix(found.column("vec")))
    return [(n[a:b], total[a:b], float(cost[a:b].sum())) for a, b in zip(ends, ends[1:])]


def assign_clusters(items: DataFrame, centers: np.ndarray) -> DataFrame:
    """Nearest center of every item, ties to the lowest: ``cluster`` and ``dist``."""

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("vec"))
            if not len(x):
                continue
            cluster, dist = np.empty(len(x), dtype=np.int32), np.empty(len(x))
            for rows in row_slices(len(x)):
                d = np.round(distances(x[rows], centers), 12)
                cluster[rows] = d.argmin(axis=1)
                dist[rows] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(cluster), pa.array(dist)], names=["item_id", "cluster", "dist"]
            )

    schema = T.StructType(
        [items.schema["item_id"], T.StructField("cluster", T.IntegerType()), T.StructField("dist", T.DoubleType())]
    )
    return items.select("item_id", "vec").mapInArrow(assign, schema)


def cluster_representatives(assigned: DataFrame) -> DataFrame:
    """Per non-empty cluster its size and the member nearest the center."""
    nearest = F.min(F.struct(F.round("dist", 9).alias("d"), F.col("item_id").alias("i")))
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), nearest.alias("__near")
    ).select("cluster", "size", F.col("__near.i").alias("item_id"), F.col("__near.d").alias("dist"))


def kmeans_scores(assigned: DataFrame, budget: int) -> DataFrame:
    """Score every item: 1 - d/max d, representatives 1 + (budget - r)/budget, all over the maximum."""
    far = assigned.agg(F.max("dist")).scalar()
    reps = _representative_ranks(assigned, budget)
    near = F.when(far > 0, 1.0 - F.col("dist") / far).otherwise(F.lit(1.0))
    raw = assigned.join(reps.select("item_id", "rank"), "item_id", "left").select(
        "item_id",
        F.coalesce(1.0 + (F.lit(budget) - (F.col("rank") - 1)) / F.lit(float(budget)), near).alias("raw"),
        F.col("rank").isNotNull().alias("selected"),
    )
    return raw.select("item_id", (F.col("raw") / raw.agg(F.max("raw")).scalar()).alias("score"), "selected")


def _representative_ranks(assigned: DataFrame, k: int) -> DataFrame:
    """Representatives in cluster order; at most ``k`` rows."""
    reps = cluster_representatives(assigned).withColumn("order", -F.col("cluster"))
    return top_budget(reps, k, score="order").select("rank", "item_id", F.col("dist").alias("gain"))


@register("kmeans", "pool")
def kmeans_select(
    pool: DataFrame, budget: int, seed: int = 42, n_init: int = 10, max_iter: int = 300,
    centers: np.ndarray | None = None, **_,
) -> Selection:
    """One cluster per pick; each cluster's member nearest its center is selected."""
    budget = _pool_budget(pool, budget)
    centers = kmeans_centers(pool, budget, seed, n_init, max_iter) if centers is None else centers
    assigned = freeze(assign_clusters(pool, centers))
    ranking = _representative_ranks(assigned, budget)
    return Selection(ranking, lambda: kmeans_scores(assigned, budget), "kmeans", budget, {"n_clusters": budget})


def kmeans_by_size(
    pool: DataFrame, max_rank: int, normalize: bool = False, seed: int = 0, n_init: int = 10,
    max_iter: int = 300, centers: np.ndarray | None = None,
) -> Selection:
    """Cluster representatives ordered by cluster size; score 1 - r/(N - 1), others 0."""
    items = pool.select("item_id", F.col("vec").cast("array<double>").alias("vec"))
    if normalize:
        items = items.select("item_id", l2_normalize(F.col("vec"), 1e-12, "add").alias("vec"))
    k = _pool_budget(pool, max_rank)
    centers = kmeans_centers(items, k, seed, n_init, max_iter) if centers is None else centers
    reps = cluster_representatives(assign_clusters(items, centers)).select(
        # Equal sizes keep cluster order.
        "item_id", "size", F.struct("size", (-F.col("cluster")).alias("c")).alias("order")
    )
    ranking = freeze(
        top_budget(reps, k, score="order").select("rank", "item_id", F.col("size").cast("double").alias("gain"))
    )

    def scores():
        last = F.greatest(ranking.agg(F.count(F.lit(1))).scalar() - 1, F.lit(1))
        return (
            pool.select("item_id")
            .join(ranking.select("item_id", "rank"), "item_id", "left")
            .select(
                "item_id",
                F.coalesce(1.0 - (F.col("rank") - 1) / last, F.lit(0.0)).alias("score"),
                F.col("rank").isNotNull().alias("selected"),
            )
        )

    return Selection(ranking, scores, "kmeans_by_size", k, {"seed": seed})


# ------------------------------------------------------------------ similarity to the query


def rds_max(source: DataFrame, target: DataFrame, budget: int | None = None) -> Selection:
    """Largest cosine to any target vector; the top ``budget`` are selected (all without one)."""
    scored = with_similarity(source, target, [max_similarity("score")], eps=1e-12)
    ranking = (rank_all(scored) if budget is None else top_budget(scored, budget)).select(
        "rank", "item_id", F.col("score").alias("gain")
    )
    return Selection(ranking, lambda: scored, "rds_max", budget or 0)


def less_slice_scores(source: DataFrame, target: DataFrame, beta: float = 20.0, keep: Sequence[str] = ()) -> DataFrame:
    """Per source slice sum_j w_j cos_j with w = exp(beta cos)/(sum + 1e-8)."""
    parts = with_similarity(
        source, target, [exp_mass(beta, "mass"), exp_weighted(beta, "sims")], keep=keep, eps=1e-12
    )
    return parts.select(
        "item_id", *keep, (F.col("sims") / (F.col("mass") + F.lit(1e-8 * float(np.exp(-beta))))).alias("score")
    )


def less_softmax(source: DataFrame, target: DataFrame, beta: float = 20.0, by: str = "subject_id") -> Selection:
    """Mean slice score of every subject, ranked."""
    scored = (
        less_slice_scores(source, target, beta, [by])
        .groupBy(by)
        .agg(F.avg("score").alias("score"))
        .withColumnRenamed(by, "item_id")
    )
    ranking = rank_all(scored).select("rank", "item_id", F.col("score").alias("gain"))
    return Selection(ranking, lambda: scored, "less_softmax", 0, {"beta": beta})


@register("craig_proxy", "pool", "query")
def craig_proxy(pool: DataFrame, query: DataFrame, budget: int, temperature: float = 5.0, **_) -> Selection:
    """Softmax over the pool for each query, summed over the queries, scaled to [0, 1]."""
    if abs(temperature) > 300:
        raise ValueError("temperature out of range")
    mass = with_similarity(query, pool, [exp_mass(temperature, "mass")], keep=["vec"])
    shares = mass.select("item_id", "vec", (1.0 / F.col("mass")).alias("share"))
    covered = freeze(with_similarity(pool, shares, [exp_mass(temperature, "score")], weight="share"))
    low, high = (covered.agg(f("score")).scalar() for f in (F.min, F.max))
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(0.5))
    scored = covered.select("item_id", scaled.alias("score"))
    ranking = top_budget(scored, budget).select("rank", "item_id", F.col("score").alias("gain"))
    return Selection(ranking, lambda: scored, "craig_proxy", budget, {"temperature": temperature})


def mean_similarity(source: DataFrame, target: DataFrame) -> DataFrame:
    """Mean cosine to the target vectors: the cosine is linear in the mean unit vector.

    Kept at 12 decimals: the last bits of a product depend on a row's place in its batch, and copies must tie.
    """
    unit_target = target.select(l2_normalize(F.col("vec"), 1e-12, "max").alias("vec"))
    center = centroid_array(unit_target)
    return pool_values(source, lambda x: np.round(x @ center, TIE_DECIMALS) + 0.0, "score", unit(1e-12, "max"))


def mean_sim_rank(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rank 1..n by mean cosine to the target."""
    return rank_all(mean_similarity(source, target))


@register("rds", "pool", "query")
def rds_round_robin(pool: DataFrame, query: DataFrame, budget: int, **_) -> Selection:
    """Queries take turns, by id, to pick their most similar unused item.

    One pass fetches for every query its best unused items. The turns are then played on
    these lists, which name a query's true best unused item until its list runs out; the
    next pass goes on from there. With more queries than picks only the first ``budget``
    queries get a turn.
    """
    budget = _pool_budget(pool, budget)
    queries = query.select(F.col("item_id").alias("query_id"), "vec").orderBy("query_id").limit(budget)
    picks: list[Pick] = []
    with cached_pool(pool) as data, cached_pool(queries, "query_id") as asking:
        count = asking.count()
        turns = freeze(row_number(asking.select("query_id"), [F.asc("query_id")], name="turn"))
        turn = length = 0
        while len(picks) < budget:
            # As many items as picks are left always suffice; after a pass that ran out, read more.
            left = budget - len(picks)
            length = min(max(2 * -(-left // count) + 8, 4 * length), left, WINDOW_LIMIT)
            lists = _BestLists(nearest_items(asking, data, length, exclude=[p.item for p in picks]), turns, count, length)
            before, taken = len(picks), set()
            while len(picks) < budget:
                best = lists.best(turn % count, taken)
                if best is None:
                    break
                picks.append(Pick(best[0], None, best[1]))
                taken.add(best[0])
                turn += 1
            lists.close()
            if len(picks) == before:
                break
    ranking = _ranking(pool, picks)

    def scores():
        return full_scores(with_similarity(pool, query, [max_similarity("value")]), ranking, len(picks))

    return Selection(ranking, scores, "rds", len(picks))


#: Rows of best items that the driver looks at together.
LIST_ROWS = 1_000_000


class _BestLists:
    """Each query's items from best to worst, stored as a table; the driver reads those of a block of queries at a time.

    Queries take their turns in id order, so a block is read once a round. What stays on the driver is a place
    in the list of each query.
    """

    def __init__(self, found: DataFrame, turns: DataFrame, count: int, length: int) -> None:
        numbered = found.join(turns, "query_id").select((F.col("turn") - 1).alias("turn"), "position", "item_id", "sim")
        self.found, self.path = stored(numbered)
        self.size = max(LIST_ROWS // length, 1)
        self.loaded = -1
        self.at = np.zeros(count, dtype=np.int64)

    def _load(self, block: int) -> None:
        low = block * self.size
        rows = self.found.filter((F.col("turn") >= low) & (F.col("turn") < low + self.size)).toArrow().sort_by([("turn", "ascending"), ("position", "ascending")])
        self.items, self.sims = id_values(rows.column("item_id")), np.asarray(rows.column("sim"))
        self.bounds = np.searchsorted(np.asarray(rows.column("turn")), np.arange(low, low + self.size + 1))
        self.loaded = block

    def best(self, query: int, taken: set) -> tuple | None:
        """The query's best item that is not taken, with its similarity; None when its list has run out."""
        if query // self.size != self.loaded:
            self._load(query // self.size)
        begin, end = self.bounds[query % self.size : query % self.size + 2]
        while begin + self.at[query] < end:
            place = begin + self.at[query]
            item = self.items[place].item()
            if item not in taken:
                return item, float(self.sims[place])
            self.at[query] += 1
        return None

    def close(self) -> None:
        discard(self.found.sparkSession, self.path)


# ------------------------------------------------------------------ gradient matching


def _target_direction(query: DataFrame, eps: float, normalize: bool = True) -> np.ndarray:
    target = centroid_array(query)
    return target / (np.linalg.norm(target) + eps) if normalize else target


def _alignment_scores(pool, picks, target, ranking):
    values = pool_values(pool, lambda x: np.abs(x @ target), prepare=unit(1e-8, "max"))
    return full_scores(values, ranking, len(picks))


@register("gradmatch", "pool_grads", "query_grads")
def gradmatch_omp(pool_grads: DataFrame, query_grads: DataFrame, budget: int, **_) -> Selection:
    """Orthogonal matching pursuit towards the mean query gradient.

    The residual is that of the unconstrained least-squares fit on all picks; the reported
    weights are that fit's, negative ones set to 0.
    """
    target = _target_direction(query_grads, 1e-8)

    def refit(picked):
        atoms = np.stack(picked).T
        weights = np.linalg.lstsq(atoms, target, rcond=None)[0]
        return target - atoms @ weights, weights

    rule = ResidualMatching(target, refit, unit(1e-8, "max"))
    with cached_pool(pool_grads) as data:
        picks = greedy(data, rule, budget)
    ranking = _ranking(pool_grads, picks, np.maximum(rule.weights, 0.0))
    return Selection(ranking, lambda: _alignment_scores(pool_grads, picks, target, ranking), "gradmatch_omp", len(picks))


@register("gradmatch_mp", "pool_grads", "query_grads")
def gradmatch_mp(pool_grads: DataFrame, query_grads: DataFrame, budget: int, **_) -> Selection:
    """Matching pursuit: the residual loses its component along each pick in turn."""
    target = _target_direction(query_grads, 1e-8)
    state = {"residual": target, "weights": []}

    def refit(picked):
        atom = picked[-1]
        along = float(atom @ state["residual"])
        state["residual"] = state["residual"] - along * atom
        state["weights"].append(max(along, 0.0))
        return state["residual"], np.array(state["weights"])

    rule = ResidualMatching(target, refit, unit(1e-8, "max"))
    with cached_pool(pool_grads) as data:
        picks = greedy(data, rule, budget)
    ranking = _ranking(pool_grads, picks, rule.weights)
    return Selection(ranking, lambda: _alignment_scores(pool_grads, picks, target, ranking), "gradmatch", len(picks))


def nonnegative_fit(atoms: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least squares with weights >= 0 (active set of Lawson and Hanson) for a few atoms."""
    gram, along = atoms.T @ atoms, atoms.T @ target
    k = len(along)
    free = np.zeros(k, dtype=bool)
    weights = np.zeros(k)
    for _ in range(10 * k + 10):
        slope = along - gram @ weights
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-12:
            break
        free[best] = True
        while True:
            trial = np.zeros(k)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], along[free], rcond=None)[0]
            if trial[free].min() > 0:
                weights = trial
                break
            low = free & (trial <= 0)
            step = np.min(weights[low] / np.maximum(weights[low] - trial[low], 1e-300))
            weights = weights + step * (trial - weights)
            free &= weights > 1e-14
            weights[~free] = 0.0
            if not free.any():
                break
    return weights


def gradmatch_nnls(
    source: DataFrame, target_items: DataFrame, max_rank: int, normalize: bool = False
) -> Selection:
    """Matching pursuit with a non-negative refit; score = drop of the squared residual."""
    prepare = unit(1e-12, "add") if normalize else identity
    target = _target_direction(target_items, 1e-12, normalize)
    left = [float(target @ target)]

    def refit(picked):
        atoms = np.stack(picked).T
        weights = nonnegative_fit(atoms, target)
        residual = target - atoms @ weights
        left.append(float(residual @ residual))
        return residual, weights

    with cached_pool(source) as data:
        longest = 1.0 if normalize else data.agg(F.max(norm(F.col("vec")))).first()[0]
        picks = greedy(data, ResidualMatching(target, refit, prepare, longest), max_rank)
    for p, before, after in zip(picks, left, left[1:]):
        p.gain = before - after
    ranking = _ranking(source, picks)
    return Selection(ranking, lambda: _gain_scores(source, ranking), "gradmatch_nnls", len(picks))


def leading_basis(pool_grads: DataFrame, rank: int) -> np.ndarray:
    """Orthonormal columns that span the directions with most of the pool's energy; at most ``rank`` and as many as items."""
    moment = gram_array(pool_grads)
    return np.linalg.eigh(moment)[1][:, ::-1][:, : min(rank, _pool_budget(pool_grads, rank), len(moment))]


@register("less", "pool_grads", "query_grads")
def less_lowrank(pool_grads: DataFrame, query_grads: DataFrame, budget: int, rank: int = 50, **_) -> Selection:
    """Greedy matching of the mean query gradient in the leading subspace of the pool.

    With V the leading right singular vectors (from the d x d second moment), an item's
    projection is X V, so its contribution X V r is an inner product with V r: the pool is
    never projected or stored again.
    """
    with cached_pool(pool_grads) as data:
        basis = leading_basis(data, rank)
        aim = basis.T @ centroid_array(query_grads)
        longest = data.agg(F.max(norm(F.col("vec")))).first()[0]
        state = {"residual": aim}

        def refit(picked):
            along = basis.T @ picked[-1]
            size = float(along @ along)
            if np.sqrt(size) > 1e-8:
                state["residual"] = state["residual"] - (along @ state["residual"]) / size * along
            return basis @ state["residual"], np.zeros(0)

        picks = greedy(data, ResidualMatching(basis @ aim, refit, max_norm=longest), budget)
    ranking = _ranking(pool_grads, picks)
    direction = basis @ aim

    def scores():
        return full_scores(pool_values(pool_grads, lambda x: np.abs(x @ direction)), ranking, len(picks))

    return Selection(ranking, scores, "less", len(picks), {"rank": basis.shape[1]})


# ------------------------------------------------------------------ coverage


@register("craig", "pool_grads")
def craig_fl_unclipped(pool_grads: DataFrame, budget: int, compat_first: bool = False, **_) -> Selection:
    """Facility location over the gradients' cosines with order-based scores.

    By default coverage starts at 0. ``compat_first`` starts from the lowest id and lets
    negative cosines count.
    """
    with cached_pool(pool_grads) as data:
        first = data.agg(F.min("item_id")).first()[0] if compat_first else None
        picks = facility_location(data, budget, first=first)
    ranking = _ranking(pool_grads, picks)
    points, floor = _stack(picks), -np.inf if compat_first else 0.0

    def scores():
        covered = pool_values(
            pool_grads, lambda x: np.maximum((x @ points.T).max(axis=1), floor), prepare=unit(1e-8, "max")
        )
        return full_scores(covered, ranking, len(picks))

    return Selection(ranking, scores, "craig", len(picks))


def craig_fl(source: DataFrame, max_rank: int) -> Selection:
    """Facility location over max(cos, 0); score = marginal gain, others 0.

    The cosine does not depend on the length of the vectors, so there is no separate
    normalised form.
    """
    with cached_pool(source) as data:
        picks = facility_location(data, max_rank, leave=1, eps=1e-12)
    ranking = _ranking(source, picks)
    return Selection(ranking, lambda: _gain_scores(source, ranking), "craig_fl", len(picks))


def _orient_picks(pool, query, budget, eta, stop_if_negative):
    caps = with_similarity(pool, query, [max_similarity("cap")], keep=["vec"], eps=1e-12)
    capped = caps.select("item_id", "vec", (F.greatest("cap", F.lit(0.0)) * F.lit(eta)).alias("cap")).persist()
    try:
        return facility_location(capped, budget, cap="cap", stop_if_negative=stop_if_negative, eps=1e-12)
    finally:
        capped.unpersist()


@register("orient", "pool", "query")
def orient_flmi(pool: DataFrame, query: DataFrame, budget: int, eta: float = 1.0, **_) -> Selection:
    """Facility-location mutual information between the picks and the query set.

    The objective sum_i min(max_j K_ij, eta max_q Q_iq) is facility location with the
    similarities of row i capped by eta max_q Q_iq. Picked items score 1 - r/(L - 1);
    items at 0 (the last pick too) get their mean query similarity below 0.5/budget.
    """
    picks = _orient_picks(pool, query, budget, eta, False)
    ranking = _ranking(pool, picks)

    def scores():
        relevance = with_similarity(pool, query, [sum_positive("value")], eps=1e-12)
        unit_scores = order_scores(ranking, "unit", len(picks))
        placed = freeze(
            relevance.join(unit_scores, "item_id", "left").select(
                "item_id",
                "value",
                F.coalesce("score", F.lit(0.0)).alias("placed"),
                F.col("score").isNotNull().alias("selected"),
            )
        )
        # The sum over the queries stands for the mean: their ratio to the maximum is the same.
        top = placed.filter(F.col("placed") == 0).agg(F.max("value")).scalar()
        low = F.when(top > 0, F.col("value") / top * F.lit(0.5 / len(picks))).otherwise(F.lit(0.0))
        return placed.select(
            "item_id", F.when(F.col("placed") == 0, low).otherwise(F.col("placed")).alias("score"), "selected"
        )

    return Selection(ranking, scores, "orient", len(picks), {"eta": eta})


def orient_set(
    pool: DataFrame, query: DataFrame, budget: int, eta: float = 1.0, stop_if_negative: bool = True
) -> DataFrame:
    """The picked set in id order."""
    picks = _orient_picks(pool, query, budget, eta, stop_if_negative)
    return _ranking(pool, picks).select("item_id").orderBy("item_id")


# ------------------------------------------------------------------ all methods


def score_all(
    names: Sequence[str], budget: int, options: Mapping[str, Mapping] | None = None, **inputs
) -> DataFrame:
    """Scores of several methods over one pool in long form.

    Inputs are checked for every method before the first one runs.
    """
    for name in names:
        missing = sorted(n for n in get_method(name).needs if inputs.get(n) is None)
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
    parts = []
    for name in names:
        result = select(name, budget, **{**inputs, **(options or {}).get(name, {})})
        parts.append(result.scores.select(F.lit(name).alias("method"), "item_id", "score"))
    return reduce(DataFrame.unionByName, parts)
