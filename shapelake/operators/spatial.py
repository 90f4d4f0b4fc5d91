"""Nearest neighbours, range joins and region queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelake.storage import saved
from shapelake.functions.vector import Vec

#: Vectors in a block of an exact high-dimensional search.
BLOCK = 2048
#: A cluster of a search holds about so many points on average; there are at most so many clusters, whatever the table.
CLUSTER, MOST_CLUSTERS = 20_000, 1024
#: Of few clusters each meets its queries in several deals, so that there are this many keys to share out.
SPREAD = 16
METRICS = ("l2", "l1")
#: "l2", "l1" or a function of arrays (n, d) and (m, d) that gives their distances (n, m) in any metric.
Metric = str | Callable[[np.ndarray, np.ndarray], np.ndarray]


def checked(metric: Metric) -> Metric:
    if not callable(metric) and metric not in METRICS:
        raise ValueError(f"metric is a function or one of {METRICS}")
    return metric


def between(a: np.ndarray, b: np.ndarray, metric: Metric) -> np.ndarray:
    """Distances of all rows of a to all of b, for l2 to rounding of a matrix product; rows of a are few at a time."""
    if callable(metric):
        return metric(a, b)
    if metric == "l1":
        return np.abs(a[:, None, :] - b[None]).sum(axis=2)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def rough(a: np.ndarray, b: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray | float]:
    """Distances (n, m) as between, for l1 in single precision, a coordinate at a time; and by how much each row's may be wrong at most."""
    if metric == "l1" and len(a) and len(b):
        scale = np.abs(a).sum(axis=1) + np.abs(b).sum(axis=1).max()
        if np.isfinite(scale).all() and scale.max() < 1e30:
            x, y = np.ascontiguousarray(a.T, np.float32), np.ascontiguousarray(b.T, np.float32)
            out = np.empty((len(a), len(b)), np.float32)
            for i in range(0, len(a), 16):
                sums = out[i : i + 16]
                np.abs(np.subtract(x[0, i : i + 16, None], y[0], out=sums), out=sums)
                one = np.empty_like(sums)
                for k in range(1, len(x)):
                    np.abs(np.subtract(x[k, i : i + 16, None], y[k], out=one), out=one)
                    sums += one
            return out, (len(x) + 4) * 2.0**-23 * scale + 1e-30
    return between(a, b, metric), 0.0


def packed(cluster: int, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, ids, vecs, bounds) of up to BLOCK vectors as raw bytes."""
    for i in range(0, len(ids), BLOCK):
        cells = (ids[i : i + BLOCK].astype("<i8"), vectors[i : i + BLOCK].astype("<f8"), bounds[i : i + BLOCK].astype("<f8"))
        yield pa.record_batch([pa.array([cluster], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], ["cluster", "ids", "vecs", "bounds"])


def unpacked(ids: bytes, vecs: bytes, bounds: bytes | None = None) -> tuple[np.ndarray, ...]:
    n = np.frombuffer(ids, "<i8")
    return n, np.frombuffer(vecs, "<f8").reshape(len(n), -1), np.frombuffer(bounds, "<f8") if bounds is not None else n


PACKED = "cluster int, ids binary, vecs binary, bounds binary"


class Clusters:
    """Points in clusters around pivots, in blocks; a query visits the clusters that the triangle inequality doesn't rule out.

    Pivots are the points of the least hashes, one for CLUSTER points and MOST_CLUSTERS at most, so what the driver and
    every task hold of them is bounded; a cluster's blocks are rows of their own, so a crowded one is no one's group.
    """

    def __init__(self, points: DataFrame, point_id: str, point_vec: str, metric: Metric):
        rows = points.select(F.col(point_id).cast("long").alias("id"), F.col(point_vec).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
        self.metric, self.n = metric, rows.count()
        many = min(max(1, self.n // CLUSTER), MOST_CLUSTERS)
        first = rows.limit(1) if many == 1 else rows.orderBy(F.xxhash64("id"), "id").limit(many)
        self.pivots = pivots = np.array([r.v for r in first.select("v").collect()], float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                d = np.concatenate([between(v[i : i + 256], pivots, metric) for i in range(0, len(v), 256)]) if len(v) else np.zeros((0, 1))
                own = d.argmin(axis=1)
                for c in np.unique(own):
                    at = np.flatnonzero(own == c)
                    yield from packed(int(c), ids[at], v[at], d[at, c])

        self.blocks = rows.mapInArrow(run, PACKED)
        self.inner, self.outer, self.size = np.zeros(many), np.full(many, np.inf), np.full(many, self.n)
        if many > 1:
            self.blocks = saved(self.blocks)

            def shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    bounds = [np.frombuffer(b, "<f8") for b in batch.column(1).to_pylist()]
                    yield pa.record_batch([batch.column(0), pa.array([b.min() for b in bounds], pa.float64()), pa.array([b.max() for b in bounds], pa.float64()), pa.array([len(b) for b in bounds], pa.int64())], ["cluster", "low", "high", "n"])

            sums = self.blocks.select("cluster", "bounds").mapInArrow(shells, "cluster int, low double, high double, n long").groupBy("cluster").agg(F.min("low"), F.max("high"), F.sum("n"))
            self.size = np.zeros(many, np.int64)
            for c, low, high, n in sums.collect():
                self.inner[c], self.outer[c], self.size[c] = low, high, n

    def visits(self, rows: DataFrame, reach, metric: Metric) -> DataFrame:
        """Blocks of the queries (id, v, more..) for each cluster to visit; reach(batch, distances to pivots) -> (which, bound of each query)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(i, BLOCK)
                    ids, v = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                    d = np.concatenate([between(v[j : j + 256], pivots, metric) for j in range(0, len(v), 256)])
                    which, bound = reach(part, d)
                    for c in np.flatnonzero(which.any(axis=0)):
                        at = np.flatnonzero(which[:, c])
                        yield from packed(int(c), ids[at], v[at], bound[at])

        pivots = self.pivots
        return rows.mapInArrow(run, PACKED).toDF("cluster", "q_ids", "q_vecs", "q_bounds")

    def meet(self, visits: DataFrame, found) -> DataFrame:
        """q_id, p_id, d2 by found(query ids, vectors, bounds, point ids, vectors) for each block of queries and block of its cluster."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    (qi, q, bound), (pi, p, _) = unpacked(row.q_ids, row.q_vecs, row.q_bounds), unpacked(row.ids, row.vecs)
                    for i in range(0, len(qi), 64):
                        yield found(qi[i : i + 64], q[i : i + 64], bound[i : i + 64], pi, p)

        spread = -(-SPREAD // len(self.pivots)) if len(self.pivots) else 1
        copies = self.blocks.select("cluster", "ids", "vecs", F.explode(F.array(*map(F.lit, range(spread)))).alias("deal"))
        dealt = visits.withColumn("deal", F.pmod(F.xxhash64("q_ids"), F.lit(spread)).cast("int"))
        return dealt.join(copies, ["cluster", "deal"]).select("q_ids", "q_vecs", "q_bounds", "ids", "vecs").mapInPandas(run, "q_id long, p_id long, d2 double")


def exact(near: np.ndarray, q: np.ndarray, p: np.ndarray, n: np.ndarray, j: np.ndarray, metric: Metric) -> np.ndarray:
    """Of pairs (n, j) the sum of squared (l2) or absolute (l1) differences, or the distance by another metric."""
    if callable(metric):
        return near[n, j]
    return np.abs(q[n] - p[j]).sum(1) if metric == "l1" else ((q[n] - p[j]) ** 2).sum(1)


def knn(queries: DataFrame, points: DataFrame, k: int = 1, query_id: str = "q_id", query_vec: str = "q_vec", point_id: str = "p_id", point_vec: str = "p_vec", exclude_same_id: bool = False, metric: Metric = "l2") -> DataFrame:
    """q_id, p_id, d2, rank: the k nearest points of every query, ties by the smaller id. Exact, any dimension.

    Points lie in clusters around pivots (see Clusters). A query first meets the nearest cluster that has k points, which
    bounds the distance of its k-th neighbour, then those whose shell around their pivot comes nearer than that. A block
    of queries and one of points meet as a matrix product; products only choose candidates: distances are recomputed as
    sums of differences, squared, or absolute for metric "l1" (then d2 is that sum); by another metric d2 is the distance,
    and the metric has to keep the triangle inequality. Null vectors are left out.
    """
    clusters = Clusters(points, point_id, point_vec, checked(metric))
    rows = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    if not clusters.n:
        return queries.sparkSession.createDataFrame([], "q_id long, p_id long, d2 double, rank int")
    need, inner, outer, size = k + exclude_same_id, clusters.inner, clusters.outer, clusters.size

    def found(qi: np.ndarray, q: np.ndarray, bound: np.ndarray, pi: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        (near, wrong), want = rough(q, p, metric), min(k + 8 + exclude_same_id, len(pi))
        cut = np.minimum(np.partition(near, want - 1, axis=1)[:, want - 1], bound)
        n, j = np.nonzero(near <= (cut + 2 * wrong + 1e-6 * (1 + np.where(np.isfinite(cut), cut, 0)))[:, None])
        out = pd.DataFrame({"q_id": qi[n], "p_id": pi[j], "d2": exact(near, q, p, n, j, metric)})
        if exclude_same_id:
            out = out[out.q_id != out.p_id]
        return out.sort_values(["q_id", "d2", "p_id"]).groupby("q_id").head(k)

    order = Window.partitionBy("q_id").orderBy("d2", "p_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    full = np.flatnonzero(size >= need)
    if len(size) == 1 or not len(full):
        return best(clusters.meet(clusters.visits(rows, lambda part, d: (np.broadcast_to(size > 0, d.shape), np.full(len(d), np.inf)), metric), found))

    def home(part: pa.RecordBatch, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = np.zeros(d.shape, bool)
        which[np.arange(len(d)), full[d[:, full].argmin(axis=1)]] = True
        return which, np.full(len(d), np.inf)

    def others(part: pa.RecordBatch, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = part.column(2).to_numpy(zero_copy_only=False)
        low = np.maximum(np.maximum(d - outer, inner - d), 0)
        return (low <= (bound * (1 + 1e-6) + 1e-9)[:, None]) & (size > 0) & ~home(part, d)[0], bound

    first = saved(best(clusters.meet(clusters.visits(rows, home, metric), found)))
    far = first.filter(F.col("rank") == k).select(F.col("q_id").alias("__q"), (F.sqrt("d2") if metric == "l2" else F.col("d2")).alias("bound"))
    bounded = rows.join(far, F.col("id") == F.col("__q"), "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    more = clusters.meet(clusters.visits(bounded, others, metric), found)
    return best(first.drop("rank").unionByName(more))


def eps_vectors(queries: DataFrame, points: DataFrame, eps: float, exclude_same_id: bool = False, metric: Metric = "l2") -> DataFrame:
    """q_id, p_id, d2 of all pairs of (q_id, q_vec) and (p_id, p_vec) within eps (inclusive); any dimension.

    A query visits the clusters (see Clusters) whose shell around their pivot comes within eps of it.
    """
    clusters = Clusters(points, "p_id", "p_vec", checked(metric))
    rows = queries.select(F.col("q_id").cast("long").alias("id"), F.col("q_vec").cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    if not clusters.n:
        return queries.sparkSession.createDataFrame([], "q_id long, p_id long, d2 double")
    inner, outer, size = clusters.inner, clusters.outer, clusters.size

    def reach(part: pa.RecordBatch, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (np.maximum(d - outer, inner - d) <= eps * (1 + 1e-6) + 1e-9) & (size > 0), np.full(len(d), eps)

    def found(qi: np.ndarray, q: np.ndarray, bound: np.ndarray, pi: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        near = between(q, p, metric)
        n, j = np.nonzero(near <= eps * (1 + 1e-6) + 1e-6)
        d2 = exact(near, q, p, n, j, metric)
        out = pd.DataFrame({"q_id": qi[n], "p_id": pi[j], "d2": d2})[(np.sqrt(d2) if metric == "l2" else d2) <= eps]
        return out[out.q_id != out.p_id] if exclude_same_id else out

    return clusters.meet(clusters.visits(rows, reach, metric), found)


def cell(names: Sequence[str], size: float) -> list:
    return [F.floor(F.col(n) / size).alias(f"__c{k}") for k, n in enumerate(names)]


def eps_join(queries: DataFrame, points: DataFrame, eps: float, names: Sequence[str] = ("x", "y", "z"), query_id: str = "q_id", point_id: str = "p_id") -> DataFrame:
    """q_id, p_id, d2 of all pairs within eps (inclusive) in one to three dimensions.

    Space is cut into cells as wide as eps: a query meets the points of its own and the neighbouring cells by an
    equi-join on the cell, which Spark can shuffle, broadcast or split where a cell is crowded.
    """
    d = len(names)
    keys = [f"__c{k}" for k in range(d)]
    p = points.select(F.col(point_id).alias("p_id"), *[F.col(n).alias(f"p_{n}") for n in names], *cell(names, eps))
    q = queries.select(F.col(query_id).alias("q_id"), *[F.col(n).alias(f"q_{n}") for n in names], *cell(names, eps))
    for key in keys:
        q = q.withColumn(key, F.explode(F.array(*[F.col(key) + s for s in (-1, 0, 1)])))
    d2 = (Vec.of(*[f"q_{n}" for n in names]) - Vec.of(*[f"p_{n}" for n in names])).norm2()
    return q.join(p, keys).withColumn("d2", d2).filter(F.sqrt("d2") <= eps).select("q_id", "p_id", "d2")


#: Cells of a level along each side of a cell of the next.
FAN = 4
#: Levels of at most so many cells are summed up on the driver and broadcast; larger ones are tables in the shared folder.
SMALL_LEVEL = 20_000


class Levels:
    """Items (item_id, lo_x, .., hi_x, .., rep_x, ..: a box around each and one point of it) summed up in cells of size start by their point, these in cells FAN times as wide, and so on to a level of a few cells."""

    def __init__(self, items: DataFrame, start: float, names: Sequence[str]):
        self.names, self.keys = names, [f"__c{k}" for k in range(len(names))]
        box = items.agg(*[f(f"{e}_{n}").alias(f"{e}_{n}") for n in names for e, f in (("lo", F.min), ("hi", F.max))]).first()
        self.empty = box[0] is None
        self.ends, self.reps = [f"{e}_{n}" for n in names for e in ("lo", "hi")], [f"rep_{n}" for n in names]
        self.items = items.select("item_id", *self.ends, *self.reps, *[F.floor(F.col(f"rep_{n}") / start).alias(k) for n, k in zip(names, self.keys)])
        levels, size = 1, start
        while not self.empty and max(box[f"hi_{n}"] - box[f"lo_{n}"] for n in names) > 2 * size:
            levels, size = levels + 1, size * FAN
        self.tables, self.small = [], []
        if self.empty:
            return
        finest = self._summed(self.items).transform(saved)
        local = finest.toPandas() if finest.count() <= SMALL_LEVEL else None
        self.tables, self.small = [finest], [local is not None]
        for _ in range(levels - 1):
            if local is None and self.tables[-1].count() <= SMALL_LEVEL:
                local = self.tables[-1].toPandas()
            if local is None:
                self.tables.append(self._summed(self.tables[-1].withColumns({k: F.floor(F.col(k) / FAN) for k in self.keys})).transform(saved))
            else:
                local = self._coarser(local)
                self.tables.append(items.sparkSession.createDataFrame(local, finest.schema))
            self.small.append(local is not None)

    def _coarser(self, cells: pd.DataFrame) -> pd.DataFrame:
        moved = cells.assign(**{k: cells[k] // FAN for k in self.keys}).sort_values(self.reps)
        ends = {e: "min" if e.startswith("lo") else "max" for e in self.ends}
        out = moved.groupby(self.keys, as_index=False).agg(ends | {r: "first" for r in self.reps})
        return out[[*self.keys, *self.ends, *self.reps]]

    def _summed(self, df: DataFrame) -> DataFrame:
        first = F.min(F.struct(*self.reps)).alias("__r")
        boxes = [(F.min if e.startswith("lo") else F.max)(e).alias(e) for e in self.ends]
        return df.groupBy(*self.keys).agg(*boxes, first).select(*self.keys, *self.ends, *[F.col(f"__r.{r}").alias(r) for r in self.reps])

    def descend(self, queries: DataFrame, keep) -> DataFrame:
        """(q_id, item_id) of what is left when `keep` filters pairs of queries (q_id and further columns) and cells, level by level, then items."""
        columns = queries.columns
        if self.empty:
            return queries.select("q_id").join(self.items.select("item_id"), F.lit(False))
        found = keep(queries.crossJoin(F.broadcast(self.tables[-1])))  # a few cells: at most 4 a side
        for table, small in zip(self.tables[-2::-1], self.small[-2::-1]):
            parents = [f"__p{k}" for k in range(len(self.keys))]
            children = table.withColumns({p: F.floor(F.col(k) / FAN) for p, k in zip(parents, self.keys)})
            above = found.select(*columns, *[F.col(k).alias(p) for p, k in zip(parents, self.keys)])
            found = keep(above.join(F.broadcast(children) if small else children, parents).drop(*parents))
            found = found if small else found.transform(saved)
        return keep(found.select(*columns, *self.keys).join(self.items, self.keys)).select("q_id", "item_id")


def nearest_candidates(queries: DataFrame, items: DataFrame, start: float, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of q_id and item_id among which every query's nearest item is, without meeting all items.

    queries: (q_id, coordinates); items as in Levels. Queries go down the levels: a cell is kept if its box is not
    farther than the nearest representative seen, so a query goes on with few cells a level, however far or crowded
    the items are.
    """
    levels = Levels(items, start, names)

    def pruned(df: DataFrame) -> DataFrame:
        at = Vec.of(*[f"q_{n}" for n in names])
        gap = Vec(tuple(F.greatest(F.col(f"lo_{n}") - F.col(f"q_{n}"), F.col(f"q_{n}") - F.col(f"hi_{n}"), F.lit(0.0)) for n in names))
        seen = df.withColumn("__low", gap.norm2()).withColumn("__up", (at - Vec.of(*levels.reps)).norm2())
        least = F.min("__up").over(Window.partitionBy("q_id"))
        return seen.withColumn("__least", least).filter("__low <= __least").drop("__low", "__up", "__least")

    return levels.descend(queries.select("q_id", *[F.col(n).alias(f"q_{n}") for n in names]), pruned)


def line_candidates(lines: DataFrame, items: DataFrame, start: float, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of q_id and item_id such that the line (q_id, o_x, .., d_x, ..), endless both ways, meets the item's box."""
    far = 1e300

    def crossed(df: DataFrame) -> DataFrame:
        enters, leaves = [], []
        for n in names:
            o, d, slack = F.col(f"o_{n}"), F.col(f"d_{n}"), F.lit(1e-9) * (1 + F.abs(F.col(f"lo_{n}")) + F.abs(F.col(f"hi_{n}")))
            lo, hi = F.col(f"lo_{n}") - slack, F.col(f"hi_{n}") + slack
            inside = (o >= lo) & (o <= hi)
            a, b = F.try_divide(lo - o, d), F.try_divide(hi - o, d)
            enters.append(F.when(d == 0, F.when(inside, F.lit(-far)).otherwise(F.lit(far))).otherwise(F.least(a, b)))
            leaves.append(F.when(d == 0, F.when(inside, F.lit(far)).otherwise(F.lit(-far))).otherwise(F.greatest(a, b)))
        return df.filter((F.greatest(*enters) if len(names) > 1 else enters[0]) <= (F.least(*leaves) if len(names) > 1 else leaves[0]))

    return Levels(items, start, names).descend(lines.select("q_id", *[f"{e}_{n}" for n in names for e in ("o", "d")]), crossed)


def nearest(queries: DataFrame, points: DataFrame, start: float, names: Sequence[str] = ("x", "y", "z"), query_id: str = "q_id", point_id: str = "p_id") -> DataFrame:
    """q_id, p_id, d2: the nearest point of every query in one to three dimensions, ties by the smaller id.

    start: about the distance of neighbouring points; it only decides the number of levels of the search. Rows with a
    NULL coordinate are left out.
    """
    q = queries.select(F.col(query_id).alias("q_id"), *names).dropna()
    p = points.select(F.col(point_id).alias("item_id"), *names).dropna()
    items = p.select("item_id", *[F.col(n).alias(f"{e}_{n}") for n in names for e in ("lo", "hi", "rep")])
    pairs = nearest_candidates(q, items, start, names)
    d2 = (Vec.of(*[f"a_{n}" for n in names]) - Vec.of(*[f"b_{n}" for n in names])).norm2()
    near = pairs.join(q.toDF("q_id", *[f"a_{n}" for n in names]), "q_id").join(p.toDF("item_id", *[f"b_{n}" for n in names]), "item_id")
    best = near.groupBy("q_id").agg(F.min(F.struct(d2.alias("d2"), F.col("item_id").alias("p_id"))).alias("m"))
    return best.select("q_id", "m.p_id", "m.d2")


def region(points: DataFrame, lower: Sequence[float], upper: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Points of a closed box."""
    for n, a, b in zip(names, lower, upper, strict=True):
        points = points.filter(F.col(n).between(float(a), float(b)))
    return points


def exact_point(points: DataFrame, at: DataFrame, names: Sequence[str]) -> DataFrame:
    """Points whose coordinates occur in `at`."""
    return points.join(at.select(*names).distinct(), list(names), "left_semi")
