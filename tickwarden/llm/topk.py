"""Exact inner-product top-k by dual-tree search over cover trees.

Vectors are cut into compact blocks of bounded size around pivots (a bounded sample), queries
into blocks of their own. Pairs of blocks that a bound excludes are dropped; each other pair is
one group of a cogroup, in which both blocks are indexed by a cover tree and searched together: a
pair of nodes with centres q and p and covering radii r and s can't hold a score above
<q, p> + r |p| + s |q| + r s, and is left out if that is below the worst k-th score of the
query node. First bounds come from the scores against the pivots. The k best of each pair meet by
query in a window of Spark.

Components become floor(scale * x). Vectors that are null or hold null or non-finite components take
no part; vectors of other lengths than a query's are no candidates for it. Ties go to the smaller
vec_id. Scores are exact; one beyond 64 bits is an error. Rows with equal ids are rows of their own, as candidates and as queries: each such query has its own k rows
in the result, under the id that they share; a query's own id is no candidate. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ship

#: Rows of a block, on average, and pivots at most.
BLOCK_ROWS = 1024
MOST_PIVOTS = 256
#: A cover tree's radii shrink by this factor from level to level; nodes of up to LEAF points are leaves.
BASE = 1.3
LEAF = 64


class CoverTree:
    """Points in depth-first order; every node is a range of them with a point as its centre and a covering radius.

    The children of a node of radius r are cut around its own centre and points of it that lie more than r / BASE apart (separation) and
    cover it within r / BASE (covering). A node that ``fanout`` such children don't cover, or of up to LEAF points, is a leaf.
    """

    def __init__(self, points: np.ndarray, fanout: int = 32) -> None:
        self.points, self.fanout = points, fanout
        order = np.arange(len(points))
        self.start: list[int] = []
        self.end: list[int] = []
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        todo = [(0, len(points), -1, middle)]
        while todo:
            s, e, parent, point = todo.pop()
            own, node = points[order[s:e]], len(self.start)
            near = ((own - points[point]) ** 2).sum(axis=1)
            radius = float(np.sqrt(near.max()))
            self.start.append(s), self.end.append(e), self.children.append([]), self.centres.append(points[point]), self.radii.append(radius)
            if parent >= 0:
                self.children[parent].append(node)
            if e - s <= LEAF or radius == 0:
                continue
            picked, to, least = [point], np.zeros(e - s, np.int64), (radius / BASE) ** 2
            while near[pick := int(near.argmax())] > least and len(picked) < fanout:
                d = ((own - own[pick]) ** 2).sum(axis=1)
                closer = d < near
                near[closer], to[closer] = d[closer], len(picked)
                picked.append(int(order[s + pick]))
            if near.max() > least:
                continue
            by = np.argsort(to, kind="stable")
            order[s:e] = order[s:e][by]
            cuts = s + np.searchsorted(to[by], np.arange(len(picked) + 1))
            todo += [(int(a), int(b), node, p) for a, b, p in zip(cuts, cuts[1:], picked)]
        self.order = order
        self.centre = np.array(self.centres)
        self.radius = np.array(self.radii)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))


def dual_tree_top_k(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, score) of each query's k best points whose score reaches its floor."""
    most_score = float(np.sqrt((q**2).sum(axis=1).max() * (p**2).sum(axis=1).max()))
    if most_score * max(len(p), 2) >= 2.0**52:  # beyond what doubles and packed keys hold exactly
        return _by_integers(q, q_ids, p, p_ids, k)
    slop = 1e-9 * most_score + 1e-6  # more than rounding can be off
    qt, pt = CoverTree(q), CoverTree(p)
    q, q_ids, floor = q[qt.order], q_ids[qt.order], floor[qt.order]
    p, p_ids = p[pt.order], p_ids[pt.order]
    rank = np.empty(len(p), np.int64)  # ties go to the smaller id
    rank[np.argsort(p_ids, kind="stable")] = np.arange(len(p))[::-1]
    none = np.iinfo(np.int64).min
    best = np.full((len(q), k), none)
    kth = floor.astype(np.float64)
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        s, e = qt.start[a], qt.end[a]
        most = qt.centre[a] @ pt.centre[b] + qt.radius[a] * pt.norm[b] + pt.radius[b] * qt.norm[a] + qt.radius[a] * pt.radius[b]
        if most + slop < kth[s:e].min():
            continue
        if qt.children[a] and (not pt.children[b] or e - s >= pt.end[b] - pt.start[b]):
            todo += [(c, b) for c in qt.children[a]]
        elif pt.children[b]:
            c = np.array(pt.children[b])
            bound = pt.centre[c] @ qt.centre[a] + pt.radius[c] * qt.norm[a]
            todo += [(a, int(x)) for x in c[np.argsort(bound)]]  # the last is looked at first
        else:
            t, f = pt.start[b], pt.end[b]
            score = np.rint(q[s:e] @ p[t:f].T).astype(np.int64)
            keys = np.where((q_ids[s:e, None] == p_ids[None, t:f]) | (score < floor[s:e, None]), none, score * len(p) + rank[t:f])
            both = np.concatenate([best[s:e], keys], axis=1)
            best[s:e] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            low = best[s:e].min(axis=1)
            kth[s:e] = np.maximum(kth[s:e], np.where(low == none, -np.inf, low // len(p)))
    row, col = np.nonzero(best != none)
    keys = best[row, col]
    at = np.empty(len(p), np.int64)
    at[rank] = np.arange(len(p))
    return qt.order[row], pt.order[at[keys % len(p)]], keys // len(p)


def _by_integers(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by Python's integers, whatever their size."""
    rows, cols, scores = [], [], []
    whole = [[int(y) for y in x] for x in p.tolist()]
    for i, x in enumerate(q.tolist()):
        x = [int(y) for y in x]
        every = sorted((-sum(a * b for a, b in zip(x, y)), int(p_ids[j]), j) for j, y in enumerate(whole) if p_ids[j] != q_ids[i])
        for score, _, j in every[:k]:
            rows.append(i), cols.append(j), scores.append(-score)
    if any(abs(x) >= 2**63 for x in scores):
        raise ValueError("a score does not fit in 64 bits")
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(scores, np.int64)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _nearest(df: DataFrame, pivots: np.ndarray, column: str) -> DataFrame:
    """The nearest pivot of each vector and the distance to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.array(b["v"].tolist(), np.float64)
                d = (pivots**2).sum(axis=1)[None, :] - 2 * v @ pivots.T
                to = d.argmin(axis=1)
                yield b[["vec_id", "v"]].assign(**{column: to.astype(np.int32), "far": np.sqrt(((v - pivots[to]) ** 2).sum(axis=1))})

    return df.mapInPandas(assign, f"vec_id long, v array<double>, {column} int, far double")


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), F.asc("vec_id"))
    return df.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each row that ``queries`` marks."""
    spark = vectors.sparkSession
    ship(spark)
    doubles = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    given = vectors.where(F.col(id).isNotNull() & usable(F.col(vector))).select(F.col(id).cast("long").alias("vec_id"), queries.alias("asks"), doubles.alias("v"))
    given = given.where(F.size("v") > 0)
    out: DataFrame | None = None
    for row in given.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():  # lengths of vectors: one, as a rule
        found = _of_one_length(given.where(F.size("v") == row["n"]), row["count"], k, block_rows, most_pivots)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _of_one_length(given: DataFrame, n: int, k: int, block_rows: int, most_pivots: int) -> DataFrame:
    data, asking = given.drop("asks"), given.where("asks").drop("asks")
    n_asking = asking.count()
    want = min(most_pivots, max(1, n // block_rows))
    drawn = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(want, 4 * k)).collect()
    sample, sample_ids = np.array([r["v"] for r in drawn]), np.array([r["vec_id"] for r in drawn])
    few = min(most_pivots, max(1, n_asking // block_rows))
    blocks = _nearest(data, sample[:want], "p")
    groups = _nearest(asking, sample[:few], "g")

    # per pivot: rows and covering radius; as many numbers as pivots
    sides = {}
    for name, df, column in (("p", blocks, "p"), ("g", groups, "g")):
        rows = df.groupBy(column).agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        sides[name] = {r[column]: (max(1, -(-r["n"] // block_rows)), r["far"]) for r in rows}

    def floors(v: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A score that k rows of the sample reach."""
        s = np.where(ids[:, None] == sample_ids[None, :], -np.inf, v @ sample.T)
        return np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(v), -np.inf)

    def with_floor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                f = floors(np.array(b["v"].tolist(), np.float64), b["vec_id"].to_numpy())
                f = np.where(np.isfinite(f), f, -np.inf)
                yield b.drop(columns="far").assign(least=f - 1e-9 * np.abs(f) - 1)

    # a number for each query row; ids may repeat
    groups = checkpoint(groups.mapInPandas(with_floor, "vec_id long, v array<double>, g int, least double").withColumn("row", F.monotonically_increasing_id()))
    least = {r["g"]: r["least"] for r in groups.groupBy("g").agg(F.min("least").alias("least")).collect()}
    norm = np.sqrt((sample**2).sum(axis=1))
    pairs = [
        (g, gs, p, ps)
        for g, (gs, gr) in sides["g"].items()
        for p, (ps, pr) in sides["p"].items()
        if (sample[g] @ sample[p] + gr * norm[p] + pr * norm[g] + gr * pr) + 1e-9 * (norm[g] + gr) * (norm[p] + pr) + 1e-6 >= least[g]
    ]
    spark = given.sparkSession
    pair = spark.createDataFrame(pairs, "g int, gs int, p int, ps int")  # most_pivots^2 rows at most
    to_p, to_g = pair.groupBy("p").agg(F.first("ps").alias("ps"), F.collect_list(F.struct("g", "gs")).alias("to")), pair.groupBy("g").agg(F.first("gs").alias("gs"), F.collect_list(F.struct("p", "ps")).alias("to"))
    part = lambda of: F.pmod(F.xxhash64("vec_id", "v"), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    left = groups.join(F.broadcast(to_g), "g").withColumn("gi", part("gs")).withColumn("to", F.explode("to")).select("g", "gi", F.col("to.p").alias("p"), F.explode(every("to.ps")).alias("pi"), "vec_id", "row", "v", "least")
    right = blocks.join(F.broadcast(to_p), "p").withColumn("pi", part("ps")).withColumn("to", F.explode("to")).select(F.col("to.g").alias("g"), F.explode(every("to.gs")).alias("gi"), "p", "pi", "vec_id", "v")

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []}, dtype=np.int64)
        qi, pi = q["vec_id"].to_numpy(), p["vec_id"].to_numpy()
        a, b, score = dual_tree_top_k(np.array(q["v"].tolist()), qi, np.array(p["v"].tolist()), pi, k, q["least"].to_numpy())
        return pd.DataFrame({"query_id": qi[a], "row": q["row"].to_numpy()[a], "vec_id": pi[b], "score": score})

    by = ["g", "gi", "p", "pi"]
    found = left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(search, "query_id long, row long, vec_id long, score long")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
