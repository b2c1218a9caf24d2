"""Nearest neighbours by inner product over learned partitions.

The index is fitted on a sample of at most ``SAMPLE`` vectors, the first by a hash of the id (a documented bound). Their graph
of nearest neighbours is cut into parts of equal size: parts start from seeds spread over the vectors, and nodes then change
to the part that holds most of their neighbours as far as its room allows. A small network with one hidden layer learns to
predict from a vector in which parts its neighbours lie. Every vector of the table is put into its most probable part; a
query goes to its most probable parts until their probabilities reach ``mass``, the least value at which sample vectors left
out of the fit found ``RECALL`` of their neighbours, and goes on until those parts hold enough candidates. What is found there
is ranked by the exact inner product in double precision.

Parts are cut into blocks of bounded size by a hash of the id, and a block of candidates meets a block of queries per task
group: a part may hold any share of the rows. A query first meets the blocks of its most probable part; its k-th best score
there is the bound that candidates of the other parts must reach to be handed on. Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. Rows that repeat a vec_id are candidates of their own, and queries with that id get one
answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import materialize

SAMPLE = 6_000
PARTS = 24
NEIGHBOURS = 20
HIDDEN = 64
EPOCHS = 60
RECALL = 0.97
BLOCK = 512
#: A part has at most so many blocks while they hold no more than ``WIDEST`` candidates: every query goes to each of them.
BLOCKS = 64
WIDEST = 8_192
#: Rows in which queries are sent to blocks at once.
SENT = 4_096
#: Queries of one block; a candidate is sent once to each of them.
ASKERS = 4_096


@dataclass
class Router:
    """The classifier and the probability mass that a query covers."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(x @ self.w1 + self.b1, 0)
        z = hidden @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row with the others, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo:lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo:lo + 1024] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 30, slack: float = 1.05) -> np.ndarray:
    """Cut the neighbour graph into parts of at most ``slack`` times the mean size with few links between them."""
    rng = np.random.default_rng(3)
    n = len(x)
    room = int(np.ceil(slack * n / parts))
    centers = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    for _ in range(10):  # spread starting parts: nodes choose in the order of how much they prefer their first choice
        s = x @ centers.T
        order = np.argsort(-(np.partition(s, -2, 1)[:, -1] - np.partition(s, -2, 1)[:, -2]), kind="stable")
        label = _fill(s, order, room, parts)
        for p in range(parts):
            if (label == p).any():
                c = x[label == p].mean(0)
                centers[p] = c / max(np.linalg.norm(c), 1e-12)
    back = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (back[0], label[back[1]]), 1.0)
        np.add.at(votes, (back[1], label[back[0]]), 1.0)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                label[i] = best[i]
                size[best[i]] += 1
                moved += 1
        if not moved:
            break
    return label


def _fill(s: np.ndarray, order: np.ndarray, room: int, parts: int) -> np.ndarray:
    label, size = np.zeros(len(s), np.int64), np.zeros(parts, np.int64)
    wish = np.argsort(-s, 1)
    for i in order.tolist():
        for p in wish[i].tolist():
            if size[p] < room:
                label[i], size[p] = p, size[p] + 1
                break
    return label


def fit_router(x: np.ndarray, parts: int = PARTS, neighbours: int = NEIGHBOURS, recall: float = RECALL) -> Router:
    """Fit on the sample; a fifth of it only chooses the mass."""
    n, d = x.shape
    parts = max(1, min(parts, n // (2 * neighbours)))
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    near = _nearest(x, min(neighbours, n - 1))
    label = balanced_parts(x, near, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), label[near].reshape(-1)), 1.0 / near.shape[1])
    held = np.arange(n) % 5 == 4
    router = _learn(x[~held], 0.9 * target[~held] + 0.1 * np.eye(parts)[label[~held]], parts)
    # vectors lie where the router puts them
    p = router.probabilities(x)
    place = p.argmax(1)
    share = np.sort(p[held], 1)[:, ::-1]
    order = np.argsort(-p[held], 1, kind="stable")
    rank = np.argsort(order, 1)
    rows = np.flatnonzero(held)
    at = rank[np.arange(len(rows))[:, None], place[near[rows]]]
    before = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(share, 1)[:, :-1]], 1)
    # a neighbour is found when the mass before its part is below the mass covered
    reached = np.sort(before[np.arange(len(rows))[:, None], at].reshape(-1))
    mass = reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))))] + 1e-9
    return Router(router.w1, router.b1, router.w2, router.b2, float(min(mass, 1.0)))


def _learn(x: np.ndarray, target: np.ndarray, parts: int) -> Router:
    """Cross-entropy to the neighbours' parts, by mini-batches with adaptive steps."""
    rng = np.random.default_rng(5)
    d = x.shape[1]
    scale = np.sqrt((x * x).sum(1).mean())
    p = [rng.normal(0, np.sqrt(2.0) / scale, (d, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, np.sqrt(1.0 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            own = order[lo:lo + 256]
            a = x[own] @ p[0] + p[1]
            h = np.maximum(a, 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - target[own]) / len(own)
            gh = (g @ p[2].T) * (a > 0)
            grads = [x[own].T @ gh + 1e-5 * p[0], gh.sum(0), h.T @ g + 1e-5 * p[2], g.sum(0)]
            step += 1
            for i, gr in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * gr
                second[i] = 0.999 * second[i] + 0.001 * gr * gr
                p[i] -= rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Router(p[0], p[1], p[2], p[3], 1.0)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, vec) that take part: of the commonest length, finite, not zero; vec is array<double>."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(fine & F.exists("vec", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(sizes.select("d")), F.size("vec") == F.col("d")).select("id", "vec")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def block_counts(count: np.ndarray) -> np.ndarray:
    """Number of blocks of parts with so many candidates."""
    size = np.clip(-(-count // BLOCKS), BLOCK, WIDEST)
    return np.maximum(1, -(-count // size))


def to_blocks(batch: pa.RecordBatch, row: np.ndarray, visited: np.ndarray, blocks: np.ndarray,
              most: int) -> Iterator[pa.RecordBatch]:
    """Queries ``row`` of the batch, once for each block of the part that each visits, in batches of about ``most`` rows."""
    times = blocks[visited]
    ends = np.cumsum(times)
    lo = 0
    while lo < len(times):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - times[lo] + most, "right")))
        own = times[lo:hi]
        block = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        take, part = np.repeat(row[lo:hi], own), np.repeat(visited[lo:hi], own).astype(np.int32)
        for at in range(0, len(take), most):  # one part alone may have more blocks
            rows = slice(at, at + most)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(take[rows])) for c in ("id", "vec", "bound")], pa.array(part[rows]),
                 pa.array(block[rows].astype(np.int32))], ["id", "vec", "bound", "part", "block"])
        lo = hi


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
            sample: int = SAMPLE, parts: int = PARTS) -> DataFrame:
    """The k nearest of each query row: query_id, rank, the candidate's id as ``id_col``, score.

    ``is_query`` is a condition on ``id``. A query never finds a row with its own id. With fewer than k candidates found in
    the parts of its mass, a query visits further parts, so only a table with fewer gives fewer.
    """
    rows = materialize(usable(vectors, id_col, vec_col), "vectors")
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["vec"].to_numpy()).astype(np.float64)
        r = fit_router(x, parts)
        flat = [np.asarray(a, np.float64) for a in (r.w1, r.b1, r.w2, r.b2, np.array([r.mass]))]
        return pd.DataFrame({"part": range(5), "shape": [list(a.shape) for a in flat], "data": [a.tobytes() for a in flat]})

    made = materialize(picked.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        fit, "part int, shape array<int>, data binary"), "router").orderBy("part").collect()
    if not made:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col),
                           F.lit(0.0).alias("score")).where("false")
    router = Router(*[np.frombuffer(r["data"]).reshape(r["shape"]) for r in made[:4]], float(np.frombuffer(made[4]["data"])[0]))
    sent = rows.sparkSession.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.probabilities(_matrix(batch.column("vec"))) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(
                p.argmax(1).astype(np.int32))], ["id", "vec", "part"])

    placed = rows.mapInArrow(place, "id long, vec array<double>, part int")
    placed = materialize(placed.withColumn("query", is_query), "placed")
    count = np.zeros(len(router.b2), np.int64)
    for r in placed.groupBy("part").count().collect():  # a row per part
        count[r["part"]] = r["count"]
    own_rows = placed.groupBy("id").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
    repeats = own_rows.agg(F.max("own")).first()[0] or 1
    blocks, sent_rows = block_counts(count), SENT

    def route(home: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Sends queries to the blocks of their most probable part, or to those of the others that they visit."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                p = sent.value.probabilities(_matrix(batch.column("vec")))
                order = np.argsort(-p, 1, kind="stable")
                share = np.take_along_axis(p, order, 1)
                before = np.cumsum(share, 1) - share
                enough = np.cumsum(count[order], 1) - count[order] < k + repeats
                row, at = np.nonzero(((before < sent.value.mass) | enough) & ((np.arange(p.shape[1]) == 0) == home))
                yield from to_blocks(batch, row, order[row, at], blocks, sent_rows)

        return task

    # of the rows that repeat a vec_id the least vector asks, in both steps and on every run
    asking = materialize(placed.where("query").groupBy("id").agg(F.min("vec").alias("vec")), "asking")
    per_part = placed.where("query").count()
    query_blocks = max(1, -(-per_part // ASKERS))
    salt = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(query_blocks)).cast("int")
    size = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("part") + 1)
    held = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), size).cast("int")).withColumn(
        "asker", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select("id", "vec", "part", "block", "asker")

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "score": []}
        if len(queries) and len(candidates):
            x = np.stack(candidates["vec"].to_numpy()).astype(np.float64)
            ids = candidates["id"].to_numpy()
            step = max(64, 1024 * BLOCK // max(BLOCK, len(candidates)))
            for lo in range(0, len(queries), step):
                q = np.stack(queries["vec"].to_numpy()[lo:lo + step]).astype(np.float64)
                names = queries["id"].to_numpy()[lo:lo + step]
                s = q @ x.T
                s[names[:, None] == ids[None, :]] = -np.inf
                top = min(k, s.shape[1])
                least = np.partition(s, s.shape[1] - top, 1)[:, s.shape[1] - top]
                least = np.fmax(least, queries["bound"].to_numpy(np.float64)[lo:lo + step])
                row, at = np.nonzero((s >= least[:, None] - 1e-9 * np.abs(least[:, None])) & np.isfinite(s))
                out["query_id"].append(names[row])
                out["id"].append(ids[at])
                # summed in one order for every pair, whatever block it is met in
                out["score"].append(np.einsum("ij,ij->i", q[row], x[at]))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64 if c != "score" else np.float64)
                             for c, v in out.items()})

    keys = ["part", "block", "asker"]

    def found(home: bool, queries: DataFrame) -> DataFrame:
        asked = queries.mapInArrow(route(home), "id long, vec array<double>, bound double, part int, block int")
        return asked.withColumn("asker", salt).groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(
            meet, "query_id long, id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = found(True, asking.withColumn("bound", F.lit(None).cast("double"))).withColumn("rank", F.row_number().over(best))
    near = materialize(near.where(F.col("rank") <= k), "near")
    bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    far = found(False, asking.join(bounds, "id", "left").select("id", "vec", "bound"))
    ranked = near.drop("rank").unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
