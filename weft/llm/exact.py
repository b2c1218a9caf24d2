"""Exact de-duplication against a history held in minimal perfect hash tables.

The history's distinct digests are dealt into shards of bounded size. Each shard is a minimal perfect hash: a digest's
bucket names a pilot, and the pilot sends the digest to a slot of its own among exactly as many slots as there are
digests. A slot holds the full digest, the locator of the row that won so far, and how many rows had it. A new digest
is sent to its slot and compared byte by byte: an equal one joins the slot's rows, any other is no member and is grouped
with its like among the new rows.

A null text counts as an empty one. Rows that repeat a doc_id and its text are one document and get one answer. Of equal
texts the row with the largest doc_id stays, null being the smallest; where all are null, all of them are marked as kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import attach, materialize
from weft.llm.kernels import mix

DIGEST_BYTES = 32
SHARD_DIGESTS = 50_000
BUCKET = 4
_SEEDS = 1 << 22
_INDEX = "shard int, pilots binary, digests binary, winners binary, counts binary"
_CLASSES = "digest binary, keep_id long, group_size long"
#: Stands for a null locator; doc_ids are compared with null as the smallest.
NO_ID = -(1 << 63)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each digest."""
    wide = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), -1)
    return mix(wide[:, 0] ^ mix(wide[:, 2])), mix(wide[:, 1] + mix(wide[:, 3]))


def _slots(value: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (mix(value ^ mix(pilots.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build_table(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots by bucket, and the slot of every digest; the digests have to be distinct.

    Large buckets are placed first. A bucket of one takes a free slot by its number, stored below zero.
    """
    n = len(digests)
    buckets = max(1, n // BUCKET)
    first, second = _keys(digests)
    bucket = (first % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    sizes = np.diff(ends, prepend=0)
    pilots, slot, free = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[b])
        members = order[ends[b] - size:ends[b]]
        if size < 2:
            break
        for seed in range(0, _SEEDS, 128):
            tried = np.arange(seed, seed + 128)
            at = _slots(second[members][None, :], tried[:, None], n)
            fits = free[at].all(1)
            if fits.any():
                rows = np.flatnonzero(fits)
                apart = (np.diff(np.sort(at[rows], 1), axis=1) > 0).all(1)
                if apart.any():
                    row = rows[apart.argmax()]
                    pilots[b], slot[members] = tried[row], at[row]
                    free[at[row]] = False
                    break
        else:
            raise RuntimeError("no pilot found: are the digests distinct?")
    alone = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    pilots[alone], slot[order[ends[alone] - 1]] = -1 - left, left
    return pilots, slot


def find_slots(digests: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot each digest is sent to; only a member's slot holds it."""
    first, second = _keys(digests)
    pilot = pilots[(first % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(pilot < 0, -1 - pilot, _slots(second, np.maximum(pilot, 0), n))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, DIGEST_BYTES)


def build_index(classes: DataFrame, shards: int) -> DataFrame:
    """One row per shard from (digest, keep_id, group_size)."""

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("digest")
        digests = _matrix(group["digest"])
        pilots, slot = build_table(digests)
        back = np.empty_like(slot)
        back[slot] = np.arange(len(slot))
        winners = group["keep_id"].to_numpy()[back]
        counts = group["group_size"].to_numpy()[back]
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "pilots": [pilots.tobytes()],
                             "digests": [digests[back].tobytes()], "winners": [winners.astype(np.int64).tobytes()],
                             "counts": [counts.astype(np.int64).tobytes()]})

    return classes.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(shard, _INDEX)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def look_up(index: DataFrame, classes: DataFrame, shards: int) -> DataFrame:
    """All classes after ``classes`` of new rows have met the index: (digest, keep_id, group_size)."""

    def shard(held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return new[["digest", "keep_id", "group_size"]]
        pilots = np.frombuffer(held["pilots"].iloc[0], np.int64)
        digests = np.frombuffer(held["digests"].iloc[0], np.uint8).reshape(-1, DIGEST_BYTES)
        winners = np.frombuffer(held["winners"].iloc[0], np.int64).copy()
        counts = np.frombuffer(held["counts"].iloc[0], np.int64).copy()
        out = [pd.DataFrame({"digest": [d.tobytes() for d in digests]})]
        if len(new):
            asked = _matrix(new["digest"])
            slot = find_slots(asked, pilots, len(digests))
            member = (digests[slot] == asked).all(1)
            at = slot[member]  # distinct digests have distinct slots
            winners[at] = np.maximum(winners[at], new["keep_id"].to_numpy()[member])
            counts[at] += new["group_size"].to_numpy()[member]
            out.append(new.loc[~member, ["digest", "keep_id", "group_size"]])
        out[0]["keep_id"], out[0]["group_size"] = winners, counts
        return pd.concat(out)

    new = classes.withColumn("shard", _shard(shards))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(shard, _CLASSES)


def _classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("keep_id"),
                                      F.count(F.lit(1)).alias("group_size"))


def exact_duplicates(rows: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """Each row's class, from rows (doc_id, digest, historical): keep_id, group_size and kept are added."""
    past = materialize(_classes(rows.where("historical")), "past")
    new = materialize(_classes(rows.where("not historical")), "new")
    shards = -(-max(past.count(), new.count(), 1) // shard_digests)
    index = materialize(build_index(past, shards), "index")
    classes = materialize(look_up(index, new, shards), "classes")
    out = attach(rows, classes, ["digest"], "group_size")
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return out.withColumn("keep_id", keep).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
