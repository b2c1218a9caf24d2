"""The prefix trie of conversations, read off their sorted order.

Conversations are put into lexicographic order of their turns, so the members of a prefix are neighbours. LCP[i] is the number
of leading turns that conversation i shares with the one before. A prefix of depth d around position i reaches left and right as long
as the LCPs stay at d or more. Each end is found by itself, by binary search in a sparse table of range minima; a second
sparse table gives the smallest member. No stack is kept and no prefix waits for another, so all are searched at once.

**Order.** Turns are compared by SHA-256 of role and text. Up to ``RADIX`` digests in a row are one fixed-width string;
longer conversations take the ranks of such strings as digits of the next level, until each conversation is one string. A
conversation of any length is only ever handled by its turns.

**Two levels of minima.** Positions are cut into at most ``MAX_BLOCKS`` blocks. A task holds one block's tables and up to
``2**SLICE`` depths of its prefixes. A prefix that reaches past its block asks the table of block minima (broadcast, bounded by
``MAX_BLOCKS``) which block ends it, and that block where; equal questions are asked once.

**Sums.** In sorted order the nodes below one are owned by the positions of its interval (position i owns the depths above
LCP[i]), so sums over subtrees are differences of prefix sums over positions plus the rest of the owner's own path.
Prefixes of one member need no search: the two LCPs beside them say so.

Odd inputs: rows without a conv_id are no conversation's. Null role or text counts as empty; a null turn comes first; rows of one
turn number go by the SHA-256 of role and text; repeated rows are repeated turns. An empty table has no node, not even the root.
Other columns are not read. The members' ids are hashed as a stream of bounded pieces, as SHA-256 has to see them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import attach
from weft.llm.mixing import word_count
from weft.llm.workers import ship
from weft.operators.ordered import OrderedRows
from weft.sources.workspace import materialize

#: Digits of one comparison string.
RADIX = 64
#: Least positions of a block, and most blocks.
BLOCK = 2048
MAX_BLOCKS = 1 << 16
#: Depths that one task searches together, as a power of two.
SLICE = 11
#: Conversation ids of one piece of a hashed list.
PIECE = 512
_NONE = np.iinfo(np.int64).max


class RangeMinimum:
    """Sparse table: ``levels[k][i]`` is the least of the 2**k values from i on."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least value of each range lo..hi, both included; of an empty range the greatest number."""
        out = np.full(len(lo), _NONE, np.int64)
        width = hi - lo + 1
        some = width > 0
        k = np.zeros(len(lo), np.int64)
        k[some] = np.frexp(width[some].astype(np.float64))[1] - 1
        for level in np.unique(k[some]).tolist():
            at = some & (k == level)
            row = self.levels[level]
            out[at] = np.minimum(row[lo[at]], row[hi[at] + 1 - (1 << level)])
        return out

    def run_start(self, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Where the run of values of at least ``bound`` that stops before ``end`` begins."""
        at = end.astype(np.int64).copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at >= 1 << k
            before = np.where(fits, at - (1 << k), 0)
            at = np.where(fits & (self.levels[k][np.minimum(before, len(self.levels[k]) - 1)] >= bound), before, at)
        return at

    def run_end(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Where the run of values of at least ``bound`` that begins at ``start`` stops; the first that is less, or n."""
        at = start.astype(np.int64).copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) <= self.n
            here = np.where(fits, at, 0)
            at = np.where(fits & (self.levels[k][here] >= bound), at + (1 << k), at)
        return at


def rebuilt_turns(rows: DataFrame, heads: int = 4, span: int = 20) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, words) of the rebuilt conversations, and (conv_id, len) of each.

    Conversation c takes the first h turns of c - c % span in place of its own first h; h = crc32(c) % heads.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        word_count(text).alias("words"))
    # copies of a row are counted before they are put in order
    counted = turns.groupBy("conv_id", "turn", "digest", "words").agg(F.count(F.lit(1)).alias("n"))
    ends = OrderedRows(counted, ["conv_id"], ["turn", "digest"]).running_sum(["n"], "end")
    turns = materialize(ends.select("conv_id", "digest", "words", F.explode(F.sequence(
        F.col("end") - F.col("n") + 1, F.col("end"))).alias("pos")), "turns")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % span).alias("origin"))
    convs = materialize(convs, "convs")
    origin = convs.select(F.col("conv_id").alias("origin"), F.col("n").alias("_on"))
    convs = convs.join(origin, "origin", "left").select(
        "conv_id", "origin", "n", "h", F.least("h", F.coalesce("_on", F.lit(0).cast("long"))).alias("m"))
    convs = materialize(convs, "convs")
    own = attach(turns.select("conv_id", "pos", "digest", "words"), convs.select("conv_id", "n", "h", "m"),
                 ["conv_id"], "n").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "digest", "words")
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("origin"), F.col("pos").alias("depth"),
                                                     "digest", "words")
    head = convs.where("m > 0").select("conv_id", "origin", "m").join(first, "origin").where("depth <= m")
    made = own.unionByName(head.select("conv_id", "depth", "digest", "words"))
    sizes = convs.select("conv_id", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("m")).alias("len"))
    return materialize(made, "rebuilt"), materialize(sizes, "sizes")


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with their place in the order ``by``, from 0; the places of a range of rows come from its own count."""
    marked = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "_m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("_m", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    out = marked.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, place)
    return out.drop("_m", "_part", "_start")


def _digits(rows: DataFrame, digit: str) -> DataFrame:
    """One string per conversation and ``RADIX`` places, from rows (conv_id, at, digit) of digits of one width."""
    grouped = rows.groupBy("conv_id", F.floor(F.col("at") / RADIX).alias("_to")).agg(
        F.array_sort(F.collect_list(F.struct("at", digit))).alias("_l"))
    return grouped.select("conv_id", F.col("_to").alias("at"), F.array_join(F.col(f"_l.{digit}"), "").alias("key"))


def sorted_conversations(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(i, conv_id, len): conversations in the order of their turns, equal ones by id."""
    longest = sizes.agg(F.max("len")).first()[0] or 0
    keys = _digits(turns.select("conv_id", (F.col("depth") - 1).alias("at"), "digest"), "digest")
    while longest > RADIX:
        keys = materialize(keys, "keys")
        distinct = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_w"))
        ranks = materialize(numbered(distinct, ["key"], "_rank"), "ranks")
        ranked = attach(keys, ranks, ["key"], "_w").select(
            "conv_id", "at", F.lpad(F.hex("_rank"), 16, "0").alias("digit"))
        keys, longest = _digits(ranked, "digit"), -(-longest // RADIX)
    whole = sizes.join(keys.select("conv_id", "key"), "conv_id", "left").withColumn(
        "key", F.coalesce("key", F.lit("")))
    return materialize(numbered(whole, ["key", "conv_id"], "i").select("i", "conv_id", "len"), "order")


def with_lcps(turns: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns by position (i, depth, words, conv_id, len, lcp, next), and the order with the LCPs on both sides of each."""
    weighted = order.withColumn("_w", F.greatest("len", F.lit(1)))
    placed = materialize(attach(turns, weighted, ["conv_id"], "_w").drop("_w"), "placed")
    before = placed.select((F.col("i") + 1).alias("i"), "depth", F.col("digest").alias("_other"))
    other = placed.select("i", "depth", "digest").join(before, ["i", "depth"], "left").groupBy("i").agg(
        F.min(F.when(~F.col("digest").eqNullSafe(F.col("_other")), F.col("depth"))).alias("_differ"))
    lcps = order.join(other, "i", "left").withColumn(
        "lcp", F.when(F.col("i") == 0, F.lit(-1)).otherwise(F.coalesce(F.col("_differ") - 1, F.col("len"))).cast("long"))
    lcps = materialize(lcps.drop("_differ"), "lcps")
    after = lcps.select((F.col("i") - 1).alias("i"), F.col("lcp").alias("next"))
    full = lcps.join(after, "i", "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long")))
    full = materialize(full.withColumn("_w", F.greatest("len", F.lit(1))), "lcps")
    beside = attach(placed.select("i", "depth", "words"), full, ["i"], "_w").drop("_w")
    return materialize(beside, "beside"), full.drop("_w")


def _packed(order: DataFrame, block: int) -> DataFrame:
    """One row per block with its LCPs, ids and their minima."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        return pd.DataFrame({"block": group["block"].iloc[:1], "lcps": [group["lcp"].to_numpy(np.int64).tobytes()],
                             "ids": [group["conv_id"].to_numpy(np.int64).tobytes()],
                             "least_lcp": [group["lcp"].min()], "least_id": [group["conv_id"].min()]})

    rows = order.select(F.floor(F.col("i") / block).alias("block"), "i", "lcp", "conv_id")
    return materialize(rows.groupBy("block").applyInPandas(
        pack, "block long, lcps binary, ids binary, least_lcp long, least_id long"), "blocks")


def _sliced(asked: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions by block and slice of depths, and each block once per slice that asks it."""
    asked = asked.withColumn("slice", F.shiftright("depth", SLICE))
    held = asked.select("block", "slice").distinct().join(packed.select("block", "lcps", "ids"), "block")
    return asked, materialize(held, "held")


def _tables(held: pd.DataFrame) -> tuple[RangeMinimum, RangeMinimum]:
    return (RangeMinimum(np.frombuffer(held["lcps"].iloc[0], np.int64)),
            RangeMinimum(np.frombuffer(held["ids"].iloc[0], np.int64)))


def extents(asked: DataFrame, order: DataFrame, total: int, block: int) -> DataFrame:
    """Each prefix (i, depth) with its members' first and last position and smallest id."""
    spark = asked.sparkSession
    packed = _packed(order, block)
    tops = packed.select("block", "least_lcp", "least_id").orderBy("block").toPandas()  # MAX_BLOCKS rows at most
    top = spark.sparkContext.broadcast((tops["least_lcp"].to_numpy(np.int64), tops["least_id"].to_numpy(np.int64)))
    questions, held = _sliced(asked.withColumn("block", F.floor(F.col("i") / block)), packed)

    def inside(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        lcps, ids = _tables(own)
        base = ask["block"].iloc[0] * block
        at, depth = ask["i"].to_numpy(np.int64) - base, ask["depth"].to_numpy(np.int64)
        start, end = lcps.run_start(at + 1, depth), lcps.run_end(at + 1, depth)
        # the run starts after the first LCP below depth, which stands at the first member itself
        left, right = start - 1, end - 1
        least = ids.least(np.maximum(left, 0), right)
        return pd.DataFrame({"block": ask["block"], "i": ask["i"], "depth": depth,
                             "left": np.where(left < 0, -1, left + base),
                             "right": np.where(end == lcps.n, -1, right + base), "least": least})

    found = questions.groupBy("block", "slice").cogroup(held.groupBy("block", "slice")).applyInPandas(
        inside, "block long, i long, depth long, left long, right long, least long")
    # the last position ends every prefix that reaches it
    last = (total - 1) // block
    found = found.withColumn("right", F.when((F.col("right") < 0) & (F.col("block") == last),
                                             F.lit(total - 1)).otherwise(F.col("right")))
    found = materialize(found, "found")

    def side(column: str, sign: int) -> DataFrame:
        return found.where(F.col(column) < 0).groupBy("block", "depth").agg(
            F.count(F.lit(1)).alias("n")).withColumn("sign", F.lit(sign))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = None
        for ask in batches:
            tables = tables or [RangeMinimum(v) for v in top.value]
            lcps, ids = tables
            home, depth = ask["block"].to_numpy(np.int64), ask["depth"].to_numpy(np.int64)
            back = ask["sign"].to_numpy() < 0
            to = np.where(back, lcps.run_start(home, depth) - 1, lcps.run_end(home + 1, depth))
            between = np.where(back, ids.least(to + 1, home - 1), ids.least(home + 1, to - 1))
            yield ask.assign(to=to, between=between)

    routed = materialize(side("left", -1).unionByName(side("right", 1)).mapInPandas(
        route, "block long, depth long, n long, sign int, to long, between long"), "routed")

    def there(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        lcps, ids = _tables(own)
        base, n = ask["block"].iloc[0] * block, lcps.n
        depth, back = ask["depth"].to_numpy(np.int64), ask["sign"].to_numpy() < 0
        whole = np.full(len(ask), n, np.int64)
        at = np.where(back, lcps.run_start(whole, depth) - 1, lcps.run_end(0 * whole, depth) - 1)
        # looking ahead, the run may stop before the block's first position
        least = np.where(back, ids.least(np.maximum(at, 0), whole - 1), ids.least(0 * whole, at))
        return pd.DataFrame({"to": ask["block"], "depth": depth, "sign": ask["sign"], "at": at + base, "least_there": least})

    asked_there, held_there = _sliced(routed.where(F.col("to") <= last).select(
        F.col("to").alias("block"), "depth", "sign").distinct(), packed)
    ends = asked_there.groupBy("block", "slice").cogroup(held_there.groupBy("block", "slice")).applyInPandas(
        there, "to long, depth long, sign int, at long, least_there long")
    answers = routed.join(ends, ["to", "depth", "sign"], "left").select(
        "block", "depth", "sign", "n", F.coalesce("at", F.lit(total - 1)).alias("at"),
        F.least("between", "least_there").alias("least"))
    answers = materialize(answers, "answers")
    for sign, tag in ((-1, "_l"), (1, "_r")):
        table = answers.where(F.col("sign") == sign).select(
            "block", "depth", F.col("n").alias(f"{tag}n"), F.col("at").alias(f"{tag}at"), F.col("least").alias(f"{tag}least"))
        found = attach(found, table, ["block", "depth"], f"{tag}n")
    # an answer belongs to the prefixes of that block and depth that reach its edge
    left, right = F.col("left") < 0, F.col("right") < 0
    return materialize(found.select(
        "i", "depth", F.when(left, F.col("_lat")).otherwise(F.col("left")).alias("left"),
        F.when(right, F.col("_rat")).otherwise(F.col("right")).alias("right"),
        F.least("least", F.when(left, F.col("_lleast")), F.when(right, F.col("_rleast"))).alias("least")), "extents")


def _ends_hash(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, from rows (left, depth, i, conv_id): (left, depth, ends_sha256)."""
    pieces = ends.groupBy("left", "depth", F.floor((F.col("i") - F.col("left")) / PIECE).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("i", F.col("conv_id").cast("string").alias("c")))).alias("_l"))
    pieces = materialize(pieces.select("left", "depth", "piece", F.array_join("_l.c", ",").alias("ids")), "pieces")
    long = pieces.where("piece = 1").select("left", "depth")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(at: tuple[int, int], state: "hashlib._Hash") -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([state.hexdigest()])],
                                              ["left", "depth", "ends_sha256"])

        now, state = None, None
        for batch in batches:
            for left, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("left", "depth", "ids")), strict=True):
                if (left, depth) != now:
                    if now is not None:
                        yield row(now, state)
                    now, state = (left, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if now is not None:
            yield row(now, state)

    several = pieces.join(long, ["left", "depth"], "left_semi").repartition("left", "depth").sortWithinPartitions(
        "left", "depth", "piece").select("left", "depth", "ids")
    short = pieces.join(long, ["left", "depth"], "left_anti").select(
        "left", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    return short.unionByName(several.mapInArrow(stream, "left long, depth long, ends_sha256 string"))


def _prefix_sums(order: DataFrame, owned: DataFrame, block: int) -> DataFrame:
    """(i, leaf, leaves, saved): leaf ends owned by position i, and the sums of leaves and savings up to it."""
    rows = order.select("i", F.floor(F.col("i") / block).alias("block"),
                        (F.col("len") > F.greatest("lcp", "next")).cast("long").alias("_one")).join(owned, "i", "left")
    rows = rows.select("i", "block", (F.col("_one") + F.coalesce("leaf", F.lit(0))).alias("leaf"),
                       F.coalesce("saved", F.lit(0)).alias("saved"))
    rows = materialize(rows, "owned")
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # MAX_BLOCKS rows at most
    blocks = rows.groupBy("block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).select(
        "block", F.coalesce(F.sum("leaf").over(earlier), F.lit(0)).alias("_leaves"),
        F.coalesce(F.sum("saved").over(earlier), F.lit(0)).alias("_saved"))
    own = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("i", "block", "leaf", F.sum("leaf").over(own).alias("leaves"), F.sum("saved").over(own).alias("saved"))
    return materialize(summed.join(F.broadcast(blocks), "block").select(
        "i", "leaf", (F.col("leaves") + F.col("_leaves")).alias("leaves"),
        (F.col("saved") + F.col("_saved")).alias("saved")), "sums")


def _at(nodes: DataFrame, sums: DataFrame, column: str, tag: str) -> DataFrame:
    """The sums at the position in ``column``, put onto the nodes however many share it."""
    wanted = nodes.groupBy(F.col(column).alias("i")).agg(F.count(F.lit(1)).alias("_w"))
    table = materialize(wanted.join(sums, "i").select(
        F.col("i").alias(column), "_w", *[F.col(c).alias(f"{tag}{c}") for c in ("leaf", "leaves", "saved")]), "sums_at")
    return attach(nodes, table, [column], "_w").drop("_w")


def prefix_trie(rows: DataFrame, heads: int = 4, span: int = 20, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text); see the module."""
    ship(rows.sparkSession)
    turns, sizes = rebuilt_turns(rows, heads, span)
    order = sorted_conversations(turns, sizes)
    total = order.count()
    block = max(block, -(-total // MAX_BLOCKS))
    beside, order = with_lcps(turns, order)
    top = F.greatest("lcp", "next")
    root = order.where("i = 0").select("i", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"),
                                       "conv_id", "len", "lcp", "next")
    nodes = beside.select(*root.columns).where("depth > lcp").unionByName(root)
    shared = materialize(nodes.where(F.col("depth") <= F.col("next")).select("i", "depth", "words"), "shared")
    links = order.where("i > 0").select("i", F.col("lcp").alias("depth"))
    spans = extents(shared.select("i", "depth").unionByName(links), order, total, block)

    # a node's parent is the prefix of one turn less around the same position
    above = spans.select("i", (F.col("depth") + 1).alias("depth"), F.col("left").alias("_pleft"),
                         F.col("least").alias("parent_conv_id"))
    known = shared.join(spans, ["i", "depth"]).withColumn("n_convs", F.col("right") - F.col("i") + 1)
    known = materialize(known.join(above, ["i", "depth"], "left"), "known")
    first = nodes.where(F.col("depth") == top + 1).select("i", "depth").join(above, ["i", "depth"], "left")
    first = materialize(first, "first")
    children = known.select("_pleft", "depth").unionByName(first.select("_pleft", "depth")).where(
        "_pleft is not null").groupBy(F.col("_pleft").alias("i"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    known = known.join(children, ["i", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = materialize(known.withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "known")

    owned = known.groupBy("i").agg(F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"), F.sum("own").alias("saved"))
    sums = _prefix_sums(order, owned, block)
    path = OrderedRows(known.withColumn("_up", -F.col("depth")), ["i"], ["_up"]).running_sum(["own"], "path")
    full = _at(_at(path, sums, "i", "_a"), sums, "right", "_b")
    ended = order.where(F.col("len") <= top).join(
        spans.select("i", F.col("depth").alias("lcp"), "left"), ["i", "lcp"], "left").select(
        F.when(F.col("len") > F.col("lcp"), F.col("i")).otherwise(F.col("left")).alias("left"),
        F.col("len").alias("depth"), "i", "conv_id")
    hashes = _ends_hash(ended).withColumnRenamed("left", "i")
    nothing = hashlib.sha256().hexdigest()
    many = full.join(hashes, ["i", "depth"], "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("_bleaves") - F.col("_aleaves") + F.col("_aleaf")).alias("n_leaves"),
        (F.col("path") + F.col("_bsaved") - F.col("_asaved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = nodes.where(F.col("depth") > top).join(
        first.select("i", "depth", F.col("parent_conv_id").alias("_above")), ["i", "depth"], "left")
    single = alone.select(
        "conv_id", "depth", F.when(F.col("depth") == top + 1, F.col("_above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(F.col("depth") == F.col("len"), _id_hash(F.col("conv_id"))).otherwise(
            F.lit(nothing)).alias("ends_sha256"))
    return many.unionByName(single)


def _id_hash(conv_id: Column) -> Column:
    return F.sha2(conv_id.cast("string").cast("binary"), 256)
