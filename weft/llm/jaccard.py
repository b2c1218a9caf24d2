"""Components of documents whose shingle sets are alike, by a grouped prefix join.

A document's set holds its distinct ``WIDTH``-word shingles (A-Z lowered); of fewer words the whole sequence counts as one
shingle, and without words the set is empty and linked with nothing. Two sets are linked when their intersection is at least
``PERCENT`` hundredths of their union. Shingles are 64-bit values.

1. Shingles are put in one order for all documents: those of frequent hash buckets last, the others by value. Two linked
   sets share a shingle among their first fifth (the prefix). Equal sets are one set from here on.
2. Sets with the same prefix and the same size are one group; the index holds each prefix shingle once per group.
3. In each shingle's list and size class, every group meets the first one there and the one before it, in an order of the
   list's own. The group pairs that pass the size and position filters are expanded to a member of each, and verified on
   the full sets after a look at their sketches, as are the members of a group against its first. Their links give first components; members of different
   components that come within ``LOOK_BACK`` places in a list meet again in ``ROUNDS`` more rounds.
4. What is left are pairs of sets in different components. All of those that share an index entry and pass the filters are
   expanded to members and verified too, so that no link between components is lost. The sketches of both sides, folded to
   one size per list and size class, are a condition of that join: a pair that they rule out is never made a row. Pairs
   inside a component need no more work: its documents are the same whichever further links it holds.

So the work is one entry per prefix shingle and group, and copies are never expanded into pairs. Rows with a null doc_id
get their set's size and no component. Rows that repeat a doc_id and a text are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import attach, components, materialize
from weft.llm.kernels import shingle_sets, text_runs

WIDTH = 5
PERCENT = 80
BUCKET_BITS = 24
#: Hash buckets of the ids whose texts are read again; their table is broadcast.
ID_BUCKETS = 1 << 20
ROUNDS = 1
LOOK_BACK = 8
#: Size classes are steps of this factor; an entry's sketch in the last join has at most this many bits.
CLASS_STEP, MOST_BITS = 1.25, 1 << 12
#: Bits of a sketch for each shingle; what two sets lack is hidden by chance in one of so many cases.
SHINGLE_BITS = 8
#: Bytes of text that a task works on at once.
RUN = 1 << 19
#: A bucket is frequent in a task when it holds this many times the mean, and this many shingles.
FREQUENT_TIMES, FREQUENT_LEAST = 4, 3
_SETS = "doc_id long, n long, sid long, sketch binary, bucket int, hits long"
_INDEX = "token long, gid long, n int, place int"


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each shingle by its low digits, ``SHINGLE_BITS`` or more per shingle."""
    size = 1 << max(6, (SHINGLE_BITS * len(shingles) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch in at most ``size`` bytes: the one that fewer bits for the same shingles would have given."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def most_common(n1: int, sketch1: bytes, n2: int, sketch2: bytes) -> int:
    """No fewer than the shingles that both sets hold: a bit that one side lacks stands for a shingle it lacks."""
    one, two = np.frombuffer(sketch1, np.uint8), np.frombuffer(sketch2, np.uint8)
    one, two = folded(one, len(two)), folded(two, len(one))
    return min(n1 - int(np.bitwise_count(one & ~two).sum()), n2 - int(np.bitwise_count(two & ~one).sum()))


class BucketHits:
    """How often each hash bucket was met: a byte per bucket, and for the few that outgrow it what is above."""

    def __init__(self) -> None:
        self.low, self.above, self.total = np.zeros(1 << BUCKET_BITS, np.uint8), {}, 0

    def add(self, buckets: np.ndarray, times: np.ndarray) -> None:
        """``buckets`` are distinct."""
        at = buckets.astype(np.int64)
        now = self.low[at] + times
        self.low[at] = (now & 255).astype(np.uint8)
        self.total += int(times.sum())
        for i in np.flatnonzero(now > 255).tolist():
            self.above[int(at[i])] = self.above.get(int(at[i]), 0) + (int(now[i]) >> 8 << 8)

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The frequent buckets and their hits."""
        limit = max(FREQUENT_LEAST, FREQUENT_TIMES * self.total / len(self.low))
        above = np.fromiter(sorted(self.above), np.int64, len(self.above))
        step = 1 << 20
        at = np.concatenate([above, *[lo + np.flatnonzero(self.low[lo:lo + step] >= limit)
                                      for lo in range(0, len(self.low), step)]])
        at = np.unique(at)
        hits = self.low[at] + np.array([self.above.get(i, 0) for i in at.tolist()], np.int64)
        return at[hits >= limit], hits[hits >= limit]


def document_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row (doc_id, n, sid, sketch); and per task and frequent bucket a row (bucket, hits)."""
    shift = np.uint64(64 - BUCKET_BITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = BucketHits()
        for batch in batches:
            sizes, ids, bits = [], [], []
            for _, _, words in text_runs(batch.column("text"), RUN):
                own = list(shingle_sets(words, width))
                sizes += map(len, own)
                ids += map(set_id, own)
                bits += map(sketch, own)
                if own:
                    hits.add(*np.unique(np.concatenate(own) >> shift, return_counts=True))
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(bits, pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())],
                ["doc_id", "n", "sid", "sketch", "bucket", "hits"])
        at, often = hits.frequent()
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(often)],
            ["doc_id", "n", "sid", "sketch", "bucket", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _SETS)


def bucket_classes(sets: DataFrame) -> np.ndarray:
    """Frequency class of each hash bucket; at most ``2**BUCKET_BITS`` rows are read."""
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in sets.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")).toLocalIterator():
        out[r["bucket"]] = min(63, r["hits"].bit_length())
    return out


def in_order(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shingles (sorted by value) in the order all documents share."""
    high = classes[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
    key = high << np.uint64(58) | shingles >> np.uint64(6)
    return shingles[np.argsort(key, kind="stable")]


def prefix_index(docs: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """Rows (token, gid, n, place) per group and prefix shingle; with place -1 the token is the id of a member set.

    A task makes the rows of a group and of a member once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups, members = sent.value, set(), set()
        for batch in batches:
            for _, _, words in text_runs(batch.column("text"), RUN):
                tokens, gids, sizes, places = [], [], [], []
                for own in shingle_sets(words, width):
                    sid = set_id(own)
                    if not len(own) or sid in members:
                        continue
                    members.add(sid)
                    first = in_order(own, held)[:prefix_length(len(own), percent)]
                    gid = group_id(first, len(own))
                    if gid in groups:
                        first = first[:0]
                    groups.add(gid)
                    tokens.append(np.append(first.view(np.int64), np.int64(sid)))
                    gids.append(np.full(len(first) + 1, gid, np.int64))
                    sizes.append(np.full(len(first) + 1, len(own), np.int32))
                    places.append(np.append(np.arange(len(first), dtype=np.int32), np.int32(-1)))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, gids, sizes, places)],
                                                     ["token", "gid", "n", "place"])

    return docs.select("text").mapInArrow(task, _INDEX)


def group_id(prefix: np.ndarray, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little",
                          signed=True)


def may_match(n1: Column, place1: Column, n2: Column, place2: Column, percent: int) -> Column:
    """Size and position filter for two entries of one list: a linked pair passes at its first common shingle."""
    sizes = (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent)
    return sizes & (F.least(n1 - place1, n2 - place2) * (100 + percent) >= (n1 + n2) * percent)


def shared_entries(index: DataFrame) -> DataFrame:
    """Entries (token, gid, n, place, class) of lists with two or more groups, and all member rows (place -1).

    Of lists with the same groups only the first in the order of shingles stays: whatever two groups share there comes before
    what they share in the others.
    """
    by_token = Window.partitionBy("token")
    ordered = by_token.orderBy("gid", "place")
    once = index.withColumn("_before", F.lag("gid").over(ordered)).where("_before is null or _before <> gid")
    marks = once.select("token", "gid", "n", "place", F.first("gid").over(ordered).alias("_least"),
                        F.max("gid").over(by_token).alias("_most"), F.count("gid").over(by_token).alias("_groups"),
                        F.bit_xor(F.xxhash64("gid")).over(by_token).alias("_all"),
                        F.first("place").over(ordered).alias("_at"))
    shared = marks.where("_least <> _most or place < 0")
    # a member row is a list of its own
    alone = F.when(F.col("place") < 0, F.col("token")).otherwise(F.lit(0))
    alike = Window.partitionBy("_least", "_most", "_groups", "_all", "_alone").orderBy("_at", "token")
    first = shared.withColumn("_alone", alone).withColumn("_turn", F.dense_rank().over(alike)).where("_turn = 1")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(CLASS_STEP))).cast("int")
    return first.select("token", "gid", "n", "place", size_class.alias("class"))


def neighbours(lists: DataFrame) -> DataFrame:
    """Each entry with the first one of its list and size class and the one before it, in an order of the list's own."""
    in_class = Window.partitionBy("token", "class").orderBy(F.xxhash64("token", "gid"), "gid", "place")
    entry = F.struct("gid", "n", "place")
    return lists.select("gid", "n", "place", F.first(entry).over(in_class).alias("first"),
                        F.lag(entry).over(in_class).alias("before"))


def fetch_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The sets (sid, shingles) of the documents with these doc_ids.

    A table of at most ``ID_BUCKETS`` hash buckets of the ids goes out first, so that few other texts are shuffled.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in text_runs(batch.column("text"), RUN):
                own = list(shingle_sets(words, width))
                yield pa.record_batch({"sid": pa.array(map(set_id, own), pa.int64()),
                                       "shingles": pa.array([x.tobytes() for x in own], pa.binary())})

    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS))
    buckets = ids.select(bucket.alias("_b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(buckets), bucket == F.col("_b"), "left_semi").join(ids, "doc_id", "left_semi")
    # a repeated doc_id may bring other sets and equal ones
    made = texts.select("text").mapInArrow(make, "sid long, shingles binary")
    return materialize(made.dropDuplicates(["sid"]), "shingles")


class Verifier:
    """Verifies pairs of sets; a set is made from its text when a pair first needs it."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> None:
        self.docs, self.reps, self.width, self.percent = docs, reps, width, percent
        self.sets: DataFrame | None = None

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of set ids that are linked: what the sketches leave is compared on the full sets."""
        percent = self.percent

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.zeros(batch.num_rows, bool)
                sides = (batch.column(c).to_pylist() for c in ("n1", "x", "n2", "y"))
                for i, (n1, x, n2, y) in enumerate(zip(*sides, strict=True)):
                    stay[i] = most_common(n1, x, n2, y) * (100 + percent) >= percent * (n1 + n2)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(stay))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                    one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(one, two, True))
                    linked[i] = 100 * both >= percent * (len(one) + len(two) - both)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                    pa.array(linked))

        x = self.reps.select(F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("x"))
        y = self.reps.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("y"))
        pairs = materialize(pairs.distinct().join(y, "b").join(x, "a").select("a", "n1", "x", "b", "n2", "y").mapInArrow(
            possible, "a long, b long"), "pairs")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        if self.sets is not None:
            needed = needed.join(self.sets, "sid", "left_anti")
        ids = needed.join(self.reps.select("sid", "rep"), "sid").select(F.col("rep").alias("doc_id")).distinct()
        ids = materialize(ids, "needed")
        if self.sets is None:
            self.sets = fetch_sets(ids, self.docs, self.width)
        elif ids.limit(1).count():
            more = fetch_sets(ids, self.docs, self.width)
            self.sets = self.sets.unionByName(more.join(self.sets, "sid", "left_anti"))
        x = self.sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
        y = self.sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
        rows = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
        return materialize(rows.mapInArrow(compare, "a long, b long"), "linked")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, root) after more links."""
    if labels is None:
        return components(links)
    if not links.limit(1).count():
        return labels
    named = links
    for c in ("a", "b"):
        part = labels.select(F.col("node").alias(c), F.col("root").alias("_root"))
        named = named.join(part, c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    over = components(named)
    moved = labels.join(over.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select(
        "node", F.coalesce("_to", "root").alias("root"))
    return materialize(moved.unionByName(over.join(labels, "node", "left_anti").select("node", "root")), "labels")


def open_lists(lists: DataFrame, members: DataFrame, heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries (token, class, n, place, sid, part) of the lists that hold more than one component, with their members."""
    labeled = members.join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left").select(
        "gid", "sid", "size", F.coalesce("root", "sid").alias("part"))
    entries = lists.select("token", "gid", "n", "place", "class").join(labeled, "gid")
    # a group's own members meet in a list of their own
    own = labeled.join(heads.where("members > 1").select("gid"), "gid", "left_semi").select(
        "gid", F.col("gid").alias("token"), F.col("size").alias("n"), F.lit(0).alias("place"), F.lit(-1).alias("class"),
        "sid", "size", "part")
    by_list = Window.partitionBy("token")
    both = entries.unionByName(own).withColumn("_least", F.min("part").over(by_list)).withColumn(
        "_most", F.max("part").over(by_list)).where("_least <> _most")
    return materialize(both.select("token", "n", "place", "class", "sid", "part"), "open")


def class_bits(size_class: int, n: int) -> int:
    """Bits of a sketch in a list's size class: no more than the sketches of this class and of the one below have."""
    least = n if size_class < 0 else int(CLASS_STEP ** (size_class - 1))
    return min(MOST_BITS, 1 << max(6, (SHINGLE_BITS * least - 1).bit_length()))


def with_bits(entries: DataFrame) -> DataFrame:
    """Entries with their sketch as ``bits``, of one length for all entries of a list and class."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("class", "n", "sketch"))
            bits = [folded(np.frombuffer(x, np.uint8), class_bits(c, n) // 8).view(np.int64) for c, n, x in zip(*sides, strict=True)]
            rest = [c for c in batch.schema.names if c != "sketch"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(bits, pa.list_(pa.int64()))],
                                             [*rest, "bits"])

    schema = "token long, class int, n int, place int, sid long, part long, bits array<long>"
    return entries.select("token", "class", "n", "place", "sid", "part", "sketch").mapInArrow(task, schema)


def sketches_allow(n1: Column, bits1: Column, n2: Column, bits2: Column, percent: int) -> Column:
    """``most_common`` as a condition; true where the lengths differ."""

    def lacks(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0),
                           lambda total, one: total + one)

    most = F.least(n1 - lacks(bits1, bits2), n2 - lacks(bits2, bits1))
    return F.coalesce(most * (100 + percent) >= (n1 + n2) * percent, F.lit(True))


def meetings(left: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of open entries of different components that pass the filters and the sketches."""
    left = materialize(left.join(reps.select("sid", "sketch"), "sid"), "sketched")
    wide = with_bits(left.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1))))
    wide = wide.select("token", "class", *[F.col(c).alias(f"{c}1") for c in ("n", "place", "sid", "part", "bits")])
    # the larger one is in the same size class or the next; equal classes meet twice
    met = wide.join(with_bits(left), ["token", "class"]).where(
        (F.col("part1") != F.col("part")) & may_match(F.col("n1"), F.col("place1"), F.col("n"), F.col("place"), percent)
        & sketches_allow(F.col("n1"), F.col("bits1"), F.col("n"), F.col("bits"), percent))
    return met.select(F.least("sid1", "sid").alias("a"), F.greatest("sid1", "sid").alias("b"))


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    ``rounds`` of meetings between components come before the last step; they decide how much that has to do.
    """
    sets = materialize(document_sets(docs, width), "sets")
    rows = sets.where("bucket is null").select("doc_id", "n", "sid")
    entries = materialize(shared_entries(prefix_index(docs, bucket_classes(sets), width, percent)), "entries")
    members = entries.where("place < 0").select("gid", F.col("token").alias("sid"), F.col("n").alias("size")).distinct()
    members = materialize(members, "members")
    heads = materialize(members.groupBy("gid").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("members")), "heads")
    reps = materialize(sets.where("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch")), "reps")
    verifier = Verifier(docs, reps, width, percent)

    # every group against two of its size class in each list, every member against its group's first
    lists = entries.where("place >= 0")
    near = neighbours(lists).select("gid", "n", "place", F.explode(F.array("first", "before")).alias("other")).where(
        (F.col("other.gid") != F.col("gid")) & may_match(F.col("n"), F.col("place"), F.col("other.n"), F.col("other.place"),
                                                         percent))
    near = near.select(F.least("gid", "other.gid").alias("g"), F.greatest("gid", "other.gid").alias("h")).distinct()
    near = near.join(heads.select(F.col("gid").alias("g"), F.col("head").alias("a")), "g").join(
        heads.select(F.col("gid").alias("h"), F.col("head").alias("b")), "h").select("a", "b")
    inside = members.join(heads.where("members > 1"), "gid").where("sid <> head").select(
        F.col("sid").alias("a"), F.col("head").alias("b"))
    labels = merged(None, verifier.linked(near.unionByName(inside)))

    # members of different components that come close in an order by chance
    for turn in range(rounds):
        left = open_lists(lists, members, heads, labels)
        chance = Window.partitionBy("token").orderBy("class", F.xxhash64(F.lit(turn), "token", "sid"), "sid")
        seen = F.collect_list(F.struct("sid", "part", "n", "place")).over(chance.rowsBetween(-LOOK_BACK, -1))
        others = F.filter(seen, lambda o: (o["part"] != F.col("part")) & may_match(
            F.col("n"), F.col("place"), o["n"], o["place"], percent))
        met = left.select("sid", others.alias("others")).select("sid", F.explode("others").alias("other"))
        links = verifier.linked(met.select(F.least("sid", "other.sid").alias("a"), F.greatest("sid", "other.sid").alias("b")))
        labels = merged(labels, links)

    # all pairs between components that may match
    left = open_lists(lists, members, heads, labels)
    labels = merged(labels, verifier.linked(meetings(left, reps, percent)))

    table = reps.join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left").select(
        "sid", "rep", "rows", F.coalesce("root", "sid").alias("part"))
    table = materialize(table, "parts")
    parts = table.groupBy("part").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("part_rows"))
    parts = materialize(attach(table, materialize(parts, "ids"), ["part"], "part_rows").select(
        "sid", "rows", "component_id"), "components")
    out = attach(rows, parts, ["sid"], "rows")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
