"""Mixing sources to target weights by pivotal rounding, with DataFrame functions only.

A source with target ``t`` and size ``s`` words should give each of its documents ``t / s`` times: its whole part for
certain, the rest as a probability. Probabilities meet in pairs and words move from one to the other, at random and
fairly, until one of the two is 0 or 1; what the pair holds together, in words, stays the same. The one that is left over
meets the next. Documents are dealt into blocks of about ``BLOCK``; each block folds to one leftover, ``BLOCK``
leftovers to one of the next level, and so on to one per source. About ``CLOSING`` documents of each source, chosen by
hash, wait outside the tree: the leftover meets all of them as one partner, then the largest meets the rest, and so on
down to the smallest, which alone is rounded by itself. So a source's words miss the target by about its smallest
document, or by less than one document where fewer words than it holds are to be left out or added in all; and each document
has exactly its chance.

A source of few documents can still miss by much. Where it does by more than ``TOLERANCE`` of its target, about ``NEARER`` of
its documents, chosen by hash, give and take whole copies (0 to ``most`` of each): up to ``EXCHANGES`` times the one change, or the
two together, that bring the sum of words nearest to the target; once from the rounding, and once from each number of copies that the
longest of them can have. There, and only there, chances are not kept exactly.

The randomness is a hash of the document and the level: reruns agree. Rows that repeat doc_id, source and size are one
document with their words added up, and are all taken alike. Documents without words are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import attach, materialize, same

#: Words are runs of anything but the six white bytes.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
CLOSING = 512
NEARER = 64
EXCHANGES = 4
TOLERANCE = 0.005
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
_UNIT = float(1 << 53)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Targets from (source, source_size): weights by code point of the source, null last, repeating.

    Sharing ``share`` of all words by weight, stopping sources at ``most`` times their size and sharing the excess again
    ends at one level: ``least(most * size, level * weight)``. Sources sorted by the level at which they stop give it with
    two running sums. One row per source goes through these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    capped = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    stops = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    after = stops.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    leveled = capped.withColumn("_level", level)
    free = F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct(F.row_number().over(stops), "_level"))
    first = F.min(F.col("_free")).over(Window.partitionBy())["_level"]
    out = leveled.withColumn("_free", free).withColumn("_at", first)
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w")))
    return out.select("source", "source_size", target.alias("target"), *[
        c for c in sources.columns if c not in ("source", "source_size")])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _meet(state: Column, new: Column) -> Column:
    """The leftover ``state.left`` meets ``new``: words move until one of both is settled."""
    old = state["left"]

    def moved(give: Column) -> Column:
        # give.up: the old one gains give.a words and the new one loses them; else the other way round with give.b
        old_p = (F.when(give["up"] & (give["a"] >= give["old_room"]), F.lit(1.0))
                 .when(give["up"], old["p"] + give["a"] / old["w"])
                 .when(give["b"] >= give["old_has"], F.lit(0.0)).otherwise(old["p"] - give["b"] / old["w"]))
        new_p = (F.when(give["up"] & (give["a"] >= give["new_has"]), F.lit(0.0))
                 .when(give["up"], new["p"] - give["a"] / new["w"])
                 .when(give["b"] >= give["new_room"], F.lit(1.0)).otherwise(new["p"] + give["b"] / new["w"]))
        return F.struct(old_p.alias("old"), new_p.alias("new"))

    def settled(p: Column) -> Column:
        open_old = (p["old"] > 0) & (p["old"] < 1)
        open_new = (p["new"] > 0) & (p["new"] < 1)
        empty = old.withField("w", F.lit(0.0))
        left = F.when(open_old, old.withField("p", p["old"])).when(
            open_new, new.withField("p", p["new"])).otherwise(empty)
        done = F.concat(F.when(open_old, F.array().cast(_done_type)).otherwise(F.array(F.struct(
            old["id"].alias("id"), p["old"].alias("v")))).cast(_done_type),
            F.when(open_new & ~open_old, F.array().cast(_done_type)).otherwise(F.array(F.struct(
                new["id"].alias("id"), p["new"].alias("v")))).cast(_done_type))
        return F.struct(left.alias("left"), F.concat(state["done"], done).alias("done"))

    old_has, old_room = old["w"] * old["p"], old["w"] * (1 - old["p"])
    new_has, new_room = new["w"] * new["p"], new["w"] * (1 - new["p"])
    a, b = F.least(old_room, new_has), F.least(old_has, new_room)
    give = F.struct(a.alias("a"), b.alias("b"), old_has.alias("old_has"), old_room.alias("old_room"),
                    new_has.alias("new_has"), new_room.alias("new_room"), (new["u"] * (a + b) < b).alias("up"))
    met = _let(_let(give, moved), settled)
    first = F.struct(new.alias("left"), state["done"].alias("done"))
    return F.when(old["w"] > 0, met).otherwise(first)


_id_type = "struct<block:bigint,doc_id:bigint,size:bigint,n:bigint>"
_done_type = f"array<struct<id:{_id_type},v:double>>"
_one_type = f"struct<u:double,w:double,p:double,id:{_id_type}>"


def _uniform(seed: int, level: int, *columns: Column) -> Column:
    h = F.xxhash64(F.lit(seed), F.lit(level), *columns)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(_UNIT)


def _against_the_rest(state: Column, one: Column) -> Column:
    """One document, or the tree's leftover, meets all that come after it, which share the chance ``state.q``."""
    rest = F.when(one["left"], state["g"]).otherwise(F.greatest(state["g"] - one["w"], F.lit(0.0)))
    chance = F.when(one["left"], one["p"]).otherwise(state["q"])

    def split(x: Column) -> Column:
        has, room = one["w"] * x["p"], one["w"] * (1 - x["p"])
        a, b = F.least(room, x["g"] * state["q"]), F.least(has, x["g"] * (1 - state["q"]))
        return F.struct(a.alias("a"), b.alias("b"), has.alias("has"), room.alias("room"), x["p"].alias("p"),
                        x["g"].alias("g"), (one["u"] * (a + b) < b).alias("up"))

    def end(x: Column) -> Column:
        moved = F.when(x["up"], x["a"]).otherwise(-x["b"])
        p = F.when(x["up"] & (x["a"] >= x["room"]), F.lit(1.0)).when(
            ~x["up"] & (x["b"] >= x["has"]), F.lit(0.0)).otherwise(x["p"] + moved / one["w"])
        q = F.when(x["g"] > 0, F.least(F.greatest(state["q"] - moved / x["g"], F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        done = F.struct(one["left"].alias("left"), one["id"].alias("id"),
                        (one["u2"] < p).cast("double").alias("v"))
        return F.struct(q.alias("q"), x["g"].alias("g"), F.concat(state["done"], F.array(done)).alias("done"))

    return _let(_let(F.struct(chance.alias("p"), rest.alias("g")), split), end)


def _close(closing: DataFrame, left: DataFrame, seed: int) -> DataFrame:
    """Settles the waiting documents (source, p, one) and each source's leftover: (source, left, id, v)."""
    columns = [F.col("one")["w"].alias("w"), F.col("one")["p"].alias("p"), F.col("one")["id"].alias("id")]
    rows = closing.select("source", F.lit(False).alias("left"), *columns).unionByName(
        left.select("source", F.lit(True).alias("left"), *[F.col("left")[c].alias(c) for c in ("w", "p", "id")]))
    u = [_uniform(seed, level, F.col("source"), F.col("id")).alias(n) for level, n in ((-1, "u"), (-2, "u2"))]
    ones = rows.select("source", F.struct((~F.col("left")).alias("order"), (-F.col("w")).alias("size"), *u, "left", "w",
                                          "p", "id").alias("one"))
    grouped = ones.groupBy("source").agg(
        F.sort_array(F.collect_list("one")).alias("all"),
        F.sum(F.when(~F.col("one")["left"], F.col("one")["w"])).alias("g"),
        F.max(F.when(~F.col("one")["left"], F.col("one")["p"])).alias("q"))
    empty = F.struct(F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("g", F.lit(0.0)).alias("g"),
                     F.array().cast(f"array<struct<left:boolean,id:{_id_type},v:double>>").alias("done"))
    closed = grouped.select("source", F.aggregate("all", empty, _against_the_rest, lambda x: x["done"]).alias("done"))
    return closed.select("source", F.explode("done").alias("d")).select("source", "d.left", "d.id", "d.v")


def _settle(items: DataFrame, closing: DataFrame, level: int, levels: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """0 or 1 for every item of (source, parent, one): (source, id, v); the same for the closing documents."""
    empty = F.struct(F.struct(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(None).cast(_id_type)).cast(_one_type).alias("left"),
                     F.array().cast(_done_type).alias("done"))
    folded = items.groupBy("source", "parent").agg(F.sort_array(F.collect_list("one")).alias("all")).select(
        "source", "parent", F.aggregate("all", empty, _meet).alias("f"))
    folded = materialize(folded.select("source", "parent", "f.left", "f.done"), f"mix{level}")
    done = folded.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.v")
    left = folded.where(F.col("left")["w"] > 0).select("source", "parent", "left")
    if level == levels:
        closed = materialize(_close(closing, left, seed), "closed")
        return (done.unionByName(closed.where("left").select("source", "id", "v")),
                closed.where("not left").select("source", "id", "v"))
    up = left.select("source", F.shiftright("parent", 6).alias("parent"), F.struct(
        _uniform(seed, level + 1, F.col("source"), F.col("parent")).alias("u"), F.col("left")["w"].alias("w"),
        F.col("left")["p"].alias("p"), F.struct(
            F.col("parent").alias("block"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("size"),
            F.lit(0).cast("long").alias("n")).alias("id")).cast(_one_type).alias("one"))
    upper, closed = _settle(up, closing, level + 1, levels, seed)
    upper = upper.select(F.col("source").alias("_s"), F.col("id")["block"].alias("_b"), "v")
    back = left.join(upper, same([F.col("source")], [F.col("_s")]) & (F.col("parent") == F.col("_b")))
    return done.unionByName(back.select("source", F.col("left")["id"].alias("id"), "v")), closed


def _nearer(state: Column, most: int) -> Column:
    """The change of one document's copies, or of two documents', after which ``state.r`` words are missing least."""
    options = F.array(*[F.lit(d) for d in range(-most, most + 1) if d])

    def changes(items: Column) -> Column:
        own = F.transform(items, lambda x, i: F.transform(
            F.filter(options, lambda d: (x["c"] + d >= 0) & (x["c"] + d <= most)),
            lambda d: F.struct(i.alias("i"), d.alias("d"), (d * x["w"]).alias("a"))))
        return F.flatten(own)

    def outcome(r: Column, number: int, x: Column | None = None, y: Column | None = None) -> Column:
        none = F.lit(-1), F.lit(0)
        (xi, xd), (yi, yd) = ((v["i"], v["d"]) if v is not None else none for v in (x, y))
        return F.struct(F.abs(r).alias("miss"), F.lit(number).alias("number"), xi.alias("i"), xd.alias("d"), yi.alias("j"),
                        yd.alias("e"), r.alias("r"))

    def best(all_: Column) -> Column:
        alone = F.transform(all_, lambda x: outcome(state["r"] - x["a"], 1, x))
        both = F.transform(all_, lambda x: F.array_min(F.transform(
            F.filter(all_, lambda y: y["i"] > x["i"]), lambda y: outcome(state["r"] - x["a"] - y["a"], 2, x, y))))
        return F.array_min(F.concat(F.array(outcome(state["r"], 0)), alone, F.filter(both, lambda b: b.isNotNull())))

    def applied(b: Column) -> Column:
        items = F.transform(state["items"], lambda x, i: x.withField("c", x["c"] + F.when(i == b["i"], b["d"]).when(
            i == b["j"], b["e"]).otherwise(0)))
        return F.struct(b["r"].alias("r"), items.alias("items"))

    return _let(_let(changes(state["items"]), best), applied)


def _exchange(mixed: DataFrame, most: float, seed: int) -> DataFrame:
    """Copies of documents of sources that miss their target by more than ``TOLERANCE``: (source, doc_id, size, c)."""
    missing = mixed.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("n") * F.col("copies"))).alias("r"),
                                          F.first("target").alias("_t"))
    missing = missing.where(F.abs("r") > F.col("_t") * F.lit(TOLERANCE)).select(F.col("source").alias("_s"), "r")
    u = _uniform(seed, -4, F.col("doc_id"), F.col("size"))
    given = mixed.where((F.col("size") > 0) & (u * F.col("atoms") < NEARER)).groupBy("source").agg(F.sort_array(F.collect_list(
        F.struct(u.alias("u"), "doc_id", "size", (F.col("size") * F.col("n")).cast("double").alias("w"),
                 F.col("copies").cast("int").alias("c")))).alias("items"))
    both = given.join(missing, same([F.col("source")], [F.col("_s")]))
    # small steps cannot get past one document that outweighs the others: they also start from each of its numbers of copies
    weights = F.transform("items", lambda x: x["w"])
    both = both.withColumn("at", F.array_position(weights, F.array_max(weights)).cast("int") - 1)

    def start(q: Column) -> Column:
        held = F.get("items", F.col("at"))
        items = F.transform("items", lambda x, i: x.withField("c", F.when((i == F.col("at")) & (q >= 0), q).otherwise(x["c"])))
        return F.struct(F.when(q < 0, F.col("r")).otherwise(F.col("r") - (q - held["c"]) * held["w"]).alias("r"),
                        items.alias("items"))

    def run(state: Column) -> Column:
        done = F.aggregate(F.sequence(F.lit(1), F.lit(EXCHANGES)), state, lambda s, _: _nearer(s, int(most)))
        return _let(done, lambda e: F.struct(F.abs(e["r"]).alias("miss"), e["items"].alias("items")))

    ended = F.array_min(F.transform(F.transform(F.sequence(F.lit(-1), F.lit(int(most))), start), run))
    rows = both.select("source", F.explode(F.arrays_zip(F.col("items"), ended["items"].alias("after"))).alias("x"))
    changed = rows.where(F.col("x")["items"]["c"] != F.col("x")["after"]["c"])
    return changed.select("source", *[F.col("x")["after"][c].alias(c) for c in ("doc_id", "size", "c")])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                seed: int = 1) -> DataFrame:
    """Copies of each document from rows (doc_id, source, text).

    One row per (doc_id, source, size) that occurs, with n rows of it: copies is how often each is to be taken.
    """
    sized = docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"))
    atoms = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sized")
    sources = atoms.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                          F.count(F.lit(1)).alias("atoms"))
    sources = source_targets(materialize(sources, "sources"), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-12).cast("long")
    sources = materialize(sources.select("*", whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("p")),
                          "targets")
    most_atoms = sources.agg(F.max("atoms")).first()[0] or 0
    levels, blocks = 0, -(-most_atoms // BLOCK)
    while blocks > 1:
        levels, blocks = levels + 1, -(-blocks // BLOCK)
    planned = materialize(attach(atoms, sources, ["source"], "atoms"), "planned")
    chance = planned.where((F.col("size") > 0) & (F.col("p") > 1e-12))
    parent = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.ceil(F.col("atoms") / F.lit(BLOCK)))
    waits = _uniform(seed, -3, F.col("doc_id"), F.col("size")) * F.col("atoms") < CLOSING
    items = chance.select("source", waits.alias("waits"), parent.cast("long").alias("parent"), F.struct(
        _uniform(seed, 0, F.col("doc_id"), F.col("source"), F.col("size")).alias("u"),
        (F.col("size") * F.col("n")).cast("double").alias("w"), F.col("p"),
        F.struct(F.lit(0).cast("long").alias("block"), "doc_id", "size", "n").alias("id")).cast(_one_type).alias("one"))
    tree, closed = _settle(items.where("not waits"), items.where("waits"), 0, levels, seed)
    settled = tree.unionByName(closed).select(
        F.col("source").alias("_s"), F.col("id")["doc_id"].alias("_d"), F.col("id")["size"].alias("_z"), "v")
    out = planned.join(settled, same([F.col(c) for c in ("source", "doc_id", "size")],
                                     [F.col(c) for c in ("_s", "_d", "_z")]), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("v", F.lit(0.0)).cast("long")).otherwise(F.lit(0))
    mixed = materialize(out.select("doc_id", "source", "size", "n", "source_size", "target", "atoms",
                                   copies.cast("long").alias("copies")), "mixed")
    changed = _exchange(mixed, most, seed).select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"),
                                                  F.col("size").alias("_z"), F.col("c").cast("long").alias("_c"))
    final = mixed.join(materialize(changed, "exchanged"), same([F.col(c) for c in ("source", "doc_id", "size")],
                                                               [F.col(c) for c in ("_s", "_d", "_z")]), "left")
    return final.select("doc_id", "source", "size", "n", "source_size", "target", F.coalesce("_c", "copies").alias("copies"))
