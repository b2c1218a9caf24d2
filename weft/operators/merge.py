"""Relation-driven merging of side tables into the main table.

Relations are followed along paths, and a column's name and lineage belong to the path that leads to it. A table that is met
on several paths (two relations to it, or a diamond) is computed once and joined once per path; only then do its
columns carry the whole path in their names.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.aggregate import (
    PIECE_ROWS,
    cat_last,
    cat_union_length,
    cat_union_pieces,
    fresh_length,
    is_list,
    joined_pieces,
    list_last,
    list_union_length,
    list_union_pieces,
    num_aggs,
    pieces_by_key,
    side_columns,
    whole_text,
)
from weft.operators.asof import asof_join
from weft.operators.clean import clean_fill
from weft.operators.skew import BROADCAST_KEYS, HOT_ROWS, KeyProfile, attach, has_null_key, is_small, key_profiles, same_keys
from weft.sources.tables import (
    CAT,
    MULTI_CAT,
    NUM,
    TIME,
    Relation,
    TableSet,
    columns_of,
    is_key,
    kind_of,
    origin_of,
    path_of,
    retag,
    table_of,
    tagged,
)
from weft.sources.workspace import materialize


@dataclass(frozen=True)
class Lineage:
    """Where a side column is from: its table, the path to it from the rows it is put on, and its name's two parts."""

    table: str
    path: str
    label: str
    base: str

    @property
    def name(self) -> str:
        return f"{self.label}__{self.base}"

    def of(self, fn: str) -> str:
        """The name of an aggregate of the column."""
        return f"{self.label}__{fn}__{self.base}"


def _lineage(df: DataFrame, column: str, table: str, step: str | None = None) -> Lineage:
    """Lineage of a side column on the merged rows.

    With ``step``, the relation by which the side table is joined, names have the path in front; without, the source table.
    """
    source, inner = table_of(df, column) or table, path_of(df, column)
    if step is None:
        base = column[len(source) + 2:] if column.startswith(f"{source}__") else column
        return Lineage(source, "", source if column.startswith(f"{source}__") else table, base)
    path = f"{step}/{inner}" if inner else step
    base = column[len(_label(inner)) + 2:] if inner else column
    return Lineage(source, path, _label(path), base)


def _label(path: str) -> str:
    return path.replace("/", "__")


def require_unique(df: DataFrame, keys: Sequence[str], name: str) -> None:
    """Raise if a to-one side repeats a key, which would repeat main rows."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"to-one table {name!r} repeats the key {repeated[0].asDict()}")


def join_to_one(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
                table: str, *, check_unique: bool = False, spread: Sequence[str] | None = None,
                broadcast_keys: int = BROADCAST_KEYS, hot_rows: int = HOT_ROWS, step: str | None = None,
                carry: Sequence[Column] = (), measured: DataFrame | None = None) -> DataFrame:
    """Left equi-join of a table with one row per key; its typed columns get the table's name in front, or the path
    that begins with ``step``. ``carry`` has columns that come along as they are. ``measured`` has the keys as ``left``
    has them and is read for hot ones in its place, where ``left`` is dear to compute.

    A small table is broadcast. A larger one is shuffled with the heavy left keys salted.
    """
    if check_unique:
        require_unique(right, right_keys, table)
    names = {c: _lineage(right, c, table, step) for c in columns_of(right) if c not in right_keys}
    side = right.select(
        *[F.col(k).alias(f"_right{i}") for i, k in enumerate(right_keys)], *carry,
        *[tagged(F.col(c), n.name, kind_of(right, c), n.table, is_key(right, c), origin_of(right, c), n.path)
          for c, n in names.items()])
    small = is_small(right, broadcast_keys)
    profile = KeyProfile(0) if small else _large(measured or left, left_keys, broadcast_keys, hot_rows)
    return attach(left, side, list(left_keys), profile, broadcast_keys=broadcast_keys,
                  null_keys=small or has_null_key(right, right_keys),
                  table_keys=[f"_right{i}" for i in range(len(right_keys))], spread=spread)


def _large(left: DataFrame, keys: Sequence[str], broadcast_keys: int, hot_rows: int) -> KeyProfile:
    """The profile for a table too large, or not known to be small enough, to broadcast."""
    return KeyProfile(broadcast_keys + 1, key_profiles(left, [keys], hot_rows)[tuple(keys)].hot)


@dataclass(frozen=True)
class UnionPieces:
    """The texts of a union column in numbered pieces: ``table`` has (``_u0``, .., piece, text), and ``keys`` are the columns
    of the rows that the ``_u`` columns match. Without ``null_keys`` no ``_u`` is null."""

    keys: tuple[str, ...]
    table: DataFrame
    null_keys: bool = True

    def of(self, rows: DataFrame, row_id: str) -> DataFrame:
        """(row_id, piece, text) of all rows; the pieces of a row in order are its whole union."""
        asked = rows.select(row_id, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        sides = [[F.col(f"{s}{i}") for i in range(len(self.keys))] for s in ("_k", "_u")]
        on = same_keys(*sides) if self.null_keys else [a == b for a, b in zip(*sides, strict=True)]
        return asked.join(self.table, on).select(row_id, "piece", "text")


@dataclass(frozen=True)
class Merged:
    """Merged rows, and the pieces of their union columns by column name."""

    rows: DataFrame
    unions: dict[str, UnionPieces]


def aggregate_side(right: DataFrame, keys: Sequence[str], table: str, order: Sequence[str],
                   unions: str = "length", last: bool = True, times: bool = False, *, step: str | None = None) -> DataFrame:
    """One row per key of a to-many table: numeric mean and sum, category and list "last" and union.

    The key itself is not aggregated, and times only with ``times`` (their first and last). ``unions``
    chooses what a union becomes: ``"length"`` (its number of characters, all that the later features use,
    without building the text), ``"text"`` (one cell per key; see ``whole_text``), ``"pieces"`` (see
    ``aggregate_with_unions``) or ``"none"``.
    """
    return aggregate_with_unions(right, keys, table, order, unions, last, times, step=step)[0]


def aggregate_with_unions(right: DataFrame, keys: Sequence[str], table: str, order: Sequence[str], unions: str = "pieces",
                          last: bool = True, times: bool = False, *, step: str | None = None,
                          nested: Mapping[str, UnionPieces] | None = None, piece_rows: int = PIECE_ROWS,
                          hot_rows: int = HOT_ROWS,
                          measured: DataFrame | None = None) -> tuple[DataFrame, dict[str, UnionPieces]]:
    """``aggregate_side`` and the pieces of its union columns.

    With lengths or pieces the rows move once, as they are: buffers of "last" texts made before the shuffle are
    larger than the rows, and the distinct values of all columns are found where the rows of a key meet. Rows of
    hot keys (``hot_rows`` and more, looked for in ``measured``, see ``join_to_one``) are aggregated in two steps,
    so that no task gets a whole hot key.

    A union column holds the first piece of its text, and ``union_pieces`` the number of pieces. ``nested`` has
    the pieces of list columns of ``right`` that are unions themselves: they take part with their whole texts, and the "last"
    of one keeps the link to its pieces, in columns without a type.
    """
    if unions not in ("length", "text", "pieces", "none"):
        raise ValueError(f"unknown union form {unions!r}")
    nested = nested or {}
    cols = side_columns(right, keys)
    name = {c: _lineage(right, c, table, step) for cs in cols.values() for c in cs}
    aggs: list[Column] = []
    meta: dict[str, tuple[str, Lineage, str]] = {}
    pieces: dict[str, UnionPieces] = {}

    def add(kind: str, c: str, fn: str, agg: Column | None = None) -> str:
        meta[name[c].of(fn)] = (kind, name[c], fn)
        if agg is not None:
            aggs.append(agg.alias(name[c].of(fn)))
        return name[c].of(fn)

    for fn in ("mean", "sum"):
        for c in cols[NUM]:
            add(NUM, c, fn, num_aggs([c], [fn])[0])
    if last:
        for c in cols[CAT]:
            add(CAT, c, "last", cat_last(c, order))
        for c in cols[MULTI_CAT]:
            made = add(MULTI_CAT, c, "last", list_last(c, order))
            if c in nested:
                links = [f"_last{len(aggs)}_{i}" for i in range(len(nested[c].keys))]
                latest = F.max_by(F.struct(*nested[c].keys), F.when(is_list(F.col(c)), F.struct(*order, c)))
                aggs += [latest[k].alias(n) for k, n in zip(nested[c].keys, links, strict=True)]
                pieces[made] = replace(nested[c], keys=tuple(links))
    if times:
        for c in (c for c in columns_of(right, TIME) if c not in keys):
            name[c] = _lineage(right, c, table, step)
            add(TIME, c, "first", F.min(c))
            add(TIME, c, "latest", F.max(c))
    if unions == "length":
        for c in cols[MULTI_CAT]:
            add(NUM, c, "union_length", list_union_length(c))
    lengths = {c: add(NUM, c, "union_length") for c in cols[CAT]} if unions == "length" else {}
    extra = [n for p in pieces.values() for n in p.keys]

    def in_steps(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_side_rows"), *aggs).drop("_side_rows")
        if not lengths:
            return out
        # All category unions from one table of distinct (key, column, value) rows.
        values = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in lengths])
        pairs = rows.select(*keys, F.explode(values).alias("p")).select(*keys, "p.c", "p.v").distinct()
        return _join_aggregates(out, pairs.groupBy(*keys).agg(*[cat_union_length(c).alias(n) for c, n in lengths.items()]), keys)

    def at_once(rows: DataFrame) -> DataFrame:
        met = rows.repartition(*keys)
        for i, c in enumerate(lengths):
            same = Window.partitionBy(*keys, F.col(c).cast("string")).orderBy(*keys)
            met = met.withColumn(f"_fresh{i}", F.row_number().over(same) == 1)
        return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_side_rows"), *aggs, *[
            fresh_length(c, f"_fresh{i}").alias(n) for i, (c, n) in enumerate(lengths.items())]).drop("_side_rows")

    if unions in ("length", "pieces"):
        cold, heavy, n_rows = _by_heat(right, keys, hot_rows, measured)
        table_out = at_once(cold) if heavy is None else at_once(cold).unionByName(in_steps(heavy))
    else:
        table_out = in_steps(right)

    if unions == "text":
        for c in cols[CAT]:
            text = whole_text(cat_union_pieces(right, keys, c), keys, add(MULTI_CAT, c, "union"))
            table_out = _join_aggregates(table_out, text, keys)
        for c in cols[MULTI_CAT]:
            text = whole_text(list_union_pieces(right, keys, c, order), keys, add(MULTI_CAT, c, "union"))
            table_out = _join_aggregates(table_out, text, keys)
    elif unions == "pieces" and (cols[CAT] or cols[MULTI_CAT]):
        lists = [c for c in cols[MULTI_CAT] if c not in nested]
        parts = []
        if cols[CAT] or lists:
            parts.append(pieces_by_key(cold, keys, cols[CAT], lists, order, piece_rows, n_rows))
        if heavy is not None:
            parts += [(cat_union_pieces(heavy, keys, c, piece_rows) if c in cols[CAT] else
                       list_union_pieces(heavy, keys, c, order, piece_rows)).withColumn("column", F.lit(c))
                      for c in (*cols[CAT], *lists)]
        parts += [_union_of_unions(right, keys, c, order, nested[c], piece_rows).withColumn("column", F.lit(c))
                  for c in cols[MULTI_CAT] if c in nested]
        found = materialize(reduce(DataFrame.unionByName, parts), "pieces")
        firsts = []
        for c in (*cols[CAT], *cols[MULTI_CAT]):
            made, number, own = add(MULTI_CAT, c, "union"), add(NUM, c, "union_pieces"), F.col("column") == c
            firsts += [F.max(F.when(own & (F.col("piece") == 0), F.col("text"))).alias(made),
                       (F.max(F.when(own, F.col("piece"))) + 1).cast("long").alias(number)]
            pieces[made] = UnionPieces(tuple(keys), found.where(own).drop("column").withColumnsRenamed(
                {k: f"_u{i}" for i, k in enumerate(keys)}))
        table_out = _join_aggregates(table_out, found.groupBy(*keys).agg(*firsts), keys)
    return table_out.select(*keys, *extra, *[
        tagged(F.col(n), n, k, src.table, origin=o, path=src.path) for n, (k, src, o) in meta.items()]), pieces


def _by_heat(rows: DataFrame, keys: Sequence[str], hot_rows: int,
             measured: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of keys that are not hot, those of hot ones if there are any, and how many rows there are in all."""
    found = key_profiles(measured or rows, [keys], hot_rows)[tuple(keys)]
    if not found.hot:
        return rows, None, found.rows
    heavy = F.xxhash64(*keys).isin(list(found.hot))
    return rows.where(~heavy), rows.where(heavy), found.rows


def _union_of_unions(right: DataFrame, keys: Sequence[str], column: str, order: Sequence[str], pieces: UnionPieces,
                     piece_rows: int) -> DataFrame:
    """The union per key of a column that is a union itself: every row brings all its pieces, in their order."""
    rows = right.select(*dict.fromkeys((*keys, *order, *pieces.keys)), F.col(column).alias("_first"))
    on = same_keys([F.col(k) for k in pieces.keys], [F.col(f"_u{i}") for i in range(len(pieces.keys))])
    # a one-character union does not count; it has one piece
    every = rows.where(is_list(F.col("_first"))).join(pieces.table, on).select(
        *dict.fromkeys((*keys, *order)), *[F.col(f"_u{i}") for i in range(len(pieces.keys))], "piece", F.col("text").alias("_text"))
    by = [*order, *[f"_u{i}" for i in range(len(pieces.keys))], "piece"]
    # each of them may have ``piece_rows`` elements
    return joined_pieces(right, every, keys, by, "_text", max(isqrt(piece_rows), 1))


def _join_aggregates(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two one-row-per-key tables on plain keys; both are already partitioned by them."""
    return a.join(b, list(keys), "left")


def join_to_many(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
                 table: str, order: Sequence[str], unions: str = "length", *, times: bool = False,
                 spread: Sequence[str] | None = None, broadcast_keys: int = BROADCAST_KEYS,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Aggregate the side table per key, then left-join the result: rows are never multiplied.

    Side rows without a key belong to no row and are left out. Left rows that share a key (a fill value,
    say) are salted if they are many.
    """
    return join_with_unions(left, right, left_keys, right_keys, table, order, unions, times=times, spread=spread,
                            broadcast_keys=broadcast_keys, hot_rows=hot_rows).rows


def join_with_unions(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
                     table: str, order: Sequence[str], unions: str = "pieces", *, times: bool = False,
                     spread: Sequence[str] | None = None, broadcast_keys: int = BROADCAST_KEYS, hot_rows: int = HOT_ROWS,
                     step: str | None = None, nested: Mapping[str, UnionPieces] | None = None,
                     piece_rows: int = PIECE_ROWS, measured: tuple[DataFrame, DataFrame] | None = None) -> Merged:
    """``join_to_many`` with the pieces of the union columns. ``measured`` has what is read for hot keys in place of
    ``left`` and ``right`` (see ``join_to_one``)."""
    with_key = right.dropna(subset=list(right_keys))
    left_keyed, right_keyed = measured or (left, right)
    side, pieces = aggregate_with_unions(
        with_key, right_keys, table, order, unions, times=times, step=step, nested=nested, piece_rows=piece_rows,
        hot_rows=hot_rows, measured=right_keyed.dropna(subset=list(right_keys)))
    renamed = {k: f"_right{i}" for i, k in enumerate(right_keys)}
    # the number of keys is not known before they are aggregated; at run time a small result is broadcast
    profile = _large(left_keyed, left_keys, broadcast_keys, hot_rows)
    rows = attach(left, side.withColumnsRenamed(renamed), list(left_keys), profile, null_keys=False,
                  table_keys=list(renamed.values()), spread=spread, broadcast_keys=broadcast_keys)
    own = tuple(right_keys)
    return Merged(rows, {c: UnionPieces(tuple(left_keys), p.table, False) if p.keys == own else p for c, p in pieces.items()})


def depths(relations: Sequence[Relation], main: str) -> dict[str, int]:
    """Distance of each table from the main one in the relation graph."""
    near: dict[str, list[str]] = {}
    for r in relations:
        near.setdefault(r.left, []).append(r.right)
        near.setdefault(r.right, []).append(r.left)
    out, queue = {main: 0}, deque([main])
    while queue:
        at = queue.popleft()
        for to in near.get(at, ()):
            if to not in out:
                out[to] = out[at] + 1
                queue.append(to)
    return out


def join_as_of(left: DataFrame, right: DataFrame, left_key: str, right_key: str, time_col: str, row_id: str,
               table: str, step: str | None = None) -> DataFrame:
    """The latest values of a to-many table at or before each left row's time, in place of aggregates that
    also see later rows. Of a union that the side table has, the first piece comes along."""
    names = {c: _lineage(right, c, table, step) for c in columns_of(right) if c not in (right_key, time_col)}
    side = right.dropna(subset=[right_key]).select(F.col(right_key).alias(left_key), time_col, *names)
    joined = asof_join(left, side, left_key, time_col, row_id, list(names), prefix="_asof_")
    joined = joined.select(*left.columns, *[
        tagged(F.col(f"_asof_{c}"), n.of("asof"), kind_of(right, c), n.table, origin="last", path=n.path)
        for c, n in names.items()])
    return retag(joined, left)


@dataclass(frozen=True)
class Branch:
    """A table with the branches that are joined into it, each by a relation under a step's name."""

    table: str
    joined: tuple[tuple[Relation, str, "Branch"], ...] = ()


def branches(relations: Sequence[Relation], main: str, paths: str = "nearest") -> Branch:
    """The paths from the main table as a tree.

    With ``"nearest"`` a relation is followed to tables that are further from the main table than the one it starts from.
    With ``"all"`` to-one relations are also followed to tables that are as near or nearer, if the path has not met them.
    """
    if paths not in ("nearest", "all"):
        raise ValueError(f"unknown choice of paths {paths!r}")
    depth = depths(relations, main)
    edges = [e for r in relations for e in (r, r.flipped())]
    between = Counter((e.left, e.right) for e in edges)

    def grow(table: str, above: frozenset[str]) -> Branch:
        joined = []
        for e in edges:
            if e.left != table or e.right in above:
                continue
            if depth[e.right] <= depth[table] and not (paths == "all" and e.kind == "many_to_one"):
                continue
            step = e.right if between[e.left, e.right] == 1 else f"{e.name or '_'.join(e.left_keys)}__{e.right}"
            joined.append((e, step, grow(e.right, above | {e.right})))
        return Branch(table, tuple(joined))

    return grow(main, frozenset({main}))


def _met(branch: Branch) -> Counter:
    """How often each branch is joined."""
    out = Counter([branch])
    for _, _, child in branch.joined:
        out += _met(child)
    return out


def merge_graph(tables: TableSet, *, fill: str = "after", unions: str = "length", as_of: bool = False,
                times: bool = False, check_unique: bool = False, paths: str = "nearest",
                broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One wide table: each table takes in the deeper ones it is related to, up to the main table.

    Columns of a table that is met on one path have its name in front; of one met on several, the steps of the path.
    ``paths`` chooses the relations that are followed (see ``branches``).
    ``as_of`` joins a to-many table that shares the main clock by the latest earlier row instead of
    aggregating all its rows; ``times`` adds the first and last time of aggregated tables.
    ``fill`` says when nulls are filled: ``"before"`` (tables are cleaned first, so the fills take part
    in the aggregates), ``"after"`` (aggregates skip nulls) or ``"none"``. The merged rows are cleaned in
    both filling modes, which covers rows without a match.
    """
    merged = merge_with_unions(tables, fill=fill, unions=unions, as_of=as_of, times=times, check_unique=check_unique,
                               paths=paths, broadcast_keys=broadcast_keys).rows
    return merged.drop(*[c for c in merged.columns if c.startswith(_LINK)])


_LINK = "_link"


def merge_with_unions(tables: TableSet, *, fill: str = "after", unions: str = "pieces", as_of: bool = False,
                      times: bool = False, check_unique: bool = False, paths: str = "nearest",
                      broadcast_keys: int = BROADCAST_KEYS, piece_rows: int = PIECE_ROWS) -> Merged:
    """``merge_graph`` with the whole texts of its union columns beside it.

    The pieces of a union ride along wherever its table is joined: the rows keep the key that finds them, in a column without
    a type where they have no such column.
    """
    if fill not in ("before", "after", "none"):
        raise ValueError(f"unknown fill mode {fill!r}")
    root = branches(tables.relations, tables.main, paths)
    met = _met(root)
    done: dict[Branch, Merged] = {}
    bases: dict[Branch, DataFrame] = {}  # tables before anything is joined: joins do not repeat rows
    fresh = count()

    def gather(branch: Branch) -> Merged:
        if branch in done:
            return done[branch]
        df = tables.typed(branch.table)
        if fill == "before":
            df = clean_fill(df)
        bases[branch] = df
        found: dict[str, UnionPieces] = {}
        for edge, step, child in branch.joined:
            held = gather(child)
            side = held.rows
            # a side table on a clock its parent does not have is left out
            if tables.time_col in side.columns and tables.time_col not in df.columns:
                continue
            spread = [tables.row_id] if tables.row_id in df.columns else None
            clock = tables.time_col
            if as_of and edge.to_many and spread and clock in df.columns and clock in side.columns:
                if len(edge.left_keys) != 1:
                    raise ValueError("an as-of join takes one key column")
                df = join_as_of(df, side, edge.left_keys[0], edge.right_keys[0], clock, tables.row_id, edge.right, step)
            elif edge.to_many:
                joined = join_with_unions(
                    df, side, edge.left_keys, edge.right_keys, edge.right, tables.specs[edge.right].order, unions,
                    times=times, spread=spread, broadcast_keys=broadcast_keys, step=step, nested=held.unions,
                    piece_rows=piece_rows, measured=(bases[branch], bases[child]))
                df = joined.rows
                for c, p in joined.unions.items():
                    # the keys come along under names of their own, unless these are the main rows
                    links = p.keys if branch.table == tables.main and p.keys == tuple(edge.left_keys) else tuple(
                        f"{_LINK}{next(fresh)}" for _ in p.keys)
                    if links != p.keys:
                        df = df.select("*", *[F.col(k).alias(n) for k, n in zip(p.keys, links, strict=True)])
                    found[c] = replace(p, keys=links)
                df = df.drop(*[k for p in joined.unions.values() for k in p.keys if k.startswith("_last")])
            else:
                links = {k: f"{_LINK}{next(fresh)}" for p in held.unions.values() for k in p.keys}
                df = join_to_one(df, side, edge.left_keys, edge.right_keys, edge.right, check_unique=check_unique,
                                 broadcast_keys=broadcast_keys, spread=spread, step=step, measured=bases[branch],
                                 carry=[F.col(k).alias(n) for k, n in links.items()])
                found |= {_lineage(side, c, edge.right, step).name: replace(p, keys=tuple(links[k] for k in p.keys))
                          for c, p in held.unions.items()}
        if met[branch] > 1 and branch.joined:
            df = retag(materialize(df, branch.table), df)  # computed once, joined on every path
        done[branch] = Merged(df, found)
        return done[branch]

    whole = gather(root)
    rows, short = _short_names(whole.rows)
    rows = rows if fill == "none" else clean_fill(rows)
    return Merged(rows, {short[c]: p for c, p in whole.unions.items()})


def _short_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns of tables met on one path under the table's name, and all names by the ones they had."""
    met: dict[str, set[str]] = {}
    for c in df.columns:
        if path_of(df, c):
            met.setdefault(table_of(df, c), set()).add(path_of(df, c))
    names = {}
    for c in df.columns:
        path, table = path_of(df, c), table_of(df, c)
        alone = path and len(met[table]) == 1
        names[c] = f"{table}__{c[len(_label(path)) + 2:]}" if alone else c
    return df.select(*[F.col(c).alias(n, metadata=df.schema[c].metadata) for c, n in names.items()]), names
