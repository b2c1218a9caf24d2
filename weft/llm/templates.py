"""Line de-duplication by a tree of log templates, with DataFrame functions.

A line's words are masked where they hold a digit, and the line goes down a tree of fixed depth: first by its number of words,
then by its first ``LEADING`` masked words. In a leaf that at least ``min_docs`` documents reach, a word stands for itself at its
place when as many occurrences of lines (one per document and masked line) have it there; all other words are fields. The line
with its fields generalised is its template. A template recurs when at least ``min_docs`` occurrences have it and it keeps
enough words: all of them, or ``CONSTANT`` of them and at least ``LEAST_CONSTANT`` when fields were found by frequency, or
``MASKED`` of them when every field holds a digit.

Lines of a recurring template are dropped from every document but the one with the smallest doc_id among those that have it,
so copied documents do not lose their text altogether. Blank lines are never dropped. Lines are cut at line feeds; a null text
has none and stays null. Rows that repeat a doc_id and a text are one document. Null doc_ids count as the largest.

The tree is worked on by leaf and by distinct masked line. The lists of words of a leaf are never in one place: every count is
a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import attach, materialize, same

BETWEEN = r"[\x20\x09-\x0D]+"
FIELD = "<*>"
LEADING = 3
MIN_DOCS = 10
CONSTANT, LEAST_CONSTANT, MASKED = 0.75, 4, 0.5
_LAST = (1 << 63) - 1


def line_words(line: Column) -> Column:
    """The line's words; white space at its ends makes none."""
    return F.array_remove(F.split(line, BETWEEN), "")


def masked(words: Column) -> Column:
    """A field in place of each word that holds a digit."""
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(w))


def _leaf(words: Column) -> Column:
    """The leaf of a line's words: only the leading ones are masked for it."""
    return F.xxhash64(F.size(words), masked(F.slice(words, 1, LEADING)))


def template_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The lines to drop, from rows (doc_id, text): doc_id, text_hash, places (of the lines, from 0)."""
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    lines = key.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.select("doc_id", "text_hash", "place", line_words(F.col("line")).alias("words")).where(F.size("words") > 0)

    leaves = key.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.split("text", "\n"), lambda x: _leaf(line_words(x))))).alias("leaf"))
    reached = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    found = lines.withColumn("leaf", _leaf(F.col("words"))).join(materialize(reached.select("leaf"), "leaves"), "leaf",
                                                                 "left_semi")
    # few lines lie in such leaves: the others are never masked
    found = materialize(found.withColumn("words", masked(F.col("words"))), "lines")

    # distinct masked lines with the number of documents that have them
    per_doc = found.select("leaf", "words", "doc_id").distinct()
    distinct = per_doc.groupBy("leaf", "words").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("first"))
    distinct = materialize(distinct.withColumn("line", F.xxhash64("words")), "distinct")
    at_place = distinct.select("leaf", "line", "docs", F.posexplode("words").alias("at", "word"))
    constant = at_place.where(F.col("word") != FIELD).groupBy("leaf", "at", "word").agg(F.sum("docs").alias("n")).where(
        F.col("n") >= min_docs).select(F.col("leaf").alias("_l"), F.col("at").alias("_a"), F.col("word").alias("_w"))
    known = at_place.join(constant, (F.col("leaf") == F.col("_l")) & (F.col("at") == F.col("_a"))
                          & (F.col("word") == F.col("_w")), "left")
    word = F.when(F.col("_w").isNotNull(), F.col("word")).otherwise(F.lit(FIELD))
    templates = known.groupBy("leaf", "line").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", word.alias("word")))), lambda x: x["word"]).alias("template"),
        F.count("_w").alias("constants"), F.count(F.lit(1)).alias("size"),
        F.count(F.when(F.col("word") == FIELD, 1)).alias("masked"))
    enough = ((F.col("constants") == F.col("size"))
              | (F.col("constants") >= F.greatest(CONSTANT * F.col("size"), F.lit(LEAST_CONSTANT)))
              | ((F.col("constants") + F.col("masked") == F.col("size")) & (F.col("constants") >= MASKED * F.col("size"))))
    templates = templates.where(enough).select(F.col("leaf").alias("_l"), F.col("line").alias("_n"),
                                               F.xxhash64("template").alias("template"))
    placed = materialize(distinct.join(templates, (F.col("leaf") == F.col("_l")) & (F.col("line") == F.col("_n"))).select(
        "leaf", "line", "docs", "first", "template"), "placed")
    recurring = placed.groupBy("leaf", "template").agg(
        F.sum("docs").alias("total"), F.min("first").alias("keeper"), F.count(F.lit(1)).alias("members")).where(
        F.col("total") >= min_docs)
    dropped = attach(placed, materialize(recurring, "recurring"), ["leaf", "template"], "members").where("total is not null")
    dropped = materialize(dropped.select("leaf", "line", "docs", "keeper"), "dropped")

    marked = attach(found.select("doc_id", "text_hash", "place", "leaf", F.xxhash64("words").alias("line")), dropped,
                    ["leaf", "line"], "docs")
    marked = marked.where(F.col("keeper").isNotNull() & (F.coalesce("doc_id", F.lit(_LAST)) != F.col("keeper")))
    return marked.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def drop_template_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; n_lines and n_dropped are added (replaced if there)."""
    places = template_lines(docs, min_docs).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "places")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept, F.xxhash64("text").alias("_t"))
    out = rows.join(places, same([F.col("doc_id").cast("long"), F.col("_t")], [F.col("_d"), F.col("_h")]), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], count.alias("n_lines"),
                      F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
