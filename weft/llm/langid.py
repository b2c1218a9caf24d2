"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams that both hold, over all lengths 1 to ``SPECTRUM`` (a blended spectrum, by
presence and not by count), over the root of the product of their own numbers. N-grams are of bytes after A-Z are lowered and
every run of ASCII other than letters became one space; they are told apart by ``BITS`` bits of a hash. ``LANDMARKS`` texts
span the kernel (Nyström): one-versus-rest kernel ridge regression with those columns, rows weighted so that every language
counts alike. Its normal equations are summed over the training texts by tasks. As the kernel is an inner product of presence
vectors, landmarks and coefficients are multiplied once, and a batch of texts is scored by one product of its presence matrix.

Bounds, all parameters: at most ``PER_LANGUAGE`` distinct texts of a language and ``TRAINING`` of all are learnt from, those
with the least hashes of the text, the languages in turn. All else covers every row and whole texts; a text is cut into rows of bits
whose size does not depend on its length.

Odd inputs: texts that are null or have no letter (Unicode) are ``und`` with score 0, and so is every text where nothing was
learnt. A null language is not learnt from; an empty one is a language. A null doc_id is not held out. Repeated texts are learnt once
per language. Equal outputs go to the language first by code point. The score is half of one plus the winner's output,
between 0 and 1. The coefficients take 256 KB a language. Other columns are kept as they are; one that has the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.kernels import CHUNK, runs, text_bytes
from weft.llm.moments import array_sum
from weft.llm.workers import ship
from weft.sources.workspace import materialize

SPECTRUM = 4
BITS = 16
LANDMARKS = 192
PER_LANGUAGE = 2_000
TRAINING = 16_000
RIDGE = 1e-3
UNKNOWN = "und"
#: Texts whose presence matrix is made at once, and bytes that are hashed at once.
ROWS = 128
SEGMENT = 1 << 19

#: Bytes as n-grams see them: A-Z lowered, ASCII that is no letter as a space.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_SALT = [np.uint32((0x9E3779B1 * (p + 1)) & 0xFFFFFFFF) for p in range(8)]
_FACTOR = np.uint32(0x85EBCA6B)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by class with runs of spaces as one, none at a row's start, and the new offsets."""
    seen = _CLASS[data]
    space = seen == 32
    before = np.ones(len(seen), bool)
    before[1:] = space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(seen)]
    before[inner] = True
    keep = ~(space & before)
    count = np.zeros(len(seen) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return seen[keep], count[offsets]


def presence(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, spectrum: int = SPECTRUM) -> np.ndarray:
    """Per row a 1 at the place of every n-gram that it holds."""
    seen, own = normalised(data, offsets)
    rows = len(own) - 1
    flags = np.zeros(rows << bits, np.uint8)
    for lo in range(0, len(seen), SEGMENT):
        hi = min(lo + SEGMENT, len(seen))
        row = np.searchsorted(own, np.arange(lo, hi), "right") - 1
        room = own[row + 1] - np.arange(lo, hi)
        base = row.astype(np.int64) << bits
        value = np.zeros(hi - lo, np.uint32)
        for p in range(min(spectrum, 4)):
            # bytes past the end of a row are masked by ``room``
            tail = seen[lo + p:hi + p].astype(np.uint32)
            value[:len(tail)] |= tail << np.uint32(8 * p)
            ok = room > p
            h = (value[ok] + _SALT[p]) * _FACTOR
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            flags[base[ok] + (h >> np.uint32(32 - bits)).astype(np.int64)] = 1
    return flags.reshape(rows, 1 << bits)


def presence_runs(texts: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """Presence matrices of at most ``ROWS`` texts each, in order."""
    data, offsets = text_bytes(texts)
    for lo, hi in runs(offsets, CHUNK):
        for a in range(lo, hi, ROWS):
            b = min(a + ROWS, hi)
            yield presence(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], bits)


@dataclass(frozen=True)
class LanguageModel:
    """Languages by code point, and a coefficient per place and language."""

    languages: list[str]
    weights: np.ndarray


def kernel(flags: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of each row of presence bits with each landmark (scaled, one per column)."""
    size = np.sqrt(np.maximum(flags.sum(1, dtype=np.int64), 1)).astype(np.float32)
    return (flags.astype(np.float32) @ landmarks) / size[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _unpacked(places: list[bytes], bits: int) -> np.ndarray:
    flags = np.zeros((len(places), 1 << bits), np.uint8)
    for i, p in enumerate(places):
        flags[i, np.frombuffer(p, np.uint16)] = 1
    return flags


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, training: int = TRAINING) -> DataFrame:
    """The sample of distinct texts as (lang, turn, h, places): n-gram places, at most 128 KB of them a text."""
    texts = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(
        "lang", "text", F.xxhash64("text").alias("h"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = texts.select("lang", "h").distinct().withColumn("turn", turn).where(F.col("turn") <= per_language)
    # ``training`` rows at most
    picked = materialize(picked.orderBy("turn", "lang").limit(training), "picked")
    own = texts.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "turn", "h").agg(F.first("text").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for flags in presence_runs(batch.column("text")):
                places = [np.flatnonzero(f).astype(np.uint16).tobytes() for f in flags]
                part = batch.slice(at, len(flags))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "turn", "h")),
                                                  pa.array(places, pa.binary())], ["lang", "turn", "h", "places"])
                at += len(flags)

    return materialize(own.mapInArrow(task, "lang string, turn int, h long, places binary"), "kernel_rows")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, training: int = TRAINING, landmarks: int = LANDMARKS,
          ridge: float = RIDGE) -> LanguageModel:
    """Learn from the text and lang of all ``docs``."""
    ship(docs.sparkSession)
    rows = training_rows(docs, per_language, training)
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(count)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32))
    marks = [r["places"] for r in rows.orderBy("turn", "lang").limit(landmarks).collect()]
    spanned = _unpacked(marks, BITS).astype(np.float32).T
    spanned /= np.sqrt(np.maximum(spanned.sum(0), 1))
    sent = rows.sparkSession.sparkContext.broadcast(marks)
    size, many = len(marks), len(languages)
    number = {lang: i for i, lang in enumerate(languages)}
    weight = [1.0 / (many * count[lang]) for lang in languages]

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, columns = None, None
        for batch in batches:
            if columns is None:
                columns = _unpacked(sent.value, BITS).astype(np.float32).T.copy()
                columns /= np.sqrt(np.maximum(columns.sum(0), 1))
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                k = kernel(_unpacked(part.column("places").to_pylist(), BITS), columns).astype(np.float64)
                at = np.array([number[x] for x in part.column("lang").to_pylist()])
                wide = k * np.array(weight)[at][:, None]
                goal = np.full((len(at), many), -1.0)
                goal[np.arange(len(at)), at] = 1.0
                sums = np.concatenate([(wide.T @ k).reshape(-1), (wide.T @ goal).reshape(-1)])
                total = sums if total is None else total + sums
        return total

    total = array_sum(rows.select("lang", "places"), task)
    normal, right = total[:size * size].reshape(size, size), total[size * size:].reshape(size, many)
    among = (spanned.T @ spanned).astype(np.float64)
    system = normal + ridge * among + 1e-9 * np.trace(normal) / size * np.eye(size)
    alpha = np.linalg.lstsq(system, right, rcond=None)[0]
    return LanguageModel(languages, spanned @ alpha.astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score."""
    spark = ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_letters")]
    if not model.languages:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)
    asked = docs.select(*kept, has_letter(F.col("text")).alias("_letters"))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, UNKNOWN], object)
        for batch in batches:
            best, score = [], []
            for flags in presence_runs(batch.column("text")):
                out = kernel(flags, sent.value.weights)
                best.append(out.argmax(1))
                score.append(np.clip((out.max(1).astype(np.float64) + 1) / 2, 0, 1))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            at = np.concatenate(best) if best else np.zeros(0, np.int64)
            value = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names[np.where(letters, at, len(names) - 1)], pa.string()),
                 pa.array(np.where(letters, value, 0.0))], [*kept, "lang_pred", "score"])

    return asked.mapInArrow(task, schema)
