"""Document scores by a bidirectional language model: the log-probability of each word given its neighbours on both sides.

The vocabulary is counted over all documents: the ``TOP`` commonest words (A-Z lowered) have a number of their own, the others
share numbers by hash. The probability of one of those is that of its number times its share among all occurrences of the
number's words, counted over the whole corpus; one occurrence more is kept for words that were never seen. The shares of up to
``NEAR`` common words are sent to the tasks, those of all others are joined. A network looks at the ``WINDOW`` numbers before and after a place, never at the place itself, and
predicts the number there in two steps of ``BASE`` outcomes each: the high digit, then the low digit given the high one.
Places beyond the text's ends have a number of their own. A document's score is the sum of the log-probabilities of its
words, each predicted from both sides.

Training reads every document once, in ``ROUNDS`` rounds of different documents: each task trains a copy of the network on its
share, in blocks of places, and the copies are averaged by the places they have seen. So what is gathered grows with the
input, and the driver holds one network. Null and empty texts have no words and score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import attach, materialize
from weft.llm.kernels import mix, text_runs

TOP = 640
#: Words whose counts go to every task, and steps per doubling in which their least count is found.
NEAR = 65_536
STEPS = 8
BASE = 32
WINDOW = 3
WIDTH = 8
HIDDEN = 32
ROUNDS = 2
BLOCK = 512
SCORE_BLOCK = 8_192
RATE = 1e-2
VOCABULARY = BASE * BASE
#: The number of places outside the text, as an input only.
OUTSIDE = VOCABULARY
Network = list[np.ndarray]


class Model(NamedTuple):
    """``known`` words (sorted) with their ``place`` numbers, ``near`` words (sorted) with their counts, all words' ``counts``,
    and the occurrences of the words that share a number."""

    net: Network
    known: np.ndarray
    place: np.ndarray
    near: np.ndarray
    near_n: np.ndarray
    shared: np.ndarray
    counts: DataFrame


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over all documents, a word being its 64-bit value."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in text_runs(batch.column("text")):
                value, n = np.unique(words.hashes(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbers(words: np.ndarray, known: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Vocabulary numbers of word values; ``known`` is sorted and ``order`` has its numbers."""
    out = (len(known) + (mix(words) % np.uint64(VOCABULARY - len(known))).astype(np.int64)).astype(np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        hit = known[at] == words
        out[hit] = order[at[hit]]
    return out


def near_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``NEAR`` of the commonest words, sorted by value, with their counts: all above a count."""
    step = F.floor(F.log2("n") * STEPS)
    sizes = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    total = np.cumsum([r["words"] for r in sizes])
    taken = [r["step"] for r, t in zip(sizes, total, strict=True) if t <= NEAR]
    rows = counts.where(step >= min(taken)).collect() if taken else []
    values = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r["n"] for r in rows], np.int64)[order]


def shared_counts(counts: DataFrame, known: np.ndarray) -> np.ndarray:
    """Occurrences of all words of each number that words share; 0 for the numbers of one word."""
    place = np.zeros(len(known), np.int32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            np.add.at(total, numbers(batch.column("word").to_numpy().view(np.uint64), known, place), batch.column("n").to_numpy())
        total[:len(known)] = 0
        at = np.flatnonzero(total)
        yield pa.record_batch({"number": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(VOCABULARY, np.int64)
    for r in counts.mapInArrow(task, "number int, n long").groupBy("number").agg(F.sum("n").alias("n")).collect():
        out[r["number"]] = r["n"]
    return out


def new_network(seed: int = 1) -> Network:
    """Embeddings by place in the window, hidden layer, and the two output layers with the embedding of the high digit."""
    rng = np.random.default_rng(seed)
    sides = 2 * WINDOW
    shapes = [(VOCABULARY + 1, WIDTH), (sides * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, BASE), (BASE,), (BASE, HIDDEN),
              (HIDDEN, BASE), (BASE,)]
    scale = [0.3, 1 / np.sqrt(sides * WIDTH), 0, 1 / np.sqrt(HIDDEN), 0, 0.3, 1 / np.sqrt(HIDDEN), 0]
    return [rng.normal(0, 1, s).astype(np.float32) * np.float32(c) for s, c in zip(shapes, scale, strict=True)]


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The neighbours' numbers of every place; rows ``first[i]:first[i + 1]`` are one text."""
    n = len(ids)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lo, hi = first[:-1][row], first[1:][row]
    out = np.full((n, 2 * WINDOW), OUTSIDE, np.int32)
    place = np.arange(n)
    for c, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        at = place + step
        inside = (at >= lo) & (at < hi)
        out[inside, c] = ids[at[inside]]
    return out


def row_max(z: np.ndarray) -> np.ndarray:
    """The largest value of each row as a column, by halves: rows are too short for a reduction of each. The width is a power of two."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = np.maximum(z[:, :half], z[:, half:])
    return z


def row_sums(z: np.ndarray) -> np.ndarray:
    """The sum of each row as a column, in numpy's order: eight running sums, then their tree. The width is a multiple of eight."""
    total = sum((z[:, at:at + 8] for at in range(8, z.shape[1], 8)), z[:, :8])
    while total.shape[1] > 1:
        total = total[:, ::2] + total[:, 1::2]
    return total


def exponents(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of each row's outcomes less the largest, and their sums as a column. An outcome's values lie side by
    side: so every step is over long stretches of them."""
    z = np.asfortranarray(rows @ weights)
    z += bias
    z -= row_max(z)
    np.exp(z, out=z)
    return z, row_sums(z)


def hidden(net: Network, context: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    x = net[0].take(context.reshape(-1), 0).reshape(len(context), -1)
    h = x @ net[1]
    h += net[2]
    np.tanh(h, out=h)
    g = net[5].take(high, 0)
    g += h
    return x, h, np.tanh(g, out=g)


def forward(net: Network, context: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    x, h, g = hidden(net, context, high)
    out = []
    for rows, weights, bias in ((h, net[3], net[4]), (g, net[6], net[7])):
        z, total = exponents(rows, weights, bias)
        z /= total
        out.append(np.ascontiguousarray(z))
    return x, h, g, *out


def log_probabilities(net: Network, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each number given its neighbours."""
    out = np.zeros(len(ids))
    for lo in range(0, len(ids), SCORE_BLOCK):
        own = ids[lo:lo + SCORE_BLOCK]
        high, low = own // BASE, own % BASE
        _, h, g = hidden(net, context[lo:lo + SCORE_BLOCK], high)
        row = np.arange(len(own))
        # only the own outcome of a place is divided
        (p, p_sum), (q, q_sum) = exponents(h, net[3], net[4]), exponents(g, net[6], net[7])
        out[lo:lo + SCORE_BLOCK] = (np.log(p[row, high] / p_sum[:, 0] + 1e-30)
                                     + np.log(q[row, low] / q_sum[:, 0] + 1e-30))
    return out


class Trainer:
    """Steps of one copy of the network, each with a step size of its own per weight. All weights lie in one array, and so do their
    gradients; ``net`` and ``grads`` are the parts of it."""

    def __init__(self, net: Network, rate: float) -> None:
        self.flat, self.net = _parts(net)
        self.gradient, self.grads = _parts(net)
        self.square = np.full_like(self.flat, 1e-6)
        self.rate, self.seen = rate, 0

    def learn(self, ids: np.ndarray, context: np.ndarray) -> None:
        for lo in range(0, len(ids), BLOCK):
            self._step(ids[lo:lo + BLOCK], context[lo:lo + BLOCK])

    def _step(self, ids: np.ndarray, context: np.ndarray) -> None:
        net, n = self.net, len(ids)
        high, low = ids // BASE, ids % BASE
        x, h, g, p, q = forward(net, context, high)
        row = np.arange(n)
        p[row, high] -= 1
        q[row, low] -= 1
        p /= n
        q /= n
        dg = (q @ net[6].T) * (1 - g * g)
        dh = (p @ net[3].T + dg) * (1 - h * h)
        # a row per column of the embedding
        dx = (dh @ net[1].T).reshape(n * 2 * WINDOW, WIDTH).T.astype(np.float64, order="C")
        places = context.reshape(-1).astype(np.intp)
        embedding = self.grads[0]
        for c in range(WIDTH):
            embedding[:, c] = np.bincount(places, dx[c], len(embedding))
        digit = np.zeros((BASE, n), np.float32)
        digit[high, row] = 1
        for own, value in zip(self.grads[1:], (x.T @ dh, dh.sum(0), h.T @ p, p.sum(0), digit @ dg, g.T @ q, q.sum(0)), strict=True):
            own[...] = value
        gr, s = self.gradient, self.square
        s *= 0.99
        s += 0.01 * gr * gr
        size = np.sqrt(s)
        size += 1e-6
        gr *= self.rate
        gr /= size
        self.flat -= gr
        self.seen += n


def _parts(net: Network) -> tuple[np.ndarray, Network]:
    """A copy of all weights in one array, and the network as views of it."""
    flat = np.concatenate([a.reshape(-1) for a in net])
    ends = np.cumsum([a.size for a in net])
    return flat, [flat[e - a.size:e].reshape(a.shape) for a, e in zip(net, ends, strict=True)]


def pack(net: Network) -> bytes:
    return b"".join(a.tobytes() for a in net)


def unpack(data: bytes) -> Network:
    out, at = [], 0
    for a in new_network():
        out.append(np.frombuffer(data, np.float32, a.size, at).reshape(a.shape))
        at += 4 * a.size
    return out


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """The network, the known words with their numbers, and the counts of all words."""
    counts = materialize(word_counts(docs), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()
    values = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(values)
    known, place = values[order], order.astype(np.int32)
    spark, net = docs.sparkSession, new_network()
    for turn in range(rounds):
        own = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        sent = spark.sparkContext.broadcast((pack(net), known, place))
        rate = RATE * (1 - 0.5 * turn / max(1, rounds))

        def task(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            data, words_known, words_place = sent.value
            trainer = Trainer(unpack(data), rate)
            for batch in batches:
                for _, _, words in text_runs(batch.column("text")):
                    ids = numbers(words.hashes(), words_known, words_place)
                    trainer.learn(ids, contexts(ids, words.first))
            if trainer.seen:
                flat = np.concatenate([a.reshape(-1) for a in trainer.net]).astype(np.float64) * trainer.seen
                # by slices, so that the sum is spread over tasks
                size = -(-len(flat) // 16)
                parts = [flat[i:i + size] for i in range(0, len(flat), size)]
                yield pa.record_batch({"slice": pa.array(range(len(parts)), pa.int32()),
                                       "seen": pa.array([trainer.seen] * len(parts), pa.int64()),
                                       "weights": pa.array([p.tobytes() for p in parts], pa.binary())})

        copies = own.mapInArrow(task, "slice int, seen long, weights binary")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            seen: dict[int, int] = {}
            for batch in batches:
                for s, n, w in zip(*(batch.column(c).to_pylist() for c in ("slice", "seen", "weights")), strict=True):
                    value = np.frombuffer(w)
                    total[s] = total[s] + value if s in total else value
                    seen[s] = seen.get(s, 0) + n
            yield pa.record_batch({"slice": pa.array(list(total), pa.int32()), "seen": pa.array(list(seen.values()), pa.int64()),
                                   "weights": pa.array([v.tobytes() for v in total.values()], pa.binary())})

        # a task holds one sum per slice, however many copies it adds
        summed = copies.repartition(16, "slice").mapInArrow(add, "slice int, seen long, weights binary").collect()
        if summed:
            summed.sort(key=lambda r: r["slice"])
            flat = np.concatenate([np.frombuffer(r["weights"]) / r["seen"] for r in summed]).astype(np.float32)
            net = unpack(flat.tobytes())
    return Model(net, known, place, *near_words(counts), shared_counts(counts, known), counts)


def find(words: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words a sorted table holds, and where."""
    if not len(table):
        return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return table[at] == words, at


def far_shares(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (text_hash, far, copies): the summed log shares of the words that are neither known nor near, and the rows with the
    text. Texts without such words have no row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.known, model.place, model.near, model.shared))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, near, shared = sent.value
        for batch in batches:
            for lo, hi, words in text_runs(batch.column("text")):
                h = words.hashes()
                ids = numbers(h, known, place)
                at = np.flatnonzero(ids >= len(known))
                at = at[~find(h[at], near)[0]]
                row = np.searchsorted(words.first, at, "right") - 1
                by = np.lexsort((h[at], row))
                at, row = at[by], row[by]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[at[1:]] != h[at[:-1]])
                begin = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_hash").slice(lo, hi - lo).take(pa.array(row[begin])),
                     pa.array(h[at[begin]].view(np.int64)), pa.array(np.diff([*begin, len(at)]).astype(np.int64)),
                     pa.array(shared[ids[at[begin]]] + 1)], ["text_hash", "word", "times", "of"])

    found = docs.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        task, "text_hash long, word long, times long, of long")
    # rows with the same text count once
    found = found.groupBy("text_hash", "word", "times", "of").agg(F.count(F.lit(1)).alias("copies"))
    share = F.log(F.coalesce("n", F.lit(1)) / F.col("of"))
    return found.join(model.counts, "word", "left").groupBy("text_hash").agg(
        F.sum(F.col("times") * share).alias("far"), F.max("copies").alias("copies"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text`` and with n_words, log_prob (the sum) and mean_log_prob (0 without words)."""
    near_share = np.log(model.near_n / (model.shared[numbers(model.near, model.known, model.place)] + 1.0))
    sent = docs.sparkSession.sparkContext.broadcast((pack(model.net), model.known, model.place, model.near, near_share))
    new = ("n_words", "log_prob", "mean_log_prob")
    kept = [c for c in docs.columns if c not in ("text", *new)]
    rows = docs.select(*kept, F.xxhash64("text").alias("_text"))
    schema = rows.schema.add("n_words", "long").add("log_prob", "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, known, place, near, share = sent.value
        net = unpack(data)
        for batch in batches:
            for lo, hi, words in text_runs(batch.column("text")):
                h = words.hashes()
                ids = numbers(h, known, place)
                value = log_probabilities(net, ids, contexts(ids, words.first))
                tail = np.flatnonzero(ids >= len(known))
                hit, at = find(h[tail], near)
                value[tail[hit]] += share[at[hit]]
                total = np.concatenate([[0.0], np.cumsum(value)])
                n = np.diff(words.first)
                value = np.where(n > 0, total[words.first[1:]] - total[words.first[:-1]], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in (*kept, "_text")), pa.array(n, pa.int64()), pa.array(value)],
                    [*kept, "_text", "n_words", "log_prob"])

    scored = docs.select(*kept, F.xxhash64("text").alias("_text"), "text").mapInArrow(task, schema)
    far = materialize(far_shares(docs, model).withColumnRenamed("text_hash", "_text"), "far")
    total = F.col("log_prob") + F.coalesce("far", F.lit(0.0))
    return attach(scored, far, ["_text"], "copies").select(
        *kept, "n_words", total.alias("log_prob"), (total / F.greatest("n_words", F.lit(1))).alias("mean_log_prob"))
