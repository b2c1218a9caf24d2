"""The prefix trie, whitening and language identification against plain versions of them."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import langid, mixing, prefix_trie, whitening
from weft.llm.workers import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11 prefix trie

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("depth", T.StringType()), T.StructField("i", T.StringType())])


def plain_trie(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    original = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, v in original.items():
        h, origin = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = original.get(origin, [])[:h] + v[h:]
    nodes = collections.defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        words = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += words
            leaves[k[:d]] += kids[k] == 0
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(
        ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k)))).encode()).hexdigest()) for k, m in nodes.items())


def trie(spark, rows, **more):
    frame = ship(spark).createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    out = prefix_trie.prefix_trie(frame, **more)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def test_trie_against_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for c in list(range(60)) + [-7, -20, 4000]:
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "a  b d"])))
    rows += [(61, None, "user", "late"), (61, 0, "user", "x"), (None, 0, "user", "none"), (62, 1, "u", "p"), (62, 1, "u", "p"),
             (62, 1, "u", "o")]
    assert trie(spark, rows, block=4) == plain_trie(rows)


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RADIX", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "SLICE", 2)
    long = [("user", f"turn {i} of many") for i in range(70)]
    rows = [(c, t, r, x) for c in range(100, 112) for t, (r, x) in enumerate(long)]
    rows += [(c, t, r, x) for c in (120, 121) for t, (r, x) in enumerate(long[:33])]
    rows += [(c, t, r, x) for c in (140, 143) for t, (r, x) in enumerate(long[:20] + [("bot", "other")] + long[21:50])]
    assert trie(spark, rows, block=3) == plain_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie(spark, []) == []
    one = [(5, 0, "user", "w " * 30_000)]
    assert trie(spark, one) == plain_trie(one)
    # conversations that lose all their turns are still members of the root
    bare = [(c, 0, "user", "x") for c in (21, 22, 23, 24, 25, 26)]
    assert trie(spark, bare) == plain_trie(bare)


def test_range_minimum():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 6, 300)
    table = prefix_trie.RangeMinimum(values)
    lo = rng.integers(0, 300, 400)
    hi = np.minimum(lo + rng.integers(-1, 80, 400), 299)
    for a, b, m in zip(lo, hi, table.least(lo, hi), strict=True):
        assert m == (values[a:b + 1].min() if b >= a else np.iinfo(np.int64).max)
    bound = rng.integers(0, 7, 400)
    for at, d, s, e in zip(lo, bound, table.run_start(lo, bound), table.run_end(lo, bound), strict=True):
        assert all(values[s:at] >= d) and (s == 0 or values[s - 1] < d)
        assert all(values[at:e] >= d) and (e == 300 or values[e] < d)


# 12 whitening

def vectors(spark, rows, kind=T.FloatType):
    return ship(spark).createDataFrame([(*r, 1.0, "x") for r in rows], T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind())),
        T.StructField("n", T.DoubleType()), T.StructField("x", T.StringType())]))


def check_whitening(out, x, components=4):
    """``out`` by component against eigenvectors of the covariance of the distinct rows of ``x`` (id -> integer row)."""
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    value, axis = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    value, axis = value[::-1], axis[:, ::-1]
    k = int(min(components, (value > 1e-12 * value[0]).sum()))
    assert sorted(out.component.unique()) == list(range(1, k + 1))
    assert (out.n == n).all() and (out.identity_error < 1e-10).all()
    for c in range(k):
        own = out[out.component == c + 1]
        want = {i: (np.array(v) - s / n) @ axis[:, c] / np.sqrt(value[c]) for i, v in x.items()}
        got, plain = own.whitened.to_numpy(), np.array([want[i] for i in own.vec_id])
        assert min(np.abs(got - plain).max(), np.abs(got + plain).max()) < 1e-9
        assert np.allclose(own.explained, value[c] / value.sum(), rtol=1e-10)
        assert own.deviation.tolist() == [int(((n * np.array(x[i]) - s) ** 2).sum()) for i in own.vec_id]


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] @ rng.normal(size=(6, 6))
    rows = [(i, v) for i, v in enumerate(base.astype(np.float32).tolist())]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000, rows[5][1]), (2000, rows[5][1])]
    bad = [(3000, None), (3001, [None] * 6), (3002, [float("nan")] * 6), (3003, [1.0] * 5 + [float("inf")])]
    out = whitening.whiten(vectors(spark, rows + bad)).toPandas()
    assert len(out) == 4 * len(rows)
    check_whitening(out, {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows})


def test_whitening_of_dependent_and_constant_columns(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-9, 9, (120, 2))
    rows = [(i, [float(p), float(q), float(p + q), 7.0, -0.0]) for i, (p, q) in enumerate(a.tolist())]
    rows.append((500, [1.0, 2.0, 3.0, 7.0]))  # shorter: filled up with zeros
    out = whitening.whiten(vectors(spark, rows, T.DoubleType)).toPandas()
    full = {i: (np.array(v + [0.0] * (5 - len(v))) * 256).astype(int) for i, v in rows}
    check_whitening(out, full)


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    out = whitening.whiten(vectors(spark, [(1, [0.0, 2.0]), (None, [1.0, 2.0])])).toPandas()
    assert len(out) == 2 and np.allclose(np.abs(out.whitened), 1) and np.allclose(out.explained, 1)
    huge = whitening.whiten(vectors(spark, [(1, [1e300]), (2, [1.0]), (3, [2.0])], T.DoubleType)).toPandas()
    assert len(huge) == 3 and huge.deviation.isna().any()


def test_shift_grows_until_the_factor_exists():
    gram = np.array([[1.0, 1.0], [1.0, 1.0 - 1e-9]])
    r = whitening.upper_factor(gram, 0.0)
    assert np.allclose(r.T @ r, gram, atol=1e-6) and r[1, 0] == 0
    a = np.random.default_rng(1).normal(size=(5, 2))
    assert np.allclose(whitening.triangular_solve(a, r) @ r, a)


# 13 language

SYLLABLES = {"aa": ["kar", "tol", "min", "ves"], "bb": ["ou", "eau", "leé", "tion"], "cc": ["sch", "ung", "ä", "ber"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


def test_presence_is_the_set_of_n_grams():
    texts = ["Ab, ab!", None, "", "--", "  x ", "Été 1 b", "q" * 3000 + " zz"]

    def grams(text):
        seen = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").encode().lower()).lstrip(b" ")
        return {seen[i:i + p] for p in range(1, langid.SPECTRUM + 1) for i in range(len(seen) - p + 1)}

    flags = np.concatenate(list(langid.presence_runs(pa.array(texts), 16)))
    for row, text in zip(flags, texts, strict=True):
        assert row.sum() == len(grams(text))  # so few do not meet in 65,536 places
    one = np.concatenate(list(langid.presence_runs(pa.array(["ab ab"]), 16)))
    assert (flags[0] == one[0]).sum() >= (1 << 16) - 5


def test_cutting_a_text_changes_nothing(monkeypatch):
    text = [prose(random.Random(1), "bb", 400), "short one", prose(random.Random(2), "cc", 300)]
    whole = np.concatenate(list(langid.presence_runs(pa.array(text))))
    monkeypatch.setattr(langid, "SEGMENT", 64)
    assert (np.concatenate(list(langid.presence_runs(pa.array(text)))) == whole).all()


def test_languages_of_held_out_documents(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, rng.randrange(3, 60)), lang, "s") for i, lang in enumerate(rng.choices(list(SYLLABLES), [90, 9, 4], k=500))]
    rows += [(1000 + i, rows[0][1], rows[0][2], "s") for i in range(200)]
    rows += [(2000, None, "aa", None), (2001, "", "bb", None), (2002, "123 !!", "bb", None), (None, "kar tol", None, None),
             (2003, prose(rng, "cc", 200_000), None, None)]
    docs = ship(spark).createDataFrame(rows, DOCS)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), per_language=100)
    assert model.languages == ["aa", "bb", "cc"]
    out = langid.predict(docs, model).toPandas()
    assert out.columns.tolist() == ["doc_id", "text", "lang", "lang_pred", "score"] and len(out) == len(rows)
    assert out.score.between(0, 1).all()
    known = out[out.lang.notna() & ~out.doc_id.isin([2000, 2001, 2002])]
    assert (known.lang == known.lang_pred).mean() > 0.97
    odd = out.set_index("doc_id")
    assert all(odd.loc[i].lang_pred == "und" and odd.loc[i].score == 0 for i in (2000, 2001, 2002))
    assert odd.loc[2003].lang_pred == "cc"
    # another partitioning gives the same sample and, up to rounding, the same model
    again = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).repartition(7), per_language=100)
    assert np.allclose(model.weights, again.weights, atol=1e-3)


@pytest.mark.parametrize("rows", [[], [(1, "abc", None, None)], [(1, None, "aa", None)]])
def test_nothing_to_learn(spark, rows):
    docs = ship(spark).createDataFrame(rows, DOCS)
    model = langid.train(docs)
    assert model.languages == []
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} <= {"und"}


def test_one_language(spark):
    docs = ship(spark).createDataFrame([(1, "abc", "aa", None), (2, "xyz", None, None)], DOCS)
    out = langid.predict(docs, langid.train(docs)).collect()
    assert {r["lang_pred"] for r in out} == {"aa"} and all(0 <= r["score"] <= 1 for r in out)


# 2 mixing of sources of few documents

def test_no_change_of_one_document_brings_a_small_source_nearer(spark, docs):
    rng = random.Random(6)
    rows = [(s * 100 + i, "w " * rng.choice([3, 40, 400, 2000]), f"s{s:02d}") for s in range(12) for i in range(rng.randrange(1, 11))]
    rows += [(9000 + i, "w " * 7, "s03") for i in range(2)] + [(9000, "w " * 7, "s03"), (9500, None, "s04"), (None, "w w", "s05")]
    got = mixing.mix_sources(docs(rows)).collect()
    assert sum(r["n"] for r in got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        target = own[0]["target"]
        miss = target - sum(r["size"] * r["n"] * r["copies"] for r in own)
        steps = [d * r["size"] * r["n"] for r in own for d in (-2, -1, 1, 2) if 0 <= r["copies"] + d <= 2]
        assert abs(miss) <= mixing.TOLERANCE * target or all(abs(miss - a) >= abs(miss) - 1e-9 for a in steps)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs(rows[::-1]).repartition(5)).collect()))
