"""Every operator against a plain version of it, on small tables with nulls, ties, repeats and very long texts."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import bpe, chains, common, exact, jaccard, kernels, mixing, neighbours, pseudo, quality, queries, templates, warc
from weft.sources.workspace import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# kernels

def test_words_and_hashes():
    texts = ["Ab  c\n\td é Ab c", None, "", " ", "x" * 5, "\x0b\x0c\r", "a\x1cb \x85"]
    for lo, hi, w in kernels.text_runs(pa.array(texts), 8):
        for i in range(hi - lo):
            own = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[i]:w.first[i + 1]],
                                                             w.end[w.first[i]:w.first[i + 1]], strict=True)]
            assert own == WORD.findall(texts[lo + i] or "")
    (_, _, w), = kernels.text_runs(pa.array(["ABC abc abd", "abc"]))
    h = w.hashes()
    assert h[0] == h[1] == h[3] != h[2]
    assert w.hashes(lower=False)[0] != h[0]


# shared steps

def test_attach_serves_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(1,)] * 3000 + [(None,)] * 5 + [(k,) for k in range(2, 3000)], "k long")
    table = common.materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "v", F.coalesce("k", F.lit(-1)) * 10))
    got = common.attach(rows, table, ["k"], "n")
    assert got.count() == rows.count()
    assert got.where("v is null or v <> coalesce(k, -1) * 10").count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    links += [(500, i) for i in range(501, 560)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {a: find(a) for link in links for a in link if a not in alone}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 nearest neighbours

def vectors(spark, rows):
    return common.ship(spark).createDataFrame(rows, T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("score", T.StringType())]))


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[:900] = x[0] + 0.01 * rng.normal(size=(900, 16))  # a crowd
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], "s") for i in range(3000)]
    got = neighbours.nearest(vectors(spark, rows), F.col("id") % 20 == 0).toPandas()
    s = x.astype(float)[::20] @ x.astype(float).T
    s[np.arange(len(s)), np.arange(0, 3000, 20)] = -np.inf
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in own.vec_id.tolist()
        assert np.allclose(own.score, s[q // 20][own.vec_id]) and (np.diff(own.score) <= 0).all()
        hits += len(set(np.argsort(-s[q // 20], kind="stable")[:20]) & set(own.vec_id))
    assert got.query_id.nunique() == 150 and hits >= 0.9 * 3000


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"),
            (5, [float("nan"), 1.0], "a"), (6, [float("inf"), 1.0], "a"), (7, [1.0, None], "a"), (8, [1.0], "a"),
            (None, [1.0, 1.0], "a"), (40, [3.0, 1.0], None)]
    got = neighbours.nearest(vectors(spark, rows), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (0, 1, 40, 3.0), (0, 2, 1, 2.0), (0, 3, 2, 2.0), (40, 1, 1, 6.0), (40, 2, 2, 6.0), (40, 3, 0, 3.0)]
    assert neighbours.nearest(vectors(spark, []), F.col("id") % 20 == 0).count() == 0


def test_queries_are_sent_to_blocks_in_bounded_batches():
    count = np.array([3, 40_000, 1_000_000, 0, 512])
    blocks = neighbours.block_counts(count)
    assert blocks.tolist() == [1, 64, 123, 1, 1]
    vec = pa.array([[float(i), 1.0] for i in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), vec, pa.array([None] * 300, pa.float64())], ["id", "vec", "bound"])
    row, visited = np.repeat(np.arange(300), 3), np.tile([2, 0, 1], 300)
    for most in (50, 4_096):
        made = list(neighbours.to_blocks(batch, row, visited, blocks, most))
        assert max(b.num_rows for b in made) <= most
        got = [(r["id"], r["vec"][0], r["part"], r["block"]) for b in made for r in b.to_pylist()]
        assert got == [(i, float(i), p, n) for i in range(300) for p in (2, 0, 1) for n in range(blocks[p])]
    assert list(neighbours.to_blocks(batch, row[:0], visited[:0], blocks, 10)) == []


def test_wide_blocks_find_the_same(spark, docs, monkeypatch):
    rng = np.random.default_rng(19)
    docs([])
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 6)))], "vec_id long, embedding array<double>")
    got = {}
    for block, most in ((512, 4_096), (16, 7)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "SENT", most)
        got[block] = sorted(map(tuple, neighbours.nearest(made, F.col("id") % 9 == 0, k=5, parts=4).collect()))
    assert len(got[16]) == 500 and got[16] == got[512]


# 2 mixing

def filled(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, docs, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([1, 5, 20, 60, 300])), rng.choice(["a", "b", "é", None, "z"] + ["hot"] * 5))
            for i in range(1500)] + [(9000, None, "a"), (9001, "", "empty"), (None, "x y", "b")]
    rows += [(9100, "same row", "z")] * 3
    frame = docs(rows)
    got = mixing.mix_sources(frame, seed=seed).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    want, taken = filled(dict(sizes)), collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["n"] * r["copies"]
    assert sum(r["n"] for r in got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) < 300  # the longest document
    again = mixing.mix_sources(frame.repartition(3), seed=seed).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_gives_each_document_its_chance(spark, docs):
    rng = random.Random(3)
    frame = docs([(i, prose(rng, 5 + i % 40), "ab"[i % 2]) for i in range(700)])
    sums, p = collections.Counter(), None
    for seed in range(4):
        for r in mixing.mix_sources(frame, seed=seed).collect():
            sums[r["source"]] += r["copies"]
            p = p or {}
            p[r["source"]] = r["target"] / r["source_size"]
    for s, total in sums.items():
        assert abs(total / (4 * 350) - p[s]) < 0.08


def test_mix_of_nothing(spark, docs):
    assert mixing.mix_sources(docs([])).count() == 0
    assert [r["copies"] for r in mixing.mix_sources(docs([(1, None), (2, "")])).collect()] == [0, 0]
    one = mixing.mix_sources(docs([(1, "a b c")])).collect()
    assert one[0]["target"] == 4.5 and one[0]["copies"] in (1, 2)


def test_mix_plan_has_no_python(spark, docs):
    from plans import plan_of

    assert not re.search("Python|Pandas|Arrow", plan_of(mixing.mix_sources(docs([(1, "a b"), (2, "c")]))))


# 3 line templates

def test_templates_drop_what_recurs(spark, docs):
    rng = random.Random(5)
    rows = [(i, f"{prose(rng, 12, 10 ** 9)}\nPage {i} of {i + 7}\nRead more about wq{'abcdefghijklmnop'[i % 16]} in our shop today\n\n"
                f"{prose(rng, 9, 10 ** 9)}") for i in range(30)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "Page 3 of 4"), (103, "one line of its own")]
    got = {r["doc_id"]: r for r in templates.drop_template_lines(docs(rows)).collect()}
    for i in range(1, 30):
        assert got[i]["n_lines"] == 5 and "Page" not in got[i]["text"]
        assert got[i]["text"].count("\n") == 4 - got[i]["n_dropped"]
    assert got[0]["text"] == rows[0][1] and got[0]["n_dropped"] == 0  # the first keeps what recurs
    assert got[100]["text"] is None and got[101]["text"] == "" and got[102]["text"] == "\n\n"
    assert got[None]["text"] == "" and got[103]["n_dropped"] == 0
    assert templates.drop_template_lines(docs([])).count() == 0


def test_templates_leave_rare_lines(spark, docs):
    rows = [(i, "alpha beta gamma delta\nonly here " + "x" * i) for i in range(9)]
    assert templates.drop_template_lines(docs(rows)).agg(F.sum("n_dropped")).first()[0] == 0


# 4 exact copies

def test_perfect_hash_has_every_slot_once():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 5000):
        digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        pilots, slot = exact.build_table(digests)
        assert sorted(slot.tolist()) == list(range(n))
        assert (exact.find_slots(digests, pilots, n) == slot).all()
    stranger = rng.integers(0, 256, (100, 32), dtype=np.uint8)
    at = exact.find_slots(stranger, pilots, n)
    assert ((at >= 0) & (at < n)).all()


def test_exact_copies(spark, docs):
    rng = random.Random(6)
    texts = [None, "", "a", "A", "a ", "b" * 100_000] + [f"t{i}" for i in range(40)]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(1000 + i, "hot") for i in range(300)] + [(None, "a"), (None, "nul")]
    frame = docs(rows).select("doc_id", exact.text_digest(F.col("text")).alias("digest"),
                              F.coalesce(F.col("doc_id") < 200, F.lit(False)).alias("historical"))
    got = exact.exact_duplicates(common.materialize(frame), shard_digests=7).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).digest()].append(i)
    assert len(got) == len(rows)
    for r in got:
        own = groups[bytes(r["digest"])]
        keep = max((i for i in own if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep)
    empty = frame.where("false")
    assert exact.exact_duplicates(common.materialize(empty)).count() == 0


# 5 Jaccard join

def brute_components(rows, percent=80):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, docs, seed):
    rng = random.Random(seed)
    rows, common_part = [], prose(rng, 60, 50)
    bases = [prose(rng, rng.choice([6, 20, 80, 200])) for _ in range(25)]
    for i in range(220):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        if rng.random() < 0.3:
            w += common_part.split()[:rng.randrange(60)]
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "a"), (505, "x " * 3000), (506, " \n")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard.similar_documents(docs([*rows, (None, "a b")])).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute_components(rows)


def test_jaccard_of_nothing(spark, docs):
    assert jaccard.similar_documents(docs([])).count() == 0
    assert jaccard.similar_documents(docs([(1, None)])).collect()[0]["component_id"] == 1


def test_sketches_never_hide_shingles():
    rng = np.random.default_rng(3)
    for n, m in ((10, 12), (100, 90), (300, 700)):
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[:n // 2], rng.integers(0, 2 ** 63, m).astype(np.uint64)]))
        true = len(np.intersect1d(a, b))
        assert true <= jaccard.most_common(len(a), jaccard.sketch(a), len(b), jaccard.sketch(b)) <= min(len(a), len(b))


def test_jaccard_near_misses_are_not_dealt_as_pairs(spark, docs, monkeypatch):
    """Copies with three changed words each are below the threshold of each other, and their sketches say so."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(8, 140, 6), 3):
            w[at] = f"e{rng.randrange(10 ** 9)}"
        rows.append((i, " ".join(w)))
    dealt, linked = [], jaccard.Verifier.linked

    def counted(self, pairs):
        dealt.append(pairs.count())
        return linked(self, pairs)

    monkeypatch.setattr(jaccard.Verifier, "linked", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs(rows)).collect()}
    assert got == brute_components(rows)
    assert dealt[-1] < len(rows)


def test_bucket_hits_are_exact_in_a_byte_per_bucket():
    rng = np.random.default_rng(4)
    hits, plain = jaccard.BucketHits(), collections.Counter()
    for _ in range(50):
        drawn = np.concatenate([rng.integers(0, 40, 700), rng.integers(0, 1 << 24, 300)]).astype(np.uint64)
        plain.update(drawn.tolist())
        hits.add(*np.unique(drawn, return_counts=True))
    at, often = hits.frequent()
    assert dict(zip(at.tolist(), often.tolist(), strict=True)) == {b: n for b, n in plain.items() if n >= jaccard.FREQUENT_LEAST}
    assert hits.low.nbytes == 1 << jaccard.BUCKET_BITS


# 6 quality

def test_quality_learns_a_planted_rule(spark, docs):
    rng = random.Random(7)
    rows = [(i, prose(rng, 40) + (" | spam | " + prose(rng, 3) if i % 4 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(3, 0), (401, None), (None, 1)],
                                   "doc_id long, quality int")
    frame = docs([*rows, (700, None), (701, ""), (None, "x")])
    model = quality.train(frame, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(frame, model).collect()}
    test = range(400, 600)
    right = sum((got[i] >= 0.5) == (i % 4 != 0) for i in test)
    assert right >= 195 and all(0 <= s <= 1 for s in got.values())
    assert got[700] == got[701]
    assert np.array_equal(model, quality.train(frame.repartition(5), labels))


def test_quality_without_labels(spark, docs):
    frame, labels = docs([(1, "a b")]), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(frame, quality.train(frame, labels)).collect()[0]["score"] == pytest.approx(0.5)
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score(frame, quality.train(frame, one)).collect()[0]["score"] == pytest.approx(0.75)
    assert quality.score(docs([]), quality.train(docs([]), labels)).count() == 0


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


# 7 WARC

def test_archive_round_trip(spark):
    big = "é<p>" * 30_000
    rows = [(1, "http://a", "<html>x"), (2, "http://b", "<html>x"), (3, None, None), (4, "u\r\nX: y", ""), (5, "v", big),
            (6, "w", big), (7, "z", "WARC/1.0\r\nContent-Length: 3\r\n\r\n0\r\n\r\n"), (None, "n", "<html>x"), (-8, "m", "neg")]
    pages = common.ship(spark).createDataFrame(rows, "page_id long, url string, html string")
    path = f"{shared_folder(spark)}/archive-{random.random()}"
    warc.write_archive(pages, path, segment_bytes=1000)
    kinds = {r["record_type"] for r in warc.read_records(spark, path).select("record_type").collect()}
    assert kinds == {"response", "revisit", "continuation"}
    got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        body = (html or "").encode()
        alike = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        r = got[page_id]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["payload_bytes"] == len(body) and r["complete"]
        if page_id == max(alike):
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, body)
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", max(alike), None)


def test_small_payloads_are_all_responses(spark):
    pages = common.ship(spark).createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "xx"), (4, "d", "xx")],
                                               "page_id long, url string, html string")
    path = f"{shared_folder(spark)}/archive-{random.random()}"
    warc.write_archive(pages, path, least_bytes=2)
    got = {r["page_id"]: r["record_type"] for r in warc.read_archive(spark, path).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_archive(spark):
    path = f"{shared_folder(spark)}/archive-{random.random()}"
    warc.write_archive(common.ship(spark).createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_chunked_framing():
    for body in (b"", b"a", b"0\r\n\r\n", bytes(range(256)) * 40):
        assert warc.unchunked(warc.chunked(body, 7)) == body
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: u\r\n\r\n") == b"abc"
    assert warc.response_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"


# 8 passages

def test_passages_are_found_and_clean_texts_left(spark, docs):
    rng = random.Random(8)
    fresh = lambda n: prose(rng, n, 10 ** 7)
    passage = fresh(70)
    changed = passage.split()
    changed[20], changed[45] = "new", "words"
    rows = [(1, f"{fresh(100)} {passage} {fresh(50)}"), (2, f"{fresh(30)} {' '.join(changed)} {fresh(20)}"),
            (3, passage.upper()), (4, f"{fresh(10)} {' '.join(passage.split()[:30])} {fresh(80)}"), (5, fresh(400)), (6, None),
            (7, ""), (None, passage), (8, fresh(9))]
    rows += [(100 + i, f"{fresh(20 + i)} {passage}") for i in range(60)]
    got = chains.shared_passages(docs(rows)).toPandas()
    assert set(got.doc_id) | set(got.match_doc_id) == {1, 2, 3, *range(100, 160)}
    assert len(got) <= 4 * len(rows)
    one = got[(got.doc_id == 3)].iloc[0]
    assert (one.end - one.start) >= 65 and one.agree >= 65
    two = got[got.doc_id == 2].iloc[0]
    assert (two.match_doc_id, two.start, two.end, two.match_start, two.match_end, two.agree) == (1, 30, 100, 100, 170, 68)
    assert chains.shared_passages(docs([])).count() == 0


def test_every_pair_of_a_list_meets_when_asked(spark, docs):
    rng = random.Random(13)
    passage = prose(rng, 70, 10 ** 7)
    rows = [(i, f"{prose(rng, 10 + i, 10 ** 7)} {passage} {prose(rng, 15, 10 ** 7)}") for i in range(1, 8)]
    pairs = lambda **more: {(r["doc_id"], r["match_doc_id"]) for r in chains.shared_passages(docs(rows), **more).collect()}
    assert pairs(every=True) == {(a, b) for a in range(1, 8) for b in range(1, a)}
    assert (4, 2) not in pairs()
    found = spark.createDataFrame([(s, d, 3 * d + s) for s in range(3) for d in range(4 * s + 2)], "seed long, doc_id long, place int")
    for cell in (1, 3, 256):
        got = sorted(map(tuple, chains.all_meetings(found, cell).collect()))
        assert got == sorted((a, b, 3 * a + s, 3 * b + s) for s in range(3) for a in range(4 * s + 2) for b in range(a))


def test_query_compares_every_two_documents_that_share_seeds(spark, docs, tmp_path):
    rng = random.Random(16)
    fresh = lambda n: prose(rng, n, 10 ** 7)
    passage = fresh(70)
    docs([(i, f"{fresh(10 + i)} {passage} {fresh(15)}") for i in range(1, 9)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_shared_passages(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["match_doc_id"]) for r in got} == {(a, b) for a in range(1, 9) for b in range(1, a)}


def test_one_shared_seed_is_enough_where_the_texts_go_on_alike(spark, docs):
    rng = random.Random(17)
    fresh = lambda n: prose(rng, n, 10 ** 7).split()
    rows, wanted = [], set()
    for n in range(12):
        passage = fresh(60)
        changed = list(passage)
        for at in [*range(4, 24, 6), *range(39, 60, 6)]:  # only words 23 to 38 are alike in a row
            changed[at] = "other"
        rows += [(2 * n + 1, " ".join(fresh(20) + passage + fresh(20))), (2 * n + 2, " ".join(fresh(9) + changed + fresh(30)))]
        wanted.add((2 * n + 2, 2 * n + 1))
    made = docs(rows)
    found = chains.seeds(made)
    points = chains.all_meetings(found).groupBy("a", "b").count().collect()
    alone = {(r["a"], r["b"]) for r in points if r["count"] == 1}
    assert alone and alone <= wanted
    got = {(r["doc_id"], r["match_doc_id"]): r for r in chains.shared_passages(made, every=True).collect()}
    assert alone <= set(got) <= wanted
    assert all(r["agree"] >= 0.8 * (r["end"] - r["start"]) and r["end"] - r["start"] >= 50 for r in got.values())


def test_words_beside_seeds_go_on_as_extend_says():
    rng = random.Random(18)
    text = [[rng.randrange(4) for _ in range(chains.REACH)] for _ in range(600)]
    other = [[w if rng.random() < 0.8 else rng.randrange(4) for w in t] for t in text]
    other = [t[:n] + t[n + 1:] + [5] if rng.random() < 0.5 else t for t in other for n in [rng.randrange(20)]]
    want = [max(chains._extend(a, b)[:2]) for a, b in zip(text, other, strict=True)]
    assert chains.go_on(np.array(text, np.uint8), np.array(other, np.uint8)).tolist() == want
    h = kernels.mix(np.arange(1, 60, dtype=np.uint64))
    before, behind = chains.beside(h, np.array([0, 3, 49]), 7)
    assert (before[1][:3] == (h[:3] >> np.uint64(56))[::-1]).all() and (behind[0] == h[10:42] >> np.uint64(56)).all()
    assert (before[2] == (h[17:49] >> np.uint64(56))[::-1]).all() and behind.shape == (3, chains.REACH)
    assert (chains.beside(h, np.array([0]), 8)[0] != before[0]).any()


def test_common_length_against_dynamic_programme():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert chains.common_length(a, b) == t[-1][-1]


def test_chain_is_collinear():
    x, y = np.array([0, 5, 9, 20, 30, 31]), np.array([100, 105, 109, 50, 130, 131])
    best = next(chains.chain(x, y))
    assert best == [0, 1, 2, 4, 5]
    everything = [i for c in chains.chain(x, y) for i in c]
    assert sorted(everything) == list(range(6))


def test_unlike_middles_do_not_cost_the_passages_around_them(spark, docs):
    rng = random.Random(11)
    fresh = lambda n: prose(rng, n, 10 ** 7)
    one, two, three = fresh(60), fresh(60), fresh(400)
    rows = [(1, f"{fresh(20)} {one} {fresh(200)} {two} {fresh(20)}"), (2, f"{fresh(40)} {one} {fresh(230)} {two} {fresh(5)}"),
            (11, f"{three} {fresh(500)} {one}"), (12, f"{three} {fresh(480)} {one}")]
    got = {(r["doc_id"], r["match_doc_id"], r["start"], r["end"], r["match_start"], r["match_end"], r["agree"])
           for r in chains.shared_passages(docs(rows)).collect()}
    assert {(2, 1, 40, 100, 20, 80, 60), (2, 1, 330, 390, 280, 340, 60)} <= got
    assert {(12, 11, 0, 400, 0, 400, 400), (12, 11, 880, 940, 900, 960, 60)} <= got


def test_cut_chain_keeps_the_longest_run_that_passes():
    rng = random.Random(12)
    new = iter(range(10 ** 6))
    same = [next(new) for _ in range(200)]
    # two runs of 40 words pass together over 15 other words, and neither alone; a third lies too far off
    one = same[:40] + [next(new) for _ in range(15)] + same[40:80] + [next(new) for _ in range(90)] + same[80:120]
    two = same[:40] + [next(new) for _ in range(15)] + same[40:80] + [next(new) for _ in range(90)] + same[80:120]
    xs = sorted(rng.sample(range(0, 30), 4)) + [56, 70, 85] + [186, 200]
    assert chains.align(one, two, xs, xs) == [(0, 95, 0, 95, 80)]


# 9 language model

def test_pseudo_likelihood_prefers_what_it_has_seen(spark, docs):
    rng = random.Random(10)
    pattern = ["red green blue", "one two three", "north south east"]
    rows = [(i, " ".join(rng.choice(pattern) for _ in range(60))) for i in range(300)]
    odd = " ".join(rng.sample("red green blue one two three north south east".split() * 20, 180))
    frame = docs([*rows, (1000, odd), (1001, None), (1002, ""), (1003, "red"), (None, "one two three")])
    model = pseudo.train(docs(rows).coalesce(1))  # one copy sees enough of so small a corpus
    got = {r["doc_id"]: r for r in pseudo.score(frame, model).collect()}
    assert all(got[i]["mean_log_prob"] > got[1000]["mean_log_prob"] + 0.5 for i in range(300))
    assert got[1001]["log_prob"] == got[1002]["log_prob"] == 0.0 and got[1001]["n_words"] == 0
    assert got[1003]["n_words"] == 1 and got[0]["log_prob"] == pytest.approx(180 * got[0]["mean_log_prob"])
    assert pseudo.score(docs([]), pseudo.train(docs([]))).count() == 0


@pytest.mark.parametrize("near", [0, 900, 1 << 16])
def test_rare_words_have_probabilities_of_their_own(spark, docs, monkeypatch, near):
    monkeypatch.setattr(pseudo, "NEAR", near)
    rng = random.Random(13)
    often = {f"w{i}": 1 + 3000 // (i + 1) for i in range(2500)}
    every = [w for w, n in often.items() for _ in range(n)]
    rng.shuffle(every)
    model = pseudo.train(docs([(i, " ".join(every[i::100])) for i in range(100)]))
    rows = [*enumerate(often), (5000, "never"), (5001, "never"), (5002, "seen w2000 never W2000 w1"), (5003, None)]
    got = {r["doc_id"]: r for r in pseudo.score(docs(rows), model).collect()}
    assert len(got) == len(rows) and got[5003]["log_prob"] == 0
    # of one place without neighbours: all words that were seen, and per shared number what is kept for the others
    seen = sum(np.exp(got[i]["log_prob"]) for i in range(2500))
    numbers = np.arange(pseudo.VOCABULARY, dtype=np.int32)
    each = np.exp(pseudo.log_probabilities(model.net, numbers, np.full((len(numbers), 2 * pseudo.WINDOW), pseudo.OUTSIDE)))
    assert seen + (each / (model.shared + 1))[pseudo.TOP:].sum() == pytest.approx(1.0, abs=1e-3)
    word = np.array([kernels.Words(np.frombuffer(b"never", np.uint8), np.array([0, 5])).hashes()[0]])
    number = int(pseudo.numbers(word, model.known, model.place)[0])
    assert got[5000]["log_prob"] == got[5001]["log_prob"] == pytest.approx(np.log(each[number] / (model.shared[number] + 1)), abs=1e-3)


def test_probabilities_sum_to_one_and_ignore_the_place_itself():
    net = pseudo.new_network()
    ids = np.array([3, 70, 900, 5, 6], np.int32)
    context = pseudo.contexts(ids, np.array([0, 5]))
    assert (context[2] == [pseudo.OUTSIDE, 3, 70, 5, 6, pseudo.OUTSIDE]).all()
    every = np.arange(pseudo.VOCABULARY, dtype=np.int32)
    lp = pseudo.log_probabilities(net, every, np.repeat(context[2:3], len(every), 0))
    assert np.exp(lp).sum() == pytest.approx(1.0, abs=1e-3)


def test_row_maxima_and_probabilities_by_hand():
    rng = np.random.default_rng(14)
    z = rng.normal(size=(7, pseudo.BASE)).astype(np.float32)
    assert (pseudo.row_max(z) == z.max(1, keepdims=True)).all() and pseudo.row_max(z[:0]).shape == (0, 1)
    net = pseudo.new_network()
    context, high = rng.integers(0, pseudo.OUTSIDE + 1, (7, 2 * pseudo.WINDOW)).astype(np.int32), np.arange(7, dtype=np.int32)
    x, h, g, p, q = pseudo.forward(net, context, high)
    assert (x == net[0][context].reshape(7, -1)).all() and (g == np.tanh(h + net[5][high])).all()
    for got, logits in ((p, h @ net[3] + net[4]), (q, g @ net[6] + net[7])):
        e = np.exp(logits - logits.max(1, keepdims=True))
        assert (got == e / e.sum(1, keepdims=True)).all()


def test_row_sums_and_steps_by_hand():
    """The sums of short rows have numpy's bits, and a step over all weights at once those of a step by each array."""
    rng = np.random.default_rng(15)
    z = rng.exponential(size=(700, pseudo.BASE)).astype(np.float32)
    assert (pseudo.row_sums(z) == z.sum(1, keepdims=True)).all() and pseudo.row_sums(z[:0]).shape == (0, 1)
    ids = rng.integers(0, pseudo.VOCABULARY, 1300).astype(np.int32)
    context = pseudo.contexts(ids, np.array([0, 900, 900, 1300]))
    trainer = pseudo.Trainer(pseudo.new_network(), 0.01)
    assert all(np.shares_memory(trainer.flat, a) for a in trainer.net)
    trainer.learn(ids, context)
    net = pseudo.new_network()
    square = [np.full_like(a, 1e-6) for a in net]
    for lo in range(0, len(ids), pseudo.BLOCK):
        own, around = ids[lo:lo + pseudo.BLOCK], context[lo:lo + pseudo.BLOCK]
        n, high, low, row = len(own), own // pseudo.BASE, own % pseudo.BASE, np.arange(len(own))
        x, h, g, p, q = pseudo.forward(net, around, high)
        p[row, high] -= 1
        q[row, low] -= 1
        p /= n
        q /= n
        dg = (q @ net[6].T) * (1 - g * g)
        dh = (p @ net[3].T + dg) * (1 - h * h)
        dx = (dh @ net[1].T).reshape(-1, pseudo.WIDTH).astype(float)
        embedding = np.zeros(net[0].shape)
        np.add.at(embedding, around.reshape(-1), dx)
        digit = (high == np.arange(pseudo.BASE)[:, None]).astype(np.float32)
        grads = [embedding.astype(np.float32), x.T @ dh, dh.sum(0), h.T @ p, p.sum(0), digit @ dg, g.T @ q, q.sum(0)]
        for a, s, gr in zip(net, square, grads, strict=True):
            s *= 0.99
            s += 0.01 * gr * gr
            a -= 0.01 * gr / (np.sqrt(s) + 1e-6)
    assert trainer.seen == 1300 and all((a == b).all() for a, b in zip(trainer.net, net, strict=True))


# 10 tokens

@pytest.fixture(scope="module")
def vocab():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.Vocabulary(f.read())


def test_ids_equal_the_library(vocab):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rng = random.Random(11)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", "''", " ", "  ", "\n", "\t", " ", "　", "a", "b", "Z", "é",
             "ß", "1", "23", "٣", "Ⅷ", "!", "?!", "—", "😀", "漢", "l", "r", "v", "e", "s", "\x1c", "\x85", "\0", "​", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    texts += ["", " ", " " * 700, "a" * 3000, "ab" * 900 + " 'll", "word " * 2000, None, "<|endoftext|>"]
    at = 0
    for lo, hi, ids, begins in bpe.encode_runs(pa.array(texts), vocab):
        assert lo == at
        at = hi
        for text, x, starts in zip(texts[lo:hi], ids.to_pylist(), begins.to_pylist(), strict=True):
            assert x == own.encode_ordinary(text or "")
            assert vocab.decode(x) == (text or "").encode()
            assert starts == [sum(len(vocab.pieces[i]) for i in x[:n]) for n in range(len(x))][:len(starts)] if len(x) < 50 else True
    assert at == len(texts)


def test_scan_equals_one_pass():
    rng = random.Random(12)
    after, begins = bpe._automaton()
    for n in (1, 255, 256, 257, 3000):
        text = "".join(rng.choices("ab1! '\n\tséll", k=n)) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        borders = np.array([n])
        state, want = bpe.FRESH, []
        for i, s in enumerate(bpe._symbols(points, borders).tolist()):
            if begins[s, state]:
                want.append(i)
            state = after[s, state]
        assert bpe.piece_starts(points, borders).tolist() == want


def test_round_trip_with_clashing_columns(spark, docs):
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    frame = docs([(1, "It's 42 naïve   cafés\n\n"), (2, None), (3, "")]).withColumn("ids", F.lit("x")).withColumn("bytes", F.lit(1))
    back = bpe.decode(bpe.encode(frame, ranks), ranks)
    got = {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()}
    assert got == {1: "It's 42 naïve   cafés\n\n", 2: "", 3: ""} and "source" in back.columns
    assert bpe.encode(frame.where("false"), ranks).count() == 0
    broken = bpe.encode(frame, ranks).withColumn("offsets", F.transform("offsets", lambda x: x + 1))
    with pytest.raises(Exception, match="offsets do not fit"):
        bpe.decode(broken, ranks).collect()
