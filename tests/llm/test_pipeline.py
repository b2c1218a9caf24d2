"""The registered queries and the pipeline's stages on the driver tables."""

import collections
import re

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F
from test_operators import WORD, brute_components, filled

import corpus_pipeline
from weft.llm import quality
from weft.llm.common import materialize, read
from weft.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_agrees_with_sql(spark, sf_dir, name):
    fn, sql = QUERIES[name]
    assert differences(fn(spark, sf_dir), connect(sf_dir), sql) is None


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage takes and gives."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    docs, out = read(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, sf_dir), name)
        out[name] = docs.toPandas(), made.toPandas()
        assert name == "byte_level_bpe" or made.columns == docs.columns
        docs = made
    return out


def test_quality_keeps_clean_documents(stages, spark, sf_dir):
    before, after = stages["quality_classifier"]
    labels = read(spark, sf_dir, "labels").where(quality.held_out(F.col("doc_id"))).toPandas().set_index("doc_id").quality
    kept = set(after.doc_id)
    clean = [d for d in before.doc_id if labels.get(d) == 1]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)
    assert len(after) < len(before)


def test_lines_go_and_texts_stay(stages):
    before, after = stages["line_dedup"]
    texts = dict(zip(before.doc_id, before.text, strict=True))
    carriers = collections.defaultdict(set)
    for d, t in zip(after.doc_id, after.text, strict=True):
        lines = (texts[d] or "").split("\n")
        assert all(line in lines for line in (t or "").split("\n") if line)
        for line in set((t or "").split("\n")):
            if len(WORD.findall(line)) > 3:
                carriers[line].add(d)
    assert max(map(len, carriers.values())) < 10


def test_one_of_each_component_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    want = brute_components(list(zip(before.doc_id, before.text, strict=True)))
    assert sorted(after.doc_id) == sorted(d for d, (n, c) in want.items() if n == 0 or c == d)


def test_mix_meets_targets(stages):
    before, after = stages["mix_sources"]
    count = lambda frame: collections.Counter(
        {s: sum(len(WORD.findall(t or "")) for t in own.text) for s, own in frame.groupby("source")})
    sizes, taken = count(before), count(after)
    for s, target in filled(dict(sizes)).items():
        assert abs(taken[s] - target) <= max(200, 0.02 * target)
    assert after.doc_id.value_counts().max() <= 2


def test_tokens_stand_for_the_text(stages):
    import public_tokenizers

    from weft.llm.bpe import Vocabulary

    before, after = stages["byte_level_bpe"]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        vocab = Vocabulary(f.read())
    back = collections.Counter((d, vocab.decode(list(ids)).decode()) for d, ids in zip(after.doc_id, after.ids, strict=True))
    assert back == collections.Counter((d, t or "") for d, t in zip(before.doc_id, before.text, strict=True))
    assert (after.n_tokens == after.ids.map(len)).all()


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, docs, sf_dir, number):
    _, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, docs([]), sf_dir).count() == 0
    odd = docs([(1, None), (2, ""), (None, "a b"), (3, "x " * 50_000), (4, "\n"), (4, "\n")])
    assert stage(spark, odd, sf_dir).count() <= 12


def test_nothing_else_imports_the_package():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for f in (root / "weft").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"weft\.llm|corpus_pipeline", f.read_text()), f
