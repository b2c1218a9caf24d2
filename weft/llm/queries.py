"""The package's registered queries with their SQL equivalents, where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import (
    bpe,
    chains,
    exact,
    jaccard,
    langid,
    mixing,
    neighbours,
    prefix_trie,
    pseudo,
    quality,
    templates,
    warc,
    whitening,
)
from weft.llm.common import materialize, read
from weft.sources.workspace import shared_folder

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours.nearest(read(spark, sf, "embeddings"), F.col("id") % 20 == 0)


def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mixed = mixing.mix_sources(read(spark, sf, "documents").select("doc_id", "source", "text"))
    each = mixed.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                       "source", "copies")


def op3_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines whose template recurs."""
    return templates.drop_template_lines(read(spark, sf, "documents").select("doc_id", "text"))


OP3_SQL = f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
parts AS (SELECT doc_id, text, unnest(ls) AS line, unnest(range(0, len(ls))) AS place FROM raw),
masked AS (SELECT doc_id, text, place, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'),
    lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS words FROM parts),
lines AS (SELECT *, len(words) AS size, words[1:{templates.LEADING}] AS head FROM masked WHERE len(words) > 0),
leaves AS (SELECT size, head FROM lines GROUP BY ALL HAVING count(DISTINCT doc_id) >= {templates.MIN_DOCS}),
found AS (SELECT l.* FROM lines l JOIN leaves v ON l.size = v.size AND l.head = v.head),
d AS (SELECT size, head, words, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM found GROUP BY ALL),
placed AS (SELECT size, head, words, docs, unnest(words) AS word, unnest(range(0, size)) AS i FROM d),
known AS (SELECT size, head, i, word FROM placed WHERE word <> '<*>' GROUP BY ALL HAVING sum(docs) >= {templates.MIN_DOCS}),
marked AS (SELECT a.*, k.word IS NOT NULL AS fixed FROM placed a LEFT JOIN known k USING (size, head, i, word)),
t AS (SELECT size, head, words, list(CASE WHEN fixed THEN word ELSE '<*>' END ORDER BY i) AS template,
    count(*) FILTER (fixed) AS constants, count(*) FILTER (word = '<*>') AS fields FROM marked GROUP BY ALL),
good AS (SELECT d.*, t.template FROM t JOIN d USING (size, head, words) WHERE constants = size
    OR constants >= greatest({templates.CONSTANT} * size, {templates.LEAST_CONSTANT})
    OR (constants + fields = size AND constants >= {templates.MASKED} * size)),
rec AS (SELECT size, head, template, min(first) AS keeper FROM good GROUP BY ALL HAVING sum(docs) >= {templates.MIN_DOCS}),
gone AS (SELECT DISTINCT f.doc_id, f.place FROM found f JOIN good g USING (size, head, words)
    JOIN rec r USING (size, head, template) WHERE f.doc_id <> r.keeper),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.place) FILTER (g.place IS NULL) AS text,
    count(*) AS n_lines, count(g.place) AS n_dropped
    FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM raw r LEFT JOIN kept k USING (doc_id)"""


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents up to the middle of the ids are the history, the others arrive against it."""
    docs = read(spark, sf, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    past = F.coalesce(F.col("doc_id") <= ((low or 0) + (high or 0)) // 2, F.lit(False))
    rows = docs.select("doc_id", exact.text_digest(F.col("text")).alias("digest"), past.alias("historical"))
    out = exact.exact_duplicates(materialize(rows, "digests"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)"""


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """The component of every document under links of like shingle sets."""
    return jaccard.similar_documents(read(spark, sf, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents, learnt from the labelled ones outside the held-out fold."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    labels = read(spark, sf, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives, and what the archives give back."""
    path = f"{shared_folder(spark)}/weft/archive-{uuid.uuid4().hex}"
    warc.write_archive(read(spark, sf, "pages").select("page_id", "url", "html"), path)
    out = warc.read_archive(spark, path)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The 32 letters of base32 stand for five bits each: five hexadecimal digits give four letters.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS winner,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT) >> (5 * (3 - i % 4))) & 31)::INT + 1, 1)), 'string_agg', '')
        AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM d"""


def op8_shared_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of 50 words and more that documents share up to small changes, of every two documents that share seeds."""
    return chains.shared_passages(read(spark, sf, "documents").select("doc_id", "text"), every=True)


def op9_pseudo_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's log-probability under a model that sees both sides of each word."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return pseudo.score(docs, pseudo.train(docs))


def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, and the text that the ids give back."""
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    ids = bpe.encode(read(spark, sf, "documents").select("doc_id", "text"), ranks)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    back = bpe.decode(ids.select("doc_id", "ids", "offsets", F.size("ids").cast("long").alias("n_tokens"),
                                 digest.alias("ids_sha256")), ranks)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(read(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


#: The CRC is taken bit by bit: SQL has no function for it.
OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS origin, count(*) AS n, string_split(CAST(conv_id AS VARCHAR), '') AS digits
    FROM t GROUP BY conv_id),
c AS (SELECT conv_id, origin, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(digits,
        lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM ids),
m AS (SELECT c.conv_id, c.origin, c.h, least(c.h, coalesce(o.n, 0)) AS m FROM c LEFT JOIN c o ON o.conv_id = c.origin),
r AS (SELECT m.conv_id, t.pos AS depth, t.role, t.text FROM m JOIN t ON t.conv_id = m.origin AND t.pos <= m.m
    UNION ALL SELECT m.conv_id, t.pos - m.h + m.m, t.role, t.text FROM m JOIN t ON t.conv_id = m.conv_id AND t.pos > m.h),
s AS (SELECT m.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.depth) FILTER (r.depth IS NOT NULL), [])
    AS turns FROM m LEFT JOIN r ON r.conv_id = m.conv_id GROUP BY m.conv_id),
p AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM s),
n AS (SELECT depth, turns[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends
    FROM p GROUP BY depth, turns[1:depth]),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].text,
    '[^\x20\x09-\x0D]+')) END AS own FROM n),
kids AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT w.*, coalesce(k.n_children, 0) AS n_children FROM w LEFT JOIN kids k ON k.depth = w.depth AND k.prefix = w.prefix),
ups AS (SELECT unnest(range(0, depth + 1)) AS up, prefix, own, n_children FROM f),
sums AS (SELECT up AS depth, prefix[1:up] AS prefix, sum(own) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
    FROM ups GROUP BY up, prefix[1:up])
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN sums s ON s.depth = f.depth AND s.prefix = f.prefix
LEFT JOIN n u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.prefix = f.prefix[1:f.depth - 1]"""


def op12_whiten(spark: SparkSession, sf: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    out = whitening.whiten(read(spark, sf, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document, learnt from the documents outside the held-out fold."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_neighbours": (op1_neighbours, None),
    "op2_mix_sources": (op2_mix_sources, None),
    "op3_line_templates": (op3_line_templates, OP3_SQL),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op5_jaccard_join": (op5_jaccard_join, None),
    "op6_quality": (op6_quality, None),
    "op7_warc": (op7_warc, OP7_SQL),
    "op8_shared_passages": (op8_shared_passages, None),
    "op9_pseudo_likelihood": (op9_pseudo_likelihood, None),
    "op10_byte_bpe": (op10_byte_bpe, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_whiten": (op12_whiten, None),
    "op13_language": (op13_language, None),
}
