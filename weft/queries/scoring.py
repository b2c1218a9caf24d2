"""Scores of columns, accepted pair features, profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import gated as G
from weft.operators import profile as P
from weft.operators.encode import encode
from weft.operators.merge import merge_graph
from weft.operators.model import auc as auc_of
from weft.operators.model import auc_of_label_file
from weft.operators.pairs import PairFeatureModel
from weft.operators.scoring import hellinger_scores, mutual_info
from weft.operators.selection import drop_reported
from weft.operators.selection import feature_report as report_of
from weft.operators.selection import importance_cut as cut_of
from weft.queries import fixtures as X
from weft.sources.tables import read_label_column
from weft.sources.workspace import materialize, shared_folder

CATS = ("o_orderpriority", "customer__c_mktsegment", "customer__c_nationkey", "nation__n_name")
CODES = tuple(f"{c}_code" for c in CATS)
KEYED = ("o_custkey", *CATS)
SCORED = ("o_totalprice", "customer__c_acctbal", "lineitem__mean__l_quantity", "lineitem__sum__l_extendedprice",
          "lineitem__mean__l_tax", "part__mean__p_size", "part__union_length__p_names")
PROFILED = ("o_totalprice", "customer__c_acctbal", "lineitem__mean__l_quantity", "lineitem__sum__l_quantity",
            "lineitem__sum__l_extendedprice", "lineitem__sum__l_discount", "part__sum__p_size")


def _coded(spark: SparkSession, sf: str, cats: tuple[str, ...] = CATS) -> DataFrame:
    m = merge_graph(X.customer_graph(spark, sf)).select("o_orderkey", "label", *cats)
    return materialize(encode(m, {c: f"{c}_code" for c in cats}, ["o_orderkey"]), "coded")


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """The scored columns of the merged table, written once because scoring reads them twice."""
    return materialize(merge_graph(X.order_graph(spark, sf)).select("label", *SCORED), "merged")


def hellinger_score(spark: SparkSession, sf: str) -> DataFrame:
    return hellinger_scores(_merged(spark, sf), SCORED, "label")


def mutual_info_query(spark: SparkSession, sf: str) -> DataFrame:
    return mutual_info(_merged(spark, sf), SCORED, "label")


def fe_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The pair features accepted on the order table, with their scores."""
    model = PairFeatureModel.fit(_coded(spark, sf), CATS, "label", codes=CODES)
    rows = [(f.name, s) for f, s in zip(model.features, model.scores, strict=True)]
    return spark.createDataFrame(rows, "feature string, score double")


def count_enc_mi(spark: SparkSession, sf: str) -> DataFrame:
    df = _coded(spark, sf)
    model = G.gated_counts(df, CATS, "label", threshold=0.0)
    return model.transform(df, ["o_orderkey"]).select("o_orderkey", *[f.name for f in model.features])


def pair_count_mi(spark: SparkSession, sf: str) -> DataFrame:
    df = _coded(spark, sf)
    model = G.gated_pair_counts(df, CATS, CODES, "label", threshold=0.0)
    return model.transform(df, ["o_orderkey"]).select("o_orderkey", *[f.name for f in model.features])


#: The search of pair counts: pairs tried together, pairs tried in all, and the information that a count has to exceed.
SEARCH = {"batch": 2, "budget": 5, "threshold": 0.0015}


#: The information that a distinct count has to exceed.
NUNIQUE_THRESHOLD = 0.0002


def pair_count_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair that the best-first search tried, in its order, and whether it was kept."""
    _, trials = G.search_pair_counts(_coded(spark, sf), CATS, CODES, "label", **SEARCH)
    rows = [(t.feature.name, t.turn, t.batch, t.mi, t.accepted) for t in trials]
    return spark.createDataFrame(rows, "feature string, turn int, batch int, mi double, accepted boolean")


def pair_nunique_mi(spark: SparkSession, sf: str) -> DataFrame:
    """The better direction of each pair, where it tells enough, and the range its values were scaled by."""
    model = G.gated_pair_nuniques(_coded(spark, sf, KEYED), KEYED, [f"{c}_code" for c in KEYED], "label",
                                  threshold=NUNIQUE_THRESHOLD)
    rows = [(f.name, mi, *model.ranges[f.name]) for f, mi in zip(model.features, model.mi, strict=True)]
    return spark.createDataFrame(rows, "feature string, mi double, lo double, hi double")


def auc(spark: SparkSession, sf: str) -> DataFrame:
    out = auc_of(X.orders(spark, sf), "o_totalprice", "label")
    return out.select(F.round("auc", 9).alias("auc"))


def auc_file(spark: SparkSession, sf: str) -> DataFrame:
    """The same area with the labels read back from a file of lines, by position."""
    o = X.orders(spark, sf)
    path = f"{shared_folder(spark)}/weft/labels-{uuid.uuid4().hex}"
    by_id = o.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    by_id.select(F.col("label").cast("string").alias("value")).write.text(path)
    scores = o.select("o_orderkey", F.col("o_totalprice").alias("score"))
    out = auc_of_label_file(scores, "o_orderkey", read_label_column(spark, path, header=False))
    return out.select(F.round("auc", 9).alias("auc"))


def _wide_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """The merged table before the final fill: orders without lines have nulls."""
    return merge_graph(X.order_graph(spark, sf), fill="none").withColumn("constant", F.lit(1.0))


def profile_missing(spark: SparkSession, sf: str) -> DataFrame:
    return P.missing_fractions(_wide_with_nulls(spark, sf), [*PROFILED, "constant"])


def profile_single_unique(spark: SparkSession, sf: str) -> DataFrame:
    return P.single_unique(_wide_with_nulls(spark, sf), [*PROFILED, "constant"])


def collinear(spark: SparkSession, sf: str) -> DataFrame:
    m = merge_graph(X.order_graph(spark, sf))
    out = P.collinear(m, PROFILED, 0.5)
    return out.select("corr_feature", "drop_feature", F.round("corr_value", 9).alias("corr_value"))


def feature_report(spark: SparkSession, sf: str) -> DataFrame:
    columns = [*PROFILED, "constant"]
    wide = materialize(_wide_with_nulls(spark, sf).select(*columns), "wide")
    return report_of(wide, columns, PROFILED, missing_threshold=0.01, correlation_threshold=0.9)


def _informative(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The profiled columns with the label, and each one's information as its importance."""
    columns = [*PROFILED, "constant"]
    wide = materialize(_wide_with_nulls(spark, sf).select("label", *columns), "wide")
    return wide, materialize(mutual_info(wide, columns, "label").withColumnRenamed("mi", "importance"), "importances"), columns


def importance_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised and cumulative importance of the profiled columns."""
    cut = cut_of(_informative(spark, sf)[1])
    return cut.select("feature", "importance", *[F.round(c, 9).alias(c) for c in ("normalized", "cumulative")],
                      "zero_importance", "low_importance")


def feature_report_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every reason to drop a column, and the columns that are left once the reported ones are dropped."""
    wide, importances, columns = _informative(spark, sf)
    report = materialize(report_of(wide, columns, PROFILED, missing_threshold=0.01, correlation_threshold=0.9,
                                   importances=importances), "report")
    left = [(c, "kept") for c in drop_reported(wide, report).columns if c != "label"]
    return report.unionByName(spark.createDataFrame(left, "feature string, reason string"))


_COUNTS_SQL = """r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v GROUP BY feature),
 b AS (SELECT feature, CASE WHEN hi > lo THEN least(63, CAST(floor((value - lo) / (hi - lo) * 64) AS INTEGER)) ELSE 0
 END AS bin, sum(pos) AS pos, sum(neg) AS neg FROM v JOIN r USING (feature) GROUP BY 1, 2),
 t AS (SELECT feature, sum(pos) AS p_all, sum(neg) AS n_all FROM b GROUP BY feature)"""

_HELLINGER_SQL = """SELECT feature, CASE WHEN min(p_all) = 0 OR min(n_all) = 0 THEN -1.0 ELSE
 round(sqrt(sum((sqrt(pos / p_all) - sqrt(neg / n_all)) ** 2)) / sqrt(2.0), 9) END AS score
 FROM b JOIN t USING (feature) GROUP BY feature"""


def _mi_term(n: str, n_all: str) -> str:
    return (f"CASE WHEN {n} > 0 THEN {n} / (p_all + n_all) * ln(({n} / (p_all + n_all)) / "
            f"((pos + neg) / (p_all + n_all) * ({n_all} / (p_all + n_all)))) ELSE 0 END")


_MI_SQL = f"""SELECT feature, round(sum({_mi_term('pos', 'p_all')} + {_mi_term('neg', 'n_all')}), 9) AS mi
 FROM b JOIN t USING (feature) GROUP BY feature"""


def _long_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, label AS pos, 1 - label AS neg FROM {table}"
        for c in columns)


_CODED_SQL = f"""m0 AS ({X.CUSTOMER_MERGED_SQL}), m AS (SELECT o_orderkey, label, {', '.join(KEYED)}, """ + ", ".join(
    f"dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) AS {k}" for c, k in zip(CATS, CODES, strict=True)) + " FROM m0)"


def _candidates_sql() -> str:
    """Every candidate's (feature, value, pos, neg) on the rows."""
    out = [f"""SELECT 'fe_count__{c}' AS feature, CAST(count(*) OVER (PARTITION BY {c}) AS DOUBLE) AS value,
 label AS pos, 1 - label AS neg FROM m""" for c in CATS]
    cats = sorted(CATS)
    for i, a in enumerate(cats):
        for b in cats[i + 1:]:
            out.append(f"""SELECT 'fe_count__{a}__{b}', CAST(count(*) OVER (PARTITION BY {a}, {b}) AS DOUBLE),
 label, 1 - label FROM m""")
            for x, y in ((a, b), (b, a)):
                n, u = f"count(*) OVER (PARTITION BY {x})", f"count(DISTINCT {y}) OVER (PARTITION BY {x})"
                out += [f"""SELECT 'fe_ratio__{x}__{y}', count(*) OVER (PARTITION BY {x}, {y})
 / ({n} + CAST(0.01 AS DOUBLE)), label, 1 - label FROM m""",
                        f"""SELECT 'fe_per_nunique__{x}__{y}', {n} / ({u} + CAST(0.01 AS DOUBLE)),
 label, 1 - label FROM m""",
                        f"SELECT 'fe_nunique__{x}__{y}', CAST({u} AS DOUBLE), label, 1 - label FROM m"]
    return " UNION ALL ".join(out)



_TOPK_SQL = f"""WITH {_CODED_SQL},
 own AS (WITH v AS ({_long_sql('m', CODES)}), {_COUNTS_SQL} {_HELLINGER_SQL}),
 cand AS (WITH v AS ({_candidates_sql()}), {_COUNTS_SQL} {_HELLINGER_SQL}),
 thr AS (SELECT score AS threshold FROM own ORDER BY score DESC LIMIT 1 OFFSET 2)
 SELECT feature, score FROM cand, thr WHERE score > threshold ORDER BY score DESC, feature LIMIT 12"""


def _scaled_sql(names_keys) -> str:
    cols = ", ".join(f"(CAST({n} AS DOUBLE) - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ()) * 100 AS {n}"
                     for n in names_keys)
    counts = ", ".join(f"count(*) OVER (PARTITION BY {', '.join(ks)}) AS {n}" for n, ks in names_keys.items())
    return f"WITH {_CODED_SQL}, c AS (SELECT o_orderkey, {counts} FROM m) SELECT o_orderkey, {cols} FROM c"


def _nunique_mi_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(KEYED) for b in KEYED[i + 1:]]
    v, which, ranges = [], [], []
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            name = f"nunique__{x}__{y}"
            v.append(f"""SELECT '{name}' AS feature, CAST(count(DISTINCT {y}) OVER (PARTITION BY {x}) AS DOUBLE)
 AS value, label AS pos, 1 - label AS neg FROM m""")
            which.append(f"SELECT '{name}' AS feature, {i} AS pair")
    ranges = "r2 AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v GROUP BY feature)"
    return f"""WITH {_CODED_SQL},
 v AS ({' UNION ALL '.join(v)}), {ranges}, {_COUNTS_SQL},
 s AS ({_MI_SQL}),
 k AS (SELECT feature, mi, row_number() OVER (PARTITION BY pair ORDER BY mi DESC, feature) AS n
  FROM s JOIN ({' UNION ALL '.join(which)}) USING (feature))
 SELECT feature, mi, lo, hi FROM k JOIN r2 USING (feature) WHERE n = 1 AND mi > {NUNIQUE_THRESHOLD}"""


def _search_sql() -> str:
    """Information of the codes ranks the pairs; that of the pair counts decides."""
    pairs = [(a, b) for i, a in enumerate(CATS) for b in CATS[i + 1:]]
    listed = ", ".join(f"('cnt__{'__'.join(sorted(p))}', '{p[0]}', '{p[1]}')" for p in pairs)
    counts = " UNION ALL ".join(f"""SELECT 'cnt__{'__'.join(sorted(p))}' AS feature, CAST(count(*) OVER (PARTITION BY {p[0]}, {p[1]})
 AS DOUBLE) AS value, label AS pos, 1 - label AS neg FROM m""" for p in pairs)
    return f"""WITH {_CODED_SQL}, own AS (WITH v AS ({_long_sql('m', CODES)}), {_COUNTS_SQL} {_MI_SQL}),
 cand AS (WITH v AS ({counts}), {_COUNTS_SQL} {_MI_SQL}),
 pairs(feature, a, b) AS (VALUES {listed}),
 ranked AS (SELECT p.feature, row_number() OVER (ORDER BY x.mi + y.mi DESC, a, b) AS turn FROM pairs p
  JOIN own x ON x.feature = a || '_code' JOIN own y ON y.feature = b || '_code')
 SELECT feature, CAST(turn AS INTEGER) AS turn, CAST((turn - 1) // {SEARCH['batch']} + 1 AS INTEGER) AS batch, mi,
  mi > {SEARCH['threshold']} AS accepted FROM ranked JOIN cand USING (feature) WHERE turn <= {SEARCH['budget']}"""


_WIDE_SQL = f"""WITH {X.side_sql('part')}, m AS (SELECT o.*, c.c_acctbal AS customer__c_acctbal, a.* FROM o
 LEFT JOIN ({X.CUSTOMER_SQL}) c ON o.o_custkey = c.c_custkey LEFT JOIN a ON o.o_orderkey = a.l_orderkey)"""

_MISSING_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) "
                                  f"AS missing_fraction FROM m" for c in PROFILED)
_SINGLE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) = 1 AS single_unique FROM m"
                                 for c in PROFILED)


def _corr_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS corr_feature, '{b}' AS drop_feature, corr({a}, {b}) AS corr_value FROM {table}"
        for i, a in enumerate(PROFILED) for b in PROFILED[i + 1:])


_AUC_SQL = f"""WITH o AS ({X.ORDERS_SQL}), g AS (SELECT o_totalprice AS s, sum(label) AS pos,
 sum(1 - label) AS neg FROM o GROUP BY s), c AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM g)
 SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM c"""

_IMPORTANCE_SQL = f"""{_WIDE_SQL}, q AS (SELECT *, 1.0 AS constant FROM m),
 v AS (SELECT * FROM ({_long_sql('q', (*PROFILED, 'constant'))}) WHERE value IS NOT NULL), {_COUNTS_SQL}, i AS ({_MI_SQL}),
 k AS (SELECT feature, mi AS importance, mi / sum(mi) OVER () AS normalized,
  sum(mi) OVER (ORDER BY mi DESC, feature ROWS UNBOUNDED PRECEDING) / sum(mi) OVER () AS cumulative FROM i)"""

QUERIES = {
    "hellinger_score": (hellinger_score, f"""WITH m AS ({X.MERGED_SQL}), v AS ({_long_sql('m', SCORED)}),
 {_COUNTS_SQL} {_HELLINGER_SQL}"""),
    "mutual_info": (mutual_info_query, f"""WITH m AS ({X.MERGED_SQL}), v AS ({_long_sql('m', SCORED)}),
 {_COUNTS_SQL} {_MI_SQL}"""),
    "fe_topk": (fe_topk, _TOPK_SQL),
    "count_enc_mi": (count_enc_mi, _scaled_sql({f"cnt__{c}": (c,) for c in CATS})),
    "pair_count_mi": (pair_count_mi, _scaled_sql({"cnt__" + "__".join(sorted((a, b))): (a, b)
                                                  for i, a in enumerate(CATS) for b in CATS[i + 1:]})),
    "pair_count_search": (pair_count_search, _search_sql()),
    "pair_nunique_mi": (pair_nunique_mi, _nunique_mi_sql()),
    "auc": (auc, _AUC_SQL),
    "auc_file": (auc_file, _AUC_SQL),
    "profile_missing": (profile_missing, f"""{_WIDE_SQL} {_MISSING_SQL}
 UNION ALL SELECT 'constant', 0.0"""),
    "profile_single_unique": (profile_single_unique, f"{_WIDE_SQL} {_SINGLE_SQL} UNION ALL SELECT 'constant', TRUE"),
    "collinear": (collinear, f"""WITH m AS ({X.MERGED_SQL}), c AS ({_corr_sql('m')})
 SELECT corr_feature, drop_feature, round(corr_value, 9) AS corr_value FROM c WHERE abs(corr_value) > 0.5"""),
    "feature_report": (feature_report, f"""{_WIDE_SQL}, x AS ({_MISSING_SQL}), y AS ({_SINGLE_SQL}
 UNION ALL SELECT 'constant', TRUE), c AS ({_corr_sql('m')})
 SELECT feature, 'missing' AS reason FROM x WHERE missing_fraction > 0.01
 UNION ALL SELECT feature, 'single_unique' FROM y WHERE single_unique
 UNION ALL SELECT DISTINCT drop_feature, 'collinear' FROM c WHERE abs(corr_value) > 0.9"""),
    "importance_shares": (importance_shares, f"""{_IMPORTANCE_SQL} SELECT feature, importance, round(normalized, 9) AS normalized,
 round(cumulative, 9) AS cumulative, importance = 0 AS zero_importance, cumulative > 0.95 AS low_importance FROM k"""),
    "feature_report_all": (feature_report_all, f"""{_IMPORTANCE_SQL}, x AS ({_MISSING_SQL}), y AS ({_SINGLE_SQL}
 UNION ALL SELECT 'constant', TRUE), c AS ({_corr_sql('m')}),
 found AS (SELECT feature, 'missing' AS reason FROM x WHERE missing_fraction > 0.01
 UNION ALL SELECT feature, 'single_unique' FROM y WHERE single_unique
 UNION ALL SELECT DISTINCT drop_feature, 'collinear' FROM c WHERE abs(corr_value) > 0.9
 UNION ALL SELECT feature, 'zero_importance' FROM k WHERE importance = 0
 UNION ALL SELECT feature, 'low_importance' FROM k WHERE cumulative > 0.95)
 SELECT feature, reason FROM found UNION ALL SELECT feature, 'kept' FROM k WHERE feature NOT IN (SELECT feature FROM found)"""),
}
