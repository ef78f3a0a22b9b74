"""Preparation, anomaly models and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog.profiles import SHAPE, described, histogram_sql
from ledgerlens.catalog.registry import plain, register, rounded, to_digits
from ledgerlens.catalog.views import Views
from ledgerlens.operators import evaluation, features, neighbors, preparation, scoring
from ledgerlens.operators import forest as iforest
from ledgerlens.plans.daily import Paths
from ledgerlens.plans.scoring import run_scoring
from ledgerlens.session import materialize, new_path

# --- preparation -------------------------------------------------------------------------------------------------
USED = ("tx_count", "total_value", "avg_value", "unique_counterparties", "active_days", "in_out_ratio")
USED_SQL = ", ".join(USED)


def _base(v: Views) -> DataFrame:
    """A few features; wallets that never received have no ratio."""
    basic = features.basic_features(v.stored_staged)
    ratio = F.when(F.col("tx_count_in") > 0, F.col("in_out_ratio"))
    return materialize(basic.withColumn("in_out_ratio", ratio).select("wallet_address", *USED))


BASE = {
    "base": f"""
        SELECT wallet_address, {USED_SQL.replace('in_out_ratio', 'CASE WHEN tx_count_in > 0 THEN in_out_ratio END AS in_out_ratio')}
        FROM basic"""
}
FILLED = {
    **BASE,
    "filled": """
        SELECT * REPLACE (coalesce(in_out_ratio, (SELECT median(in_out_ratio) FROM base)) AS in_out_ratio) FROM base""",
}
for _strategy, _fill in (
    ("median", "(SELECT median(in_out_ratio) FROM base)"),
    ("mean", "(SELECT avg(in_out_ratio) FROM base)"),
    ("zero", "0"),
):
    register(
        f"impute_{_strategy}",
        lambda v, s=_strategy: rounded(
            preparation.impute(_base(v), USED, strategy=s).select("wallet_address", "tx_count", "in_out_ratio"),
            {"in_out_ratio": 9},
        ),
        f"""
        SELECT wallet_address, tx_count, round(coalesce(in_out_ratio, {_fill}), 9) AS in_out_ratio
        FROM base""",
        BASE,
    )
ALL_USED = to_digits(USED, 6)


def _scaled(expression: str) -> str:
    return "SELECT wallet_address, " + ", ".join(
        f"round({expression.format(c=c)}, 6) AS {c}" for c in USED
    ) + " FROM filled"


STANDARD = "({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled)"
register(
    "prepare_features",
    lambda v: rounded(preparation.prepare_features(_base(v), features.FEATURE_COLUMNS)[0], ALL_USED).select(
        "wallet_address", *USED
    ),
    _scaled(STANDARD),
    FILLED,
)
_SPREADS = {
    "standard": STANDARD,
    "minmax": "({c} - (SELECT min({c}) FROM filled)) / CAST((SELECT max({c}) - min({c}) FROM filled) AS DOUBLE)",
    "robust": "({c} - (SELECT quantile_cont({c}, 0.5) FROM filled)) / "
    "coalesce(nullif((SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM filled), 0), 1)",
}
for _method, _expression in _SPREADS.items():
    register(
        f"scale_{_method}",
        lambda v, m=_method: rounded(
            preparation.scale(materialize(preparation.clean_features(_base(v), USED)), USED, method=m)[0], ALL_USED
        ),
        _scaled(_expression),
        FILLED,
    )
OUTLIER_COLUMNS = ("tx_count", "total_value", "unique_counterparties")
register(
    "remove_outliers_iqr",
    lambda v: preparation.remove_outliers(_base(v), OUTLIER_COLUMNS, threshold=1.0).select("wallet_address"),
    "SELECT wallet_address FROM base WHERE "
    + " AND ".join(
        f"{c} BETWEEN (SELECT quantile_cont({c}, 0.25) - 1.0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM base)"
        f" AND (SELECT quantile_cont({c}, 0.75) + 1.0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM base)"
        for c in OUTLIER_COLUMNS
    ),
    BASE,
)
register(
    "remove_outliers_zscore",
    lambda v: preparation.remove_outliers(_base(v), OUTLIER_COLUMNS, method="zscore", threshold=1.5).select(
        "wallet_address"
    ),
    "SELECT wallet_address FROM base WHERE "
    + " AND ".join(
        f"abs({c} - (SELECT avg({c}) FROM base)) <= 1.5 * (SELECT stddev_samp({c}) FROM base)" for c in OUTLIER_COLUMNS
    ),
    BASE,
)
QUARTILES = {"median": 6, "q25": 6, "q75": 6}
register(
    "describe_numeric",
    lambda v: rounded(preparation.describe_numeric(_base(v), USED), SHAPE | QUARTILES),
    "SELECT * REPLACE (round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75) FROM ("
    + described("base", {c: f"CAST({c} AS DOUBLE)" for c in USED})
    + ")",
    BASE,
)


def _split(v: Views) -> DataFrame:
    train, test = preparation.train_test_split(v.raw_wallets.select("wallet_address"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


register("train_test_split", _split)

# --- scores ------------------------------------------------------------------------------------------------------
register(
    "min_max",
    lambda v: rounded(
        scoring.min_max(scoring.min_max(_base(v), "total_value", "scaled"), "total_value", "inverted", invert=True).select(
            "wallet_address", "scaled", "inverted"
        ),
        {"scaled": 9, "inverted": 9},
    ),
    """
    SELECT wallet_address, round((total_value - low) / (high - low), 9) AS scaled,
      round((high - total_value) / (high - low), 9) AS inverted
    FROM base, (SELECT min(total_value) AS low, max(total_value) AS high FROM base)""",
    BASE,
)
ENSEMBLE = "round(0.5 * isolation_forest_score + 0.3 * lof_score + 0.2 * dbscan_is_noise, 9)"


def _ensemble(v: Views) -> DataFrame:
    columns = ("wallet_address", *scoring.ENSEMBLE_WEIGHTS)
    return rounded(scoring.ensemble_score(v.scores.select(*columns)), {"fraud_score": 9})


register(
    "ensemble_score",
    lambda v: _ensemble(v).select("wallet_address", "fraud_score"),
    f"SELECT wallet_address, {ENSEMBLE} AS fraud_score FROM scores",
)
register(
    "ensemble_score_partial",
    lambda v: rounded(
        scoring.ensemble_score(
            v.scores.select("wallet_address", "isolation_forest_score", "lof_score"), scoring.NOTEBOOK_WEIGHTS
        ),
        {"fraud_score": 9},
    ).select("wallet_address", "fraud_score"),
    """
    SELECT wallet_address, round((0.4 * isolation_forest_score + 0.35 * lof_score) / 0.75, 9) AS fraud_score
    FROM scores""",
)
register(
    "risk_category",
    lambda v: scoring.risk_category(_ensemble(v)).select("wallet_address", "risk_category"),
    f"""
    SELECT wallet_address, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium'
      ELSE 'low' END AS risk_category FROM (SELECT wallet_address, {ENSEMBLE} AS s FROM scores)""",
)

# --- neighbours over the embedding table --------------------------------------------------------------------------
K = 20
EPS = 1.18
MIN_SAMPLES = 5


def _points(v: Views) -> DataFrame:
    return neighbors.vector_points(v.table("embeddings"), "vec_id", "embedding")


POINTS = {
    "pts": "SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings",
    "dist": "SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.e, b.e) AS d FROM pts a, pts b WHERE a.vec_id <> b.vec_id",
    "knn": f"""
        SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM dist)
        WHERE rank <= {K}""",
    "close_pairs": f"SELECT i, j, d FROM dist WHERE d <= {EPS}",
    "core": f"""
        SELECT vec_id AS c FROM pts WHERE 1 + (SELECT count(*) FROM close_pairs WHERE i = vec_id) >= {MIN_SAMPLES}""",
}
register(
    "knn_join",
    lambda v: rounded(neighbors.knn_join(_points(v), K), {"distance": 6}),
    "SELECT i AS id, j AS neighbor, round(d, 6) AS distance, rank FROM knn",
    POINTS,
)
register(
    "eps_join",
    lambda v: rounded(neighbors.eps_join(_points(v), EPS), {"distance": 6}),
    "SELECT i AS id, j AS neighbor, 1::BIGINT AS neighbor_weight, round(d, 6) AS distance FROM close_pairs",
    POINTS,
)
register(
    "lof",
    lambda v: rounded(neighbors.lof(_points(v), k=K), {"lof": 6}),
    """
    SELECT k.i AS id, round(avg(n.density) / any_value(o.density), 6) AS lof
    FROM knn k JOIN density n ON k.j = n.i JOIN density o ON k.i = o.i GROUP BY k.i""",
    {
        **POINTS,
        "density": """
            SELECT k.i, 1.0 / (avg(greatest(k.d, far.kd)) + 1e-10) AS density
            FROM knn k JOIN (SELECT i, max(d) AS kd FROM knn GROUP BY i) far ON k.j = far.i GROUP BY k.i""",
    },
)
DBSCAN_SQL = """
    SELECT vec_id AS id, coalesce(own.cluster, near.cluster) AS cluster,
      own.cluster IS NULL AND near.cluster IS NULL AS is_noise, own.cluster IS NOT NULL AS is_core
    FROM pts LEFT JOIN named own ON own.c = vec_id
    LEFT JOIN (SELECT i, min(cluster) AS cluster FROM close_pairs JOIN named ON j = c GROUP BY i) near ON near.i = vec_id"""
register(
    "dbscan",
    lambda v: neighbors.dbscan(_points(v), eps=EPS, min_samples=MIN_SAMPLES),
    # components by recursion: every core point reaches itself and, through close core points, the rest
    "WITH RECURSIVE "
    + ", ".join(f"{n} AS ({t})" for n, t in POINTS.items())
    + """, links AS (SELECT i, j FROM close_pairs WHERE i IN (SELECT c FROM core) AND j IN (SELECT c FROM core)),
    reach(c, r) AS (SELECT c, c FROM core UNION SELECT reach.c, links.j FROM reach JOIN links ON reach.r = links.i),
    named AS (SELECT c, min(r) AS cluster FROM reach GROUP BY c) """
    + DBSCAN_SQL,
    {"none": ""},
)


def _labelled(v: Views) -> DataFrame:
    """Embeddings with their label as cluster; the last label stands for noise."""
    table = v.table("embeddings")
    cluster = F.when(F.col("label") < 9, F.col("label"))
    return table.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), cluster.alias("cluster")
    )


register(
    "cluster_quality",
    lambda v: rounded(
        evaluation.cluster_quality(_labelled(v)),
        to_digits(("silhouette_score", "calinski_harabasz_score", "davies_bouldin_score"), 6),
    ),
    """
    SELECT (SELECT count(DISTINCT c) FROM lab) AS n_clusters, (SELECT count(*) FROM lab WHERE c IS NULL) AS n_noise,
      (SELECT CAST(count(*) FILTER (WHERE c IS NULL) AS DOUBLE) / count(*) FROM lab) AS noise_ratio,
      (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM (
        SELECT i, max(m) FILTER (WHERE ci = cj) AS a, min(m) FILTER (WHERE ci <> cj) AS b FROM (
          SELECT x.vec_id AS i, x.c AS ci, y.c AS cj, avg(list_distance(x.e, y.e)) AS m
          FROM kept x, kept y WHERE x.vec_id <> y.vec_id GROUP BY 1, 2, 3) GROUP BY i)) AS silhouette_score,
      (SELECT round((sum(n * power(list_distance(center, middle), 2)) / (count(*) - 1))
        / (sum(within) / (sum(n) - count(*))), 6) FROM spread, overall) AS calinski_harabasz_score,
      (SELECT round(avg(worst), 6) FROM (
        SELECT p.c, max((p.scatter + q.scatter) / list_distance(p.center, q.center)) AS worst
        FROM spread p, spread q WHERE p.c <> q.c GROUP BY p.c)) AS davies_bouldin_score""",
    {
        "lab": "SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN label < 9 THEN label END AS c FROM embeddings",
        "kept": "SELECT * FROM lab WHERE c IS NOT NULL",
        "cellsx": "SELECT vec_id, c, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM kept",
        "centers": """
            SELECT c, list(m ORDER BY pos) AS center FROM (SELECT c, pos, avg(x) AS m FROM cellsx GROUP BY c, pos)
            GROUP BY c""",
        "overall": "SELECT list(m ORDER BY pos) AS middle FROM (SELECT pos, avg(x) AS m FROM cellsx GROUP BY pos)",
        "spread": """
            SELECT c, any_value(center) AS center, count(*) AS n, avg(list_distance(e, center)) AS scatter,
              sum(power(list_distance(e, center), 2)) AS within
            FROM kept JOIN centers USING (c) GROUP BY c""",
    },
)

# --- evaluation of scores ----------------------------------------------------------------------------------------
DISTRIBUTION = """
    SELECT 'basic_stats' AS section, unnest(['count', 'mean', 'std', 'min', 'max', 'median']) AS metric,
      unnest([count(*)::DOUBLE, avg(fraud_score), stddev_samp(fraud_score), min(fraud_score), max(fraud_score),
        median(fraud_score)]) AS value FROM scores
    UNION ALL SELECT 'percentiles', unnest(['p1', 'p5', 'p10', 'p25', 'p50', 'p75', 'p90', 'p95', 'p99']),
      unnest(quantile_cont(fraud_score, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) FROM scores
    UNION ALL SELECT 'risk_distribution', risk_category, count(*)::DOUBLE FROM scores GROUP BY risk_category
    UNION ALL SELECT 'thresholds', unnest(['above_0.5', 'above_0.7', 'above_0.9']),
      unnest([count(*) FILTER (WHERE fraud_score > 0.5), count(*) FILTER (WHERE fraud_score > 0.7),
        count(*) FILTER (WHERE fraud_score > 0.9)])::DOUBLE FROM scores
    UNION ALL SELECT 'anomaly_rate', unnest(['at_10_percent', 'at_5_percent', 'at_1_percent']),
      unnest([avg((fraud_score > q[1])::INT), avg((fraud_score > q[2])::INT), avg((fraud_score > q[3])::INT)])
    FROM scores, (SELECT quantile_cont(fraud_score, [0.9, 0.95, 0.99]) AS q FROM scores)"""
register(
    "score_distribution",
    lambda v: rounded(evaluation.score_distribution(v.scores), {"value": 6}),
    f"SELECT section, metric, round(value, 6) AS value FROM ({DISTRIBUTION})",
)
register(
    "score_histogram",
    lambda v: rounded(plain(evaluation.score_histogram(v.scores)), {"lower": 6, "upper": 6}),
    histogram_sql("score_rows"),
    {"score_rows": "SELECT fraud_score AS x FROM scores"},
)
MODEL_COLUMNS = ("isolation_forest_score", "lof_score")
register(
    "model_score_quartiles",
    lambda v: rounded(
        evaluation.model_score_quartiles(v.scores, MODEL_COLUMNS), to_digits(("q25", "median", "q75"), 9)
    ),
    " UNION ALL ".join(
        f"""
        SELECT '{c}' AS feature, round(q25, 9) AS q25, round(median, 9) AS median, round(q75, 9) AS q75, min({c}) AS min,
          max({c}) AS max, min({c}) FILTER (WHERE {c} >= q25 - 1.5 * (q75 - q25)) AS whisker_low,
          max({c}) FILTER (WHERE {c} <= q75 + 1.5 * (q75 - q25)) AS whisker_high
        FROM scores, (SELECT quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median,
          quantile_cont({c}, 0.75) AS q75 FROM scores) GROUP BY q25, median, q75"""
        for c in MODEL_COLUMNS
    ),
)
COMPARED = features.FEATURE_COLUMNS


def _comparison_sql(high: str, normal: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, avg({c}) FILTER (WHERE {high}) AS high_risk_mean,
          avg({c}) FILTER (WHERE {normal}) AS normal_mean, stddev_samp({c}) FILTER (WHERE {high}) AS high_risk_std,
          stddev_samp({c}) FILTER (WHERE {normal}) AS normal_std FROM merged"""
        for c in COMPARED
    )
    return f"SELECT *, high_risk_mean / greatest(normal_mean, 1e-10) AS ratio FROM ({parts})"


MERGED = {
    "merged": "SELECT f.*, s.fraud_score, s.risk_category FROM scores s JOIN wallet_features f USING (wallet_address)"
}
COMPARISON_COLUMNS = ("high_risk_mean", "normal_mean", "high_risk_std", "normal_std", "ratio")


def _significant(df: DataFrame) -> DataFrame:
    """Means of prices in wei have 11 whole digits, so only relative precision is comparable."""
    def cut(c: str):
        scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.col(c)))) - 8)
        return F.when(F.col(c) == 0, 0.0).otherwise(F.round(F.col(c) / scale).cast("bigint")).cast("double").alias(c)

    return df.select("feature", *[cut(c) for c in COMPARISON_COLUMNS])


def _significant_sql(sql: str) -> str:
    parts = ", ".join(
        f"CASE WHEN {c} = 0 THEN 0 ELSE CAST(round({c} / pow(10.0, floor(log10(abs({c}))) - 8)) AS DOUBLE) END AS {c}"
        for c in COMPARISON_COLUMNS
    )
    return f"SELECT feature, {parts} FROM ({sql})"


register(
    "high_risk_comparison",
    lambda v: _significant(evaluation.high_risk_comparison(v.scores, v.features, columns=COMPARED)),
    _significant_sql(_comparison_sql("fraud_score >= 0.7", "fraud_score < 0.7")),
    MERGED,
)
register(
    "high_risk_comparison_by_category",
    lambda v: _significant(
        evaluation.high_risk_comparison(v.scores, v.features, columns=COMPARED, by_category=True)
    ),
    _significant_sql(_comparison_sql("risk_category IN ('high', 'critical')", "risk_category = 'low'")),
    MERGED,
)
register(
    "evaluation_report",
    lambda v: rounded(evaluation.evaluation_report(v.scores, v.features), {"value": 6}),
    f"""
    SELECT section, metric, round(value, 6) AS value FROM (
      SELECT 'summary' AS section, 'total_wallets' AS metric, count(*)::DOUBLE AS value FROM scores
      UNION ALL SELECT 'summary', 'features_count', {len(COMPARED)}::DOUBLE
      UNION ALL ({DISTRIBUTION})
      UNION ALL (SELECT 'top_distinguishing_features', feature, ratio
        FROM ({_comparison_sql("fraud_score >= 0.7", "fraud_score < 0.7")})
        ORDER BY ratio DESC NULLS LAST, feature LIMIT 10))""",
    MERGED,
)

# --- models ------------------------------------------------------------------------------------------------------
WALLET_EPS = 3.0


def _fitted(v: Views, model_type: str = "isolation_forest") -> tuple[DataFrame, scoring.Models]:
    stored = materialize(v.features)
    return stored, scoring.fit_models(stored, model_type=model_type)


def _nodes(v: Views) -> DataFrame:
    _, models = _fitted(v)
    return models.forest.nodes


register("isolation_forest_fit", _nodes)


def _forest_scores(v: Views) -> DataFrame:
    stored, models = _fitted(v)
    raw = iforest.isolation_forest_score(scoring.prepared_rows(stored, models), models.forest)
    return scoring.min_max(materialize(raw), "decision", "isolation_forest_score", invert=True)


register("isolation_forest_score", _forest_scores)


def _scores(v: Views) -> DataFrame:
    stored, models = _fitted(v, "ensemble")
    return scoring.score_wallets(stored, models, eps=WALLET_EPS, scored_at=v.now)


register("score_wallets", _scores)


def _eval_forest(v: Views) -> DataFrame:
    stored, models = _fitted(v)
    _, test = preparation.train_test_split(scoring.prepared_rows(stored, models))
    return scoring.model_eval_if(test, models.forest)


register("model_eval_if", _eval_forest)


def _anomaly_counts(v: Views) -> DataFrame:
    stored, models = _fitted(v, "ensemble")
    scores = materialize(scoring.score_wallets(stored, models, eps=WALLET_EPS))
    return scoring.model_anomaly_counts(scoring.flag_top_share(scores, "lof_score", "lof_is_outlier"))


register("model_anomaly_counts", _anomaly_counts)


def _metadata(v: Views) -> DataFrame:
    stored, models = _fitted(v)
    return plain(scoring.training_metadata(stored, models, started_at=v.now, ended_at=v.now))


register("training_metadata", _metadata)


def _importance(v: Views) -> DataFrame:
    stored, models = _fitted(v)
    return iforest.permutation_importance(scoring.prepared_rows(stored, models), models.forest)


register("permutation_importance", _importance)
register(
    "scoring_run",
    lambda v: run_scoring(
        v.spark, v.stored_staged, Paths(new_path(v.spark, "scoring")), mode="full", now=v.now, eps=WALLET_EPS
    ),
)
