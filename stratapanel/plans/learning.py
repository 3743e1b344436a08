"""Clustering and classification over the panel."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from stratapanel.operators import classify, derive, elastic_net, features, grid, groupstats, kmeans, metrics, pca, relations, scores
from stratapanel.operators.dbscan import dbscan as density_clusters
from stratapanel.operators.ward import ward as ward_clusters
from stratapanel.plans.panel import INDICATORS, PANEL_SQL, info, panel, table
from stratapanel.plans.registry import query
from stratapanel.session import materialize

MEANS_SQL = PANEL_SQL + ", m AS (SELECT entity, " + ", ".join(f"avg({c}) AS {c}" for c in INDICATORS) + " FROM panel GROUP BY 1)\n"


def z_sql(*columns: str) -> str:
    parts = ", ".join(f"(m.{c} - s.m_{c}) / s.s_{c} AS {c}" for c in columns)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in columns)
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f", known AS (SELECT * FROM m WHERE {known}), z AS (SELECT m.entity, {parts} FROM known m, (SELECT {stats} FROM known) s)\n"


def means(spark, sf, *columns: str):
    names = list(columns) or INDICATORS
    return groupstats.group_means(panel(spark, sf), ["entity"], names).dropna(subset=names)


def scaled(spark, sf, *columns: str):
    return features.zscore(means(spark, sf, *columns), list(columns))


@query("zscore", MEANS_SQL + z_sql("stress", "domestic") + "SELECT entity, round(stress, 6) AS stress, round(domestic, 6) AS domestic FROM z")
def zscore(spark, sf):
    return scaled(spark, sf, "stress", "domestic").select("entity", F.round("stress", 6).alias("stress"), F.round("domestic", 6).alias("domestic"))


@query("minmax_rescale", PANEL_SQL + """, b AS (SELECT min(stress) AS lo, max(stress) AS hi FROM panel WHERE year <= 1999)
SELECT entity, year::BIGINT AS year, round((stress - lo) / (hi - lo), 7) AS stress FROM panel, b WHERE year > 1999""")
def minmax_rescale(spark, sf):
    rows = panel(spark, sf).select("entity", F.col("year").cast("long").alias("year"), "stress")
    train, test = rows.where(F.col("year") <= 1999), rows.where(F.col("year") > 1999)
    return features.rescale(test, ["stress"], fitted_on=train).withColumn("stress", F.round("stress", 7))


@query("train_standardise", PANEL_SQL + """, b AS (SELECT avg(stress) AS m, stddev_samp(stress) AS s FROM panel WHERE year <= 1999)
SELECT entity, year::BIGINT AS year, round((stress - m) / s, 6) AS stress FROM panel, b WHERE year > 1999""")
def train_standardise(spark, sf):
    rows = panel(spark, sf).select("entity", F.col("year").cast("long").alias("year"), "stress")
    train, test = rows.where(F.col("year") <= 1999), rows.where(F.col("year") > 1999)
    return features.standardise_by(test, ["stress"], train).withColumn("stress", F.round("stress", 6))


# Two features have components in closed form, so SQL can check the whole path.
@query("pca_two_features", MEANS_SQL + z_sql("stress", "gdppc") + """, r AS (SELECT corr(stress, gdppc) AS r FROM z)
SELECT entity, round(CASE WHEN r > 0 THEN (stress + gdppc) / sqrt(2) ELSE (stress - gdppc) / sqrt(2) END, 6) AS pc1, round(CASE WHEN r > 0 THEN (stress - gdppc) / sqrt(2) ELSE (stress + gdppc) / sqrt(2) END, 6) AS pc2 FROM z, r""")
def pca_two_features(spark, sf):
    rows = means(spark, sf, "stress", "gdppc")
    model = pca.components_of(pca.moments_of(rows, ["stress", "gdppc"]))
    return pca.scores(rows, model, ["entity"], 2).select("entity", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("pca_scores")
def pca_scores(spark, sf):
    rows = means(spark, sf)
    return pca.scores(rows, pca.components_of(pca.moments_of(rows, INDICATORS)), ["entity"], 3)


@query("pca_summary")
def pca_summary(spark, sf):
    return pca.summary(spark, pca.components_of(pca.moments_of(means(spark, sf), INDICATORS)))


@query("pca_contributions")
def pca_contributions(spark, sf):
    return pca.contributions(spark, pca.components_of(pca.moments_of(means(spark, sf), INDICATORS)))


CENTRES = [[-0.8, -0.5], [0.9, -0.4], [0.1, 1.2]]
_CENTRE_SQL = ", ".join(
    f"{{'d': (stress - ({a})) * (stress - ({a})) + (domestic - ({b})) * (domestic - ({b})), 'c': {i + 1}}}" for i, (a, b) in enumerate(CENTRES)
)
LABELLED_SQL = MEANS_SQL + z_sql("stress", "domestic") + f", lab AS (SELECT entity, stress, domestic, (list_sort([{_CENTRE_SQL}])[1]).c::BIGINT AS cluster FROM z)\n"


def labelled(spark, sf):
    rows = scaled(spark, sf, "stress", "domestic")
    return rows.withColumn("cluster", kmeans.nearest_centre(["stress", "domestic"], CENTRES).cast("long"))


@query("kmeans_assign_fixed_centres", LABELLED_SQL + "SELECT entity, cluster FROM lab")
def kmeans_assign_fixed_centres(spark, sf):
    return labelled(spark, sf).select("entity", "cluster")


@query("kmeans")
def kmeans_fit(spark, sf):
    rows = scaled(spark, sf, "stress", "domestic", "productivity")
    dims = ["stress", "domestic", "productivity"]
    centres = kmeans.kmeans_restarts(rows, dims, 3, starts=25)
    return kmeans.assign(rows, centres, dims).select("entity", "cluster")


@query("elbow")
def elbow(spark, sf):
    return kmeans.elbow(scaled(spark, sf, "stress", "domestic"), ["stress", "domestic"], range(1, 11), starts=25)


DBSCAN_SQL = MEANS_SQL + z_sql("stress", "domestic") + """, p AS (SELECT entity AS id, stress AS x, domestic AS y FROM z),
nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.2),
core AS (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) >= 5),
link AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS root, id FROM core UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.id),
comp AS (SELECT id, min(root) AS c FROM reach GROUP BY 1),
lab AS (SELECT p.id, coalesce(any_value(own.c), min(oc.c)) AS c FROM p LEFT JOIN comp own ON own.id = p.id LEFT JOIN nb ON nb.a = p.id LEFT JOIN comp oc ON oc.id = nb.b GROUP BY p.id),
num AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT c FROM comp))
"""


@query("dbscan", DBSCAN_SQL + "SELECT lab.id AS entity, coalesce(k, 0)::BIGINT AS cluster FROM lab LEFT JOIN num USING (c)")
def dbscan(spark, sf):
    labels = density_clusters(scaled(spark, sf, "stress", "domestic"), "entity", ["stress", "domestic"], 0.2, 5)
    return labels.withColumn("cluster", F.col("cluster").cast("long"))


@query("ward")
def ward(spark, sf):
    dims = ["stress", "domestic", "productivity"]
    return ward_clusters(scaled(spark, sf, *dims), dims, 3).select("entity", "cluster")


EMBEDDING_SQL = """WITH e AS (SELECT vec_id, label, unnest(generate_series(1, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
"""


def embedding_points(spark, sf):
    dims = [f"x{i}" for i in range(64)]
    rows = table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(dims)])
    return rows, dims


@query("silhouette_sq", EMBEDDING_SQL + """pair AS (SELECT p.vec_id AS a, q.vec_id AS b, any_value(p.label) AS la, any_value(q.label) AS lb, sum((p.x - q.x) * (p.x - q.x)) AS d FROM e p JOIN e q ON p.i = q.i GROUP BY 1, 2),
g AS (SELECT a, la, lb, sum(d) AS s, count(*) AS n FROM pair GROUP BY 1, 2, 3),
ab AS (SELECT a, max(CASE WHEN la = lb THEN s / nullif(n - 1, 0) END) AS a0, min(CASE WHEN la <> lb THEN s / n END) AS b0 FROM g GROUP BY 1)
SELECT round(avg(CASE WHEN a0 IS NULL THEN 0 ELSE (b0 - a0) / greatest(a0, b0) END), 6) AS silhouette FROM ab""")
def silhouette_sq(spark, sf):
    rows, dims = embedding_points(spark, sf)
    return scores.silhouette_squared(rows, "label", dims).withColumn("silhouette", F.round("silhouette", 6))


@query("davies_bouldin", EMBEDDING_SQL + """c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2),
s AS (SELECT e.label, sqrt(sum((x - c) * (x - c)) / count(DISTINCT vec_id)) AS s FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY 1),
d AS (SELECT p.label AS a, q.label AS b, sqrt(sum((p.c - q.c) * (p.c - q.c))) AS d FROM c p JOIN c q ON p.i = q.i AND p.label <> q.label GROUP BY 1, 2),
r AS (SELECT a, max((x.s + y.s) / d) AS r FROM d JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY 1)
SELECT round(avg(r), 6) AS db_index FROM r""")
def davies_bouldin(spark, sf):
    rows, dims = embedding_points(spark, sf)
    return scores.davies_bouldin(rows, "label", dims).withColumn("db_index", F.round("db_index", 6))


RANKED = ["stress", "domestic", "productivity", "gdppc"]
RANK_CONFIGS = [(f"{a},{b},{k}", a, b, k) for a, b in combinations(RANKED, 2) for k in (2, 3, 4)]


def _label_sql(a, b, k):
    rule = {2: f"1 + ({a} > 0)::INT", 3: f"1 + ({a} > -0.5)::INT + ({a} > 0.5)::INT", 4: f"1 + ({a} > 0)::INT + 2 * ({b} > 0)::INT"}[k]
    return f"CASE WHEN abs({a}) > 1.6 THEN 0 ELSE {rule} END"


RANK_SQL = MEANS_SQL + z_sql(*RANKED) + ", pts AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS config, {a} AS x1, {b} AS x2, {_label_sql(a, b, k)} AS l FROM z" for name, a, b, k in RANK_CONFIGS
) + """),
cl AS (SELECT config, l, count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1 + x2 * x2) AS q FROM pts GROUP BY 1, 2),
pd AS (SELECT p.config, p.x1, p.x2, p.l, c.l AS o, c.n, greatest(p.x1 * p.x1 + p.x2 * p.x2 + (c.q - 2 * (p.x1 * c.s1 + p.x2 * c.s2)) / c.n, 0) AS d, row_number() OVER () AS rn FROM pts p JOIN cl c USING (config)),
ab AS (SELECT config, x1, x2, l, max(CASE WHEN o = l THEN d * n / nullif(n - 1, 0) END) AS a, min(CASE WHEN o <> l THEN d END) AS b FROM pd GROUP BY 1, 2, 3, 4),
sil AS (SELECT config, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM pts JOIN ab USING (config, x1, x2, l) GROUP BY 1),
ce AS (SELECT config, l, n, s1 / n AS c1, s2 / n AS c2, sqrt(greatest(q / n - (s1 / n) * (s1 / n) - (s2 / n) * (s2 / n), 0)) AS s FROM cl WHERE l <> 0),
db AS (SELECT config, avg(r) AS db_index FROM (SELECT p.config, p.l, max((p.s + q.s) / sqrt((p.c1 - q.c1) * (p.c1 - q.c1) + (p.c2 - q.c2) * (p.c2 - q.c2))) AS r FROM ce p JOIN ce q ON p.config = q.config AND p.l <> q.l GROUP BY 1, 2) GROUP BY 1),
ba AS (SELECT config, count(CASE WHEN l <> 0 THEN 1 END) AS k, max(CASE WHEN l <> 0 THEN n END) / min(CASE WHEN l <> 0 THEN n END) AS ratio, coalesce(sum(CASE WHEN l = 0 THEN n END), 0) / sum(n) AS miss FROM cl GROUP BY 1),
res AS (SELECT config, silhouette, db_index, k, CASE WHEN k > 1 THEN ratio END AS ratio, miss FROM sil JOIN db USING (config) JOIN ba USING (config) WHERE k BETWEEN 2 AND 4),
sc AS (SELECT *, 0.5 * (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()) + 0.5 * (1 - (db_index - min(db_index) OVER ()) / (max(db_index) OVER () - min(db_index) OVER ())) AS composite FROM res)
SELECT config, round(silhouette, 6) AS silhouette, round(db_index, 6) AS db_index, k AS num_clusters, round(ratio, 6) AS max_min_ratio, round(miss, 6) AS missing_rate, round(composite, 6) AS composite FROM sc WHERE ratio < 10 AND miss <= 0.2"""


def _rule(a, b, k):
    up = lambda c, v: (F.col(c) > v).cast("int")
    label = {2: 1 + up(a, 0), 3: 1 + up(a, -0.5) + up(a, 0.5), 4: 1 + up(a, 0) + 2 * up(b, 0)}[k]
    return F.when(F.abs(a) > 1.6, 0).otherwise(label)


@query("grid_rank", RANK_SQL)
def grid_rank(spark, sf):
    z = scaled(spark, sf, *RANKED)
    configs = [F.struct(F.lit(n).alias("config"), F.col(a).alias("x1"), F.col(b).alias("x2"), _rule(a, b, k).alias("l")) for n, a, b, k in RANK_CONFIGS]
    points = z.select(F.inline(F.array(*configs)))
    by, dims = ["config"], ["x1", "x2"]
    scored = (
        scores.silhouette_squared(points, "l", dims, by)
        .join(scores.davies_bouldin(points, "l", dims, by, noise=0), by)
        .join(scores.balance(points, "l", by), by)
    )
    ranked = grid.rank_configurations(scored, ties=["config"])
    return ranked.select("config", *[F.round(c, 6).alias(c) for c in ("silhouette", "db_index")], "num_clusters", *[F.round(c, 6).alias(c) for c in ("max_min_ratio", "missing_rate", "composite")])


#: The settings of the study: eleven radii and seven least counts, three numbers of clusters.
EPS, MIN_PTS, KS = [round(0.2 * k, 1) for k in range(11)], range(2, 9), (2, 3, 4)


@query("grid_search")
def grid_search(spark, sf):
    """Every setting of one reduction: three indicators, two components."""
    chosen = ["stress", "domestic", "productivity"]
    plan = grid.reductions(grid.feature_subsets(spark, chosen, least=3), most_pc=2)
    found = grid.grid_search(means(spark, sf, *chosen), "entity", chosen, plan, KS, EPS, MIN_PTS)
    return found.select(
        "method", F.array_join("features", ",").alias("features"), "n_pc", F.concat_ws(", ", F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("param"),
        "num_clusters", *[F.round(c, 6).alias(c) for c in ("silhouette", "db_index", "max_min_ratio", "missing_rate")],
    )


@query("cluster_profile", LABELLED_SQL + """, w AS (SELECT cluster, avg(m.stress) AS stress, avg(m.domestic) AS domestic FROM lab JOIN m USING (entity) GROUP BY 1)
SELECT cluster, 'stress' AS feature, round(stress, 5) AS mean, round(log10(stress + 1), 6) AS log_mean FROM w UNION ALL SELECT cluster, 'domestic', round(domestic, 5), round(log10(domestic + 1), 6) FROM w""")
def cluster_profile(spark, sf):
    rows = relations.merge(labelled(spark, sf).select("entity", "cluster"), means(spark, sf, "stress", "domestic"), "entity")
    found = scores.profile(rows, "cluster", ["stress", "domestic"])
    return found.select("cluster", "feature", F.round("mean", 5).alias("mean"), F.round("log_mean", 6).alias("log_mean"))


@query("cluster_map_join", LABELLED_SQL + "SELECT c_custkey AS entity, n_name AS place, cluster FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lab ON entity = c_custkey")
def cluster_map_join(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    base = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey", "left")
    mapped = relations.attach_as(base, labelled(spark, sf).select("entity", "cluster"), "c_custkey", "entity")
    return mapped.select(F.col("c_custkey").alias("entity"), "place", "cluster")


FIVE = ["productivity", "gdppc", "stress", "agriculture", "industry"]
LABEL_SQL = """, g AS (SELECT entity, max(CASE WHEN year = 1995 THEN population END) AS a, max(CASE WHEN year = 2000 THEN population END) AS b FROM panel GROUP BY 1),
lb AS (SELECT entity, CASE WHEN (b - a) / nullif(a, 0) * 100 < 30 THEN 'Slow_growth' ELSE 'Rapid_growth' END AS label FROM g)
"""
BLOCK_SQL = PANEL_SQL + LABEL_SQL + ", fm AS (SELECT entity, " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_sd, min({c}) AS {c}_min, max({c}) AS {c}_max, CASE WHEN count({c}) > 1 THEN regr_slope({c}, year) END AS {c}_slope" for c in FIVE
) + " FROM panel WHERE year <= 2000 GROUP BY 1)\n"


def labels(spark, sf):
    return derive.growth_label(panel(spark, sf), "population", 1995, 2000)


def matrix(spark, sf):
    return features.feature_matrix(panel(spark, sf).where(F.col("year") <= 2000), FIVE, labels(spark, sf))


_matrices: dict[tuple, DataFrame] = {}


def stored_matrix(spark, sf) -> DataFrame:
    """The feature matrix, written once a session for the models that read it many times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _matrices:
        _matrices[key] = materialize(matrix(spark, sf), "matrix")
    return _matrices[key]


BLOCK = [f"{c}_{s}" for c in FIVE for s in ("mean", "sd", "min", "max", "slope")]


@query("feature_matrix", BLOCK_SQL + "SELECT entity, label, " + ", ".join(f"round({c} + 0.0000137, 4) AS {c}" for c in BLOCK) + " FROM fm JOIN lb USING (entity) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in BLOCK))
def feature_matrix(spark, sf):
    # Both sides are moved off the rounding ties of exact cents.
    return matrix(spark, sf).select("entity", "label", *[F.round(F.col(c) + 0.0000137, 4).alias(c) for c in BLOCK])


FOLD_SQL = PANEL_SQL + LABEL_SQL + """, fo AS (SELECT entity, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(entity::VARCHAR || '#7')) - 1) % 5 + 1)::BIGINT AS fold FROM lb),
pr AS (SELECT *, CASE WHEN substr(md5(entity::VARCHAR || '#11'), 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 'Rapid_growth' ELSE 'Slow_growth' END AS pred FROM fo)
"""


def folds(spark, sf):
    return classify.stratified_folds(labels(spark, sf).select("entity", "label"), "entity", "label", 5, 7)


def baseline(spark, sf):
    return classify.random_baseline(folds(spark, sf), "entity", 11).withColumnRenamed("label", "truth")


@query("stratified_folds", FOLD_SQL + "SELECT entity, label, fold FROM fo")
def stratified_folds(spark, sf):
    return folds(spark, sf).select("entity", "label", F.col("fold").cast("long").alias("fold"))


@query("random_baseline", FOLD_SQL + "SELECT entity, fold, label AS truth, pred FROM pr")
def random_baseline(spark, sf):
    return baseline(spark, sf).select("entity", F.col("fold").cast("long").alias("fold"), "truth", "pred")


CONF_SQL = FOLD_SQL + """, cf AS (SELECT fold, sum((label = 'Rapid_growth' AND pred = 'Rapid_growth')::INT)::BIGINT AS tp, sum((label <> 'Rapid_growth' AND pred = 'Rapid_growth')::INT)::BIGINT AS fp,
  sum((label = 'Rapid_growth' AND pred <> 'Rapid_growth')::INT)::BIGINT AS fn, sum((label <> 'Rapid_growth' AND pred <> 'Rapid_growth')::INT)::BIGINT AS tn FROM pr GROUP BY 1),
fr AS (SELECT fold, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy FROM cf)
"""


@query("f1_accuracy", CONF_SQL + "SELECT fold, round(f1, 7) AS f1, round(accuracy, 7) AS accuracy FROM fr")
def f1_accuracy(spark, sf):
    found = metrics.f1_accuracy(baseline(spark, sf), ["fold"])
    return found.select(F.col("fold").cast("long").alias("fold"), F.round("f1", 7).alias("f1"), F.round("accuracy", 7).alias("accuracy"))


@query("confusion", CONF_SQL + "SELECT fold, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fn), 7) AS sensitivity, round(tn::DOUBLE / (tn + fp), 7) AS specificity FROM cf")
def confusion(spark, sf):
    found = metrics.confusion(baseline(spark, sf), ["fold"])
    return found.select(F.col("fold").cast("long").alias("fold"), "tp", "fp", "fn", "tn", F.round("sensitivity", 7).alias("sensitivity"), F.round("specificity", 7).alias("specificity"))


@query("roc_auc", """WITH s AS (SELECT lang, n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id))
SELECT p.lang, round(sum(CASE WHEN p.x > n.x THEN 1.0::DOUBLE WHEN p.x = n.x THEN 0.5 ELSE 0 END) / count(*), 7) AS auc FROM s p JOIN s n ON p.lang = n.lang AND p.y = 1 AND n.y = 0 GROUP BY 1""")
def roc_auc(spark, sf):
    truth = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, derive.RAPID).otherwise(derive.SLOW).alias("truth"))
    scored = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(truth, "doc_id")
    found = metrics.roc_auc(scored, "n_chars", ["lang"])
    return found.where(F.col("auc").isNotNull()).select("lang", F.round("auc", 7).alias("auc"))


@query("fold_summary", CONF_SQL + """SELECT round(avg(f1), 7) AS mean_f1, round(stddev_samp(f1), 7) AS sd_f1, round(avg(accuracy), 7) AS mean_accuracy, round(stddev_samp(accuracy), 7) AS sd_accuracy,
  round(avg(f1) - 2.7764451051977987 * stddev_samp(f1) / sqrt(count(*)), 6) AS ci_f1_l, round(avg(f1) + 2.7764451051977987 * stddev_samp(f1) / sqrt(count(*)), 6) AS ci_f1_u, 'RandomBaseline' AS model FROM fr""")
def fold_summary(spark, sf):
    results = metrics.f1_accuracy(baseline(spark, sf), ["fold"]).withColumn("model", F.lit("RandomBaseline"))
    found = metrics.fold_summary(results, ["f1", "accuracy"])
    return found.select("model", *[F.round(c, 7).alias(c) for c in ("mean_f1", "sd_f1", "mean_accuracy", "sd_accuracy")], F.round("ci_f1_l", 6).alias("ci_f1_l"), F.round("ci_f1_u", 6).alias("ci_f1_u"))


WEIGHTS = {"stress": 0.02, "domestic": -0.03}


@query("partial_dependence", MEANS_SQL + """SELECT g::DOUBLE AS value, round(avg(1 / (1 + exp(-(0.02 * g - 0.03 * domestic + 0.1)))), 7) AS mean_prob FROM m, (SELECT unnest(generate_series(0, 200, 20)) AS g) WHERE stress IS NOT NULL AND domestic IS NOT NULL GROUP BY 1""")
def partial_dependence(spark, sf):
    probability = lambda d: d.withColumn("prob", classify.linear_probability(WEIGHTS, 0.1))
    found = classify.partial_dependence(means(spark, sf, "stress", "domestic"), "stress", range(0, 201, 20), probability)
    return found.withColumn("mean_prob", F.round("mean_prob", 7))


_studies: dict[tuple, elastic_net.Study] = {}


def study(spark, sf) -> elastic_net.Study:
    """The tuned elastic net at full width: 30 draws, 10 times 5 folds, on all rows and in each of 5 outer folds.

    Fitted once a session; its short tables and the predictions are stored, as the panel is.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _studies:
        found = elastic_net.nested_study(stored_matrix(spark, sf), "entity", "label", BLOCK)
        found.predictions = materialize(found.predictions, "predictions")
        _studies[key] = found
    return _studies[key]


@query("elastic_net_cv")
def elastic_net_cv(spark, sf):
    """Score of every draw on all rows; the best one first by its order."""
    rows = study(spark, sf).draws.where("fold = 0")
    return rows.select("draw", *[F.round(c, 6).alias(c) for c in ("mix", "reg", "mean_f1", "sd_f1")], "at_rest")


@query("nested_cv")
def nested_cv(spark, sf):
    """Out-of-fold predictions of the model tuned inside each outer fold."""
    return study(spark, sf).predictions.select("fold", "entity", "truth", "pred", F.round("prob", 6).alias("prob"))


def model_results(spark, sf):
    """F1 and accuracy by outer fold of the tuned model and of the random baseline on the same folds."""
    predictions = study(spark, sf).predictions
    random = classify.random_baseline(predictions.select("fold", "entity", "truth"), "entity", 11)
    scored = [elastic_net.fold_scores(d).withColumn("model", F.lit(name)) for name, d in (("ElasticNet", predictions), ("RandomBaseline", random))]
    return relations.stack(scored)


@query("model_summary")
def model_summary(spark, sf):
    found = metrics.fold_summary(model_results(spark, sf), ["f1", "accuracy"])
    return found.select("model", *[F.round(c, 6).alias(c) for c in found.columns if c != "model"])


@query("model_comparison")
def model_comparison(spark, sf):
    found = metrics.compare_models(model_results(spark, sf), "f1", [("ElasticNet", "RandomBaseline")])
    return found.select("comparison", F.round("mean_diff", 6).alias("mean_diff"), F.round("p_value", 6).alias("p_value"))


@query("importance_odds")
def importance_odds(spark, sf):
    """The ten features of greatest effect in the tuned model."""
    found = elastic_net.interpreted(study(spark, sf).coefficients)
    return classify.top(found.select("feature", *[F.round(c, 6).alias(c) for c in ("estimate", "odds_ratio", "importance")], "direction"), "estimate", 10, "feature")


@query("partial_dependence_model")
def partial_dependence_model(spark, sf):
    """Mean predicted probability over twenty values of each of the three features of greatest effect."""
    found, rows = study(spark, sf), stored_matrix(spark, sf)
    parts = []
    for row in classify.top(found.coefficients, "estimate", 3, "feature").collect():
        name = row["feature"]
        probability = lambda d: d.withColumn("prob", classify.linear_probability(found.slopes, found.intercept))
        part = classify.partial_dependence(rows, name, classify.grid_values(rows, name), probability)
        parts.append(part.select(F.lit(name).alias("feature"), F.round("value", 6).alias("value"), F.round("mean_prob", 6).alias("mean_prob")))
    return relations.stack(parts)


@query("misclassification_map")
def misclassification_map(spark, sf):
    """Share of wrong out-of-fold predictions by place; places without predictions stay."""
    place = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    rates = metrics.error_rates(relations.merge(study(spark, sf).predictions, place, "entity"), "c_nationkey")
    mapped = relations.attach_as(table(spark, sf, "nation").select("n_nationkey", "n_name"), rates, "n_nationkey", "c_nationkey")
    return mapped.select("n_name", F.round("mis_rate", 6).alias("mis_rate"))
