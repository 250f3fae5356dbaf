"""Queries on dimensionality reduction, alignment and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.numeric import rounded as R
from ..operators import alignment as al, decoding as dc, epochs as ep, multiset as ms, sketches as sk, stats as st
from .registry import query

STEPS = 8


def _trajectories(spark, sf):
    """Features of one trial, time-major."""
    rows = ep.flatten_features(b.features_long(spark, sf), ["subject", "trial", "label"], ["t", "ch"])
    return rows


@query("pca_variance")
def pca_variance(spark, sf):
    models = dc.fit_pca(b.features(spark, sf), ["subject"], 0.8)
    return models.select(
        "subject", "n", F.size("eigen").alias("k"), R(F.aggregate("ratio", F.lit(0.0), lambda a, x: a + x)).alias("explained")
    )


@query("decode_cv")
def decode_cv(spark, sf):
    predictions = dc.decode_within(b.features(spark, sf), k=5, n_iter=2)
    return dc.decode_scores(predictions)


@query(
    "decode_grid",
    f"""WITH {b.FEATURES_SQL}, c AS (SELECT subject, trial // 4 % 2 AS period, count(*) AS n FROM feat GROUP BY ALL)
    SELECT subject, period, CAST(iter AS INTEGER) AS iter, n FROM c, range(2) AS r(iter)""",
)
def decode_grid(spark, sf):
    """Rows predicted per cell of subject x period and iteration: each once."""
    rows = b.features(spark, sf).withColumn("period", F.pmod(F.floor(F.col("trial") / 4), F.lit(2)))
    predictions = dc.decode_within(rows, k=5, n_iter=2, keys=["subject", "period"])
    return predictions.groupBy("subject", "period", "iter").agg(F.countDistinct("trial").alias("n"))


@query("decode_chance")
def decode_chance(spark, sf):
    predictions = dc.decode_within(b.features(spark, sf), k=5, n_iter=2, chance=True)
    return dc.decode_scores(predictions)


@query("decode_rbf")
def decode_rbf(spark, sf):
    return dc.decode_within(b.features(spark, sf), k=5, n_iter=1)


@query("decode_linear")
def decode_linear(spark, sf):
    rows = st.stratified_folds(b.features(spark, sf).drop("subject"), "trial", 5)
    return dc.decode_linear_folds(rows, 5)


@query("pool_sep_pca")
def pool_sep_pca(spark, sf):
    out = al.pool_separate_pca(_trajectories(spark, sf), 0, STEPS)
    return out.withColumn("vec", F.transform("vec", lambda v: R(v)))


def _sides(spark, sf):
    steps = al.time_rows(_trajectories(spark, sf), STEPS)
    return steps.filter("subject = 0").drop("subject"), steps.filter("subject > 0")


@query("cca_corr")
def cca_corr(spark, sf):
    a, other = _sides(spark, sf)
    models = al.fit_cca(al.pair_classes(a, other, ["subject"]), ["subject"])
    return models.select("subject", F.posexplode("corr").alias("component", "r")).withColumn("r", R(F.col("r")))


@query("cca_corr_trials")
def cca_corr_trials(spark, sf):
    a, other = _sides(spark, sf)
    models = al.fit_cca(al.pair_trials(a, other, ["subject"]), ["subject"])
    return models.select("subject", F.posexplode("corr").alias("component", "r")).withColumn("r", R(F.col("r")))


@query("cca_transform")
def cca_transform(spark, sf):
    a, other = _sides(spark, sf)
    models = al.fit_cca(al.pair_classes(a, other, ["subject"]), ["subject"])
    out = al.transform(other, al.cca_matrix(models), ["subject"], "trial", ["label", "t"])
    return out.withColumn("vec", F.transform("vec", lambda v: R(v)))


@query("decode_cross")
def decode_cross(spark, sf):
    predictions = al.decode_across(_trajectories(spark, sf), 0, STEPS, k=5, n_iter=2)
    return dc.decode_scores(predictions)


def _class_means(spark, sf):
    """Class-mean trajectories of the four subjects, under one key."""
    steps = al.time_rows(_trajectories(spark, sf), STEPS)
    return al.class_means(steps, ["subject"]).withColumn("all", F.lit(0))


MCCA_REG = 0.3


@query(
    "mcca_invariants",
    """SELECT CAST(c AS INTEGER) AS component, 1.0 AS norm, 0.0 AS mixed, 0.0 AS residual FROM range(5) AS r(c)""",
)
def mcca_invariants(spark, sf):
    """What makes the components canonical, measured on the data.

    ``norm``: sum over the sets of (1 - reg) times the variate's squares plus reg times the weights' squares; ``mixed``: the
    greatest such product of two components; ``residual``: squares of the summed variates against the eigenvalue.
    """
    rows = _class_means(spark, sf)
    maps = ms.fit_sets(rows, ["all"], ["label", "t"], ms.mcca(5, MCCA_REG))
    y = ms.variates(rows, maps, ["all"]).select("subject", "label", "t", F.col("vec").alias("y"))
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda a: F.transform(
        F.sequence(F.lit(0), F.lit(4)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    products = y.select(pairs.alias("p"), "y").select("p.*", (F.get("y", F.col("p.a")) * F.get("y", F.col("p.b"))).alias("v"))
    places = F.sequence(F.lit(0), (F.size("matrix") / 5 - 1).cast("int"))
    weights = maps.select("matrix", F.explode(places).alias("d")).select(pairs.alias("p"), "matrix", "d").select(
        "p.*", (F.get("matrix", F.col("d") * 5 + F.col("p.a")) * F.get("matrix", F.col("d") * 5 + F.col("p.b"))).alias("v")
    )
    terms = products.withColumn("v", F.col("v") * (1 - MCCA_REG)).unionByName(weights.withColumn("v", F.col("v") * MCCA_REG))
    form = terms.groupBy("a", "b").agg(F.sum("v").alias("v")).groupBy("a").agg(
        R(F.max(F.when(F.col("a") == F.col("b"), F.col("v")))).alias("norm"),
        R(F.abs(F.max(F.when(F.col("a") != F.col("b"), F.abs("v"))))).alias("mixed"),
    )
    summed = y.select("label", "t", F.posexplode("y").alias("a", "v")).groupBy("label", "t", "a").agg(F.sum("v").alias("v"))
    power = summed.groupBy("a").agg(F.sum(F.col("v") * F.col("v")).alias("power"))
    eigen = maps.select(F.posexplode("eigen").alias("a", "eigen")).distinct()
    return form.join(power, "a").join(eigen, "a").select(
        F.col("a").alias("component"), "norm", "mixed", R(F.abs(F.col("power") / F.col("eigen") - 1)).alias("residual")
    )


@query(
    "joint_variance",
    f"""WITH {b.FEATURES_SQL}, m AS (SELECT subject, label, t, ch, avg(value) AS v FROM fl GROUP BY ALL),
    c AS (SELECT subject, ch, v - avg(v) OVER (PARTITION BY subject, ch) AS v FROM m
          WHERE (label, t) IN (SELECT (label, t) FROM m GROUP BY label, t HAVING count(DISTINCT subject) = (SELECT count(DISTINCT subject) FROM m)))
    SELECT round(sum(v * v), 6) AS total, (SELECT count(*) FROM (SELECT DISTINCT subject, ch FROM m)) AS axes FROM c""",
)
def joint_variance(spark, sf):
    """Variance that the joint axes of all subjects hold together: all of it."""
    axes = 32
    maps = ms.fit_sets(_class_means(spark, sf), ["all"], ["label", "t"], ms.joint_axes(axes))
    one = maps.select("eigen").limit(1)
    return one.select(R(F.aggregate("eigen", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("eigen").cast("long").alias("axes"))


@query("decode_mcca")
def decode_mcca(spark, sf):
    """Class means aligned by multi-set CCA; the target trains too."""
    options = dict(k=5, n_iter=2, n_comp_align=0.99, fit_maps=al.mean_maps(ms.mcca(5, 0.5)))
    return dc.decode_scores(al.decode_across(_trajectories(spark, sf), 0, STEPS, **options))


@query("decode_joint")
def decode_joint(spark, sf):
    """Joint axes of the trials of all subjects; only the others train."""
    options = dict(k=5, n_iter=2, target_trains=False, joint=ms.joint_axes(0.8))
    return dc.decode_scores(al.decode_across(_trajectories(spark, sf), 0, STEPS, **options))


@query("decode_margin")
def decode_margin(spark, sf):
    """The maximum-margin classifier; every row predicted once."""
    return dc.decode_within(b.features(spark, sf), k=5, n_iter=1, classifier="margin")


_FOLDS_SQL = """n AS (SELECT subject, label, count(*) AS n FROM feat GROUP BY ALL),
    big AS (SELECT subject, max(n) AS m FROM n GROUP BY subject),
    kf AS (SELECT subject, iter, trial, label, (row_number() OVER (PARTITION BY subject, iter
      ORDER BY CASE WHEN m >= 5 THEN label END, md5('42|' || iter || '|' || trial), trial) - 1) % 5 AS fold
      FROM feat JOIN big USING (subject), range(2) AS i(iter))"""


@query(
    "decode_nearest_mean",
    f"""WITH {b.FEATURES_SQL}, {_FOLDS_SQL},
    s AS (SELECT subject, iter, fold, kf.label, ch * 8 + t AS i, sum(value) AS s, count(*) AS n
          FROM kf JOIN fl USING (subject, trial) GROUP BY ALL),
    m AS (SELECT subject, iter, f.fold, label, i, sum(s) / sum(n) AS v FROM s JOIN range(5) AS f(fold) ON f.fold <> s.fold GROUP BY ALL),
    d AS (SELECT subject, iter, trial, kf.label AS y, m.label, sum((value - v) * (value - v)) AS d
          FROM kf JOIN m USING (subject, iter, fold) JOIN fl USING (subject, trial) WHERE fl.ch * 8 + fl.t = m.i GROUP BY ALL)
    SELECT CAST(subject AS VARCHAR) AS target, CAST(iter AS INTEGER) AS iter, trial, CAST(y AS INTEGER) AS y,
      CAST(arg_min(label, d) AS INTEGER) AS y_pred FROM d GROUP BY subject, iter, trial, y""",
)
def decode_nearest_mean(spark, sf):
    """Nearest class mean of the whole vectors: registered estimators by name."""
    return dc.decode_within(b.features(spark, sf), k=5, n_iter=2, reducer="none", classifier="nearest_mean")


@query("decode_discriminant")
def decode_discriminant(spark, sf):
    """Linear discriminant analysis on principal components, chosen by name."""
    return dc.decode_scores(dc.decode_within(b.features(spark, sf), k=5, n_iter=2, classifier="discriminant"))


LONG = 4096


def _long_trials(spark, sf):
    """Sixty-four feature vectors one after another as one trial of 4096 values; two subjects."""
    rows = b.features(spark, sf).withColumn("long", F.floor(F.col("trial") / 64))
    parts = F.array_sort(F.collect_list(F.struct("trial", "vec")))
    whole = rows.groupBy("long").agg(parts.alias("p")).filter(F.size("p") == 64)
    return whole.select(
        F.col("long").alias("trial"), F.pmod("long", F.lit(2)).alias("subject"), F.flatten(F.transform("p", lambda s: s["vec"])).alias("vec")
    )


@query(
    "pca_long",
    f"""WITH {b.FEATURES_SQL}, l AS (SELECT trial // 64 AS long, trial % 64 AS step, vec FROM feat
      WHERE trial // 64 IN (SELECT trial // 64 FROM feat GROUP BY 1 HAVING count(*) = 64)),
    v AS (SELECT long % 2 AS subject, long, step, i, CAST(vec[i + 1] AS DOUBLE) AS x FROM l, range(64) AS r(i)),
    s AS (SELECT subject, step, i, var_samp(x) AS v FROM v GROUP BY ALL)
    SELECT subject, (SELECT count(DISTINCT long) FROM v AS o WHERE o.subject = s.subject) AS n, round(sum(v), 6) AS variance, 1.0 AS explained
    FROM s GROUP BY subject""",
)
def pca_long(spark, sf):
    """All axes of long trials hold their whole variance."""
    models = sk.fit_pca(_long_trials(spark, sf), ["subject"], "trial", LONG, rank=None)
    def total(name):
        return F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    return models.select("subject", "n", R(total("eigen")).alias("variance"), R(total("ratio")).alias("explained"))
