"""Canonical-correlation alignment of subjects and cross-subject decoding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans import apply_model, cut_lineage, join_keys, moments
from ..plans.blocks import gram_tiles
from . import decoding as dc, estimators as es, multiset as ms, stats as st

CCA_SCHEMA = "m_a array<double>, m_b array<double>, corr array<double>, dim_a int, dim_b int"


def canonical_directions(n: float, total: np.ndarray, gram: np.ndarray, dim_a: int):
    """CCA of paired vectors ``[a, b]`` from their joint sums.

    Both sides are whitened from their covariance (directions without variance left out);
    the singular vectors of the whitened cross-covariance give the directions. Returns
    ``m_a`` (dim_a x d), ``m_b`` (dim_b x d) and the correlations clipped to [0, 1], where
    d is the smaller rank.
    """
    size = len(total)
    mean = total / n
    cov = gram.reshape(size, size) - n * np.outer(mean, mean)

    def whiten(block: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh((block + block.T) / 2)
        keep = values > max(values.max(initial=0.0), 0.0) * 1e-10
        return vectors[:, keep] / np.sqrt(values[keep])

    w_a, w_b = whiten(cov[:dim_a, :dim_a]), whiten(cov[dim_a:, dim_a:])
    u, s, vt = np.linalg.svd(w_a.T @ cov[:dim_a, dim_a:] @ w_b)
    d = min(w_a.shape[1], w_b.shape[1])
    return w_a @ u[:, :d], w_b @ vt.T[:, :d], np.clip(s[:d], 0.0, 1.0)


def class_means(rows: DataFrame, keys: Sequence[str], vec: str = "vec", label: str = "label") -> DataFrame:
    """Mean vector per keys, label and time ``t``."""
    per_position = (
        rows.select(*keys, label, "t", F.posexplode(vec).alias("__p", "__v"))
        .groupBy(*keys, label, "t", "__p")
        .agg(F.avg("__v").alias("__v"))
    )
    parts = F.array_sort(F.collect_list(F.struct("__p", "__v")))
    return per_position.groupBy(*keys, label, "t").agg(F.transform(parts, lambda s: s["__v"]).alias("vec"))


def fit_cca(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CCA per ``keys`` from paired vectors ``vec_a``, ``vec_b``."""
    joint = pairs.select(
        *keys, F.concat("vec_a", "vec_b").alias("__vec"), F.size("vec_a").alias("dim_a")
    )
    stats = moments(joint, [*keys, "dim_a"], "__vec")

    @F.pandas_udf(CCA_SCHEMA)
    def fit(n: pd.Series, total: pd.Series, gram: pd.Series, dim_a: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, d in zip(n, total, gram, dim_a):
            m_a, m_b, corr = canonical_directions(a, np.asarray(b), np.asarray(c), d)
            out.append((m_a.ravel(), m_b.ravel(), corr, d, len(b) - d))
        return pd.DataFrame(out, columns=["m_a", "m_b", "corr", "dim_a", "dim_b"])

    return stats.withColumn("__c", fit(F.col("n").cast("double"), "total", "gram", "dim_a")).select(*keys, "__c.*")


def pair_classes(a: DataFrame, b: DataFrame, keys_b: Sequence[str]) -> DataFrame:
    """Class-mean time courses of two sides paired on the labels and times both have."""
    left = class_means(a, []).withColumnRenamed("vec", "vec_a")
    right = class_means(b, list(keys_b)).withColumnRenamed("vec", "vec_b")
    return right.join(left, ["label", "t"])


def pair_trials(a: DataFrame, b: DataFrame, keys_b: Sequence[str], seed: int = 42) -> DataFrame:
    """Single trials of two sides paired per label: as many as the side with fewer has.

    Trials are ranked in hash order on each side and matched rank by rank.
    """

    def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
        ids = rows.select(*keys, "label", "trial").distinct()
        text = st._seed_text(F.lit(str(seed)), *keys, "trial")
        return st.hashed_rank(ids, [*keys, "label"], text, ["trial"], "__pick")

    keys = list(keys_b)
    left = a.join(ranked(a, []), ["label", "trial"]).select("label", "__pick", "t", F.col("vec").alias("vec_a"))
    right = b.join(ranked(b, keys), [*keys, "label", "trial"]).select(
        *keys, "label", "__pick", "t", F.col("vec").alias("vec_b")
    )
    return right.join(left, ["label", "__pick", "t"])


def cca_matrix(models: DataFrame, space: str = "b_to_a") -> DataFrame:
    """Matrix (row-major, ``rows`` lines) that carries vectors to another space.

    ``b_to_a`` carries side b to a, ``a_to_b`` the reverse; ``shared_a`` and ``shared_b``
    carry each side to the canonical space.
    """
    if space not in ("b_to_a", "a_to_b", "shared_a", "shared_b"):
        raise ValueError(f"unknown space: {space}")

    @F.pandas_udf("matrix array<double>, rows int")
    def build(m_a: pd.Series, m_b: pd.Series, dim_a: pd.Series, dim_b: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, da, db in zip(m_a, m_b, dim_a, dim_b):
            a, b = np.asarray(a).reshape(da, -1), np.asarray(b).reshape(db, -1)
            matrix = {
                "b_to_a": lambda: b @ np.linalg.pinv(a),
                "a_to_b": lambda: a @ np.linalg.pinv(b),
                "shared_a": lambda: a,
                "shared_b": lambda: b,
            }[space]()
            out.append((matrix.ravel(), matrix.shape[0]))
        return pd.DataFrame(out, columns=["matrix", "rows"])

    kept = [c for c in models.columns if c not in ("m_a", "m_b", "corr", "dim_a", "dim_b")]
    return models.withColumn("__m", build("m_a", "m_b", "dim_a", "dim_b")).select(*kept, "__m.*")


def transform(rows: DataFrame, matrices: DataFrame, keys: Sequence[str], row_id: str, carry: Sequence[str]) -> DataFrame:
    """Row vectors times their key's matrix."""
    columns = [*keys, row_id, *[c for c in carry if c not in (*keys, row_id)]]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", vec array<double>"

    def run(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        matrix = np.asarray(model["matrix"].iloc[0]).reshape(int(model["rows"].iloc[0]), -1)
        out = block[columns].copy()
        out["vec"] = list(np.array(block["vec"].tolist()) @ matrix)
        return out

    return apply_model(rows.select(*columns, "vec"), matrices, keys, run, schema, row_id)


# --- time-resolved rows ------------------------------------------------------------


def time_rows(rows: DataFrame, n_steps: int, first: int = 0, stop: int | None = None) -> DataFrame:
    """Trial vectors (time-major) to one row per time step with the channel vector.

    ``first``/``stop`` select time steps (half-open). Subjects may differ in their number of
    channels.
    """
    times = F.array(*[F.lit(t) for t in range(first, n_steps if stop is None else min(stop, n_steps))])
    channels = F.floor(F.size("vec") / F.lit(n_steps)).cast("int")
    others = [c for c in rows.columns if c != "vec"]
    return rows.withColumn("t", F.explode(times)).select(
        *others, "t", F.slice("vec", F.col("t") * channels + 1, channels).alias("vec")
    )


def window_steps(n_steps: int, full: tuple[float, float], window: tuple[float, float]) -> tuple[int, int]:
    """Half-open range of the time steps inside ``window`` (ends included) on ``full``."""
    times = np.linspace(full[0], full[1], n_steps)
    inside = np.flatnonzero((times >= window[0]) & (times <= window[1]))
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)


def truncate_axes(models: DataFrame, k) -> DataFrame:
    """Keep the first ``k`` axes of PCA models (``k`` a number or column)."""
    dim = F.size("mean")
    return models.withColumn("comps", F.slice("comps", F.lit(1), (dim * k).cast("int")))


def separate_pca(rows: DataFrame, n_steps: int, n_comp: float = 0.8) -> DataFrame:
    """Channel PCA per subject, cut to the smallest number of axes any subject needs."""
    models = dc.fit_pca(time_rows(rows, n_steps), ["subject"], n_comp)
    common = models.agg(F.min(F.size("eigen")).alias("__k"))
    return truncate_axes(join_keys(models, common, []), F.col("__k")).drop("__k")


def pool_separate_pca(rows: DataFrame, target, n_steps: int, n_comp: float = 0.8) -> DataFrame:
    """Pooled trials of all subjects in their own axes, labels of the target only.

    Result: subject, trial, label, vec (time-major latent trajectory).
    """
    models = separate_pca(rows, n_steps, n_comp)
    latent = dc.project(
        time_rows(rows, n_steps), models, ["subject"], "trial", carry=["label", "t"]
    )
    parts = F.array_sort(F.collect_list(F.struct("t", "vec")))
    flat = latent.groupBy("subject", "trial", "label").agg(
        F.flatten(F.transform(parts, lambda s: s["vec"])).alias("vec")
    )
    return st.shared_labels(flat, rows.filter(F.col("subject") == F.lit(target)))


# --- cross-subject decoding ----------------------------------------------------------


def _map_udf():
    @F.pandas_udf("array<double>")
    def combine(comps: pd.Series, mean: pd.Series, matrix: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series(
            [
                (np.asarray(c).reshape(-1, len(m)).T @ np.asarray(x).reshape(int(r), -1)).ravel()
                for c, m, x, r in zip(comps, mean, matrix, rows)
            ]
        )

    return combine


def _transpose_udf():
    @F.pandas_udf("array<double>")
    def transpose(comps: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(c).reshape(-1, len(m)).T.ravel() for c, m in zip(comps, mean)])

    return transpose


def _axes_udf():
    @F.pandas_udf("array<double>")
    def to_axes(vec: pd.Series, mean: pd.Series, comps: pd.Series) -> pd.Series:
        return pd.Series(
            [(np.asarray(v) - m) @ np.asarray(c).reshape(-1, len(m)).T for v, m, c in zip(vec, mean, comps)]
        )

    return to_axes


FOLD = ["iter", "test_fold"]


def _own_axes(pca: DataFrame) -> DataFrame:
    """Linear maps that are nothing but a subject's own axes."""
    return pca.select(
        "subject", *FOLD, F.col("mean").alias("lin_mean"), _transpose_udf()("comps", "mean").alias("lin_matrix")
    )


def cca_maps(
    target_means: DataFrame, source_means: DataFrame, target_pca: DataFrame, source_pca: DataFrame
) -> DataFrame:
    """The target in its own axes, the sources carried into them by CCA of class-mean trajectories.

    Works on class means only (labels x times x channels).
    """
    a = target_means.join(target_pca.drop("subject"), FOLD).select(
        *FOLD, "label", "t", _axes_udf()("vec", "mean", "comps").alias("vec_a")
    )
    b = source_means.join(source_pca, "subject").select(
        "subject", "label", "t", _axes_udf()("vec", "mean", "comps").alias("vec_b")
    )
    fitted = cca_matrix(fit_cca(b.join(a, ["label", "t"]), ["subject", *FOLD]), "b_to_a")
    sources = fitted.join(source_pca, "subject").select(
        "subject", *FOLD, F.col("mean").alias("lin_mean"),
        _map_udf()("comps", "mean", "matrix", "rows").alias("lin_matrix"),
    )
    return sources.unionByName(_own_axes(target_pca))


def separate_maps(
    target_means: DataFrame, source_means: DataFrame, target_pca: DataFrame, source_pca: DataFrame
) -> DataFrame:
    """Every subject in its own axes, cut to the smallest number of axes among them."""
    # the folds are a short list that the target's models spell out: one array for all
    folds = target_pca.agg(F.collect_set(F.struct(*FOLD)).alias("__folds"))
    spread = join_keys(source_pca, folds, []).select("*", F.explode("__folds").alias("__f")).select(
        *source_pca.columns, *[F.col(f"__f.{c}").alias(c) for c in FOLD]
    )
    every = spread.unionByName(target_pca.select("subject", "mean", "comps", *FOLD))
    axes = F.floor(F.size("comps") / F.size("mean"))
    common = every.groupBy(*FOLD).agg(F.min(axes).alias("__k"))
    return _own_axes(truncate_axes(every.join(common, FOLD), F.col("__k")))


def mean_maps(solver: ms.Solver) -> Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]:
    """``fit_maps`` of a joint solver (see ``multiset``) over class-mean trajectories in the subjects' own axes."""

    def fit(target_means: DataFrame, source_means: DataFrame, target_pca: DataFrame, source_pca: DataFrame) -> DataFrame:
        folds = target_pca.agg(F.collect_set(F.struct(*FOLD)).alias("__folds"))
        own = target_means.join(target_pca, FOLD)
        others = join_keys(source_means.join(source_pca, "subject"), folds, []).withColumn("__f", F.explode("__folds"))
        others = others.withColumns({c: F.col(f"__f.{c}") for c in FOLD})
        columns = ["subject", *FOLD, "label", "t", _axes_udf()("vec", "mean", "comps").alias("vec")]
        fitted = ms.fit_sets(own.select(*columns).unionByName(others.select(*columns)), FOLD, ["label", "t"], solver)
        pca = target_pca.select("subject", *FOLD, "mean", "comps").unionByName(
            join_keys(source_pca, folds, []).withColumn("__f", F.explode("__folds")).select(
                "subject", *[F.col(f"__f.{c}").alias(c) for c in FOLD], "mean", "comps"
            )
        )
        maps = fitted.withColumnsRenamed({"set": "subject", "mean": "__shift"}).join(pca, ["subject", *FOLD])

        @F.pandas_udf("lin_mean array<double>, lin_matrix array<double>")
        def combine(comps: pd.Series, mean: pd.Series, shift: pd.Series, matrix: pd.Series) -> pd.DataFrame:
            out = []
            for c, m, s, x in zip(comps, mean, shift, matrix):
                axes = np.asarray(c).reshape(-1, len(m)).T
                out.append((np.asarray(m) + axes @ np.asarray(s), (axes @ np.asarray(x).reshape(len(s), -1)).ravel()))
            return pd.DataFrame(out, columns=["lin_mean", "lin_matrix"])

        return maps.withColumn("__m", combine("comps", "mean", "__shift", "matrix")).select("subject", *FOLD, "__m.*")

    return fit


def trial_maps(rows: DataFrame, target, k: int, n_steps: int, window: tuple[int, int], solver: ms.Solver, seed: int = 42) -> DataFrame:
    """Linear maps of a joint solver fitted on the trials of all subjects at once, per iteration and test fold.

    ``rows``: subject, trial, align_label, vec, ``folds`` (of the target's trials, NULL elsewhere). Trials are aligned
    by label and rank within it; a row belongs to the fold of the target's trial in it. Sums are kept per fold, and a
    training set is their total without its test fold.
    """
    aligned = cut_lineage(ms.aligned_trials(rows, seed, label="align_label"))
    folds = aligned.filter(F.col("subject") == F.lit(str(target))).select("align_label", "pick", "folds")
    steps = time_rows(aligned.drop("folds"), n_steps, *window).withColumn("__all", F.lit(0))
    joined, layout = ms.join_sets(steps, ["__all"], ["align_label", "pick", "t"])
    dealt = joined.join(folds, ["align_label", "pick"]).select("vec", F.posexplode("folds").alias("iter", "fold"))
    per_fold = gram_tiles(dealt, ["iter", "fold"], "vec")
    test_folds = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold")))
    spread = per_fold.withColumn("test_fold", test_folds).withColumn("__v", dc.array_to_vector("acc"))
    train = spread.groupBy(*FOLD, "i", "j").agg(dc.Summarizer.sum(F.col("__v")).alias("__v"))
    train = train.select(*FOLD, "i", "j", dc.vector_to_array("__v").alias("acc"), F.lit(0).alias("__all"))
    wide = join_keys(train, layout, ["__all"])
    fitted = ms.solve_sets(wide.drop("sets", "dims", "__all"), wide.select(*FOLD, "sets", "dims").distinct(), FOLD, solver)
    return fitted.select(F.col("set").alias("subject"), *FOLD, F.col("mean").alias("lin_mean"), F.col("matrix").alias("lin_matrix"))


# ways to bring subjects together, by name
Aligner = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]
ALIGNERS: dict[str, Aligner] = {"cca": cca_maps, "separate": separate_maps}


def register_aligner(name: str, fit_maps: Aligner) -> None:
    ALIGNERS[name] = fit_maps


def decode_across(
    rows: DataFrame,
    target,
    n_steps: int,
    full: tuple[float, float] = (-1.0, 1.0),
    align: tuple[float, float] = (-1.0, 1.0),
    decode: tuple[float, float] = (-0.5, 0.5),
    k: int = 20,
    n_iter: int = 10,
    n_comp_align: float = 0.9,
    n_comp_decode: float = 0.8,
    target_trains: bool = True,
    fit_maps: str | Aligner = cca_maps,
    seed: int = 42,
    size: int = 128,
    joint: ms.Solver | None = None,
    classifier: str | es.Decoder = "least_squares",
    reducer: str | es.Reducer = "pca",
) -> DataFrame:
    """Decode a target subject from its own and other subjects' trials.

    ``rows``: subject, trial, label, vec (time-major, ``n_steps`` x channels of the subject)
    and optionally ``align_label``. Per fold, the channel PCA and the class means of the target
    come from its training folds, kept as sums per fold so that a training set is the
    total without one fold. ``fit_maps`` turns class means and PCA models into one linear
    map per subject and fold (subject, iter, test_fold, ``lin_mean``, ``lin_matrix``): by
    default CCA into the target's axes; ``separate_maps`` pools without alignment, and ``mean_maps`` takes a
    joint solver of ``multiset`` (MCCA, stacked axes) to the class means. A solver passed as ``joint`` is fitted on the trials of all
    subjects at once instead. ``fit_maps`` may be the name of a registered aligner, ``reducer`` and ``classifier`` a
    caller's own (see ``estimators``). Alignment and decoding use their own time windows.
    Result: target, iter, trial, y, y_pred.
    """
    fit_maps = es.found(fit_maps, ALIGNERS, ())
    a0, a1 = window_steps(n_steps, full, align)
    d0, d1 = window_steps(n_steps, full, decode)
    fold = FOLD
    align_label = F.col("align_label") if "align_label" in rows.columns else F.col("label")
    typed = rows.select(
        F.col("subject").cast("string").alias("subject"), "trial", F.col("label").cast("int").alias("label"),
        align_label.alias("align_label"), "vec",
    )
    is_target = F.col("subject") == F.lit(str(target))
    own, others = typed.filter(is_target), typed.filter(~is_target)
    folded = dc.fold_table(own, "trial", k, n_iter, seed)
    own = own.join(dc._fold_arrays(folded, "trial", ["subject"]), ["subject", "trial"])
    classes = dc._training_classes(folded, k, ["subject"]).drop("subject")

    own = cut_lineage(own)  # rows with their folds, read by every statistic below
    pooled = own.unionByName(others.withColumn("folds", F.lit(None).cast("array<int>")))

    def decoded(maps: DataFrame) -> DataFrame:
        maps = maps.withColumn("trains", F.lit(target_trains) | (F.col("subject") != F.lit(str(target))))
        models = maps.join(classes, fold).select(
            F.lit(str(target)).alias("target"), "subject", *fold, "classes", "trains", "lin_mean", "lin_matrix",
            F.lit(d0).alias("t_first"), F.lit(d1).alias("t_stop"),
        )
        return dc.decode(pooled.drop("align_label"), models, k, n_comp_decode, size=size, seed=seed, classifier=classifier, reducer=reducer)

    if joint is not None:
        return decoded(trial_maps(pooled, target, k, n_steps, (a0, a1), joint, seed))
    own_steps = time_rows(own, n_steps, a0, a1).select(
        "align_label", "t", "vec", F.posexplode("folds").alias("iter", "fold")
    )
    test_folds = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold")))

    # sums per fold, then per training set
    per_fold = moments(own_steps, ["iter", "fold"], "vec").withColumn(
        "acc", F.concat(F.array(F.col("n").cast("double")), "total", "gram")
    )
    train = dc._sum_blocks(
        per_fold.withColumn("test_fold", test_folds).withColumn("target", F.lit(str(target)))
    )
    # length is 1 + d + d*d
    d = ((F.sqrt(4 * F.size("acc") - F.lit(3)) - 1) / 2).cast("int")
    target_stats = train.select(
        *fold, F.element_at("acc", 1).alias("n"), F.slice("acc", F.lit(2), d).alias("total"),
        F.slice("acc", d + 2, d * d).alias("gram"),
    )
    target_pca = dc.pca(target_stats, n_comp_align).select(
        F.lit(str(target)).alias("subject"), *fold, "mean", "comps"
    )

    sums = (
        own_steps.select("iter", "fold", F.col("align_label").alias("label"), "t", F.posexplode("vec").alias("p", "v"))
        .groupBy("iter", "fold", "label", "t", "p")
        .agg(F.sum("v").alias("s"), F.count("v").alias("n"))
        .withColumn("test_fold", test_folds)
        .groupBy(*fold, "label", "t", "p")
        .agg((F.sum("s") / F.sum("n")).alias("v"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("p", "v")))
    target_means = sums.groupBy(*fold, "label", "t").agg(F.transform(ordered, lambda s: s["v"]).alias("vec"))

    other_steps = time_rows(others, n_steps, a0, a1).select(
        "subject", F.col("align_label").alias("label"), "t", "vec"
    )
    source_means = class_means(other_steps, ["subject"])
    source_pca = dc.fit_pca(other_steps, ["subject"], n_comp_align).select("subject", "mean", "comps")

    return decoded(fit_maps(target_means, source_means, target_pca, source_pca))
