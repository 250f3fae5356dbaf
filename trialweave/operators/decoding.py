"""Dimensionality reduction and label decoding from additive statistics.

Every fit below is a sum over rows: counts, sums and Gram matrices. Tasks add up the
rows they hold, the sums meet in an aggregate, and the small systems (vector length
squared) are solved per model. Rows are shuffled once to blocks of bounded size; each
block is run against all models of its subject, so neither the number of trials of a
subject nor the number of folds decides how much one task holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..plans import apply_model, cut_lineage, join_measured, moments, run_blocks, split_blocks
from . import estimators as es, margin, stats as st

MODEL_KEYS = ["target", "iter", "test_fold"]


# --- principal components --------------------------------------------------------

PCA_SCHEMA = "mean array<double>, comps array<double>, eigen array<double>, ratio array<double>"


def principal_axes(n: float, total: np.ndarray, gram: np.ndarray, n_comp: float):
    """Mean, axes (rows), variances and their ratios; ``n_comp`` < 1 is a share of variance.

    The sign of an axis makes its largest entry positive.
    """
    d = len(total)
    mean = total / n
    cov = (gram.reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    ratio = values / values.sum() if values.sum() > 0 else np.full(d, 1.0 / d)
    if n_comp < 1:
        k = int(np.searchsorted(np.cumsum(ratio), n_comp, side="right")) + 1
    else:
        k = int(n_comp)
    k = max(1, min(k, d))
    axes = vectors[:, :k].T
    lead = np.abs(axes).argmax(axis=1)
    axes = axes * np.sign(axes[np.arange(k), lead])[:, None]
    return mean, axes, values[:k], ratio[:k]


def pca(stats: DataFrame, n_comp: float) -> DataFrame:
    """PCA per row of ``moments`` output: adds ``mean, comps`` (row-major), ``eigen, ratio``."""

    @F.pandas_udf(PCA_SCHEMA)
    def fit(n: pd.Series, total: pd.Series, gram: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c in zip(n, total, gram):
            mean, axes, eigen, ratio = principal_axes(a, np.asarray(b), np.asarray(c), n_comp)
            rows.append((mean, axes.ravel(), eigen, ratio))
        return pd.DataFrame(rows, columns=["mean", "comps", "eigen", "ratio"])

    return stats.withColumn("__p", fit(F.col("n").cast("double"), "total", "gram")).select(
        *[c for c in stats.columns if c not in ("total", "gram")], "__p.*"
    )


def fit_pca(rows: DataFrame, keys: Sequence[str], n_comp: float = 0.8, vec: str = "vec") -> DataFrame:
    return pca(moments(rows, keys, vec), n_comp)


def project(
    rows: DataFrame, models: DataFrame, keys: Sequence[str], row_id: str, carry: Sequence[str] = (),
    vec: str = "vec",
) -> DataFrame:
    """Row vectors in the axes of their key's PCA model (``mean``, ``comps``)."""
    columns = [*keys, row_id, *[c for c in carry if c not in (*keys, row_id)]]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in columns) + ", vec array<double>"

    def run(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        mean = np.asarray(model["mean"].iloc[0])
        axes = np.asarray(model["comps"].iloc[0]).reshape(-1, len(mean))
        out = block[columns].copy()
        out["vec"] = list((np.array(block[vec].tolist()) - mean) @ axes.T)
        return out

    small = models.select(*keys, "mean", "comps")
    return apply_model(rows.select(*columns, vec), small, keys, run, schema, row_id)


# --- folds and labels --------------------------------------------------------------


def fold_table(
    rows: DataFrame, row_id: str, k: int, n_iter: int, seed: int = 42, keys: Sequence[str] = ("subject",)
) -> DataFrame:
    """One fold per row and iteration: keys, row id, label, ``iter``, ``fold``."""
    ids = rows.select(*keys, row_id, "label").withColumn(
        "iter", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1)))
    )
    return st.stratified_folds(ids, row_id, k, seed, keys, salt=["iter"])


def _fold_arrays(folded: DataFrame, row_id: str, keys: Sequence[str]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("iter", "fold")))
    return folded.groupBy(*keys, row_id).agg(F.transform(parts, lambda s: s["fold"]).alias("folds"))


def _training_classes(folded: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """Sorted labels of every training set (keys, iter, test_fold)."""
    counts = folded.select(*keys, "iter", "fold", "label").distinct()
    return (
        counts.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .filter(F.col("test_fold") != F.col("fold"))
        .groupBy(*keys, "iter", "test_fold")
        .agg(F.sort_array(F.collect_set("label")).cast("array<int>").alias("classes"))
    )


def _shuffled_arrays(folded: DataFrame, row_id: str, k: int, n_iter: int, seed: int, keys) -> DataFrame:
    """Chance labels per row at position ``iter * k + test_fold``; -1 where the row is tested."""
    dealt = st.chance_labels(folded, row_id, k, seed, keys=[*keys, "iter"])
    entry = F.struct((F.col("iter") * k + F.col("test_fold")).cast("int"), F.col("label").cast("int"))
    table = dealt.groupBy(*keys, row_id).agg(F.map_from_entries(F.collect_list(entry)).alias("__m"))
    places = F.sequence(F.lit(0), F.lit(k * n_iter - 1))
    return table.select(
        *keys, row_id,
        F.transform(places, lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(-1))).alias("shuffled"),
    )


# --- kernel classifier -------------------------------------------------------------


def _features(z: np.ndarray, gamma: float, size: int, seed: int) -> np.ndarray:
    """Random Fourier features of the RBF kernel ``exp(-gamma |a-b|^2)`` plus a constant."""
    rng = np.random.default_rng(seed)
    omega = rng.standard_normal((z.shape[1], size)) * math.sqrt(2.0 * gamma)
    phase = rng.uniform(0.0, 2.0 * math.pi, size)
    phi = math.sqrt(2.0 / size) * np.cos(z @ omega + phase)
    return np.hstack([phi, np.ones((len(z), 1))])


def _latent(x: np.ndarray, model) -> np.ndarray:
    """Rows through the model's per-time linear map, if it has one."""
    if model.lin_mean is None:
        return x
    mean = np.asarray(model.lin_mean)
    matrix = np.asarray(model.lin_matrix).reshape(len(mean), -1)
    steps = x.reshape(len(x), x.shape[1] // len(mean), len(mean))[:, model.t_first : model.t_stop]
    return ((steps - mean) @ matrix).reshape(len(x), steps.shape[1] * matrix.shape[1])


class _Block:
    """Arrays of one block: vectors, labels, folds per iteration (-1 = always trains), chance labels."""

    def __init__(self, block: pd.DataFrame):
        self.x = np.array(block["vec"].tolist())
        self.labels = block["label"].to_numpy()
        self.tested = block["folds"].notna().to_numpy()
        self.folds = self._matrix(block["folds"])
        self.shuffled = self._matrix(block["shuffled"]) if "shuffled" in block.columns else None

    def _matrix(self, column: pd.Series) -> np.ndarray:
        if not self.tested.any():
            return np.full((len(column), 1), -1)
        known = np.array(column[self.tested].tolist(), dtype=int)
        out = np.full((len(column), known.shape[1]), -1)
        out[self.tested] = known
        return out

    def training(self, model, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Mask and labels of the rows that train ``model``."""
        if not model.trains:
            return np.zeros(len(self.x), dtype=bool), self.labels
        if not self.tested.any():
            return np.isin(self.labels, model.classes), self.labels
        mask = self.folds[:, model.iter] != model.test_fold
        labels = self.labels
        if self.shuffled is not None:
            labels = np.where(self.tested, self.shuffled[:, model.iter * k + model.test_fold], labels)
        return mask & np.isin(labels, model.classes), labels


def _sum_blocks(blocks: DataFrame) -> DataFrame:
    summed = blocks.withColumn("__v", array_to_vector("acc")).groupBy(*MODEL_KEYS).agg(
        Summarizer.sum(F.col("__v")).alias("__v")
    )
    return summed.select(*MODEL_KEYS, vector_to_array("__v").alias("acc"))


ACC_SCHEMA = "target string, iter int, test_fold int, acc array<double>"


def decode(
    rows: DataFrame,
    models: DataFrame,
    k: int,
    n_comp: float = 0.8,
    penalty: float = 1.0,
    size: int = 128,
    seed: int = 42,
    row_id: str = "trial",
    classifier: str | es.Decoder = "least_squares",
    rows_per_block: int = 20_000,
    reducer: str | es.Reducer = "pca",
) -> DataFrame:
    """Cross-validated predictions of a class-balanced RBF classifier on PCA features.

    ``rows``: subject, row id, label, ``vec``, ``folds`` (NULL for rows that only train), and
    optionally ``shuffled`` chance labels. ``models``: target, subject, iter, test_fold,
    classes, ``trains`` and the linear map columns ``lin_mean, lin_matrix, t_first, t_stop``
    (NULL = none). The kernel is expanded in random Fourier features and solved as a
    least-squares classifier, one against the rest. Three passes over blocks of rows: PCA
    statistics, classifier statistics, predictions. With ``classifier="margin"`` the kernel itself is used, and the
    second step is the hinge-loss problem of every class pair (see ``margin``). A ``Reducer`` or ``Decoder`` of
    ``estimators``, or the name of a registered one, takes the place of the PCA or of the classifier.
    Result: target, iter, row id, y, y_pred.
    """
    own_decoder = es.found(classifier, es.DECODERS, ("least_squares", "margin"))
    own_reducer = es.found(reducer, es.REDUCERS, ("pca",))
    if own_decoder is None and classifier == "margin":
        rows_per_block = min(rows_per_block, 2000)

    # read by three passes; the models by all of them too
    tagged = cut_lineage(split_blocks(rows, ["subject"], row_id, rows_per_block))
    models = cut_lineage(models)

    def shape_pass(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        rows_of, out = _Block(block), []
        for model in group.itertuples():
            mask, labels = rows_of.training(model, k)
            z = _latent(rows_of.x[mask], model)
            counts = np.array([(labels[mask] == c).sum() for c in model.classes], dtype=float)
            acc = np.concatenate([counts, z.sum(axis=0), (z.T @ z).ravel()])
            out.append((model.target, model.iter, model.test_fold, acc))
        return pd.DataFrame(out, columns=[*MODEL_KEYS, "acc"])

    classes = models.select(*MODEL_KEYS, F.size("classes").alias("n_classes")).distinct()

    @F.pandas_udf(PCA_SCHEMA + ", gamma double, weights array<double>")
    def shape_fit(acc: pd.Series, n_classes: pd.Series) -> pd.DataFrame:
        out = []
        for a, c in zip(acc, n_classes):
            counts, rest = np.asarray(a[:c]), np.asarray(a[c:])
            d = int((math.sqrt(4 * len(rest) + 1) - 1) / 2)
            n = counts.sum()
            mean, axes, eigen, ratio = principal_axes(max(n, 1.0), rest[:d], rest[d:], n_comp)
            spread = eigen.sum() * (n - 1) / max(n, 1.0)
            gamma = 1.0 / spread if spread > 0 else 1.0
            present = (counts > 0).sum()
            weights = n / (present * np.maximum(counts, 1.0))
            out.append((mean, axes.ravel(), eigen, ratio, gamma, weights))
        return pd.DataFrame(out, columns=["mean", "comps", "eigen", "ratio", "gamma", "weights"])

    def own_pass(estimator, reduce: Callable):
        """Partials of a caller's estimator over the training rows of a block."""
        partial = estimator.partial

        def run(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
            rows_of, out = _Block(block), []
            for model in group.itertuples():
                mask, labels = rows_of.training(model, k)
                if mask.any():
                    acc = partial(reduce(rows_of.x[mask], model), labels[mask], np.asarray(model.classes))
                    out.append((model.target, model.iter, model.test_fold, np.asarray(acc, dtype=float).ravel()))
            return pd.DataFrame(out, columns=[*MODEL_KEYS, "acc"])

        return run

    def own_fit(estimator, group: DataFrame, reduce: Callable, name: str) -> DataFrame:
        """The models of ``group`` with the estimator's parameters as column ``name``."""
        partials = run_blocks(tagged, group, ["subject"], own_pass(estimator, reduce), ACC_SCHEMA)
        sums = es.merged(partials, MODEL_KEYS, estimator.merge)
        listed = models.select(*MODEL_KEYS, "classes").distinct()
        return group.join(es.solved(sums.join(listed, MODEL_KEYS), estimator, name).drop("classes"), MODEL_KEYS)

    def spread_pass(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        rows_of, out = _Block(block), []
        for model in group.itertuples():
            mask, labels = rows_of.training(model, k)
            if not mask.any():
                continue
            z = reduced(rows_of.x[mask], model)
            counts = np.array([(labels[mask] == c).sum() for c in model.classes], dtype=float)
            acc = np.concatenate([counts, z.sum(axis=0), (z * z).sum(axis=0)])
            out.append((model.target, model.iter, model.test_fold, acc))
        return pd.DataFrame(out, columns=[*MODEL_KEYS, "acc"])

    @F.pandas_udf("gamma double, weights array<double>")
    def spread_fit(acc: pd.Series, n_classes: pd.Series) -> pd.DataFrame:
        out = []
        for a, c in zip(acc, n_classes):
            counts, rest = np.asarray(a[:c]), np.asarray(a[c:]).reshape(2, -1)
            n = counts.sum()
            spread = (rest[1] / n - (rest[0] / n) ** 2).sum()
            out.append((1.0 / spread if spread > 0 else 1.0, n / ((counts > 0).sum() * np.maximum(counts, 1.0))))
        return pd.DataFrame(out, columns=["gamma", "weights"])

    def reduced(x: np.ndarray, model) -> np.ndarray:
        if own_reducer is not None:
            return own_reducer.apply(_latent(x, model), np.asarray(model.axes))
        mean = np.asarray(model.mean)
        axes = np.asarray(model.comps).reshape(-1, len(mean))
        return (_latent(x, model) - mean) @ axes.T

    def phi(x: np.ndarray, model) -> np.ndarray:
        return _features(reduced(x, model), model.gamma, size, seed)

    def fit_pass(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        rows_of, out = _Block(block), []
        for model in group.itertuples():
            mask, labels = rows_of.training(model, k)
            f = phi(rows_of.x[mask], model)
            y = labels[mask]
            at = np.searchsorted(model.classes, y)
            weight = np.asarray(model.weights)[at]
            gram = f.T @ (f * weight[:, None])
            sums = np.zeros((len(model.classes), size + 1))
            np.add.at(sums, at, f * weight[:, None])
            out.append((model.target, model.iter, model.test_fold, np.concatenate([gram.ravel(), sums.ravel()])))
        return pd.DataFrame(out, columns=[*MODEL_KEYS, "acc"])

    if own_reducer is not None:
        shaped = cut_lineage(own_fit(own_reducer, models, _latent, "axes"))
        if own_decoder is None:  # the kernels want the spread of the reduced rows
            spreads = _sum_blocks(run_blocks(tagged, shaped, ["subject"], spread_pass, ACC_SCHEMA))
            fitted = spreads.join(classes, MODEL_KEYS).withColumn("__f", spread_fit("acc", "n_classes"))
            shaped = cut_lineage(shaped.join(fitted.select(*MODEL_KEYS, "__f.gamma", "__f.weights"), MODEL_KEYS))
    else:
        shape_stats = _sum_blocks(run_blocks(tagged, models, ["subject"], shape_pass, ACC_SCHEMA))
        fitted = shape_stats.join(classes, MODEL_KEYS).withColumn("__f", shape_fit("acc", "n_classes")).select(
            *MODEL_KEYS, "__f.mean", "__f.comps", "__f.gamma", "__f.weights"
        )
        shaped = cut_lineage(models.join(fitted, MODEL_KEYS))
    width = size + 1

    @F.pandas_udf("array<double>")
    def solve(acc: pd.Series) -> pd.Series:
        out = []
        for a in acc:
            a = np.asarray(a)
            gram, sums = a[: width * width].reshape(width, width), a[width * width :].reshape(-1, width)
            ridge = np.eye(width) / penalty
            ridge[-1, -1] = 1e-9  # the constant is not penalised
            right = 2.0 * sums - sums.sum(axis=0)  # targets +1 / -1
            out.append(np.linalg.solve(gram + ridge, right.T).ravel())
        return pd.Series(out)

    own = F.col("subject") == F.col("target")
    if own_decoder is not None:
        final = own_fit(own_decoder, shaped, reduced, "coef").filter(own)
    elif classifier == "margin":
        def training(block: pd.DataFrame) -> Callable:
            rows_of = _Block(block)

            def rows(model):
                mask, labels = rows_of.training(model, k)
                return mask, labels[mask], reduced(rows_of.x[mask], model)

            return rows

        packed = margin.training_rows(tagged, shaped, training, penalty)
        pairs = margin.fit(packed, shaped)
    else:
        fit_stats = _sum_blocks(run_blocks(tagged, shaped, ["subject"], fit_pass, ACC_SCHEMA))
        final = shaped.filter(own).join(fit_stats.select(*MODEL_KEYS, solve("acc").alias("coef")), MODEL_KEYS)
    tested = tagged.filter(F.col("folds").isNotNull())
    id_type = rows.schema[row_id].dataType.simpleString()
    if own_decoder is None and classifier == "margin":
        def predicted(block: pd.DataFrame) -> Callable:
            x, folds = np.array(block["vec"].tolist()), np.array(block["folds"].tolist())

            def rows(model):
                mask = folds[:, model.iter] == model.test_fold
                return mask, reduced(x[mask], model)

            return rows

        return margin.predict(tested, shaped.filter(own), packed, pairs, predicted, row_id, id_type)

    def predict_pass(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(block["vec"].tolist())
        folds = np.array(block["folds"].tolist())
        parts = []
        for model in group.itertuples():
            mask = folds[:, model.iter] == model.test_fold
            if not mask.any():
                continue
            if own_decoder is not None:
                chosen = own_decoder.predict(reduced(x[mask], model), np.asarray(model.coef), np.asarray(model.classes))
            else:
                scores = phi(x[mask], model) @ np.asarray(model.coef).reshape(width, -1)
                chosen = np.asarray(model.classes)[scores.argmax(axis=1)]
            parts.append(
                pd.DataFrame(
                    {
                        "target": model.target, "iter": model.iter, row_id: block[row_id].to_numpy()[mask],
                        "y": block["label"].to_numpy()[mask],
                        "y_pred": chosen,
                    }
                )
            )
        columns = ["target", "iter", row_id, "y", "y_pred"]
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in columns})

    schema = f"target string, iter int, {row_id} {id_type}, y int, y_pred int"
    return run_blocks(tested, final, ["subject"], predict_pass, schema)


def _plain_models(models: DataFrame) -> DataFrame:
    none = F.lit(None)
    return models.select(
        F.col("subject").alias("target"), "subject", "iter", "test_fold", "classes",
        F.lit(True).alias("trains"),
        none.cast("array<double>").alias("lin_mean"), none.cast("array<double>").alias("lin_matrix"),
        none.cast("int").alias("t_first"), none.cast("int").alias("t_stop"),
    )


def decode_within(
    rows: DataFrame, k: int = 10, n_iter: int = 50, n_comp: float = 0.8, chance: bool = False,
    row_id: str = "trial", seed: int = 42, size: int = 128, penalty: float = 1.0,
    keys: Sequence[str] = ("subject",), rank: int | None = None, classifier: str | es.Decoder = "least_squares", rows_per_block: int = 20_000,
    reducer: str | es.Reducer = "pca",
) -> DataFrame:
    """Repeated cross-validated decoding within each subject, or within each combination of ``keys``.

    ``rows``: keys, row id, label, vec. ``chance`` trains on labels shuffled inside each
    training set. ``rank`` is for long vectors: they are written in a basis of up to so many directions of their
    subject's rows (see ``sketches``) before anything else, which changes nothing where the subject has no more rows. Result: ``target`` (the subject) or the keys, iter, row id, y, y_pred. A grid of
    subjects, periods and positions is one plan: its cells are models of their own.
    ``reducer`` and ``classifier`` may be a caller's own (see ``estimators``).
    """
    if tuple(keys) != ("subject",):
        # cells are carried as one text and taken apart again
        cell = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        packed = rows.select(cell.alias("subject"), row_id, "label", "vec")
        out = decode_within(packed, k, n_iter, n_comp, chance, row_id, seed, size, penalty, ("subject",), rank, classifier, rows_per_block, reducer)
        fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
        cells = out.withColumn("target", F.from_json("target", fields))
        return cells.select(*[F.col(f"target.{c}").alias(c) for c in keys], *[c for c in out.columns if c != "target"])
    typed = rows.select(
        F.col("subject").cast("string").alias("subject"), row_id, F.col("label").cast("int").alias("label"), "vec"
    )
    if rank is not None:
        from . import sketches

        bases = sketches.basis(typed, ["subject"], row_id, rank)
        typed = cut_lineage(sketches.compress(typed, bases, ["subject"], row_id, ["label"]))
    folded = fold_table(typed, row_id, k, n_iter, seed)
    tagged = typed.join(_fold_arrays(folded, row_id, ["subject"]), ["subject", row_id])
    if chance:
        shuffled = _shuffled_arrays(folded, row_id, k, n_iter, seed, ["subject"])
        tagged = tagged.join(shuffled, ["subject", row_id])
    models = _plain_models(_training_classes(folded, k, ["subject"]))
    return decode(tagged, models, k, n_comp, penalty, size, seed, row_id, classifier, rows_per_block, reducer)


def decode_scores(predictions: DataFrame, scorer: str = "balanced_accuracy") -> DataFrame:
    """Score per target and iteration; the scorer goes by name."""
    return st.SCORERS[scorer](predictions, ["target", "iter"])


#: Doubles of training vectors in one partition: an iteration is a job, and small tasks cost more than their sums.
POINT_DOUBLES = 2_000_000


def decode_linear_folds(rows: DataFrame, k: int, max_iter: int = 100, row_id: str = "trial") -> DataFrame:
    """``decode_linear`` for each of ``k`` folds; the folds are trained at the same time."""
    rows = cut_lineage(rows)  # read by every fold
    parts: list = [None] * k

    def train(fold: int) -> None:
        parts[fold] = decode_linear(rows, fold, max_iter, row_id)

    with ThreadPoolExecutor(k) as pool:
        # each thread takes on the caller's job group and tags
        for done in [pool.submit(inheritable_thread_target(rows.sparkSession)(train), fold) for fold in range(k)]:
            done.result()
    return reduce(lambda a, b: a.unionByName(b), parts)


def decode_linear(rows: DataFrame, test_fold: int, max_iter: int = 100, row_id: str = "trial") -> DataFrame:
    """One large linear one-against-rest model (distributed training), class-balanced.

    ``rows``: row id, label, vec, fold. For pools too large for cross-validated kernels.
    """
    from pyspark.ml.classification import LinearSVC, OneVsRest

    train = rows.filter(F.col("fold") != test_fold)
    weighted = join_measured(train, st.class_weights(train).select("label", "weight"), ["label"])
    # one class per label that occurs, numbered from 0
    known = [r.label for r in train.select("label").distinct().orderBy("label").collect()]
    number = F.array_position(F.array(*[F.lit(x) for x in known]), F.col("label")) - 1
    svc = LinearSVC(maxIter=max_iter, regParam=0.01)
    points = cut_lineage(  # read once per iteration
        weighted.select(
            number.cast("double").alias("label"), "weight", array_to_vector("vec").alias("features")
        )
    )
    doubles = train.agg(F.sum(F.size("vec"))).first()[0] or 0
    points = points.coalesce(max(1, -(-doubles // POINT_DOUBLES)))
    model = OneVsRest(
        classifier=svc, featuresCol="features", labelCol="label", weightCol="weight", predictionCol="y_pred",
        parallelism=4,
    ).fit(points)
    test = rows.filter(F.col("fold") == test_fold).select(
        row_id, F.col("label").alias("y"), array_to_vector("vec").alias("features")
    )
    label = F.element_at(F.array(*[F.lit(x) for x in known]), F.col("y_pred").cast("int") + 1)
    return model.transform(test).select(row_id, "y", label.cast("int").alias("y_pred"))
