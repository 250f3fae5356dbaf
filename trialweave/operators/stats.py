"""Permutation tests, false-discovery control, folds, scores, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans import cut_lineage, hashed_rank, join_keys, join_measured, measured, number_and_least


def _seed_text(*parts) -> F.Column:
    return F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


#: Permutations that one task runs over the observations of a key, and the most observations for that.
PERMUTATIONS, OBSERVATIONS = 256, 100_000


#: Scores that a task draws at a time.
SCORES = 4_000_000


def _scores(observations: np.ndarray, perms: np.ndarray, seed: int) -> np.ndarray:
    """Random 64-bit scores (permutations x observations): a counter run through a mixing function.

    A score depends on the seed, the permutation and the observation's hash only, not on the task or the other rows.
    The multipliers are the fixed values of the SplitMix64 generator.
    """
    step = np.uint64(0x9E3779B97F4A7C15)

    def mix(z: np.ndarray) -> np.ndarray:
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    start = mix(perms.astype(np.uint64) * step + mix(np.array([seed % 2**64], dtype=np.uint64)))
    return mix((start[:, None] ^ observations[None]) * step + step)


def _counted_extremes(values: np.ndarray, hashes: np.ndarray, taken: int, observed: float, perms: range, seed: int) -> int:
    """Permutations whose difference is at least the observed one."""
    total, extreme, n = values.sum(), 0, len(values)
    some = max(1, SCORES // n)
    for low in range(perms.start, perms.stop, some):
        scores = _scores(hashes, np.arange(low, min(low + some, perms.stop)), seed)
        chosen = values[np.argpartition(scores, taken - 1, axis=1)[:, :taken]].sum(axis=1)
        extreme += int((chosen / taken - (total - chosen) / (n - taken) >= observed - 1e-9).sum())
    return extreme


def _extremes_in_blocks(
    valid: DataFrame, key_list: list[str], obs_id: str, n_perm: int, seed: int, draws: str
) -> DataFrame:
    """Keys and ``__extreme`` of one block of permutations per row."""
    if draws == "counter":
        hashed = F.xxhash64(*[F.col(c).cast("string") for c in (*key_list, obs_id)])
        rows = valid.select(
            *key_list, obs_id, hashed.alias("__hash"), "value", "n_interest", "difference",
            F.explode(F.sequence(F.lit(0), F.lit(-(-n_perm // PERMUTATIONS) - 1))).alias("__block"),
        )

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(obs_id)
            block = int(pdf["__block"].iloc[0])
            perms = range(block * PERMUTATIONS + 1, min((block + 1) * PERMUTATIONS, n_perm) + 1)
            extreme = _counted_extremes(
                pdf["value"].to_numpy(float), pdf["__hash"].to_numpy(np.int64).view(np.uint64),
                int(pdf["n_interest"].iloc[0]), pdf["difference"].iloc[0], perms, seed,
            )
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in key_list}, "__extreme": [extreme]})

        fields = ", ".join([*[f"`{c}` {valid.schema[c].dataType.simpleString()}" for c in key_list], "__extreme long"])
        return rows.groupBy(*key_list, "__block").applyInPandas(count, fields)
    tail = _seed_text(*key_list, obs_id)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-n_perm // PERMUTATIONS) - 1)))
    rows = valid.select(*key_list, obs_id, tail.alias("__tail"), "value", "n_interest", "difference", blocks.alias("__block"))
    kinds = ", ".join(f"`{c}` {valid.schema[c].dataType.simpleString()}" for c in key_list)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(obs_id)
        values = pdf["value"].to_numpy(float)
        tails = [t.encode() for t in pdf["__tail"]]
        taken, observed, block = int(pdf["n_interest"].iloc[0]), pdf["difference"].iloc[0], int(pdf["__block"].iloc[0])
        total, extreme = values.sum(), 0
        for perm in range(block * PERMUTATIONS + 1, min((block + 1) * PERMUTATIONS, n_perm) + 1):
            head = f"{seed}|{perm}|".encode()
            ranks = np.frombuffer(b"".join([md5(head + t).digest() for t in tails]), ">u8").reshape(-1, 2)
            chosen = values[np.lexsort((ranks[:, 1], ranks[:, 0]))[:taken]].sum()
            extreme += chosen / taken - (total - chosen) / (len(values) - taken) >= observed - 1e-9
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in key_list}, "__extreme": [int(extreme)]})

    return rows.groupBy(*key_list, "__block").applyInPandas(run, ", ".join(x for x in (kinds, "__extreme long") if x))


#: Observations of a large key that one task hashes, and half the width, in deviations, of the hashes it passes on.
PART, DEVIATIONS = 50_000, 8.0


def _extremes_in_parts(
    valid: DataFrame, key_list: list[str], obs_id: str, n_perm: int, seed: int
) -> DataFrame:
    """Keys and ``__extreme`` of one permutation per row, for keys of many observations, in md5 order.

    Hashes are uniform, so the one that parts the first ``n_interest`` from the rest is known up to a few deviations. A
    task adds up its values below that range and passes on those within: of n observations some square roots of n.
    ``__extreme`` is NULL where the range missed.
    """
    part = F.pmod(F.xxhash64(obs_id), F.ceil((F.col("n_interest") + F.col("n_baseline")) / F.lit(PART)))
    sizes = ["n_interest", "n_baseline", "difference", "__total"]
    rows = valid.select(*key_list, _seed_text(*key_list, obs_id).alias("__tail"), "value", *sizes, part.alias("__part"))
    deviations = DEVIATIONS
    kinds = "".join(f"`{c}` {valid.schema[c].dataType.simpleString()}, " for c in key_list)

    def hashed(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["value"].to_numpy(float)
        tails = [t.encode() for t in pdf["__tail"]]
        head = tuple(pdf[c].iloc[0] for c in key_list)
        size = tuple(pdf[c].iloc[0] for c in sizes)
        n = int(size[0] + size[1])
        share = size[0] / n
        spread = deviations * np.sqrt(share * (1 - share) / n)
        low, high = (np.uint64(min(max(int(x * 2.0**64), 0), 2**64 - 1)) for x in (share - spread, share + spread))
        out = []
        for perm in range(1, n_perm + 1):
            start = f"{seed}|{perm}|".encode()
            digests = np.frombuffer(b"".join([md5(start + t).digest() for t in tails]), ">u8").reshape(-1, 2)
            first = digests[:, 0].astype(np.uint64)
            below = first < low
            near = ~below & (first <= high)
            out.append((*head, perm, *size, int(below.sum()), values[below].sum(), digests[near].tobytes(), values[near]))
        return pd.DataFrame(out, columns=[*key_list, "perm", *sizes, "__below", "__sum", "__near", "__values"])

    def parted(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, others = int(pdf["n_interest"].iloc[0]), int(pdf["n_baseline"].iloc[0])
        ranks = np.frombuffer(b"".join(pdf["__near"]), ">u8").reshape(-1, 2)
        needed = taken - int(pdf["__below"].sum())
        extreme = None
        if 0 <= needed <= len(ranks):
            order = np.lexsort((ranks[:, 1], ranks[:, 0]))[:needed]
            chosen = pdf["__sum"].sum() + np.concatenate(pdf["__values"].tolist())[order].sum()
            null = chosen / taken - (pdf["__total"].iloc[0] - chosen) / others
            extreme = int(null >= pdf["difference"].iloc[0] - 1e-9)
        return pd.DataFrame([(*[pdf[c].iloc[0] for c in key_list], pdf["perm"].iloc[0], extreme)], columns=[*key_list, "perm", "__extreme"]).astype({"__extreme": "Int64"})

    near = "perm int, n_interest long, n_baseline long, difference double, `__total` double, `__below` long, `__sum` double, `__near` binary, `__values` array<double>"
    parts = rows.groupBy(*key_list, "__part").applyInPandas(hashed, kinds + near)
    return parts.groupBy(*key_list, "perm").applyInPandas(parted, kinds + "perm int, `__extreme` long")


def _extremes_ranked(valid: DataFrame, perms: DataFrame, key_list: list[str], obs_id: str, seed: int) -> DataFrame:
    """Keys and ``__extreme`` of the permutations ``perms`` (keys, ``perm``), whose observations are ranked as a table."""
    dealt = join_measured(valid, perms, key_list) if key_list else valid.crossJoin(F.broadcast(perms))
    ranked = hashed_rank(
        dealt, [*key_list, "perm"], _seed_text(F.lit(str(seed)), "perm", *key_list, obs_id), [obs_id], "__rn",
        digits=2,
    )
    chosen = F.col("__rn") <= F.col("n_interest")
    null = ranked.groupBy(*key_list, "perm", "difference").agg(
        (F.avg(F.when(chosen, F.col("value"))) - F.avg(F.when(~chosen, F.col("value")))).alias("__d")
    )
    return null.select(*key_list, (F.col("__d") >= F.col("difference") - F.lit(1e-9)).cast("long").alias("__extreme"))


def permutation_test(
    observations: DataFrame,
    keys: Sequence[str],
    obs_id: str,
    n_perm: int = 9999,
    seed: int = 42,
    draws: str = "counter",
) -> DataFrame:
    """One-sided permutation test of a mean difference per ``keys``.

    ``observations``: keys, ``obs_id`` (unique per key), ``interest`` (BOOLEAN), ``value``.
    In each permutation the observations are dealt by random scores: ``counter`` draws them in numpy, a matrix at a
    time; ``md5`` takes the md5 order that SQL can repeat. A task takes the observations of a key
    and ``PERMUTATIONS`` permutations and returns one count; keys of more than ``OBSERVATIONS`` rows
    are hashed in parts instead, in md5 order (see ``_extremes_in_parts``). The p-value counts the
    permuted differences at least as large as the observed one; with fewer than two values
    on a side it is 1.
    """
    if draws not in ("counter", "md5"):
        raise ValueError(f"draws must be 'counter' or 'md5', got {draws!r}")
    key_list = list(keys)
    valid = observations.filter(F.col("value").isNotNull()).select(*key_list, obs_id, "interest", "value")
    inside, outside = F.col("interest"), ~F.col("interest")
    observed = valid.groupBy(*key_list).agg(
        F.count_if(inside).alias("n_interest"),
        F.count_if(outside).alias("n_baseline"),
        (F.avg(F.when(inside, F.col("value"))) - F.avg(F.when(outside, F.col("value")))).alias("difference"),
        F.sum(F.col("value").cast("double")).alias("__total"),
    )
    observed = measured(observed)  # one row per channel
    testable = observed.filter((F.col("n_interest") >= 2) & (F.col("n_baseline") >= 2))
    known = join_keys(valid, testable.select(*key_list, "n_interest", "n_baseline", "difference", "__total"), key_list)
    size = F.col("n_interest") + F.col("n_baseline")
    few = size <= OBSERVATIONS
    extreme = _extremes_in_blocks(known.filter(few), key_list, obs_id, n_perm, seed, draws)
    if not testable.filter(~few).isEmpty():
        many = known.filter(~few)
        parts = cut_lineage(_extremes_in_parts(many, key_list, obs_id, n_perm, seed))
        extreme = extreme.unionByName(parts.filter("__extreme IS NOT NULL").drop("perm"))
        missed = parts.filter("__extreme IS NULL").select(*key_list, "perm")
        if not missed.isEmpty():
            extreme = extreme.unionByName(_extremes_ranked(many, missed, key_list, obs_id, seed))
    extreme = extreme.groupBy(*key_list).agg(F.sum("__extreme").alias("__extreme"))
    joined = join_keys(observed, extreme, key_list, "left")
    p = (F.col("__extreme") + 1) / F.lit(float(n_perm + 1))
    return joined.select(
        *key_list, "n_interest", "n_baseline", "difference", F.coalesce(p, F.lit(1.0)).alias("p")
    )


def false_discovery(pvalues: DataFrame, family: Sequence[str] = (), p: str = "p") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values ``q`` within ``family``.

    From the largest p-value down, ``q`` is the running minimum of ``p * n / rank``. A
    family may span many tasks.
    """
    keys = list(family)
    sizes = pvalues.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    sized = join_measured(pvalues, sizes, keys)

    def raw():  # the row number counts from the largest p-value
        return F.col(p) * F.col("__n") / (F.col("__n") - F.col("__r") + 1)

    scanned = number_and_least(sized, keys, [F.desc(p)], "__r", raw, "q")
    return scanned.withColumn("q", F.least(F.lit(1.0), F.col("q"))).drop("__r", "__n")


def significant_channels(pvalues: DataFrame, family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Channels whose adjusted p-value is below ``alpha``."""
    return false_discovery(pvalues, family).filter(F.col("q") < F.lit(alpha))


def stratified_folds(
    rows: DataFrame, row_id: str, k: int, seed: int = 42, keys: Sequence[str] = (), label: str = "label",
    salt: Sequence[str] = (),
) -> DataFrame:
    """Add ``fold``: rows of a class dealt to ``k`` folds in hash order.

    If every class of ``keys`` has fewer than ``k`` rows the classes are ignored and all
    rows are dealt together. ``salt`` columns (an iteration number) also group the rows.
    A class is dealt on from where the class before it ended, so fold sizes differ by one at most.
    """
    by = [*keys, *salt]
    every = Window.partitionBy(*by)
    before = every.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    # one row per class
    sizes = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__largest", F.max("__n").over(every)).withColumn(
        "__earlier", F.coalesce(F.sum("__n").over(before), F.lit(0))
    )
    sizes = sizes.select(*by, F.col(label).alias("__class"), "__largest", "__earlier")
    tagged = join_measured(rows.withColumn("__class", F.col(label)), sizes, [*by, "__class"]).withColumn(
        "__stratum",
        F.when(F.col("__largest") >= k, F.concat(F.lit("="), F.col(label).cast("string"))).otherwise(""),
    ).withColumn("__earlier", F.when(F.col("__largest") >= k, F.col("__earlier")).otherwise(F.lit(0)))
    ranked = hashed_rank(
        tagged, [*by, "__stratum"], _seed_text(F.lit(str(seed)), *salt, row_id), [row_id], "__rn"
    )
    place = F.col("__earlier") + F.col("__rn") - 1
    return ranked.withColumn("fold", F.pmod(place, F.lit(k)).cast("int")).drop(
        "__rn", "__stratum", "__largest", "__earlier", "__class"
    )


def class_weights(rows: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_class"))
    totals = counts.groupBy(*keys).agg(F.sum("n_class").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return join_keys(counts, totals, list(keys)).select(
        *keys, label, "n_class", (F.col("__n") / (F.col("__k") * F.col("n_class"))).alias("weight")
    )


def chance_labels(
    folded: DataFrame, row_id: str, k: int, seed: int = 42, keys: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Labels shuffled inside each training set (every fold but the test fold).

    Two independent hash orders of one training set are matched rank by rank. Result:
    keys, ``test_fold``, row id, ``label`` (shuffled).
    """
    train = (
        folded.select(*keys, row_id, label, "fold")
        .withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .filter(F.col("test_fold") != F.col("fold"))
        .drop("fold")
    )
    group = [*keys, "test_fold"]

    def ranked(tag: str) -> DataFrame:
        text = _seed_text(F.lit(f"{seed}{tag}"), *group, row_id)
        return hashed_rank(train, group, text, [row_id], "__rn")

    takers = ranked("a").drop(label)
    givers = ranked("b").drop(row_id)
    return join_keys(takers, givers, [*group, "__rn"]).drop("__rn")


def balanced_accuracy(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes present in ``y``."""
    recall = predictions.groupBy(*keys, "y").agg(
        F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("__recall")
    )
    return recall.groupBy(*keys).agg(F.avg("__recall").alias("score"))


def accuracy(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("score")
    )


SCORERS = {"balanced_accuracy": balanced_accuracy, "accuracy": accuracy}


def score_summary(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_iter"), F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
    )


def shared_labels(pooled: DataFrame, target: DataFrame, label: str = "label") -> DataFrame:
    """Pooled rows whose label occurs in the target."""
    return pooled.join(measured(target.select(label).distinct()), [label], "left_semi")


def shared_classes(rows: DataFrame, label: str = "label", subject: str = "subject") -> DataFrame:
    """Labels present in every subject of ``rows``."""
    pairs = rows.select(subject, label).distinct()
    n_subjects = pairs.select(subject).distinct().agg(F.count(F.lit(1)).alias("__all"))
    counts = pairs.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    return counts.join(n_subjects, F.col("__n") == F.col("__all"), "left_semi").select(label)


def class_correlation(
    target: DataFrame, sources: DataFrame, n_comp: int = 25, source: Sequence[str] = ()
) -> DataFrame:
    """Pearson r of class-average time courses per label, averaged over components.

    Both sides: ``label``, ``ch`` (component), ``t``, ``value``; ``sources`` may carry
    ``source`` columns, which gives one result per source and label.
    """
    averaged = target.filter(F.col("ch") < n_comp).groupBy("label", "ch", "t").agg(F.avg("value").alias("__a"))
    others = sources.filter(F.col("ch") < n_comp).groupBy(*source, "label", "ch", "t").agg(
        F.avg("value").alias("__b")
    )
    return (
        others.join(averaged, ["label", "ch", "t"])
        .groupBy(*source, "label", "ch")
        .agg(F.corr("__a", "__b").alias("__r"))
        .groupBy(*source, "label")
        .agg(F.avg("__r").alias("r"))
    )


def trial_subselect(rows: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Per label, as many trials of each subject as the subject with fewest has.

    Labels that a subject lacks are dropped. Trials are taken in hash order; ``pick``
    numbers them.
    """
    shared = rows.join(measured(shared_classes(rows)), ["label"], "left_semi")
    least = (
        shared.groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("label").agg(F.min("n").alias("__least"))
    )
    ranked = hashed_rank(
        shared, ["subject", "label"], _seed_text(F.lit(str(seed)), row_id), [row_id], "pick"
    )
    return join_measured(ranked, least, ["label"]).filter(F.col("pick") <= F.col("__least")).drop("__least")
