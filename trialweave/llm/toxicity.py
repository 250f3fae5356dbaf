"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (see ``FEATURES``): densities of a lexicon of word beginnings, as written and after undoing
common disguises (digits and signs for letters, marks within words), how near lexicon words stand to
second-person words, capitals, punctuation, repeated characters and length. Everything is read off whole texts.

Fitting uses at most about ``max_rows`` labelled rows, chosen by hash of doc_id; four fifths of them give the lexicon
(the ``lexicon_size`` word beginnings with the highest z-score for label 1) and the trees, one fifth the
calibration. These are the only bounds. Trees and calibration are Spark ML models.

Null text counts as empty text, which is scored like any other. Labels other than 0 and 1 and labels without
doc_id are ignored; of repeated labels the highest counts. Without labels of both kinds the score is the share
of label 1 (0 if there are no labels). Rows are scored one by one; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import ALNUM, FOLDED_VALUES, span_hashes, text_slices, words
from .store import stored

# Second-person words.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "ti tus usted ustedes vosotros tú"
).split()
NEAR = 4
FEATURES = (
    "log_words", "lexicon_density", "lexicon_hits", "hidden_density", "hidden_hits", "second_person", "near_second_person",
    "capitals", "capital_words", "punctuation", "exclamations", "digits_in_words", "signs_in_words", "repeats",
)
# Signs and digits that stand for letters.
_DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"}

_PLAIN = np.arange(256, dtype=np.uint8)
for _a, _b in _DISGUISE.items():
    _PLAIN[ord(_a)] = ord(_b)
_UPPER, _LETTER, _DIGIT, _PUNCT, _SPACE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_SPACE[32] = _SPACE[9:14] = True


class Lexicon:
    """Word beginnings and whole words by hash."""

    def __init__(self, beginnings: list[str]):
        self.by_length: dict[int, np.ndarray] = {}
        groups: dict[int, list[int]] = {}
        for entry in beginnings:
            raw = np.frombuffer(entry.encode(), np.uint8)
            one = span_hashes(raw, np.array([0]), np.array([len(raw)]), FOLDED_VALUES)
            groups.setdefault(len(raw), []).append(int(one[0]))
        for length, hashes in groups.items():
            self.by_length[length] = np.unique(np.array(hashes, np.uint64))
        second = [np.frombuffer(w.encode(), np.uint8) for w in SECOND_PERSON]
        self.second = np.unique(
            np.concatenate([span_hashes(r, np.array([0]), np.array([len(r)]), FOLDED_VALUES) for r in second])
        )

    def begins(self, data, starts, ends) -> np.ndarray:
        """Whether a word begins with an entry."""
        hit = np.zeros(len(starts), bool)
        for length, known in self.by_length.items():
            long = np.flatnonzero((ends - starts >= length) & ~hit)
            if len(long):
                hashes = span_hashes(data, starts[long], starts[long] + length, FOLDED_VALUES)
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit[long[known[place] == hashes]] = True
        return hit

    def second_person(self, data, starts, ends) -> np.ndarray:
        hashes = span_hashes(data, starts, ends, FOLDED_VALUES)
        place = np.minimum(np.searchsorted(self.second, hashes), len(self.second) - 1)
        return self.second[place] == hashes


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of true flags per text; ``at`` holds the borders."""
    sums = np.append(0, np.cumsum(flags))
    return (sums[at[1:]] - sums[at[:-1]]).astype(float)


def measure(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Feature matrix of a string column."""
    out = []
    for _, _, data, offsets in text_slices(column):
        starts, ends, at = words(data, offsets, ALNUM)
        n, chars = np.diff(at).astype(float), np.diff(offsets).astype(float)
        per_word, per_char = 1 / np.maximum(n, 1), 1 / np.maximum(chars, 1)
        hit = lexicon.begins(data, starts, ends)
        second = lexicon.second_person(data, starts, ends)
        reach = np.append(0, np.cumsum(second))
        places = np.arange(len(starts))
        text = np.repeat(np.arange(len(n)), np.diff(at))
        low = np.maximum(places - NEAR, at[:-1][text]) if len(starts) else places
        high = np.minimum(places + NEAR + 1, at[1:][text]) if len(starts) else places
        near = hit & (reach[high] > reach[low])
        # the same words without marks, digits read as letters
        keep = ~_PUNCT[data] | (_PLAIN[data] != data)
        inner = np.append(0, np.cumsum(keep))
        bare = _PLAIN[data][keep]
        bare_offsets = inner[offsets]
        s2, e2, at2 = words(bare, bare_offsets, _LETTER)
        hidden = np.maximum(_per_text(lexicon.begins(bare, s2, e2), at2) - _per_text(hit, at), 0)
        capitals, letters = _per_text(_UPPER[data], offsets), _per_text(_LETTER[data], offsets)
        upper = np.append(0, np.cumsum(_UPPER[data]))
        shouted = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
        digit = np.append(0, np.cumsum(_DIGIT[data]))
        of_digits = digit[ends] - digit[starts]
        mixed = (of_digits > 0) & (of_digits < ends - starts)
        punct = _PUNCT[data]
        inside, again = np.zeros(len(data), bool), np.zeros(len(data), bool)
        if len(data) > 2:
            owner = np.repeat(np.arange(len(n)), np.diff(offsets))
            one_text = owner[2:] == owner[:-2]
            inside[1:-1] = punct[1:-1] & _LETTER[data[:-2]] & _LETTER[data[2:]] & one_text
            again[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & ~_SPACE[data[2:]] & (data[2:] < 128) & one_text
        out.append(
            np.stack(
                [
                    np.log1p(n), _per_text(hit, at) * per_word, _per_text(hit, at), hidden * per_word, hidden,
                    _per_text(second, at) * per_word, _per_text(near, at), capitals / np.maximum(letters, 1),
                    _per_text(shouted, at) * per_word, _per_text(punct, offsets) * per_char, _per_text(data == 33, offsets) * per_char,
                    _per_text(mixed, at) * per_word, _per_text(inside, offsets) * per_char, _per_text(again, offsets) * per_char,
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def with_features(documents: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` columns and a double column per feature."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    frame = documents.select(*[F.col(f"`{c}`") for c in keep], "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            matrix = measure(batch.column(len(keep)), shared.value)
            columns = [pa.array(np.ascontiguousarray(c)) for c in matrix.T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *FEATURES])

    return frame.mapInArrow(run, ", ".join([fields, *[f"{f} double" for f in FEATURES]]))


def learn_lexicon(sample: DataFrame, size: int, least: int = 5, purity: float = 0.8) -> list[str]:
    """Word beginnings of 4 to 8 letters that mark label 1: at least ``purity`` of their documents bear it."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))
    beginnings = F.array_distinct(
        F.flatten(F.transform(found, lambda w: F.array(*[F.substring(w, 1, k) for k in range(4, 9)])))
    )
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    rate = (total["t"] or 0) / max(total["n"], 1)
    counts = (
        sample.select("label", F.explode(beginnings).alias("entry"))
        .groupBy("entry")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t"))
        .filter((F.col("t") >= least) & (F.col("t") >= purity * F.col("n")))
    )
    z = (F.col("t") - rate * F.col("n")) / F.sqrt(rate * F.col("n") + 1)
    return [r["entry"] for r in counts.orderBy(z.desc(), "entry").limit(size).collect()]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    constant: float = 0.0
    entries: list[str] = field(default_factory=list)


def fit(documents: DataFrame, labels: DataFrame, usable: Column, max_rows: int = 20_000, lexicon_size: int = 500, rounds: int = 20) -> ToxicityModel:
    """Fit on labelled documents; ``usable`` is a condition on doc_id."""
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    n = known.count()
    scale = 1 << 30
    share = scale if n <= max_rows else int(scale * max_rows / n)
    # a bounded table (about ``max_rows`` rows), so it can go to every task
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(scale)) < share)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    sample = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5))
    sample = stored(sample.withColumn("for_scale", part == 0), "labelled")
    grow = sample.filter("NOT for_scale")
    kinds = {r["label"]: r["count"] for r in grow.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return ToxicityModel(Lexicon([]), constant=1.0 if 1.0 in kinds else 0.0)
    entries = learn_lexicon(grow, lexicon_size)
    lexicon = Lexicon(entries)
    rows = stored(with_features(sample, lexicon, ["label", "for_scale"]), "features")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    trees = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.2, seed=5).fit(rows.filter("NOT for_scale"))
    held = trees.transform(rows.filter("for_scale")).select("label", vector_to_array("probability")[1].alias("p"))
    calibration = None
    if not held.isEmpty():
        calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    return ToxicityModel(lexicon, trees, calibration, entries=entries)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score double in 0..1, predicted int."""
    if model.trees is None:
        scored = documents.select("doc_id", F.lit(model.constant).alias("score"))
    else:
        rows = with_features(documents, model.lexicon, ["doc_id"])
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        rows = model.trees.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("p"))
        value = F.col("p")
        if model.calibration is not None:
            rows = model.calibration.transform(rows)
            # isotonic steps tie many texts; a thousandth of the tree score orders them within a step
            value = 0.999 * F.col("prediction") + 0.001 * F.col("p")
        scored = rows.select("doc_id", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
