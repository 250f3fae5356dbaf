"""Text quality by a generalised additive model with pairwise interactions.

A text is reduced to the dense features of ``FEATURES``, each feature to one of at most ``bins`` bins. The model is a sum
of lookup tables, one per feature and one per chosen pair of features, behind a logistic link. Tables are learned by
cyclic boosting: feature after feature, round after round, a shallow tree (at most ``leaves`` leaves over the bins of
that one feature) is fitted to the gradients and added to the feature's table. Then pairs are ranked by how much of the
residual a four-cell split of both features explains, and the best ``pairs`` get tables of their own, boosted the same
way by trees of one split per feature. Scoring adds up the bins' entries: an array lookup per feature and pair.

Fitting uses at most about ``max_rows`` labelled rows, chosen by hash of doc_id: the only bound. ``bags`` models are
fitted in as many tasks, each without another part of the rows, which stops its boosting; the tables are averaged.

Null text counts as empty text, which is scored like any other. Labels other than 0 and 1 and labels without doc_id are
ignored; of repeated labels the highest counts. Without labels of both kinds the score is the share of label 1 (0 if
there are no labels). Rows are scored one by one, so repeated rows have equal scores; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import FOLDED_VALUES, NONSPACE, mix, span_hashes, text_slices, words
from .store import Scratch

FEATURES = (
    "log_words", "word_length", "long_words", "distinct_words", "commonest_word", "same_as_before", "letters", "capitals",
    "capital_words", "digits", "marks", "ending_marks", "bars", "odd_marks", "line_words", "short_lines", "repeated_lines",
    "sentence_words", "mark_runs", "lone_letters",
)

_UPPER, _LETTER, _DIGIT, _PUNCT, _ENDING, _ODD = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_ENDING[[ord(c) for c in ".!?"]] = True
_ODD[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True
_CONTINUED = np.zeros(256, bool)  # later bytes of a character
_CONTINUED[128:192] = True


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum per text; ``at`` holds the borders."""
    total = np.append(0, np.cumsum(flags, dtype=np.float64))
    return total[at[1:]] - total[at[:-1]]


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner the number of distinct hashes and the count of the commonest."""
    order = np.argsort(mix(owner.astype(np.uint64)) ^ hashes, kind="stable")
    o, h = owner[order], hashes[order]
    first = np.ones(len(o), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    start = np.flatnonzero(first)
    count, whose = np.diff(np.append(start, len(o))), o[start]
    most = np.zeros(n)
    np.maximum.at(most, whose, count)
    return np.bincount(whose, minlength=n).astype(float), most


def measure(column: pa.Array) -> np.ndarray:
    """Feature matrix of a string column, read off whole texts."""
    out = []
    for _, _, data, offsets in text_slices(column):
        n_texts = len(offsets) - 1
        starts, ends, at = words(data, offsets, NONSPACE)
        hashes = span_hashes(data, starts, ends, FOLDED_VALUES)
        owner = np.repeat(np.arange(n_texts), np.diff(at))
        n = np.diff(at).astype(float)
        length = np.append(0, np.cumsum(~_CONTINUED[data]))
        chars = np.maximum((length[offsets[1:]] - length[offsets[:-1]]).astype(float), 1)
        per_word = 1 / np.maximum(n, 1)
        size = (length[ends] - length[starts]).astype(float)
        distinct, most = _repeats(owner, hashes, n_texts)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        letter, upper, punct = _LETTER[data], _UPPER[data], _PUNCT[data]
        real = letter & ~_CONTINUED[data]
        n_letters = np.maximum(_sums(real, offsets), 1)
        upto = np.append(0, np.cumsum(upper))
        of_letters = np.append(0, np.cumsum(real))
        shouted = (upto[ends] - upto[starts] > 1) & (upto[ends] - upto[starts] >= 0.7 * (of_letters[ends] - of_letters[starts]))
        ending = _ENDING[data]
        runs = np.zeros(len(data), bool)
        runs[1:] = punct[1:] & punct[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        runs[inner] = False
        solid = np.ones(256, bool)
        solid[10] = solid[13] = False
        line_starts, line_ends, line_at = words(data, offsets, solid)
        n_lines = np.maximum(np.diff(line_at).astype(float), 1)
        line_owner = np.repeat(np.arange(n_texts), np.diff(line_at))
        line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
        line_kinds, _ = _repeats(line_owner, span_hashes(data, line_starts, line_ends, FOLDED_VALUES), n_texts)
        sentences = np.zeros(len(starts), bool)
        if len(starts):
            sentences = ending[ends - 1]
        out.append(
            np.stack(
                [
                    np.log1p(n), _sums(size, at) * per_word, _sums(size > 12, at) * per_word, distinct * per_word, most * per_word,
                    _sums(same, at) * per_word, _sums(real, offsets) / chars, _sums(upper, offsets) / n_letters,
                    _sums(shouted, at) * per_word, _sums(_DIGIT[data], offsets) / chars, _sums(punct, offsets) / chars,
                    _sums(ending, offsets) / chars, _sums(data == ord("|"), offsets) / chars, _sums(_ODD[data], offsets) / chars,
                    np.log1p(n / n_lines), _sums(line_words < 4, line_at) / n_lines, 1 - line_kinds / n_lines,
                    np.log1p(n / np.maximum(_sums(sentences, at), 1)), _sums(runs, offsets) / chars, _sums(size == 1, at) * per_word,
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def with_features(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the column ``x``, an array of the features."""
    frame = documents.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            matrix = measure(batch.column(len(keep)))
            x = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], names=[*keep, "x"])

    return frame.mapInArrow(run, f"{fields}, x array<double>")


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, a column per feature."""
    return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)


def _cuts_of(gain_of, low: int, high: int, g: np.ndarray, h: np.ndarray):
    """The best cut of the bins low..high-1: (gain, cut)."""
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    if not len(left_g):
        return 0.0, low
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gain = gain_of(left_g, left_h) + gain_of(all_g - left_g, all_h - left_h) - gain_of(all_g, all_h)
    best = int(np.argmax(gain))
    return float(gain[best]), low + best + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, damping: float = 1.0) -> np.ndarray:
    """Values per bin of a tree of at most ``leaves`` leaves, grown where the gain is greatest.

    ``g`` and ``h`` are sums of gradients and curvatures per bin.
    """

    def gain_of(a, b):
        return a * a / (b + damping)

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gains = [_cuts_of(gain_of, low, high, g, h) for low, high in parts]
        best = int(np.argmax([gain for gain, _ in gains]))
        if gains[best][0] <= 1e-9:
            break
        low, high = parts.pop(best)
        parts += [(low, gains[best][1]), (gains[best][1], high)]
    values = np.zeros(len(g))
    for low, high in parts:
        values[low:high] = g[low:high].sum() / (h[low:high].sum() + damping)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray, damping: float = 1.0) -> tuple[float, int, int]:
    """(gain, row, column): the best split of a table of bins into four cells."""

    def below(t):
        return t.cumsum(0).cumsum(1)[:-1, :-1]

    def cells(t):
        a = below(t)
        rows, columns, whole = t.cumsum(0)[:-1].sum(1)[:, None], t.cumsum(1)[:, :-1].sum(0)[None, :], t.sum()
        return a, rows - a, columns - a, whole - rows - columns + a

    if min(g.shape) < 2:
        return 0.0, 0, 0
    gain = sum(a * a / (b + damping) for a, b in zip(cells(g), cells(h)))
    place = int(np.argmax(gain))
    row, column = divmod(place, gain.shape[1])
    return float(gain.ravel()[place] - g.sum() ** 2 / (h.sum() + damping)), row + 1, column + 1


def _loss(score: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -score, score)).mean()) if len(y) else 0.0


def boost(bins: np.ndarray, y: np.ndarray, held: np.ndarray, sizes: list[int], rounds: int, pairs: int, leaves: int, rate: float):
    """(intercept, table per feature, {(i, j): table}) of one bag; the rows of ``held`` stop the boosting."""
    grow = ~held
    base = (y[grow].sum() + 0.5) / (grow.sum() + 1)
    start = float(np.log(base / (1 - base)))
    score = np.full(len(y), start)
    tables = [np.zeros(s) for s in sizes]

    def steps(update, keep):
        best, since, saved = _loss(score[held], y[held]), 0, keep()
        for _ in range(rounds):
            update()
            loss = _loss(score[held], y[held])
            if loss < best - 1e-6:
                best, since, saved = loss, 0, keep()
            else:
                since += 1
                if since >= 25 and held.any():
                    break
        return saved

    def gradients():
        p = 1 / (1 + np.exp(-score))
        return np.where(grow, y - p, 0), np.where(grow, p * (1 - p), 0)

    def features():
        for f, size in enumerate(sizes):
            g, h = gradients()
            values = rate * shallow_tree(np.bincount(bins[:, f], g, size), np.bincount(bins[:, f], h, size), leaves)
            tables[f] += values
            score[:] += values[bins[:, f]]

    tables, score = steps(features, lambda: ([t.copy() for t in tables], score.copy()))
    # which pairs explain what is left
    g, h = gradients()
    ranked = []
    for i in range(len(sizes)):
        for j in range(i):
            flat, shape = bins[:, j] * sizes[i] + bins[:, i], (sizes[j], sizes[i])
            gain, _, _ = _quadrants(*(np.bincount(flat, x, sizes[i] * sizes[j]).reshape(shape) for x in (g, h)))
            ranked.append((-gain, j, i))
    chosen = [(j, i) for gain, j, i in sorted(ranked)[:pairs] if gain < -1e-9]
    grids = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in chosen}

    def interactions():
        for (j, i), grid in grids.items():
            g, h = gradients()
            flat = bins[:, j] * sizes[i] + bins[:, i]
            sums_g, sums_h = (np.bincount(flat, x, grid.size).reshape(grid.shape) for x in (g, h))
            _, row, column = _quadrants(sums_g, sums_h)
            values = np.zeros(grid.shape)
            for rows in (slice(0, row), slice(row, None)):
                for columns in (slice(0, column), slice(column, None)):
                    values[rows, columns] = rate * sums_g[rows, columns].sum() / (sums_h[rows, columns].sum() + 1.0)
            grid += values
            score[:] += values.ravel()[flat]

    if grids:
        grids, _ = steps(interactions, lambda: ({p: t.copy() for p, t in grids.items()}, None))
    return start, tables, grids


@dataclass
class QualityModel:
    constant: float = 0.0
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    grids: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        total = np.full(len(x), self.intercept)
        for f, values in enumerate(self.tables):
            total += values[bins[:, f]]
        for (i, j), grid in self.grids.items():
            total += grid[bins[:, i], bins[:, j]]
        return total


def fit(
    documents: DataFrame, labels: DataFrame, usable: Column, max_rows: int = 20_000, bins: int = 64, bags: int = 8,
    rounds: int = 300, pairs: int = 10, leaves: int = 3, rate: float = 0.1,
) -> QualityModel:
    """Fit on labelled documents; ``usable`` is a condition on doc_id."""
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    n, scale = known.count(), 1 << 30
    share = scale if n <= max_rows else int(scale * max_rows / n)
    # a bounded table (about ``max_rows`` rows), so it can go to every task
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(scale)) < share)
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    with Scratch(documents.sparkSession) as scratch:
        rows = with_features(sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(bags)).cast("int")), ["label", "part"])
        rows = scratch.stored(rows, "features", 500)
        kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(kinds) < 2:
            return QualityModel(constant=1.0 if 1.0 in kinds else 0.0)
        points = [k / bins for k in range(1, bins)]
        borders = rows.agg(*[F.percentile(F.col("x")[f], F.lit(points)).alias(name) for f, name in enumerate(FEATURES)]).first()
        edges = [np.unique(np.array(borders[name])) for name in FEATURES]
        sizes = [len(e) + 1 for e in edges]

        def fit_bag(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["part", "label", "order"])  # the same rows in the same order, whatever the shuffle
            matrix = binned(np.stack(frame["x"].to_numpy()), edges)
            bag = int(frame["bag"].iloc[0])
            held = (frame["part"] == bag).to_numpy()
            start, tables, grids = boost(matrix, frame["label"].to_numpy(), held, sizes, rounds, pairs, leaves, rate)
            out = [(bag, -1, -1, np.array([start])), *[(bag, f, -1, t) for f, t in enumerate(tables)]]
            out += [(bag, i, j, t.ravel()) for (i, j), t in grids.items()]
            return pd.DataFrame([(a, b, c, v.tolist()) for a, b, c, v in out], columns=["bag", "i", "j", "entries"])

        spread = rows.withColumn("order", F.xxhash64("x")).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
        # a bag holds the bounded sample
        learned = spread.groupBy("bag").applyInPandas(fit_bag, "bag int, i int, j int, entries array<double>").collect()
    model = QualityModel(edges=edges, tables=[np.zeros(s) for s in sizes])
    for _, i, j, entries in sorted(tuple(r) for r in learned):
        values = np.array(entries) / bags
        if i < 0:
            model.intercept += float(values[0])
        elif j < 0:
            model.tables[i] += values
        else:
            grid = model.grids.setdefault((i, j), np.zeros((sizes[i], sizes[j])))
            grid += values.reshape(grid.shape)
    return model


def score(documents: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score double in 0..1, predicted int (1 from ``threshold`` on)."""
    if not model.tables:
        scored = documents.select("doc_id", F.lit(model.constant).alias("score"))
    else:
        shared = documents.sparkSession.sparkContext.broadcast(model)
        frame = documents.select("doc_id", F.col("text").cast("string").alias("text"))

        def run(batches):
            for batch in batches:
                p = 1 / (1 + np.exp(-shared.value.logit(measure(batch.column(1)))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

        kind = frame.schema["doc_id"].dataType.simpleString()
        scored = frame.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
