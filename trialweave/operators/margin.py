"""Maximum-margin classifier with an RBF kernel: dual problems per pair of classes, joined by a cascade of support vectors.

One model is one training set; it has a two-class problem per pair of classes, and pairs vote. The rows that train a
model lie packed per block and class (``training_rows``), reduced once for all pairs. Both classes of a pair meet in one
task, which solves their problem (``solve_dual``). Pairs of more than ``PAIR_ROWS`` rows are solved in parts, that pass on the rows
that carry weight. Parts meet two by two, solve again and pass on, as many times as the logarithm of their number. Then every block
compares all its rows with the result; rows that violate its conditions join the support vectors and the problem is
solved once more, until no row does. So the result is the optimum over all rows, while a task holds the rows of a part
or the support vectors of a pair. Found weights go by the place of their rows, without the rows. Rows to predict meet the
support vectors class by class: one kernel value serves all pairs of a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans import cut_lineage, join_measured, run_blocks

MODEL_KEYS = ["target", "iter", "test_fold"]
PAIR = [*MODEL_KEYS, "first", "second"]
TOLERANCE = 1e-3
#: Rows of a pair that are solved together.
PAIR_ROWS = 20_000
#: Blocks of rows in one task of a check or a prediction, doubles of a kernel matrix at a time, and of one that is summed.
BLOCKS_PER_TASK, KERNEL_DOUBLES, SUMMED_DOUBLES = 16, 8_000_000, 1_000_000
#: Most doubles of kernel columns that a problem keeps, columns computed at a time, doubles that stay in a core's cache.
KEPT_DOUBLES, COLUMNS, NEAR_DOUBLES = 32_000_000, 64, 32_768
#: Problems of more rows are solved for some rows at a time, with their columns only.
WHOLE_ROWS, WORKING_ROWS = 5_000, 512
#: A row is known by its block and its place there, a block by its subject's number in the model and its number there.
PLACE_BITS, BLOCK_BITS = 22, 20


class _Kernel:
    """Columns of the RBF kernel matrix, computed some at a time when asked for and kept while there is room."""

    def __init__(self, x: np.ndarray, gamma: float):
        self.x, self.gamma, self.squares, self.kept = x, gamma, (x * x).sum(axis=1), {}

    def column(self, i: int) -> np.ndarray:
        some, at = divmod(i, COLUMNS)
        if some not in self.kept:
            if (len(self.kept) + 1) * COLUMNS * len(self.x) > KEPT_DOUBLES and self.kept:
                self.kept.pop(next(iter(self.kept)))  # the oldest
            self.kept[some] = self.columns(slice(some * COLUMNS, (some + 1) * COLUMNS))
        return self.kept[some][at]

    def columns(self, which) -> np.ndarray:
        """Columns as rows of the result."""
        return rbf(self.x[which], self.x, self.gamma, self.squares[which], self.squares)


def rbf(a: np.ndarray, b: np.ndarray, gamma: float, squares: np.ndarray | None = None, others: np.ndarray | None = None) -> np.ndarray:
    squares = (a * a).sum(axis=1) if squares is None else squares
    others = (b * b).sum(axis=1) if others is None else others
    out = a @ b.T
    some = max(1, NEAR_DOUBLES // max(len(b), 1))
    for at in range(0, len(a), some):
        part = out[at : at + some]
        part *= -2
        part += squares[at : at + some, None] + others
        np.maximum(part, 0, out=part)
        part *= -gamma
        np.exp(part, out=part)
    return out


def _free(y, a, cost) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may move up and rows that may move down."""
    return np.where(y > 0, a < cost, a > 0), np.where(y > 0, a > 0, a < cost)


def _steps(column: Callable, y: np.ndarray, cost: np.ndarray, a: np.ndarray, value: np.ndarray, tolerance: float) -> None:
    """Sequential minimal optimisation: changes the weights ``a`` and the ``value`` of the rows in place."""
    up, down = _free(y, a, cost)
    up, down = np.where(up, 0.0, -np.inf), np.where(down, 0.0, np.inf)
    signs, costs, weights = y.tolist(), cost.tolist(), a.tolist()
    gain, curve = np.empty(len(y)), np.empty(len(y))
    while True:
        i = int(np.add(value, up, out=gain).argmax())
        most = value[i]
        np.add(value, down, out=gain)
        np.subtract(most, gain, out=gain)
        if not gain.max() > tolerance:
            break
        column_i = column(i)
        np.subtract(1.0, column_i, out=curve)  # K_ii = 1; half the curvature
        np.maximum(curve, 5e-13, out=curve)
        np.maximum(gain, 0.0, out=gain)
        gain *= gain
        gain /= curve
        j = int(gain.argmax())
        step = float(most - value[j]) / (2 * float(curve[j]))
        room_i = costs[i] - weights[i] if signs[i] > 0 else weights[i]
        room_j = weights[j] if signs[j] > 0 else costs[j] - weights[j]
        step = min(step, room_i, room_j)
        weights[i] += signs[i] * step
        weights[j] -= signs[j] * step
        for m in (i, j):  # rounding must not leave a weight beside its border
            if weights[m] < 1e-12 * costs[m]:
                weights[m] = 0.0
            elif weights[m] > costs[m] * (1 - 1e-12):
                weights[m] = costs[m]
            below, above = weights[m] < costs[m], weights[m] > 0
            up[m] = 0.0 if (below if signs[m] > 0 else above) else -np.inf
            down[m] = 0.0 if (above if signs[m] > 0 else below) else np.inf
        np.subtract(column_i, column(j), out=curve)
        curve *= step
        value -= curve
    a[:] = weights


def _rounds(kernel: _Kernel, y: np.ndarray, cost: np.ndarray, a: np.ndarray, value: np.ndarray, tolerance: float) -> None:
    """``_steps`` among the rows that violate most, one set of rows after the other."""
    while True:
        up, down = _free(y, a, cost)
        if not (up.any() and down.any()):
            return
        gap = value[up].max() - value[down].min()
        if not gap > tolerance:
            return
        half = max(1, min(WORKING_ROWS, KERNEL_DOUBLES // len(y)) // 2)
        ups, downs = np.flatnonzero(up), np.flatnonzero(down)
        if len(ups) > half:
            ups = ups[np.argpartition(-value[ups], half - 1)[:half]]
        if len(downs) > half:
            downs = downs[np.argpartition(value[downs], half - 1)[:half]]
        rows = np.union1d(ups, downs)
        columns = kernel.columns(rows)
        among, part, values = np.ascontiguousarray(columns[:, rows]), a[rows], value[rows]
        _steps(among.__getitem__, y[rows], cost[rows], part, values, max(tolerance, gap / 10))
        value -= ((part - a[rows]) * y[rows]) @ columns
        a[rows] = part


def solve_dual(
    x: np.ndarray, y: np.ndarray, cost: np.ndarray, gamma: float, tolerance: float = TOLERANCE, start: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise ``sum(a) - 0.5 sum a_i a_j y_i y_j K_ij`` with ``0 <= a <= cost``, ``sum a y = 0``.

    Sequential minimal optimisation: of the rows that may move up, the one with the steepest gradient is paired with the
    row that promises the largest gain. With more than ``WHOLE_ROWS`` rows, the steps are taken among ``WORKING_ROWS`` rows
    at a time. ``y`` is +1 or -1. With one class only, no row has weight and the bias is its sign.
    """
    if (y > 0).all() or (y < 0).all():
        return np.zeros(len(y)), float(y[0]) if len(y) else 0.0
    kernel = _Kernel(x, gamma)
    a = np.zeros(len(y)) if start is None else start.astype(float)
    value = y.astype(float)  # the label less the weighted kernel sum
    begun, width = np.flatnonzero(a), max(1, KERNEL_DOUBLES // len(y))
    for at in range(0, len(begun), width):
        some = begun[at : at + width]
        value -= (a[some] * y[some]) @ kernel.columns(some)
    if len(y) > WHOLE_ROWS:
        _rounds(kernel, y, cost, a, value, tolerance)
    else:
        _steps(kernel.column, y, cost, a, value, tolerance)
    free = (a > 0) & (a < cost)
    if free.any():
        return a, float(value[free].mean())
    up, down = _free(y, a, cost)
    return a, float((value[up].max(initial=-np.inf) + value[down].min(initial=np.inf)) / 2)


def _sides(x: np.ndarray, pair) -> np.ndarray:
    """Signed distances of rows to a pair's border."""
    points = np.asarray(pair.points).reshape(-1, int(pair.width))
    weight, squares = np.asarray(pair.y) * np.asarray(pair.weight), (points * points).sum(axis=1)
    out, some = np.full(len(x), float(pair.bias)), max(1, SUMMED_DOUBLES // max(len(points), 1))
    for a in range(0, len(x), some):
        out[a : a + some] += weight @ rbf(points, x[a : a + some], pair.gamma, squares)
    return out


_SV = "ids array<long>, width int, points array<double>, y array<double>, cost array<double>, weight array<double>, bias double"
_COLUMNS = ["ids", "width", "points", "y", "cost", "weight", "bias"]
_FOUND = "bias double, blocks array<long>, at array<array<int>>, weight array<array<double>>"
_MODEL = "target string, iter int, test_fold int"


def _packed(ids, x, y, cost, weight, bias) -> tuple:
    return ids, x.shape[1], x.ravel(), y, cost, weight, float(bias)


def _unpacked(rows) -> tuple:
    """Rows of several parts as one problem; a row that several parts hold counts once."""
    x = np.concatenate([np.asarray(r.points).reshape(-1, int(r.width)) for r in rows])
    ids, y, cost, weight = (np.concatenate([np.asarray(getattr(r, c)) for r in rows]) for c in ("ids", "y", "cost", "weight"))
    _, first = np.unique(ids, return_index=True)
    return ids[first], x[first], y[first], cost[first], weight[first]


def _places(row) -> np.ndarray:
    return (int(row.block) << PLACE_BITS) + np.asarray(row.at, dtype=np.int64)


def _problem(frame: pd.DataFrame, first: int) -> tuple:
    """ids, points, +1/-1 and costs of the packed rows of a pair, in the order of blocks and their rows."""
    rows = list(frame.itertuples())
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0), np.zeros(0)
    ids, sizes = np.concatenate([_places(r) for r in rows]), [len(r.at) for r in rows]
    order = np.argsort(ids)
    x = np.concatenate([np.asarray(r.points).reshape(-1, int(r.width)) for r in rows])
    y = np.repeat([1.0 if r.label == first else -1.0 for r in rows], sizes)
    return ids[order], x[order], y[order], np.repeat([r.cost for r in rows], sizes)[order]


def _found(ids: np.ndarray, signed: np.ndarray, bias: float) -> tuple:
    """The bias, and by blocks the places of the rows with weight and their signed weights."""
    with_weight = np.flatnonzero(signed)
    with_weight = with_weight[np.argsort(ids[with_weight])]
    ids, signed = ids[with_weight], signed[with_weight]
    blocks, starts = np.unique(ids >> PLACE_BITS, return_index=True)
    at = (ids & ((1 << PLACE_BITS) - 1)).astype(np.int32)
    return float(bias), blocks, np.split(at, starts[1:]) if len(ids) else [], np.split(signed, starts[1:]) if len(ids) else []


def _tasks(df: DataFrame) -> int:
    """Partitions for groups whose work is large and whose bytes are few, which Spark would put together."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def training_rows(tagged: DataFrame, models: DataFrame, training: Callable, penalty: float = 1.0) -> DataFrame:
    """The rows that train each model, by block and label: places in the block, points, cost, and ``part``, the task's share.

    ``tagged``: blocks of rows (``split_blocks``); ``models``: rows with ``classes``, ``weights`` and ``gamma``.
    ``training(block)`` gives a function from a model to the mask, labels and coordinates of the rows that train it.
    """
    schema = f"{_MODEL}, label int, block long, gamma double, cost double, classes array<int>, at array<int>, width int, points array<double>"
    names = [*MODEL_KEYS, "label", "block", "gamma", "cost", "classes", "at", "width", "points"]

    def pack(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out, number, rows = [], int(block["__block"].iloc[0]), training(block)
        for model in group.itertuples():
            mask, labels, x = rows(model)
            at = np.flatnonzero(mask).astype(np.int32)
            for label, weight in zip(model.classes, model.weights):
                of = labels == label
                if of.any():
                    out.append((
                        model.target, model.iter, model.test_fold, label, (int(model.source) << BLOCK_BITS) + number,
                        model.gamma, weight * penalty, model.classes, at[of], x.shape[1], x[of].ravel(),
                    ))
        return pd.DataFrame(out, columns=names)

    # a model may train on several subjects, whose blocks have the same numbers
    sources = models.withColumn("source", F.row_number().over(Window.partitionBy(*MODEL_KEYS).orderBy("subject")) - 1)
    packed = cut_lineage(run_blocks(tagged, sources, ["subject"], pack, schema))
    number = F.row_number().over(Window.partitionBy(*MODEL_KEYS).orderBy("block")) - 1
    blocks = packed.select(*MODEL_KEYS, "block").distinct()
    parts = blocks.withColumn("number", number).withColumn("part", F.floor(F.col("number") / BLOCKS_PER_TASK).cast("int"))
    return join_measured(packed, parts, [*MODEL_KEYS, "block"])


def fit(packed: DataFrame, models: DataFrame) -> DataFrame:
    """Every class pair of a model: target, iter, test_fold, first, second, the bias, and per block the rows with weight.

    ``packed``: ``training_rows``. Weights of ``first`` are above 0, those of ``second`` below.
    """
    schema = f"{_MODEL}, `first` int, `second` int, block int, gamma double, {_SV}"
    names = [*PAIR, "block", "gamma", *_COLUMNS]

    def solve(frame: pd.DataFrame) -> tuple:
        head = frame.iloc[0]
        rows = _problem(frame[frame["label"].notna()], head["first"])
        return head, rows, solve_dual(*rows[1:], head["gamma"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        head, (ids, _, y, _), (weight, bias) = solve(frame)
        return pd.DataFrame([(*[head[c] for c in PAIR], *_found(ids, y * weight, bias))], columns=[*PAIR, "bias", "blocks", "at", "weight"])

    def first_pass(frame: pd.DataFrame) -> pd.DataFrame:
        head, (ids, x, y, cost), (weight, bias) = solve(frame)
        # rows of one class only have nothing to be told apart from here: all go on
        keep = weight > 0 if weight.any() else np.ones(len(y), bool)
        part = (*[head[c] for c in PAIR], int(head["leaf"]), head["gamma"], *_packed(ids[keep], x[keep], y[keep], cost[keep], weight[keep], bias))
        return pd.DataFrame([part], columns=names)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        rows = list(frame.sort_values("block").itertuples())
        if len(rows) == 1 and head["bias"] == head["bias"]:
            return frame[names].assign(block=int(head["block"]) // 2)
        ids, x, y, cost, start = _unpacked(rows)
        weight, bias = solve_dual(x, y, cost, head["gamma"], start=start)
        keep = weight > 0 if weight.any() else np.ones(len(y), bool)
        part = (*[head[c] for c in PAIR], int(head["block"]) // 2, head["gamma"], *_packed(ids[keep], x[keep], y[keep], cost[keep], weight[keep], bias))
        return pd.DataFrame([part], columns=names)

    def by_pair(rows: DataFrame) -> DataFrame:
        """Rows once per pair that their label is in."""
        pair = rows.withColumn("__other", F.explode(F.filter("classes", lambda c: c != F.col("label"))))
        first, second = F.least("label", "__other"), F.greatest("label", "__other")
        return pair.withColumn("first", first).withColumn("second", second).drop("classes", "__other")

    # a pair without rows has a result too
    listed = models.select(*MODEL_KEYS, "gamma", "classes").dropDuplicates(MODEL_KEYS)
    pairs = listed.select(*MODEL_KEYS, "gamma", "classes", F.explode("classes").alias("first"))
    later = F.explode(F.filter("classes", lambda c: c > F.col("first"))).alias("second")
    pairs = pairs.select(*MODEL_KEYS, "gamma", "first", later).withColumn("leaf", F.lit(0))

    sizes = packed.groupBy(*MODEL_KEYS, "label").agg(F.sum(F.size("at")).alias("n")).groupBy(*MODEL_KEYS).agg(
        F.sort_array(F.collect_list("n"), asc=False).alias("n")
    )
    largest = F.aggregate(F.slice("n", 1, 2), F.lit(0).cast("long"), lambda a, n: a + n)
    leaves = cut_lineage(sizes.select(*MODEL_KEYS, F.ceil(largest / F.lit(PAIR_ROWS)).alias("__leaves")))
    split = (leaves.agg(F.max("__leaves")).first()[0] or 0) > 1
    dealt = join_measured(packed, leaves, MODEL_KEYS)
    dealt = dealt.withColumn("leaf", F.pmod("number", "__leaves").cast("int")).drop("__leaves", "number", "part")
    problems = by_pair(dealt).unionByName(pairs, allowMissingColumns=True)
    problems = problems.repartition(_tasks(packed), *PAIR, "leaf")
    if not split:
        return cut_lineage(problems.groupBy(*PAIR, "leaf").applyInPandas(whole, f"{_MODEL}, `first` int, `second` int, {_FOUND}"))

    parts = cut_lineage(problems.groupBy(*PAIR, "leaf").applyInPandas(first_pass, schema))
    last = parts.agg(F.max("block")).first()[0] or 0
    while last > 0:
        halves = parts.withColumn("__half", F.shiftright("block", 1)).repartition(_tasks(packed), *PAIR, "__half")
        parts = cut_lineage(halves.groupBy(*PAIR, "__half").applyInPandas(meet, schema))
        last //= 2

    def check(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        pair = next(found.itertuples(), None)
        for row in rows.itertuples() if pair is not None else ():
            x, ids = np.asarray(row.points).reshape(-1, int(row.width)), _places(row)
            y, cost = np.full(len(x), 1.0 if row.label == row.first else -1.0), np.full(len(x), row.cost)
            new = (y * _sides(x, pair) < 1 - 2 * TOLERANCE) & ~np.isin(ids, np.asarray(pair.ids))
            if new.any():
                out.append((*[getattr(row, c) for c in PAIR], 1, row.gamma, *_packed(ids[new], x[new], y[new], cost[new], np.zeros(int(new.sum())), np.nan)))
        return pd.DataFrame(out, columns=names)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (*[getattr(r, c) for c in PAIR], *_found(np.asarray(r.ids), np.asarray(r.y) * np.asarray(r.weight), r.bias))
                for r in batch.itertuples()
            ]
            yield pd.DataFrame(out, columns=[*PAIR, "bias", "blocks", "at", "weight"])

    finished, left = [], parts.withColumn("block", F.lit(0))
    while True:
        rows = by_pair(packed).join(F.broadcast(left.select(*PAIR)), PAIR, "left_semi")
        violators = cut_lineage(_meet_pairs(rows, left, PAIR, check, schema))
        if violators.isEmpty():
            solved = reduce(lambda a, b: a.unionByName(b), [*finished, left])
            return cut_lineage(solved.mapInPandas(placed, f"{_MODEL}, `first` int, `second` int, {_FOUND}"))
        # pairs without violators are done: only the others are solved again and checked again
        again = F.broadcast(violators.select(*PAIR).distinct())
        finished.append(left.join(again, PAIR, "left_anti"))
        solved = left.join(again, PAIR, "left_semi").unionByName(violators)
        left = cut_lineage(solved.repartition(_tasks(packed), *PAIR).groupBy(*PAIR).applyInPandas(meet, schema))


def _meet_pairs(packed: DataFrame, pairs: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(packed rows, pair)`` for the blocks of one ``part`` at a time; ``packed`` has the pair's keys."""
    copies = pairs.join(packed.select(*keys, "part").distinct(), keys)
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
    by, tasks = [*keys, "part"], _tasks(packed)
    return packed.repartition(tasks, *by).groupBy(*by).cogroup(copies.repartition(tasks, *by).groupBy(*by)).applyInPandas(fn, schema)


def predict(
    tagged: DataFrame, models: DataFrame, packed: DataFrame, pairs: DataFrame, tested: Callable, row_id: str, id_type: str
) -> DataFrame:
    """Class of each tested row: most votes of the pairs, the first of equal ones (target, iter, row id, y, y_pred).

    ``packed``: the rows that ``pairs`` were fitted on. ``tested(block)`` gives a function from a model to the mask and
    coordinates of the rows that it predicts.
    """
    rows_schema = f"{_MODEL}, block int, ids array<{id_type}>, y array<int>, width int, points array<double>"
    sums_names = [*MODEL_KEYS, "block", "ids", "y", "firsts", "seconds", "biases", "sums"]
    sums_schema = f"{_MODEL}, block int, ids array<{id_type}>, y array<int>, firsts array<int>, seconds array<int>, biases array<double>, sums array<double>"

    def pack(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out, number, rows = [], int(block["__block"].iloc[0]), tested(block)
        for model in group.itertuples():
            mask, x = rows(model)
            if mask.any():
                out.append((
                    model.target, model.iter, model.test_fold, number, block[row_id].to_numpy()[mask],
                    block["label"].to_numpy()[mask], x.shape[1], x.ravel(),
                ))
        return pd.DataFrame(out, columns=[*MODEL_KEYS, "block", "ids", "y", "width", "points"])

    def add_up(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """Weighted kernel sums of every pair over the support vectors of a part; a class meets the rows once for all its pairs."""
        if rows.empty:
            return pd.DataFrame({c: [] for c in sums_names})
        head = rows.iloc[0]
        pairs = list(zip(head["firsts"], head["seconds"]))
        x = [np.asarray(r.points).reshape(-1, int(r.width)) for r in rows.itertuples()]
        ends = np.cumsum([len(part) for part in x])
        x, placed = np.concatenate(x), list(found[found["label"].isna()].itertuples())
        sums = np.zeros((len(x), len(pairs)))
        for label, of in found[found["label"].notna()].sort_values("block").groupby("label"):
            of = list(of.itertuples())
            ids = np.concatenate([_places(r) for r in of])
            column = {pair: i for i, pair in enumerate(p for p in pairs if label in p)}
            weight = np.zeros((len(ids), len(column)))
            for r in placed:
                if (r.first, r.second) in column:
                    signed = np.asarray(r.weight)
                    own = signed > 0 if r.first == label else signed < 0
                    weight[np.searchsorted(ids, _places(r)[own]), column[r.first, r.second]] = signed[own]
            live = weight.any(axis=1)
            if not live.any():
                continue
            points = np.concatenate([np.asarray(r.points).reshape(-1, int(r.width)) for r in of])[live]
            to, weight, squares = [pairs.index(p) for p in column], weight[live], (points * points).sum(axis=1)
            some = max(1, SUMMED_DOUBLES // len(points))
            for a in range(0, len(x), some):
                sums[a : a + some, to] += rbf(x[a : a + some], points, of[0].gamma, None, squares) @ weight
        parts = np.split(sums, ends[:-1])
        out = [
            (*[getattr(r, c) for c in [*MODEL_KEYS, "block", "ids", "y", "firsts", "seconds", "biases"]], part.ravel())
            for r, part in zip(rows.itertuples(), parts)
        ]
        return pd.DataFrame(out, columns=sums_names)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        sides = np.sum([np.asarray(s) for s in frame["sums"]], axis=0).reshape(len(first["ids"]), -1) + np.asarray(first["biases"])
        firsts, seconds = np.asarray(first["firsts"]), np.asarray(first["seconds"])
        classes = np.unique(np.concatenate([firsts, seconds]))
        won = np.zeros((len(sides), len(classes)), int)
        for side, a, b in zip(sides.T, np.searchsorted(classes, firsts), np.searchsorted(classes, seconds)):
            won[np.arange(len(won)), np.where(side > 0, a, b)] += 1
        return pd.DataFrame({
            "target": first["target"], "iter": first["iter"], row_id: first["ids"], "y": first["y"],
            "y_pred": classes[won.argmax(axis=1)],
        })

    rows = cut_lineage(run_blocks(tagged, models, ["subject"], pack, rows_schema))
    group = F.floor(F.col("block") / BLOCKS_PER_TASK).cast("int")
    borders = pairs.groupBy(*MODEL_KEYS).agg(F.sort_array(F.collect_list(F.struct("first", "second", "bias"))).alias("b"))
    borders = borders.select(*MODEL_KEYS, F.col("b.first").alias("firsts"), F.col("b.second").alias("seconds"), F.col("b.bias").alias("biases"))
    parts = cut_lineage(packed.select(*MODEL_KEYS, "block", "part").distinct())
    tests = join_measured(rows.withColumn("group", group), borders, MODEL_KEYS)
    tests = join_measured(tests, parts.select(*MODEL_KEYS, "part").distinct(), MODEL_KEYS, "left")
    tests = tests.withColumn("part", F.coalesce("part", F.lit(0)))

    entry = F.explode(F.arrays_zip("blocks", "at", "weight")).alias("e")
    placed = pairs.select(*PAIR, entry).select(*PAIR, F.col("e.blocks").alias("block"), "e.at", "e.weight")
    placed = join_measured(placed, parts, [*MODEL_KEYS, "block"])
    found = packed.drop("classes", "cost", "number").unionByName(placed, allowMissingColumns=True)
    found = join_measured(found, rows.select(*MODEL_KEYS, group.alias("group")).distinct(), MODEL_KEYS)
    found = found.select(*[F.col(c).alias(c) for c in found.columns])

    by, tasks = [*MODEL_KEYS, "part", "group"], _tasks(packed)
    met = tests.repartition(tasks, *by).groupBy(*by).cogroup(found.repartition(tasks, *by).groupBy(*by))
    schema = f"target string, iter int, `{row_id}` {id_type}, y int, y_pred int"
    return met.applyInPandas(add_up, sums_schema).groupBy(*MODEL_KEYS, "block").applyInPandas(count, schema)
