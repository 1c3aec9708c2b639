"""Second-order boosted trees over binned columns, with waiting times, counts, values and classes as targets.

Columns are cut into bins once, and rows that are then alike become one with a weight.  For each level of a tree every task adds up its rows' first and second derivatives by
(model, class, node, column, bin); the sums, whose size does not depend on the rows, meet in a tree of reductions, and
the best split of each node is read off them, with the side on which missing values do better.  Two models grow in the
same passes: a probe that does not see the newest rows and tells on them when to stop, and the one that is kept.
"""

from __future__ import annotations

import json
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.shared import written

#: Bins of a column besides the one of missing values, and rows that are packed together.
BINS, PACKED = 64, 1 << 14
#: Rows unlike one another that a task counts before it gives them on.
GATHERED = 1 << 18
#: Values of unlike rows up to which one task fits on them; beyond, each level of a round is a job. The trees are the same.
ONE_TASK = 1 << 20
#: Parts whose sums meet on the driver at once; those of more meet in tasks first.
FLAT = 16
#: After so many rounds what all trees say is worked out from the rows as they came, not from those of the round before.
REFRESH = 16
#: Weight below which a side of a split does not stand, and the penalty on a leaf's weight.
MIN_WEIGHT, SHRINK = 1.0, 1.0
TWEEDIE_POWER, AFT_SCALE = 1.5, 1.0
PROBE, KEPT = 0, 1
#: Of a gain only so many digits count, so that the order in which sums were added up does not decide; of a leaf's value
#: more, since it is added up over all rows.
DIGITS, LEAF_DIGITS = 9, 12

_GRID = np.arange(-12.0, 12.0, 1 / 512)
_TAIL = np.array([math.erfc(z / math.sqrt(2)) / 2 for z in _GRID])
_HAZARD = np.exp(-_GRID * _GRID / 2) / math.sqrt(2 * math.pi) / _TAIL


def hazard(z: np.ndarray) -> np.ndarray:
    """The normal density over the mass above it."""
    return np.where(z < _GRID[-1], np.interp(z, _GRID, _HAZARD), z + 1 / np.maximum(z, 1))


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: column and last bin that goes left (-1: a leaf), where missing values go, a leaf's value."""

    column: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray, steps: int | None = None) -> np.ndarray:
        """The node where each row ends, or where it is after so many steps."""
        node, start, flat = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins)) * bins.shape[1], bins.ravel()
        for _ in range(int(math.log2(len(self.column) + 1)) - 1 if steps is None else steps):
            column = self.column[node]
            own = np.take(flat, start + np.maximum(column, 0))
            left = np.where(own == BINS, self.missing_left[node], own <= self.bin[node])
            node = np.where(column < 0, node, 2 * node + 2 - left)
        return node

    def says(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class Boosted:
    """Edges of each column's bins, where predictions begin for each class, and the trees of each round, one a class."""

    objective: str
    edges: list[np.ndarray]
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Raw scores, rows x classes, of values with NaN where missing."""
        return self.scores_of(binned(x, self.edges))

    def scores_of(self, bins: np.ndarray) -> np.ndarray:
        bins, at = _unlike(bins)
        out = np.tile(np.array(self.base), (len(bins), 1))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[:, k] += tree.says(bins)
        return out[at]

    def save(self, path: str) -> None:
        lists = [[{n: getattr(t, n).tolist() for n in ("column", "bin", "missing_left", "value")} for t in trees] for trees in self.trees]
        text = json.dumps({"objective": self.objective, "edges": [e.tolist() for e in self.edges], "base": self.base, "trees": lists})
        session = SparkSession.getActiveSession()
        session.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> Boosted:
        kept = json.loads(SparkSession.getActiveSession().read.text(path, wholetext=True).first()["value"])
        kinds = {"column": np.int64, "bin": np.int64, "missing_left": bool, "value": float}
        trees = [[Tree(**{n: np.array(t[n], dtype=k) for n, k in kinds.items()}) for t in some] for some in kept["trees"]]
        return cls(kept["objective"], [np.array(e) for e in kept["edges"]], kept["base"], trees)


def output(objective: str, scores: np.ndarray) -> np.ndarray:
    """Scores in the target's own unit, or as chances of each class."""
    if objective == "softprob":
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-scores))
        return np.concatenate([1 - p, p], axis=1)
    return np.exp(np.clip(scores, -80, 80)) if objective in ("tweedie", "poisson", "aft") else scores


def derivatives(objective: str, scores: np.ndarray, y: np.ndarray, seen: np.ndarray, width: float):
    """First and second derivatives of each row's loss, rows x classes. ``seen`` is false for a waiting time still open
    at ``y``; ``width`` is where absolute errors begin to count in full."""
    m = scores[:, 0]
    if objective == "squared":
        g, h = m - y, np.ones_like(m)
    elif objective == "absolute":  # the quadratic that touches the smoothed absolute error from above
        h = 1 / np.sqrt(1 + ((m - y) / width) ** 2)
        g = h * (m - y)
    elif objective == "tweedie":
        a, b = y * np.exp((1 - TWEEDIE_POWER) * m), np.exp((2 - TWEEDIE_POWER) * m)
        g, h = b - a, (TWEEDIE_POWER - 1) * a + (2 - TWEEDIE_POWER) * b
    elif objective == "poisson":
        h = np.exp(m)
        g = h - y
    elif objective == "aft":
        z = (np.log(y) - m) / AFT_SCALE
        beyond = hazard(z)
        g = -np.where(seen, z, beyond) / AFT_SCALE
        h = np.where(seen, 1.0, np.maximum(beyond * (beyond - z), 1e-12)) / AFT_SCALE**2
    elif objective == "logistic":
        p = output(objective, scores)[:, 1]
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
    else:
        p = output(objective, scores)
        own = np.arange(p.shape[1]) == y[:, None]
        return p - own, np.maximum(2 * p * (1 - p), 1e-12)
    return g[:, None], h[:, None]


def losses(objective: str, scores: np.ndarray, y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each row's loss, by which the probe stops."""
    m = scores[:, 0]
    if objective == "squared":
        return (m - y) ** 2
    if objective == "absolute":
        return np.abs(m - y)
    if objective == "tweedie":
        return -y * np.exp((1 - TWEEDIE_POWER) * m) / (1 - TWEEDIE_POWER) + np.exp((2 - TWEEDIE_POWER) * m) / (2 - TWEEDIE_POWER)
    if objective == "poisson":
        return np.exp(m) - y * m
    if objective == "aft":
        z = (np.log(y) - m) / AFT_SCALE
        tail = np.where(z < _GRID[-1], np.interp(z, _GRID, np.log(_TAIL)), -z * z / 2 - np.log(np.maximum(z, 1)) - 0.92)
        return np.where(seen, z * z / 2, -tail)
    p = output(objective, scores)
    return -np.log(np.maximum(p[np.arange(len(p)), y.astype(np.int64)], 1e-15))


def bin_edges(rows: DataFrame, features: list[str | Column], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each column's bins but the last, from quantile sketches of all rows in one pass."""
    return _edges(rows.agg(*_sketches(features, bins)).first(), len(features)) if features else []


def _sketches(features: list[str | Column], bins: int = BINS) -> list[Column]:
    shares = [F.lit(k / bins) for k in range(1, bins)]
    return [F.percentile_approx(_number(f), F.array(*shares), 10_000).alias(f"__q{i}") for i, f in enumerate(features)]


def _edges(row: Row, columns: int) -> list[np.ndarray]:
    return [np.unique(np.array(row[f"__q{i}"] or [], dtype=np.float64)) for i in range(columns)]


def _number(feature: str | Column) -> Column:
    """A column, or one of this name, as a double, null where it is no finite number."""
    value = (F.col(f"`{feature}`") if isinstance(feature, str) else feature).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), BINS, np.searchsorted(e, x[:, f], side="left"))
    return out


def _unlike(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of bins that differ, and which of them each row is."""
    if not bins.size:
        return bins, np.arange(len(bins))
    raw = pa.py_buffer(np.ascontiguousarray(bins, dtype=np.uint8))
    found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bins.shape[1]), len(bins), [None, raw]).dictionary_encode()
    own = np.frombuffer(found.dictionary.buffers()[1], np.uint8, len(found.dictionary) * bins.shape[1])
    return own.reshape(-1, bins.shape[1]), np.asarray(found.indices)


def packed(rows: DataFrame, features: list[str | Column], edges: list[np.ndarray], y: Column, seen: Column, newest: Column) -> DataFrame:
    """Rows packed by the thousand: ``bins`` (rows x columns), ``y``, the two flags of each row as bytes, and its ``weight``.

    Rows that are alike in all of these are one row whose weight is their number: tasks count what they read, a shuffle adds
    the counts up.
    """
    width = len(edges)

    def count(batches):
        held, n = [], 0
        for batch in batches:
            column = lambda i: np.asarray(batch.column(i).cast(pa.float64()).fill_null(float("nan")))  # noqa: B023, E731
            x = np.stack([column(i) for i in range(width)], axis=1) if edges else np.zeros((batch.num_rows, 0))
            flags = [np.asarray(batch.column(width + k)).astype(np.uint8)[:, None] for k in (1, 2)]
            rows_ = np.concatenate([binned(x, edges), column(width).view(np.uint8).reshape(-1, 8), *flags], axis=1)
            held.append(counted(pa.FixedSizeBinaryArray.from_buffers(pa.binary(width + 10), len(rows_), [None, pa.py_buffer(rows_.tobytes())]), None))
            n += len(held[-1])
            if n >= GATHERED:
                held = [together(held)]
                n = len(held[0])
                if n >= GATHERED // 2:  # few are alike
                    yield from given(held)
                    held, n = [], 0
        if held:
            yield from given([together(held)])

    def counted(keys, n):
        table = pa.table({"key": keys, "n": pa.array(np.ones(len(keys), np.int64)) if n is None else n})
        found = table.group_by("key").aggregate([("n", "sum")])
        return pa.table({"key": found["key"], "n": found["n_sum"]})

    def together(held):
        table = pa.concat_tables(held)
        return counted(table["key"], table["n"])

    def given(held):
        for table in held:
            yield from table.cast(pa.schema([("key", pa.binary()), ("n", pa.int64())])).to_batches(PACKED)

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    def block(held):
        table = pa.Table.from_batches(held)
        raw = np.frombuffer(b"".join(table["key"].to_pylist()), np.uint8).reshape(table.num_rows, width + 10)
        parts = raw[:, :width], raw[:, width : width + 8], raw[:, width + 8], raw[:, width + 9], np.asarray(table["n"]).astype(np.float64)
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["bins", "y", "seen", "newest", "weight"])

    flags = [F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in (("s", seen), ("n", newest))]
    wide = rows.select(*[_number(f).alias(f"x{i}") for i, f in enumerate(features)], y.cast("double").alias("y"), *flags)
    alike = wide.mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return alike.mapInArrow(pack, "bins binary, y binary, seen binary, newest binary, weight binary")


@dataclass
class _Block:
    bins: np.ndarray
    y: np.ndarray
    seen: np.ndarray
    newest: np.ndarray
    weight: np.ndarray  # how many rows each stands for
    scores: list[np.ndarray]  # of each model


def _block(columns: int, base: list[float]):
    def unpack(row) -> _Block:
        y, weight = (np.frombuffer(row[n], np.float64) for n in ("y", "weight"))
        flags = [np.frombuffer(row[n], np.uint8).astype(bool) for n in ("seen", "newest")]
        return _Block(np.frombuffer(row["bins"], np.uint8).reshape(len(y), columns), y, *flags, weight, [np.tile(np.array(base), (len(y), 1)) for _ in (PROBE, KEPT)])

    return unpack


def _added(block: _Block, trees: list[list[list[Tree]]]) -> list[np.ndarray]:
    """Scores of each model after its further trees."""
    out = []
    for scores, rounds in zip(block.scores, trees):
        scores = scores.copy()
        for some in rounds:
            for k, tree in enumerate(some):
                scores[:, k] += tree.says(block.bins)
        out.append(scores)
    return out


def _sums(blocks, objective: str, trees, growing: list[list[Tree]], level: int, columns: int, width: float) -> np.ndarray:
    """A task's sums of both derivatives by (model, class, node of the level, column, bin), then the newest rows' loss by the probe and their number."""
    classes, nodes = len(growing[KEPT]), 1 << level
    shape = (len(growing), classes, nodes, columns, BINS + 1)
    total, loss, n = np.zeros((2, math.prod(shape))), 0.0, 0
    offset = np.arange(columns) * (BINS + 1)
    for block in blocks:
        scores = _added(block, trees)
        if block.newest.any():
            loss += losses(objective, scores[PROBE][block.newest], block.y[block.newest], block.seen[block.newest]) @ block.weight[block.newest]
            n += block.weight[block.newest].sum()
        for model, own in enumerate(growing):
            use = ~block.newest if model == PROBE else np.ones(len(block.y), dtype=bool)
            if not own or not use.any():
                continue
            bins, weight, g_h = block.bins[use], block.weight[use], derivatives(objective, scores[model][use], block.y[use], block.seen[use], width)
            for k, tree in enumerate(own):
                node = tree.leaves(bins, level) - (nodes - 1)
                here = node >= 0
                at = (((model * classes + k) * nodes + node[here])[:, None] * columns * (BINS + 1) + offset + bins[here]).ravel()
                for i in (0, 1):
                    total[i] += np.bincount(at, np.repeat(g_h[i][here, k] * weight[here], columns), minlength=total.shape[1])
    return np.concatenate([total.ravel(), [loss, n]])


def _rounded(x: np.ndarray, to: int = DIGITS) -> np.ndarray:
    with np.errstate(divide="ignore"):
        digits = to - 1 - np.floor(np.log10(np.abs(x), where=x != 0, out=np.zeros_like(x)))
    scale = 10.0 ** np.clip(digits, -300, 300)
    return np.round(x * scale) / scale


def best_split(g: np.ndarray, h: np.ndarray, min_weight: float = MIN_WEIGHT, shrink: float = SHRINK):
    """``(column, bin, missing_left)`` of the best split of one node by its sums, columns x bins with the missing last; None where none gains."""
    left_g, left_h = np.cumsum(g[:, :BINS], axis=1)[:, :-1], np.cumsum(h[:, :BINS], axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    sides = []
    for side in (1, 0):
        a, b = left_g + side * g[:, BINS:], left_h + side * h[:, BINS:]
        gain = a * a / (b + shrink) + (all_g - a) ** 2 / (all_h - b + shrink) - all_g**2 / (all_h + shrink)
        sides.append(np.where((b >= min_weight) & (all_h - b >= min_weight), gain, -np.inf))
    gain = np.stack(sides)
    gain = np.where(np.isfinite(gain), _rounded(np.where(np.isfinite(gain), gain, 0.0)), -np.inf)
    if not gain.size or gain.max() <= 1e-12:
        return None
    side, column, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(column), int(cut), side == 0


def _leaf(g: float, h: float, rate: float, shrink: float) -> float:
    return float(_rounded(np.array([-rate * g / (h + shrink)]), LEAF_DIGITS)[0])


def _empty(depth: int) -> Tree:
    n = (1 << (depth + 1)) - 1
    return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))


def _grow(tree: Tree, level: int, g: np.ndarray, h: np.ndarray, rate: float, min_weight: float, shrink: float) -> None:
    """Splits the nodes of a level by their sums, nodes x columns x bins; both sides get the leaf values that they would have."""
    for node in range(1 << level):
        at = (1 << level) - 1 + node
        if level and tree.column[(at - 1) // 2] < 0:
            continue
        if level == 0:
            tree.value[0] = _leaf(g[0, 0].sum(), h[0, 0].sum(), rate, shrink)
        split = best_split(g[node], h[node], min_weight, shrink)
        if split is None:
            continue
        column, cut, missing_left = split
        a, b = (x[node, column, : cut + 1].sum() + missing_left * x[node, column, BINS] for x in (g, h))
        tree.column[at], tree.bin[at], tree.missing_left[at] = column, cut, missing_left
        tree.value[2 * at + 1] = _leaf(a, b, rate, shrink)
        tree.value[2 * at + 2] = _leaf(g[node, column].sum() - a, h[node, column].sum() - b, rate, shrink)


@dataclass(frozen=True)
class Settings:
    objective: str
    depth: int = 4
    rounds: int = 100
    rate: float = 0.1
    patience: int = 10
    min_weight: float = MIN_WEIGHT
    shrink: float = SHRINK


def grow(sums, s: Settings, columns: int, base: list[float], probing: bool, refresh) -> list[list[Tree]]:
    """The kept model's trees. ``sums(trees, growing, level)`` gives the sums over all rows; ``refresh(trees)`` is told after
    each round to store what its trees say."""
    classes = len(base)
    trees: list[list[list[Tree]]] = [[], []]
    fresh: list[list[list[Tree]]] = [[], []]
    best, best_at = math.inf, 0
    for round_ in range(s.rounds):
        growing = [[_empty(s.depth) for _ in range(classes)] if model == KEPT or probing else [] for model in (PROBE, KEPT)]
        for level in range(s.depth):
            got = sums(fresh, growing, level)
            if round_ == 0 and not got[-1]:
                probing = False  # no row is set apart
            if level == 0 and probing:
                loss = got[-2] / max(got[-1], 1)
                if loss < best * (1 - 1e-9) or round_ == 0:
                    best, best_at = loss, round_
                elif round_ - best_at >= s.patience:
                    return trees[KEPT][: max(best_at, 1)]
            g, h = got[:-2].reshape(2, 2, classes, 1 << level, columns, BINS + 1)
            for model, own in enumerate(growing):
                for k, tree in enumerate(own):
                    _grow(tree, level, g[model, k], h[model, k], s.rate, s.min_weight, s.shrink)
            if not any((tree.column[(1 << level) - 1 : (2 << level) - 1] >= 0).any() for own in growing for tree in own):
                break
        for model, own in enumerate(growing):
            if own:
                trees[model].append(own)
                fresh[model].append(own)
        refresh(fresh)
        fresh = [[], []]
    if probing:
        got = sums(fresh, [[], [_empty(0) for _ in range(classes)]], 0)
        if not got[-2] / max(got[-1], 1) < best * (1 - 1e-9):
            return trees[KEPT][: max(best_at, 1)]
    return trees[KEPT]


def heads(objectives: list[str], features: list[str | Column], y: Column) -> list[Column]:
    """Aggregates over all rows that fits begin with: the bins of each column, and where each objective's predictions begin."""
    middle = lambda o: F.percentile_approx(y, 0.5) if o == "absolute" else F.avg(F.ln(y) if o == "aft" else y)
    return [*_sketches(features), *[middle(o).alias(f"__m_{o}") for o in dict.fromkeys(objectives)]]


def start(objective: str, table: DataFrame, classes: int, middle: float | None) -> tuple[list[float], float]:
    """Where predictions begin, and the width of absolute errors over packed rows, by the middle that ``heads`` tells."""
    if objective == "softprob":
        return [0.0] * classes, 1.0
    if objective == "absolute":
        return [float(middle or 0.0)], max(0.1 * _spread(table, middle or 0.0), 1e-9)
    return _begin(objective, round(middle or 0.0, 12)), 1.0


def _spread(table: DataFrame, middle: float) -> float:
    """The mean distance from the middle, of packed rows by their weights."""

    def fold(batches):
        for batch in batches:
            both = [[np.frombuffer(x, np.float64) for x in batch.column(i).to_pylist()] for i in (0, 1)]
            sums = np.sum([(w @ np.abs(y - middle), w.sum()) for y, w in zip(*both)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], ["off", "n"])

    return table.select("y", "weight").mapInArrow(fold, "off double, n double").agg(F.try_divide(F.sum("off"), F.sum("n"))).first()[0] or 0.0


def _begin(objective: str, mean: float) -> list[float]:
    if objective in ("tweedie", "poisson"):
        return [math.log(max(mean, 1e-9))]
    if objective == "logistic":
        share = min(max(mean, 1e-6), 1 - 1e-6)
        return [math.log(share / (1 - share))]
    return [float(mean)]


def fit(
    rows: DataFrame, features: list[str | Column], settings: list[Settings], y: Column, seen: Column | None = None, newest: Column | None = None, classes: int = 1, head: Row | None = None
) -> list[Boosted]:
    """Boosted trees on ``rows``, a model for each of the settings. ``y`` is the target (a class's code for classes, time waited
    for waits), ``seen`` tells ended waits from open ones, ``newest`` the rows by which the number of rounds is found; without
    it all rounds are kept.

    ``head`` is the row of ``heads``, where the caller has it from a pass of its own. Rows are binned and packed once into
    a table, from which all the models are fitted.  Where few are unlike one another one task fits on them; else a pass over
    them is one job per level of a round.
    """
    spark, columns = rows.sparkSession, len(features)
    head = rows.agg(*heads([s.objective for s in settings], features, y)).first() if head is None else head
    edges = _edges(head, columns)
    table = written(packed(rows, features, edges, y, F.lit(True) if seen is None else seen, F.lit(False) if newest is None else newest))
    unlike = table.agg(F.sum(F.length("seen"))).first()[0] or 0
    wanted = [(s, *start(s.objective, table, classes, head[f"__m_{s.objective}"])) for s in settings]
    at_once = 0 < unlike * max(1, columns) <= ONE_TASK
    grown = _grown_at_once(table, wanted, columns, newest is not None) if at_once else [_grown_by_passes(spark, table, *w, columns, newest is not None) for w in wanted]
    return [Boosted(s.objective, edges, base, trees) for (s, base, _), trees in zip(wanted, grown)]


def _grown_by_passes(spark: SparkSession, table: DataFrame, s: Settings, base: list[float], width: float, columns: int, probing: bool) -> list[list[Tree]]:
    """The trees from a job per level of a round. Sums are reduced in a tree, as an RDD, since every pass is the same imperative
    fold over whole blocks and its result a single array."""
    base_blocks = table.rdd.map(_block(columns, base)).persist(StorageLevel.MEMORY_AND_DISK)
    parts = base_blocks.getNumPartitions()
    state: dict = {"now": base_blocks, "past": [], "told": [[], []], "turns": 0}

    def sums(trees, growing, level):
        sent = spark.sparkContext.broadcast(growing)

        def fold(part):
            yield _sums(part, s.objective, trees, sent.value, level, columns, width)

        try:
            return state["now"].mapPartitions(fold).treeReduce(np.add, 1 if parts <= FLAT else 2)
        finally:
            sent.unpersist()
            while state["past"]:  # what the sums were read from is stored by now
                state["past"].pop().unpersist()

    def refresh(trees):
        """Rows with what the trees say, from the rows before, or from the first ones where the way from there is long."""
        for model, more in enumerate(trees):
            state["told"][model] += more
        state["turns"] += 1
        anew = state["turns"] % REFRESH == 0
        sent = spark.sparkContext.broadcast(state["told"] if anew else trees)

        def add(block):
            block.scores = _added(block, sent.value)
            return block

        if state["now"] is not base_blocks:
            state["past"].append(state["now"])
        state["now"] = (base_blocks if anew else state["now"]).map(add).persist(StorageLevel.MEMORY_AND_DISK)

    try:
        return grow(sums, s, columns, base, probing, refresh)
    finally:
        for blocks in (base_blocks, state["now"], *state["past"]):
            blocks.unpersist()


def start_of(objective: str, y: np.ndarray, classes: int) -> tuple[list[float], float]:
    """``start`` of rows at hand."""
    if objective == "softprob":
        return [0.0] * classes, 1.0
    if objective == "absolute":
        middle = float(np.percentile(y, 50, method="inverted_cdf"))
        return [middle], max(0.1 * float(np.abs(y - middle).mean()), 1e-9)
    mean = round(float((np.log(y) if objective == "aft" else y).mean()), 12)
    return _begin(objective, mean), 1.0


def _grown(blocks: list[_Block], s: Settings, columns: int, base: list[float], probing: bool, width: float) -> list[list[Tree]]:
    """The trees from all blocks at hand."""

    def sums(trees, growing, level):
        return _sums(blocks, s.objective, trees, growing, level, columns, width)

    def refresh(trees):
        for block in blocks:
            block.scores = _added(block, trees)

    return grow(sums, s, columns, base, probing, refresh)


def _grown_at_once(table: DataFrame, wanted: list[tuple[Settings, list[float], float]], columns: int, probing: bool) -> list[list[list[Tree]]]:
    """The trees of each of the wanted models from one task that reads all blocks; there are ONE_TASK values at most."""

    def run(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        grown = [_grown([_block(columns, base)(row) for row in rows], s, columns, base, probing, width) for s, base, width in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grown)], pa.binary())], ["trees"])

    return pickle.loads(table.coalesce(1).mapInArrow(run, "trees binary").first()["trees"])


def fit_local(bins: np.ndarray, settings: Settings, y: np.ndarray, seen: np.ndarray, newest: np.ndarray, base: list[float], width: float) -> Boosted:
    """The same fit inside one task, on a bounded number of rows that are binned already."""
    block = _Block(bins, y, seen, newest, np.ones(len(y)), [np.tile(np.array(base), (len(y), 1)) for _ in (PROBE, KEPT)])
    return Boosted(settings.objective, [], base, _grown([block], settings, bins.shape[1], base, bool(newest.any()), width))


def histogram(rows: DataFrame, features: list[str], model: Boosted, y: Column, seen: Column | None = None) -> DataFrame:
    """``feature, bin, g, h, n``: the sums from which the next tree's first split would be read, as a table; null bin: missing."""
    blocks = packed(rows, features, model.edges, y, F.lit(True) if seen is None else seen, F.lit(False))
    names, columns = features, len(features)

    def fold(batches):
        unpack = _block(columns, model.base)
        for batch in batches:
            for row in batch.to_pylist():
                block = unpack(row)
                scores = _added(block, [[], model.trees])[KEPT]
                g, h = (x[:, 0] for x in derivatives(model.objective, scores, block.y, block.seen, 1.0))
                at = (np.arange(columns) * (BINS + 1) + block.bins).ravel()
                sums = [np.bincount(at, np.repeat(w * block.weight, columns), minlength=columns * (BINS + 1)) for w in (g, h, np.ones(len(g)))]
                own = np.flatnonzero(sums[2])
                bins = own % (BINS + 1)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in own // (BINS + 1)]), pa.array(bins, mask=bins == BINS), *(pa.array(x[own]) for x in sums)], ["feature", "bin", "g", "h", "n"])

    parts = blocks.mapInArrow(fold, "feature string, bin long, g double, h double, n double")
    return parts.groupBy("feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").cast("long").alias("n"))


def prediction(model: Boosted, features: list[str | Column]) -> Column:
    """What a model with one value says of each row."""

    @F.pandas_udf("double")
    def says(x: pd.DataFrame) -> pd.Series:
        return pd.Series(output(model.objective, model.scores(x.to_numpy(dtype=np.float64, na_value=np.nan)))[:, 0])

    return says(F.struct(*[_number(f).alias(f"x{i}") for i, f in enumerate(features)]))


def each_prediction(models: list[Boosted], features: list[str | Column]) -> Column:
    """What models with one value say of each row, in one pass: a struct with a field ``p0``, ``p1`` and so on for each."""
    names = [f"p{i}" for i in range(len(models))]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def says(x: pd.DataFrame) -> pd.DataFrame:
        values = x.to_numpy(dtype=np.float64, na_value=np.nan)
        return pd.DataFrame({n: output(m.objective, m.scores(values))[:, 0] for n, m in zip(names, models)})

    return says(F.struct(*[_number(f).alias(f"x{i}") for i, f in enumerate(features)]))


def predictions(model: Boosted, features: list[str | Column]) -> Column:
    """What the model says of each row: an array with one value, or with each class's chance."""

    @F.pandas_udf("array<double>")
    def says(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(output(model.objective, model.scores(x.to_numpy(dtype=np.float64, na_value=np.nan)))))

    return says(F.struct(*[_number(f).alias(f"x{i}") for i, f in enumerate(features)]))
