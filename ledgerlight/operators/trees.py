"""Forests and boosted trees for regression, grown from histograms over binned rows.

Spark's growers keep every row as an object (some 265 bytes for a forest of 20 trees) and update
statistics entry by entry, once per level of every tree. Here a row is one or two bytes per feature
and its label, many rows are one binary cell, and a level is a few ``bincount`` calls per cell. Boosting
takes no samples, so rows with the same bins always stay together: they are one group with its number
of rows, mean and spread, which loses nothing. What is computed is the same: thresholds, bootstrap
law, choice of features and splits, stopping, pruning and the boosting steps follow
``org.apache.spark.ml.tree.impl``, and the result is Spark's own model.

The driver holds the trees and, per pass, sums of as many nodes as ``maxMemoryInMB`` allows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.staging import discard, stage

# Workers get this module's functions with each job, so the package need not be on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows per binary cell at most; what one bincount works on stays in a core's cache.
BLOCK_ROWS = 2**15
# Rows and groups of no more bytes are grown on the driver: a pass takes less than a Spark job's start.
LOCAL_ROWS, LOCAL_GROUPS = 2**22, 2**25
# Rows that are grouped at once.
GROUP_ROWS = 2**20
# Partial sums that go straight to the driver; more of them are first added up by tasks.
DIRECT_PARTS = 16
_BLOCKS = "block long, bins binary, target binary"


def supported(estimator: Estimator, vectors: DataFrame) -> bool:
    """Whether :func:`fit` grows this estimator's trees; the others are left to Spark."""
    if type(estimator) not in (RandomForestRegressor, GBTRegressor):
        return False
    value = estimator.getOrDefault
    attributes = vectors.schema[value("featuresCol")].metadata.get("ml_attr", {}).get("attrs", {})
    plain = "nominal" not in attributes and "binary" not in attributes
    plain = plain and not estimator.isDefined("weightCol") and value("impurity") == "variance" and value("maxBins") <= 2**16
    if isinstance(estimator, GBTRegressor):
        return plain and value("lossType") == "squared" and value("subsamplingRate") == 1.0 and not estimator.isDefined("validationIndicatorCol")
    return plain and (value("bootstrap") or value("subsamplingRate") == 1.0)


def thresholds(values: np.ndarray, max_splits: int) -> np.ndarray:
    """Midpoints between neighbouring values of a feature: all, or ``max_splits`` at even steps of the rows."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) <= max_splits:
        return middles
    stride = len(values) / (max_splits + 1)
    upto, target, found = np.cumsum(counts), stride, []
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


_Cell = tuple[int, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Binned:
    """Training rows as cells of bins and labels; ``splits`` has the thresholds of every feature.

    Instead of its label a group has three numbers: rows, mean label, and the sum of squares around it.
    The cells are a stored table, or a list if they are small.
    """

    blocks: DataFrame | list[_Cell]
    splits: list[np.ndarray]
    rows: int
    parts: int

    @property
    def kind(self) -> str:
        """The type of a bin's number."""
        return "u1" if self.width <= 2**8 else "<u2"

    @property
    def width(self) -> int:
        return max(len(s) for s in self.splits) + 1

    def mapped(self, function: Callable[[Iterator[_Cell]], Iterator[_Cell]]) -> Binned:
        """The rows with other labels."""
        if isinstance(self.blocks, list):
            return replace(self, blocks=list(function(iter(self.blocks))))
        kind, k = self.kind, len(self.splits)
        run = lambda batches: (_block(*cell) for cell in function(_cells(batches, kind, k)))
        return replace(self, blocks=stage(self.blocks.mapInArrow(run, _BLOCKS), "tree-rows"))

    def collected(self, limit: int) -> Binned:
        """The cells as a list, if they have no more than ``limit`` bytes."""
        size = F.sum(F.length("bins") + F.length("target"))
        if isinstance(self.blocks, list) or self.blocks.agg(size).first()[0] > limit:
            return self
        batches = sorted(self.blocks.toArrow().to_batches(max_chunksize=1), key=lambda b: b.column(0)[0].as_py())
        self.discard()
        return replace(self, blocks=list(_cells(batches, self.kind, len(self.splits))))

    def discard(self) -> None:
        if not isinstance(self.blocks, list):
            discard(self.blocks)


def binned(rows: DataFrame, features: Column, label: str, size: int, parts: int, max_bins: int, seed: int) -> Binned:
    """Cells of the ``size`` rows in ``parts`` partitions, to be discarded after use; ``features`` is an array.

    Thresholds come from as many rows as Spark's growers take (``max_bins`` squared, 10,000 at least).
    """
    wanted = max(max_bins**2, 10_000)
    cells = rows.select(features.alias("x"), F.col(label).cast("double").alias("y"))
    seen = cells.select("x") if size <= wanted else cells.select("x").sample(False, wanted / size, seed)
    seen = np.array([r["x"] for r in seen.collect()], dtype=float)
    if not seen.size:
        raise ValueError("no rows to fit")
    data = Binned([], [thresholds(column, min(max_bins, size) - 1) for column in seen.T], size, parts)
    splits, kind, k = data.splits, data.kind, len(data.splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if not (np.isfinite(x).all() and np.isfinite(y).all()):
                raise ValueError("features and label must be finite")
            for at in range(0, len(y), BLOCK_ROWS):
                part = x[at : at + BLOCK_ROWS]
                bins = np.stack([np.searchsorted(s, part[:, i]).astype(kind) for i, s in enumerate(splits)])
                yield _block(number, bins, y[at : at + BLOCK_ROWS])
                number += 1

    return replace(data, blocks=stage(cells.mapInArrow(run, _BLOCKS), "tree-rows")).collected(LOCAL_ROWS)


def _block(number: int, bins: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int64()), pa.array([bins.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "bins", "target"])


def _cells(batches: Iterator[pa.RecordBatch], kind: str, k: int) -> Iterator[_Cell]:
    for batch in batches:
        for number, bins, target in zip(*(batch.column(i) for i in range(3))):
            cells = np.frombuffer(bins.as_buffer(), kind).reshape(k, -1)
            labels = np.frombuffer(target.as_buffer(), "f8")
            yield number.as_py(), cells, labels if labels.size == cells.shape[1] else labels.reshape(3, -1)


def _merged(codes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups (rows, mean, sum of squares around it) of equal codes put together, in the codes' order."""
    order = np.argsort(codes, kind="stable")
    codes, (n, mean, around) = codes[order], groups[:, order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    rows = np.add.reduceat(n, first)
    middle = np.add.reduceat(n * mean, first) / rows
    off = mean - np.repeat(middle, np.diff(np.r_[first, len(codes)]))
    return codes[first], np.stack([rows, middle, np.add.reduceat(around + n * off * off, first)])


def _coded(cells: Iterator[_Cell], shape: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of up to ``GROUP_ROWS`` rows at a time, with the number of the first cell."""
    first, codes, labels, size = 0, [], [], 0
    for number, bins, y in cells:
        first = first if codes else number
        codes.append(np.ravel_multi_index(tuple(bins), shape))
        labels.append(y)
        size += len(y)
        if size >= GROUP_ROWS:
            y = np.concatenate(labels)
            yield first, *_merged(np.concatenate(codes), np.stack([np.ones(size), y, np.zeros(size)]))
            codes, labels, size = [], [], 0
    if codes:
        y = np.concatenate(labels)
        yield first, *_merged(np.concatenate(codes), np.stack([np.ones(size), y, np.zeros(size)]))


def _uncoded(number: int, codes: np.ndarray, groups: np.ndarray, shape: tuple[int, ...], kind: str) -> Iterator[_Cell]:
    for i, at in enumerate(range(0, len(codes), BLOCK_ROWS)):
        bins = np.stack(np.unravel_index(codes[at : at + BLOCK_ROWS], shape)).astype(kind)
        yield number + i, bins, np.ascontiguousarray(groups[:, at : at + BLOCK_ROWS])


def grouped(data: Binned) -> Binned:
    """The rows as groups of equal bins, dealt by a hash of them; as they are if bins do not fit a 64-bit code."""
    shape, kind, k = tuple(len(s) + 1 for s in data.splits), data.kind, len(data.splits)
    if math.prod(shape) >= 2**63:
        return data
    if isinstance(data.blocks, list):
        _, codes, groups = zip(*_coded(iter(data.blocks), shape))
        return replace(data, blocks=list(_uncoded(0, *_merged(np.concatenate(codes), np.concatenate(groups, axis=1)), shape, kind)))
    buckets = data.parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, codes, groups in _coded(_cells(batches, kind, k), shape):
            mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                mine = order[ends[b] : ends[b + 1]]
                if len(mine):
                    yield _sent(b, number, codes[mine], groups[:, mine])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, groups = [], []
        for batch in batches:
            codes += [np.frombuffer(c.as_buffer(), np.int64) for c in batch.column(2)]
            groups += [np.frombuffer(g.as_buffer(), "f8").reshape(3, -1) for g in batch.column(3)]
        if codes:
            whole = _merged(np.concatenate(codes), np.concatenate(groups, axis=1))
            for cell in _uncoded(TaskContext.get().partitionId() << 32, *whole, shape, kind):
                yield _block(*cell)

    sent = data.blocks.mapInArrow(deal, "bucket int, block long, codes binary, groups binary")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    return replace(data, blocks=stage(dealt.mapInArrow(merge, _BLOCKS), "tree-groups")).collected(LOCAL_GROUPS)


def _sent(bucket: int, number: int, codes: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([bucket], pa.int32()), pa.array([number], pa.int64()), pa.array([codes.tobytes()], pa.binary()), pa.array([groups.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "codes", "groups"])


@dataclass
class Tree:
    """Nodes in the order they were made. ``stats`` has rows, sum and sum of squares of the label."""

    feature: list[int] = field(default_factory=list)
    split: list[int] = field(default_factory=list)
    kids: list[tuple[int, int]] = field(default_factory=list)
    stats: list[np.ndarray] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    depth: int = 0

    def add(self, stats: np.ndarray | None) -> int:
        at = len(self.feature)
        self.feature.append(0)
        self.split.append(2**16)  # no bin is larger: rows stay
        self.kids.append((at, at))
        self.stats.append(stats)
        self.gain.append(0.0)
        return at

    def leaf(self, node: int) -> bool:
        return self.kids[node][0] == node

    def values(self) -> np.ndarray:
        """The prediction of every node."""
        return np.array([s[1] / s[0] for s in self.stats])

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        return np.array(self.feature, np.intp), np.array(self.split, np.int32), np.array(self.kids, np.intp).ravel(), self.depth


def _walk(table: tuple[np.ndarray, np.ndarray, np.ndarray, int], bins: np.ndarray) -> np.ndarray:
    """The node each row has reached."""
    feature, split, kids, depth = table
    n = bins.shape[1]
    node, flat, row = np.zeros(n, np.intp), bins.ravel(), np.arange(n)
    for level in range(depth):
        if level:
            right = flat[feature[node] * n + row] > split[node]
        else:
            right = bins[feature[0]] > split[0]
        node = kids[2 * node + right]
    return node


def _poisson_cuts(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Where 32 random bits pass from one Poisson count to the next, and the counts by the first 16 bits."""
    cuts, chance, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += chance
        cut = round(total * 2**32)
        if cut >= 2**32 or (cuts and cut == cuts[-1] and k > rate):
            cuts = np.array(cuts, np.uint32)
            return cuts, _prefixes(cuts)
        cuts.append(cut)
        k += 1
        chance *= rate / k


def _prefixes(cuts: np.ndarray) -> np.ndarray:
    """The count that 16 leading random bits settle; 255 where it depends on the others."""
    low = np.arange(2**16, dtype=np.uint32) << np.uint32(16)
    counts = [np.searchsorted(cuts, bits, side="right") for bits in (low, low + np.uint32(2**16 - 1))]
    return np.where((counts[0] == counts[1]) & (counts[0] < 255), counts[0], 255).astype(np.uint8)


def _draws(cuts: np.ndarray, settled: np.ndarray, seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in a tree's bootstrap sample; the same in every pass."""
    key = np.random.SeedSequence([seed % 2**64, tree, block])
    bits = np.random.SFC64(key).random_raw(n // 2 + 1).view(np.uint32)[:n]
    counts = settled[bits >> np.uint32(16)]
    rest = np.flatnonzero(counts == 255)
    if len(rest):
        counts = counts if len(cuts) < 255 else counts.astype(np.int32)
        counts[rest] = np.searchsorted(cuts, bits[rest], side="right")
    return counts


@dataclass(frozen=True)
class _Pass:
    """What one pass over the cells adds up: per tree a table, the slot of every node, and the features of every slot."""

    trees: list[tuple[int, tuple, np.ndarray, np.ndarray | None]]
    slots: int
    chosen: int
    width: int
    seed: int
    cuts: tuple[np.ndarray, np.ndarray] | None

    def add(self, total: np.ndarray, block: int, bins: np.ndarray, target: np.ndarray) -> None:
        """Add a block to ``total``: slots x features x bins x (rows, sum, sum of squares)."""
        n, flat, every = bins.shape[1], bins.ravel(), np.arange(bins.shape[1])
        once = (None, target, target * target)
        if target.ndim == 2:
            rows, mean, around = target
            once = rows, rows * mean, around + rows * mean * mean
        for tree, table, slot_of, features in self.trees:
            slot = slot_of[_walk(table, bins)]
            low, high = slot_of[slot_of >= 0].min(), slot_of.max() + 1
            inside, sums, at = slot >= 0, once, every
            if self.cuts is not None:
                weight = _draws(*self.cuts, self.seed, tree, block, n)
                inside &= weight > 0
            if not inside.all():
                at = np.flatnonzero(inside)
                slot = slot[at]
                sums = tuple(w if w is None else w[at] for w in once)
            if self.cuts is not None:
                weight = weight[at].astype(float)
                sums = weight, weight * sums[1], weight * sums[2]
            base, size = (slot - low) * self.width, (high - low) * self.width
            for j in range(self.chosen):
                if features is None:
                    values = bins[j] if at is every else bins[j][at]
                elif high - low == 1:
                    values = bins[features[low, j]][at]
                else:
                    values = flat[(features[:, j] * n)[slot] + at]
                place = base + values
                for i, w in enumerate(sums):
                    total[low:high, j, :, i] += np.bincount(place, w, size).reshape(-1, self.width)


def _histograms(data: Binned, run: _Pass) -> np.ndarray:
    """One pass over all cells. The order of additions depends on the partitions alone."""
    kind, k, shape = data.kind, len(data.splits), (run.slots, run.chosen, run.width, 3)
    if isinstance(data.blocks, list):
        total = np.zeros(shape)
        for cell in data.blocks:
            run.add(total, *cell)
        return total

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for number, bins, target in _cells(batches, kind, k):
            run.add(total, number, bins, target)
        yield _partial(TaskContext.get().partitionId(), total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(shape), None
        for batch in batches:
            for part, sums in zip(batch.column(0), batch.column(1)):
                first = part.as_py() if first is None else first
                total += np.frombuffer(sums.as_buffer(), "f8").reshape(shape)
        if first is not None:
            yield _partial(first, total)

    parts = data.blocks.mapInArrow(count, "part int, sums binary")
    if data.parts > DIRECT_PARTS:
        groups = math.isqrt(data.parts)
        parts = parts.repartition(groups, F.col("part") % groups).sortWithinPartitions("part").mapInArrow(merge, "part int, sums binary")
    total = np.zeros(shape)
    for row in sorted(parts.collect()):
        total += np.frombuffer(row["sums"], "f8").reshape(shape)
    return total


def _partial(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def _variance(stats: np.ndarray) -> np.ndarray:
    n = np.where(stats[..., 0] > 0, stats[..., 0], 1.0)
    return np.where(stats[..., 0] > 0, (stats[..., 2] - stats[..., 1] ** 2 / n) / n, 0.0)


def _best(sums: np.ndarray, stats: np.ndarray, sizes: np.ndarray, least: tuple[float, float, float]) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """Gain, place among the features, bin, and both sides' stats of a node's first best split."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = stats - left
    share = left[..., 0] / stats[0], right[..., 0] / stats[0]
    gain = _variance(stats) - share[0] * _variance(left) - share[1] * _variance(right)
    rows, weight, information = least
    smaller = np.minimum(left[..., 0], right[..., 0])
    valid = (np.arange(left.shape[1]) < sizes[:, None]) & (smaller >= max(rows, weight)) & (gain >= information)
    gain = np.where(valid, gain, -math.inf)
    if not gain.size:
        return -math.inf, 0, 0, stats, stats
    j, at = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[j, at]), int(j), int(at), left[j, at], right[j, at]


def _grow(data: Binned, estimator: Estimator, trees: int, chosen: int, seed: int, rate: float | None) -> list[Tree]:
    """All trees level by level, on bootstrap samples of ``rate`` of the rows, if given; a pass takes the open nodes of all trees, as far as memory allows."""
    value, k = estimator.getOrDefault, len(data.splits)
    least = value("minInstancesPerNode"), value("minWeightFractionPerNode") * data.rows, value("minInfoGain")
    cuts = None if rate is None else _poisson_cuts(rate)
    grown = [Tree() for _ in range(trees)]
    sizes = np.array([len(s) for s in data.splits])
    open_nodes = [(t, tree.add(None)) for t, tree in enumerate(grown)]
    at_once = max(1, value("maxMemoryInMB") * 2**20 // (chosen * data.width * 24))
    random = np.random.default_rng([seed % 2**64, trees])
    for level in range(value("maxDepth") + 1):
        following = []
        for start in range(0, len(open_nodes), at_once):
            group = open_nodes[start : start + at_once]
            picks = np.array([np.sort(random.permutation(k)[:chosen]) for _ in group])
            spec = []
            for t in sorted({t for t, _ in group}):
                slot_of = np.full(len(grown[t].feature), -1, np.intp)
                for slot, (tree, node) in enumerate(group):
                    if tree == t:
                        slot_of[node] = slot
                spec.append((t, grown[t].table(), slot_of, picks if chosen < k else None))
            total = _histograms(data, _Pass(spec, len(group), chosen, data.width, seed, cuts))
            for slot, (t, node) in enumerate(group):
                tree = grown[t]
                if tree.stats[node] is None:
                    tree.stats[node] = total[slot, 0].sum(axis=0)
                if level == value("maxDepth") or not tree.stats[node][0]:
                    continue
                gain, j, at, *sides = _best(total[slot], tree.stats[node], sizes[picks[slot]], least)
                if gain <= 0:
                    continue
                tree.feature[node], tree.split[node], tree.gain[node] = int(picks[slot, j]), at, gain
                tree.kids[node] = tree.add(sides[0]), tree.add(sides[1])
                if level + 1 < value("maxDepth"):
                    following += [(t, c) for c in tree.kids[node] if abs(_variance(tree.stats[c])) >= sys.float_info.epsilon]
        for tree in grown:
            tree.depth = level + 1
        open_nodes = following
        if not open_nodes:
            break
    for tree in grown:
        if not tree.stats[0][0]:  # an empty bootstrap sample
            tree.stats[0] = np.array([1.0, 0.0, 0.0])
    return grown


def _chosen(strategy: str, trees: int, k: int) -> int:
    """Features tried per node, by Spark's names of the strategies."""
    named = {"auto": k if trees == 1 else math.ceil(k / 3), "all": k, "onethird": math.ceil(k / 3), "sqrt": math.ceil(math.sqrt(k)), "log2": max(1, math.ceil(math.log2(k)))}
    if strategy in named:
        return named[strategy]
    if strategy.isdigit():
        return min(k, int(strategy))
    return max(1, math.ceil(float(strategy) * k))


def _boost(data: Binned, estimator: GBTRegressor, chosen: int) -> tuple[list[Tree], list[float]]:
    """Each tree fits twice what the trees before it leave of the label, as the gradient of squared errors says."""
    seed = estimator.getOrDefault("seed")
    trees: list[Tree] = []
    weights = [1.0] + [estimator.getStepSize()] * (estimator.getMaxIter() - 1)
    now = grouped(data)
    try:
        for i in range(len(weights)):
            if i:
                before, now = now, now.mapped(_remainder(trees[-1], weights[i - 1], 2.0 if i == 1 else 1.0))
                if before is not data:
                    before.discard()
            trees += _grow(now, estimator, 1, chosen, seed + i, None)
    finally:
        if now is not data:
            now.discard()
    return trees, weights


def _remainder(tree: Tree, weight: float, scale: float) -> Callable[[Iterator[_Cell]], Iterator[_Cell]]:
    table, step = tree.table(), 2 * weight * tree.values()

    def run(cells: Iterator[_Cell]) -> Iterator[_Cell]:
        for number, bins, target in cells:
            off = step[_walk(table, bins)]
            if target.ndim == 1:
                yield number, bins, scale * target - off
            else:
                yield number, bins, np.stack([target[0], scale * target[1] - off, scale**2 * target[2]])

    return run


def _java_tree(spark: SparkSession, tree: Tree, splits: Sequence[np.ndarray]):
    """Spark's model of one tree. Siblings that predict the same are one leaf."""
    jvm = spark._jvm
    inner, leaf, threshold = (getattr(jvm.org.apache.spark.ml.tree, n) for n in ("InternalNode", "LeafNode", "ContinuousSplit"))
    impurity, part = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.java.util.Arrays.copyOfRange
    numbers = np.array(tree.stats).astype(">f8")
    every = spark.sparkContext._gateway.new_array(jvm.double, numbers.size)
    jvm.java.nio.ByteBuffer.wrap(numbers.tobytes()).asDoubleBuffer().get(every)
    values, variances = tree.values().tolist(), _variance(np.array(tree.stats)).tolist()
    made: dict[int, tuple] = {}
    # Children have larger numbers than their parents.
    for node in range(len(values) - 1, -1, -1):
        told = impurity(part(every, 3 * node, 3 * node + 3), int(tree.stats[node][0]))
        made[node] = leaf(values[node], variances[node], told), True
        if not tree.leaf(node):
            (left, is_a), (right, is_b) = (made.pop(c) for c in tree.kids[node])
            a, b = (values[c] for c in tree.kids[node])
            if not (is_a and is_b and a == b):
                f = tree.feature[node]
                split = threshold(f, float(splits[f][tree.split[node]]))
                made[node] = inner(values[node], variances[node], tree.gain[node], left, right, split, told), False
    return jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(f"dtr_{id(tree):x}", made[0][0], len(splits))


def _model(spark: SparkSession, estimator: Estimator, trees: list[Tree], weights: list[float] | None, splits: Sequence[np.ndarray]) -> Model:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    regression = jvm.org.apache.spark.ml.regression
    array = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = _java_tree(spark, tree, splits)
    if weights is None:
        made, kind = regression.RandomForestRegressionModel(estimator.uid, array, len(splits)), RandomForestRegressionModel
    else:
        given = gateway.new_array(jvm.double, len(weights))
        for i, w in enumerate(weights):
            given[i] = w
        made, kind = regression.GBTRegressionModel(estimator.uid, array, given, len(splits)), GBTRegressionModel
    estimator._transfer_params_to_java()
    estimator._java_obj.copyValues(made, jvm.org.apache.spark.ml.param.ParamMap())
    return estimator._copyValues(kind(made))


def fit(spark: SparkSession, estimator: Estimator, data: Binned) -> Model:
    """The model ``estimator.fit`` makes of these rows, but for the forest's random draws."""
    value, k = estimator.getOrDefault, len(data.splits)
    boosted = isinstance(estimator, GBTRegressor)
    count = 1 if boosted else estimator.getNumTrees()
    chosen = _chosen(value("featureSubsetStrategy"), count, k)
    if boosted:
        trees, weights = _boost(data, estimator, chosen)
        return _model(spark, estimator, trees, weights, data.splits)
    rate = value("subsamplingRate") if value("bootstrap") else None
    return _model(spark, estimator, _grow(data, estimator, count, chosen, value("seed"), rate), None, data.splits)
