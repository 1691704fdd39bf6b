"""Product-quantised vector codes, trained exactly on whole numbers.

Every vector is cut into equal parts, and every part position has its own small codebook. Training
is exact: components are whole numbers, and each round replaces an entry by the floor of the mean of
the parts that are nearest to it.

The parts of one position are sorted along a Hilbert curve and stored as flat blocks of
neighbouring parts, each with the box that encloses them and with their sums. In a round the
distances from an entry to the nearest and to the farthest corner of a box tell which entries can be
nearest to any part of the block. If a single one is left, the stored sums stand for the whole
block; otherwise a small integer kernel evaluates the block's parts against that shortlist. Blocks
are dealt by range, with the row as the last key, so copies of one vector spread over partitions. A
task returns one partial sum per entry, and the driver sees only the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import scratch, worker
from ledgerlight.llm.arrow_text import slices
from ledgerlight.llm.packing import hilbert_keys

#: Parts per flat block.
BLOCK_ROWS = 128
#: Bytes of blocks that one partition holds.
PARTITION_BYTES = 64 << 20
#: Coordinates of the curve; longer parts are averaged to as many.
CURVE_DIMENSIONS = 8
CURVE_BITS = 7
#: Whole-number components must be smaller, so that distances fit 64 bits.
LARGEST = 1 << 26
#: Bytes of parts that one numpy step works on.
STEP_BYTES = 4 << 20


@dataclass
class Codes:
    """``rows``: (vec_id, label, code, error, label_error); ``codebooks``: parts x entries x width."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """True for a vector whose components are all there and finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def curve_keys(parts: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hilbert position of each part (n x width), its coordinates scaled from low..high."""
    width = parts.shape[1]
    if not width or high <= low:
        return np.zeros(len(parts), np.int64)
    edges = np.linspace(0, width, min(width, CURVE_DIMENSIONS) + 1).astype(int)
    means = np.stack([parts[:, a:b].mean(axis=1) for a, b in zip(edges, edges[1:])], axis=1)
    top = (1 << CURVE_BITS) - 1
    return hilbert_keys(np.clip((means - low) * (top / (high - low)), 0, top).astype(np.int64), CURVE_BITS)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """blocks x entries: whether the entry can be nearest to a point of the box low..high."""
    below, above = low[:, None, :] - book[None], book[None] - high[:, None, :]
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1)[:, None]


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry per point (the lower one of equals) and the squared distance."""
    gap = (book * book).sum(axis=1)[None] - 2 * (points @ book.T)
    index = gap.argmin(axis=1)
    return index, gap[np.arange(len(points)), index] + (points * points).sum(axis=1)


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bytes]]]:
    """Per part position of a batch: it, block sizes, low, high, sums, and the points and rows as bytes."""
    part = batch.column("part").to_numpy()
    matrix = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, width).astype(np.int64)
    size, low, high, total = batch.column("n").to_numpy(), matrix("low", "<i4"), matrix("high", "<i4"), matrix("total", "<i8")
    points, rows = batch.column("points").to_pylist(), batch.column("rows").to_pylist()
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield int(p), size[at], low[at], high[at], total[at], [points[i] for i in at], [rows[i] for i in at]


def _kernels(size: np.ndarray, possible: np.ndarray, points: list[bytes], book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of equal shortlist together: (blocks, their points, index, distance)."""
    mask = (possible * (1 << np.arange(possible.shape[1], dtype=np.int64))).sum(axis=1)
    for m in np.unique(mask):
        at = np.flatnonzero(mask == m)
        entries = np.flatnonzero(possible[at[0]])
        flat = np.frombuffer(b"".join([points[i] for i in at]), "<i4").reshape(int(size[at].sum()), -1).astype(np.int64)
        index, distance = nearest(flat, book[entries])
        yield at, flat, entries[index], distance


def _stored_blocks(kept: DataFrame, parts: int, width: int, low: int, high: int, partitions: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("vector-codes")
        for batch in batches:
            step = max(1, STEP_BYTES // (8 * parts * max(width, 1)))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                v = some.column("v").flatten().to_numpy().reshape(some.num_rows, parts, width)
                for p in range(parts):
                    mine = np.ascontiguousarray(v[:, p], "<i4")
                    cells = [mine[i].tobytes() for i in range(len(mine))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), p, np.int32)), pa.array(curve_keys(mine, low, high)), some.column("row"), pa.array(cells, pa.binary())], names=["part", "key", "row", "point"]
                    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("vector-codes")
        names = ["part", "n", "low", "high", "total", "points", "rows"]

        def block(p: int, cells: list[bytes], rows: list[int]) -> tuple:
            flat = np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), width)
            return p, len(cells), flat.min(axis=0).tobytes(), flat.max(axis=0).tobytes(), flat.sum(axis=0, dtype="<i8").tobytes(), flat.tobytes(), np.array(rows, "<i8").tobytes()

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        part, cells, rows, done = None, [], [], []
        for batch in batches:
            for p, row, cell in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "point"))):
                if cells and (p != part or len(cells) == BLOCK_ROWS):
                    done.append(block(part, cells, rows))
                    cells, rows = [], []
                    if len(done) == 256:
                        yield batch_of(done)
                        done = []
                part = p
                cells.append(cell)
                rows.append(row)
        if cells:
            done.append(block(part, cells, rows))
        if done:
            yield batch_of(done)

    dealt = kept.select("row", "v").mapInArrow(cut, "part int, key long, row long, point binary").repartitionByRange(partitions, "part", "key", "row").sortWithinPartitions("part", "key", "row")
    return scratch.keep(dealt.mapInArrow(build, "part int, n int, low binary, high binary, total binary, points binary, rows binary"), "code-blocks")


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("vector-codes")
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for some in slices(batch, "points", STEP_BYTES):
                for p, size, low, high, total, points, _ in _blocks(some, width):
                    possible = shortlists(low, high, books[p])
                    settled = possible.sum(axis=1) == 1
                    only = possible.argmax(axis=1)[settled]
                    np.add.at(sums[p], only, total[settled])
                    np.add.at(counts[p], only, size[settled])
                    open_ = np.flatnonzero(~settled)
                    for _, flat, index, _ in _kernels(size[open_], possible[open_], [points[i] for i in open_], books[p]):
                        for e in np.unique(index):
                            mine = index == e
                            sums[p, e] += flat[mine].sum(axis=0)
                            counts[p, e] += int(mine.sum())
        p, e = np.nonzero(counts)
        lists = pa.array([np.r_[counts[a, b], sums[a, b]].tolist() for a, b in zip(p, e)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), lists], names=["part", "entry", "sums"])

    partial = blocks.mapInArrow(assign, "part int, entry int, sums array<long>").select("part", "entry", F.posexplode("sums").alias("at", "x"))
    new = books.copy()
    used: dict[tuple[int, int], list[int]] = {}
    for r in partial.groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).orderBy("part", "entry", "at").collect():
        used.setdefault((r.part, r.entry), []).append(r.x)
    for (p, e), (count, *total) in used.items():
        new[p, e] = [x // count for x in total]
    return new


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> Codes:
    """Codes of ``parts`` entries for every usable vector, and the codebooks they refer to.

    Rows whose vector is null or holds a null or a component that is not finite are left out. Ids
    and labels may be null or repeated; every row is coded by itself, null labels count as one
    label, and the codebooks start from the smallest ids, null ids last, equal ids by their vector.
    With fewer usable rows than entries there are as many entries as rows; without any, no rows.
    Vectors of unequal length, or of one that ``parts`` does not divide, and components of 2**26 or
    more after scaling are a ValueError. Other columns are ignored. At most 255 entries.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    picked = vectors.where(usable(F.col(vector))).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))
    fits = F.forall("v", lambda x: x.between(-LARGEST + 1, LARGEST - 1))
    kept = scratch.keep(picked.select("row", "vec_id", "label", F.size("v").alias("width"), F.when(fits, F.col("v").cast("array<int>")).alias("v")), "whole-vectors")
    seen = kept.agg(
        F.count("*").alias("n"), F.min("width").alias("least"), F.max("width").alias("most"), F.count_if(F.col("v").isNull()).alias("beyond"),
        F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"),
    ).first()
    if seen.n and (seen.least != seen.most or seen.most % parts):
        raise ValueError(f"vectors must have one length that {parts} divides, found {seen.least} to {seen.most}")
    if seen.beyond:
        raise ValueError(f"{seen.beyond} vectors have components of {LARGEST} or more after scaling")
    width = (seen.most or 0) // parts
    first = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    partitions = max(kept.sparkSession.sparkContext.defaultParallelism, seen.n * parts * (4 * width + 20) // PARTITION_BYTES + 1)
    blocks = _stored_blocks(kept, parts, width, seen.low or 0, seen.high or 0, partitions)
    for _ in range(rounds if seen.n else 0):
        new = _round(blocks, books)
        if np.array_equal(new, books):
            break
        books = new

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("vector-codes")
        for batch in batches:
            for some in slices(batch, "points", STEP_BYTES):
                for p, size, low, high, _, points, rows in _blocks(some, width):
                    for at, _, index, distance in _kernels(size, shortlists(low, high, books[p]), points, books[p]):
                        ids = np.frombuffer(b"".join([rows[i] for i in at]), "<i8")
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), p, np.int32)), pa.array(index.astype(np.int32)), pa.array(distance)], names=["row", "part", "entry", "distance"])

    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda x: F.lpad(F.lower(F.hex(x["entry"])), 2, "0")), "")
    coded = blocks.mapInArrow(code, "row long, part int, entry int, distance long").groupBy("row").agg(digits.alias("code"), F.sum("distance").alias("error"))
    rows = scratch.keep(kept.select("row", "vec_id", "label").join(coded, "row").drop("row"), "vector-codes")
    by_label = scratch.keep(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return Codes(joined.select("vec_id", "label", "code", "error", "label_error"), books)
