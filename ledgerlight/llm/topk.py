"""Exact top-k search with block-at-a-time pruning.

Vectors become whole numbers. A vector's terms are its non-zero components, those of opposite sign
counting as different terms, and a block is a range of consecutive IDs with a forward index (its
vectors) and the largest weight of each term. For a query, the sum of its weights times the block's
term maxima bounds every score in the block. Blocks are scored in descending order of that bound
until it falls below the query's k-th best score so far.

The maxima are a small table next to the blocks, and bounds hold across all blocks:

1.  Every query meets the maxima of all blocks, and scores the block with the highest bound. The
    k-th best score in there is its floor.
2.  Queries meet the maxima again. A block is sent only to those groups of queries of which one has
    a bound that reaches its floor.
3.  A task searches one group of queries in one slice of consecutive blocks, beginning from the
    floors, and returns the best k of the slice.

Groups of queries, chunks of maxima and slices are of stated size, and none is listed on the driver.
Every query meets the maxima of every block, because the queries are a stated set; what is scored
beyond is what the bounds leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlight.llm import scratch

BLOCK_ROWS = 128
SLICE_BLOCKS = 32
#: Queries stored together, and pieces of that size that one task holds on average.
PIECE_ROWS = 512
GROUP_PIECES = 8
#: Blocks whose maxima one task holds on average.
CHUNK_BLOCKS = 4096
#: Tasks over which a piece's first blocks are dealt.
FIRST_PARTS = 8


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null for null, NaN and infinite ones."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))


def term_bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each term the largest weight: of positive components, and of negative ones their least."""
    return np.maximum(rows.max(axis=0), 0), np.minimum(rows.min(axis=0), 0)


def exact_dtype(*parts: np.ndarray) -> type:
    """float64 where all sums of products stay below 2**53, Python numbers beyond."""
    width = max((p.shape[1] for p in parts), default=0)
    sizes = [max((abs(int(p.max())), abs(int(p.min())))) if p.size else 0 for p in parts]
    return np.float64 if width * sizes[0] * sizes[-1] < 2**53 else object


def block_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """queries x blocks: the most that a row of the block can score, exactly."""
    kind = exact_dtype(queries, np.vstack([high, low]))
    q = queries.astype(kind)
    return np.maximum(q, 0) @ high.T.astype(kind) + np.minimum(q, 0) @ low.T.astype(kind)


def search_blocks(
    queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, floors: list[int | None] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, ID, score) of each query's k best rows, and how many (query, block) pairs were scored.

    ``floors`` are scores that each query's k-th best row is known to reach. A block is skipped only
    if its bound is below the floor or the k-th score, so ties reach the smaller ID.
    """
    kind = exact_dtype(queries, *([np.vstack([b[1] for b in blocks])] if blocks else []))
    q = queries.astype(kind)
    limits = [term_bounds(rows) for _, rows in blocks]
    bounds = block_bounds(queries, np.array([h for h, _ in limits]), np.array([x for _, x in limits])).astype(kind) if blocks else np.empty((len(q), 0), kind)
    order = np.argsort(-bounds, axis=1, kind="stable")
    lowest = -(2**62) if kind is object else -np.inf
    floor = np.array([lowest if f is None else f for f in floors], kind) if floors is not None else np.full(len(q), lowest, kind)
    best_score = np.full((len(q), 0), lowest, kind)
    best_id = np.zeros((len(q), 0), np.int64)
    alive, scored = np.arange(len(q)), 0
    for step in range(len(blocks)):
        kth = np.maximum(best_score[:, k - 1], floor) if best_score.shape[1] >= k else floor
        alive = alive[bounds[alive, order[alive, step]] >= kth[alive]]
        if not len(alive):
            break
        add_score = np.full((len(q), max(len(b[0]) for b in blocks)), lowest, kind)
        add_id = np.full(add_score.shape, np.iinfo(np.int64).max, np.int64)
        for j in np.unique(order[alive, step]):
            ids, rows = blocks[j]
            mine = alive[order[alive, step] == j]
            s = q[mine] @ rows.T.astype(kind)
            s[ids[None, :] == query_ids[mine][:, None]] = lowest
            add_score[mine, : len(ids)], add_id[mine, : len(ids)] = s, ids
            scored += len(mine)
        score, ident = np.hstack([best_score[alive], add_score[alive]]), np.hstack([best_id[alive], add_id[alive]])
        ident = np.where(score == lowest, np.iinfo(np.int64).max, ident)
        pick = np.lexsort((ident, -score), axis=1)[:, :k]
        width = pick.shape[1]
        if best_score.shape[1] < width:
            best_score = np.hstack([best_score, np.full((len(q), width - best_score.shape[1]), lowest, kind)])
            best_id = np.hstack([best_id, np.full((len(q), width - best_id.shape[1]), np.iinfo(np.int64).max, np.int64)])
        best_score[alive], best_id[alive] = np.take_along_axis(score, pick, 1), np.take_along_axis(ident, pick, 1)
    at, place = np.nonzero(best_id != np.iinfo(np.int64).max)
    return at, best_id[at, place], best_score[at, place].astype(np.int64), scored


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Runs of at most ``size`` rows of each partition's ID order, stored: (part, block, n, width, ids, cells, limits)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def out() -> pa.RecordBatch:
            width = max(map(len, vectors))
            cells = np.zeros((len(vectors), width), np.int64)
            for i, v in enumerate(vectors):
                cells[i, : len(v)] = v
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "width": pa.array([width], pa.int32()),
                 "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "cells": pa.array([cells.tobytes()], pa.binary()), "limits": pa.array([np.concatenate(term_bounds(cells)).tobytes()], pa.binary())}
            )

        for batch in batches:
            for ident, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
                ids.append(ident)
                vectors.append(vector)
                if len(ids) == size:
                    yield out()
                    block, ids, vectors = block + 1, [], []
        if ids:
            yield out()

    return scratch.keep(rows.mapInArrow(pack, "part int, block int, n int, width int, ids binary, cells binary, limits binary"), name)


def _matrix(cells: list[bytes], sizes: list[int], widths: list[int], width: int) -> list[np.ndarray]:
    """Stored rows of whole numbers, ``sizes`` of them each, widened with zeros."""
    found = [np.frombuffer(c, np.int64).reshape(n, w) for c, n, w in zip(cells, sizes, widths)]
    return [np.pad(f, ((0, 0), (0, width - f.shape[1]))) for f in found]


class Asked:
    """The queries of some pieces: their vectors, IDs, floors, and where each lies."""

    def __init__(self, pieces: pd.DataFrame, width: int):
        pieces = pieces.sort_values(["part", "block"])
        self.part, self.block = (np.repeat(pieces[c].to_numpy(), pieces["n"]) for c in ("part", "block"))
        self.at = np.concatenate([np.arange(n) for n in pieces["n"]])
        self.ids = np.concatenate([np.frombuffer(i, np.int64) for i in pieces["ids"]])
        self.cells = np.vstack(_matrix(pieces["cells"], pieces["n"], pieces["width"], width))
        self.floors: list[int | None] = [None] * len(self.ids)
        if "floors" in pieces:
            starts = np.cumsum(pieces["n"].to_numpy()) - pieces["n"].to_numpy()
            for start, known in zip(starts.tolist(), pieces["floors"]):
                for f in known if known is not None else ():
                    self.floors[start + f["at"]] = f["floor"]


def _widest(*frames: pd.DataFrame) -> int:
    return int(max(f["width"].max() for f in frames))


def _limits(summaries: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.stack(_matrix(summaries["limits"], [2] * len(summaries), summaries["width"], width))
    return both[:, 0], both[:, 1]


def _first_blocks(pieces: pd.DataFrame, summaries: pd.DataFrame) -> pd.DataFrame:
    """Each query's block of the highest bound in a chunk."""
    if not len(pieces) or not len(summaries):
        return pd.DataFrame({"part": [], "block": [], "at": [], "bound": [], "d_part": [], "d_block": []})
    width = _widest(pieces, summaries)
    asked = Asked(pieces, width)
    bounds = block_bounds(asked.cells, *_limits(summaries, width)).astype(np.float64)
    best = bounds.argmax(axis=1)
    return pd.DataFrame(
        {"part": asked.part, "block": asked.block, "at": asked.at, "bound": bounds[np.arange(len(best)), best],
         "d_part": summaries["part"].to_numpy()[best], "d_block": summaries["block"].to_numpy()[best]}
    )


def _live_blocks(pieces: pd.DataFrame, summaries: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a chunk in which a query of the group can still find one of its k best."""
    if not len(pieces) or not len(summaries):
        return pd.DataFrame({"asker": [], "part": [], "block": []})
    width = _widest(pieces, summaries)
    asked = Asked(pieces, width)
    bounds = block_bounds(asked.cells, *_limits(summaries, width))
    known = np.array([f is not None for f in asked.floors])
    floors = np.array([f or 0 for f in asked.floors], np.int64).astype(bounds.dtype)
    live = ((bounds >= floors[:, None]) | ~known[:, None]).any(axis=0)
    return pd.DataFrame({"asker": pieces["asker"].iloc[0], "part": summaries["part"].to_numpy()[live], "block": summaries["block"].to_numpy()[live]})


def _floors(pieces: DataFrame, summaries: DataFrame, docs: DataFrame, n_askers: int, n_chunks: int, k: int) -> DataFrame:
    """(part, block, floors) of each piece with a floor: the k-th best score in the query's first block."""
    left = pieces.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).drop("limits")
    right = summaries.withColumn("asker", F.explode(F.sequence(F.lit(0), F.lit(n_askers - 1))))
    met = left.groupBy("asker", "chunk").cogroup(right.groupBy("asker", "chunk")).applyInPandas(_first_blocks, "part int, block int, at int, bound double, d_part int, d_block int")
    first = met.groupBy("part", "block", "at").agg(F.max(F.struct("bound", "d_part", "d_block")).alias("b"))
    wanted = scratch.keep(first.groupBy("part", "block", F.col("b.d_part").alias("d_part"), F.col("b.d_block").alias("d_block")).agg(F.sort_array(F.collect_list("at")).alias("asks")), "first-blocks")
    deal = F.pmod(F.xxhash64("d_part", "d_block"), F.lit(FIRST_PARTS)).cast("int")
    held = docs.select(F.col("part").alias("d_part"), F.col("block").alias("d_block"), F.col("ids").alias("d_ids"), F.col("n").alias("d_n"), F.col("width").alias("d_width"), F.col("cells").alias("d_cells"))
    blocks = wanted.join(held, ["d_part", "d_block"]).withColumn("deal", deal)
    mine = pieces.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(FIRST_PARTS - 1)))).drop("limits")

    def score(piece: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        part, block, at, floor = [], [], [], []
        if len(piece) and len(blocks):
            width = max(_widest(piece), int(blocks["d_width"].max()))
            asked = Asked(piece, width)
            rows = _matrix(blocks["d_cells"], blocks["d_n"], blocks["d_width"], width)
            for ids, cells, asks in zip(blocks["d_ids"], rows, blocks["asks"]):
                asks = np.asarray(asks, np.int64)
                found = search_blocks(asked.cells[asks], asked.ids[asks], [(np.frombuffer(ids, np.int64), cells)], k)
                times = np.bincount(found[0], minlength=len(asks))
                least = np.full(len(asks), np.iinfo(np.int64).max)
                np.minimum.at(least, found[0], found[2])
                full = times >= k
                at += asks[full].tolist()
                floor += least[full].tolist()
            part, block = [int(piece["part"].iloc[0])] * len(at), [int(piece["block"].iloc[0])] * len(at)
        return pd.DataFrame({"part": part, "block": block, "at": at, "floor": floor})

    keys = ["part", "block", "deal"]
    known = mine.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(score, "part int, block int, at int, floor long")
    return scratch.keep(known.groupBy("part", "block").agg(F.collect_list(F.struct("at", "floor")).alias("floors")), "floors")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose ID ``every`` divides.

    A row is never its own answer; ties go to the smaller ID. Rows with a null ID, vector or
    component, or an infinite one, take no part. A shorter vector lacks the terms it does not have.
    Repeated IDs are separate rows, none of which answers a query of that ID.
    """
    rows = scratch.keep(
        vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), whole_numbers(F.col(embedding), scale).alias("cells")).where("vec_id is not null and cells is not null"), "vectors"
    )
    total, n_asked = rows.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    parts, groups = (max(1, -(-n // size)) for n, size in ((total, BLOCK_ROWS * SLICE_BLOCKS), (n_asked, PIECE_ROWS * GROUP_PIECES)))
    docs = _packed(rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id"), BLOCK_ROWS, "blocks")
    pieces = _packed(asked.repartitionByRange(groups, "vec_id").sortWithinPartitions("vec_id"), PIECE_ROWS, "queries")
    # Groups and chunks are dealt by hash, so that their labels are plain numbers on both sides.
    n_chunks, n_askers = (max(1, -(-t.count() // size)) for t, size in ((docs, CHUNK_BLOCKS), (pieces, GROUP_PIECES)))
    dealt = lambda n: F.pmod(F.xxhash64("part", "block"), F.lit(n)).cast("int")
    pieces = pieces.withColumn("asker", dealt(n_askers))
    summaries = docs.select("part", "block", "width", "limits", dealt(n_chunks).alias("chunk"))
    known = pieces.drop("limits").join(_floors(pieces, summaries, docs, n_askers, n_chunks, k), ["part", "block"], "left")
    known = scratch.keep(known, "asked")
    left = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    right = summaries.withColumn("asker", F.explode(F.sequence(F.lit(0), F.lit(n_askers - 1))))
    met = left.groupBy("asker", "chunk").cogroup(right.groupBy("asker", "chunk")).applyInPandas(_live_blocks, "asker int, part int, block int")
    live = scratch.keep(met.withColumn("slice", F.floor(F.col("block") / SLICE_BLOCKS).cast("int")), "live-blocks")
    tasks = live.select(F.col("asker").alias("to"), F.col("part").alias("d_part"), F.col("slice").alias("d_slice")).distinct()
    sent = docs.drop("limits").join(live, ["part", "block"])

    def search(pieces: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(pieces) or not len(blocks):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        width = _widest(pieces, blocks)
        asked, blocks = Asked(pieces, width), blocks.sort_values("block")
        held = [(np.frombuffer(i, np.int64), c) for i, c in zip(blocks["ids"], _matrix(blocks["cells"], blocks["n"], blocks["width"], width))]
        at, found, score, _ = search_blocks(asked.cells, asked.ids, held, k, asked.floors)
        return pd.DataFrame({"query_id": asked.ids[at], "vec_id": found, "score": score})

    left = known.join(tasks, F.col("asker") == F.col("to")).groupBy("to", "d_part", "d_slice")
    found = left.cogroup(sent.groupBy("asker", "part", "slice")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
