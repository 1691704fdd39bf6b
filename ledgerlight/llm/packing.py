"""Packing documents into token sequences along a space-filling curve.

Each document becomes a vector of hashed token counts, projected to three dimensions with signs
that are hashed as well; a Hilbert curve through that space gives a key under which similar
documents are neighbours. Documents are range-sorted by the key, and each partition is cut into
sequences of ``length`` tokens as one stream, so neighbours share a sequence. What is left at the
end of a partition is cut into sequences of power-of-two lengths, which need no padding.

Tokenised documents are stored once before the sort, because choosing the ranges reads the keys a
second time. Documents with equal keys (copies) are told apart by a hash of their ID, so a group of
any size spreads over ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import scratch, tokens, worker
from ledgerlight.llm.arrow_text import slices

DIMENSIONS, BITS = 3, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
PARTITION_TOKENS = 4_000_000


def projection(n_ids: int) -> np.ndarray:
    """Signs (+1, -1) of each token ID in each dimension, from a hash of the ID."""
    x = np.arange(n_ids, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(DIMENSIONS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(x >> np.uint64(63), 1.0, -1.0).astype(np.float32)


def places(flat: np.ndarray, offsets: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each document's point: mean sign per dimension, scaled to whole numbers below 2**BITS."""
    n = np.diff(offsets)
    sums = np.zeros((len(n), DIMENSIONS))
    full = n > 0
    if full.any():
        sums[full] = np.add.reduceat(signs[flat], offsets[:-1][full], axis=0, dtype=np.float64)
    mean = sums / np.maximum(n, 1)[:, None]
    return np.clip((mean + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of whole-number points (n x d, below 2**bits) on the Hilbert curve of their cube.

    Works from the highest bit down (Skilling's transform): undo the rotations of each level, Gray
    decode, then interleave the bits.
    """
    x = points.astype(np.int64).copy()
    d = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(d):
            high = (x[:, i] & level) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(high, below, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[:, d - 1] & level, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> bit & 1)
    return key


def tail_lengths(rest: int) -> list[int]:
    """``rest`` as a sum of different powers of two, the largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, tie, n_tokens, ids): whole texts as IDs and ``end_id``, with their Hilbert key.

    IDs take two bytes each where the vocabulary allows, otherwise four.
    """
    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(doc_id).alias("tie"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("tokens")
        coder = tokens.loaded(tokenizer)
        signs = projection(max(coder.tokenizer.get_vocab_size(), end_id + 1))
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                flat, offsets = coder.ids(part.column("text"))
                key = hilbert_keys(places(flat, offsets, signs))
                n = np.diff(offsets)
                ids = np.insert(flat, offsets[1:], np.array(end_id, coder.dtype))
                ends = np.r_[0, np.cumsum(n + 1)] * ids.itemsize
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key), part.column("tie"), pa.array(n + 1), cells], names=["doc_id", "key", "tie", "n_tokens", "ids"])

    return picked.mapInArrow(run, "doc_id long, key long, tie long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row of ``PIECES`` per piece of a document; a null text is the end ID alone.

    Sequences are full or have a power-of-two length. Sequence IDs are the partition times 2**40
    plus a running number. Repeated rows and null IDs are documents of their own; other columns
    are not read. ``keep_ids=False`` leaves the pieces' IDs out (their CRC stays).
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    stored = scratch.keep(tokenise(docs, tokenizer, end_id, doc_id, text), "tokens")
    total = stored.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // PARTITION_TOKENS))
    ranged = stored.repartitionByRange(parts, "key", "tie", "doc_id").sortWithinPartitions("key", "tie", "doc_id", "n_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        sequence, room = first, length
        held: list[tuple] = []  # the pieces of the sequence being filled

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names=names)

        def piece(doc, data, start, n, tokens_of, at) -> tuple:
            width = len(data) // tokens_of
            ids = np.frombuffer(data, f"<u{width}", n, width * start).astype("<u4").tobytes()
            return doc, start, n, zlib.crc32(ids), tokens_of, sequence, at, ids if keep_ids else None

        done: list[tuple] = []
        for batch in batches:
            for doc, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids")):
                data, start = data.as_py(), 0
                while start < n:
                    take = min(room, n - start)
                    held.append((doc, data, start, take, n, length - room))
                    start, room = start + take, room - take
                    if not room:
                        done += [piece(*p) for p in held]
                        held, room, sequence = [], length, sequence + 1
                if len(done) >= 2_000:
                    yield rows(done)
                    done = []
        # The rest of the partition: the same pieces, cut again into power-of-two sequences.
        sizes = iter(tail_lengths(length - room))
        size = used = 0
        for doc, data, start, n, of, _ in held:
            while n:
                if used == size:
                    sequence, size, used = sequence + bool(size), next(sizes), 0
                take = min(n, size - used)
                done.append(piece(doc, data, start, take, of, used))
                start, n, used = start + take, n - take, used + take
        if done:
            yield rows(done)

    return ranged.select("doc_id", "n_tokens", "ids").mapInArrow(cut, PIECES)
