"""SimHash near-duplicates by fuzzy hashing with the Golay code.

A document's 64-bit fingerprint takes each bit from the majority of its shingles' XXH64 values.
Fingerprints that differ in at most three bits are linked. The 64 bits are three segments of 23, 23
and 18 bits; of three errors at most one segment can hold two or more, so two segments have at most
one error each. Each segment is decoded to nearby codewords of the Golay code: the decoded one is
stored, all within distance four are looked up, which meets every word with one error. A key is a
pair of codewords, 24 bits, so a fingerprint is stored under three keys and looked up under some
eighty.

Only distinct fingerprints take part, copies are joined by their fingerprint. The join verifies the
distance as its condition, so its output is links, not candidates. Both sides are plain shuffles of
stored tables: adaptive execution splits a key that holds very many fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import golay, scratch, worker
from ledgerlight.llm.arrow_text import slices
from ledgerlight.llm.components import connected_components

MAX_BITS = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
SEED = 42
#: Shingles whose bits are counted in one step, so that a long text needs no more memory than its words.
SHINGLES_AT_ONCE = 1 << 17


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """uint64 per text. Words are split at ASCII white space and A-Z lower-cased; shingles count as
    often as they occur; a text with fewer words is one shingle, one without words has fingerprint 0."""
    from xxhash import xxh64_intdigest

    hashes, counts = [np.zeros(0, np.uint64)], []
    for text in texts:
        words = text.encode().lower().split() if text else []
        if len(words) <= shingle:
            if words:
                hashes.append(np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
            counts.append(min(len(words), 1))
            continue
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start, n = end - size + 1, len(words) - shingle + 1
        for at in range(0, n, SHINGLES_AT_ONCE):
            a, b = start[at : min(at + SHINGLES_AT_ONCE, n)].tolist(), end[at + shingle - 1 :][:SHINGLES_AT_ONCE].tolist()
            hashes.append(np.fromiter((xxh64_intdigest(line[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a)))
        counts.append(n)
    count, every = np.array(counts, np.int64), np.concatenate(hashes)
    row = np.repeat(np.arange(len(count)), count)
    set_bits = np.zeros((len(count), 64), np.int64)
    for at in range(0, len(every), SHINGLES_AT_ONCE):
        part, own = every[at : at + SHINGLES_AT_ONCE], row[at : at + SHINGLES_AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        set_bits[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """n x 3 keys to store each fingerprint under, and the distinct keys to look it up under."""
    near = [golay.nearby_codewords((prints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    stored, looked_up = [], []
    for p, (a, b) in enumerate(PAIRS):
        tag = p << 2 * golay.MESSAGE
        stored.append(tag | near[a][:, 0] << golay.MESSAGE | near[b][:, 0])
        looked_up.append((tag | near[a][:, :, None] << golay.MESSAGE | near[b][:, None, :]).reshape(len(prints), -1))
    rows = np.sort(np.concatenate(looked_up, axis=1), axis=1)
    first = np.concatenate([np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1)
    return np.stack(stored, axis=1), [r[f] for r, f in zip(rows, first)]


def fingerprint_documents(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, given): the fingerprint's 64 bits as a signed number, and the columns ``carry`` as a struct."""
    given = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), given.alias("given"))
    schema = picked.select("doc_id", F.lit(0).cast("bigint").alias("fp"), "given").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("simhash")
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                fp = fingerprints(part.column("text").to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), part.column("given")], names=["doc_id", "fp", "given"])

    return picked.mapInArrow(run, schema)


def near_links(prints: DataFrame) -> DataFrame:
    """(u, v): all pairs of distinct fingerprints ``fp`` with at most three different bits, u < v."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("simhash")
        kind = pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                fp = batch.column(0).slice(at, 5_000)
                stored, looked_up = fuzzy_keys(fp.to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([fp, pa.array(list(stored), kind), pa.array(looked_up, kind)], names=["fp", "stored", "looked_up"])

    keyed = scratch.keep(prints.select("fp").mapInArrow(keys, "fp long, stored array<int>, looked_up array<int>"), "simhash-keys")
    left = keyed.select(F.col("fp").alias("u"), F.explode("stored").alias("key"))
    right = keyed.select(F.col("fp").alias("v"), F.explode("looked_up").alias("key"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    links = scratch.keep(left.hint("merge").join(right, (left["key"] == right["key"]) & (F.col("u") < F.col("v")) & close).select("u", "v").distinct(), "simhash-links")
    scratch.drop(keyed)
    return links


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, group, n_links, given): every row's fingerprint and the smallest ID it reaches.

    ``group`` is the smallest fingerprint of the component, which tells components apart also where
    IDs are repeated. ``n_links`` counts the other distinct fingerprints linked to the row's own.
    Null and blank texts share fingerprint 0. Rows with equal IDs are rows of their own that reach
    each other only by fingerprint; a null ID is never the smallest unless its whole component has
    none. Columns of ``carry`` are returned in the struct ``given``; no others are read.
    """
    rows = scratch.keep(fingerprint_documents(docs, shingle, doc_id, text, carry), "fingerprints")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = near_links(distinct)
    degree = links.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    members = scratch.keep(connected_components(links).select(F.col("vertex").alias("fp"), "component"), "simhash-members")
    # Stored, so that both sides of the next join are plain shuffles and a huge component can be split.
    least = scratch.keep(members.join(distinct, "fp").groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    linked = members.join(least, "component").select("fp", "component", "component_id")
    found = scratch.keep(
        distinct.join(linked, "fp", "left").join(degree, "fp", "left").select(
            "fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "fp").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        ), "simhash-classes"
    )
    joined = rows.join(found, "fp")
    return joined.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id", hex_of(F.col("group")).alias("group"), "n_links", "given")
