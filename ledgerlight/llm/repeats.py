"""Removal of long repeats: bytes covered by a 50-byte string that an earlier document has too.

What a document loses depends on which of its 50-byte suffix prefixes (windows) occur in a document
with a smaller ID. Suffixes that share their first 50 bytes are neighbours in suffix order, so the
windows are settled by sorting suffixes (:mod:`ledgerlight.llm.suffix_sort`). Sorting every suffix of
a corpus would move each byte dozens of times; most need no sorting, because a string inside them
occurs nowhere else. The steps:

1.  Texts are stored in blocks of about ``block_bytes``, bucketed by block, so that later steps read
    them where they lie. Copies of whole texts are found by their digest; only the first takes part.
2.  The smallest 24-byte hash in a window is its anchor. Equal windows have equal anchors, so each
    window belongs to one anchor, and neighbouring windows of one anchor form a context of at most
    76 bytes. Each block sends its distinct anchors to owners by hash, and gets back which of them
    another document has, and which are in very many blocks.
3.  For shared anchors a block sends its distinct contexts, with the smallest document of each, to
    owners by anchor. An owner sorts the contexts, then the windows of all anchors that occur in
    different contexts, and returns which windows have an earlier document. Windows of anchors that
    very many blocks have are sent one by one, by their own hash: each distinct window once per
    block, so no owner's share grows with the number of copies.
4.  Blocks turn the answers into removed bytes.

Anchors are only a filter without false negatives; equality is settled by sorted order and bytes.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import scratch, worker
from ledgerlight.llm.arrow_text import longs, ragged, utf8
from ledgerlight.llm.rolling import PrefixHashes, mix
from ledgerlight.llm.suffix_sort import first_owner

WIDTH, GRAM = 50, 24
SPREAD = WIDTH - GRAM + 1
HOT_BLOCKS = 128
#: Text read by one task.
BUCKET_BYTES = 16 << 20
_POSITION = 24  # bits of a packed number that hold a position in a stretch of the block

ANSWER = "block int, owner int, payload binary"


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """This worker's compressor and decompressor; messages are small and many."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes one after the other, compressed."""
    return _codec()[0].compress(b"".join([a.tobytes() for a in arrays]))


def expand(data: bytes, kind: str = "u1") -> np.ndarray:
    return np.frombuffer(_codec()[1].decompress(data), kind)


def request_fields(payload: bytes) -> list[np.ndarray]:
    """The arrays of a block's request: per context the number of windows, the anchor's place and the
    document, the contexts' bytes; the single windows' documents and bytes."""
    data = expand(payload)
    contexts, letters, windows = np.frombuffer(data[:24].tobytes(), np.int64).tolist()
    sizes = [contexts, contexts, 8 * contexts, letters, 8 * windows, WIDTH * windows]
    return np.split(data[24:], np.cumsum(sizes)[:-1])


def least_grams(grams: np.ndarray, stretch: int = 1 << _POSITION) -> np.ndarray:
    """Of each ``SPREAD`` neighbours, the position of the one with the smallest hash, or the first of several.

    Hashes are compared by the bits that positions leave free. Positions count within stretches that
    overlap, so the outcome does not depend on where in a block, or in how long a block, a window lies.
    """
    low, found = np.uint64((1 << _POSITION) - 1), [np.zeros(0, np.int64)]
    step = stretch - SPREAD
    for at in range(0, len(grams) - SPREAD + 1, step):
        part = grams[at : at + step + SPREAD - 1]
        least, reach = part & ~low | np.arange(len(part), dtype=np.uint64), 1
        while reach * 2 <= SPREAD:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < SPREAD:
            least = np.minimum(least[: len(least) - (SPREAD - reach)], least[SPREAD - reach :])
        found.append((least & low).astype(np.int64) + at)
    return np.concatenate(found)


class Block:
    """The anchors and windows of a block's documents; equal blocks give equal arrays."""

    def __init__(self, table: pa.Table):
        self.table = table
        text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        self.data, self.offsets = utf8(text)
        self.doc = table.column("doc_id").to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)
        self.lengths = np.diff(self.offsets)
        ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.known = np.asarray(ids.is_valid())
        self.doc = longs(ids.fill_null(0))
        self.copy = np.asarray(table.column("copy").combine_chunks().fill_null(False)) if table.num_rows else np.zeros(0, bool)
        self.takes_part = self.known & ~self.copy & (self.lengths >= WIDTH)

    def find(self) -> None:
        """Windows grouped by their anchors: start of the first, number of windows, row, anchor hash."""
        self.hashes = PrefixHashes(self.data)
        grams = mix(self.hashes.grams(GRAM))
        least = least_grams(grams)
        rows = np.flatnonzero(self.takes_part)
        windows = ragged(self.offsets[rows], self.lengths[rows] - WIDTH + 1)
        row = np.repeat(rows, self.lengths[rows] - WIDTH + 1)
        anchor = least[windows]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        self.start, self.row = windows[head], row[head]
        self.count = np.diff(np.r_[head, len(row)])
        self.anchor = anchor[head]
        self.gram = grams[self.anchor]
        self.kinds, self.kind = np.unique(self.gram, return_inverse=True)

    def by_owner(self, owners: int, hashes: np.ndarray) -> list[np.ndarray]:
        """Indices of ``hashes`` by owner, each list in order."""
        owner = (hashes % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        return np.split(order, np.searchsorted(owner[order], np.arange(1, owners)))

    def anchor_requests(self, owners: int):
        """(owner, payload): six bytes of each distinct anchor and whether two documents here have it."""
        order = np.lexsort((self.doc[self.row], self.kind))
        k, d = self.kind[order], self.doc[self.row][order]
        several = np.zeros(len(self.kinds), bool)
        several[k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])]] = True
        for owner, chosen in enumerate(self.by_owner(owners, self.kinds)):
            if len(chosen):
                short = np.ascontiguousarray(self.kinds[chosen].view(np.uint8).reshape(-1, 8)[:, 2:])
                yield owner, short.tobytes() + several[chosen].tobytes()

    def distinct(self, start: np.ndarray, length: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, which): an index of the row with the smallest document for each distinct text, and
        each text's place in that list. Bytes confirm what hashes put together."""
        key = mix(self.hashes.of(start, start + length))
        order = np.lexsort((self.doc[row], key))
        new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        same = (length == length[first][which])
        other = np.flatnonzero(first[which] != np.arange(len(which)))
        for at in range(0, len(other), 100_000):
            x = other[at : at + 100_000]
            x = x[same[x]]
            if len(x):
                y, n = first[which[x]], length[x]
                differ = self.data[ragged(start[x], n)] != self.data[ragged(start[y], n)]
                same[x] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
        alone = np.flatnonzero(~same)
        which[alone] = len(first) + np.arange(len(alone))
        return np.r_[first, alone], which

    def choose(self, answers: dict[int, bytes], owners: int) -> None:
        """Read the anchor answers and list the contexts and single windows to be settled."""
        code = np.zeros(len(self.kinds), np.uint8)
        for owner, chosen in enumerate(self.by_owner(owners, self.kinds)):
            if len(chosen):
                code[chosen] = expand(answers[owner], "u1")
        own = code[self.kind]
        self.cold = np.flatnonzero(own == 1)
        self.context_first, self.context_of = self.distinct(self.start[self.cold], self.count[self.cold] + WIDTH - 1, self.row[self.cold])
        hot = np.flatnonzero(own == 2)
        self.hot_start = ragged(self.start[hot], self.count[hot])
        self.hot_row = np.repeat(self.row[hot], self.count[hot])
        self.hot_first, self.hot_of = self.distinct(self.hot_start, np.full(len(self.hot_start), WIDTH), self.hot_row)

    def settle_requests(self, owners: int):
        """(owner, payload) of the distinct contexts, by anchor, and hot windows, by their hash."""
        contexts = self.cold[self.context_first]
        windows = self.hot_start[self.hot_first]
        window_hash = mix(self.hashes.of(windows, windows + WIDTH))
        for owner, (c, w) in enumerate(zip(self.by_owner(owners, self.gram[contexts]), self.by_owner(owners, window_hash))):
            if len(c) or len(w):
                x = contexts[c]
                text = self.data[ragged(self.start[x], self.count[x] + WIDTH - 1)]
                yield owner, squeeze(
                    np.array([len(c), len(text), len(w)], np.int64),
                    self.count[x].astype(np.uint8), (self.anchor[x] - self.start[x]).astype(np.uint8), self.doc[self.row[x]], text,
                    self.doc[self.hot_row[self.hot_first[w]]], self.data[ragged(windows[w], np.full(len(w), WIDTH))],
                )

    def earlier(self, answers: dict[int, bytes], owners: int) -> np.ndarray:
        """Starts of the windows that an earlier document has too."""
        contexts = self.cold[self.context_first]
        windows = self.hot_start[self.hot_first]
        window_hash = mix(self.hashes.of(windows, windows + WIDTH))
        mask, flag = np.zeros(len(contexts), np.uint32), np.zeros(len(windows), bool)
        for owner, (c, w) in enumerate(zip(self.by_owner(owners, self.gram[contexts]), self.by_owner(owners, window_hash))):
            if len(c) or len(w):
                answer = expand(answers[owner]).tobytes()
                mask[c] = np.frombuffer(answer, np.uint32, len(c))
                flag[w] = np.frombuffer(answer, np.uint8, len(w), 4 * len(c)).astype(bool)
        # A document after the block's first one with the same context has lost the whole context.
        doc = self.doc[self.row[self.cold]]
        all_ones = np.uint32((1 << SPREAD) - 1)
        bits = np.where(doc > doc[self.context_first][self.context_of], all_ones, mask[self.context_of]) if len(doc) else np.zeros(0, np.uint32)
        n = self.count[self.cold]
        nth = ragged(np.zeros(len(n), np.int64), n)
        cold = (np.repeat(self.start[self.cold], n) + nth)[(np.repeat(bits, n) >> nth.astype(np.uint32) & np.uint32(1)).astype(bool)]
        own = self.doc[self.hot_row]
        hot = self.hot_start[(own > own[self.hot_first][self.hot_of]) | flag[self.hot_of]] if len(own) else np.zeros(0, np.int64)
        return np.concatenate([cold, hot])

    def removed(self, starts: np.ndarray) -> np.ndarray:
        """A flag for each byte of the block."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WIDTH, -1)
        flags = np.cumsum(change)[:-1] > 0
        for i in np.flatnonzero(self.known & self.copy & (self.lengths >= WIDTH)).tolist():
            flags[self.offsets[i] : self.offsets[i + 1]] = True
        return flags


def answer_anchors(table: pa.Table, hot_blocks: int) -> pa.Table:
    """For each block's anchors: 0 one document, 1 several, 2 in at least ``hot_blocks`` blocks."""
    worker.enter("powers")
    blocks, payloads = table.column("block").to_pylist(), [x.as_py() for x in table.column("payload")]
    sizes = np.array([len(p) // 7 for p in payloads], np.int64)
    key = np.zeros((int(sizes.sum()), 8), np.uint8)
    several = np.zeros(len(key), bool)
    edges = np.r_[0, np.cumsum(sizes)]
    for p, a, b in zip(payloads, edges[:-1], edges[1:]):
        raw = np.frombuffer(p, np.uint8)
        key[a:b, 2:] = raw[: 6 * (b - a)].reshape(-1, 6)
        several[a:b] = raw[6 * (b - a) :].astype(bool)
    key = key.view(np.uint64).ravel()
    order = np.argsort(key)
    head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    size = np.diff(np.r_[head, len(key)])
    shared = (size > 1) | np.logical_or.reduceat(several[order], head)
    code = np.where(size >= hot_blocks, 2, shared).astype(np.uint8)
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat(code, size)
    owner = table.column("owner")[0].as_py()
    return pa.table({"block": pa.array(blocks, pa.int32()), "owner": pa.array([owner] * len(blocks), pa.int32()), "payload": pa.array([squeeze(out[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


def answer_windows(table: pa.Table) -> pa.Table:
    """For each context a bit per window, for each single window a byte: has an earlier document it too?"""
    worker.enter("powers")
    fields = list(zip(*(request_fields(x.as_py()) for x in table.column("payload"))))
    count, anchor = (np.concatenate(x).astype(np.int64) for x in fields[:2])
    doc, single_doc = (np.concatenate(fields[i]).view(np.int64) for i in (2, 4))
    data = np.concatenate([*fields[3], *fields[5]])
    text = PrefixHashes(data)
    length = count + WIDTH - 1
    start = np.cumsum(length) - length
    # Equal contexts: only the first document's still has to be looked at.
    kind, least = first_owner(text, start, length, doc)
    mask = np.where(doc > least[kind] if len(doc) else np.zeros(0, bool), np.uint32((1 << SPREAD) - 1), np.uint32(0))
    chosen = np.unique(kind, return_index=True)[1]
    gram = text.of(start[chosen] + anchor[chosen], start[chosen] + anchor[chosen] + GRAM)
    _, which, contexts = np.unique(gram, return_inverse=True, return_counts=True)
    mixed = chosen[contexts[which] > 1] if len(chosen) else chosen
    n = count[mixed]
    window = np.r_[ragged(start[mixed], n), int(length.sum()) + np.arange(len(single_doc)) * WIDTH]
    owner = np.r_[np.repeat(least[kind[mixed]], n), single_doc]
    window_kind, window_least = first_owner(text, window, np.full(len(window), WIDTH), owner)
    earlier = window_least[window_kind] < owner if len(owner) else np.zeros(0, bool)
    inside = int(n.sum())
    nth = ragged(np.zeros(len(n), np.int64), n).astype(np.uint32)
    by_kind = np.zeros(len(least), np.uint32)
    if inside:
        by_kind[kind[mixed]] = np.bitwise_or.reduceat(earlier[:inside].astype(np.uint32) << nth, np.cumsum(n) - n)
    if len(kind):
        mask = mask | by_kind[kind]
    flag = earlier[inside:].astype(np.uint8)
    context_edges = np.r_[0, np.cumsum([len(x) for x in fields[0]], dtype=np.int64)]
    single_edges = np.r_[0, np.cumsum([len(x) // 8 for x in fields[4]], dtype=np.int64)]
    payload = [squeeze(mask[a:b].astype(np.uint32), flag[c:d]) for a, b, c, d in zip(context_edges[:-1], context_edges[1:], single_edges[:-1], single_edges[1:])]
    owner_id = table.column("owner")[0].as_py()
    return pa.table({"block": table.column("block").cast(pa.int32()), "owner": pa.array([owner_id] * table.num_rows, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _answers(table: pa.Table) -> dict[int, bytes]:
    return {o: p for o, p in zip(table.column("owner").to_pylist(), table.column("payload").to_pylist())}


def store_blocks(docs: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """The rows as a table bucketed by ``block``, a hash of the document's ID and text."""
    spark = docs.sparkSession
    name, path = f"llm_blocks_{uuid.uuid4().hex}", scratch.new_path(spark, "blocks")
    (docs.repartition(buckets, "block").write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name))
    scratch.remember_table(spark, name)
    return spark.table(name)


def first_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row whose whole text an earlier document has; ``rows``: doc_id, digest."""
    groups = scratch.keep(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "copy-groups")
    # Merged, so that both sides are plain shuffles and a digest with very many copies is split.
    later = scratch.keep(rows.hint("merge").join(groups, "digest").where("doc_id > first").select("doc_id", "digest").distinct(), "copies")
    scratch.drop(groups)
    return later


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), block_bytes: int = 1 << 20, owner_bytes: int = 4 << 20, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per document: (doc_id, columns ``carry``, n_bytes, n_removed, n_spans, spans, kept, kept_text).

    ``spans`` are the maximal removed byte ranges [start, end); ``kept`` the remaining bytes;
    ``kept_text`` the text without the characters all of whose bytes are removed (null stays null).
    A null text is empty. Texts shorter than 50 bytes lose nothing. Rows with equal IDs do not count
    as earlier than each other, and a row without an ID neither loses nor removes anything.
    Carried columns named like an output are replaced.
    """
    taken = {"n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text", "block", "copy", "digest", "doc_id", "text", "owner", "payload"}
    extra = [c for c in dict.fromkeys(carry) if c.lower() not in taken]
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *extra)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(1, min(blocks, -(-total // BUCKET_BYTES)))
    owners, sorters = max(1, -(-total // (8 * owner_bytes))), max(1, -(-total // owner_bytes))
    base = base.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("block", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks)).cast("int"))
    table = store_blocks(base, blocks, buckets)
    copies = first_copies(table.select("doc_id", "digest").where("doc_id is not null and octet_length(text) >= 50"))
    marks = scratch.keep(copies.select(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "digest"), "copy-marks")
    scratch.drop(copies)
    # The answers a block gets are one table: copies to leave out (owner -1) and payloads by owner.
    left_out = marks.select("block", F.lit(-1).cast("bigint").alias("owner"), F.to_binary(F.concat_ws(":", F.col("doc_id"), F.col("digest")), F.lit("utf-8")).alias("payload"))
    content = table.select("block", "doc_id", "digest", "text", *extra)

    def block_of(rows: pa.Table, answers: pa.Table) -> tuple[Block, list[bytes]]:
        worker.enter("powers")
        out = {p for o, p in zip(answers.column("owner").to_pylist(), answers.column("payload").to_pylist()) if o == -1}
        order = rows.sort_by([("doc_id", "ascending"), ("digest", "ascending")])
        copy = [f"{d}:{h}".encode() in out for d, h in zip(order.column("doc_id").to_pylist(), order.column("digest").to_pylist())]
        block = Block(order.append_column("copy", pa.array(copy, pa.bool_())))
        block.find()
        return block, copy

    def only(answers: pa.Table, stage: int) -> dict[int, bytes]:
        """Answers of a stage: its owners are numbered from stage << 40, so no number of owners reaches the next."""
        return {o - (stage << 40): p for o, p in _answers(answers).items() if o >> 40 == stage}

    def requests(block: int, asked: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table({"owner": pa.array([o for o, _ in asked], pa.int32()), "block": pa.array([block] * len(asked), pa.int32()), "payload": pa.array([p for _, p in asked], pa.binary())})

    def ask_anchors(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py() if rows.num_rows else 0
        return requests(block, list(block_of(rows, answers)[0].anchor_requests(owners)) if rows.num_rows else [])

    def ask_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        asked, number = [], 0
        if rows.num_rows:
            number = rows.column("block")[0].as_py()
            block, _ = block_of(rows, answers)
            block.choose(only(answers, 1), owners)
            asked = list(block.settle_requests(sorters))
        return requests(number, asked)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*extra).schema.fields]
    schema = ", ".join(["doc_id long", *fields, "n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_text string"])

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", *extra, "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text"]
        if not rows.num_rows:
            kinds = [rows.schema.field(n).type for n in ("doc_id", *extra)] + [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        block, _ = block_of(rows, answers)
        block.choose(only(answers, 1), owners)
        gone = block.removed(block.earlier(only(answers, 2), sorters))
        kept, texts, spans, removed = [], [], [], []
        is_null = np.asarray(block.table.column("text").combine_chunks().is_null())
        for i, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())):
            own, data = gone[a:b], block.data[a:b]
            edge = np.flatnonzero(np.diff(np.r_[0, own.view(np.int8), 0]))
            spans.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            removed.append(int(own.sum()))
            kept.append(data[~own].tobytes())
            if is_null[i]:
                texts.append(None)
            elif not removed[-1]:
                texts.append(data.tobytes().decode())
            else:
                heads = np.flatnonzero((data & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(own, heads)
                texts.append(data[~np.repeat(whole, np.diff(np.r_[heads, len(data)]))].tobytes().decode())
        t = block.table
        columns = [t.column("doc_id"), *[t.column(c) for c in extra], pa.array(block.lengths), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
        return pa.Table.from_arrays(columns, names=names)

    def with_stage(stored: DataFrame, stage: int) -> DataFrame:
        return stored.select("block", (F.col("owner") + F.lit(stage << 40)).alias("owner"), "payload")

    by_block = content.groupBy("block")
    request = "owner int, block int, payload binary"
    asked = by_block.cogroup(left_out.groupBy("block")).applyInArrow(ask_anchors, request)
    shared = scratch.keep(asked.groupBy("owner").applyInArrow(lambda rows: answer_anchors(rows, hot_blocks), ANSWER), "anchor-answers")
    answers = left_out.unionByName(with_stage(shared, 1))
    asked = by_block.cogroup(answers.groupBy("block")).applyInArrow(ask_windows, request)
    settled = scratch.keep(asked.groupBy("owner").applyInArrow(answer_windows, ANSWER), "window-answers")
    answers = answers.unionByName(with_stage(settled, 2))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def digest_of(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
