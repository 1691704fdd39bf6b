"""Benchmark decontamination with an FM-index per shard of training text.

Windows of ten consecutive words of each benchmark item are the phrases (an item with fewer words is
one phrase). A shard is a bounded run of documents within a task. A phrase can only occur where all
words belong to the benchmark, so the shard's index holds those stretches of at least the shortest
phrase's length and nothing else; the reduction drops no occurrence. All phrases are searched
backwards at once through wavelet ranks, occurrences are located by sampled suffix positions, and
the words they cover are merged into spans.

No text is shuffled. The benchmark is what travels. Spark splits its items into pieces of words, numbers
the words and groups equal windows with their items, in parts of about ``PART_WORDS`` words at most; each
part is broadcast for one pass over the documents, whose marks are stored for the next. A benchmark of
ordinary size is one part. A long item is cut into pieces, so no part is larger for it.
"""

from __future__ import annotations

import hashlib
import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import scratch, worker
from ledgerlight.llm.arrow_text import ragged, slices, utf8
from ledgerlight.llm.fm_index import FMIndex
from ledgerlight.llm.rolling import PrefixHashes, mix

WINDOW = 10
#: Words of benchmark text that one pass holds; a word adds one window, some 60 bytes of broadcast.
PART_WORDS = 1_000_000
#: Windows of an item that stay together; a longer item is cut.
PIECE_WORDS = 4096
#: A word of lower-cased text, the same bytes as ``_IN_WORD``.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes after lower-casing: digits, a-z and everything beyond ASCII.
_IN_WORD = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _IN_WORD[_low : _high + 1] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, text index) of all words of texts laid end to end."""
    lower = _LOWER[data]
    inside = _IN_WORD[lower]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    before = np.r_[False, inside[:-1]] & ~begins[: len(data)]
    start = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False] & ~begins[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return lower, start, end, np.searchsorted(offsets, start, side="right") - 1


class Phrases:
    """Benchmark windows as rows of word numbers (from 1), the items of each, and the numbered words."""

    def __init__(self, vocabulary: pa.Table, windows: pa.Table):
        """``vocabulary``: (word, code), both unique; ``windows``: (codes, items), each window once."""
        self.data, edges = utf8(vocabulary.column("word").combine_chunks())
        self.starts, self.ends = edges[:-1], edges[1:]
        hashes = mix(PrefixHashes(self.data).of(self.starts, self.ends)) if vocabulary.num_rows else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

        code = vocabulary.column("code").to_numpy()
        by_code = np.argsort(code)
        lists, owners = windows.column("codes").combine_chunks(), windows.column("items").combine_chunks()
        number = (by_code[np.searchsorted(code[by_code], lists.flatten().to_numpy())] + 1).astype(np.int32)
        length, owned = (x.value_lengths().to_numpy().astype(np.int64) for x in (lists, owners))
        first, first_owner = np.cumsum(length) - length, np.cumsum(owned) - owned
        names = owners.flatten().dictionary_encode()
        self.names, self.owner = names.dictionary.to_pylist(), names.indices.to_numpy().astype(np.int32)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(length).tolist():
            which = np.flatnonzero(length == n)
            self.by_length.append((number[ragged(first[which], length[which])].reshape(-1, n), first_owner[which], owned[which]))
        self.shortest = self.by_length[0][0].shape[1] if self.by_length else 0

    def word(self, number: int) -> bytes:
        return self.data[self.starts[number - 1] : self.ends[number - 1]].tobytes()


def shard_hits(part: pa.RecordBatch, text: str, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """(word start, word end, word's text, words per text, hit flag per word, items per text) of a shard."""
    data, offsets = utf8(part.column(text))
    lower, start, end, row = words_of(data, offsets)
    items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
    hit = np.zeros(len(start), bool)
    count = np.bincount(row, minlength=len(items))
    if not len(start) or not phrases.shortest:
        return start, end, row, count, hit, items
    hashes = mix(PrefixHashes(lower).of(start, end))
    slot = np.minimum(np.searchsorted(phrases.hashes, hashes), len(phrases.hashes) - 1)
    number = np.where(phrases.hashes[slot] == hashes, phrases.order[slot] + 1, 0)

    def stretches() -> tuple[np.ndarray, np.ndarray]:
        known = number > 0
        joined = known[1:] & known[:-1] & (row[1:] == row[:-1])
        begin = np.flatnonzero(known & ~np.r_[False, joined])
        size = np.flatnonzero(known & ~np.r_[joined, False]) + 1 - begin
        return begin[size >= phrases.shortest], size[size >= phrases.shortest]

    # Hashes choose the words; their bytes confirm them where a phrase could stand.
    raw, (begin, size) = lower.tobytes(), stretches()
    for w in ragged(begin, size).tolist():
        if phrases.word(number[w]) != raw[start[w] : end[w]]:
            number[w] = 0
    begin, size = stretches()
    if not len(begin):
        return start, end, row, count, hit, items
    symbols = np.zeros(int(size.sum()) + len(size), np.int64)  # stretches, each followed by a 0
    word = np.full(len(symbols), -1, np.int64)
    to = ragged(np.cumsum(size + 1) - size - 1, size)
    word[to] = ragged(begin, size)
    symbols[to] = number[word[to]]
    index = FMIndex(symbols)
    change = np.zeros(len(start) + 1, np.int64)
    for rows, first, owned in phrases.by_length:
        low, high = index.search(rows)
        times = high - low
        which = np.repeat(np.arange(len(rows)), times)
        at = word[index.locate(ragged(low[times > 0], times[times > 0]))]
        np.add.at(change, at, 1)
        np.add.at(change, at + rows.shape[1], -1)
        pairs = np.unique(row[at] * len(rows) + which) if len(at) else []
        for text_index, phrase in (divmod(int(pair), len(rows)) for pair in pairs):
            items[text_index].update(phrases.names[i] for i in phrases.owner[first[phrase] : first[phrase] + owned[phrase]])
    hit = np.cumsum(change)[:-1] > 0
    return start, end, row, count, hit, items


def spans_of(start: np.ndarray, end: np.ndarray, row: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first byte, end byte) of each run of hit words within a text."""
    joined = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
    first = np.flatnonzero(hit & ~np.r_[False, joined])
    last = np.flatnonzero(hit & ~np.r_[joined, False])
    return row[first], start[first], end[last]


def benchmark_pieces(benchmark: DataFrame, item_id: str, text: str, window: int, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item, words, weight): the words of each item in pieces that share ``window - 1`` words, so that each window lies in one.

    ``weight`` counts the words, or half their letters if that is more.
    """
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(piece_words))
    pieces = items.where("item is not null and size(words) > 0").select("item", "words", F.explode(begins).alias("at"))
    pieces = pieces.select("item", F.slice("words", F.col("at") + 1, F.lit(piece_words + window - 1)).alias("words")).distinct()
    return pieces.withColumn("weight", F.greatest(F.size("words"), F.expr("length(array_join(words, '')) div 2")).cast("bigint"))


def collect_phrases(pieces: DataFrame, window: int) -> Phrases:
    """Numbered words and grouped windows of one part of the benchmark; only the results reach the driver."""
    words = pieces.select(F.explode("words").alias("word")).distinct()
    for seed in itertools.count():
        vocabulary = words.select("word", F.xxhash64(F.lit(seed), "word").alias("code")).toArrow()
        if pc.count_distinct(vocabulary.column("code")).as_py() == vocabulary.num_rows:
            break
    coded = pieces.select("item", F.transform("words", lambda w: F.xxhash64(F.lit(seed), w)).alias("codes"))
    places = F.sequence(F.lit(1), F.greatest(F.size("codes") - window + 1, F.lit(1)))
    windows = coded.select("item", F.explode(F.transform(places, lambda k: F.slice("codes", k, F.lit(window)))).alias("codes"))
    return Phrases(vocabulary, windows.groupBy("codes").agg(F.collect_set("item").alias("items")).toArrow())


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, part_words: int = PART_WORDS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, items, spans, clean_text) and the columns ``carry``.

    ``items`` are the IDs of items with an occurring window, sorted as text; ``spans`` the byte
    ranges [start, end) of merged hits; ``clean_text`` the text without them. A null text has no
    words and stays null; repeated rows are separate documents; an item without an ID or words takes
    no part. Carried columns named like an output are replaced.
    """
    outputs = {"n_words", "n_hit", "items", "spans", "clean_text", "_text", "_hits", "_items"}
    kept = [c for c in dict.fromkeys((doc_id, *carry)) if c.lower() not in outputs]
    frame = docs.select(*kept, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    pieces = scratch.keep(benchmark_pieces(benchmark, item_id, item_text, window), "benchmark-pieces")
    total = pieces.agg(F.sum("weight")).first()[0] or 0
    # Parts are dealt by hash, so they are aimed at half of what one may hold.
    parts = 1 if total <= part_words else -(-2 * total // part_words)
    part_of = F.pmod(F.xxhash64("item", "words"), F.lit(parts))

    def marked(held: Broadcast, source: DataFrame, last: bool) -> DataFrame:
        has_marks = "_hits" in source.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.enter("powers")
            for batch in batches:
                for part in slices(batch, "_text"):
                    start, end, row, count, hit, found = shard_hits(part, "_text", held.value)
                    edge = np.r_[0, np.cumsum(count)]
                    if has_marks:
                        hit = hit | np.frombuffer(b"".join(part.column("_hits").to_pylist()), bool)
                        found = [a | set(b) for a, b in zip(found, part.column("_items").to_pylist())]
                    columns = [part.column(c) for c in (*kept, "_text")]
                    if not last:
                        cells = [hit[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=[*kept, "_text", "_hits", "_items"])
                        continue
                    n_hit = np.bincount(row[hit], minlength=len(count))
                    which, a, b = spans_of(start, end, row, hit)
                    texts = part.column("_text")
                    raws = texts.to_pylist() if len(which) else None
                    origin = utf8(texts)[1]
                    spans: list[list[dict]] = [[] for _ in count]
                    for i, x, y in zip(which.tolist(), a.tolist(), b.tolist()):
                        spans[i].append({"start": x - int(origin[i]), "end": y - int(origin[i])})
                    clean = texts
                    if raws is not None:
                        for i in np.unique(which).tolist():
                            raw, pieces, at = raws[i].encode(), [], 0
                            for s in spans[i]:
                                pieces.append(raw[at : s["start"]])
                                at = s["end"]
                            raws[i] = (b"".join(pieces) + raw[at:]).decode()
                        clean = pa.array(raws, texts.type)
                    yield pa.RecordBatch.from_arrays(
                        [*columns[:-1], pa.array(count.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), clean],
                        names=[*kept, "n_words", "n_hit", "items", "spans", "clean_text"],
                    )

        out = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, clean_text string" if last else "_text string, _hits binary, _items array<string>"
        return source.mapInArrow(run, ", ".join(filter(None, [fields, out])))

    marks = None
    for number in range(parts):
        held = frame.sparkSession.sparkContext.broadcast(collect_phrases(pieces.where(part_of == number), window))
        frame = marked(held, frame, number == parts - 1)
        if number < parts - 1:
            # Stored, so that one part's phrases are held at a time and no pass repeats those before it.
            frame, before = scratch.keep(frame, "benchmark-marks"), marks
            if before is not None:
                scratch.drop(before)
            held.destroy()
            marks = frame
    scratch.drop(pieces)
    return frame


def items_digest(items: list[str]) -> str:
    """Hex SHA-256 of the comma-joined IDs; the queries compute the same in SQL."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
