"""Groups of spelling variants: words one edit apart, each led to its most frequent near word.

Letters are hashed to a few symbols. A word's reduced form keeps its length, so words that differ by
one inserted, deleted or replaced letter have reduced forms that differ by one such edit or by none.
Each reduced word's full neighbourhood of one edit is generated and joined with the reduced words of
the vocabulary; every pair so met is verified on the original strings within the join, whose
output is links, not candidates.

Of two reduced words the one with the smaller key looks up the other, so a pair is met once. The
number of symbols follows from the size of the vocabulary: few symbols make many chance meetings,
many symbols large neighbourhoods. Neighbourhoods grow with the word, so words of more than
``LONG`` letters meet by their halves instead, one of which an edit leaves as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import scratch, worker

#: Words of up to as many letters are met by their reduced neighbourhoods.
LONG = 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
#: Neighbours that one numpy step generates.
STEP = 1 << 20


def symbols_for(words: int) -> int:
    """Symbols with which reduced words of nine letters are about as many as the vocabulary."""
    return max(3, math.ceil(words ** (1 / 9)))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough.

    A word is a run of Latin letters, A-Z lower-cased, that loses one letter where the CRC-32 of
    ``doc_id:run`` is a multiple of ``noise``. Null texts have none; a null id counts as empty.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), 0)).alias("run"))
    lowered = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def reduced(words: np.ndarray, symbols: int) -> np.ndarray:
    """Words of one length as code points (n x length) to symbols 1..symbols."""
    x = words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def neighbourhood(letters: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of reduced words (n x length), and of all words one edit away from each or none (n x m).

    A key is the polynomial of the symbols modulo 2**64, so an edit changes it by prefix and suffix.
    """
    n, size = letters.shape
    power = np.array([pow(_BASE, i, 1 << 64) for i in range(size + 1)], np.uint64)
    head = np.zeros((n, size + 1), np.uint64)
    np.cumsum(letters * power[:size], axis=1, out=head[:, 1:])
    whole = head[:, -1:]
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    replaced = whole[:, :, None] + (every[None, None, :] - letters[:, :, None]) * power[None, :size, None]
    removed = head[:, :-1] + (whole - head[:, 1:]) * np.uint64(_INVERSE)
    inserted = (head + (whole - head) * np.uint64(_BASE))[:, :, None] + every[None, None, :] * power[None, :, None]
    return whole[:, 0], np.concatenate([whole, replaced.reshape(n, -1), removed, inserted.reshape(n, -1)], axis=1)


def _short_keys(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, own, keys): the reduced word's key, and those of its neighbours that are not smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("spelling")
        for batch in batches:
            word = batch.column("word").to_pylist()
            size = np.fromiter(map(len, word), np.int64, len(word))
            for length in np.unique(size):
                at = np.flatnonzero(size == length)
                step = max(1, STEP // int(2 * (length + 1) * (symbols + 1)))
                for some in (at[i : i + step] for i in range(0, len(at), step)):
                    codes = np.frombuffer("".join([word[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(len(some), -1)
                    own, near = neighbourhood(reduced(codes, symbols), symbols)
                    near = np.sort(near, axis=1)
                    fresh = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1) & (near >= own[:, None])
                    ends = np.r_[0, np.cumsum(fresh.sum(axis=1))].astype(np.int32)
                    keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(near[fresh].view(np.int64)))
                    part = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(own.view(np.int64)), keys], names=["word", "n", "own", "keys"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, own long, keys array<long>")


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point, in linear time."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = (np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in (a, b))
    differ = np.flatnonzero(x != y[: len(x)])
    at = int(differ[0]) if len(differ) else len(x)
    return bool((x[at + (len(x) == len(y)) :] == y[at + 1 :]).all())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.enter("spelling")
    for batch in batches:
        yield batch.filter(pa.array([one_edit(u.as_py(), v.as_py()) for u, v in zip(batch.column("u"), batch.column("v"))], pa.bool_()))


def near_links(words: DataFrame, symbols: int) -> DataFrame:
    """(u, n_u, v, n_v): every pair of words that differ by exactly one letter, once, from (word, n)."""
    keyed = scratch.keep(_short_keys(words.where(F.char_length("word") <= LONG), symbols), "reduced-words")
    left = keyed.select(F.col("word").alias("u"), F.col("n").alias("n_u"), "own", F.explode("keys").alias("key")).select("u", "n_u", "key", (F.col("own") == F.col("key")).alias("same"))
    right = keyed.select(F.col("word").alias("v"), F.col("n").alias("n_v"), F.col("own").alias("met"))
    once = ~F.col("same") | (F.col("u") < F.col("v"))
    alike = F.abs(F.char_length("u") - F.char_length("v")) <= 1
    short = left.hint("merge").join(right, (F.col("key") == F.col("met")) & once & alike & (F.levenshtein("u", "v", 1) == 1)).select("u", "n_u", "v", "n_v")

    size = F.char_length("word")
    halves = []
    for least in (size, size - 1):  # the length of the shorter word of a pair
        half = F.floor(least / 2).cast("int")
        halves += [F.xxhash64(F.lit(0), least, F.substr("word", F.lit(1), half)), F.xxhash64(F.lit(1), least, F.substr("word", size - half + 1))]
    long = words.where(size >= LONG).select("word", "n", F.explode(F.array(*halves)).alias("key"))
    a, b = long.select(F.col("word").alias("u"), F.col("n").alias("n_u"), "key"), long.select(F.col("word").alias("v"), F.col("n").alias("n_v"), "key")
    beyond = (F.col("u") < F.col("v")) & (F.greatest(F.char_length("u"), F.char_length("v")) > LONG)
    met = a.hint("merge").join(b, "key").where(beyond).select("u", "n_u", "v", "n_v").distinct()
    return short.unionByName(met.mapInArrow(_verified, "u string, n_u long, v string, n_v long"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form; forms are ever more frequent, so chains end."""
    step = scratch.keep(forms.select("word", F.col("form").alias("root")), "spelling-step")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.keep(step.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-step")
        scratch.drop(step)
        step = moved
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")


def spelling_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row (word, n) of a vocabulary.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The
    form is the near word with the largest n, of equals the first in code-point order, if its n is
    at least ``ratio`` times the word's; the root is where the chain of forms ends, the word itself
    without one. Null and repeated words are left out: null has no letters, and of a repeated word
    the counts are added. No words, no rows; other columns are ignored.
    """
    known = scratch.keep(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "vocabulary")
    links = scratch.keep(near_links(known, symbols_for(known.count())), "spelling-links")
    both = links.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("n_v").alias("m")).unionByName(links.select(F.col("v").alias("word"), F.col("u").alias("near"), F.col("n_u").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    led = F.col("n") * ratio <= -F.col("best.less")
    formed = scratch.keep(
        known.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")
        ), "spelling-forms"
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
