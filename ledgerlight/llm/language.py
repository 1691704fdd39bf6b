"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters per language and hash slot inside each task, and
adds the tasks' counts up with an aggregation, so every labelled text counts in whole. The model is
one log-probability per language and slot. It is broadcast; its size is slots x languages x 4 bytes
whatever the amount of text, and more than ``max_languages`` languages are an error. Texts are
scored in sparse batches: the distinct (text, slot) pairs of a batch with their counts, times the
rows of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import worker
from ledgerlight.llm.arrow_text import slices

UNDETERMINED = "und"
SLOTS = 1 << 14
SIZES = (1, 2, 3)
BATCH_BYTES = 1 << 20
# Odd multipliers of the n-gram hash.
_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@dataclass
class Model:
    """``weights``: slots x languages, log P(slot | language); ``prior``: log P(language)."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each run of other characters than letters a blank."""
    parts = [f" {x.lower()} " for x in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, lengths


def slot_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, slot, count) of the distinct n-gram slots of each text.

    Digits, punctuation, symbols and white space below U+0100 count as blanks, and n-grams of blanks
    alone, or across two texts, are not counted.
    """
    points, lengths = characters(texts)
    table = np.ones(256, bool)
    table[[c for c in range(256) if not chr(c).isalpha()]] = False
    letter = np.where(points < 256, table[np.minimum(points, 255)], True)
    points = np.where(letter, points, np.uint32(32)).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    found = np.zeros(len(texts) * SLOTS if len(texts) <= 64 else 0, np.int32)
    keys = []
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint32(n * 0x01000193), np.uint32)
        some = np.zeros(m, bool)
        for i in range(n):
            h = (h ^ points[i : i + m]) * _MULTIPLIERS[i]
            h ^= h >> np.uint32(15)
            some |= letter[i : i + m]
        some &= row[:m] == row[n - 1 :]
        key = row[:m][some] * SLOTS + (h[some] & np.uint32(SLOTS - 1)).astype(np.int64)
        if len(found):
            found += np.bincount(key, minlength=len(found)).astype(np.int32)
        else:
            keys.append(key)
    if len(found):
        where = np.flatnonzero(found)
        return where // SLOTS, where % SLOTS, found[where]
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return key // SLOTS, key % SLOTS, count


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5, max_languages: int = 1_000) -> Model:
    """Fit on all rows with a text and a language. No such rows give a model without languages."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    schema = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("language")
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                texts = part.column("text").to_pylist()
                for name in set(langs):
                    chosen = [texts[i] for i in np.flatnonzero(langs == name)]
                    total = seen.setdefault(name, np.zeros(SLOTS + 1, np.int64))
                    _, slot, n = slot_counts(chosen)
                    total[:SLOTS] += np.bincount(slot, weights=n, minlength=SLOTS).astype(np.int64)
                    total[SLOTS] += len(chosen)
                    if len(seen) > max_languages:
                        raise ValueError(f"more than {max_languages} languages")
        for name, total in seen.items():
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot)), pa.array(slot.astype(np.int32)), pa.array(total[slot])], schema=schema)

    counted = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # One row per language, its slots packed, so that languages are counted before anything is fetched.
    packed = counted.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("slots")).limit(max_languages + 1)
    languages, counts, documents = [], [], []
    for r in sorted(packed.collect(), key=lambda r: r["lang"]):
        total = np.zeros(SLOTS + 1)
        for slot, n in r["slots"]:
            total[slot] = n
        languages.append(r["lang"])
        counts.append(total[:SLOTS])
        documents.append(total[SLOTS])
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    table = np.array(counts).T + smoothing
    weights = np.log(table) - np.log(table.sum(axis=0))
    return Model(languages, weights.astype(np.float32), np.log(np.array(documents) / sum(documents)))


def score(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; ties to the first name."""
    row, slot, n = slot_counts(texts)
    logs = np.tile(model.prior, (len(texts), 1))
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        logs[row[starts]] += np.add.reduceat(model.weights[slot].astype(np.float64) * n[:, None], starts, axis=0)
    best = logs.argmax(axis=1)
    top = logs.max(axis=1, keepdims=True)
    return [model.languages[i] for i in best], 1.0 / np.exp(logs - top).sum(axis=1)


def identify(docs: DataFrame, model: Model, text: str = "text", *carry: str) -> DataFrame:
    """The columns ``carry`` with ``lang_pred`` and ``score`` for every row.

    ``und`` with score 0 stands for a null text, one without a letter, and for any text if the model
    has no languages. Input columns named ``lang_pred`` or ``score`` are replaced.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    carry = [c for c in carry if c.lower() not in ("lang_pred", "score")]
    source = text if text in carry else "_text"
    rows = docs.select(*carry, *([] if text in carry else [F.col(text).alias("_text")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("language")
        m = held.value
        for batch in batches:
            for part in slices(batch, source, BATCH_BYTES):
                texts = part.column(source).to_pylist()
                known = [i for i, x in enumerate(texts) if m.languages and x and any(map(str.isalpha, x))]
                names, sure = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if known:
                    found, p = score([texts[i] for i in known], m)
                    sure[known] = p
                    for i, name in zip(known, found):
                        names[i] = name
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + [pa.array(names, pa.string()), pa.array(sure)], names=[*carry, "lang_pred", "score"])

    return rows.mapInArrow(predict, ", ".join(filter(None, [fields, "lang_pred string, score double"])))


def in_fold(doc_id: str | Column, fold: int = 1, folds: int = 3) -> Column:
    """Does crc32 of the ID as text leave this remainder? False for a null ID."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, "UTF-8")) % folds == fold, F.lit(False))
