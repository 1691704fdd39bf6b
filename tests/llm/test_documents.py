"""Operators on documents against brute force on small tables."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import decontamination, golay, language, packing, plans, repeats, scratch, sharding, simhash, tokens
from ledgerlight.llm.fm_index import FMIndex
from ledgerlight.llm.rolling import PrefixHashes
from ledgerlight.llm.suffix_sort import Suffixes, first_owner

EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "É中文 ß"), (None, "no id here"), (6, "one"), (7, "two words"), (8, "%%% ... 123"), (9, "½ ² Ⅷ")]


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- repeats ---


def removed_by_hand(rows):
    first, out = {}, {}
    for doc, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            first[w] = min(first.get(w, doc), doc)
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < doc:
                gone[p : p + 50] = True
        out[doc] = bytes(np.frombuffer(data, np.uint8)[~gone])
    return out


def test_repeats_match_brute_force_with_hot_lines_and_copies(docs):
    rng = random.Random(5)
    line = " ".join(words(14, 99))
    rows = []
    for i in range(80):
        parts = [" ".join(words(rng.randint(0, 25), i)), line if i % 2 else "é" * rng.randint(0, 40), " ".join(words(10, i % 7))]
        rows.append((i, "\n".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, None), (301, "short"), (302, "ab" * 400), (303, "ba" * 300)]
    want = removed_by_hand(rows)
    for hot in (128, 2):  # by context, and window by window
        got = repeats.remove_repeats(docs(rows), carry=("lang",), block_bytes=3_000, owner_bytes=4_000, hot_blocks=hot).collect()
        assert {r.doc_id: bytes(r.kept) for r in got} == want
        for r in got:
            assert r.n_bytes - r.n_removed == len(r.kept) and r.n_spans == len(r.spans)
            assert r.kept_text is None if r.doc_id == 300 else r.kept_text.encode().startswith(bytes(r.kept)[:1])


def test_repeats_edges(docs):
    got = repeats.remove_repeats(docs(EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.n_removed == 0 for r in got)
    long = "x" * 30 + "y" * 40
    got = {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(docs([(1, long), (1, long), (None, long), (2, long)])).collect()}
    assert got == {(1, 0), (None, 0), (2, 70)}
    assert repeats.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("size", [0, 26, 27, 28, 300, 1000])
def test_least_grams_do_not_depend_on_stretches(size):
    grams = np.random.default_rng(size).integers(0, 40, size, dtype=np.uint64) << np.uint64(30)
    want = [i + int(np.argmin(grams[i : i + repeats.SPREAD])) for i in range(size - repeats.SPREAD + 1)]
    for stretch in (repeats.SPREAD + 1, 64, 1 << 24):
        assert repeats.least_grams(grams, stretch).tolist() == want


def test_a_text_beyond_sixteen_megabytes(docs):
    rng = np.random.default_rng(3)
    long, line = rng.integers(97, 123, 17_000_000, dtype=np.uint8).tobytes().decode(), " ".join(words(30, 4))
    rows = [(1, line), (2, long + line), (3, long[-90:]), (4, long[:60])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got == {1: (len(line), 0, 0), 2: (len(long) + len(line), len(line), 1), 3: (90, 90, 1), 4: (60, 60, 1)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=16, max_size=60), min_size=1, max_size=30))
def test_suffix_order(texts):
    raw = "".join(texts).encode()
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    order, equal = Suffixes(PrefixHashes(np.frombuffer(raw, np.uint8)), starts, lengths).order()
    ordered = [texts[i] for i in order]
    assert ordered == sorted(texts)
    assert [bool(e) for e in equal[1:]] == [a == b for a, b in zip(ordered, ordered[1:])]


def test_colliding_hashes_are_found_out():
    text = PrefixHashes(np.frombuffer(b"a" * 20 + b"b" * 20 + b"a" * 20, np.uint8))
    text.prefix[:] = 0  # every comparison of hashes now says equal
    kind, least = first_owner(text, np.array([0, 20, 40]), np.array([20, 20, 20]), np.array([5, 1, 3]))
    assert kind[0] == kind[2] != kind[1] and least[kind[0]] == 3 and least[kind[1]] == 1


# --- near-duplicates ---


def print_by_hand(text, k=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))] if parts else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_simhash_matches_brute_force(docs):
    rng, rows = random.Random(2), list(EDGES)
    for i in range(60):
        base = words(150, i % 12)
        for _ in range(i // 12):
            base[rng.randrange(150)] = "changed"
        rows.append((100 + i, " ".join(base).upper() if i % 3 else "\n".join(base)))
    got = simhash.near_duplicates(docs(rows), 3).collect()
    assert len(got) == len(rows)
    by_hand = {t: print_by_hand(t) for _, t in rows}
    prints = sorted(set(by_hand.values()))
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    linked = 0
    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
            linked += 1
    assert linked > 3
    least = defaultdict(list)
    for doc, text in rows:
        if doc is not None:
            least[root(by_hand[text])].append(doc)
    want = sorted((doc or -1, f"{by_hand[t]:016x}", min(least[root(by_hand[t])], default=None)) for doc, t in rows if doc)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id) == want
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(docs([]), 3).count() == 0


def test_fingerprints_do_not_depend_on_steps(monkeypatch):
    texts = [" ".join(words(n, n)) for n in (40, 3, 0, 200, 2, 41)] + [None]
    whole = simhash.fingerprints(texts, 3)
    for step in (1, 7, 64):
        monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", step)
        assert simhash.fingerprints(texts, 3).tolist() == whole.tolist()


def test_golay_code():
    error, near = golay.tables()
    assert sorted(np.bincount([e.bit_count() for e in error.tolist()])) == sorted([1, 23, 253, 1771])
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 2_000)
    y = x ^ 1 << rng.integers(0, 23, 2_000)
    assert all(a[0] in b for a, b in zip(golay.nearby_codewords(x), golay.nearby_codewords(y).tolist()))


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    stored, _ = simhash.fuzzy_keys(x)
    _, looked_up = simhash.fuzzy_keys(y)
    assert all(set(s.tolist()) & set(k.tolist()) for s, k in zip(stored, looked_up))


# --- decontamination ---


def test_decontamination_matches_brute_force(spark, docs):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng.choice([1, 3, 9, 10, 11, 30]), 1000 + i, 60))) for i in range(12)] + [(50, None), (None, "a b"), (51, "..."), (0, "Other text, same ID")]
    rows = list(EDGES)
    for i in range(40):
        inside = rng.choice(items)[1] or ""
        rows.append((100 + i, " ".join(words(20, i, 60)) + "; " + inside.upper() + ".\n" + " ".join(words(15, i + 500, 60))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def split(text):
        out, word = [], ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if c > "\x7f" or c.isdigit() or "a" <= c <= "z":
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    windows = defaultdict(set)
    for ident, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9) if w and ident is not None else 0):
            windows[tuple(w[k : k + 10])].add(str(ident))
    for part_words in (2_000_000, 20):  # in one pass, and in several
        got = decontamination.decontaminate(docs(rows), benchmark, carry=("lang",), part_words=part_words).collect()
        assert len(got) == len(rows)
        by_doc = {r.doc_id: r for r in got if r.doc_id}
        for doc, text in rows:
            w, hit, found = split(text), set(), set()
            for phrase, owners in windows.items():
                for k in range(len(w) - len(phrase) + 1):
                    if tuple(w[k : k + len(phrase)]) == phrase:
                        hit.update(range(k, k + len(phrase)))
                        found |= owners
            if doc:
                r = by_doc[doc]
                assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hit), sorted(found))
                assert len(split(r.clean_text)) <= len(w) - len(hit) and (text is None) == (r.clean_text is None)
    assert decontamination.decontaminate(docs([]), benchmark).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(docs(rows), benchmark.limit(0)).collect()} == {0}


def test_long_benchmark_items_are_cut_without_losing_a_window(spark, docs):
    long = [f"w{i}" for i in range(2 * decontamination.PIECE_WORDS + 500)]
    cut = decontamination.PIECE_WORDS
    benchmark = spark.createDataFrame([("long", " ".join(long)), ("long", " ".join(long)), ("also", " ".join(long[:30]))], "item_id string, text string")
    pieces = decontamination.benchmark_pieces(benchmark, "item_id", "text", 10).collect()
    assert max(len(p.words) for p in pieces) <= cut + 9 and len(pieces) == 4
    rows = [(i, "before " + " ".join(long[a : a + 10]) + " after") for i, a in enumerate((0, cut - 9, cut - 1, cut, 2 * cut - 5, len(long) - 10))]
    rows += [(20, " ".join(long[cut - 9 : cut])), (21, " ".join(long)), (22, " ".join(reversed(long)))]
    for part_words in (decontamination.PART_WORDS, cut):
        got = {r.doc_id: r for r in decontamination.decontaminate(docs(rows), benchmark, part_words=part_words).collect()}
        assert {i: r.n_hit for i, r in got.items()} == {**dict.fromkeys(range(6), 10), 20: 0, 21: len(long), 22: 0}
        assert got[0]["items"] == ["also", "long"] and got[1]["items"] == ["long"] and got[21]["items"] == ["also", "long"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index(text, phrase):
    index = FMIndex(np.array(text), sample=3)
    low, high = index.search(np.array([phrase]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]


# --- language ---


def test_language_held_out_accuracy_and_edges(spark, sf, docs):
    got = plans.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    edge = {(r.doc_id, r.lang_pred == "und") for r in language.identify(docs(EDGES), model, "text", "doc_id").collect()}
    assert {(1, True), (2, True), (3, True), (8, True), (9, True), (4, False), (5, False)} <= edge
    assert language.identify(docs([]), model, "text", "doc_id").count() == 0
    nothing = language.train(docs([]))
    assert {r.lang_pred for r in language.identify(docs(EDGES), nothing, "text", "doc_id").collect()} == {"und"}
    with pytest.raises(Exception, match="more than 1 languages"):
        language.train(spark.read.parquet(f"{sf}/documents.parquet"), max_languages=1)


def grams_by_hand(text):
    """Slots of all n-grams of a text: letters lower-cased, everything else a blank, blanks alone not counted."""
    points = [ord(c) if ord(c) >= 256 or c.isalpha() else 32 for c in f" {text.lower()} "]
    letter = [p >= 256 or chr(p).isalpha() for p in points]
    found = []
    for n in language.SIZES:
        for at in range(len(points) - n + 1):
            if not any(letter[at : at + n]):
                continue
            h = n * 0x01000193 & 0xFFFFFFFF
            for i in range(n):
                h = (h ^ points[at + i]) * int(language._MULTIPLIERS[i]) & 0xFFFFFFFF
                h ^= h >> 15
            found.append(h % language.SLOTS)
    return found


def test_language_matches_naive_bayes_by_hand(spark, docs):
    import math
    from collections import Counter

    rng = random.Random(12)
    alphabets = {"aa": "abcdeé ", "bb": "cdefg, ", "cc": "中文字cd "}
    rows = [(i, "".join(rng.choice(alphabets[name]) for _ in range(rng.randint(1, 40))), name) for i, name in enumerate(["aa", "bb", "bb", "cc"] * 20)]
    rows += [(900, None, "aa"), (901, "abc", None), (902, "", "bb"), (0, rows[0][1], "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame)
    seen, texts = {n: Counter() for n in alphabets}, Counter()
    for _, text, name in rows:
        if text is not None and name:
            seen[name].update(grams_by_hand(text))
            texts[name] += 1
    whole = {n: sum(c.values()) + 0.5 * language.SLOTS for n, c in seen.items()}
    asked = [r for r in rows if r[1]] + [(950, "dé 12 中", None), (951, "1 2 3", None)]
    got = {(r.doc_id, r.text): r for r in language.identify(spark.createDataFrame(asked, frame.schema), model, "text", "doc_id", "text").collect()}
    for i, text, _ in asked:
        r = got[i, text]
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == (language.UNDETERMINED, 0.0)
            continue
        logs = {n: math.log(texts[n] / sum(texts.values())) + sum(math.log((seen[n][g] + 0.5) / whole[n]) for g in grams_by_hand(text)) for n in seen}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)


# --- packing and sharding ---


def test_packing_round_trip(spark, sf, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(plans.tokenizer_file())
    rows = [r for r in EDGES if r[0] not in (4, None)] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces, held = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs(rows), plans.tokenizer_file(), length=256).collect():
        pieces[r.doc_id].append(r)
        held[r.sequence_id].append(r)
    for doc, text in rows:
        want, got = [*coder.encode(text or "", add_special_tokens=False).ids, 2], []
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (len(got), len(want), zlib.crc32(bytes(r.ids)))
            got += np.frombuffer(r.ids, "<u4").tolist()
        assert got == want
    for sequence in held.values():
        sequence.sort(key=lambda r: r.offset)
        assert [r.offset for r in sequence] == np.cumsum([0] + [r.length for r in sequence])[:-1].tolist()
        n = sum(r.length for r in sequence)
        assert n <= 256 and n & (n - 1) == 0
    assert packing.pack(docs([]), plans.tokenizer_file()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbZ'stTreRvlLmMdD.,!?%09éÉçßÿÀ×÷ \n\t ́̌JǰİΣσ²½\x1c\x85<|endoftext|>中", max_size=40), max_size=6))
def test_remembered_words_give_the_tokenizers_ids(texts):
    coder = tokens.loaded(plans.tokenizer_file())
    flat, offsets = coder.ids(pa.array(texts, pa.string()))
    assert [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])] == [coder.whole(t) for t in texts]


def test_hilbert_neighbours_are_adjacent_cells():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_keys(grid, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_shards(spark, sf, docs):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shuffle_shards(source, shards=8, bucket_bytes=60_000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in source.collect())
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    sizes = [len(v) for v in by_shard.values()]
    assert len(by_shard) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    again = sharding.shuffle_shards(source.repartition(5), shards=8, bucket_bytes=60_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    edge = sharding.shuffle_shards(docs(EDGES)).collect()
    assert len(edge) == len(EDGES) and {r["size"] for r in edge if r.doc_id == 1} == {1}
    assert sharding.shuffle_shards(docs([])).count() == 0
    assert sorted(sharding.fisher_yates(50, 1)) == list(range(50)) and len(sharding.fisher_yates(0, 1)) == 0


def hilbert_by_hand(point, bits):
    """Index of a point by walking the curve's cells from the largest to the smallest, one bit per dimension at a time."""
    d, x = len(point), list(point)
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        for i in range(d):
            if x[i] & bit:
                x[0] ^= bit - 1
            else:
                swap = (x[0] ^ x[i]) & (bit - 1)
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = 0
    for level in range(bits - 1, 0, -1):
        if x[d - 1] & 1 << level:
            turn ^= (1 << level) - 1
    return int("".join(str((v ^ turn) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_packed_documents_follow_the_curve(spark, sf):
    """Sequences hold documents in the order of keys that are computed here one by one."""
    source = spark.read.parquet(f"{sf}/documents.parquet")
    name = plans.tokenizer_file()
    coder = tokens.loaded(name)
    signs = packing.projection(max(coder.tokenizer.get_vocab_size(), 3))
    keys = {}
    for r in source.collect():
        ids = coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids
        mean = signs[ids].astype(float).mean(axis=0) if ids else np.zeros(packing.DIMENSIONS)
        top = (1 << packing.BITS) - 1
        keys[r.doc_id] = hilbert_by_hand([min(top, int((m + 1) / 2 * (top + 1))) for m in mean], packing.BITS)
    pieces = sorted(packing.pack(source, name, length=4096, keep_ids=False).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = [keys[r.doc_id] for r in pieces if r.start == 0 and r.length == r.doc_tokens]
    assert len(order) > 50 and order == sorted(order)


def shards_by_hand(rows, shards, seed, buckets, hashes):
    """Slots of rows (other columns included) from their two hashes, bucket after bucket."""
    places, at = {}, 0
    for bucket in range(buckets):
        mine = sorted((h, row) for h, row in zip(hashes, rows) if h[0] % buckets == bucket)
        for i, k in enumerate(sharding.fisher_yates(len(mine), seed * 1_000_003 + bucket)):
            places.setdefault(mine[k][1], []).append(((at + i) % shards, (at + i) // shards))
        at += len(mine)
    return {row: sorted(p) for row, p in places.items()}


def test_shards_match_brute_force_with_a_hot_group(spark):
    rows = [(i, f"text {i} " + "x" * (i % 50), i % 3) for i in range(300)] + [(7, "copy", i % 5) for i in range(150)] + [(7, "copy", 1)] * 20
    frame = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    seed, size = 5, 1_000
    total = sum(len(t) + 1 for _, t, _ in rows)
    hashed = frame.selectExpr("doc_id", "text", "rank", f"xxhash64({seed}, doc_id, text) AS a", f"xxhash64({seed + 1}, text, doc_id) AS b").collect()
    want = shards_by_hand([(r.doc_id, r.text, r["rank"]) for r in hashed], 3, seed, -(-total // size), [(r.a, r.b) for r in hashed])
    for parts in (1, 7):
        got = defaultdict(list)
        for r in sharding.shuffle_shards(frame.repartition(parts), shards=3, seed=seed, bucket_bytes=size).collect():
            got[r.doc_id, r.text, r["rank"]].append((r.shard, r.slot))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_shard_files(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(sharding.shuffle_shards(source, shards=3, bucket_bytes=60_000), str(tmp_path / "shards"))
    stored = spark.read.parquet(str(tmp_path / "shards"))
    assert stored.count() == source.count() and stored.select("shard").distinct().count() == 3


def test_release_deletes_what_was_kept(spark, docs):
    import os

    kept = scratch.keep(docs([(1, "a")]), "probe")
    path = kept._scratch_path.removeprefix("file:")
    assert os.path.exists(path)
    scratch.drop(kept)
    assert not os.path.exists(path)
