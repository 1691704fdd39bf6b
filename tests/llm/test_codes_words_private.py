"""Vector codes, spelling groups and private data against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlight.llm import plans, private_data, scratch, spelling, vector_codes

SF = "/root/testdata/sf0.001"

# --- vector codes ---


def codes_by_hand(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(cut[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, x: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for row in cut:
                groups[best(p, row[p])[1]].append(row[p])
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[best(p, row[p]) for p in range(parts)] for row in cut]
    by_label = Counter()
    for (_, _, lab), f in zip(kept, found):
        by_label[lab] += sum(d for d, _ in f)
    out = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[lab]) for (i, _, lab), f in zip(kept, found)]
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted(out, key=repr), hashlib.sha256(text.encode()).hexdigest()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS row", "'z' AS code", "2 AS part", "3 AS error", "4 AS of")


def check_codes(spark, rows, **how):
    done = vector_codes.compress(vectors(spark, rows), **how)
    got = sorted([tuple(r) for r in done.rows.select("vec_id", "code", "error", "label_error").collect()], key=repr)
    want, digest = codes_by_hand(rows, how["parts"], how["entries"], how["rounds"], how["scale"])
    assert got == want
    assert done.digest() == digest


@pytest.mark.parametrize("block", [3, 128])
def test_codes_match_brute_force_with_hot_copies_ties_and_broken_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    rng = random.Random(4)
    vector = lambda n=8: [float(np.float32(rng.choice([rng.gauss(0, 1), rng.randint(-2, 2) / 2]))) for _ in range(n)]
    rows = [(i, vector(), rng.choice([None, 0, 1, 2])) for i in range(150)]
    hot = vector()
    rows += [(200 + i, hot, 1) for i in range(90)] + [(5, vector(), 0), (5, rows[5][1], 0), (None, vector(), None), (None, None, 1)]
    rows += [(300, None, 1), (301, [None] * 8, 1), (302, [float("nan")] * 8, 1), (303, [1.0] * 7 + [float("-inf")], None)]
    rng.shuffle(rows)
    check_codes(spark, rows, parts=4, entries=6, rounds=5, scale=16)


def test_codes_with_fewer_rows_than_entries_and_without_rows(spark):
    check_codes(spark, [(2, [0.5, -0.5], None), (1, [0.25, 3.0], None)], parts=2, entries=16, rounds=6, scale=4096)
    none = vector_codes.compress(vectors(spark, [(1, None, 2)]))
    assert none.rows.collect() == [] and none.digest() == hashlib.sha256(b"").hexdigest()


def test_codes_refuse_what_they_cannot_cut_or_hold(spark):
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(vectors(spark, [(1, [0.5] * 8, 0), (2, [0.5] * 16, 0)]))
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(vectors(spark, [(1, [0.5] * 9, 0)]))
    with pytest.raises(ValueError, match="components"):
        vector_codes.compress(vectors(spark, [(1, [1e30] * 8, 0)]))


def test_shortlists_hold_the_nearest_entry_and_settle_blocks():
    rng = np.random.default_rng(3)
    for spread in (1, 20, 400):
        book = rng.integers(-500, 500, (16, 8))
        points = rng.integers(-500, 500, (200, 1, 8)) + rng.integers(-spread, spread, (200, 30, 8))
        possible = vector_codes.shortlists(points.min(axis=1), points.max(axis=1), book)
        index, distance = vector_codes.nearest(points.reshape(-1, 8), book)
        assert possible[np.repeat(np.arange(200), 30), index].all()
        assert (distance == ((points.reshape(-1, 1, 8) - book[None]) ** 2).sum(axis=2).min(axis=1)).all()
        if spread == 1:
            assert (possible.sum(axis=1) == 1).mean() > 0.8


# --- spelling variants ---


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def groups_by_hand(counts, ratio=10):
    form, n_near = {}, {}
    for w in counts:
        close = [v for v in counts if near(w, v)]
        n_near[w] = len(close)
        top = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], counts.get(form[w])))
    return sorted(out)


def words_by_hand(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edited(word, rng, letters):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind < 2) :]


def test_spelling_groups_match_brute_force(spark):
    rng, letters = random.Random(7), "abcdeéß×"
    counts = {}
    for i in range(60):
        size = rng.choice([7, 8, 9, 31, 32, 33, 34, 80])
        word = "".join(rng.choice(letters) for _ in range(size))
        counts[word] = 10_000
        for n in (900, 90, 900, 5):
            word = edited(word, rng, letters)
            counts[word] = n
    counts |= {"a" * n: 10 ** (n % 4) for n in range(6, 40)}
    frame = spark.createDataFrame([*counts.items(), (None, 4), ("a" * 7, 5)], "word string, n long").selectExpr("*", "'x' AS form", "1 AS key", "'y' AS root")
    counts["a" * 7] += 5
    got = sorted([tuple(r) for r in spelling.spelling_groups(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()])
    assert got == groups_by_hand(counts)
    assert any(f and f != r for _, f, r, *_ in got)  # chains of more than one step


@pytest.mark.parametrize("symbols", [1, 3, 7])
def test_links_do_not_depend_on_the_alphabet(spark, symbols):
    rng = random.Random(symbols)
    words = {"".join(rng.choice("abcé") for _ in range(rng.choice([7, 8, 33]))) for _ in range(150)}
    words |= {edited(w, rng, "abcé") for w in list(words)[:80]}
    links = spelling.near_links(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), symbols).collect()
    got = [tuple(sorted((r.u, r.v))) for r in links]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_words_of_texts_match_brute_force(docs):
    rng = random.Random(11)
    vocabulary = ["Straßen", "straßen", "çÇelleñ", "variant", "Variants", "x" * 5_000, "abcdef", "÷×÷×÷×÷", "Ālphabets", "it's", "wordone2wordtwo"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(120)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (500, None), (501, ""), (502, "12 34 !!")]
    got = {r.word: r.n for r in spelling.word_counts(docs(rows)).collect()}
    assert got == words_by_hand(rows)


def test_spelling_of_very_long_words_and_empty_tables(docs):
    long = "ab" * 400_000
    rows = [(1, f"{long} {long[:-1]}"), (2, f"{long} {long[:-1]}"), (3, None)]
    got = {r.word: r.n_near for r in spelling.spelling_groups(spelling.word_counts(docs(rows), noise=1 << 40)).collect()}
    assert got == {long: 1, long[:-1]: 1}
    assert spelling.spelling_groups(spelling.word_counts(docs([(1, None)]))).collect() == []


# --- private data ---

LITERAL = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == 1:
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 10 <= len(digits) <= 15


def shapes(hit):
    n = len(re.sub("[^0-9]", "", hit))
    if re.search(r"@|[(\[]at[)\]]", hit):
        return {0}
    if not re.fullmatch(r"[(]?[0-9](?:[ ()./-]{0,2}[0-9])+", hit):
        return {1} if n else set()
    return {k for k, a, b in ((2, 12, 19), (3, 7, 15)) if a <= n <= b}


def private_by_hand(rows, rounds=3, least=0.8, support=8):
    found = []
    for row, (_, text) in enumerate(rows):
        text = (text or "").replace("\x01", "\x02")
        mine = []
        for kind, pattern in enumerate((*LITERAL, private_data.CANDIDATE)):
            all_ = list(re.finditer(pattern, text))
            for i, m in enumerate(all_):
                back = all_[i - 1].start() if i else 0
                gap = all_[i - 1].end() if i else 0
                before = text[max(gap, m.start() - 40) : m.start()]
                before = (text[back:gap] + before)[-40:]
                ahead = all_[i + 1].start() if i + 1 < len(all_) else len(text)
                after = text[m.end() : min(ahead, m.end() + 40)] + (all_[i + 1][0] if i + 1 < len(all_) else "")
                if kind == 4 or valid(kind, m[0]):
                    mine.append((row, kind, m.start(), m.end(), m[0], before, after[:40]))
        base = [x for x in mine if x[1] < 4]
        found += base + [x for x in mine if x[1] == 4 and shapes(x[4]) and not any(b[2] < x[3] and x[2] < b[3] for b in base)]
    edges = set()
    for _, kind, _, _, hit, before, after in found:
        words = lambda s: re.findall(r"[^\W\d_]+(?:0|[^\W\d_])*|0(?:0|[^\W\d_])*|[^\s\w]|_", re.sub("[0-9]+", "0", s.lower()))
        a, b = words(before), words(after)
        l1, l2, r1 = (a or ["^"])[-1], (["^", "^"] + a)[-2] if len(a) > 1 else "^", (b or ["$"])[0]
        edges |= {(p, kind, hit.lower()) for p in (f"{l1} _", f"{l2} {l1} _", f"{l1} _ {r1}")}
    scores = {}
    for _ in range(rounds):
        weight = defaultdict(lambda: [0.0] * 4)
        seeds, unknown = defaultdict(lambda: [0] * 4), Counter()
        for p, kind, hit in edges:
            if kind < 4:
                seeds[p][kind] += 1
            else:
                unknown[p] += 1
                if hit in scores:
                    weight[p][scores[hit][0]] += scores[hit][1]
        good = defaultdict(list)
        for p, n in unknown.items():
            own = [s + w for s, w in zip(seeds[p], weight[p])]
            doubt = (n - sum(weight[p])) * 0.25
            for k in range(4):
                score = round(own[k] / (sum(own) + doubt + 1), 9)
                if score >= least and own[k] >= support:
                    good[p].append((k, score))
        wrong = defaultdict(lambda: 1.0)
        for p, kind, hit in edges:
            if kind == 4:
                for k, score in good[p]:
                    if k in shapes(hit):
                        wrong[hit, k] *= 1 - score
        scores = {}
        for (hit, k), x in sorted(wrong.items()):
            if hit not in scores or round(1 - x, 9) > scores[hit][1]:
                scores[hit] = (k, round(1 - x, 9))
    believed = {h: k for h, (k, s) in scores.items() if s >= least}
    spans = defaultdict(lambda: ([], []))
    for row, kind, start, end, hit, _, _ in found:
        if kind < 4:
            spans[row][0].append((start, kind, end))
        if kind < 4 or hit.lower() in believed:
            spans[row][1].append((start, kind if kind < 4 else believed[hit.lower()], end))
    return [(rows[r][0], sorted(spans[r][0]), sorted(spans[r][1])) for r in range(len(rows))]


def check_private(frame, rows, **how):
    got = private_data.find_private_data(frame, **how).collect()
    plain = sorted([(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in got], key=repr)
    assert plain == sorted(private_by_hand(rows, **({"support": how["least_mentions"]} if "least_mentions" in how else {})), key=repr)
    return plain


ODD = [
    "a@b.com+x@c.de a@b@c@d.com @x.y a.b@c-d.e.f. x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 12.3.4.5.6", "4111 1111 1111 1111, 4111-1111-1111-1112 79927398713 4111  1111",
    "+1 (212) 555-0100, ++49 30 1234567 +1 2 +12 3 +4930(123)45.67-8 ", "+1 212 555 0100 4111111111111111 5500000000000004 5500 0000 0000 0004",
    "\x01a@b.co\x01 \x02 1.1.1.1\x01", "日本a@b.jp語 ñandú.x@y.zz ￼𝒳 +1 212 555 0199", "", None, "   ", "4111111111111111" * 3, "0" * 40, ".@.a.b", "jörg@müller.de, jo (at) mail [dot] org",
    "2001:db8::1 12:30:45 ::1 fe80:0:0:0:1:2:3:4 :::: 10:20:30:40", "tel=0301234567; (030) 123-4567. 030/1234567@home 1234567a b1234567",
]


def test_base_matches_equal_the_literal_forms(docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[0])]
    check_private(docs(rows), rows)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab1 2@.+-()5:é_\n") for _ in range(300))) for i in range(150)]
    check_private(docs(rows), rows)


def test_context_discovers_unseen_identifiers_and_chance_words_do_not(docs):
    rng, rows = random.Random(6), []
    number = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    local = lambda: f"0{rng.randrange(100, 999)} {rng.randrange(10**6, 10**7)}"
    for i in range(40):
        rows.append((len(rows), f"word {i} Phone: {number()} and more"))
        rows.append((len(rows), f"some text mail to u{i}@site{i}.org now"))
        rows.append((len(rows), f"it took {rng.randrange(10**8, 10**9)} steps, the {number()}; the 10.0.0.{i}"))
    unseen = local()
    rows += [(len(rows) + i, f"Phone: {x} today") for i, x in enumerate([unseen, local(), local()])]
    rows += [(900, f"later {unseen} again"), (901, "mail to jörg@müller.de now"), (902, "the 030 1234567 is a count"), (903, "order 0301234567")]
    rows += [(910 + i, f"Tel {unseen}") for i in range(3)] + [(920 + i, f"Tel {number()}") for i in range(12)] + [(940, "Tel 0999 7654321")]
    got = {doc: (base, spans) for doc, base, spans in check_private(docs(rows), rows)}
    added = {doc: len(spans) - len(base) for doc, (base, spans) in got.items() if spans != base}
    assert {900, 901, 910, 940} <= set(added) and not {902, 903} & set(added)


def test_chains_of_patterns_need_several_rounds(docs):
    rows = [(i, f"fax: +1 212 555 {1000 + i} end") for i in range(30)]
    rows += [(100 + i, f"fax: 030 55500{i:02d} end") for i in range(12)] + [(200 + i, f"ring 030 55500{i:02d} soon") for i in range(12)]
    rows += [(300, "ring 040 9990001 soon")]
    got = {doc: spans for doc, _, spans in check_private(docs(rows), rows)}
    assert got[300]
    assert not {r.doc_id: r.spans for r in private_data.find_private_data(docs(rows), rounds=1).collect()}[300]


def test_private_data_of_long_texts_is_linear_and_empty_tables_have_none(docs):
    rows = [(1, "a" * 2_000_000 + "@"), (2, "a@" + "b.c" * 300_000), (3, "1" * 2_000_000), (4, "1.2" * 400_000), (5, "+1" + " " * 1_000_000 + "2"), (6, "1 2-" * 300_000), (7, "é" * 1_000_000 + "@1"), (8, ":1" * 300_000 + "@")]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in private_data.find_private_data(docs(rows)).collect()}
    assert got[2] == [(0, 0, len(rows[1][1]))] and got[1] == got[3] == got[5] == got[6] == got[7] == []
    assert private_data.find_private_data(docs([])).collect() == []


def test_private_data_keeps_no_python_on_its_path(docs):
    frame = private_data.find_private_data(docs([(1, "Phone: +1 212 555 0100")]), carry=("lang",))
    assert frame.columns == ["doc_id", "lang", "base", "spans"]
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", frame._jdf.queryExecution().executedPlan().toString())


def test_queries_of_the_three_operators_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in plans.table(spark, SF, "documents").collect()]
    names = private_data.KINDS
    line = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    want = sorted((d, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(line(base).encode()).hexdigest(), line(spans)) for d, base, spans in private_by_hand(docs))
    got = plans.op13_bootstrapped_pii(spark, SF).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert sorted(map(tuple, got)) == want
    counts = words_by_hand(docs)
    assert {r.word: r.n for r in plans.op12_spelling_groups(spark, SF).collect()} == counts
    rows = [(r.vec_id, r.embedding, r.label) for r in plans.table(spark, SF, "embeddings").collect()]
    coded, digest = codes_by_hand(rows, 8, 16, 6, 4096)
    got = plans.op11_block_codes(spark, SF).collect()
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=repr) == coded and {r.codebooks_sha256 for r in got} == {digest}
    scratch.release(spark)
