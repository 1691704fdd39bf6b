"""The stages of the text pipeline against brute force on a small table."""

import random

import numpy as np
import pytest

from ledgerlight.llm import language, plans, scratch, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(5)


def made_rows():
    rng = random.Random(3)
    word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(12):  # near copies: one word of many changed
        base = word(400).split()
        for _ in range(4):
            changed = list(base)
            changed[rng.randrange(400)] = word(1)
            rows.append((rng.randrange(10**9), " ".join(changed), "s"))
    rows += [(rng.randrange(10**9), word(60), "s") for _ in range(30)]
    rows += [(500 + i, "one and the same text", "s") for i in range(40)]
    rows += [(1, None, "s"), (2, " ", "s"), (3, "ONE and the same text", "s"), (4, "a", "t"), (4, "a", "s"), (4, "quite other words", "s"), (None, "a", "s"), (None, "words without an id", "s")]
    return rows


def test_near_duplicate_stage_matches_brute_force(spark):
    rows = made_rows()
    prints = simhash.fingerprints([t for _, t, _ in rows], 3)
    group = list(range(len(rows)))
    while True:
        before = list(group)
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if int(np.bitwise_count(a ^ b)) <= 3:
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or "", rows[i][2]))
    first = {}
    for i in order:
        first.setdefault(group[i], i)
    want = [rows[i] for i in first.values()]
    assert len(want) < len(rows) - 60
    got = STAGES["simhash_near_dedup"](spark, frame(spark, rows), SF)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted([(r.doc_id, r.text, r.source) for r in got.collect()], key=repr) == sorted(want, key=repr)


def test_language_stage_keeps_what_the_model_is_sure_of(spark):
    docs = plans.table(spark, SF, "documents")
    odd = frame(spark, [(10**6, None, "s"), (10**6 + 1, "123 !!", "s"), (10**6 + 2, "", "s")])
    both = docs.unionByName(odd.select(*docs.columns))
    model = language.train(both.where(~language.in_fold("doc_id")))
    rows = both.collect()
    _, scores = language.score([r.text or "" for r in rows], model)
    want = sorted(r.doc_id for r, s in zip(rows, scores) if any(map(str.isalpha, r.text or "")) and s >= corpus_pipeline.LEAST_SCORE)
    got = STAGES["language_id"](spark, both.selectExpr("*", "1 AS score", "'x' AS lang_pred"), SF)
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(rows)


def test_repeat_stage_matches_brute_force(spark):
    rng = random.Random(8)
    line = "this passage of more than fifty bytes stands in several documents"
    rows = [(i, f"{rng.random()} {line if i % 3 else ''} {rng.random()}", "s") for i in range(30)] + [(50, line, "s"), (51, line, "s"), (60, None, "s"), (61, "", "s"), (None, line, "s")]
    seen, want = set(), []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        grams = [data[p : p + 50] for p in range(len(data) - 49)] if i is not None else []
        gone = np.zeros(len(data), bool)
        for p, g in enumerate(grams):
            if g in seen:
                gone[p : p + 50] = True
        seen |= set(grams)
        left = bytes(b for b, x in zip(data, gone) if not x).decode()
        if not gone.any() or left.strip():
            want.append((i, None if text is None else left))
    got = STAGES["suffix_array_dedup"](spark, frame(spark, rows), SF).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted(want, key=repr)


def test_benchmark_stage_removes_passages_and_keeps_clean_documents(spark):
    item = next(r.text for r in plans.table(spark, SF, "benchmark").collect() if len((r.text or "").split()) >= 15)
    rows = [(1, f"Alpha beta. {item} Gamma delta.", "s"), (2, item, "s"), (3, "clean words, all of them", "s"), (4, None, "s"), (5, "", "s"), (3, "clean words, all of them", "s")]
    got = {(r.doc_id, r.text) for r in STAGES["benchmark_decontamination"](spark, frame(spark, rows), SF).collect()}
    assert {(3, rows[2][1]), (4, None), (5, "")} <= got and not any(i == 2 for i, _ in got)
    left = next(t for i, t in got if i == 1)
    assert left.startswith("Alpha beta.") and left.rstrip().endswith("Gamma delta.") and " ".join(item.split()[:10]) not in left


def test_stages_pass_empty_tables(spark):
    for name in ("simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"):
        assert STAGES[name](spark, frame(spark, [(1, "x", "s")]).limit(0), SF).count() == 0, name


def test_whole_run(spark):
    source = plans.table(spark, SF, "documents")
    docs, before = source, source.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, SF), "test-stage")
        assert docs.columns == source.columns and docs.dtypes == source.dtypes, name
        after = docs.count()
        assert 0 < after <= before, name
        before = after
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == before
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
