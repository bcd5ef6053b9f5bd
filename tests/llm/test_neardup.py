import random
import re
from fractions import Fraction

import numpy as np

from inkweave.llm import neardup
from inkweave.llm.bitslice import add, close_pairs, unpacked
from inkweave.llm.neardup import near_duplicates, sketches
from inkweave.llm.queries import p1_classes, p1_found

WORD = re.compile(r"[^\W_]+")


def brute(rows, num, den, least):
    sets = {}
    for k, t in rows:
        w = set(WORD.findall((t or "").lower()))
        if k is not None and len(w) >= max(least, 1):
            sets[k] = w
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])}


def made(seed, n, vocabulary, size):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 8)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(vocabulary)}"
            if rng.random() < 0.3:
                rng.shuffle(words)
            rows.append((f"r{i:03d}", " ".join(words)))
        else:
            rows.append((f"r{i:03d}", " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(rng.randrange(*size)))))
    return rows


def test_carry_save_counters():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << 63, (100, 3), np.uint64)
    counters = add(add([], rows[:37]), rows[37:])
    total = sum(unpacked(c).astype(int) << k for k, c in enumerate(counters))
    assert (total == sum(unpacked(r).astype(int) for r in rows)).all()


def test_blocks_lose_no_similar_pair():
    rng = np.random.default_rng(2)
    sets = [rng.choice(300, rng.integers(20, 60), replace=False) for _ in range(40)]
    for i in range(0, 40, 2):
        sets[i + 1] = np.unique(np.append(sets[i][rng.random(len(sets[i])) < 0.93], rng.integers(0, 300, 2)))
    group = np.repeat(np.arange(4), [1, 20, 17, 2])
    sets = [sets[i] for i in sorted(range(40), key=lambda i: (group[i], len(sets[i])))]
    bounds = np.append(0, np.cumsum([len(s) for s in sets]))
    i, j = close_pairs(group, np.diff(bounds), np.ones(40, bool), sketches(np.concatenate(sets).astype(np.int64), bounds), 7, 10)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if group[a] == group[b] and jaccard(sets[a], sets[b]) >= 0.7}
    assert want and want <= got and len(got) < 3 * len(want)
    # Half of them don't lead: of a pair the smaller one must.
    lead = rng.random(40) < 0.5
    order = np.lexsort((np.diff(bounds), ~lead, group))
    mixed_up = [sets[k] for k in order]
    bounds = np.append(0, np.cumsum([len(s) for s in mixed_up]))
    i, j = close_pairs(group[order], np.diff(bounds), lead[order], sketches(np.concatenate(mixed_up).astype(np.int64), bounds), 7, 10)
    assert {tuple(sorted((order[a], order[b]))) for a, b in zip(i, j)} >= {(a, b) for a, b in want if lead[a]}
    assert all(lead[order[a]] and len(mixed_up[a]) <= len(mixed_up[b]) for a, b in zip(i, j))


def test_against_brute_force(spark, monkeypatch):
    for seed, n, vocabulary, size, counted, block, long in ((1, 150, 400, (20, 60), 1 << 20, 4096, 256), (2, 150, 90, (26, 40), 1 << 12, 16, 256), (2, 150, 90, (1, 40), 64, 2, 256), (3, 100, 3000, (20, 300), 1 << 10, 64, 60), (4, 150, 300, (3, 50), 1 << 12, 6, 30)):
        monkeypatch.setattr(neardup, "SLOTS", counted)
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "LONG", long)
        rows = made(seed, n, vocabulary, size)
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, description string, rep int, words string")
        for threshold, least in ((("0.7", 24), ("0.8", 1)) if seed in (1, 4) or block == 2 else (("0.7", 24),)):
            f = Fraction(threshold)
            want = brute(rows, f.numerator, f.denominator, least)
            got = [tuple(r) for r in near_duplicates(df, "id", "description", threshold, least).pairs().collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_large_classes_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MANY", 7)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(f"a{i:02d}", text) for i in range(40)] + [(f"b{i}", text + " more") for i in range(9)] + [("c", text + " most")]
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", "0.7", 24).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 7, 10, 24)


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("a", text), ("a", text), ("b", text.upper()), ("c", None), ("d", ""), (None, text), ("e", "w1 w2"), ("f", text + " more")]
    df = spark.createDataFrame(rows, "id string, text string")
    found = near_duplicates(df, "id", "text", "0.7", 24)
    assert {tuple(r) for r in found.pairs().collect()} == {("a", "b"), ("a", "f"), ("b", "f")}
    assert {tuple(r) for r in found.classes().collect()} == {("a", "a", 1), ("b", "a", 1), ("f", "f", 1)}
    assert near_duplicates(df.limit(0), "id", "text").pairs().count() == 0


def test_queries_against_brute_force(spark, data):
    ideas = {(r.id, r.description) for r in spark.read.parquet(f"{data}/base_ideas.parquet").collect()}
    ideas |= {(r.decision_id, r.idea.idea if r.idea else None) for r in spark.read.parquet(f"{data}/decisions.parquet").collect()}
    got = [tuple(r) for r in p1_found(spark, data).collect()]
    assert got and len(got) == len(set(got))
    want = brute(sorted(ideas, key=lambda r: (str(r[0]), r[1] or "")), 7, 10, 24)
    assert set(got) == want
    assert {r.rec for r in p1_classes(spark, data).collect()} >= {x for p in want for x in p}
