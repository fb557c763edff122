"""Operators that compare texts with one another, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontam, jaccard, suffixes

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(-1, None), (-2, ""), (-3, " \n"), (-4, "one two"), (-5, "ONE two"), (-6, "one two three"), (-7, "x" * 3000), (-8, "same words in a row here"), (-8, "same words in a row here"), (-9, "z " * 2000)]


def near_copies(seed, sizes=(40, 25), random_texts=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    edit = lambda words, rate: [rng.choice(vocabulary) if rng.random() < rate else w for w in words]
    rows = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for size in sizes:
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            rows.append(" ".join(edit(base, rng.choice([0, 0.01, 0.02, 0.04]))))
    rows += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([4, 15, 90]))]) for _ in range(random_texts)]
    rng.shuffle(rows)
    return list(enumerate(rows)) + ODD


def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


@pytest.mark.parametrize("config", [{}, {"SHORT_LIST": 2, "ROW_BLOCK": 3, "COLUMN_BLOCK": 50}, {"SHORT_LIST": 2, "FAMILY_BLOCK": 10, "COMMON": 1, "FREQUENT": 2}, {"FREQUENT": 10**9, "SHORT_LIST": 4, "LEADERS": 1}, {"FREQUENT": 2, "HOT": 2, "FAMILY_SHINGLES": 200, "HELD_SHINGLES": 500}, {"FREQUENT": 2, "HOT": 1, "BROADCAST_SHINGLES": 0, "BROADCAST_FAMILIES": 0, "BROADCAST_NODES": 0, "LOCAL_EDGES": 0}])
def test_jaccard_classes(spark, monkeypatch, config):
    for name, value in config.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"node": F.lit("x"), "n_shingles": F.lit(0.5), "component": F.lit(1)})
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df).collect())
    assert got == brute_classes(rows)


def test_blocks_skip_only_what_cannot_match():
    """Against every pair of a list, by sizes and by what is left behind the places."""
    rng = np.random.default_rng(5)
    t, num, den = jaccard.THRESHOLD, 3, 4
    size = rng.integers(4, 60, 400)
    place = np.array([rng.integers(0, jaccard._prefix_length(int(n), t)) for n in size])
    run, node = rng.integers(0, 30, 400), rng.integers(0, 300, 400)
    order = np.lexsort((node, place, size, run))
    node, size, place, run = node[order], size[order], place[order], run[order]
    want = []
    for i in range(400):
        for j in range(i + 1, 400):
            if run[i] == run[j] and node[i] != node[j] and den * size[i] >= num * size[j]:
                left = min(size[i] - place[i], size[j] - place[j]) + jaccard.COMMON - 1
                if left * (den + num) >= num * (size[i] + size[j]):
                    want.append((min(node[i], node[j]), max(node[i], node[j]), min(jaccard.COMMON, -(-num * size[j] // den))))
    got = np.concatenate(jaccard._open_pairs(node, size, place, run, t), axis=1)
    assert sorted(map(tuple, got.T.tolist())) == sorted(want) and len(want) > 50


def test_jaccard_null_ids(spark):
    base = [f"w{k}" for k in range(60)]
    copy, near = " ".join(base), " ".join([*base, "tail"])
    rest = [f"v{k}" for k in range(60)]
    rows = [(None, copy), (7, copy), (9, near), (None, " ".join(rest)), (5, " ".join([*rest, "end"])), (None, "nothing like it at all in here"), (3, None), (None, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("None", 56, "7"), ("7", 56, "7"), ("9", 57, "7"), ("None", 56, "5"), ("5", 57, "5"), ("None", 3, "None"), ("3", 0, "3"), ("None", 0, "None")])


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_classes(df).count() == 0


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long"), local_edges=local).collect()}
    for node in {x for p in pairs if p[0] != p[1] for x in p}:
        assert got.get(node, node) == find(node)


def test_components_must_converge(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="contracted"):
        jaccard.components(chain, rounds=2, local_edges=0)


def brute_repeats(rows, length=400, passage=51):
    count, holders = collections.Counter(), collections.defaultdict(set)
    data = [(i, (t or "").encode(), WORD.findall(t or "")) for i, t in rows]
    for row, (_, b, w) in enumerate(data):
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
        for k in range(len(w) - passage + 1):
            holders[tuple(w[k : k + passage])].add(row)
    n_runs = lambda mask: int((np.diff(np.r_[0, mask.astype(np.int8)]) == 1).sum())
    out = []
    for i, b, w in data:
        gone, again = np.zeros(len(b), bool), np.zeros(len(w), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        for k in range(len(w) - passage + 1):
            if len(holders[tuple(w[k : k + passage])]) > 1:
                again[k : k + passage] = True
        out.append((i, len(b), int(gone.sum()), n_runs(gone), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int(again.sum()), n_runs(again)))
    return sorted(out)


REPEATS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages"]
#: Usual bounds; small blocks and every bucket whole; every bucket split by window.
BOUNDS = [suffixes.DEFAULT, suffixes.Bounds(chunk=500, samples=20, kept=2000, block=1 << 12, hot=1 << 40), suffixes.Bounds(samples=50, kept=5000, hot=2), suffixes.Bounds(hot=3, hot_grams=5)]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_repeats(spark, bounds):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("xyzw é") for _ in range(n))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = ODD + [(1, "a" * 3000), (2, noise(300) + passage[:500] + noise(100)), (3, noise(50) + passage[90:] + noise(500)), (4, passage[:399]), (5, passage[200:599] + noise(9)), (6, passage[200:600] + noise(9)), (7, "ab" * 400), (8, noise(450) * 3), (9, passage[:450] + passage[300:880])]
    rows += [(10 + k, noise(rng.randrange(0, 300)) + passage[k * 7 : k * 7 + 420 + k] + noise(60)) for k in range(25)] + [(60, rows[-1][1]), (61, noise(2000)), (62, "ß" * 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "cls": F.lit("x"), "n_bytes": F.lit(2)})
    assert sorted(tuple(r) for r in suffixes.remove_repeats(df, bounds=bounds).select(REPEATS).collect()) == brute_repeats(rows)


@pytest.mark.parametrize("bounds", BOUNDS)
def test_passages_of_over_fifty_words(spark, bounds):
    """Shorter than 400 bytes, in other white space; shared by many; repeated in one text alone; runs of one word."""
    rng = random.Random(19)
    prose = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n)]
    one, two, own = prose(51), prose(70), prose(60)
    rows = [(1, " ".join(prose(30) + one + prose(9))), (2, "\n".join(prose(12) + one + prose(40))), (3, " ".join(one[:50] + prose(40))), (4, " ".join(own + prose(5) + own)), (5, "the " * 300), (6, " ".join(["the"] * 51 + prose(20))), (7, "so " * 200)]
    rows += [(10 + k, " ".join(prose(rng.randrange(60)) + two[k % 5 : 60 + k % 9] + prose(rng.randrange(60)))) for k in range(30)] + [(50, rows[0][1]), (51, " ".join(prose(51))), (52, rows[0][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in suffixes.remove_repeats(df, bounds=bounds).select(REPEATS).collect()) == brute_repeats(rows)


def test_repeats_of_one_text_and_long_chunks(spark):
    rng = random.Random(10)
    noise = "".join(rng.choice("abcdef") for _ in range(3000))
    rows = [(1, noise[:2500] + "#" + noise[700:1900]), (2, None)]
    got = sorted(tuple(r) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bounds=suffixes.Bounds(chunk=700)).collect())
    assert got == brute_repeats(rows)
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_null_ids(spark):
    rng = random.Random(15)
    noise = lambda n: "".join(rng.choice("xyzw ") for _ in range(n))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(None, noise(200) + passage + noise(100)), (1, noise(90) + passage[100:] + noise(50)), (None, noise(700)), (None, None)]
    got = [tuple(r) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(rows[r[0]][0], *r[1:]) for r in brute_repeats([(k, t) for k, (_, t) in enumerate(rows)])]
    assert sorted(got, key=str) == sorted(want, key=str)


def grams(text):
    w = WORD.findall((text or "").lower())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def brute_leaks(rows, items):
    out = {}
    for i, text in rows:
        g = grams(text)
        for item, t in items:
            q = grams(t)
            for start in range(-len(q) + 1, len(g)):
                w = collections.Counter(g[max(0, start) : start + len(q)])
                it = collections.Counter(q)
                if q and sum((w | it).values()) and (s := sum((w & it).values()) / sum((w | it).values())) >= 0.75:
                    out[i, item] = max(out.get((i, item), 0), round(s, 9))
    return out


def test_decontamination(spark):
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([6, 20, 40]))) for k in range(30)] + [(100, None), (101, "too short"), (102, "a b a b a b a b a b a b"), (0, "again " + text(20))]
    rows = list(ODD)
    for k in range(60):
        words = items[k % 30][1].split()
        if k % 3 == 1 and len(words) > 10:
            words[len(words) // 2] = "edited"
        if k % 3 == 2:
            words = words[: len(words) // 2]
        rows.append((k, f"{text(rng.choice([0, 50]))} {' '.join(words).upper() if k % 2 else ' '.join(words)} {text(rng.choice([0, 30]))}"))
    rows += [(500, "a b a b a b a b a b a b"), (501, text(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "start": F.lit(1), "grams": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontam.contaminations(df, bench).collect()}
    assert got == brute_leaks(rows, items)
    kept = {r["doc_id"] for r in decontam.decontaminated(df, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontam.contaminations(df, bench.where("false")).count() == 0 and decontam.contaminations(df.where("false"), bench).count() == 0


def test_large_benchmarks_and_many_windows_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(f"t{k}_{j}" for j in range(12))) for k in range(12)]
    rows = [(k, f"before {t} after") for k, t in items] + [(100, " ".join(t for _, t in items)), (None, items[0][1]), (None, items[1][1] + " end"), (3, items[4][1])]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(str(k), k) for k in range(12)] + [("100", k) for k in range(12)] + [("None", 0), ("None", 1), ("3", 4)])
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.contaminations(df, bench).collect()) == want
    for name, value in (("BROADCAST_PLACES", 3), ("BROADCAST_TEXTS", 3), ("BROADCAST_ITEMS", 3), ("CHUNK", 2)):
        monkeypatch.setattr(decontam, name, value)
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.contaminations(df, bench).collect()) == want


def test_recall_near_the_threshold(spark):
    """Against brute force, on passages whose best window has a similarity of 0.75 to 0.85."""
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    items = [(k, " ".join(text(rng.choice([30, 60, 90])))) for k in range(60)]
    rows = []
    for k in range(600):
        words = items[k % 60][1].split()
        for _ in range(rng.choice([1, 1, 2, 2])):
            words[rng.randrange(len(words))] = "edited"
        rows.append((k, " ".join(text(20) + words + text(20))))
    want = {}
    for k, t in rows:  # edits keep places: the windows to compare are those that share a shingle's place
        g, q = grams(t), grams(items[k % 60][1])
        best = max(sum((collections.Counter(g[s : s + len(q)]) & collections.Counter(q)).values()) / sum((collections.Counter(g[s : s + len(q)]) | collections.Counter(q)).values()) for s in (19, 20, 21))
        if 0.75 <= best <= 0.85:
            want[k] = round(best, 9)
    got = {r["doc_id"]: round(r["similarity"], 9) for r in decontam.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 100 and sum(got.get(k) == v for k, v in want.items()) >= 0.99 * len(want)


def test_short_items_are_found_verbatim(spark):
    items = [(1, "Blue  moon"), (2, "zebra"), (3, "a b c d"), (4, ""), (5, None), (6, "one two three four five"), (7, "blue moon")]
    rows = [(1, "under the\nblue MOON tonight"), (2, "blue sky moon"), (3, "a b c d"), (4, "a b c"), (5, "zebra"), (6, "zebras"), (7, None), (8, "one two three four five"), (9, "x a b c d a b c d zebra")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start"], r["n_words"], r["similarity"]) for r in decontam.contaminations(df, bench).collect())
    assert got == [(1, 1, 2, 2, 1.0), (1, 7, 2, 2, 1.0), (3, 3, 0, 4, 1.0), (5, 2, 0, 1, 1.0), (8, 6, 0, 5, 1.0), (9, 2, 9, 1, 1.0), (9, 3, 1, 4, 1.0)]
    assert {r["doc_id"] for r in decontam.decontaminated(df, bench).collect()} == {2, 4, 6, 7}


def test_multi_index_finds_everything_within_the_radius():
    rng = random.Random(13)
    masks = set(decontam.neighbours())
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(0, decontam.RADIUS + 1)):
            b ^= 1 << bit
        assert any(((a ^ b) >> (8 * k)) & 255 in masks for k in range(8))
