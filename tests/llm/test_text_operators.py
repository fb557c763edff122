"""Operators that judge each text alone, against brute force and on odd input."""

import hashlib

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import html_text, langid, license, packing, pii, quality, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "x" * 50_000), (6, "a b c d e " * 3000), (7, "same text here"), (7, "same text here"), (8, "é ü ß 日本語。"), (None, "no id at all")]


def odd(spark, extra=True):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"n_words": F.lit("clash"), "length": F.lit(1.5), "kept": F.lit(None).cast("int"), "lang": F.lit(None).cast("string")}) if extra else df


def empty(spark):
    return odd(spark).where("false")


def test_quality_measures(spark):
    rng = random.Random(1)
    texts = ["\n".join(" ".join(rng.choice("ab cd ef #x $$ the | de".split()) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 12))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        text = text or ""
        words, seen, where = WORD.findall(text), {}, set()
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k : k + 3]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                where |= {p + d for p in at for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(where))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, text[:80])
        assert r["base_failed"] == (len(words) < 50 or 100 * len(where) > 50 * len(words))


def test_quality_odd_input(spark):
    assert quality.quality_rules(odd(spark)).count() == len(ODD)
    assert quality.quality_rules(empty(spark)).count() == 0
    clean = " ".join(f"the{k} of and word{k}" for k in range(30))
    assert quality.quality_rules(spark.createDataFrame([(1, clean)], "doc_id long, text string")).first()["kept"]


def test_quality_plan_has_no_python_and_no_shuffle(spark):
    plan = quality.quality_rules(odd(spark, False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_pii_base_spans():
    rng = random.Random(2)
    pieces = ["a@b.c", "@", ".", "x", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "+1 (839) 555-1724", "+", " ", "-", "12", "é", "a.b@c-d.e.f", "1.2.3.4.5.6.7.8"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert sorted([s[:3] for s in pii.spans(text) if s[3]], key=lambda s: (s[1], s[0])) == brute_spans(text), text


def test_pii_learns_secrets_and_masks(spark):
    rng = random.Random(3)
    made = []
    for k in range(60):
        made.append((k, f"plain words {k} here", 0))
        made.append((100 + k, f'x token = "{hashlib.sha1(str(k).encode()).hexdigest()}" y', 1))
        made.append((200 + k, f"mail me at u{k}@mail{k % 7}.example.com or +1 (212) 555-{1000 + k} from {rng.randrange(1, 255)}.2.3.4", 0))
    df = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    assert all(got[k]["spans"] == "" and got[k]["n_spans"] == 0 for k in range(60)) and got[100]["n_spans"] == 1
    assert all("secret:" in got[100 + k]["spans"] for k in range(60))
    assert got[205]["n_email"] == got[205]["n_phone"] == got[205]["n_ip"] == 1
    masked = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert masked[105] == 'x token = "[SECRET]" y' and masked[5] == "plain words 5 here" and masked[205] == "mail me at [EMAIL] or [PHONE] from [IP]"


def test_pii_odd_input(spark):
    got = pii.detect(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.detect(empty(spark)).count() == 0
    kept = pii.masked(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)


def test_em_separates_reliable_from_noisy_labelers():
    good, bad = pii._pattern(0, (1, 1, 1, 0, 0, 1), 20), pii._pattern(0, (-1, -1, -1, 0, 0, -1), 20)
    posterior, _ = pii.reliabilities({good: 500, bad: 500})
    score = pii.span_classifier([good] * 50 + [bad] * 50, [[1, 2, 3, 4, 5]] * 50 + [[6, 7, 8, 9, 10]] * 50, posterior).scorer()
    assert posterior[good] > 0.9 > 0.1 > posterior[bad]
    assert score({"pattern": good, "features": [1, 2, 3, 4, 5]}) > 0.5 > score({"pattern": bad, "features": [6, 7, 8, 9, 10]})
    assert pii.reliabilities({})[0] == {}


def test_span_classifier_sees_more_than_the_votes():
    """Of candidates with the same votes, those that look and stand like personal ones score higher."""
    yes, no, unsure = pii._pattern(4, (1, 1, 1, 1, 0, 1), 32), pii._pattern(4, (0, -1, -1, 0, -1, -1), 32), pii._pattern(4, (0, 1, -1, 0, 0, 1), 32)
    like, unlike = [11, 12, 13, 14, 15], [21, 22, 23, 24, 25]
    score = pii.span_classifier([yes] * 90 + [no] * 90 + [unsure] * 20, [like] * 90 + [unlike] * 100 + [like] * 10, {yes: 0.99, no: 0.01, unsure: 0.5}).scorer()
    assert score({"pattern": unsure, "features": like}) > score({"pattern": unsure, "features": unlike})


def test_many_spans_in_one_text():
    import time

    def seconds(n):
        text = " ".join(f"a{k}@b{k}.com key {k:040x} +1 212 555 {k:06d}" for k in range(n))
        began = time.process_time()
        found = pii._accept(pii._described(text), lambda s: 1.0)
        return len(found), time.process_time() - began

    n, took = seconds(33_400)
    assert n >= 100_000 and took < 20 * max(0.2, seconds(3_340)[1])  # quadratic work would take 100 times as long


def test_overlapping_candidates_go_to_the_first():
    span = lambda kind, start, end, base: {"kind": kind, "start": start, "end": end, "base": base, "pattern": 0}
    found = [span(4, 0, 9, False), span(5, 3, 6, False), span(0, 8, 20, True), span(2, 9, 12, True), span(5, 20, 25, False), span(4, 20, 30, False), span(5, 25, 27, False)]
    assert [(s["kind"], s["start"]) for s in pii._accept(found, lambda s: 0.9)] == [(5, 3), (0, 8), (2, 9), (5, 20), (5, 25)]
    assert [(s["kind"], s["start"]) for s in pii._accept(found, lambda s: 0.1)] == [(0, 8), (2, 9)]


def test_language(spark):
    rng = random.Random(4)
    syllables = {"aa": "ba lo mi ta re".split(), "bb": "krz schn pft gru ack".split()}
    rows = [(k, " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(2, 5))) for _ in range(30)), lang) for k in range(200) for lang in [("aa", "bb")[k % 2]]]
    rows += [(1000 + k, t, None) for k, (_, t) in enumerate(ODD)] + [(2000, "12 !! 34", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    for i, _, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if i < 200:
            assert got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1
    for i in (1000, 1001, 1002, 2000):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert langid.identify(df.where("false")).count() == 0
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.where("lang_pred <> 'und'").count() == 0
    assert langid.relabelled(df.where("doc_id is not null")).where("doc_id = 2000").count() == 0


def test_forward_sums_all_segmentations():
    import numpy as np

    path = langid.default_vocabulary()
    vocabulary = langid.pieces(path)
    theta = np.random.default_rng(0).random((len(vocabulary) + 2, 2)) * 1e-3
    theta[-2], theta[-1] = langid.UNKNOWN, 0

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, min(langid.LONGEST_PIECE, len(word)) + 1):
            at = vocabulary.get(word[:k], len(vocabulary) if k == 1 else None)
            if at is not None:
                out = out + theta[at] * total(word[k:])
        return out

    words = ["▁hello", "▁straße", "▁the", "▁日本", "▁entende"]
    got = langid.log_probabilities(words, path, theta)
    for w, g in zip(words, got, strict=True):
        assert np.allclose(g, np.log(total(w)))
    counts = langid.expected_counts(["▁the", "▁the"], np.array([1.0, 2.0]), path, theta[:, 0])
    assert counts.sum() > 0 and np.isclose(sum(len(p) * counts[k] for p, k in vocabulary.items() if counts[k]), 3 * 4)


def test_long_words_go_by_blocks(monkeypatch):
    """The same sums and expected counts whatever the block; nothing underflows in a word of 20,000 letters."""
    import numpy as np

    path = langid.default_vocabulary()
    theta = np.random.default_rng(1).random((len(langid.pieces(path)) + 2, 3)) * 1e-3
    theta[-2], theta[-1] = langid.UNKNOWN, 0
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("aeinrst") for _ in range(n)) for n in (1, 15, 16, 17, 60, 60, 333)] + ["▁日本語", "▁" + "ab" * 10_000]
    times = np.arange(1.0, len(words) + 1)
    whole, counts = langid.log_probabilities(words, path, theta), langid.expected_counts(words, times, path, theta[:, 1])
    monkeypatch.setattr(langid, "BLOCK", 16)
    monkeypatch.setattr(langid, "TOGETHER", 100)
    assert np.allclose(langid.log_probabilities(words, path, theta), whole) and np.isfinite(whole).all()
    assert np.allclose(langid.expected_counts(words, times, path, theta[:, 1]), counts)
    sizes = np.array([len(p) for p in langid.pieces(path)] + [1, 0])
    assert np.isclose((counts * sizes).sum(), sum(t * len(w) for t, w in zip(times, words, strict=True)))


def test_language_caches_may_overflow(monkeypatch):
    import base64

    import numpy as np
    import pyarrow as pa

    path = langid.default_vocabulary()
    theta = np.random.default_rng(2).random((len(langid.pieces(path)) + 2, 2)) * 1e-3
    theta[-2], theta[-1] = langid.UNKNOWN, 0
    rng = random.Random(4)
    blob = base64.b64encode(rng.randbytes(40_000)).decode()  # one word of thousands of letter runs
    texts = [blob, "½ ² 3 ①", "½x", "a" * 3000, None, "", *(" ".join(blob[rng.randrange(9000) :][:9] for _ in range(60)) for _ in range(40)), blob + " " + blob]
    want = langid._predictor(["a", "b"], theta, path)(pa.array(texts))
    assert want[0][1] == want[0][4] == "und" and want[0][2] != "und" and want[2][0] > 1000 and want[2][-1] == 2 * want[2][0]
    for name, value in (("PART_WORDS", 9), ("PART_RUNS", 11), ("TEXT_BYTES", 300), ("CACHED_BYTES", 50)):
        monkeypatch.setattr(langid, name, value)
        got = langid._predictor(["a", "b"], theta, path, (7, 5))(pa.array(texts))
        assert got[0] == want[0] and got[2] == want[2] and np.allclose(got[1], want[1])


def test_every_letter_piece_of_the_vocabulary_is_used():
    import sentencepiece

    path = langid.default_vocabulary()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = {p for p in map(model.id_to_piece, range(model.get_piece_size())) if langid.LETTERS.fullmatch(p.removeprefix(langid.START)) and p == p.lower()}
    assert every <= set(langid.pieces(path)) and max(map(len, every)) <= langid.LONGEST_PIECE


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import numpy as np

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    rng = random.Random(5)
    rows = ODD[:-1] + [(100 + k, " ".join(rng.choice(["Hello,", "world's", "naïve", "12.5%%", "ΣΑΣ", "foo_bar", "x" * 30]) for _ in range(rng.choice([3, 300, 900, 6000])))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "piece": F.lit(0.5)})
    got = packing.packed(df).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r)
    for i in {i for i, _ in rows}:
        texts = [t or "" for j, t in rows if j == i]
        ids = np.array(tokenizer.encode(texts[0], add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted(found[i], key=lambda r: (r["piece"], r["sequence_id"], r["offset"]))
        assert len(pieces) == len(texts) * -(-len(ids) // 4096)
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    assert packing.packed(df.where("false")).count() == 0


def test_runs_have_the_ids_that_the_tokenizer_gives():
    """Words of many scripts, of letters that compose or fold, and of any Latin letters, against the whole tokenizer."""
    from array import array

    from tokenizers import Tokenizer

    rng = random.Random(26)
    path = packing.default_vocabulary()
    tokenizer = Tokenizer.from_file(path)
    latin = "".join(chr(c) for c in range(0x41, 0x250) if chr(c).isalpha())
    words = ["".join(rng.choices(latin, k=rng.randrange(1, 12))) + rng.choice(["", ".", ",;", "!?%"]) for _ in range(3000)]
    words += ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 25))) for _ in range(3000)]
    words += ["Привет,", "ΣΑΣ", "σας", "\u1112\u1161\u11ab", "\u212b", "e\u0301t", "\uf900", "日本語。", "İstanbul", "ŉ", "ǅ", "ﬁn", "ſ", "ß", "x²", "a_b", "it's", "don't.", "12.5%"]
    want = [array("I", tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in words]
    assert packing.token_bytes([w.encode() for w in words], path) == want
    assert packing.token_bytes([" ".join(words).encode()], path) == [b"".join(want)]


def test_packing_caches_may_overflow():
    rng = random.Random(25)
    texts = [" ".join(rng.choice(["Hello,", "world's", "naïve", "12.5%%", "ΣΑΣ", "foo_bar", f"w{rng.randrange(300)}.", "x" * 30]) for _ in range(90)).encode() for _ in range(12)] + [b"", ("y" * 200_000).encode()]
    path = packing.default_vocabulary()
    want = [packing.token_bytes([t], path)[0] for t in texts]
    for caches in ((3, 2), (50, 10), (1000, 1)):
        assert [b for t in texts for b in packing.token_bytes([t], path, caches)] == want and packing.token_bytes(texts, path, caches) == want


def test_packing_ties_and_clashing_columns(spark):
    rows = [(1, "same words here")] * 3 + [(None, "same words here"), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"salt": F.lit(1), "rank": F.lit("x"), "offset": F.lit(0.5), "sequence_id": F.lit(7), "ids_crc32": F.lit(1)})
    got = packing.packed(df).collect()
    assert len(got) == 6 and len({r["sequence_id"] for r in got}) == 1
    at = sorted((r["offset"], r["length"]) for r in got)
    assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(6)]


@pytest.mark.parametrize("kind", ["small", "large", "mixed", "thirds"])
def test_packing_is_tight(kind):
    rng = random.Random(6)
    draw = {"small": lambda: rng.randrange(1, 400), "large": lambda: rng.randrange(1500, 4000), "mixed": lambda: min(4096, int(rng.expovariate(1 / 900)) + 1), "thirds": lambda: rng.choice([1365, 1366, 1000, 2049])}[kind]
    histogram = {}
    for _ in range(4000):
        n = draw()
        histogram[n] = histogram.get(n, 0) + 1
    runs = packing.plan(histogram)
    load, ranks = {}, {}
    for length, rank, n, first, offset in runs:
        for k in range(n):
            assert ranks.setdefault((length, rank + k), True)
            load.setdefault(first + k, []).append((offset, length))
    assert len(ranks) == sum(histogram.values())
    for parts in load.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    free, simple = [], 0
    for length in sorted([n for n, c in histogram.items() for _ in range(c)], reverse=True):  # plain best-fit decreasing
        at = min((k for k, room in enumerate(free) if room >= length), key=lambda k: free[k], default=None) if len(free) < 3000 else None
        if at is None:
            free.append(4096 - length)
            simple += 1
        else:
            free[at] -= length
    assert len(load) <= simple * 1.01 + 2


def test_shards(spark):
    rng = random.Random(7)
    rows = ODD + [(100 + k, "copy " * 200) for k in range(300)] + [(500 + k, "w" * rng.randrange(0, 3000)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slot": F.lit("x"), "size": F.lit("y")})
    got = sharding.shard_table(df, 8).collect()
    assert len(got) == len(rows)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8
    for s in range(8):
        assert sorted(r["place"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    # sizes and crcs row by row
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    # copies lie together unless they are more than a shard takes
    homes = {}
    for r in got:
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert {k for k, v in homes.items() if len(v) > 1} == {(1001, zlib.crc32(("copy " * 200).encode()))}
    assert sharding.shard_table(df.where("false"), 8).count() == 0


def test_slots_of_many_small_rows_are_cut(spark, tmp_path):
    """Half of the rows have no text: little in bytes, much to number. The query places by the stored map."""
    rows = [(k, None if k % 2 else f"text {k} " * 9) for k in range(4000)] + [(None, "no id")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_table(df, 4, path=str(tmp_path / "map")).collect()
    stored = sharding.read_map(spark, str(tmp_path / "map")).collect()
    assert {r["version"] for r in stored} == {1} and sum(r["n_rows"] for r in stored) == len(rows)
    hot = [r for r in stored if r["slot"] == next(g["virtual_slot"] for g in got if g["size"] == 1)]
    assert len(hot) >= 32 and max(r["n_rows"] for r in hot) < 2000 / 8 and len({r["shard"] for r in hot}) == 1
    for s in range(4):
        assert sorted(r["place"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    again = sharding.sharded(df, sharding.read_map(spark, str(tmp_path / "map"))).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_rebalancing_moves_few_slots(spark, tmp_path):
    weights = [(k, -1, 1000 + k % 7, 1) for k in range(400)]
    first = sharding.first_map(weights, 8)
    more = sharding.rebalanced(first, weights, 9)
    moved = [(a[1], b[3]) for a in first for b in more if a[1] == b[1] and a[3] != b[3]]
    assert all(to == 8 for _, to in moved) and abs(len(moved) - 400 / 9) < 10
    loads = [sum(r[4] for r in more if r[3] == s) for s in range(9)]
    assert max(loads) < 1.05 * sum(loads) / 9
    for version in (first, more):
        sharding.store_map(spark.createDataFrame(version, sharding.MAP_SCHEMA), str(tmp_path / "map"))
    assert sharding.read_map(spark, str(tmp_path / "map")).select("version").distinct().first()[0] == 2
    assert sharding.read_map(spark, str(tmp_path / "map"), 1).count() == 400


PAGES = {
    "<html><body><nav><ul><li><a>Home</a></li></ul></nav><div class='ad'>buy now please</div><article><h1>T &amp; U</h1><p><b>First   text.<br>x<p>Second<script>var a='</p>'</script> one</article><footer>&copy; me</footer>": ["T & U", "First text. x", "Second one"],
    "<div id=wrap><header><h1>Site</h1></header><div class=content><h2>Head</h2><p>" + "long text " * 30 + "</p><p>short</p><div class='comments'><p>nice</p></div></div><div class=sidebar><p>" + "links " * 40 + "</p></div></div>": ["Head", ("long text " * 30).strip(), "short"],
    "": [],
    "<p></p>": [],
    "just text": ["just text"],
    "<article><header><h1>In</h1></header><p>one</p><aside>no</aside><form>no</form></article>": ["In", "one"],
    "<main><p>a<p>b</main></div></p><p>after</p>": ["a", "b"],
}


def test_pages(spark):
    for html, want in PAGES.items():
        assert html_text.extract(html) == want, html[:80]
    rows = [(k, f"u{k}", h) for k, h in enumerate(PAGES)] + [(99, None, None), (100, "u", "<p>" + "deep <b>" * 20_000)]
    got = {r["page_id"]: r for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[0]["text"] == "\n".join(PAGES[next(iter(PAGES))]) and got[0]["n_chars"] == len(got[0]["text"])
    assert got[99]["text"] == "" and got[100]["n_chars"] > 0
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_keep_the_whole_article():
    story, long, second = "story words " * 400, "first part " * 450, "second part " * 330
    pages = {
        f"<div class=page><h1>Title</h1><div class=lead><p>short intro</p></div><div class=story><p>{story}</p></div></div>": ["Title", "short intro", story.strip()],
        f"<main><h1>Title</h1><p>intro</p><article><p>{story}</p></article></main>": ["Title", "intro", story.strip()],
        f"<div><article><p>{long}</p></article><article><p>{second}</p></article></div>": [long.strip(), second.strip()],
        f"<h1>Title</h1><main><p>{story}</p></main><div><ul><li><a>x</a></ul></div>": ["Title", story.strip()],
    }
    for html, want in pages.items():
        assert html_text.extract(html) == want, html[:80]


@pytest.mark.parametrize("attribute", ['class="content has-sidebar"', 'id="wrap-no-sidebar"', 'class="entry share-enabled"', 'class="post comment-open"', 'class="layout-sidebar-right"', 'class="page widget"'])
def test_wrappers_named_like_noise_keep_the_article(attribute):
    story = ("story words " * 50).strip()
    html = f"<body><div {attribute}><h1>Title</h1><p>{story}</p><p>{story}</p><div class='sidebar'><p>links here</p></div><div class='site-footer'><p>legal</p></div></div></body>"
    assert html_text.extract(html) == ["Title", story, story]


def test_parts_of_an_article_with_compound_names_stay():
    long, part = ("long text here " * 30).strip(), ("part of the story " * 12).strip()
    page = lambda name: f"<article><h1>T</h1><p>{long}</p><div {name}><p>{part}</p></div></article>"
    for name in ('class="social-science"', 'id="related-work"', 'class="ad-hoc-methods"', 'class="comment-on-method"'):
        assert html_text.extract(page(name)) == ["T", long, part], name
    for name in ('class="related-posts"', 'id="post-comments"', 'class="ad-slot-2"', 'class="social-share-buttons"', 'class="site-nav-wrap"'):
        assert html_text.extract(page(name)) == ["T", long], name


def test_articles_beside_one_another_and_leads_stay():
    long, other = ("long text here " * 60).strip(), ("long body two " * 60).strip()
    assert html_text.extract(f"<article><p>{long}</p></article><article><p>short one</p></article>") == [long, "short one"]
    assert html_text.extract(f"<body><div class=page><div class=lead><p>short intro</p></div><div class=story><p>{long}</p><p>{other}</p></div></div></body>") == ["short intro", long, other]
    links = "<ul>" + "<li><a href=x>one link</a>" * 5 + "</ul>"
    assert html_text.extract(f"<body><div class=page>{links}<div class=story><p>{long}</p><p>{other}</p></div></div></body>") == [long, other]


def test_a_page_may_lie_in_a_form():
    long = ("long text here " * 30).strip()
    assert html_text.extract(f"<body><form action=x><div><h1>T</h1><p>{long}</p><input name=q><select><option>no</select></div></form></body>") == ["T", long]
    assert html_text.extract(f"<div><p>{long}</p><form><label>Name</label><p>Subscribe please</p></form></div>") == [long]


@pytest.mark.parametrize("piece", ["<div>x", "<span>", "<ul><li>x", "<div></b>x", "<b><p>x</b>"])
def test_deeply_nested_pages_take_time_in_proportion(piece):
    import time

    def seconds(n):
        began = time.process_time()
        html_text.extract(piece * n + "<h2>y</i></b>" * n)
        return time.process_time() - began

    assert seconds(20_000) < 25 * max(0.05, seconds(2_000))  # quadratic work would take 100 times as long


def test_ties_and_clashing_columns(spark):
    """Equal parts count alike: both stay. Repeated rows and null ids get results like others."""
    html = "<div><p>same words here</p></div><div><p>same words here</p></div>"
    rows = [(1, "u", html), (1, "u", html), (None, None, html), (2, None, "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "n_blocks": F.lit(0.5)})
    got = html_text.extract_pages(df).collect()
    assert [r["text"] for r in got if r["page_id"] != 2] == ["same words here\nsame words here"] * 3
    assert [r["n_chars"] for r in got if r["page_id"] == 2] == [300_000]


def test_several_entries_with_states_stay():
    story = ("story words " * 50).strip()
    assert html_text.extract(f"<div class='entry share-enabled'><p>{story}</p></div>" * 3) == [story] * 3
    assert html_text.extract(f"<div><p>{story}</p></div><div class='comments'><p>{story * 2}</p></div>") == [story]


def test_licenses(spark):
    body = "words of the file that are many more than the notice " * 5
    rows = [
        ("a/x.txt", body + "\nReleased under the MIT License.", "MIT", None), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", "Apache-2.0", None), ("a/b/c/y.txt", body, None, "Apache-2.0"), ("a/b/c/GPL/COPYING", "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", None),
        ("a/b/c/GPL/z.py", body, None, "GPL-3.0"), ("a/q.txt", body + "\nall about a license to ill and other things", None, None), ("n.txt", None, None, None), (None, "", None, None), ("deep//odd/", "", None, None), ("a/b/c/y.txt", body, None, "Apache-2.0"),
    ]
    df = spark.createDataFrame([(k, p, t) for k, (p, t, _, _) in enumerate(rows)], "doc_id long, path string, text string").withColumns({"license": F.lit(1), "file": F.lit(2), "score": F.lit("x")})
    got = {r["file"]: r for r in license.scan(df).collect()}
    assert len(got) == len(rows)
    for k, (_, _, own, inherited) in enumerate(rows):
        assert (got[k]["license"], got[k]["inherited"]) == (own, inherited), rows[k]
    assert license.scan(df.where("false")).count() == 0


def test_license_templates_name_themselves(spark):
    texts = spark.createDataFrame([(t,) for _, t in license.TEMPLATES], "passage string")
    got = {r["passage"]: (r["license"], r["score"]) for r in license.scored(texts).collect()}
    assert all(got[t] == (name, 1.0) for name, t in license.TEMPLATES)



BSD_HEADER = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
#
import os"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the
 * Mozilla Public License, v. 2.0. If a copy of the MPL was not
 * distributed with this file, You can obtain one at
 * https://mozilla.org/MPL/2.0/. */
int main() { return 0; }"""


def test_wrapped_and_long_licenses(spark):
    body = "\n".join("words of the file that are many more than the notice" for _ in range(30))
    mit = "\n".join([*license._MIT[0].split(", "), "", license._MIT[1], "", *license._MIT[2].split(", ")])
    bsd2 = "\n".join(["Copyright 2020", "", *" ".join((license._BSD[0], license._BSD[1], license._BSD[3])).replace(". ", ".\n\n").split(", ")])
    rows = [
        ("b/head.py", BSD_HEADER + "\n" + body, "BSD-3-Clause", None), ("m/head.c", MPL_HEADER + "\n" + body, "MPL-2.0", None), ("s/x.c", "// SPDX-License-Identifier: Apache-2.0\n" + body, "Apache-2.0", None), ("s/y.c", "// SPDX-License-Identifier: GPL-2.0-or-later\n" + body, "GPL-2.0", None),
        ("p/LICENSE", mit, "MIT", None), ("p/q/x.txt", body, None, "MIT"), ("r/LICENSE.txt", bsd2, "BSD-2-Clause", None), ("r/x.txt", body, None, "BSD-2-Clause"), ("t/COPYING", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met", "BSD-3-Clause", None),
        ("t/u.txt", None, None, "BSD-3-Clause"), ("v/w.txt", "the software is in the source form and the copy of this file is not in any way the subject of this work\n" + body, None, None), ("s/z.c", "// SPDX-License-Identifier: Foo-9\n" + body, None, None), ("s/de.txt", "Mit.\nThe to to.\nAre with and.\n" + body, None, None),
    ]
    got = {r["path"]: r for r in license.scan(spark.createDataFrame([(k, p, t) for k, (p, t, _, _) in enumerate(rows)], "doc_id long, path string, text string")).collect()}
    assert {p: (got[p]["license"], got[p]["inherited"]) for p, _, _, _ in rows} == {p: (own, inherited) for p, _, own, inherited in rows}


def test_license_bound_loses_nothing():
    rng = random.Random(14)
    vocabulary = sorted({t for _, x in license.TEMPLATES for t in license._terms(x)}) + [f"w{k}" for k in range(60)]
    matcher = license._Matcher(license.TEMPLATES, license.COSINE)
    for _ in range(3000):
        terms = [t for t in license._terms(rng.choice(license.TEMPLATES)[1]) if rng.random() < 0.7] + rng.choices(vocabulary, k=rng.randrange(0, 12))
        match = matcher.best(terms)
        known = [t for t in terms if t in matcher.idf]
        assert not match or match[0] < license.COSINE or matcher.could(known, len(terms) - len(known))


def test_license_cosine_by_brute_force(spark):
    """One-line files against plain TF-IDF cosines to every template."""
    import math
    from collections import Counter

    rng = random.Random(23)
    templates = [Counter(license._terms(t)) for _, t in license.TEMPLATES]
    spread = Counter(t for c in templates for t in c)
    idf = lambda t: math.log((1 + len(templates)) / (1 + spread[t])) + 1
    vector = lambda c: {t: n * idf(t) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [vector(c) for c in templates]
    rows, want = [], {}
    for k in range(300):
        terms = [t for t in license._terms(rng.choice(license.TEMPLATES)[1]) if rng.random() < 0.8] + [f"word{rng.randrange(50)}" for _ in range(rng.randrange(0, 15))]
        rows.append((k, f"d{k % 7}/f{k}.txt", " ".join(terms)))
        mine, best = vector(Counter(terms)), None
        for j, (v, c) in enumerate(zip(vectors, templates, strict=True)):
            signs = len((set(terms) & set(c)) - license.FUNCTION_WORDS)
            if mine and signs >= min(license.EVIDENCE, len(set(c) - license.FUNCTION_WORDS)):
                score = round(sum(mine.get(t, 0) * x for t, x in v.items()) / norm(mine) / norm(v), 6)
                best = max(best or (0, 0, ""), (score, -j, license.TEMPLATES[j][0]))
        want[k] = (best[2], best[0]) if best and best[0] >= license.COSINE else (None, None)
    got = {r["file"]: (r["license"], r["score"]) for r in license.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got.keys() == want.keys()
    for k, (name, score) in want.items():
        assert got[k][0] == name and (score is None or abs(got[k][1] - score) < 2e-6)


def test_license_inheritance_by_brute_force(spark):
    rng = random.Random(24)
    notices = {name: text for name, text in reversed(license.TEMPLATES) if name in ("MIT", "Apache-2.0", "MPL-2.0")}
    rows = []
    for k in range(300):
        directory = "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4)))
        name, text = (("LICENSE" + rng.choice(["", ".md", ".txt"]), notices[rng.choice(list(notices))]) if rng.random() < 0.1 else (f"f{rng.randrange(40)}.txt", "words of a file " * 9))
        rows.append((k, f"{directory}/{name}" if directory else name, text))
    got = {r["file"]: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    speaking = {}
    for k, path, _ in rows:
        if got[k]["license"]:
            d = path.rpartition("/")[0]
            speaking[d] = min(speaking.get(d, (0, "~", "")), (-got[k]["score"], path, got[k]["license"]))
    for k, path, _ in rows:
        if not got[k]["license"]:
            d, found = path.rpartition("/")[0], None
            while found is None and (d or path):
                found = speaking.get(d)
                if not d:
                    break
                d = d.rpartition("/")[0]
            assert (got[k]["inherited"], got[k]["inherited_from"]) == ((found[2], found[1]) if found else (None, None)), path
