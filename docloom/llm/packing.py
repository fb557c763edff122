"""Best-fit packing of token pieces into fixed-length sequences by linear grouping.

Lengths are integers up to the capacity, so the whole optimisation runs on the histogram of lengths: at most
``capacity`` numbers reach the driver whatever the corpus size.

1. Lengths above ``capacity / 8`` are large. Sorted by length, they are cut into groups of equal cardinality and
   rounded up to the longest member of their group, which leaves few distinct sizes.
2. Configurations (multisets of sizes that fit a sequence) of these few sizes are optimised as a linear program by
   column generation; whole multiples are kept.
3. Actual lengths take the places of the rounded ones; the slack of rounding is room for small pieces.
4. Large pieces left by the rounding and then the small ones go best-fit, longest first.

The plan is a table of runs ``(length, rank range) -> (sequence range, offset)``. Pieces get their rank within
their length by counts per (length, salt) and numbering inside those small groups, so a length that a third of
all documents share is never in one task.

A document is its token ids and a closing id; null and empty texts are the closing id alone. Longer documents
are cut at multiples of the capacity; a very long text is encoded whole, its words being looked up. Ties: pieces of one
length are ranked by id, piece and crc within salted groups; null ids rank first. Repeated rows are packed once each.
Extra columns play no part. Empty table: empty result.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import mapped, only, staged, worker_cache

CAPACITY = 4096
END_ID = 1
GROUPS = 24
LARGE_SHARE = 8
#: Bounds of a Python worker's caches; they are emptied when full.
CACHED_WORDS = 500_000
CACHED_RUNS = 1_400_000
#: (words, letter runs) where executors are already full of earlier stages' memory.
SMALL_CACHES = (60_000, 150_000)
TEXT_BYTES = 1 << 18
#: Signs that the vocabulary's pre-tokeniser never splits from one another nor joins to letters.
PUNCTUATION = ".,;:!?%&$#*|"
ROWS_PER_RANK_GROUP = 50_000
BROADCAST_PLAN_ROWS = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str):
    """The tokenizer and two caches of ids (little-endian unsigned 32-bit), one set per Python worker:
    by word as written, and by letter run in lower case or punctuation run."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return worker_cache(("packing", path), lambda: (Tokenizer.from_file(path), {}, {"": b""}))


def _encoded(tokenizer, words: list[str]) -> list[bytes]:
    return [array("I", found.ids).tobytes() for found in tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []


def _byte_signs() -> dict[int, str]:
    """The sign by which the vocabulary writes each byte: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_SIGNS = _byte_signs()
#: Below this sign, lower-case letter runs are what the vocabulary's normaliser makes of them and one pre-token.
LATIN_END = "\u0250"


def _encoded_runs(tokenizer, runs: list[str]) -> list[bytes]:
    """The ids of lower-case letter runs and plain punctuation runs: Latin ones go straight to the vocabulary's merges."""
    merges, found = tokenizer.model.tokenize, []
    other = [run for run in runs if run and max(run) >= LATIN_END]
    ids = dict(zip(other, _encoded(tokenizer, other), strict=True))
    for run in runs:
        if run in ids:
            found.append(ids[run])
        else:
            signs = run if run.isascii() else "".join([_SIGNS[b] for b in run.encode()])
            found.append(array("I", [t.id for t in merges(signs)]).tobytes() if run else b"")
    return found


def _learn(tokenizer, by_word: dict[bytes, bytes], by_run: dict[str, bytes], words: list[bytes], most_runs: int = CACHED_RUNS) -> None:
    """Fill the word cache. A letter run followed by plain punctuation is two pre-tokens of this vocabulary, and
    letters are folded before they are looked up, so most new words are made of known runs; the rest (mixed signs,
    digits, apostrophes, capitals whose folding depends on context) are encoded as they stand."""
    plain, whole = [], []
    known = by_run.get
    for word in words:
        text = word.decode()
        run = text.rstrip(PUNCTUATION)
        folded, rest = run.lower(), text[len(run) :]
        head, tail = known(folded), known(rest)
        if "Σ" in run or len(folded) != len(run):
            whole.append((word, text))
        elif head is not None and tail is not None:
            by_word[word] = head + tail if tail else head
        elif folded.isalpha():
            plain.append((word, folded, rest))
        else:
            whole.append((word, text))
    wanted = {run for _, a, b in plain for run in (a, b) if run not in by_run}
    if len(by_run) + len(wanted) > most_runs:
        by_run.clear()
        by_run[""] = b""
        wanted = {run for _, a, b in plain for run in (a, b) if run}
    runs = list(wanted)
    by_run.update(zip(runs, _encoded_runs(tokenizer, runs), strict=True))
    for word, a, b in plain:
        by_word[word] = by_run[a] + by_run[b]
    by_word.update(zip([w for w, _ in whole], _encoded(tokenizer, [t for _, t in whole]), strict=True))


def token_bytes(texts: list[bytes], path: str, caches: tuple[int, int] = (CACHED_WORDS, CACHED_RUNS)) -> list[bytes]:
    """The ids of texts, four bytes each.

    The vocabulary's normaliser and pre-tokeniser never look across white space, so the ids of a text are those
    of its words; frequent words are encoded once per worker, and new words of several texts together.
    """
    tokenizer, by_word, by_run = _encoder(path)
    words = [text.split() for text in texts]
    seen = set().union(*words)
    missing = [w for w in seen if w not in by_word]
    if missing:
        if len(by_word) + len(missing) > max(caches[0], len(seen)):
            by_word.clear()
            missing = list(seen)
        _learn(tokenizer, by_word, by_run, missing, caches[1])
    return [b"".join(map(by_word.__getitem__, w)) for w in words]


def _token_batches(texts: pa.Array, path: str, caches: tuple[int, int] = (CACHED_WORDS, CACHED_RUNS)):
    """token_bytes over an Arrow array, some TEXT_BYTES of text (or one longer text) at a time."""
    some, size = [], 0
    for text in pc.cast(pc.fill_null(texts, ""), pa.binary()):
        some.append(text.as_py())
        size += len(some[-1])
        if size >= TEXT_BYTES:
            yield from token_bytes(some, path, caches)
            some, size = [], 0
    yield from token_bytes(some, path, caches)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, caches: tuple[int, int] = (CACHED_WORDS, CACHED_RUNS)) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's token pieces. Map-only."""
    path = vocabulary or default_vocabulary()
    docs = only(df, doc_id=id_col, text=text_col)
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(_token_batches(batch.column("text"), path, caches)):
                ids += end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return mapped(docs, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _best_pattern(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1, dtype=np.int64)
    for room in range(1, capacity + 1):
        top, who = best[room - 1], -1
        for g, size in enumerate(sizes):
            if size <= room and best[room - size] + value[g] > top + 1e-12:
                top, who = best[room - size] + value[g], g
        best[room], taken[room] = top, who
    pattern, room = [0] * len(sizes), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 60) -> list[tuple[list[int], int]]:
    """Patterns over few sizes with whole multiplicities that never exceed the demand.

    Revised simplex with columns priced by a knapsack; any feasible basis is a valid packing, so the number of
    rounds bounds the effort, not correctness.
    """
    k = len(sizes)
    if not k:
        return []
    patterns = [[capacity // s if g == i else 0 for g in range(k)] for i, s in enumerate(sizes)]
    for _ in range(rounds):
        basis = np.array(patterns, dtype=float).T
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, pattern = _best_pattern(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        level = np.linalg.solve(basis, np.array(demand, dtype=float))
        step = np.linalg.solve(basis, np.array(pattern, dtype=float))
        ratio = [(level[i] / step[i], i) for i in range(k) if step[i] > 1e-9]
        if not ratio:
            break
        patterns[min(ratio)[1]] = pattern
    level = np.linalg.solve(np.array(patterns, dtype=float).T, np.array(demand, dtype=float))
    left, found = list(demand), []
    for pattern, x in sorted(zip(patterns, level, strict=True), key=lambda p: -p[1]):
        n = int(max(0, np.floor(x + 1e-9)))
        n = min([n, *(left[g] // c for g, c in enumerate(pattern) if c)])
        if n > 0:
            found.append((pattern, n))
            left = [have - n * c for have, c in zip(left, pattern, strict=True)]
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, n, first sequence, offset): piece first+i goes to sequence first+i at the offset."""
    runs: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    rooms: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []
    sequences = 0

    def opened(room: int, first: int, n: int) -> None:
        if room > 0:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(keys, room)
            rooms[room].append((first, n))

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n

    large = sorted(((length, n) for length, n in histogram.items() if capacity // LARGE_SHARE < length < capacity), reverse=True)
    total = sum(n for _, n in large)
    share = max(1, -(-total // groups))
    members: list[list[list[int]]] = []
    room_left = 0
    for length, n in large:
        while n:
            if not room_left:
                members.append([])
                room_left = share
            take = min(n, room_left)
            members[-1].append([length, take])
            n -= take
            room_left -= take
    sizes = [m[0][0] for m in members]
    merged: dict[int, list[list[int]]] = {}
    for size, member in zip(sizes, members, strict=True):
        merged.setdefault(size, []).extend(member)  # groups of one length are one size
    sizes = list(merged)
    members = [merged[s] for s in sizes]
    demand = [sum(n for _, n in m) for m in members]
    for pattern, n in configurations(sizes, demand, capacity):
        places = [g for g, c in enumerate(pattern) for _ in range(c)]
        while n:
            # as many sequences as can be alike: each place takes the longest actual length left in its group
            wanted: dict[int, int] = defaultdict(int)
            for g in places:
                wanted[g] += 1
            alike, chosen = n, []
            for g, c in wanted.items():
                have = members[g][0][1]
                if have >= c:
                    alike = min(alike, have // c)
                    chosen.append((g, [(0, c)]))
                else:  # a run ends inside the sequence: take it item by item
                    alike, need, picks, k = 1, c, [], 0
                    while need:
                        some = min(need, members[g][k][1])
                        picks.append((k, some))
                        need -= some
                        k += 1
                    chosen.append((g, picks))
            at = 0
            for g, picks in chosen:
                for k, c in picks:
                    length = members[g][k][0]
                    for _ in range(c):
                        place(length, alike, sequences, at)
                        at += length
                    members[g][k][1] -= c * alike
            for g, _ in chosen:
                members[g] = [m for m in members[g] if m[1]]
            opened(capacity - at, sequences, alike)
            sequences += alike
            n -= alike

    rest: dict[int, int] = {length: n for length, n in histogram.items() if length == capacity or length <= capacity // LARGE_SHARE}
    for member in members:
        for length, n in member:
            rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            k = bisect.bisect_left(keys, length)
            if k < len(keys):
                room = keys[k]
                first, have = rooms[room].pop()
                use = min(have, n)
                if have > use:
                    rooms[room].append((first + use, have - use))
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(k)
                place(length, use, first, capacity - room)
                opened(room - length, first, use)
                n -= use
                continue
            each = capacity // length
            many = n // each
            if many:
                for t in range(each):
                    place(length, many, sequences, t * length)
                opened(capacity - each * length, sequences, many)
                sequences += many
                n -= many * each
            if n:
                for t in range(n):
                    place(length, 1, sequences, t * length)
                opened(capacity - n * length, sequences, 1)
                sequences += 1
                n = 0
    return runs


def ranked(table: DataFrame, n_rows: int) -> DataFrame:
    """Add ``rank``: gapless from 0 within each length, by counts of small (length, salt) groups."""
    salts = max(1, -(-n_rows // ROWS_PER_RANK_GROUP))
    salted = table.withColumn("salt", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("inside", inside).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("inside") - 1).drop("salt", "first", "inside")


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of a pieces table its ``sequence_id`` and ``offset``."""
    spark = table.sparkSession
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(rows := plan(histogram, capacity), "length long, first_rank long, n long, first_sequence long, offset long")
    if len(rows) <= BROADCAST_PLAN_ROWS:
        runs = F.broadcast(runs)
    places = ranked(table, sum(histogram.values())).alias("p").join(
        runs.alias("r"), (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    )
    return places.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), F.col("r.offset").alias("offset"))


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, caches: tuple[int, int] = (CACHED_WORDS, CACHED_RUNS)) -> DataFrame:
    """Tokenise once into the shared folder, then plan and place."""
    return pack(staged(pieces(df, id_col, text_col, vocabulary, capacity, end_id, caches), "pieces"), capacity)
