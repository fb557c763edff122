"""Exact removal of byte strings that occur twice, by blockwise suffix sorting over a sampled cover.

A suffix (a window of fixed length at every place) is compared through a cover sample. The sample is
content-defined: among the places of a window the one with the least gram hash is in it. Two equal windows therefore
have a sample place at the same distance from their starts, which is the property that a difference cover gives by
residues; unlike residues it brings equal windows to the same bucket wherever they stand in their texts, so texts never
need to be in one place.

1. Samples are counted by gram over all texts. A task first settles what repeats among its own texts and sends one row
   for a gram, so a gram that very many texts share is no task's burden. Only buckets (grams) that occur twice are built.
2. A bucket gets the stretches whose windows it decides. Buckets arrive sorted and are taken a block of bounded size at a
   time. In a block the samples are ranked once: by what follows the sample and, separately, by what precedes it, with
   common prefix lengths. A window that starts r places before its sample ties with another exactly if their samples'
   left ranks agree to r places and their right ranks to the rest; long ties cost no comparison.
3. Buckets of very many stretches (``Bounds.hot``) are split: their windows are dealt out one by one by a 128-bit hash of
   the window, again after each task has settled its own repeats.
4. Runs of repeated windows return to their text, and what they cover is measured and removed.

Two laws run in the same passes. BYTES is the one by which text is removed: 400 bytes that also start anywhere else, the
same text included. WORDS reports passages of over 50 words (runs without the six white-space characters, by 64-bit
hashes) that also occur in another text; nothing is removed by it, as such a passage may have fewer than 400 bytes.

Equal texts are one class: all of a class goes if it has two texts and a window at all, and only one text of a class
takes part in 1 to 4.

Null and empty texts have 0 bytes and nothing to remove. Matches never cross texts. Very long texts are read in chunks.
Rows with null ids count like others. Repeated rows are copies. Extra columns play no part. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mapped, only, staged
from ._words import _BYTE, mixed, word_hashes, words


@dataclass(frozen=True)
class Law:
    """Symbols in a window and in a gram; whether only windows count that also occur in another text."""

    number: int
    window: int
    gram: int
    across: bool

    @property
    def reach(self) -> int:
        """Places of a window that compete for the sample."""
        return self.window - self.gram + 1

    @property
    def width(self) -> int:
        """Bytes of a symbol."""
        return 8 if self.across else 1


BYTES = Law(0, 400, 64, False)
WORDS = Law(1, 51, 8, True)
LAWS = (BYTES, WORDS)


@dataclass(frozen=True)
class Bounds:
    """What a task holds at once; results are the same under any bounds.

    Symbols handled together, samples settled together, bytes of stretches kept to be sent, bytes sorted together; the
    stretches from which a bucket is split by window, and how many such buckets' grams are kept in memory (where there
    are more, only the larger ones are split).
    """

    chunk: int = 1 << 17
    samples: int = 400_000
    kept: int = 6 << 20
    block: int = 4 << 20
    hot: int = 2048
    hot_grams: int = 1_000_000


DEFAULT = Bounds()
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_U = np.uint64
_MASK = (1 << 64) - 1
_ROOTS = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_LONGEST = DEFAULT.chunk + max(law.window for law in LAWS)
_UP = [np.cumprod(np.r_[_U(1), np.full(_LONGEST, _U(root))], dtype=np.uint64) for root in _ROOTS]
_DOWN = [np.cumprod(np.r_[_U(1), np.full(_LONGEST, _U(pow(root, -1, 1 << 64)))], dtype=np.uint64) for root in _ROOTS]
_SECOND_BYTE = mixed(_BYTE ^ _U(_ROOTS[1]))
_PLACE_BITS = _U((1 << 20) - 1)


def symbols_of(data: np.ndarray, law: Law) -> np.ndarray:
    """A text's bytes as the law's symbols."""
    if law.width == 1:
        return data
    starts, ends, _ = words(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends, fold=False)


def _hashes(symbols: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of all strings of ``length`` symbols; ``which`` of two independent families."""
    if symbols.dtype == np.uint8:
        values = (_BYTE, _SECOND_BYTE)[which][symbols]
    else:
        values = mixed(symbols ^ _U(_ROOTS[which]))
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * _UP[which][: len(values)], dtype=np.uint64, out=sums[1:])
    m = len(values) - length + 1
    return mixed((sums[length:] - sums[:m]) * _DOWN[which][:m])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def sample(symbols: np.ndarray, law: Law = BYTES, chunk: int = DEFAULT.chunk):
    """(gram hash, sample place, first window, last window) of the stretches of one text that has a window.

    Windows are decided by the least (hash, place) among their grams; consecutive windows with the same
    sample are a stretch. Long texts go by chunks that overlap by a window; a stretch may be cut at a chunk's edge.
    """
    n = len(symbols)
    for lo in range(0, n - law.window + 1, chunk):
        part = symbols[lo : min(n, lo + chunk + law.window - 1)]
        grams = _hashes(part, law.gram)
        best = _least((grams & ~_PLACE_BITS) | np.arange(len(grams), dtype=np.uint64), law.reach)
        first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        place = (best[first] & _PLACE_BITS).astype(np.int64)
        yield grams[place].astype(np.int64), place + lo, first + lo, np.r_[first[1:], len(best)] - 1 + lo


def _bytes_of(batch: pa.RecordBatch):
    for text in pc.cast(pc.fill_null(batch.column("text"), ""), pa.binary()):
        yield np.frombuffer(text.as_buffer(), dtype=np.uint8)


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    change = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[len(columns[0]) > 0, change])


SAMPLES = "law byte, gram long, cls long, again boolean, n long, known boolean"


def _sampled(bounds: Bounds):
    """A mapper to rows of SAMPLES. Grams that repeat among a task's own texts: ``known`` rows for each class, and one row
    for the gram with ``again``; the others as they are. n counts samples."""

    def settled(held):
        for law, found in held.items():
            if not found:
                continue
            gram, cls, times = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.lexsort((cls, gram))
            gram, cls, times = gram[order], cls[order], times[order]
            first = _runs_of(gram, cls)  # copies of a text may come more than once
            gram, cls, times = gram[first], cls[first], np.maximum.reduceat(times, first)
            first = _runs_of(gram)
            count, texts = np.add.reduceat(times, first), np.diff(np.r_[first, len(gram)])
            again = (texts > 1) | ((count > 1) & (not law.across))
            known = np.repeat(again, texts)
            for rows, flag, n, own in ((first, again, count, False), (np.flatnonzero(known), np.ones(int(known.sum()), bool), times[known], True)):
                columns = (np.full(len(rows), law.number, np.int8), gram[rows], cls[rows], flag, n.astype(np.int64), np.full(len(rows), own))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["law", "gram", "cls", "again", "n", "known"])

    def run(batches):
        held, size = {law: [] for law in LAWS}, 0
        for batch in batches:
            for number, data in zip(batch.column("cls").to_pylist(), _bytes_of(batch), strict=True):
                for law in LAWS:
                    symbols = symbols_of(data, law)
                    if len(symbols) < law.window:
                        continue
                    found = [(g, p) for g, p, _, _ in sample(symbols, law, bounds.chunk)]
                    hashes = np.concatenate([g for g, _ in found])
                    fresh = np.unique(np.concatenate([p for _, p in found]), return_index=True)[1]
                    own, times = np.unique(hashes[fresh], return_counts=True)
                    held[law].append((own, np.full(len(own), number, dtype=np.int64), times))
                    size += len(own)
                if size >= bounds.samples:
                    yield from settled(held)
                    size = 0
        yield from settled(held)

    return run


def _repeated(bounds: Bounds):
    """A mapper to (law, gram, cls) of the grams that occur again, and (law, gram, n) of those with many samples. Each task
    has sent a gram once for each block that it settled."""

    def run(batches):
        found = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("law", "gram", "cls", "again", "n")] for b in batches if b.num_rows]
        if not found:
            return
        law, gram, cls, again, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((gram, law))
        law, gram, cls, again, n = law[order], gram[order], cls[order], again[order], n[order]
        first = _runs_of(law, gram)
        size = np.diff(np.r_[first, len(gram)])
        count = np.add.reduceat(n, first)
        keep = np.repeat((np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)) | np.logical_or.reduceat(again, first), size)
        hot = first[count >= bounds.hot]
        names = ["law", "gram", "cls", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(law[keep]), pa.array(gram[keep]), pa.array(cls[keep]), pa.nulls(int(keep.sum()), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(law[hot]), pa.array(gram[hot]), pa.nulls(len(hot), pa.int64()), pa.array(count[count >= bounds.hot])], names=names)

    return run


def _hot_grams(wanted: DataFrame, most: int) -> list[np.ndarray]:
    """For each law the sorted grams whose buckets are split."""
    hot = wanted.where("n is not null").select("law", "gram", F.floor(F.log2("n")).cast("int").alias("level"))
    least, total = 64, 0
    for level, m in sorted(((r["level"], r["m"]) for r in hot.groupBy("level").agg(F.count("*").alias("m")).collect()), reverse=True):
        if total + m > most:
            break
        least, total = level, total + m
    got = hot.where(F.col("level") >= least).toArrow()
    law, gram = got.column("law").to_numpy(), got.column("gram").to_numpy()
    return [np.sort(gram[law == x.number]) for x in LAWS]


SEGMENT = "law byte, bucket long, key binary, first int, before int, part binary, last int, second long, again boolean"
_SEGMENT_KINDS = (pa.int8(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.bool_())
_SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]


def _segments(rows):
    for lo in range(0, len(rows), 10_000):
        columns = zip(*rows[lo : lo + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SEGMENT_KINDS, strict=True)], names=_SEGMENT_NAMES)


def _finished(law: Law, key: bytes, first: int, last: int) -> tuple:
    """A run that needs no bucket is dealt out by its text."""
    return (law.number, int.from_bytes(key[:8], "little", signed=True), key, first, None, None, last, None, True)


def _repeats(law: Law, places: list) -> bool:
    """Whether a string with these (key, ...) places occurs again."""
    return len({p[0] for p in places}) > 1 if law.across else len(places) > 1


def _joined(places: list) -> list:
    """(key, first, last) places in order, single windows that follow one another as one run."""
    out: list = []
    for key, first, last in sorted(places):
        if out and first == last and out[-1][0] == key and out[-1][2] == first - 1:
            out[-1] = (key, out[-1][1], last)
        else:
            out.append((key, first, last))
    return out


def _single_windows(law: Law, found: list) -> list:
    """Rows of SEGMENT for single windows; found: (key, first window, hashes, second hashes)."""
    names: dict[bytes, int] = {}
    lengths = [len(x[2]) for x in found]
    owner = np.repeat([names.setdefault(key, len(names)) for key, *_ in found], lengths)
    at = np.concatenate([np.arange(a, a + n) for (_, a, _, _), n in zip(found, lengths, strict=True)])
    one, two = np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found])
    keys = list(names)
    order = np.lexsort((at, owner, two, one))
    one, two, at, owner = one[order], two[order], at[order], owner[order]
    first = _runs_of(one, two)
    size = np.diff(np.r_[first, len(one)])
    again = owner[first] != owner[first + size - 1] if law.across else size > 1
    rows = [(law.number, int(one[i]), keys[owner[i]], int(at[i]), None, None, int(at[i]), int(two[i]), True) for i in first[again]]
    # windows that may repeat elsewhere; a text can have one in several places, and next to one another
    rest = np.flatnonzero(~np.repeat(again, size))
    start = rest[np.r_[True, (np.diff(one[rest]) != 0) | (np.diff(two[rest]) != 0) | (np.diff(owner[rest]) != 0) | (np.diff(at[rest]) != 1)]] if len(rest) else rest
    end = np.r_[np.searchsorted(rest, start)[1:], len(rest)] - 1 if len(rest) else rest
    rows += [(law.number, int(one[i]), keys[owner[i]], int(at[i]), None, None, int(at[j]), int(two[i]), False) for i, j in zip(start, rest[end], strict=True)]
    done = np.flatnonzero(np.repeat(again, size))
    done = done[np.lexsort((at[done], owner[done]))]
    cuts = np.flatnonzero((np.diff(at[done]) != 1) | (np.diff(owner[done]) != 0)) + 1
    return rows + [_finished(law, keys[owner[run[0]]], int(at[run[0]]), int(at[run[-1]])) for run in np.split(done, cuts) if len(run)]


def _stretches(hot: list[np.ndarray], bounds: Bounds):
    """A mapper to rows of SEGMENT: windows first..last of a text with their symbols and the sample's distance ``before``;
    in hot buckets single windows by hash; finished runs (no part, no second hash). Equal stretches and equal hot
    windows of a task are sent once; what is known to repeat leaves as finished."""

    def run(batches):
        kept = {law: defaultdict(list) for law in LAWS}
        single = {law: [] for law in LAWS}
        size = 0

        def sent():
            for law in LAWS:
                rows = []
                for (gram, part, before), places in kept[law].items():
                    again, places = _repeats(law, places), _joined(places)
                    rows += [(law.number, gram, key, a, before, part, z, None, again) for key, a, z in places[: 1 if again else None]]
                    if again:
                        rows += [_finished(law, *place) for place in places]
                kept[law].clear()
                yield from _segments(rows)
                if single[law]:
                    yield from _segments(_single_windows(law, single[law]))
                    single[law].clear()

        for batch in batches:
            for key, lists, data in zip(batch.column("key").to_pylist(), batch.column("grams"), _bytes_of(batch), strict=True):
                for law in LAWS:
                    mine = lists[f"law{law.number}"].values
                    if mine is None or not len(mine):
                        continue
                    wanted, split = np.unique(mine.to_numpy()), hot[law.number]
                    symbols = symbols_of(data, law)
                    for grams, places, first, last in sample(symbols, law, bounds.chunk):
                        at = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
                        for k in np.flatnonzero(wanted[at] == grams):
                            a, z, gram = int(first[k]), int(last[k]), int(grams[k])
                            part = symbols[a : z + law.window]
                            where = np.searchsorted(split, gram)
                            if where < len(split) and split[where] == gram:
                                single[law].append((key, a, _hashes(part, law.window).astype(np.int64), _hashes(part, law.window, 1).astype(np.int64)))
                                size += 40 * (z - a + 1)
                            else:
                                kept[law][gram, part.tobytes(), int(places[k]) - a].append((key, a, z))
                                size += part.nbytes
                            if size >= bounds.kept:
                                yield from sent()
                                size = 0
        yield from sent()

    return run


def _ranked(side: np.ndarray, lengths: np.ndarray, bucket: np.ndarray):
    """(order, common): rows sorted by bucket, then symbols; common[i] is what row order[i] shares with order[i - 1]."""
    raw = np.ascontiguousarray(side).view(np.uint8).reshape(len(side), -1).tobytes()
    width = len(raw) // len(side)
    order = np.array(sorted(range(len(side)), key=lambda i: (bucket[i], raw[i * width : (i + 1) * width])), dtype=np.int64)
    sorted_side = side[order]
    differ = sorted_side[1:] != sorted_side[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    same = np.minimum(same, np.minimum(lengths[order][1:], lengths[order][:-1]))
    same[bucket[order][1:] != bucket[order][:-1]] = -1
    return order, np.r_[-1, same]


def repeated_windows(bucket: np.ndarray, parts: list[bytes], before: np.ndarray, owner: np.ndarray | None = None, law: Law = BYTES):
    """For stretches grouped in buckets: a [stretch, window] mask of windows that occur in a stretch of the bucket
    that has another owner (none given: in another stretch). Window w of a stretch starts w symbols into its part; only
    windows with the same distance to the sample can be equal."""
    m = len(parts)
    kind = np.uint8 if law.width == 1 else np.uint64
    owner = np.arange(m) if owner is None else owner
    sizes = np.array([len(p) for p in parts]) // np.dtype(kind).itemsize
    left, right = int(before.max()), int((sizes - before).max())
    grid = np.zeros((m, left + right), dtype=kind)
    flat = np.frombuffer(b"".join(parts), dtype=kind)
    start = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(m), sizes)
    grid[rows, np.arange(len(flat)) - np.repeat(start, sizes) + np.repeat(left - before, sizes)] = flat
    by_right, share_right = _ranked(grid[:, left:], sizes - before, bucket)
    if left:
        by_left, share_left = _ranked(np.ascontiguousarray(grid[:, :left][:, ::-1]), before, bucket)
    else:
        by_left = np.argsort(bucket, kind="stable")
        share_left = np.where(np.r_[True, bucket[by_left][1:] != bucket[by_left][:-1]], -1, 0)
    # a stretch of k windows spans k + window - 1 symbols; the sample may stand before + 1 windows deep at most
    windows = sizes - law.window + 1
    mask = np.zeros((m, int(windows.max())), dtype=bool)
    class_left, class_right = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for r in range(left + 1):  # windows that start r symbols before their sample
        at = np.flatnonzero((before >= r) & (before - r < windows))
        if not len(at):
            continue
        class_left[by_left] = np.cumsum(share_left < r)
        class_right[by_right] = np.cumsum(share_right < law.window - r)
        same = class_left[at] * (m + 1) + class_right[at]
        order = np.lexsort((owner[at], same))
        same, own = same[order], owner[at][order]
        first = _runs_of(same)
        last = np.r_[first[1:], len(same)] - 1
        hit = at[order[np.repeat(own[first] != own[last], last - first + 1)]]
        mask[hit, before[hit] - r] = True
    return mask


def _runs(law: Law, rows: list):
    for lo in range(0, len(rows), 50_000):
        key, first, last = zip(*rows[lo : lo + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), law.number, np.int8)), pa.array(key, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["law", "key", "first", "last"])


def _blocks(batches, block: int):
    """(law, rows) of whole buckets, a bounded number of bytes together; batches come sorted by law and bucket."""
    rows, size, place = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _SEGMENT_NAMES), strict=True):
            if place is not None and row[:2] != place and (size >= block or row[0] != place[0]):
                yield LAWS[place[0]], rows
                rows, size = [], 0
            place = row[:2]
            rows.append(row)
            size += 100 + len(row[5] or b"")
    if rows:
        yield LAWS[place[0]], rows


def _found(law: Law, rows: list) -> list:
    """(key, first, last) runs of repeated windows in the rows of some whole buckets."""
    found = [(key, first, last) for _, _, key, first, _, part, last, second, _ in rows if part is None and second is None]
    windows, stretches, alone = defaultdict(list), defaultdict(list), defaultdict(int)
    for _, bucket, key, first, before, part, last, second, again in rows:
        if part is not None:
            stretches[bucket, part, before].append((key, first, last, again))
        elif second is not None:
            windows[bucket, second].append((key, first, last, again))
    for places in windows.values():
        if any(p[3] for p in places) or _repeats(law, places):
            found += [p[:3] for p in places]
    for bucket, _, _ in stretches:
        alone[bucket] += 1
    entries = []
    for (bucket, part, before), places in stretches.items():
        again = any(p[3] for p in places) or _repeats(law, places)
        if again:
            found += [p[:3] for p in places]
        if alone[bucket] > 1:
            entries.append((bucket, part, before, places, again))
    if not entries:
        return found
    names: dict[bytes, int] = {}
    owner = [-1 - k if e[4] or not law.across else names.setdefault(e[3][0][0], len(names)) for k, e in enumerate(entries)]
    mask = repeated_windows(np.array([e[0] for e in entries], dtype=np.int64), [e[1] for e in entries], np.array([e[2] for e in entries], dtype=np.int64), np.array(owner), law)
    for i in np.flatnonzero(mask.any(axis=1)):
        _, part, _, places, again = entries[i]
        windows_of = len(part) // law.width - law.window + 1
        edge = np.flatnonzero(np.diff(np.r_[False, mask[i, :windows_of], False]))
        for key, first, last, _ in () if again else places:
            if windows_of == 1:  # a run of equal windows
                found.append((key, first, last))
            else:
                found += [(key, first + int(a), first + int(z) - 1) for a, z in zip(edge[::2], edge[1::2], strict=True)]
    return found


def _decided(bounds: Bounds):
    """A mapper to (law, key, first, last) runs of repeated windows, a block of buckets at a time."""

    def run(batches):
        for law, rows in _blocks(batches, bounds.block):
            yield from _runs(law, _found(law, rows))

    return run


def _covered(n: int, firsts, lasts, law: Law) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int32)
    if firsts.values is not None and len(firsts.values):
        np.add.at(change, firsts.values.to_numpy(), 1)
        np.add.at(change, lasts.values.to_numpy() + law.window, -1)
    return np.cumsum(change[:-1]) > 0


def _n_runs(mask: np.ndarray) -> int:
    return int((np.diff(np.r_[False, mask].astype(np.int8)) == 1).sum())


def _removed(batches):
    """(key, n_removed, n_spans, kept_sha256, n_passage_words, n_passages) from the runs of a text."""
    for batch in batches:
        out = []
        for runs, data in zip(batch.column("runs"), _bytes_of(batch), strict=True):
            gone = _covered(len(data), runs["first0"], runs["last0"], BYTES)
            again = _covered(len(symbols_of(data, WORDS)), runs["first1"], runs["last1"], WORDS)
            out.append((int(gone.sum()), _n_runs(gone), hashlib.sha256(data[~gone].tobytes()).hexdigest(), int(again.sum()), _n_runs(again)))
        if out:
            columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in columns)], names=["key", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages"])


def _by_law(column: str, name: str, collect=F.collect_list) -> list:
    return [collect(F.when(F.col("law") == law.number, F.col(column))).alias(f"{name}{law.number}") for law in LAWS]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: Bounds = DEFAULT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, n_passages) per text."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = only(df, doc_id=id_col, text=text_col).select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    texts = texts.withColumn("cls", F.xxhash64("key"))
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    base = staged(texts.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), n_words, F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "texts")
    classes = base.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    samples = staged(mapped(texts.select("cls", "text"), _sampled(bounds), SAMPLES), "samples")
    sent = samples.where("not known").select("law", "gram", "cls", "again", "n").repartition(parts, "law", "gram")
    wanted = staged(mapped(sent, _repeated(bounds), "law byte, gram long, cls long, n long"), "repeating-samples")
    hot = spark.sparkContext.broadcast(_hot_grams(wanted, bounds.hot_grams))
    grams = wanted.where("cls is not null").select("law", "gram", "cls").union(samples.where("known").select("law", "gram", "cls"))
    grams = grams.groupBy("cls").agg(F.struct(*_by_law("gram", "law", F.collect_set)).alias("grams"))
    chosen = classes.withColumn("cls", F.xxhash64("key")).join(grams, "cls").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), "copies", "grams")
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    shared = staged(texts.select("doc_id", "key", "text").join(chosen, same).select("key", "text", "copies", "grams"), "repeating-texts")

    def cut(batches):
        yield from _stretches(hot.value, bounds)(batches)

    segments = mapped(shared.select("key", "text", "grams"), cut, SEGMENT).repartition(parts, "law", "bucket").sortWithinPartitions("law", "bucket")
    runs = mapped(segments, _decided(bounds), "law byte, key binary, first int, last int")
    runs = runs.groupBy("key").agg(F.struct(*_by_law("first", "first"), *_by_law("last", "last")).alias("runs"))
    found = mapped(shared.where("copies = 1").select("key", "text").join(runs, "key"), _removed, "key binary, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long")
    # written, so that the join below is of two plain tables and a text with very many copies can be split
    results = staged(classes.select("key", "copies").join(found, "key", "left").where("copies > 1 or n_removed is not null"), "repeats")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    whole, passage = copied & (F.col("n_bytes") >= BYTES.window), copied & (F.col("n_words") >= WORDS.window)
    counted = lambda all_of, every, some: F.when(all_of, every).otherwise(F.coalesce(F.col(some), F.lit(0))).cast("long").alias(some)
    return base.join(results, "key", "left").select(
        "doc_id",
        "n_bytes",
        counted(whole, F.col("n_bytes"), "n_removed"),
        counted(whole, F.lit(1), "n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        counted(passage, F.col("n_words"), "n_passage_words"),
        counted(passage, F.lit(1), "n_passages"),
    )
