"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary are the units. Each language has a probability for every piece; a word's
probability is the sum over all of its segmentations into pieces, computed by the forward algorithm, and a text's
score is the sum of its words' log probabilities. Piece probabilities are learned by expectation-maximisation
(forward-backward over all segmentations) on the word counts of a bounded sample of labelled texts:
``TRAIN_TEXTS`` texts a language, expected, picked by a hash of the id. Learning and prediction read whole texts and
whole words: lattices of long words are built a block of positions at a time, and words and texts of any length are
scored a bounded number of letter runs at a time.

Words are runs of letters (Unicode category L), lower-cased. Null texts and texts without a letter: ``und`` with
score 0, as is every text when nothing was learned. Ties go to the language first in order. Repeated rows get equal
results; extra columns play no part. Empty table: empty result.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, mapped, only, release_worker_cache, staged

TRAIN_TEXTS = 1000
ROUNDS = 3
#: The longest lower-case letter piece of the vocabulary, with its word-start mark.
LONGEST_PIECE = 16
#: Positions of a word whose lattice is held at once, and positions of all words that are scored together.
BLOCK = 4096
TOGETHER = 1 << 16
#: Bounds of a Python worker's caches (entries, bytes of their keys); they are emptied when full. A text is read in
#: parts of so many words, a word in parts of so many letter runs.
CACHES = (250_000, 500_000)
#: (words, letter runs) where executors are already full of other stages' memory.
SMALL_CACHES = (100_000, 150_000)
CACHED_BYTES = 16 << 20
PART_WORDS = 100_000
PART_RUNS = 50_000
#: Words that a training task counts before it sends the counts on.
COUNTED_WORDS = 100_000
#: Texts whose new words are scored together.
TEXT_BYTES = 3 << 17
SMOOTHING = 0.1
UNKNOWN = 1e-7

LETTERS = regex.compile(r"\p{L}+")
START = "▁"
UNDETERMINED = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Lower-case letter pieces of the vocabulary, with or without the word-start mark, numbered in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {START: 0}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        bare = piece.removeprefix(START)
        if bare and len(piece) <= LONGEST_PIECE and LETTERS.fullmatch(bare) and bare == bare.lower():
            found.setdefault(piece, len(found))
    return found


_U = np.uint64
#: One odd multiplier for each place counted from a piece's end.
_PLACES = (np.arange(1, LONGEST_PIECE + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) ^ _U(0xD1B54A32D192ED03)) * _U(0xBF58476D1CE4E5B9) | _U(1)
_FILTER_BITS = 20


def _spread(points: np.ndarray) -> np.ndarray:
    return (points + _U(1)) * _U(0x94D049BB133111EB)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - _FILTER_BITS)).astype(np.int64)


@lru_cache(maxsize=2)
def _hashed(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's pieces as (sorted hashes, their numbers, a filter by leading bits)."""
    found = pieces(path)
    hashes = np.empty(len(found), dtype=np.uint64)
    for k, piece in enumerate(found):
        points = np.frombuffer(piece[::-1].encode("utf-32-le"), "<u4").astype(np.uint64)
        hashes[k] = (_spread(points) * _PLACES[: len(points)]).sum(dtype=np.uint64)
    order = np.argsort(hashes)
    passing = np.zeros(1 << _FILTER_BITS, dtype=bool)
    passing[_slot(hashes)] = True
    return hashes[order], order.astype(np.int32), passing


def lattice(words: list[str], vocabulary: str, first: int = 0, end: int | None = None) -> np.ndarray:
    """Piece numbers of words of one length, for pieces that end at ``first`` to ``end`` - 1: [word, end, length - 1].
    Single unknown characters are V, no piece V + 1."""
    hashes, numbers, passing = _hashed(vocabulary)
    unknown, none = len(hashes), len(hashes) + 1
    start, end = max(0, first - LONGEST_PIECE + 1), len(words[0]) if end is None else min(end, len(words[0]))
    n = end - start
    points = _spread(np.frombuffer("".join(w[start:end] for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64))
    out = np.full((len(words), n, LONGEST_PIECE), none, dtype=np.int32)
    out[:, :, 0] = unknown
    total = np.zeros_like(points)
    for k in range(min(n, LONGEST_PIECE)):
        total[:, k:] += points[:, : n - k] * _PLACES[k]
        word, last = np.nonzero(passing[_slot(total[:, k:])])
        mine = total[word, last + k]
        at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
        hit = hashes[at] == mine
        out[word[hit], last[hit] + k, k] = numbers[at[hit]]
    return out[:, first - start :]


def _alike(words: list[str]):
    """Groups of words of one length, a bounded number of positions together: lists of places."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w)].append(i)
    for n, every in by_length.items():
        step = max(1, TOGETHER // n)
        for lo in range(0, len(every), step):
            yield n, every[lo : lo + step]


def log_probabilities(words: list[str], vocabulary: str, theta: np.ndarray) -> np.ndarray:
    """[word, language] log of the sum over all segmentations. theta: [V + 2, language]; the last row is 0."""
    out = np.empty((len(words), theta.shape[1]))
    none = len(theta) - 1
    for n, at in _alike(words):
        some = [words[i] for i in at]
        reach = LONGEST_PIECE
        recent = None  # alpha of the last positions, nearest first
        scale = np.zeros((len(at), theta.shape[1]))
        for first in range(0, n, BLOCK):
            ids = lattice(some, vocabulary, first, first + BLOCK)
            longest = LONGEST_PIECE - (ids != none).any(axis=0)[:, ::-1].argmax(axis=1)  # piece that ends at a position
            if n <= BLOCK:
                reach = int(longest.max())
            if recent is None:
                recent = np.zeros((len(at), reach, theta.shape[1]))
                recent[:, 0] = 1.0
            for j in range(ids.shape[1]):
                m = longest[j]
                now = np.einsum("wkl,wkl->wl", recent[:, :m], theta[ids[:, j, :m]])
                scale += np.log(now)
                recent[:, 1:] = recent[:, :-1] / now[:, None]
                recent[:, 0] = 1.0
        out[at] = scale
    return out


def expected_counts(words: list[str], times: np.ndarray, vocabulary: str, theta: np.ndarray) -> np.ndarray:
    """Expected piece uses under theta[V + 2] of one language, by forward-backward over every segmentation.

    Forward sums are kept as ratios of neighbouring positions and backward sums as the expected number of pieces that end
    at a position, so nothing underflows however long a word is.
    """
    counts = np.zeros(len(theta))
    for n, at in _alike(words):
        some = [words[i] for i in at]
        ratio = np.zeros((len(at), LONGEST_PIECE + n))  # 1 / (alpha[j + 1] / alpha[j]), padded in front
        recent = np.zeros((len(at), LONGEST_PIECE))
        recent[:, 0] = 1.0
        for first in range(0, n, BLOCK):
            ids = lattice(some, vocabulary, first, first + BLOCK)
            for j in range(ids.shape[1]):
                step = 1 / (recent * theta[ids[:, j]]).sum(axis=1)
                ratio[:, LONGEST_PIECE + first + j] = step
                recent[:, 1:] = recent[:, :-1] * step[:, None]
                recent[:, 0] = 1.0
        ends = np.zeros((len(at), LONGEST_PIECE + n + 1))  # expected pieces that end before a position, padded in front
        ends[:, -1] = times[at]
        for first in reversed(range(0, n, BLOCK)):
            ids = lattice(some, vocabulary, first, first + BLOCK)
            use = theta[ids]
            back = np.ones(ids.shape[:2])
            for k in range(LONGEST_PIECE):
                back = back * ratio[:, LONGEST_PIECE + first - k : LONGEST_PIECE + first - k + ids.shape[1]]
                use[:, :, k] *= back
            for j in reversed(range(ids.shape[1])):
                place = LONGEST_PIECE + first + j
                use[:, j] *= ends[:, place + 1, None]
                ends[:, place - LONGEST_PIECE + 1 : place + 1] += use[:, j, ::-1]
            counts += np.bincount(ids.ravel(), weights=use.ravel(), minlength=len(theta))
    return counts


def _words(text: str) -> list[str]:
    return [START + w for w in LETTERS.findall(text.lower())]


def train(labelled: DataFrame, vocabulary: str, train_texts: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, theta[V + 2, language]) from rows (doc_id, text, lang).

    What reaches the driver is one row a language and, per round, expected counts: vocabulary x languages.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    width = len(pieces(vocabulary)) + 2
    if not languages:
        return [], np.zeros((width, 0))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, train_texts / sizes[lang])))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def count(batches):
        release_worker_cache()
        found: dict[tuple[str, str], int] = defaultdict(int)

        def counted():
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for match in LETTERS.finditer((text.as_py() or "").lower()):
                    found[lang, START + match.group()] += 1
                    if len(found) >= COUNTED_WORDS:
                        yield from counted()
        yield from counted()

    counts = staged(mapped(labelled.where(drawn).select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    theta = np.full((width, len(languages)), 1.0 / (width - 2))
    theta[-2], theta[-1] = UNKNOWN, 0.0
    number = {lang: k for k, lang in enumerate(languages)}
    sc = labelled.sparkSession.sparkContext
    for _ in range(rounds):
        current = sc.broadcast(theta)

        def expect(batches, current=current):
            release_worker_cache()
            table = current.value
            sums = np.zeros_like(table)
            for batch in batches:
                langs, words, times = batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
                own: dict[str, list[int]] = defaultdict(list)
                for i, lang in enumerate(langs):
                    own[lang].append(i)
                for lang, at in own.items():
                    sums[:, number[lang]] += expected_counts([words[i] for i in at], times[at], vocabulary, table[:, number[lang]])
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(sums[piece, lang], pa.float64())], names=["piece", "lang", "n"])

        got = mapped(counts, expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        theta = np.zeros_like(theta)
        theta[got.column("piece").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy()
        theta = theta + SMOOTHING
        theta[-2:] = 0.0
        theta /= theta.sum(axis=0)
        theta[-2] = UNKNOWN
        current.unpersist()
    discard(counts)
    return languages, theta


def _predictor(languages: list[str], theta: np.ndarray, vocabulary: str, caches: tuple[int, int] = CACHES):
    """A function from an Arrow array of texts to (language, score, letter words) lists, with its own caches."""
    release_worker_cache()
    number: dict[bytes, int] = {}  # words as written
    known = np.zeros((caches[0] + PART_WORDS, len(languages) + 1))
    run_number: dict[str, int] = {}  # letter runs
    run_known = np.zeros((caches[1] + PART_RUNS, len(languages)))
    held = [0, 0]  # bytes of the words, characters of the runs

    def learn(words: list[bytes]) -> None:
        base, runs, owners = len(number), [], []
        known[base : base + len(words)] = 0

        def settle() -> None:
            if len(run_number) > caches[1] or held[1] > CACHED_BYTES:
                run_number.clear()
                held[1] = 0
            new = [r for r in dict.fromkeys(runs) if r not in run_number]
            if new:
                run_known[len(run_number) : len(run_number) + len(new)] = log_probabilities(new, vocabulary, theta)
                run_number.update(zip(new, range(len(run_number), len(run_number) + len(new)), strict=True))
                held[1] += sum(map(len, new))
            owner = np.array(owners, dtype=np.int64)
            np.add.at(known, (owner, slice(0, len(languages))), run_known[np.fromiter(map(run_number.__getitem__, runs), np.int64, len(runs))])
            np.add.at(known[:, -1], owner, 1)
            runs.clear()
            owners.clear()

        for k, word in enumerate(words):
            for match in LETTERS.finditer(word.decode().lower()):
                runs.append(START + match.group())
                owners.append(base + k)
                if len(runs) >= PART_RUNS:
                    settle()
        settle()
        number.update(zip(words, range(base, base + len(words)), strict=True))
        held[0] += sum(map(len, words))

    def totals(texts: list[bytes]):
        """Summed word vectors of some texts, whose new words are learned together."""
        parts = [text.split() for text in texts]
        for words in parts:
            total = np.zeros(len(languages) + 1)
            for lo in range(0, len(words), PART_WORDS):
                part = words[lo : lo + PART_WORDS]
                try:
                    at = np.fromiter(map(number.__getitem__, part), np.int64, len(part))
                except KeyError:
                    near = set(part).union(*parts) if lo == 0 and sum(map(len, parts)) <= PART_WORDS else set(part)
                    if len(number) > caches[0] or held[0] > CACHED_BYTES:
                        number.clear()
                        held[0] = 0
                    learn([w for w in near if w not in number])
                    at = np.fromiter(map(number.__getitem__, part), np.int64, len(part))
                total += known[at].sum(axis=0)
            yield total

    def predicted(texts: pa.Array):
        best, score, lettered = [], [], []

        def judge(some: list[bytes]) -> None:
            for total in totals(some):
                words = int(round(total[-1]))
                lettered.append(words)
                if not words or not languages:
                    best.append(UNDETERMINED)
                    score.append(0.0)
                else:
                    gap = np.exp(np.maximum(total[:-1] - total[:-1].max(), -700))
                    top = int(gap.argmax())
                    best.append(languages[top])
                    score.append(float(gap[top] / gap.sum()))

        some, size = [], 0
        for text in pc.cast(pc.fill_null(texts, ""), pa.binary()):
            some.append(text.as_py())
            size += len(some[-1])
            if size >= TEXT_BYTES:
                judge(some)
                some, size = [], 0
        judge(some)
        return best, score, lettered

    return predicted


def predict(texts: DataFrame, languages: list[str], theta: np.ndarray, vocabulary: str) -> DataFrame:
    """(doc_id, lang_pred, score, n_letter_words) for rows (doc_id, text). Map-only over whole texts."""
    model = texts.sparkSession.sparkContext.broadcast(theta)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        predicted = _predictor(languages, model.value, vocabulary)
        for batch in batches:
            best, score, lettered = predicted(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(lettered, pa.int64())], names=["doc_id", "lang_pred", "score", "n_letter_words"])

    return mapped(texts, run, f"doc_id {kind}, lang_pred string, score double, n_letter_words long")


def relabelled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, caches: tuple[int, int] = CACHES) -> DataFrame:
    """``df`` with each row's language replaced by the predicted one, rows without a language dropped. Map-only after
    the learning, so no text is joined or shuffled; other columns stay."""
    path = vocabulary or default_vocabulary()
    languages, theta = train(_labelled(only(df, doc_id=id_col, text=text_col, lang=lang_col)), path)
    model = df.sparkSession.sparkContext.broadcast(theta)
    names = [f.name for f in df.schema.fields]
    text_at, lang_at = names.index(text_col), names.index(lang_col)

    def run(batches):
        predicted = _predictor(languages, model.value, path, caches)
        for batch in batches:
            best = pa.array(predicted(batch.column(text_at))[0], pa.string())
            yield batch.set_column(lang_at, batch.schema.field(lang_at), best.cast(batch.schema.field(lang_at).type)).filter(pc.not_equal(best, UNDETERMINED))

    return mapped(df, run, df.schema)


def held_out(doc_id: Column) -> Column:
    """Ids that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """Learn from the labelled rows that aren't held out, then predict every row."""
    path = vocabulary or default_vocabulary()
    rows = only(df, doc_id=id_col, text=text_col, lang=lang_col)
    languages, theta = train(_labelled(rows), path)
    return predict(rows.select("doc_id", "text"), languages, theta, path).withColumn("held_out", held_out(F.col("doc_id")))
