"""Personal data by weak supervision.

Candidates are spans found by base patterns (also the matches that fail their checks), key-like tokens and titled
names. Labelers of three sorts vote on each candidate: regexes and checks of form, gazetteers, and context. A vote is
1 (personal), -1 (not) or 0 (abstains). Expectation-maximisation over the counts of vote patterns of all candidates
estimates how reliable each labeler is, without labels; its posteriors are the soft labels of a final logistic span
classifier. The classifier sees the votes, the kind and the length, and by hashed features what the labelers don't: the
span's shape, its first and last characters, and the words before and after it. Spans that pass their base check are
always reported; the classifier adds others.

At most kinds x 3**labelers x lengths rows of counts reach the driver, and SAMPLE candidates (expected; picked by a
hash of id and place) on which the classifier is fitted.

Null and empty texts have no spans. Offsets are code points, end exclusive. A text is walked once for each kind and its
spans are settled in one sorted sweep, so very long texts take time in proportion. Ties: of two candidates that start
together the kind listed first comes first; a candidate that overlaps a span already settled is left out. Rows with null
ids and repeated rows get results like others; extra columns play no part. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, mapped, only, release_worker_cache, staged

#: Kinds in the order that ties follow; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "name")
BASE = 4
EM_ROUNDS = 50
FIT_ROUNDS = 200
ACCEPT = 0.5
#: Candidates that the classifier is fitted on, and its hashed features.
SAMPLE = 40_000
HASHED = 4096

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never starts inside a run of digits: the run's first digit would have matched as well.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9])")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?")
DIGIT = re.compile(r"[0-9]")

#: Public lists that gazetteer labelers look up.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int io co info biz name pro app dev ai me tv cc xyz online site shop store blog cloud tech eu de fr es uk us it nl be ch at pl cz sk hu ro bg gr pt ie dk se no fi is ee lv lt ua ru tr il ae sa eg za ng ke ma in pk bd lk cn hk tw jp kr sg my th vn id ph au nz ca mx br ar cl pe ve uy".split()
)
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "38", "60", "62", "65")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91")
RESERVED_NETS = ("0.", "10.", "127.", "169.254.", "192.168.", "224.", "255.")
GIVEN_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Paul Ashley Steven Kimberly Andrew Emily Kenneth Donna George Michelle Joshua Carol Kevin Amanda Brian Melissa Edward Deborah Maria Anna Hans Peter Klaus Jürgen Stefan Andreas Wolfgang Sabine Monika Petra Ursula Heike Jean Marie Pierre Michel Alain Philippe Nathalie Isabelle Sylvie Catherine Carlos Juan Ana José Luis Carmen Javier Miguel Lucía Pablo Sofía Elena Giuseppe Giovanni Paolo Francesca Marco Ivan Olga Sergei Natalia Ahmed Mohammed Fatima Ali Omar Wei Li Ming Yuki Hiroshi Kenji Priya Raj Amit".split()
)
SECRET_WORDS = re.compile(r"(?:key|token|secret|password|passwd|pwd|credential|auth)\w*\s*[=:]\s*[\"']?$", re.IGNORECASE)
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|mailto", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|account|payment", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|mobile|fax|contact", re.IGNORECASE),
    "secret": re.compile(r"key|token|secret|password|auth", re.IGNORECASE),
    "name": re.compile(r"dear|by|from|signed|author|contact", re.IGNORECASE),
}
OTHER_CONTEXT = re.compile(r"version|isbn|issn|commit|checksum|sha\d*|revision|licen[sc]e|release", re.IGNORECASE)
LABELERS = ("form", "check", "gazetteer", "near_word", "other_word", "edges")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches: the local part is the whole run before an @, so each text is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def _merged(intervals: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the union of intervals, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(intervals):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _overlaps(merged: tuple[list[int], list[int]], start: int, end: int) -> bool:
    k = bisect_left(merged[0], end) - 1
    return k >= 0 and merged[1][k] > start


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, passes its base check) of every candidate."""
    out = []
    if "@" in text:
        out += [(0, a, b, True) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(1, m.start(), m.end(), all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))) for m in IP.finditer(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19:
                    out.append((2, m.start(), m.end(), luhn(digits)))
        if "+" in text:
            out += [(3, m.start(), m.end(), 9 <= sum(map(str.isdigit, m.group())) <= 15) for m in PHONE.finditer(text)]
        taken = _merged([(a, b) for _, a, b, passes in out if passes])
        out += [(4, m.start(), m.end(), False) for m in SECRET.finditer(text) if not _overlaps(taken, m.start(), m.end())]
    out += [(5, m.start(), m.end(), False) for m in NAME.finditer(text)]
    return out


def votes(text: str, kind: int, start: int, end: int, passes: bool) -> tuple[int, ...]:
    """The labelers' votes on one candidate, in the order of LABELERS."""
    value, name, before = text[start:end], KINDS[kind], text[max(0, start - 40) : start]
    digits = "".join(c for c in value if c.isdigit())
    if kind == 0:
        top = value.rpartition(".")[2].lower()
        form, check, gazetteer = (1 if top.isalpha() and 2 <= len(top) <= 24 else -1), (1 if passes and ".." not in value else -1), (1 if top in TOP_DOMAINS else -1)
    elif kind == 1:
        form, check, gazetteer = (-1 if any(len(p) > 1 and p[0] == "0" for p in value.split(".")) else 1), (1 if passes else -1), (-1 if value.startswith(RESERVED_NETS) else 1)
    elif kind == 2:
        form, check, gazetteer = (1 if len(digits) in (14, 15, 16) else 0), (1 if passes else -1), (1 if digits.startswith(CARD_PREFIXES) else -1)
    elif kind == 3:
        form, check, gazetteer = (1 if len(digits) >= 10 else -1), (1 if passes else -1), (1 if digits.startswith(CALLING_CODES) else -1)
    elif kind == 4:
        plain = set(value.lower()) <= set("0123456789abcdef")
        form, check = (1 if plain and len(value) in (32, 40, 64) else 0), (1 if 0.15 <= len(digits) / len(value) <= 0.85 and len(set(value)) >= 8 else -1)
        gazetteer = 1 if SECRET_WORDS.search(before) else -1
    else:
        form, check, gazetteer = 0, (1 if len(value.split()) == 3 else 0), (1 if any(w in GIVEN_NAMES for w in value.split()) else -1)
    near = 1 if CONTEXT[name].search(before) else 0
    other = -1 if OTHER_CONTEXT.search(before[-25:]) else 0
    edge = (text[start - 1 : start], text[end : end + 1])
    return form, check, gazetteer, near, other, -1 if any(c.isalnum() for c in edge) else 1


WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W\d_]*$")
WORD_AFTER = re.compile(r"^[\W\d_]*([^\W\d_]+)")
SHAPES = ((re.compile("[A-Z]+"), "A"), (re.compile("[a-z]+"), "a"), (re.compile("[0-9]+"), "9"))


def hashed_features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Numbers below HASHED for a candidate's shape, edges and neighbouring words."""
    value = text[start:end]
    shape = value
    for pattern, sign in SHAPES:
        shape = pattern.sub(sign, shape)
    before, after = WORD_BEFORE.search(text[max(0, start - 30) : start]), WORD_AFTER.search(text[end : end + 30])
    seen = (shape[:24], value[:3].lower(), value[-3:].lower(), before.group(1).lower() if before else "", after.group(1).lower() if after else "")
    return [zlib.crc32(f"{kind}{k}{x}".encode("utf-8", "replace")) % HASHED for k, x in enumerate(seen)]


def _pattern(kind: int, vote: tuple[int, ...], length: int) -> int:
    code = kind
    for v in vote:
        code = code * 3 + v + 1
    return code * 8 + min(7, length.bit_length() - 1)


def _features(code: int) -> tuple[int, list[int], int]:
    length, code = code % 8, code // 8
    vote = []
    for _ in LABELERS:
        vote.append(code % 3 - 1)
        code //= 3
    return code, vote[::-1], length


def candidates(texts: DataFrame) -> DataFrame:
    """Per text: base counts and digest, and (kind, start, end, base, pattern, features) of every candidate."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        release_worker_cache()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = _described(text.as_py() or "")
                base = [(s["kind"], s["start"], s["end"]) for s in found if s["base"]]
                rows.append((*[sum(s[0] == k for s in base) for k in range(BASE)], hashlib.sha256(joined(base).encode()).hexdigest(), found))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), pa.array(columns[5], SPAN_ARROW)],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"],
            )

    return mapped(texts, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind:int,start:long,end:long,base:boolean,pattern:long,features:array<int>>>")


SPAN_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int64()), ("features", pa.list_(pa.int32()))]))


def joined(found) -> str:
    return ",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in found)


def reliabilities(patterns: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """(posterior that a pattern's candidates are personal, P(vote | class) as [class, labeler, vote]).

    Dawid-Skene with two classes and a prior for each kind, started from the votes' sums. No patterns: no posteriors.
    """
    codes = list(patterns)
    if not codes:
        return {}, np.full((2, len(LABELERS), 3), 1 / 3)
    seen = [_features(c) for c in codes]
    kind = np.array([s[0] for s in seen])
    vote = np.array([s[1] for s in seen]) + 1
    n = np.array([patterns[c] for c in codes], dtype=float)
    lean = (vote - 1).sum(axis=1)
    p = 1 / (1 + np.exp(-1.5 * (lean - 0.5)))
    rate = np.zeros((2, len(LABELERS), 3))
    for _ in range(rounds):
        prior = np.array([((p * n)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        for c, weight in enumerate((n * (1 - p), n * p)):
            for j in range(len(LABELERS)):
                rate[c, j] = np.bincount(vote[:, j], weights=weight, minlength=3) + 1.0
                rate[c, j] /= rate[c, j].sum()
        logit = np.log(prior[kind]) - np.log1p(-prior[kind])
        for j in range(len(LABELERS)):
            logit += np.log(rate[1, j, vote[:, j]]) - np.log(rate[0, j, vote[:, j]])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(codes, p.tolist(), strict=True)), rate


def _vector(code: int) -> np.ndarray:
    kind, vote, length = _features(code)
    x = np.zeros(len(KINDS) + 3 * len(LABELERS) + 8)
    x[kind] = 1
    for j, v in enumerate(vote):
        x[len(KINDS) + 3 * j + v + 1] = 1
    x[len(KINDS) + 3 * len(LABELERS) + length] = 1
    return x


@dataclass(frozen=True)
class Classifier:
    """Weights of the span classifier: of the vote pattern's features, and of the hashed ones."""

    dense: np.ndarray
    hashed: np.ndarray

    def scorer(self):
        """A function from a described candidate to the probability that it is personal."""
        logit: dict[int, float] = {}

        def score(span: dict) -> float:
            code = span["pattern"]
            if code not in logit:
                logit[code] = float(_vector(code) @ self.dense)
            return float(1 / (1 + np.exp(-np.clip(logit[code] + self.hashed[span["features"]].sum(), -30, 30))))

        return score


N_DENSE = len(KINDS) + 3 * len(LABELERS) + 8
UNTRAINED = Classifier(np.zeros(N_DENSE), np.zeros(HASHED))


def span_classifier(codes: list[int], features: list[list[int]], posterior: dict[int, float], rounds: int = FIT_ROUNDS) -> Classifier:
    """A logistic regression on the soft labels of sampled candidates. Frequent patterns count by the root of their number,
    so that rare kinds have a say; hashed weights are held small."""
    if not codes:
        return UNTRAINED
    seen, row = np.unique(np.array(codes), return_inverse=True)
    dense = np.stack([_vector(int(c)) for c in seen])
    y, times = np.array([posterior[int(c)] for c in seen])[row], np.bincount(row)
    n = 1 / np.sqrt(times[row])
    n /= n.sum()
    x = np.array(features, dtype=np.int64)
    w, v = np.zeros(N_DENSE), np.zeros(HASHED)
    speed_w, speed_v = np.zeros_like(w), np.zeros_like(v)
    for _ in range(rounds):
        error = n * (1 / (1 + np.exp(-np.clip((dense @ w)[row] + v[x].sum(axis=1), -30, 30))) - y)
        speed_w = 0.9 * speed_w - (dense.T @ np.bincount(row, weights=error, minlength=len(seen)) + 1e-4 * w)
        speed_v = 0.9 * speed_v - (np.bincount(x.ravel(), weights=np.repeat(error, x.shape[1]), minlength=HASHED) + 1e-3 * v)
        w, v = w + speed_w, v + speed_v
    return Classifier(w, v)


def fitted(seen: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier learned from a table of candidates (doc_id, found)."""
    each = seen.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.start", "s.pattern", "s.features")
    patterns = {r["pattern"]: r["n"] for r in each.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior, _ = reliabilities(patterns)
    share = sample / max(1, sum(patterns.values()))
    picked = each.where(F.pmod(F.xxhash64("doc_id", "start", "pattern"), F.lit(1_000_000)) < F.lit(int(min(1.0, share) * 1_000_000)))
    got = picked.select("pattern", "features").toArrow()
    order = sorted(zip(got.column("pattern").to_pylist(), got.column("features").to_pylist(), strict=True))
    return span_classifier([c for c, _ in order], [f for _, f in order], posterior)


def learned(texts: DataFrame) -> Classifier:
    """The classifier learned from (doc_id, text) rows."""
    seen = staged(candidates(texts).select("doc_id", "found"), "candidates")
    classifier = fitted(seen)
    discard(seen)
    return classifier


def _accept(found: list[dict], score) -> list[dict]:
    """Base spans, and the others that the classifier accepts where they overlap none before them; found is in order."""
    base = _merged([(s["start"], s["end"]) for s in found if s["base"]])
    got, end = [], 0
    for s in found:
        if s["base"]:
            got.append(s)
        elif s["start"] >= end and not _overlaps(base, s["start"], s["end"]) and score(s) >= ACCEPT:
            got.append(s)
            end = s["end"]
    return got


def _described(text: str) -> list[dict]:
    found = sorted(spans(text), key=lambda s: (s[1], s[0]))
    return [{"kind": k, "start": a, "end": b, "base": ok, "pattern": _pattern(k, votes(text, k, a, b, ok), b - a), "features": hashed_features(text, k, a, b)} for k, a, b, ok in found]


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, found) per text; n_spans counts the accepted
    spans and found lists them as (kind, start, end, score). Texts are read once: candidates go to the shared folder."""
    seen = staged(candidates(only(df, doc_id=id_col, text=text_col)), "candidates")
    classifier = fitted(seen)
    kind = seen.schema["doc_id"].dataType.simpleString()
    keep = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        score = classifier.scorer()
        for batch in batches:
            rows = [_accept(found or [], score) for found in batch.column("found").to_pylist()]
            texts = [joined([(s["kind"], s["start"], s["end"]) for s in got]) for got in rows]
            found = [[{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "score": score(s)} for s in got] for got in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(got) for got in rows], pa.int64()), pa.array(found, arrow)], names=[*keep, "spans", "n_spans", "found"])

    return mapped(seen, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, found array<struct<kind:string,start:long,end:long,score:double>>")


def mask(text: str, found: list[dict]) -> str:
    """A text with each accepted span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with personal data masked in the text; rows, order of columns and other columns stay.

    The classifier is learned over all texts first; then spans and masks are made where the text is, so no text is
    joined or shuffled.
    """
    classifier = learned(only(df, doc_id=id_col, text=text_col))
    name = [f.name for f in df.schema.fields].index(text_col)

    def run(batches):
        score = classifier.scorer()
        for batch in batches:
            texts = []
            for text in batch.column(name):
                text = text.as_py()
                texts.append(text if text is None else mask(text, [{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"]} for s in _accept(_described(text), score)]))
            yield batch.set_column(name, batch.schema.field(name), pa.array(texts, batch.schema.field(name).type))

    return mapped(df, run, df.schema)
