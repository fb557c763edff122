"""Hybrid retrieval for batches of questions (J1–J6, A1–A4, A15, W1, W8, K1–K6, K12, C10–C13).

chunks:   chunk_id, file_path, text and payload columns
postings: chunk_id, term, tf, weight           (one shuffle by term; cluster it by term for repeated use)
stats:    term, df
Every ranking has a total order, so results don't depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.functions import text as T
from docloom.functions.text import SEQUENCE_QUESTION, normal_form, numbered_items, sequence_score, terms, trim
from docloom.functions.vectors import bm25_weight, dot, idf, norm
from docloom.sources.scratch import materialised

#: Bytes that may be broadcast after they were measured; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of vectors in a block of questions and in one of rows; every question block meets every row block once.
QUESTION_BLOCK, VECTOR_BLOCK = 8 << 20, 4 << 20
#: Bytes by which a value of a type is taken into account before it is measured.
_WIDTHS = {"string": 64, "binary": 256}


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A side that is proven small is computed once and broadcast; a larger one is returned as it is. What the driver
    takes is bounded by rows (by their types' usual widths) and then measured."""
    width = sum(_WIDTHS.get(kind, 2048 if kind.startswith(("array", "struct", "map")) else 8) for _, kind in df.dtypes)
    rows = max(1, most // width)
    got = df.limit(rows + 1).toArrow()
    if got.num_rows > rows or got.nbytes > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema))


def postings(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, weight, n_terms): one row per distinct term of a text. Terms are sorted and counted inside their row,
    so nothing is shuffled before the index itself is clustered."""

    def counted(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        return T.let(starts, lambda s: F.transform(s, lambda p, k: F.struct(F.get(t, p).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - p).cast("long").alias("tf"))))

    listed = texts.select(id_col, terms(F.col(text_col)).alias("_t")).where(F.size("_t") > 0)
    rows = listed.select(id_col, F.size("_t").alias("_n"), T.let(F.sort_array("_t"), counted).alias("_c"))
    each = rows.select(id_col, "_n", F.size("_c").alias("n_terms"), F.explode("_c").alias("c"))
    return each.select(id_col, F.col("c.term").alias("term"), F.col("c.tf").alias("tf"), bm25_weight(F.col("c.tf"), F.col("_n")).alias("weight"), "n_terms")


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def text_term_stats(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) straight from texts; counts combine before the only shuffle."""
    return texts.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, weight): questions go through the texts' encoder, so repeated terms saturate."""
    return postings(questions, "query_id", "question").select("query_id", "term", F.col("weight").alias("query_weight"))


def postings_of(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """The postings of the questions' terms only, straight from the texts: a broadcast join drops all other terms before
    anything is counted or moved."""
    wanted = small(question_terms(questions).select("term").distinct())
    listed = texts.select("chunk_id", terms(F.col("text")).alias("_t")).where(F.size("_t") > 0)
    each = listed.select("chunk_id", F.size("_t").alias("_n"), F.size(F.array_distinct("_t")).alias("n_terms"), F.explode("_t").alias("term")).join(wanted, "term")
    counted = each.groupBy("chunk_id", "_n", "n_terms", "term").agg(F.count("*").alias("tf"))
    return counted.select("chunk_id", "term", "tf", bm25_weight(F.col("tf"), F.col("_n")).alias("weight"), "n_terms")


def asked_terms(questions: DataFrame, posted: DataFrame, n_documents: int) -> DataFrame:
    """(query_id, term, query_weight, idf) of the questions' terms. Document frequencies are counted over the whole
    collection; ``posted`` may hold all postings or those of the questions."""
    mine = question_terms(questions)
    stats = term_stats(posted.join(small(mine.select("term").distinct()), "term"))
    return small(mine.join(stats, "term").select("query_id", "term", "query_weight", idf(F.lit(n_documents), F.col("df")).alias("idf")))


def matched(questions: DataFrame, posted: DataFrame, n_documents: int) -> DataFrame:
    """Postings that meet a question's term, with the question's weights."""
    return posted.join(asked_terms(questions, posted, n_documents), "term")


def sparse_scores(questions: DataFrame, posted: DataFrame, n_documents: int) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a term; idf is taken over the whole collection, not a scope."""
    return matched(questions, posted, n_documents).groupBy("query_id", "chunk_id").agg(bm25_score().alias("score"))


def bm25_score() -> Column:
    """The aggregate over ``matched`` rows of a question and a chunk."""
    return F.round(F.sum(F.col("weight") * (F.col("query_weight") * F.col("idf"))), 6)


def dense_scores(questions: DataFrame, vectors: DataFrame, query_col: str = "vector", dense_col: str = "dense", keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, score, and the vectors' columns to keep): exact cosine of every question with every vector (the
    stated query set against all rows, a block of questions after the other if they aren't small); norms are taken once
    per row."""
    asked = questions.select("query_id", F.col(query_col).alias("_q"), norm(F.col(query_col)).alias("_qn"))
    v = vectors.select("chunk_id", *keep, F.col(dense_col).alias("_v"), norm(F.col(dense_col)).alias("_vn"))
    score = F.coalesce(F.try_divide(dot(F.col("_q"), F.col("_v")), F.col("_qn") * F.col("_vn")), F.lit(0.0))
    found = None
    for block in query_blocks(asked):
        part = v.join(block).select("query_id", "chunk_id", *keep, F.round(score, 6).alias("score"))
        found = part if found is None else found.union(part)
    return found


def dense_top(questions: DataFrame, vectors: DataFrame, limit: int, query_col: str = "vector", dense_col: str = "dense") -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``limit`` nearest vectors of every question, exactly those that ranking all of
    ``dense_scores`` gives. Questions and vectors meet in a grid of blocks; a block's matrix product says which of its
    pairs can be among the first, and only those are scored in full and leave the block."""
    from pyspark.sql.types import DoubleType, StructType

    asked = questions.select("query_id", F.col(query_col).cast("array<double>").alias("_q"))
    v = vectors.select("chunk_id", F.col(dense_col).cast("array<double>").alias("_v"))
    rows = lambda df, c, most: int(-(-(df.agg(F.sum(F.coalesce(F.size(c), F.lit(0)) * 8 + 64)).first()[0] or 0) // most)) or 1
    n_q, n_v = rows(asked, "_q", QUESTION_BLOCK), rows(v, "_v", VECTOR_BLOCK)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(2 * n_q * n_v, 2000)
    left = asked.select("*", block("query_id", n_q).alias("_qb")).select("*", every(n_v).alias("_vb")).repartition(tasks, "_qb", "_vb")
    right = v.select("*", block("chunk_id", n_v).alias("_vb")).select("*", every(n_q).alias("_qb")).repartition(tasks, "_qb", "_vb")

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        at, of, scores = nearest(q.column("_q"), v.column("_v"), v.column("chunk_id"), limit)
        return pa.table({"query_id": q.column("query_id").take(at), "chunk_id": v.column("chunk_id").take(of), "score": pa.array(scores, pa.float64())})

    schema = StructType([asked.schema["query_id"], v.schema["chunk_id"]]).add("score", DoubleType())
    found = left.groupBy("_qb", "_vb").cogroup(right.groupBy("_qb", "_vb")).applyInArrow(meet, schema)
    return ranked(found.withColumn("score", F.round("score", 6)), limit)


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (rows, their vectors); rows with a null are in none."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    holes = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) if flat.null_count else np.zeros(0, int)
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    whole = lengths > 0
    whole[np.searchsorted(starts + np.maximum(lengths, 0), holes, "right")] = False
    found = {}
    for length in np.unique(lengths[whole]).tolist():
        rows = np.flatnonzero(whole & (lengths == length))
        found[length] = rows, values[starts[rows][:, None] + np.arange(length)]
    return found


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed in order as ``vectors.dot`` does."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def nearest(questions: pa.ChunkedArray, vectors: pa.ChunkedArray, ids: pa.ChunkedArray, limit: int, step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of questions, places of vectors, cosines): all pairs that can be among a question's first ``limit`` once
    cosines are rounded to 6 digits and ties go by id. Of equal cosines the first ``limit`` by id are enough."""
    n = len(vectors)
    place = np.empty(n, np.int64)
    place[pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy(zero_copy_only=False) if n else []] = np.arange(n)
    asked, held = _matrices(questions), _matrices(vectors)
    known = {}
    with np.errstate(all="ignore"):
        for side in (asked, held):
            for length, (rows, m) in side.items():
                norms = np.sqrt(_folded(m, m))
                unit = m / norms[:, None]
                unit[norms == 0] = 0.0
                unit[~(np.isfinite(norms) & ((norms == 0) | (norms > 1e-150)))] = np.nan  # can't be judged: scored in full
                side[length] = rows, m, norms, unit
        for length, (rows, *_) in asked.items():
            known |= {row: (length, k) for k, row in enumerate(rows.tolist())}
        out = []
        groups = [(length, rows[lo : lo + step]) for length, (rows, *_) in asked.items() for lo in range(0, len(rows), step)]
        rest = np.array([k for k in range(len(questions)) if k not in known], np.int64)
        groups += [(None, rest[lo : lo + step]) for lo in range(0, len(rest), step)]
        for length, rows in groups if n else ():
            rough = np.zeros((len(rows), n))
            if length in held:
                own = np.searchsorted(asked[length][0], rows)
                rough[:, held[length][0]] = asked[length][3][own] @ held[length][3].T
                rough[np.isnan(rough)] = np.inf
            least = np.partition(rough, n - limit, axis=1)[:, n - limit, None] if n > limit else -np.inf
            q, v = np.nonzero(rough >= least - 2e-6)
            score = np.zeros(len(q))
            if length in held:
                _, m, norms, _ = held[length]
                inner = np.full(n, -1)
                inner[held[length][0]] = np.arange(len(m))
                real = np.flatnonzero(inner[v] >= 0)
                for lo in range(0, len(real), 65_536):
                    some = real[lo : lo + 65_536]
                    a, b = own[q[some]], inner[v[some]]
                    below = asked[length][2][a] * norms[b]
                    score[some] = np.where(below == 0, 0.0, _folded(asked[length][1][a], m[b]) / below)
            order = np.where(np.isnan(score), np.inf, score)
            by = np.lexsort((place[v], -order, q))
            q, v, score, order = q[by], v[by], score[by], order[by]
            starts = np.searchsorted(q, np.arange(len(rows)))
            ends = np.searchsorted(q, np.arange(len(rows)), "right")
            last = order[np.minimum(starts + limit, ends) - 1]
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (order[1:] != order[:-1])])
            nth = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
            keep = (nth < limit) & (order >= last[q] - 1e-6)
            out.append((rows[q[keep]], v[keep], score[keep]))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(empty, *out, strict=True))


def query_blocks(asked: DataFrame, most: int = BROADCAST_BYTES) -> list[DataFrame]:
    """Questions with vectors as sides that may be broadcast: one if they are small, else as many as their size asks for."""
    one = small(asked, most)
    if one is not asked:
        return [one]
    kept = materialised(asked, "questions")
    size = kept.agg(F.sum(F.size("_q") * 8 + 64)).first()[0]
    n = 2 * -(-size // most)
    return [F.broadcast(kept.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)) for k in range(n)]


def in_scope(chunks: DataFrame, chat_id: str | None = None, file_paths: list[str] | None = None) -> DataFrame:
    """A chat wins over paths; no scope is no filter. Pushed to the scan, and to partitions for the chat."""
    if chat_id:
        return chunks.where(F.col("document_chat_id") == chat_id)
    return chunks.where(F.col("file_path").isin(*file_paths)) if file_paths else chunks


def ranked(scores: DataFrame, limit: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first ``limit`` of each key with their rank; ties by chunk."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id"))
    return scores.withColumn("rank", n.cast("long")).where(F.col("rank") <= limit)


def searchable(scores: DataFrame, top_k: int = 8, settings: Settings = DEFAULTS) -> DataFrame:
    """The scores that a two-phase search can look at: the first of each (question, file). The first of a question over
    all files are among them, so nothing else needs to be kept."""
    return ranked(scores, max(3 * top_k, settings.broad_search_top_k), ("query_id", "file_path")).drop("rank")


def fused(rankings: list[DataFrame], keys: tuple[str, ...] = ("query_id",), k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion: (keys, chunk_id, rrf, first_list, first_rank). A union and one aggregate with map-side
    combination take the place of a full outer join."""
    parts = [r.select(*keys, "chunk_id", "rank", F.lit(i).alias("_list")) for i, r in enumerate(rankings)]
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    first = F.min(F.struct("_list", "rank"))
    summed = every.groupBy(*keys, "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), 9).alias("rrf"), first.alias("_f"))
    return summed.select(*keys, "chunk_id", "rrf", F.col("_f._list").alias("first_list"), F.col("_f.rank").alias("first_rank"))


def select_sources(hits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, file_path, best): files whose best hit is near the question's best. hits: query_id, file_path, rrf."""
    best = hits.where(F.coalesce(F.col("file_path"), F.lit("")) != "").groupBy("query_id", "file_path").agg(F.max("rrf").alias("best"))
    top = F.max("best").over(Window.partitionBy("query_id"))
    floor = F.greatest(F.lit(settings.search_rrf_threshold), F.lit(settings.source_selection_ratio) * F.col("_top"))
    return best.withColumn("_top", top).where(F.col("best") >= floor).drop("_top")


def keep_first_text(rows: DataFrame, keys: list[str], order: list[Column], text: Column) -> DataFrame:
    """Of rows with equal text in a key the first stays; empty texts go."""
    first = F.row_number().over(Window.partitionBy(*keys, "_same").orderBy(*order))
    return rows.withColumn("_same", text).where(F.coalesce(F.col("_same"), F.lit("")) != "").withColumn("_n", first).where("_n = 1").drop("_same", "_n")


def two_phase_search(sparse: DataFrame, dense: DataFrame, chunks: DataFrame, top_k: int = 8, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, file_path, text, rrf, pos): the search of a whole batch of questions in one plan.

    sparse, dense: (query_id, chunk_id, file_path, score) over the scope. Phase 1 ranks over all files and selects sources;
    phase 2 ranks within each (question, selected file), fuses, drops weak hits and repeated texts. Texts join last, for
    the candidates only.
    """
    lists, keys = [dense, sparse], ("query_id", "file_path")
    broad = fused([ranked(s, settings.broad_search_top_k) for s in lists], keys, settings.rrf_k)  # a chunk has one file
    sources = small(select_sources(broad, settings))
    limit = max(3 * top_k, settings.broad_search_top_k)
    again = [ranked(s.join(sources.select(*keys), list(keys)), limit, keys) for s in lists]
    found = small(fused(again, keys, settings.rrf_k).join(sources, list(keys)).where(F.col("rrf") >= settings.search_rrf_threshold))
    order = [F.desc("rrf"), F.desc("best"), F.col("file_path"), F.col("chunk_id")]
    with_text = chunks.select("chunk_id", "text").join(found, "chunk_id")  # candidates go to the texts, not texts to them
    first = keep_first_text(with_text, ["query_id"], order, trim(F.coalesce(F.col("text"), F.lit(""))))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return first.withColumn("pos", pos.cast("long")).where(F.col("pos") <= top_k).select("query_id", "chunk_id", "file_path", "text", "rrf", "pos")


def sequence_anchors(hits: DataFrame) -> DataFrame:
    """(query_id, file_path, source_segment, anchor_rrf): the likeliest procedure chunk of each question that asks for
    steps. hits: query_id, question, pos, rrf, text, section, chunk_count, source_segment, file_path."""
    able = hits.where(F.col("question").rlike(SEQUENCE_QUESTION) & (F.col("chunk_count") > 1) & F.col("source_segment").isNotNull())
    scored = able.withColumns({"_s": sequence_score(F.col("text"), F.col("section")), "_n": numbered_items(F.coalesce(F.col("text"), F.lit("")))})
    best = scored.groupBy("query_id").agg(F.max(F.struct("_s", "_n", (-F.col("pos")).alias("_p"), "file_path", "source_segment", "rrf")).alias("a"))
    return best.where("a._s > 0 and coalesce(a.file_path, '') <> ''").select("query_id", "a.file_path", "a.source_segment", F.col("a.rrf").alias("anchor_rrf"))


def expand_sequences(hits: DataFrame, chunks: DataFrame, top_k: int = 8, siblings: int = 100) -> DataFrame:
    """Put the anchor's whole segment first, in order, with the anchor's score; other hits follow.

    hits: see sequence_anchors, with chunk_id; chunks: chunk_id, file_path, source_segment, chunk_index, text.
    """
    anchors = sequence_anchors(hits)
    near = chunks.join(anchors, ["file_path", "source_segment"])
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    near = near.withColumn("_n", nth).where(F.col("_n") <= siblings)
    first = near.select("query_id", "chunk_id", F.col("anchor_rrf").alias("rrf"), "text", F.lit(0).alias("_group"), F.col("chunk_index").cast("long").alias("_at"))
    rest = hits.join(near.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "rrf", "text", F.lit(1).alias("_group"), F.col("pos").cast("long").alias("_at"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("_group", "_at", "chunk_id"))
    return first.union(rest).withColumn("pos", pos.cast("long")).where(F.col("pos") <= top_k).select("query_id", "chunk_id", "rrf", "text", "pos")


def merge_routes(structured: DataFrame, hybrid: DataFrame, top_k: int = 8) -> DataFrame:
    """Tree hits, then hybrid hits, equal texts once, ``top_k`` in all. Both: query_id, pos, text and more columns."""
    both = structured.withColumn("route", F.lit("structured")).unionByName(hybrid.withColumn("route", F.lit("hybrid")), allowMissingColumns=True)
    order = [F.desc("route"), F.col("pos")]
    kept = keep_first_text(both, ["query_id"], order, normal_form(F.col("text")))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return kept.withColumn("merged_pos", pos.cast("long")).where(F.col("merged_pos") <= top_k)
