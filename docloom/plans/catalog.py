"""Registered queries: each applies library operators to whole driver tables, with the SQL that must agree."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import BM25_B, BM25_K, BM25_MEAN_LENGTH, DEFAULTS, NO_MODEL
from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import answers, chunking, layout, retrieval, structure, tables
from docloom.plans import pipeline
from docloom.sources import files, store
from docloom.sources.scratch import folder, materialised

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_files(spark, sf_dir):
    """Documents as text files: (path, content)."""
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").cast("binary").alias("content"))


def rows_sql(rows: list[tuple], columns: str) -> str:
    """A VALUES table for SQL."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS v({columns})"


# --- scans and scalar functions -------------------------------------------------------------------------------------

#: Sentence boundaries for an engine without lookbehind: marks are put in and split on.
SENTENCES_SQL = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])(?:\s+|\[web:\d+\]\s*)', '\1' || chr(1), 'g'), '\n\s*', chr(10) || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"""


@query(r"""
select doc_id, 'doc' || doc_id || '.txt' as file_name, source as chat_id, 'Full document' as section, 1::int as line_start,
       len(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)))::int as line_end, length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))::bigint as n
from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def scan_txt_segments(spark, sf_dir):
    found = files.text_segments(_text_files(spark, sf_dir))
    return found.select(
        F.regexp_extract("file_name", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "file_name", F.element_at(F.split("file_path", "/"), -2).alias("chat_id"), "section", "line_start", "line_end", F.length("text").cast("long").alias("n")
    )


@query(f"""
select doc_id, len(s)::bigint as n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::bigint as longest, coalesce(s[1], '') as first_sentence
from (select doc_id, {SENTENCES_SQL} as s from documents)""")
def sentence_split_counts(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first_sentence"))


JUNK = ["", "***", "12", "Page 3 of 9", "Page 30 of 900", "CO1 (2)", "START", "Start", "[web:3]", "[web:3] [Web: 4]", "real text.", "c2(3)", "– 7", "7.", " STOP ", "1-2", "p 3", "é", "§"]
JUNK_SQL = r"""(b = '' or not regexp_matches(b, '[\p{L}\p{N}]') or (length(b) <= 12 and regexp_full_match(b, '(?i)(?:page\s+)?\d+\s*(?:[-–/of]*\s*\d+)?\.?\s*')) or regexp_full_match(b, '(\[\s*[wW][eE][bB]\s*:\s*\d+\s*\]\s*)+') or regexp_full_match(b, '[cC][oO]?\d+\s*\(\s*\d+\s*\)\s*') or b in ('START', 'END', 'STOP'))"""


@query(f"""
with t as (select doc_id as id, unnest(string_split(text, chr(10))) as line from documents union all select -id, line from {rows_sql([(k, x) for k, x in enumerate(JUNK, 1)], "id, line")}),
b as (select id, line, trim(line) as b from t)
select id, count(*)::bigint as n_lines, sum(case when {JUNK_SQL} then 1 else 0 end)::bigint as n_junk from b group by id""")
def junk_filter(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    extra = spark.createDataFrame([(-k, x) for k, x in enumerate(JUNK, 1)], "id long, line string")
    return lines.union(extra).groupBy("id").agg(F.count("*").alias("n_lines"), F.sum(T.is_junk(F.col("line")).cast("long")).alias("n_junk"))


@query("""
with c as (select source, doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, unnest(string_split(text, chr(10))) as line from documents)
select source as chat_id, count(*)::bigint as chunks, min(length(line))::bigint as shortest, max(length(line))::bigint as longest, sum(length(line))::bigint as characters
from c where regexp_matches(line, '[\\p{L}\\p{N}]') group by source""")
def chunk_size_stats(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    n = F.length("line").cast("long")
    return lines.groupBy(F.col("source").alias("chat_id")).agg(F.count("*").alias("chunks"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("characters"))


SECTIONS = [(1, None, "body"), (2, "", "body"), (3, "Document body", "body"), (4, "Intro", "body"), (5, "Intro", "Intro"), (6, " Table 2 ", "x"), (7, "Full document", "y")]


@query(f"""
with s as (select id, section, text from {rows_sql(SECTIONS, "id, section, text")} union all select 100 + doc_id, 'Full document', text from documents)
select id::bigint as id, md5(case when trim(coalesce(section, '')) not in ('', 'Document body') and trim(section) <> text then trim(section) || chr(10) || text else text end) as digest from s""")
def embedding_text(spark, sf_dir):
    s = spark.createDataFrame(SECTIONS, "id long, section string, text string").union(read(spark, sf_dir, "documents").select(F.col("doc_id") + 100, F.lit("Full document"), "text"))
    return s.select("id", F.md5(T.embedding_text(F.col("section"), F.col("text"))).alias("digest"))


@query(r"""
with n as (select doc_id, source || ':/data/doc' || doc_id || '.txt:' || doc_id || ':0' as name from documents),
h as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) as d from n)
select doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (('0x' || substr(d, 17, 1))::int % 4) + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) as point_id from h""")
def uuid5_point_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/data/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", V.point_id(F.col("source"), path, F.col("doc_id"), F.lit(0)).alias("point_id"))


FOLDED = [(1, "Straße  Eins\n"), (2, "STRASSE eins"), (3, " a b"), (4, None)]


@query(f"""
with t as (select id, text from {rows_sql(FOLDED, "id, text")} union all select 100 + doc_id, text from documents)
select count(*)::bigint as rows_in, count(distinct replace(lower(trim(regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss'))::bigint as texts from t""")
def normal_forms(spark, sf_dir):
    t = spark.createDataFrame(FOLDED, "id long, text string").union(read(spark, sf_dir, "documents").select(F.col("doc_id") + 100, "text"))
    return t.agg(F.count("*").alias("rows_in"), F.countDistinct(T.normal_form(F.col("text"))).alias("texts"))


TOKENS_SQL = r"""list_distinct(list_transform(list_filter(regexp_extract_all({c}, '[a-zA-Z][a-zA-Z0-9_-]+'), lambda w: length(w) > 2), lambda w:
  case when lower(w) like '%ies' and length(w) > 4 then left(lower(w), length(w) - 3) || 'y' when lower(w) like '%es' and length(w) > 4 then left(lower(w), length(w) - 2) when lower(w) like '%s' and length(w) > 3 then left(lower(w), length(w) - 1) else lower(w) end))"""


@query(f"select item_id, array_to_string(list_sort({TOKENS_SQL.format(c='text')}), ' ') as tokens from benchmark")
def lexical_tokens(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.lexical_tokens(F.col("text"))), " ").alias("tokens"))


# --- tables ----------------------------------------------------------------------------------------------------------


def _group_sql(table: str, key: str, cells: list[tuple[str, str]]) -> str:
    pairs = ", ".join(f"case when coalesce({e}, '') <> '' then '{h}: ' || {e} end" for h, e in cells)
    heads = " | ".join(h for h, _ in cells)
    return f"""select '{table}' as table_name, ((n - 1) // 20)::bigint as grp, min(n)::bigint as table_row_start, max(n)::bigint as table_row_end,
       'Table {table}' || chr(10) || 'Headers: {heads}' || chr(10) || string_agg('Row ' || n || ': ' || concat_ws('; ', {pairs}), chr(10) order by n) as text
from (select *, row_number() over (order by {key}) as n from {table}) group by 2"""


SHEETS = {
    "nation": ("n_nationkey", [("n_nationkey", "n_nationkey::varchar"), ("n_name", "n_name"), ("n_regionkey", "n_regionkey::varchar")]),
    "region": ("r_regionkey", [("r_regionkey", "r_regionkey::varchar"), ("r_name", "r_name")]),
    "supplier": ("s_suppkey", [("s_suppkey", "s_suppkey::varchar"), ("s_name", "s_name"), ("s_nationkey", "s_nationkey::varchar")]),
    "part": ("p_partkey", [("p_partkey", "p_partkey::varchar"), ("p_name", "p_name"), ("p_brand", "p_brand"), ("p_type", "p_type")]),
    "customer": ("c_custkey", [("c_custkey", "c_custkey::varchar"), ("c_name", "c_name"), ("c_mktsegment", "c_mktsegment")]),
}


@query(" union all ".join(f"({_group_sql(t, k, c)})" for t, (k, c) in SHEETS.items()))
def table_row_groups(spark, sf_dir):
    every = None
    for name, (key, cells) in SHEETS.items():
        columns = [h for h, _ in cells]
        data = read(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("n"), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("cells"))
        head = spark.createDataFrame([(name, -1, columns)], "table_name string, n long, cells array<string>")
        every = head.union(data) if every is None else every.union(head).union(data)
    groups = tables.row_groups(every.withColumn("label", F.concat(F.lit("Table "), "table_name")), ["table_name"], "n")
    return groups.select("table_name", F.col("group").cast("long").alias("grp"), F.col("table_row_start").cast("long").alias("table_row_start"), F.col("table_row_end").cast("long").alias("table_row_end"), "text")


CELLS = [("a.xlsx", "S", 1, 1, None, "Item"), ("a.xlsx", "S", 1, 2, None, "Total"), ("a.xlsx", "S", 2, 1, None, " x "), ("a.xlsx", "S", 2, 2, "=A1*2", "4"), ("a.xlsx", "S", 3, 1, None, "0"), ("a.xlsx", "S", 3, 2, "=B2", None), ("a.xlsx", "S", 4, 1, None, None), ("a.xlsx", "S", 4, 2, "=1", "1")]


@query(f"""
select file_path, sheet, row::bigint as row_no, col::bigint as col_no, case when formula is null and value is null then '' when formula like '=%' then 'Formula: ' || formula || '; calculated value: ' || coalesce(value, 'None') else trim(coalesce(value, formula)) end as shown
from {rows_sql(CELLS, "file_path, sheet, row, col, formula, value")}""")
def excel_formula_render(spark, sf_dir):
    cells = spark.createDataFrame(CELLS, "file_path string, sheet string, row int, col int, formula string, value string")
    return tables.workbook_cells(cells).select("file_path", "sheet", F.col("row").cast("long").alias("row_no"), F.col("col").cast("long").alias("col_no"), "shown")


# --- retrieval -------------------------------------------------------------------------------------------------------

#: A chunk is a line of a document; questions are the benchmark items whose id is divisible by 50.
CHUNKS_SQL = """
c as (select doc_id || '#' || i as chunk_id, 'doc' || doc_id as file_path, line as text, i, n from (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, unnest(string_split(text, chr(10))) as line, len(string_split(text, chr(10))) as n from documents)),
tok as (select chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from c),
len as (select chunk_id, count(*) as dl from tok group by 1),
p as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from tok join len using (chunk_id) group by 1, 2),
st as (select term, count(*) as df from p group by 1),
qtok as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from benchmark where item_id % 50 = 0),
qlen as (select query_id, count(*) as dl from qtok group by 1),
q as (select query_id, term, count(*) as tf, any_value(dl) as dl from qtok join qlen using (query_id) group by 1, 2)"""


def _w(t: str) -> str:
    return f"({t}.tf * {BM25_K + 1.0}e0 / ({t}.tf + {BM25_K}e0 * ({1.0 - BM25_B}e0 + {BM25_B}e0 * {t}.dl / {BM25_MEAN_LENGTH}e0)))"


SCORES_SQL = f"""
sparse as (select query_id, p.chunk_id, round(sum({_w("p")} * ({_w("q")} * ln(((select count(*) from c) - df + 0.5e0) / (df + 0.5e0) + 1e0))), 6) as score
  from p join q using (term) join st using (term) group by 1, 2),
nt as (select chunk_id, count(*) as terms from p group by 1),
dense as (select query_id, p.chunk_id, round(count(*) / sqrt(any_value(terms)::double), 6) as score from p join q using (term) join nt using (chunk_id) group by 1, 2)"""


def _line_chunks(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("_l"))
    at = lines.select("doc_id", F.size("_l").alias("chunk_count"), F.posexplode("_l").alias("chunk_index", "text"))
    return at.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_path"), "text", "chunk_index", "chunk_count")


def _questions(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _matched(spark, sf_dir):
    """(chunks, postings that meet the questions' terms, read from the texts once)."""
    chunks, questions = _line_chunks(spark, sf_dir), _questions(spark, sf_dir)
    n_chunks = read(spark, sf_dir, "documents").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    return chunks, retrieval.matched(questions, materialised(retrieval.postings_of(questions, chunks), "postings"), n_chunks)


def _rankings(spark, sf_dir):
    """(chunks, BM25 scores, overlap scores). The second ranking needs no vectors: shared distinct terms over the root of a
    chunk's distinct terms. Both come from one pass over the matched postings; of each file only what a search can look at
    is kept for the phases that follow."""
    chunks, rows = _matched(spark, sf_dir)
    overlap = F.round(F.count("*") / F.sqrt(F.first("n_terms").cast("double")), 6)
    scores = rows.groupBy("query_id", "chunk_id").agg(retrieval.bm25_score().alias("sparse"), overlap.alias("overlap"))
    rank = lambda c: F.row_number().over(Window.partitionBy("query_id", F.substring_index("chunk_id", "#", 1)).orderBy(F.desc(c), "chunk_id"))
    most = max(24, DEFAULTS.broad_search_top_k)
    scores = scores.withColumns({"_s": rank("sparse"), "_o": rank("overlap")}).where((F.col("_s") <= most) | (F.col("_o") <= most))
    scores = materialised(scores.select("query_id", "chunk_id", "sparse", "overlap"), "scores")
    return chunks, scores.select("query_id", "chunk_id", F.col("sparse").alias("score")), scores.select("query_id", "chunk_id", F.col("overlap").alias("score"))


def _of_file(scores: DataFrame) -> DataFrame:
    return scores.withColumn("file_path", F.concat(F.lit("doc"), F.substring_index("chunk_id", "#", 1)))


@query(f"with {CHUNKS_SQL} select term, df::bigint as df from st")
def bm25_term_stats(spark, sf_dir):
    return retrieval.text_term_stats(_line_chunks(spark, sf_dir)).select("term", "df")


@query(f"with {CHUNKS_SQL}, {SCORES_SQL} select query_id, chunk_id, score, r as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from sparse) where r <= 20")
def bm25_topk(spark, sf_dir):
    _, rows = _matched(spark, sf_dir)
    sparse = rows.groupBy("query_id", "chunk_id").agg(retrieval.bm25_score().alias("score"))
    return retrieval.ranked(sparse, 20).select("query_id", "chunk_id", "score", "rank")


@query("""
with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id::varchar as chunk_id, round(list_dot_product(e::double[], embedding::double[]) / (sqrt(list_dot_product(e::double[], e::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as score from embeddings, q)
select query_id, chunk_id, score, r as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from s) where r <= 20""")
def dense_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("dense"))
    return retrieval.dense_top(q, rows, 20).select("query_id", "chunk_id", "score", "rank")


FUSED_SQL = """
r1 as (select query_id, chunk_id, r, l from (select *, row_number() over (partition by query_id, l order by score desc, chunk_id) as r from (select *, 0 as l from dense union all select *, 1 as l from sparse)) where r <= 20),
f1 as (select query_id, chunk_id, round(sum(1e0 / (60e0 + r)), 9) as rrf from r1 group by 1, 2)"""
SOURCES_SQL = """
b as (select query_id, 'doc' || split_part(chunk_id, '#', 1) as file_path, max(rrf) as best from f1 group by 1, 2),
s as (select query_id, file_path, best from (select *, max(best) over (partition by query_id) as top from b) where best >= greatest(0.012e0, 0.6e0 * top))"""


@query(f"with {CHUNKS_SQL}, {SCORES_SQL}, {FUSED_SQL} select query_id, chunk_id, rrf from f1")
def rrf_fusion(spark, sf_dir):
    _, sparse, overlap = _rankings(spark, sf_dir)
    return retrieval.fused([retrieval.ranked(overlap, 20), retrieval.ranked(sparse, 20)]).select("query_id", "chunk_id", "rrf")


@query(f"with {CHUNKS_SQL}, {SCORES_SQL}, {FUSED_SQL}, {SOURCES_SQL} select query_id, file_path, best from s")
def source_selection(spark, sf_dir):
    _, sparse, overlap = _rankings(spark, sf_dir)
    hits = retrieval.fused([retrieval.ranked(overlap, 20), retrieval.ranked(sparse, 20)])
    return retrieval.select_sources(_of_file(hits))


TWO_PHASE_SQL = f"""with {CHUNKS_SQL}, {SCORES_SQL}, {FUSED_SQL}, {SOURCES_SQL},
r2 as (select query_id, file_path, best, chunk_id, r from (select *, row_number() over (partition by query_id, file_path, l order by score desc, chunk_id) as r
  from (select d.*, 0 as l, s.file_path, s.best from dense d join s on s.query_id = d.query_id and s.file_path = 'doc' || split_part(d.chunk_id, '#', 1)
        union all select d.*, 1 as l, s.file_path, s.best from sparse d join s on s.query_id = d.query_id and s.file_path = 'doc' || split_part(d.chunk_id, '#', 1))) where r <= 24),
f2 as (select query_id, file_path, chunk_id, any_value(best) as best, round(sum(1e0 / (60e0 + r)), 9) as rrf from r2 group by 1, 2, 3),
t as (select f2.*, trim(c.text) as t from f2 join c using (chunk_id) where rrf >= 0.012e0),
u as (select *, row_number() over (partition by query_id, t order by rrf desc, best desc, t.file_path, chunk_id) as n from t where t <> ''),
o as (select *, row_number() over (partition by query_id order by rrf desc, best desc, file_path, chunk_id) as pos from u where n = 1)"""


@query(TWO_PHASE_SQL + " select query_id, chunk_id, file_path, rrf, pos from o where pos <= 8")
def two_phase_search(spark, sf_dir):
    chunks, sparse, overlap = _rankings(spark, sf_dir)
    return retrieval.two_phase_search(_of_file(sparse), _of_file(overlap), chunks).select("query_id", "chunk_id", "file_path", "rrf", "pos")


@query(TWO_PHASE_SQL + ", h as (select query_id, string_agg('[' || pos || '] ' || file_path || chr(10) || t, chr(10) || chr(10) order by pos) as ctx from o where pos <= 8 group by 1) select query_id, md5(ctx) as context, '" + NO_MODEL.replace("'", "''") + "' || split_part(ctx, chr(10) || chr(10), 1) as answer from h")
def context_block(spark, sf_dir):
    chunks, sparse, overlap = _rankings(spark, sf_dir)
    hits = retrieval.two_phase_search(_of_file(sparse), _of_file(overlap), chunks)
    found = answers.contexts(hits.withColumn("source", F.col("file_path")))
    return found.select("query_id", F.md5("context").alias("context"), answers.fallback_answer(F.col("context")).alias("answer"))


@query("select source as chat_id, min(doc_id)::bigint as doc_id, text_md5 from (select *, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as text_md5 from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') group by 1, 3")
def dedupe_keep_first(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("text_md5", F.md5(T.trim(F.col("text")))).where(T.trim(F.col("text")) != "")
    return retrieval.keep_first_text(docs, ["source"], [F.col("doc_id")], F.col("text_md5")).select(F.col("source").alias("chat_id"), "doc_id", "text_md5")


@query("select doc_id, source as chat_id from documents where source = 'src3' union all select doc_id, 'paths' from documents where source in ('src1', 'src2') union all select doc_id, 'chat wins' from documents where source = 'src5'")
def scope_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_chat_id"), F.col("source").alias("file_path"))
    a = retrieval.in_scope(docs, "src3").select("doc_id", F.col("document_chat_id").alias("chat_id"))
    b = retrieval.in_scope(docs, None, ["src1", "src2"]).select("doc_id", F.lit("paths").alias("chat_id"))
    c = retrieval.in_scope(docs, "src5", ["src1"]).select("doc_id", F.lit("chat wins").alias("chat_id"))
    return a.union(b).union(c)


STEPS = [
    (1, "How to crash a project?", "p1", 1, 0.03, "2. Then crash. 3. Then stop.", "Steps", 3, 7, "a.pdf"), (1, "How to crash a project?", "p0", 2, 0.02, "What is it? 1. x", "FAQ", 2, 9, "a.pdf"), (1, "How to crash a project?", "z", 3, 0.01, "plain", None, 1, 3, "b.pdf"),
    (2, "List the stages", "r1", 1, 0.03, "1. A [web:1] 2. B [web:2]", "References", 4, 2, "c.pdf"), (2, "List the stages", "r2", 2, 0.02, "no numbers", "Intro", 2, 3, "c.pdf"), (3, "Why?", "s1", 1, 0.03, "1. one 2. two", "Steps", 2, 5, "d.pdf"),
]
STEP_COLUMNS = "query_id, question, chunk_id, pos, rrf, text, section, chunk_count, source_segment, file_path"
STEP_SCHEMA = "query_id long, question string, chunk_id string, pos long, rrf double, text string, section string, chunk_count int, source_segment int, file_path string"
SIBLINGS = [("p9", "a.pdf", 7, 2, "4. End."), ("p1", "a.pdf", 7, 1, "2. Then crash. 3. Then stop."), ("p7", "a.pdf", 7, 0, "1. Start."), ("q1", "a.pdf", 8, 0, "other"), ("r9", "c.pdf", 2, 0, "ref")]
ITEMS_SQL = r"len(regexp_extract_all(lower(text), '(?:^|\s)\d+\.\s'))"
ANCHOR_SQL = f"""sc as (select *, {ITEMS_SQL} as n, {ITEMS_SQL} * 10 + (case when lower(text) like '%step%' or lower(coalesce(section, '')) like '%step%' then 5 else 0 end)
   - (case when regexp_matches(lower(text), '^(explain |what is |describe )') then 20 else 0 end)
   - (case when {ITEMS_SQL} >= 2 and len(regexp_extract_all(lower(text), '\\[web:')) >= {ITEMS_SQL} - 1 then 200 else 0 end) - (case when lower(coalesce(section, '')) like '%reference%' then 200 else 0 end) as s
   from {rows_sql(STEPS, STEP_COLUMNS)}),
an as (select * from (select *, row_number() over (partition by query_id order by s desc, n desc, pos) as k from sc where regexp_matches(question, '(?i)\\b(steps?|process|procedure|sequence|stages?|how\\s+to)\\b') and chunk_count > 1) where k = 1 and s > 0)"""


@query(f"with {ANCHOR_SQL} select query_id::bigint as query_id, file_path, source_segment, rrf::double as anchor_rrf from an")
def sequence_anchor(spark, sf_dir):
    return retrieval.sequence_anchors(spark.createDataFrame(STEPS, STEP_SCHEMA))


@query(f"""with {ANCHOR_SQL}, sib as (select query_id, v.chunk_id, an.rrf, v.text, 0 as g, v.chunk_index as plc from an join {rows_sql(SIBLINGS, "chunk_id, file_path, source_segment, chunk_index, text")} on v.file_path = an.file_path and v.source_segment = an.source_segment),
al as (select * from sib union all select query_id, chunk_id, rrf, text, 1, pos from sc where not exists (select 1 from sib where sib.query_id = sc.query_id and sib.chunk_id = sc.chunk_id))
select query_id::bigint as query_id, chunk_id, rrf::double as rrf, text, row_number() over (partition by query_id order by g, plc, chunk_id) as pos from al""")
def sequence_expand(spark, sf_dir):
    return retrieval.expand_sequences(spark.createDataFrame(STEPS, STEP_SCHEMA), spark.createDataFrame(SIBLINGS, "chunk_id string, file_path string, source_segment int, chunk_index int, text string"))


@query("""
with b as (select doc_id % 7 as query_id, case when doc_id % 3 = 0 then 'structured' else 'hybrid' end as route, doc_id as pos, text from documents),
n as (select *, replace(lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))), 'ß', 'ss') as t from b),
u as (select *, row_number() over (partition by query_id, t order by route desc, pos) as k from n where t <> ''),
o as (select query_id, route, pos, row_number() over (partition by query_id order by route desc, pos) as merged_pos from u where k = 1)
select * from o where merged_pos <= 8""")
def route_merge(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").alias("pos"), "text")
    merged = retrieval.merge_routes(docs.where("pos % 3 = 0"), docs.where("pos % 3 <> 0"))
    return merged.select("query_id", "route", "pos", "merged_pos")


# --- structure -------------------------------------------------------------------------------------------------------

PAGES_SQL = r"""
h as (select page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) as title, regexp_extract_all(html, '<p>([^<]+)</p>', 1) as paras from pages)"""


def _page_segments(spark, sf_dir):
    """The h1 of a page is a heading of level 1, whatever number its title begins with; its p elements are bodies of that
    section."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), F.regexp_extract_all("html", F.lit("<p>([^<]+)</p>"), F.lit(1)).alias("paras"))
    items = F.concat(F.array("title"), F.col("paras"))
    rows = pages.select("page_id", "title", F.posexplode(items).alias("seg_no", "text"))
    return rows.select(F.lit("web").alias("chat_id"), F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("file_path"), "seg_no", "text", F.col("title").alias("section"), (F.col("seg_no") / 5).cast("int").alias("page"), F.when(F.col("seg_no") == 0, 1).alias("heading_level"), (F.col("seg_no") == 0).alias("is_heading"), F.lit(None).cast("string").alias("content_kind"))


@query(f"""with {PAGES_SQL}
select 'page' || page_id || '.pdf' as file_path, 1::bigint as heading_count, case when trim(title) = '' then 0 else len(paras) end::bigint as labelled_body_count,
       (case when trim(title) <> '' then 1 else 0 end + case when trim(title) = '' then 0 when len(paras) >= 3 then 3 when len(paras) >= 1 then 1 else 0 end + case when regexp_matches(trim(title), '^\\d+(?:\\.\\d+)*\\.?\\s+') then 2 else 0 end)::bigint as score from h""")
def structure_score(spark, sf_dir):
    return structure.assess(_page_segments(spark, sf_dir)).select("file_path", "heading_count", "labelled_body_count", "score")


@query(f"""with {PAGES_SQL}, t as (select page_id, title, list_distinct(list_transform(paras, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)))) as d, list_transform(paras, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))) as ps from h)
select 'page' || page_id || '.pdf' as file_path, 'section-1' as node_id, trim(title) as title, 1::int as level, 0::int as page_start, (len(ps) // 5)::int as page_end,
       md5(list_reduce(list_prepend('', ps), lambda acc, x: case when contains(acc, x) then acc when acc = '' then x else acc || chr(10) || chr(10) || x end)) as digest
from t where len(list_filter(ps, lambda x: x <> '')) > 0 and trim(title) <> ''""")
def section_tree_text(spark, sf_dir):
    nodes = structure.build_trees(_page_segments(spark, sf_dir))
    return nodes.select("file_path", "node_id", "title", "level", "page_start", "page_end", F.md5("text").alias("digest"))


def _headings(n: int = 12) -> list[tuple]:
    made, state = [], 7
    kinds = ["Intro", "1 Scope", "1.1 Terms", "2.1.3 Deep", "Notes", "3. Plan", "Annex"]
    for f in range(40):
        for k in range(1, n + 1):
            state = (state * 1103515245 + 12345) % (1 << 31)
            made.append((f"f{f}.docx", k, kinds[state // 65536 % len(kinds)], [None, None, None, 1, 2, 3][state // 4096 % 6]))
    return made


HEADINGS = _headings()
LEVELS_SQL = f"""
e as (select file_path, ord, title, case when heading_level > 0 then heading_level when regexp_matches(title, '^\\d+(?:\\.\\d+)*\\.?\\s+') then length(regexp_extract(title, '^(\\d+(?:\\.\\d+)*)', 1)) - length(replace(regexp_extract(title, '^(\\d+(?:\\.\\d+)*)', 1), '.', '')) + 1 end as x from {rows_sql(HEADINGS, "file_path, ord, title, heading_level")}),
w as (select *, last_value(x ignore nulls) over (partition by file_path order by ord rows between unbounded preceding and current row) as lx from e),
l as (select file_path, ord, title, coalesce(x, case when lx is null then (case when ord = 1 then 1 else 2 end) when lx = 1 then 2 else lx end)::int as level from w)"""


def _levelled(spark):
    return structure.with_levels(spark.createDataFrame(HEADINGS, "file_path string, ord int, title string, heading_level int"), ["file_path"])


@query(f"with {LEVELS_SQL} select file_path, ord, title, level from l")
def section_levels(spark, sf_dir):
    return _levelled(spark).select("file_path", "ord", "title", "level")


@query(f"with {LEVELS_SQL} select file_path, ord, (select max(b.ord) from l b where b.file_path = l.file_path and b.ord < l.ord and b.level < l.level) as parent_ord from l")
def section_parents(spark, sf_dir):
    return structure.with_parents(_levelled(spark), ["file_path"]).select("file_path", "ord", "parent_ord")


@query(f"""with {PAGES_SQL}, t as (select page_id, title, unnest(paras) as x from h),
n as (select 'page' || page_id || '.pdf::section-1' as identifier, any_value(trim(title)) as title, string_agg(trim(x), ' ') as text from t where trim(x) <> '' group by page_id),
q as (select item_id as query_id, unnest({TOKENS_SQL.format(c="text")}) as token from benchmark),
a as (select identifier, unnest({TOKENS_SQL.format(c="title")}) as token, 5 as w from n union all select identifier, unnest({TOKENS_SQL.format(c="text")}), 1 from n),
s as (select query_id, identifier, sum(w)::bigint as score, max(w) as best from q join a using (token) group by 1, 2),
r as (select query_id, identifier, score, row_number() over (partition by query_id order by score desc, identifier desc) as rank from s where best = 5 or score >= 3)
select * from r where rank <= 6""")
def lexical_tree_search(spark, sf_dir):
    nodes = structure.build_trees(_page_segments(spark, sf_dir)).withColumn("file_name", F.col("file_path"))
    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("web").alias("chat_id"), F.col("text").alias("question"))
    return structure.lexical_search(questions, structure.identified(nodes)).select("query_id", "identifier", "score", "rank")


@query("""
with w as (select source as chat_id, doc_id, length(text) as n, row_number() over (partition by source order by doc_id) as k, sum(length(text) + 2) over (partition by source order by doc_id rows between unbounded preceding and current row) - 2 as s from documents)
select chat_id, doc_id, n::bigint as n from w where s <= 24000 or k = 1""")
def catalog_budget(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("chat_id"), "doc_id", F.col("text").alias("entry"))
    return structure.within_budget(docs, ["chat_id"], ["doc_id"]).select("chat_id", "doc_id", F.length("entry").cast("long").alias("n"))


# --- page layout -----------------------------------------------------------------------------------------------------

LINE_TEXTS = ["Key concepts", "Normal time: the usual duration of work.", "1.2 Crash cost", "42", "Project Crash Steps", "Cost Slope Rules", "Final Review Notes", "A", "Summary of the whole chapter, in one long line of prose.", "Network analysis", "start to finish", "Tools & Methods"]


def _pdf_lines() -> list[tuple]:
    rows, state = [], 3
    for page in range(1, 31):
        for n in range(14):
            state = (state * 1103515245 + 12345) % (1 << 31)
            text = LINE_TEXTS[state // 65536 % len(LINE_TEXTS)]
            size = [10.0, 10.0, 10.0, 12.0, 14.0][state // 4096 % 5]
            y = 20.0 * n
            rows.append(("m.pdf", page, n, 50.0, y, 50.0 + 5 * len(text), y + 10, text, size, 16 if state // 1024 % 7 == 0 else 0))
    return rows


LINES = _pdf_lines()
LINE_COLUMNS = "file_path, page, line_no, x0, y0, x1, y1, txt, size, flags"
BOXES = [("m.pdf", p, "table", 40.0, 60.0 + p, 200.0, 100.0 + p) for p in range(1, 31)]


def _lines(spark):
    flat = spark.createDataFrame(LINES, "file_path string, page int, line_no int, x0 double, y0 double, x1 double, y1 double, txt string, size double, flags int")
    return flat.withColumn("spans", F.array(F.struct(F.col("txt").alias("text"), "size", "flags"))).drop("txt", "size", "flags")


@query(f"select file_path, page, list_sort(list(size))[(count(*) // 2) + 1]::double as body_size from {rows_sql(LINES, LINE_COLUMNS)} group by 1, 2")
def font_median(spark, sf_dir):
    return layout.median_size(_lines(spark))


HEADING_SQL = r"""(length(txt) between 2 and 120 and not regexp_full_match(trim(txt), '\p{N}+') and (case when body_size <= 0 then flags & 16 <> 0 and length(txt) <= 80 else
  (size >= body_size + 1.5 and length(txt) <= 80) or (flags & 16 <> 0 and length(txt) <= 60) or (len(list_filter(regexp_split_to_array(txt, '\s+'), lambda w: w <> '')) between 1 and 8 and regexp_matches(txt, '^\p{Lu}') and not regexp_matches(txt, '[.,:;!?()]'))
  or regexp_full_match(txt, '\d+(?:\.\d+)*\.?\s+[A-Z][^.!?]{0,100}') end))"""


@query(f"with v0 as (select * from {rows_sql(LINES, LINE_COLUMNS)}), m as (select file_path, page, list_sort(list(size))[(count(*) // 2) + 1]::double as body_size from v0 group by 1, 2) select page, line_no, {HEADING_SQL} as is_heading from v0 join m using (file_path, page)")
def pdf_heading_flags(spark, sf_dir):
    lines = layout.line_text(_lines(spark)).join(layout.median_size(_lines(spark)), ["file_path", "page"])
    return lines.select("page", "line_no", T.is_pdf_heading(F.col("text"), F.col("max_size"), F.col("bold"), F.col("body_size")).alias("is_heading"))


RUNS_SQL = f"""
f as (select *, (length(txt) between 2 and 45 and regexp_full_match(txt, '[A-Za-z][A-Za-z &''\\-/]*') and regexp_matches(txt, '^\\p{{Lu}}') and len(list_filter(regexp_split_to_array(txt, '\\s+'), lambda w: w <> '')) >= 2) as flag from {rows_sql(LINES, LINE_COLUMNS)}),
i as (select *, row_number() over (partition by page order by line_no) - row_number() over (partition by page, flag order by line_no) as isl from f),
k as (select *, count(*) over (partition by page, flag, isl) as run from i)"""


@query(f"with {RUNS_SQL} select page, line_no, txt as text from k where not flag or run < 3")
def section_run_drop(spark, sf_dir):
    return layout.without_title_runs(layout.line_text(_lines(spark))).select("page", "line_no", "text")


@query(f"""select page, line_no from {rows_sql(LINES, LINE_COLUMNS)} where not exists (select 1 from (select * from {rows_sql(BOXES, "file_path, page, kind, bx0, by0, bx1, by1")}) b where b.page = v.page
  and greatest(least(x1, bx1) - greatest(x0, bx0), 0) * greatest(least(y1, by1) - greatest(y0, by0), 0) / nullif((x1 - x0) * (y1 - y0), 0) > 0.5)""")
def box_overlap_filter(spark, sf_dir):
    boxes = spark.createDataFrame(BOXES, "file_path string, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    return layout.outside(_lines(spark), boxes).select("page", "line_no")


@query(f"""with {RUNS_SQL}, kept as (select * from k where not flag or run < 3), m as (select page, list_sort(list(size))[(count(*) // 2) + 1]::double as body_size from kept group by 1),
g as (select kept.*, {HEADING_SQL} as hd from kept join m using (page)),
r as (select *, sum(case when hd then 1 else 0 end) over (partition by page order by line_no) as rn, coalesce(last_value(case when hd then txt end ignore nulls) over (partition by page order by line_no rows between unbounded preceding and current row), 'Document body') as section from g)
select page, min(line_no)::int as pos, hd as is_heading, any_value(section) as section, arg_min(y0, line_no)::double as sort_y, string_agg(txt, ' ' order by line_no) as text from r group by page, rn, hd""")
def prose_runs(spark, sf_dir):
    found = layout.page_segments(_lines(spark))
    return found.select("page", "pos", F.coalesce("is_heading", F.lit(False)).alias("is_heading"), "section", "sort_y", "text")


# --- answers and chats -----------------------------------------------------------------------------------------------

PAYLOADS = [
    (1, "/u/Plan.pdf", "pdf", 4, "Intro", None, None, None, None, None, 1, 6), (2, "/u/B.xlsx", "excel_table", None, None, "Costs", None, None, 12, 30, 0, 2), (3, "N.docx", "docx", None, "Risk", None, 18, None, None, None, None, None),
    (4, "/u/T.pdf", "pdf_table", 3, "Table 2", None, None, 2, 1, 20, 0, 1), (5, None, "txt", None, "", None, None, None, None, None, None, None), (6, "s.pdf", "structured_document", 0, "Top", None, None, None, None, None, None, None),
]
PAYLOAD_COLUMNS = "id, source, source_type, page, section, sheet, paragraph, tab, r1, r2, ci, cc"
_some = "case when {0} is not null and {0}::varchar not in ('', '0') then '{1}' || {0} end"


@query(f"""
with d as (select id, list_last(string_split(coalesce(source, 'unknown'), '/')) as f, concat_ws(', ', case when source_type in ('pdf', 'structured_document') then {_some.format("page", "page ")} end, {_some.format("section", "Section: ")}, {_some.format("sheet", "Sheet: ")}, {_some.format("paragraph", "paragraph ")}, {_some.format("tab", "Table ")},
  case when r1 is not null and r2 is not null then 'rows ' || r1 || '–' || r2 end, case when ci is not null and cc > 0 then 'chunk ' || (ci + 1) || ' of ' || cc end) as s from {rows_sql(PAYLOADS, PAYLOAD_COLUMNS)})
select id::bigint as id, case when s <> '' then f || ' — ' || s else f end as citation from d""")
def citation_format(spark, sf_dir):
    p = spark.createDataFrame(PAYLOADS, "id long, source string, source_type string, page int, section string, sheet string, paragraph int, tab int, r1 int, r2 int, ci int, cc int")
    names = {"source_type": "source_type", "page": "page", "section": "section", "sheet": "sheet", "paragraph": "paragraph", "table": "tab", "table_row_start": "r1", "table_row_end": "r2", "chunk_index": "ci", "chunk_count": "cc"}
    return p.select("id", T.citation(F.col("source"), {k: F.col(c) for k, c in names.items()}).alias("citation"))


REPLIES = [(1, "All good."), (2, "A [1].\nCITATIONS: [2, 1, 2]"), (3, "x citations: []"), (4, "CITATIONS: [9] then CITATIONS: [3, 1] tail"), (5, "  spaced  "), (6, "y CITATIONS: [1, x]")]
REPLY_SQL = rf"""
f as (select id, reply, regexp_extract_all(reply, '(?i)CITATIONS:\s*\[([0-9,\s]*)\]', 1) as m from {rows_sql(REPLIES, "id, reply")}),
p as (select id, case when len(m) > 0 then trim(regexp_extract(reply, '(?is)^(.*)CITATIONS:\s*\[[0-9,\s]*\]', 1), ' ' || chr(10)) else trim(reply, ' ' || chr(10)) end as answer,
  case when len(m) > 0 then list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(m[-1], '[,\s]+'), lambda t: regexp_full_match(t, '\d+')), lambda t: t::int))) else [] end as nums from f)"""


@query(f"with {REPLY_SQL} select id::bigint as id, answer, array_to_string(nums, ',') as cited from p")
def citation_extract(spark, sf_dir):
    answer, cited = T.split_citations(F.col("reply"))
    return spark.createDataFrame(REPLIES, "id long, reply string").select("id", answer.alias("answer"), F.array_join(cited.cast("array<string>"), ",").alias("cited"))


@query(f"with {REPLY_SQL}, v as (select id, list_filter(nums, lambda n: n between 1 and 3) as ok from p) select id::bigint as id, pos::bigint as pos, (len(ok) = 0 or list_contains(ok, pos)) as used from v, (values (1), (2), (3)) as t(pos)")
def used_flags(spark, sf_dir):
    _, cited = T.split_citations(F.col("reply"))
    replies = spark.createDataFrame(REPLIES, "id long, reply string").select("id", cited.alias("cited"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pos"))
    return replies.select("id", F.col("pos").cast("long").alias("pos"), answers.used(F.col("pos"), F.col("cited"), F.lit(3)).alias("used"))


@query("""
with n as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn))
select conv_id as chat_id, turn, text as question, answer from n where role = 'user' and next_role = 'assistant'""")
def chat_history_pairs(spark, sf_dir):
    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(own), "answer": F.lead("text").over(own)})
    return turns.where("role = 'user' and next_role = 'assistant'").select(F.col("conv_id").alias("chat_id"), "turn", F.col("text").alias("question"), "answer")


@query("select path, mode from (select lang || '/' || source as path, case when bool_or(doc_id % 5 = 0) then 'vectorless_structured_tree' else 'hybrid_vector' end as mode from documents group by 1)")
def chat_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("file_path"), F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("string").alias("retrieval_mode"), "doc_id")
    return store.chat_files(docs.drop("doc_id"), docs.where("doc_id % 5 = 0").select("file_path", "file_name"))


@query("select name, id, case when count(*) over (partition by name) > 1 then name || ' (' || substr(id, 1, 6) || ')' else name end as label from (select distinct lang || '-' || substr(source, 4, 1) as name, md5(source) as id from documents)")
def chat_labels(spark, sf_dir):
    name = F.concat(F.col("lang"), F.lit("-"), F.substring("source", 4, 1))
    chats = read(spark, sf_dir, "documents").select(name.alias("name"), F.md5("source").alias("id")).distinct()
    return store.labels(chats).select("name", "id", "label")


def _store(spark, name):
    return f"{folder(spark)}/docloom-store/{name}-{uuid.uuid4().hex}"


@query("select source as chat_id, doc_id, case when doc_id % 3 = 0 then 'new' else 'old' end as version from documents union all select 'added', -1, 'new'")
def upsert_points(spark, sf_dir):
    points = store.Table(spark, _store(spark, "points"), "chat_id string, doc_id long, version string", ["doc_id"], "chat_id")
    points.create()
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("chat_id"), "doc_id", F.lit("old").alias("version"))
    points.upsert(docs)
    points.upsert(docs.where("doc_id % 3 = 0").withColumn("version", F.lit("new")).union(spark.createDataFrame([("added", -1, "new")], docs.schema)))
    return points.read()


@query("select source as chat_id, doc_id from documents where source not in ('src1', 'src2') and not (source = 'src3' and lang = 'en')")
def delete_cascade(spark, sf_dir):
    points = store.Table(spark, _store(spark, "cascade"), "chat_id string, doc_id long, lang string", ["doc_id"], "chat_id")
    points.create()
    points.upsert(read(spark, sf_dir, "documents").select(F.col("source").alias("chat_id"), "doc_id", "lang"))
    points.delete(["src1", "src2", "absent"])
    points.delete(["src3"], F.col("lang") == "en")
    return points.read().select("chat_id", "doc_id")


@query("""
with x as (select label, vec_id, generate_subscripts(embedding, 1) as d, unnest(embedding)::double as v from embeddings),
s as (select *, sum(v) over (partition by label, d order by vec_id rows between unbounded preceding and 1 preceding) as m from x)
select label, vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 4) as similarity from s where m is not null group by 1, 2""")
def semantic_similarity_steps(spark, sf_dir):
    steps = chunking.running_similarity(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return steps.select("label", "vec_id", F.round("similarity", 4).alias("similarity"))


#: An embedder that SQL can follow: how often a sentence has each of these letters.
LETTERS = "aeinorst"


def letter_vectors(texts: list[str]) -> np.ndarray:
    return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=float).reshape(len(texts), len(LETTERS))


_LETTER_SQL = ", ".join(f"length(s) - length(replace(s, '{c}', ''))" for c in LETTERS)
#: Sentences are joined one after the other, as the operator does; a state holds the group so far.
PARTS_SQL = rf"""
se as (select doc_id, doc_id::bigint as src, {SENTENCES_SQL} as parts, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from documents),
ss as (select doc_id, generate_subscripts(parts, 1) as i, unnest(parts) as s from se where len(parts) > 1),
sv as (select doc_id, i, s, [{_LETTER_SQL}]::double[] as v, regexp_matches(s, '^\d+\.\s+\S') as numbered, regexp_matches(s, '^[A-Z][A-Za-z ]+:\s') as definition from ss),
st(doc_id, i, grp, total, n, len, definition) as (
  select doc_id, i, 0, v, 1, length(s), definition from sv where i = 1
  union all
  select sv.doc_id, sv.i, case when cut then st.grp + 1 else st.grp end, case when cut then sv.v else list_transform(list_zip(st.total, sv.v), lambda z: z[1] + z[2]) end,
         case when cut then 1 else st.n + 1 end, case when cut then length(sv.s) else st.len + length(sv.s) + 1 end, sv.definition
  from st join sv on sv.doc_id = st.doc_id and sv.i = st.i + 1,
  lateral (select sv.numbered or st.len + length(sv.s) + 1 > {DEFAULTS.semantic_max_characters} or (st.n >= {DEFAULTS.semantic_min_sentences} and not (sv.definition and st.definition)
    and coalesce(list_dot_product(st.total, sv.v) / nullif(sqrt(list_dot_product(st.total, st.total)) * sqrt(list_dot_product(sv.v, sv.v)), 0), 0) < {DEFAULTS.semantic_similarity_threshold}) as cut)),
pt as (select st.doc_id, grp::bigint as chunk_index, string_agg(s, ' ' order by st.i) as part from st join sv using (doc_id, i) group by 1, 2 union all select doc_id, 0, coalesce(parts[1], bare) from se where len(parts) <= 1 and bare <> ''),
ch as (select *, count(*) over (partition by doc_id) as chunk_count from pt),
ck as (select * from (select *, trim(part) as b from ch) where not {JUNK_SQL})"""


@query(f"with recursive {PARTS_SQL} select doc_id, chunk_index, chunk_count::bigint as chunk_count, length(part)::bigint as chunk_characters, 'semantic' as chunking_method, md5(part) as digest from ck")
def semantic_chunks(spark, sf_dir):
    segments = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("content_kind"), F.col("doc_id").alias("source_segment"))
    return chunking.chunk_segments(segments, letter_vectors).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_count").cast("long").alias("chunk_count"), F.col("chunk_characters").cast("long").alias("chunk_characters"), "chunking_method", F.md5("text").alias("digest"))


@query(rf"""with recursive {PARTS_SQL},
f as (select doc_id, '/data/' || source || '/doc' || doc_id || '.txt' as path from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
n as (select doc_id, path, row_number() over (order by path) - 1 as seg from f),
u as (select ck.*, seg, 'chat:' || path || ':' || seg || ':' || chunk_index as name from ck join n using (doc_id)),
h as (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) as d from u)
select 'doc' || doc_id || '.txt' as file_name, seg::bigint as source_segment, chunk_index, chunk_count::bigint as chunk_count, md5(part) as digest, (length(part) - length(replace(part, 'e', '')))::bigint as e_count,
  substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (('0x' || substr(d, 17, 1))::int % 4) + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) as chunk_id from h""")
def ingest_points(spark, sf_dir):
    """Files to stored points: parsed, judged, chunked, embedded and indexed; a second call replaces what the first wrote."""
    shop = store.Store(spark, _store(spark, "ingest"), pipeline.POINTS, len(LETTERS))
    given = _text_files(spark, sf_dir)
    pipeline.ingest(shop, given.where("path like '%7.txt'"), "chat", "Chat", letter_vectors)
    pipeline.ingest(shop, given, "chat", "Chat", letter_vectors)
    points = shop.points.read(["chat"])
    # a file has one segment, its whole text, so the vector's text is the chunk itself
    return points.select("file_name", F.col("source_segment").cast("long").alias("source_segment"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_count").cast("long").alias("chunk_count"), F.md5("text").alias("digest"), (F.element_at("dense", LETTERS.index("e") + 1) - F.when(F.col("embedding_text") == F.col("text"), F.lit(0)).otherwise(F.lit(LETTER_E_OF_SECTION))).cast("long").alias("e_count"), "chunk_id")


#: The section of text files is part of what is embedded.
LETTER_E_OF_SECTION = "Full document\n".count("e")


# --- composites --------------------------------------------------------------------------------------------------------

#: Lines of documents as segments: every fourth is a heading; bodies name their heading's title, or nothing.
TREE_SQL = r"""
ln as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seg_no, unnest(string_split(text, chr(10))) as raw from documents),
sg as (select doc_id, seg_no, trim(raw) as bare, seg_no % 4 = 0 as head, 1 + (seg_no // 4) % 3 as lvl, seg_no // 10 as page, row_number() over (partition by doc_id, seg_no % 4 = 0 order by seg_no) as k from ln),
hd as (select doc_id, seg_no, k as ord, bare as title, lvl, page, replace(lower(bare), 'ß', 'ss') as ft from sg where head and bare <> ''),
tt as (select doc_id, ft, max(ord) as ord from hd group by 1, 2),
hr as (select hd.doc_id, hd.seg_no, tt.ord from hd join tt using (doc_id, ft)),
bd as (select sg.doc_id, sg.seg_no, sg.bare, sg.page, last_value(hr.ord ignore nulls) over (partition by sg.doc_id order by sg.seg_no rows between unbounded preceding and current row) as latest, sg.head, sg.seg_no % 3 = 0 as unnamed,
   (select replace(lower(s2.bare), 'ß', 'ss') from sg s2 where s2.doc_id = sg.doc_id and s2.seg_no = sg.seg_no - sg.seg_no % 4) as wanted
   from sg left join hr on hr.doc_id = sg.doc_id and hr.seg_no = sg.seg_no),
bo as (select bd.doc_id, bd.seg_no, bd.bare, bd.page, coalesce(case when unnamed then null else tt.ord end, latest) as ord from bd left join tt on tt.doc_id = bd.doc_id and tt.ft = bd.wanted where not head and bare <> ''),
tx as (select doc_id, ord, list(bare order by seg_no) as ps, min(page) as p0, max(page) as p1 from bo where ord is not null group by 1, 2),
pr as (select doc_id, ord, (select max(b.ord) from hd b where b.doc_id = hd.doc_id and b.ord < hd.ord and b.lvl < hd.lvl) as parent from hd),
kd as (select doc_id, parent as ord, string_agg('section-' || ord, ',' order by ord) as kids from pr where parent is not null group by 1, 2),
nd as (select hd.doc_id, hd.ord, hd.title, hd.lvl, pr.parent, coalesce(kd.kids, '') as kids, least(hd.page, p0) as page_start, greatest(hd.page, p1) as page_end,
   list_reduce(list_prepend('', ps), lambda acc, x: case when contains(acc, x) then acc when acc = '' then x else acc || chr(10) || chr(10) || x end) as text
   from hd join tx using (doc_id, ord) join pr using (doc_id, ord) left join kd using (doc_id, ord))"""


def _line_segments(spark, sf_dir):
    """Every fourth line of a document is a heading of one of three levels; a body names its heading, or no section."""
    lines = F.split("text", "\n")
    titled = T.let(lines, lambda ls: F.transform(ls, lambda x, i: F.struct(x.alias("text"), F.get(ls, i - i % 4).alias("title"))))  # no row carries the whole text
    at = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(titled).alias("seg_no", "_x")).select("doc_id", "seg_no", "_x.text", "_x.title")
    head = F.col("seg_no") % 4 == 0
    title = F.col("title")
    return at.select(
        F.lit("doc").alias("chat_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_path"), "seg_no", "text", F.when(head | (F.col("seg_no") % 3 != 0), title).alias("section"),
        F.floor(F.col("seg_no") / 10).cast("int").alias("page"), F.when(head, (1 + F.floor(F.col("seg_no") / 4) % 3).cast("int")).alias("heading_level"), head.alias("is_heading"), F.lit(None).cast("string").alias("content_kind"),
    )


@query(f"with {TREE_SQL} select 'doc' || doc_id || '.pdf' as file_path, 'section-' || ord as node_id, title, lvl::int as level, 'section-' || parent as parent_id, kids as children, page_start::int as page_start, page_end::int as page_end, md5(text) as digest from nd")
def heading_trees(spark, sf_dir):
    """Trees of many headings: levels, parents, children, pages, bodies by section title or by the latest heading."""
    nodes = structure.build_trees(_line_segments(spark, sf_dir))
    return nodes.select("file_path", "node_id", "title", "level", "parent_id", F.array_join("children", ",").alias("children"), "page_start", "page_end", F.md5("text").alias("digest"))


CATALOG_SQL = r"""
en as (select 'page' || page_id || '.pdf' as file_path, 'ID: page' || page_id || '.pdf::section-1' || chr(10) || 'File: page' || page_id || '.pdf' || chr(10) || 'Section: ' || trim(title) || chr(10) || 'Page: ?' || chr(10) || 'Preview: '
    || substr(trim(regexp_replace(list_reduce(list_prepend('', list_transform(paras, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)))), lambda acc, x: case when contains(acc, x) then acc when acc = '' then x else acc || chr(10) || chr(10) || x end), '\s+', ' ', 'g')), 1, 220) as entry
  from h where trim(title) <> '' and len(list_filter(paras, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) > 0),
bu as (select *, row_number() over (order by file_path) as n, sum(length(entry) + 2) over (order by file_path rows between unbounded preceding and current row) - 2 as s from en)"""


@query(f"with {PAGES_SQL}, {CATALOG_SQL} select 'web' as chat_id, md5(string_agg(entry, chr(10) || chr(10) order by file_path)) as digest, count(*)::bigint as sections from bu where s <= 24000 or n = 1")
def tree_catalog(spark, sf_dir):
    """What a tree router is shown of a chat, within its budget."""
    nodes = structure.build_trees(_page_segments(spark, sf_dir)).withColumn("file_name", F.col("file_path"))
    found = structure.catalogs(nodes)
    return found.select("chat_id", F.md5("catalog").alias("digest"), (F.size(F.split("catalog", "\n\nID: "))).cast("long").alias("sections"))


@query(f"""with {PAGES_SQL}, t as (select page_id, title, unnest(paras) as x from h),
n as (select 'page' || page_id || '.pdf::section-1' as identifier, any_value(trim(title)) as title, string_agg(trim(x), ' ') as text from t where trim(x) <> '' group by page_id),
q as (select item_id as query_id, unnest({TOKENS_SQL.format(c="text")}) as token from benchmark where item_id % 50 = 0),
a as (select identifier, unnest({TOKENS_SQL.format(c="title")}) as token, 5 as w from n union all select identifier, unnest({TOKENS_SQL.format(c="text")}), 1 from n),
s as (select query_id, identifier, sum(w)::bigint as score, max(w) as best from q join a using (token) group by 1, 2),
r as (select query_id, identifier, row_number() over (partition by query_id order by score desc, identifier desc) as rank from s where best = 5 or score >= 3)
select query_id, rank, identifier, title as section, 1e0 / rank as score, split_part(identifier, '::', 1) as file_path, 'vectorless_structured_tree' as retrieval_mode from r join n using (identifier) where rank <= 6""")
def tree_route(spark, sf_dir):
    """Stored trees answer a chat's questions: nodes by shared stems, ranked, with payload."""
    shop = store.Store(spark, _store(spark, "trees"), pipeline.POINTS, 8)
    shop.ensure()
    nodes = structure.build_trees(_page_segments(spark, sf_dir))
    tree = F.array_sort(F.collect_list(F.struct("ord", F.struct("node_id", "ord", "title", "level", "parent_id", "children", "page_start", "page_end", "text").alias("n"))))
    trees = nodes.groupBy("chat_id", "file_path").agg(F.transform(tree, lambda x: x["n"]).alias("tree"))
    shop.trees.upsert(trees.withColumns({"file_name": F.col("file_path"), "structure_score": F.lit(8)}))
    hits = pipeline.search_trees(shop, _questions(spark, sf_dir), "web")
    return hits.select("query_id", "rank", "identifier", "section", "score", "file_path", "retrieval_mode")


@query("""
with c as (select conv_id, max(turn) as last from conversations group by 1),
n as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)),
p as (select conv_id, turn, text as question, answer from n where role = 'user' and next_role = 'assistant')
select 'conv' || conv_id as chat_id, row_number() over (partition by conv_id order by turn) as pos, question, answer, 0::bigint as sources from p where conv_id % 5 <> 0 and conv_id % 7 <> 0""")
def chat_store(spark, sf_dir):
    """Chats and messages as stored: added together, some chats deleted, others cleared, histories in order."""
    shop = store.Store(spark, _store(spark, "chats"), pipeline.POINTS, 8)
    shop.ensure()
    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(own), "answer": F.lead("text").over(own)}).where("role = 'user' and next_role = 'assistant'")
    chat = F.concat(F.lit("conv"), F.col("conv_id").cast("string"))
    at = F.timestamp_seconds(F.col("turn"))
    rows = turns.select(chat.alias("chat_id"), F.format_string("%08d", "turn").alias("id"), F.col("text").alias("question"), "answer", at.alias("created_at"), F.lit(None).cast(shop.messages.schema["sources"].dataType).alias("sources"))
    shop.append_messages(rows)
    shop.append_messages(rows.where("length(question) % 2 = 0"))  # the same turns again replace themselves
    for kind, gone in (("delete", "conv_id % 5 = 0"), ("clear", "conv_id % 5 <> 0 and conv_id % 7 = 0")):
        chats = read(spark, sf_dir, "conversations").where(gone).select(chat.alias("chat_id"))  # the chats that a user picks
        shop.messages.delete(chats)
        if kind == "delete":
            shop.chats.delete(chats)
    pos = F.row_number().over(Window.partitionBy("chat_id").orderBy("created_at", "id"))
    return shop.messages.read().select("chat_id", pos.cast("long").alias("pos"), "question", "answer", F.size(F.coalesce("sources", F.array().cast(shop.messages.schema["sources"].dataType))).cast("long").alias("sources"))


@query("""
with a as (select page_id % (select count(*) from benchmark) as query_id, row_number() over (partition by page_id % (select count(*) from benchmark) order by page_id) as pos, url, html from pages),
h as (select query_id, pos, list_last(string_split(regexp_replace(url, '/+$', ''), '/')) as name, regexp_extract(html, '<h1>(.*?)</h1>', 1) as text from a),
c as (select query_id, string_agg('[' || pos || '] ' || name || chr(10) || trim(text), chr(10) || chr(10) order by pos) as context, count(*) as n from h group by 1)
select item_id as query_id, coalesce(n, 0)::bigint as n_passages, md5(coalesce(context, '')) as context, case when n is null then 'I could not find any relevant passages in the indexed documents to answer your question.' else trim('about ' || left(b.text, 20)) end as answer,
  coalesce(array_to_string(list_sort(list_distinct([1, n::int])), ','), '') as cited, case when n is null then 0 else len(list_distinct([1, n::int])) end::bigint as used
from benchmark b left join c on c.query_id = b.item_id""")
def answer_turns(spark, sf_dir):
    """A chat turn for every benchmark item: numbered context, an injected model's reply, its citations, passages used."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    n = asked.count()
    own = F.row_number().over(Window.partitionBy("query_id").orderBy("page_id"))
    hits = read(spark, sf_dir, "pages").select((F.col("page_id") % n).alias("query_id"), "page_id", F.col("url").alias("source"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("text")).withColumn("pos", own)

    def model(question: str, context: str) -> str:
        return f"about {question[:20]}\nCITATIONS: [{context.count(chr(10) * 2 + '[') + 1}, 1]"

    answered = materialised(answers.answers(asked, hits, model), "answers")
    used = answers.results_with_use(answered, hits).where("used").groupBy("query_id").agg(F.count("*").alias("used"))
    return answered.join(used, "query_id", "left").select("query_id", "n_passages", F.md5(F.coalesce("context", F.lit(""))).alias("context"), "answer", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.coalesce("used", F.lit(0)).cast("long").alias("used"))


@query("select doc_id, '/uploads/' || md5(doc_id::varchar) || '_' || 'doc ' || doc_id || '.txt' as path from documents")
def upload_paths(spark, sf_dir):
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("C:\\in\\")).when(F.col("doc_id") % 3 == 1, F.lit("../up/")).otherwise(F.lit("")), F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select("doc_id", T.upload_path(F.lit("/uploads"), name, F.md5(F.col("doc_id").cast("string"))).alias("path"))
