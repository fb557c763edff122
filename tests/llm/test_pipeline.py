"""The corpus pipeline on a small fixture, and the registered llm queries against DuckDB."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LINE = "The quick river runs over the old stones and under the long bridge of the quiet town where people met"


def test_stages(spark, tmp_path):
    bench = [(1, " ".join(f"quiz{k}" for k in range(20)))]
    clean = [(k, " ".join(f"{w}{chr(97 + (k * 7 + j) % 26)}" for j, w in enumerate(LINE.split())), "en", "s", 0) for k in range(20)]
    rows = clean + [(100, clean[3][1], "en", "s", 0), (101, clean[3][1] + " tail", "en", "s", 0), (102, None, "en", "s", 0), (103, "12 34", "en", "s", 0), (104, f"{clean[5][1]} {bench[0][1]} and on", "en", "s", 0), (105, f"{LINE} write to me@mail.example.com", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"] for r in docs.collect()})
    every = {r[0] for r in rows}
    assert seen[0] == every - {102, 103}
    assert seen[1] == seen[0] - {100, 101}
    assert seen[2] == seen[1] - {104}
    assert seen[3] == seen[2]
    assert docs.where("doc_id = 105").first()["text"].endswith("write to [EMAIL]")
    assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == seen[3] and len({r["sequence_id"] for r in packed}) == 1


def test_rows_without_ids(spark, tmp_path):
    texts = [" ".join(f"{chr(97 + k)}{w}{j}" for j, w in enumerate(LINE.split())) for k in range(4)]
    quiz = " ".join(f"quiz{k}" for k in range(20))
    rows = [(1, texts[0]), (None, texts[0] + " tail"), (None, texts[1]), (None, texts[1]), (None, texts[2]), (None, f"{texts[3]} {quiz} and on")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, quiz)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
    clean = corpus_pipeline.decontaminate(spark, kept, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_rows_of_one_id_are_told_apart(spark, tmp_path):
    """An id with two texts, repeated rows, near copies under other ids, extra columns."""
    texts = [" ".join(f"{chr(97 + k)}{w}{j}" for j, w in enumerate(LINE.split())) for k in range(4)]
    quiz = " ".join(f"quiz{k}" for k in range(20))
    rows = [(5, texts[0] + " end"), (5, texts[1]), (3, texts[0]), (3, texts[0]), (5, texts[2]), (7, texts[2] + " tail"), (5, f"{texts[3]} {quiz}"), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_extra": F.lit(1), "node": F.lit("x"), "hs": F.lit(0.5)})
    spark.createDataFrame([(1, quiz)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    want = [rows[1], rows[2], rows[4], rows[6], rows[7], rows[8]]
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    clean = corpus_pipeline.decontaminate(spark, kept, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted((r for r in want if r != rows[6]), key=str)


def test_empty_tables_and_long_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000)) + " " + "blob" * 20_000
    for name, rows in (("none", []), ("long", [(1, long, "en", "s", 0), (2, long + " tail", "en", "s", 0), (3, "a short text of a few words", "en", "s", 0)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, "none of this is in any text at all")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r["doc_id"] for r in got} == ({1, 3} if rows else set())


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_quality_matches_sql(spark):
    import duckdb

    from docloom.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op10_quality_rules"])
    names = [d[0] for d in want.description]
    got = queries.queries()["op10_quality_rules"](spark, DATA).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
