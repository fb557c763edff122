import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators import answers, chunking, layout, retrieval, structure, tables
from docloom.plans import pipeline
from docloom.sources import files, store


def test_row_groups(spark):
    rows = [("a", 0, ["", ""])] + [("a", 1, ["Item", ""])] + [("a", 1 + k, [f"v{k}", "", "extra"]) for k in range(1, 42)] + [("b", 0, ["only", "head"])]
    df = spark.createDataFrame(rows, "t string, n int, cells array<string>").withColumn("label", F.concat(F.lit("Table "), "t"))
    got = {(r["t"], r["group"]): r for r in tables.row_groups(df, ["t"], "n").collect()}
    assert [(got["a", g]["table_row_start"], got["a", g]["table_row_end"]) for g in range(3)] == [(1, 20), (21, 40), (41, 41)]
    assert got["a", 2]["text"] == "Table a\nHeaders: Item | Column 2\nRow 41: Item: v41"
    assert got["b", 0]["text"] == "Table b\nHeaders: only | head\nRow 1: only: only; head: head"


def test_semantic_parts():
    same, other = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    split = lambda parts, vectors, **k: chunking.semantic_parts(parts, np.array(vectors), Settings(**k))
    assert split(["a.", "b.", "c."], [same, same, other]) == ["a. b.", "c."]
    assert split(["a.", "c."], [same, other]) == ["a. c."]
    assert split(["a.", "1. step", "2. step"], [same] * 3) == ["a.", "1. step", "2. step"]
    assert split(["x.", "Normal time: a", "Crash time: b"], [same, same, other]) == ["x. Normal time: a Crash time: b"]
    assert split(["a" * 60, "b" * 60], [same] * 2, semantic_max_characters=100) == ["a" * 60, "b" * 60]
    assert split(["a" * 200, "b"], [same] * 2, semantic_max_characters=100) == ["a" * 200, "b"]


def test_python_stages_get_small_batches(spark):
    """However many rows a task has, an embedder is called before more than a few MB of them have been taken in."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    text = "A cat sat on a mat. " * 500
    rows = spark.range(0, 2000, 1, 1).select(F.lit(text).alias("text"), F.array(F.lit(text), F.col("id").cast("string")).alias("s"))
    taken = []

    def sizes(texts):
        taken.append(len(texts))
        return np.full((len(texts), 2), max(taken), dtype=float)

    most = chunking.semantic_chunks(rows, "s", sizes, batch=100_000).where(F.length(F.element_at("parts", 1)) < len(text))
    assert most.count() == 0  # grouped as before
    got = pipeline.embedded(rows.drop("s"), "text", sizes, batch=100_000)
    assert got.count() == 2000 and got.agg(F.max(F.element_at("dense", 1))).first()[0] <= (4 << 20) / len(text)


def test_parents_come_from_one_pass_over_files(spark):
    """Files that follow one another in a task, cut by batches, don't see one another's headings; no call for each file."""
    rows = [("c", f"f{f}", o, (f + o) % 4 + 1) for f in range(40) for o in range(1, 30)]
    nodes = spark.createDataFrame(rows, "chat_id string, file_path string, ord int, level int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = structure.with_parents(nodes)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["file_path"], r["ord"]): r["parent_ord"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    level = {(f, o): v for _, f, o, v in rows}
    assert got == {(f, o): max((p for p in range(1, o) if level[f, p] < v), default=None) for (f, o), v in level.items()}


def test_chunk_segments(spark):
    rows = [(0, "Heading", "heading"), (1, "One. Two. ***", None), (2, "Table 1\nHeaders: a", "table"), (3, "Page 3", None)]
    df = spark.createDataFrame(rows, "source_segment int, text string, content_kind string")
    got = sorted((r["source_segment"], r["chunk_index"], r["chunk_count"], r["chunking_method"], r["text"]) for r in chunking.chunk_segments(df).collect())
    assert [g[0] for g in got] == [1, 2] and got[1][3:] == ("table", "Table 1\nHeaders: a")


def test_levels_and_parents_match_a_stack(spark):
    rng = np.random.default_rng(3)
    rows = []
    for f in range(20):
        for k in range(1, 15):
            rows.append((f"f{f}", k, str(rng.choice(["Intro", "1 A", "1.1 B", "2.1.3 C", "Notes"])), None if rng.random() < 0.5 else int(rng.integers(1, 4))))
    df = spark.createDataFrame(rows, "file_path string, ord int, title string, heading_level int")
    got = {(r["file_path"], r["ord"]): (r["level"], r["parent_ord"]) for r in structure.with_parents(structure.with_levels(df, ["file_path"]), ["file_path"]).collect()}
    import re

    for f in range(20):
        before, stack = 0, []
        for _, k, title, level in [r for r in rows if r[0] == f"f{f}"]:
            number = re.match(r"^(\d+(?:\.\d+)*)\.?\s+", title)
            level = level or (number.group(1).count(".") + 1 if number else (2 if before == 1 else max(before, 1)))
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[f"f{f}", k] == (level, stack[-1][0] if stack else None)
            stack.append((k, level))
            before = level


def test_trees(spark):
    rows = [
        (0, "stray", None, None, None), (1, "Intro", "Intro", True, 1), (2, "first", "Intro", None, 1), (3, "Deep", "Deep", True, 1), (4, "x y", "Deep", None, 2), (5, "y", "Deep", None, 3), (6, "intro", "intro", True, 4), (7, "late", "Intro", None, 5), (8, "Empty", "Empty", True, 6),
    ]
    df = spark.createDataFrame(rows, "seg_no int, text string, section string, is_heading boolean, page int").withColumns({"chat_id": F.lit("c"), "file_path": F.lit("a.pdf"), "heading_level": F.lit(None).cast("int"), "content_kind": F.lit(None).cast("string")})
    got = {r["node_id"]: r for r in structure.build_trees(df).collect()}
    assert set(got) == {"section-2", "section-3"}  # twins give all bodies to the last
    assert got["section-3"]["text"] == "first\n\nlate" and (got["section-3"]["page_start"], got["section-3"]["page_end"]) == (1, 5)
    assert got["section-2"]["text"] == "x y" and got["section-2"]["parent_id"] == "section-1"


def test_router_reply(spark):
    df = spark.createDataFrame([('x {"section_ids": ["b", "z", "a"]} y',), ("no json",), (None,)], "r string").withColumn("valid", F.array(F.lit("a"), F.lit("b")))
    assert [r[0] for r in df.select(structure.selected_ids(F.col("r"), F.col("valid"))).collect()] == [["b", "a"], [], []]


def test_catalog_budget(spark):
    df = spark.createDataFrame([("a", 1, "x" * 30_000), ("a", 2, "y"), ("b", 1, "x" * 11_999), ("b", 2, "y" * 11_999), ("c", 1, "x" * 12_000), ("c", 2, "y" * 11_999)], "chat_id string, n int, entry string")
    assert sorted((r["chat_id"], r["n"]) for r in structure.within_budget(df, ["chat_id"], ["n"]).collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 1)]


def test_glyph_regions(spark):
    rows = [("f", 1, "glyph", x, y, x + 8, y + 8) for x, y in [(10, 10), (30, 12), (10, 50)]]
    df = spark.createDataFrame([(a, b, c, *map(float, r)) for a, b, c, *r in rows], "file_path string, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in layout.glyph_regions(df).collect())
    assert got == [(10.0, 10.0, 38.0, 20.0), (10.0, 50.0, 18.0, 58.0)]


def test_fusion_thresholds(spark):
    lists = [spark.createDataFrame([(1, f"{name}{k}", float(100 - k), k) for k in range(1, 25)], "query_id int, chunk_id string, score double, rank long") for name in "ab"]
    rrf = {r["chunk_id"]: r["rrf"] for r in retrieval.fused(lists).collect()}
    assert rrf["a20"] == 0.0125 and rrf["a24"] < 0.012 <= rrf["a23"]
    both = retrieval.fused([lists[0], lists[0]])
    assert both.where("chunk_id = 'a1'").first()["rrf"] == round(2 / 61, 9)


def test_answers(spark):
    questions = spark.createDataFrame([(1, "q"), (2, "nothing")], "query_id int, question string")
    hits = spark.createDataFrame([(1, 1, "/x/a.pdf", " one "), (1, 2, "b.pdf", "two")], "query_id int, pos int, source string, text string")
    plain = {r["query_id"]: r for r in answers.answers(questions, hits).collect()}
    assert plain[1]["context"] == "[1] a.pdf\none\n\n[2] b.pdf\ntwo" and plain[1]["answer"].endswith("[1] a.pdf\none") and plain[2]["n_passages"] == 0
    modelled = answers.answers(questions, hits, lambda q, c: f"{q}! CITATIONS: [2, 7]")
    used = {r["pos"]: r["used"] for r in answers.results_with_use(modelled, hits).collect()}
    assert used == {1: False, 2: True} and modelled.where("query_id = 1").first()["answer"] == "q!"


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style></w:styles>')
    return out.getvalue()


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="Costs" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>Item</t></si><si><t>Total</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>0</v></c><c r="B3"><f>A3*2</f><v>4</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def byte_files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_parsers(spark):
    table = [["Name", "Value"], ["x", "1"]]
    given = byte_files(spark, **{"/d/a.docx": docx([("H2", "Plan"), ("Normal", "Body text."), ("Normal", "")], table), "/d/b.xlsx": xlsx(), "/d/c.txt": b" hello\nworld \xff ", "/d/d.txt": b"  ", "/d/e.pdf": b"%PDF", "/d/f.png": b"", "/d/g.docx": b"broken"})
    segments, errors = files.parse_files(given)
    got = {(r["file_name"], r["source_type"]): r for r in segments.collect()}
    assert got["a.docx", "docx_heading"]["heading_level"] == 2 and got["a.docx", "docx"]["section"] == "Plan"
    assert got["a.docx", "docx_table"]["text"] == "Table 1\nHeaders: Name | Value\nRow 1: Name: x; Value: 1"
    assert got["b.xlsx", "excel_table"]["text"] == "Sheet Costs\nHeaders: Item | Total\nRow 1: Item: 0; Total: Formula: =A3*2; calculated value: 4"
    assert got["c.txt", "txt"]["text"] == "hello\nworld �" and got["c.txt", "txt"]["line_end"] == 2
    assert [r["source_segment"] for r in segments.orderBy("source_segment").collect()] == list(range(5))
    assert {r["path"] for r in errors.collect()} == {"/d/e.pdf", "/d/f.png", "/d/g.docx"}


def test_zip_limits(spark):
    given = byte_files(spark, ok=archive(**{"a/x.txt": b"1", "y.png": b"2"}), unsafe=archive(**{"../x.txt": b"1"}), absolute=archive(**{"/x.txt": b"1"}), not_zip=b"zip?", many=archive(**{f"{k}.md": b"" for k in range(1001)}), edge=archive(**{f"{k}.md": b"" for k in range(1000)}))
    got = files.zip_members(given).collect()
    assert [r["path"] for r in got if r["error"] is None] == ["ok!/a/x.txt"]
    assert {r["path"] for r in got if r["error"]} == {"unsafe", "absolute", "not_zip", "many"}


def test_pdf_through_a_reader(spark):
    def reader(data):
        line = lambda n, text, size: {"page": 1, "line_no": n, "x0": 0.0, "y0": 10.0 * n, "x1": 90.0, "y1": 10.0 * n + 9, "spans": [{"text": text, "size": size, "flags": 0}]}
        return [line(0, "Scope", 14.0), line(1, "this is a body line.", 10.0), line(2, "and its end.", 10.0)], []

    segments, _ = files.parse_files(byte_files(spark, **{"/p.pdf": b"x"}), reader)
    assert [(r["source_type"], r["section"], r["text"]) for r in segments.orderBy("source_segment").collect()] == [("pdf_heading", "Scope", "Scope"), ("pdf", "Scope", "this is a body line. and its end.")]


@pytest.fixture
def shop(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/store", pipeline.POINTS, 64)


def test_end_to_end(spark, shop):
    given = byte_files(spark, **{"/d/crash.txt": b"Crash cost is the extra price. 1. Start early. 2. Add people. 3. Check cost.", "/d/other.txt": b"Gardens need water and light in summer."})
    report = pipeline.ingest(shop, given, chat_id="c1", chat_name="Chat")
    assert report["segments"] == 2 and report["units"] == shop.points.count() and report["skipped"] == []
    again = pipeline.ingest(shop, given, chat_id="c1")
    assert again["units"] == shop.points.count()
    questions = spark.createDataFrame([(1, "What are the steps to crash cost?"), (2, "zzz qqq")], "query_id long, question string")
    hits = [r for r in pipeline.search_documents(shop, questions, chat_id="c1").orderBy("query_id", "pos").collect() if r["query_id"] == 1]
    assert hits[0]["file_path"] == "/d/crash.txt" and [h["chunk_index"] for h in hits] == sorted(h["chunk_index"] for h in hits)
    answered, used = pipeline.answer_questions(shop, questions, "c1")
    assert answered.count() == 2 and used.where("query_id = 1 and used").count() > 0
    assert pipeline.search_trees(shop, questions, None) is None
    assert {r["path"]: r["mode"] for r in shop.chat_files("c1").collect()} == {"/d/crash.txt": "hybrid_vector", "/d/other.txt": "hybrid_vector"}
    shop.delete_chat_documents("c1")
    assert shop.points.count() == 0


def test_structured_route(spark, shop):
    def reader(data):
        out, n = [], 0
        for k in range(7):
            out.append({"page": k // 2 + 1, "line_no": n, "x0": 0.0, "y0": 10.0 * n, "x1": 9.0, "y1": 10.0 * n + 9, "spans": [{"text": f"{k + 1}. Topic {chr(65 + k)}", "size": 14.0, "flags": 0}]})
            out.append({"page": k // 2 + 1, "line_no": n + 1, "x0": 0.0, "y0": 10.0 * n + 10, "x1": 9.0, "y1": 10.0 * n + 19, "spans": [{"text": f"the budget of part {k} is described here, with zebra{k}.", "size": 10.0, "flags": 0}]})
            n += 2
        return out, []

    report = pipeline.ingest(shop, byte_files(spark, **{"/d/book.pdf": b"x"}), chat_id="c", pdf_reader=reader)
    assert report["segments"] == 0 and report["units"] == 7 and shop.points.count() == 0
    questions = spark.createDataFrame([(1, "Which part describes the budget of zebra3?")], "query_id long, question string")
    hits = pipeline.search_trees(shop, questions, "c").orderBy("rank").collect()
    assert hits[0]["section"] == "4. Topic D" and hits[0]["score"] == 1.0
    answered, _ = pipeline.answer_questions(shop, questions, "c")
    assert "zebra3" in answered.first()["answer"]


def test_chats(spark, shop):
    shop.ensure()
    shop.upsert_chat("a", "First")
    shop.upsert_chat("b", "First")
    shop.upsert_chat("a", "Renamed")
    assert {r["id"]: r["name"] for r in shop.all_chats().collect()} == {"a": "Renamed", "b": "First"}
    shop.append_message("a", "q1", "a1", [("t", "s", 1.0, "{}", True)])
    shop.append_message("a", "q2", "a2", [])
    assert [r["question"] for r in shop.history("a").collect()] == ["q1", "q2"]
    shop.delete_chat("a")
    assert shop.history("a").count() == 0 and shop.all_chats().count() == 1
    assert all(shop.health().values())


def test_wrong_dimension(spark, shop):
    shop.ensure()
    row = spark.createDataFrame([("x", [1.0])], "chunk_id string, dense array<float>").selectExpr("chunk_id", "dense", *[f"cast(null as {t}) as `{c}`" for c, t in pipeline.POINT_COLUMNS.items() if c not in ("chunk_id", "dense")])
    with pytest.raises(ValueError, match="expected 64"):
        shop.index_points(row)


def test_nearest_vectors_agree_with_all_scores(spark, monkeypatch):
    """Blocks give what ranking every pair gives: copies tie by id, near ties by rounding, odd vectors count as before."""
    rng = np.random.default_rng(5)
    made = [rng.normal(size=6).tolist() for _ in range(150)]
    made += [made[3]] * 60 + [(np.array(made[3]) + 1e-8 * k).tolist() for k in range(40)] + [[0.0] * 6, None, [1.0, None, 2.0, 0.0, 0.0, 1.0], [1.0, 2.0], [], [float("nan")] * 6, [float("inf")] + [1.0] * 5]
    rows = spark.createDataFrame([(f"{k * 7 % 1000}", v) for k, v in enumerate(made)], "chunk_id string, dense array<double>").withColumn("query_id", F.col("chunk_id").cast("long"))
    asked = rows.where("query_id % 5 = 0 or dense is null or size(dense) < 6").select("query_id", F.col("dense").alias("vector"))
    want = [tuple(map(repr, r)) for r in retrieval.ranked(retrieval.dense_scores(asked, rows), 20).select("query_id", "chunk_id", "score", "rank").collect()]
    for most in (1 << 20, 3000):  # one block; a grid
        monkeypatch.setattr(retrieval, "QUESTION_BLOCK", most)
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", most)
        found = retrieval.dense_top(asked, rows, 20)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(map(repr, r)) for r in found.select("query_id", "chunk_id", "score", "rank").collect()) == sorted(want)


def test_postings_agree(spark):
    texts = spark.createDataFrame([("a", "The cat, the dog. Über 12"), ("b", ""), ("c", "dog dog dog cat"), ("d", None)], "chunk_id string, text string")
    got = {(r["chunk_id"], r["term"]): (r["tf"], r["n_terms"]) for r in retrieval.postings(texts).collect()}
    assert got == {("a", "the"): (2, 5), ("a", "cat"): (1, 5), ("a", "dog"): (1, 5), ("a", "über"): (1, 5), ("a", "12"): (1, 5), ("c", "dog"): (3, 2), ("c", "cat"): (1, 2)}
    questions = spark.createDataFrame([(1, "dog or bird")], "query_id int, question string")
    some = {(r["chunk_id"], r["term"]): (r["tf"], r["n_terms"]) for r in retrieval.postings_of(questions, texts).collect()}
    assert some == {k: v for k, v in got.items() if k[1] == "dog"}
    assert {r["term"]: r["df"] for r in retrieval.text_term_stats(texts).collect()} == {r["term"]: r["df"] for r in retrieval.term_stats(retrieval.postings(texts)).collect()}


def test_interrupted_and_competing_writers(spark, shop):
    """A manifest that its writer didn't finish is no version; of two writers from one version the second is refused."""
    table = shop.chats
    table.create()
    shop.upsert_chat("a", "First")
    number, manifest = table._newest()
    fs, file = table._fs(f"{table.path}/manifest-{number + 1:010d}.json")
    out = fs.create(file, False)
    out.write(bytearray(b'{"a": ["v-'))
    out.close()
    assert table._newest() == (number, manifest) and shop.all_chats().count() == 1 and not table.create()
    shop.upsert_chat("b", "Second")
    assert table._newest()[0] == number + 2 and {r["id"] for r in shop.all_chats().collect()} == {"a", "b"}
    with pytest.raises(RuntimeError, match="another writer"):
        table._point({}, number)
    assert shop.all_chats().count() == 2
    for k in range(4):
        shop.upsert_chat("a", f"Name {k}")
    assert table.vacuum(keep=2) >= 3 and len(table._manifests()) == 2
    assert {r["id"]: r["name"] for r in shop.all_chats().collect()} == {"a": "Name 3", "b": "Second"}
    with pytest.raises(RuntimeError, match="another writer"):
        table._point({}, number)


def test_a_batch_changes_each_table_once(spark, shop, monkeypatch):
    changes = []
    rewrite = store.Table._rewrite
    monkeypatch.setattr(store.Table, "_rewrite", lambda self, *a: (changes.append(self.path.rsplit("/", 1)[-1]), rewrite(self, *a)))
    text = lambda k: f"Text number {k} speaks of cost and time.".encode()
    pipeline.ingest(shop, byte_files(spark, **{f"/old/{k}.txt": text(k) for k in range(12)}), chat_id="c")
    pipeline.ingest(shop, byte_files(spark, **{"/old/0.txt": text(0)}), chat_id="other")
    assert changes == ["points", "points"]
    # the same names from another folder, one of them now empty: the older points of the batch's files go, others stay
    report = pipeline.ingest(shop, byte_files(spark, **{f"/new/{k}.txt": text(k) if k else b"" for k in range(6)}), chat_id="c")
    assert changes == ["points"] * 3 and report["skipped"] == ["0.txt"]
    assert sorted(r["file_path"] for r in shop.points.read(["c"]).collect()) == [f"/new/{k}.txt" for k in range(1, 6)] + sorted(f"/old/{k}.txt" for k in range(6, 12))
    assert [r["file_path"] for r in shop.points.read(["other"]).collect()] == ["/old/0.txt"]
    pipeline.ingest(shop, byte_files(spark, **{"/new/none.txt": b""}), chat_id="c")
    assert changes == ["points"] * 3
    shop.points.delete(["c"], F.col("file_name") == "absent.txt")
    assert changes == ["points"] * 3


def test_many_chats_share_files(spark, shop):
    """A change of thousands of chats writes few folders, whole or by deletion, and leaves ranges that it doesn't touch."""
    table = shop.messages
    table.create()
    rows = spark.range(3000).selectExpr("concat('chat', id) as chat_id", "'m' as id", "cast(id as string) as question", "'a' as answer", "timestamp_seconds(id) as created_at").withColumn("sources", F.lit(None).cast(table.schema["sources"].dataType))
    shop.append_messages(rows)
    assert len(table.manifest()) == 1 and table.count() == 3000
    shop.append_messages(rows.where("created_at < timestamp_seconds(10)").withColumn("answer", F.lit("b")))
    assert table.count() == 3000 and table.read().where("answer = 'b'").count() == 10
    table.delete(rows.where("cast(question as int) % 3 = 0").select("chat_id"))
    table.delete([f"chat{k}" for k in range(3000) if k % 3 == 1])
    assert table.count() == 1000 and shop.history("chat5").first()["answer"] == "b" and shop.history("chat6").count() == 0
    before = table._newest()[0]
    table.delete(["chat6", "absent"])
    table.delete(["chat5"], F.col("question") == "none")
    assert table._newest()[0] == before
    # ranges are cut by rows; only the one that holds a changed chat is rewritten
    cut = store.cut([(0, store.SLOTS - 1)], table._slots(table.read()), 300)
    assert [lo for lo, _ in cut] == [0, *[hi + 1 for _, hi in cut[:-1]]] and cut[-1][1] == store.SLOTS - 1 and len(cut) in (4, 5)
    assert store.cut([(0, 9), (20, 29)], {3: 900, 4: 1, 25: 5}, 300) == [(0, 3), (4, 9), (20, 29)]
    whole = table._started()
    table._rewrite(table.read(), list(whole[1]), {s: store.RANGE_ROWS * n // 50 for s, n in table._slots(table.read()).items()}, whole)
    many = table.manifest()
    shop.append_message("chat5", "q", "a", [])
    changed = {name for name in many if table.manifest().get(name) != many[name]}
    assert len(many) > 10 and len(changed) == 1 and store.span(changed.pop())[0] <= store.slot("chat5") and table.count() == 1001
    ids = spark.createDataFrame([("chat5",), ("ü",), ("",)], "id string")
    assert [r[0] for r in ids.select(store.slot_of(F.col("id"))).collect()] == [store.slot(v) for v in ("chat5", "ü", "")]


def test_tables_with_a_folder_for_each_chat_are_read_and_changed(spark, shop):
    table = shop.chats
    spark.createDataFrame([("a", "First", None), ("b c", "Second", None)], table.schema).withColumn("_by", F.col("id")).write.partitionBy("_by").parquet(f"{table.path}/v-old")
    fs, file = table._fs(f"{table.path}/manifest-0000000001.json")
    out = fs.create(file, False)
    out.write(bytearray(b'{"a": ["v-old/_by=a"], "b c": ["v-old/_by=b c"]}'))
    out.close()
    assert {r["id"] for r in table.read().collect()} == {"a", "b c"} and table.read(["b c"]).first()["name"] == "Second"
    table.delete(["a"])
    assert [r["id"] for r in table.read().collect()] == ["b c"]


def test_archives_are_ingested(spark, shop):
    inner = archive(**{"notes/plan.txt": b"The plan of the bridge is ready.", "notes/cost.txt": b"Cost is high this year.", "pic.png": b"x"})
    report = pipeline.ingest(shop, byte_files(spark, **{"/up/all.zip": inner, "/up/bad.zip": b"no archive", "/up/one.txt": b"One more text."}), chat_id="z")
    assert {r["file_path"] for r in shop.points.read(["z"]).collect()} == {"/up/all.zip!/notes/plan.txt", "/up/all.zip!/notes/cost.txt", "/up/one.txt"}
    assert set(report["errors"]) == {"/up/bad.zip"} and report["skipped"] == [] and report["files"] == 3


def pdf_page():
    """One page: a heading, prose, a table with an image and a glyph in it, prose below, a lone image and lone glyphs."""
    line = lambda n, text, y, size=10.0: {"page": 1, "line_no": n, "x0": 0.0, "y0": y, "x1": 100.0, "y1": y + 9, "spans": [{"text": text, "size": size, "flags": 0}]}
    box = lambda kind, x0, y0, x1, y1, **more: {"kind": kind, "page": 1, "x0": x0, "y0": y0, "x1": x1, "y1": y1, **more}
    lines = [line(0, "Scope", 0.0, 14.0), line(1, "this is the text above.", 20.0), line(2, "Item Cost cell text", 110.0), line(3, "this is the text below.", 300.0)]
    boxes = [
        box("table", 0.0, 100.0, 200.0, 200.0, table=1, rows=[["Item", "Cost"], ["a \n b", None], ["c", "4"]]), box("table", 0.0, 290.0, 200.0, 320.0, table=2, rows=[["", None]]),
        box("image", 10.0, 120.0, 50.0, 140.0), box("image", 0.0, 100.0, 200.0, 180.0), box("image", 300.0, 400.0, 380.0, 430.0), box("image", 300.0, 500.0, 310.0, 505.0),
        box("glyph", 60.0, 150.0, 70.0, 160.0), box("glyph", 72.0, 151.0, 80.0, 161.0), box("glyph", 300.0, 600.0, 310.0, 610.0), box("glyph", 2.0, 301.0, 8.0, 307.0),
    ]
    return lines, boxes


def test_pdf_tables_and_images(spark):

    def ocr(data, page, region, zoom):
        return f"region {region[0]:.0f} {region[1]:.0f} zoom {zoom:.0f}" if region[0] < 310 else "x"

    given = byte_files(spark, **{"/d/p.pdf": b"%PDF", "/d/broken.pdf": b""})
    page = pdf_page()

    def reader(data):
        if not data:
            raise ValueError("no pages")
        return page

    plain, errors = files.parse_files(given, reader)
    got = [(r["source_type"], r["text"], r["has_embedded_images"]) for r in plain.orderBy("source_segment").collect()]
    assert got == [
        ("pdf_heading", "Scope", None), ("pdf", "this is the text above. this is the text below.", None), ("pdf_table", "Table 1\nHeaders: Item | Cost\nRow 1: Item: a b\nRow 2: Item: c; Cost: 4", True),
    ]
    assert [r["path"] for r in errors.collect()] == ["/d/broken.pdf"]
    read, _ = files.parse_files(given, reader, Settings(enable_pdf_ocr=True), ocr)
    rows = read.orderBy("source_segment").collect()
    assert [r["source_type"] for r in rows] == ["pdf_image", "pdf_image", "pdf_heading", "pdf", "pdf_table"]
    assert [r["text"] for r in rows[:2]] == ["[Image content]\nregion 300 400 zoom 3", "[Image content]\nregion 298 598 zoom 5"]
    table = rows[-1]  # the picture of the whole table is left out; glyphs of a line are one region without padding
    assert table["image_ocr"] == ["region 10 120 zoom 3", "region 60 150 zoom 5"] and table["text"].endswith("Row 2: Item: c; Cost: 4\n\n[Image content]\nregion 10 120 zoom 3\nregion 60 150 zoom 5")
    few, _ = files.parse_files(given, reader, Settings(enable_pdf_ocr=True, max_images_per_table=1), ocr)
    assert [r["source_type"] for r in few.orderBy("source_segment").collect()].count("pdf_image") == 1
    assert [r["source_type"] for r in files.parse_files(given, reader, Settings(), ocr)[0].collect()].count("pdf_image") == 0


def test_small_is_measured_in_bytes(spark):
    few = spark.createDataFrame([(k, [float(k)] * 64) for k in range(20)], "query_id long, _q array<double>")
    assert retrieval.small(few) is not few and retrieval.small(few, 2000) is few
    blocks = retrieval.query_blocks(few, 4000)
    assert len(blocks) > 1 and sorted(r["query_id"] for b in blocks for r in b.collect()) == list(range(20))
    questions = few.select("query_id", F.col("_q").alias("vector"))
    vectors = spark.createDataFrame([(f"c{k}", [float(k % 3 + 1)] * 64) for k in range(9)], "chunk_id string, dense array<double>")
    want = sorted(map(tuple, retrieval.dense_scores(questions, vectors).collect()))
    before = retrieval.BROADCAST_BYTES
    try:
        retrieval.query_blocks.__defaults__ = (4000,)
        assert sorted(map(tuple, retrieval.dense_scores(questions, vectors).collect())) == want and len(want) == 180
    finally:
        retrieval.query_blocks.__defaults__ = (before,)


def test_pruned_scores_give_the_same_search(spark):
    rng = np.random.default_rng(8)
    rows = [(q, f"f{f}#{c}", f"f{f}", float(np.round(rng.random() * (3 if f == q else 1), 6))) for q in range(4) for f in range(12) for c in range(60)]
    scores = [spark.createDataFrame([r for r in rows if rng.random() < 0.8], "query_id long, chunk_id string, file_path string, score double") for _ in range(2)]
    chunks = spark.createDataFrame([(f"f{f}#{c}", f"text {f} {c % 50}") for f in range(12) for c in range(60)], "chunk_id string, text string")
    full = sorted(map(tuple, retrieval.two_phase_search(*scores, chunks).collect()))
    pruned = [retrieval.searchable(s) for s in scores]
    assert all(p.count() < s.count() for p, s in zip(pruned, scores, strict=True))
    assert sorted(map(tuple, retrieval.two_phase_search(*pruned, chunks).collect())) == full and len(full) == 32


def test_upload_paths(spark):
    from docloom.functions import text as T

    df = spark.createDataFrame([("a/b/Plan.pdf",), ("..\\x\\y.txt",), ("plain.docx",)], "n string")
    got = [r[0] for r in df.select(T.upload_path(F.lit("up"), F.col("n"), F.lit("t"))).collect()]
    assert got == ["up/t_Plan.pdf", "up/t_y.txt", "up/t_plain.docx"]
    assert len({r[0] for r in df.select(T.upload_path(F.lit("up"), F.lit("same.txt"))).collect()}) == 3
