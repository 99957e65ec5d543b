"""Files, sync, sheets and the structure report."""

import io
import zipfile

from pyspark.sql import functions as F

from foliant.operators import chunks as C
from foliant.operators import report as P
from foliant.operators import sheets as H
from foliant.operators import sync as Y
from foliant.operators.blocks import blocks_from_text
from foliant.sources import files as S
from foliant.sources import html, logs, sinks


def col(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {type_}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_paths(spark):
    assert col(spark, ["docs/report.docx", "a/b.c/x", "y.PDF", ".hidden", "z.tar.gz"], Y.output_path) == \
        ["docs/report_d.pdf", "a/b.c/x.pdf", "y.pdf", ".hidden.pdf", "z.tar.pdf"]
    assert col(spark, ["a.DOCX", "b.xlsx", "c.csv", "d.exe", ".docx", "e"], Y.file_kind) == ["convert", "convert", "copy", "ignore", "ignore", "ignore"]
    assert col(spark, [50_000, 2_000_000, 20_000_000], Y.size_class, "long") == ["small", "medium", "large"]


def test_sync_twice_finds_nothing_new(spark):
    rows = [("a.txt", 3, 1, "md5", bytearray(b"one")), ("b.txt", 3, 2, "md5", bytearray(b"two")), ("c.docx", 3, 3, "md5", bytearray(b"doc"))]
    files = spark.createDataFrame(rows, "path string, size long, mtime_ns long, algorithm string, content binary")
    empty = spark.createDataFrame([], "path string, size long, mtime_ns long, hash string, algorithm string, cached_at timestamp")
    first = Y.reuse_hashes(files, empty)
    assert not any(r.reused for r in first.collect())
    manifest = Y.upsert_manifest(empty, first.withColumn("cached_at", F.to_timestamp(F.lit("2024-01-01"))))
    assert all(r.reused for r in Y.reuse_hashes(files, manifest).collect())
    same = first.withColumn("out_path", F.when(F.col("path") == "c.docx", "c_d.pdf").otherwise(F.col("path")))
    assert [r.path for r in Y.pending(same, manifest).collect()] == ["c.docx"]
    assert Y.pending(same, manifest.where("path <> 'a.txt'")).count() == 2
    later = F.to_timestamp(F.lit("2024-03-01"))
    assert Y.expire(manifest, later).count() == 0 and Y.manifest_stats(manifest).first().entries == 3
    assert col(spark, ["x"], lambda c: Y.content_hash(c, "nope")) == [""] and col(spark, [None], Y.content_hash) == [""]


def test_handlers(spark):
    lists = lambda **kw: {r.ext: r.handlers for r in Y.route(
        spark.createDataFrame([("a.docx",), ("a.html",), ("a.csv",), ("a.bin",)], "path string"), Y.handler_table(spark, **kw)).collect()}
    assert lists()[".docx"] == ["office", "layout", "word"] and lists()[".bin"] is None
    assert lists(office=False)[".html"] == ["alternative", "layout"] and lists(layout_level=4)[".docx"][0] == "layout"
    assert lists(layout_level=1)[".docx"][-1] == "layout" and lists(layout_level=0)[".csv"] == ["csv"]


def test_first_success(spark):
    rows = [("a", "x", 0, False), ("a", "y", 1, True), ("a", "z", 2, True), ("b", "x", 0, False)]
    df = spark.createDataFrame(rows, "path string, handler string, priority int, success boolean")
    assert {r.path: r.handler for r in Y.first_success(df).collect()} == {"a": "y", "b": None}


def test_page_segments_equal_a_walk(spark):
    import random
    rnd = random.Random(2)
    rows = []
    for sheet, n in (("big", 300), ("small", 9)):
        for i in range(n):
            x = rnd.random()
            rows.append(("d", sheet, i, ["", " "] if x < 0.12 else ["x <<<PAGE_BREAK>>>", ""] if x < 0.15 else [str(i), None]))
    df = spark.createDataFrame(rows, "doc string, sheet string, row long, cells array<string>").repartition(5)
    for blanks, limit in ((1, 1000), (2, 25)):
        got = {(r.sheet, r.row): (r.segment, r.page) for r in H.page_segments(df, header_rows=2, blank_rows=blanks, page_rows=4, group_limit=limit).collect()}
        for sheet in ("big", "small"):
            seg = page = data = empty = 0
            turn = False
            for _, _, i, cells in sorted((r for r in rows if r[1] == sheet), key=lambda r: r[2]):
                if i > 0:
                    if turn:
                        page, data = page + 1, 0
                    turn = False
                    blank = not any(c and c.strip() for c in cells)
                    mark = any(c and "<<<PAGE_BREAK>>>" in c for c in cells)
                    if mark:
                        seg, page, data, empty = seg + 1, 0, 0, 0
                    else:
                        empty = empty + 1 if blank else 0
                        if empty == blanks:
                            seg, page, data = seg + 1, 0, 0
                        if not blank and i >= 2:
                            data += 1
                            turn = data >= 4
                assert got[sheet, i] == (seg, page), (sheet, i)


def _mixed_sheets(spark):
    """Sheets that are tables or not, blank, short, of one column, without a name, and with cells that are null."""
    import random
    rnd = random.Random(5)
    rows = []
    for d, s, n, wide, late in (("a", "t", 60, 3, 0), ("b", "t", 40, 1, 0), ("a", "late", 50, 3, 4), ("a", "two", 2, 3, 0), ("a", "empty", 5, 0, 0),
                                ("a", None, 45, 3, 0), ("a", "gaps", 30, 3, 0), (None, "t", 20, 2, 0)):
        for i in range(n):
            cells = [str(i)] * wide if i >= late else [" "]
            if s == "gaps" and 0 < i < 9:
                cells = ["only", None, ""] if i % 2 else None
            x = rnd.random()
            rows.append((d, s, i, ["", " "] if i > 12 and x < 0.06 else ["x <<<PAGE_BREAK>>>"] if i > 12 and x < 0.1 else cells))
    return spark.createDataFrame(rows, "doc string, sheet string, row long, cells array<string>").repartition(5)


def test_sheets_are_judged_in_place_as_by_their_cells(spark):
    rows = _mixed_sheets(spark)
    rows = rows.unionByName(rows.where("sheet = 'late' AND row BETWEEN 4 AND 6"))  # rows that come twice
    panes = spark.createDataFrame([("a", "t", "A5"), ("a", "gaps", "?"), ("a", "late", "A3"), ("a", "late", "A4"), ("a", None, "A9"), ("a", "empty", "A2"), ("a", "none", "A2")],
                                  "doc string, sheet string, pane string")
    cells = rows.select("doc", "sheet", "row", F.posexplode_outer("cells").alias("col", "value")).where(H.filled(F.col("value")))
    found = lambda df, *names: sorted(tuple(map(str, r)) for r in df.select(*[F.col(c) for c in ("doc", "sheet", *names)]).distinct().collect())
    named = "doc IS NOT NULL AND sheet IS NOT NULL"
    judged = H.detect_tables(rows, in_place=True)
    tables = found(H.detect_tables(cells), "is_table", "n_columns")
    assert [t for t in found(judged.where(named), "_is_table", "_n_columns") if t[1] != "empty"] == tables
    assert {t[2] for t in tables} == {"True", "False"}
    assert not judged.where(f"_is_table AND (NOT ({named}) OR sheet = 'empty')").count()
    for given in (panes, None):
        profile = H.sheet_profile(rows, given, in_place=True)
        assert found(profile.where(f"{named} AND _n_rows IS NOT NULL"), "_n_rows", "_n_cols", "_has_table", "_frozen") == \
            found(H.sheet_profile(cells, given).where(named), "n_rows", "n_cols", "has_table", "frozen")
    assert H.sheet_profile(rows, panes, in_place=True).count() == rows.count() + rows.where("sheet = 'late'").count()


def test_detected_pages_are_the_same_in_place_and_in_parts(spark):
    rows = _mixed_sheets(spark).withColumn("frozen", F.lit("own"))
    panes = spark.createDataFrame([("a", "t", "A5"), ("a", "gaps", "A3"), ("a", "empty", "A2"), ("a", "empty", "A2"), ("a", None, "A9")], "doc string, sheet string, pane string")
    got = [sorted(map(str, H.detected_segments(rows, p, group_limit=limit, page_rows=4).collect())) for p in (panes, None) for limit in (1000, 25)]
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2] and len(got[0]) == rows.count()
    sizes = (60, rows.count())
    assert sorted(map(str, H.detected_segments(rows, panes, sizes=sizes, page_rows=4).collect())) == got[0]


def test_detected_pages_move_the_rows_once(spark, tmp_path, monkeypatch):
    import foliant.operators.ordered as O
    import foliant.plans.collection as plans

    monkeypatch.setattr(O, "PART_ROWS", 100)
    i = F.col("id")
    spark.range(3000).select(
        (i % 60).alias("l_suppkey"), F.floor(i / 60).alias("l_orderkey"), (i % 7 + 1).cast("int").alias("l_linenumber"), i.alias("l_partkey"),
        (i % 50 + 1).cast("double").alias("l_quantity"), (i * 1.5).cast("double").alias("l_extendedprice"), F.lit("A").alias("l_returnflag"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(60).select(i.alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    counted = []
    monkeypatch.setattr(H, "group_sizes", lambda df, keys: counted.append(df.columns) or O.group_sizes(df, keys))
    out = plans.sheet_detected_pages(spark, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # rows and panes
    assert counted == [["doc", "sheet", "pane"]]  # not the rows once more
    assert out.count() == 3000 and out.select("sheet", "row").distinct().count() == 3000
    # the operator alone, with rows that lie anywhere
    rows = spark.range(3000).select(F.concat(F.lit("d"), (i % 2).cast("string")).alias("doc"), F.concat(F.lit("S"), (i % 60).cast("string")).alias("sheet"),
                                    F.floor(i / 60).alias("row"), F.array(i.cast("string")).alias("cells"))
    panes = spark.createDataFrame([("d1", "S3", "A3")], "doc string, sheet string, pane string")
    alone = H.detected_segments(rows, panes)
    assert alone._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_sheet_helpers(spark):
    cells = [("d", "s", r, c, f"{r}{c}") for r in range(2, 11) for c in range(1, 6) if (r, c) != (3, 2)] + [("d", "t", 0, 0, "x")]
    df = spark.createDataFrame(cells, "doc string, sheet string, row int, col int, value string")
    u = {r.sheet: (r.first_row, r.first_col, r.last_row, r.last_col) for r in H.used_range(df).collect()}
    assert u["s"] == (2, 1, 10, 5)
    assert {r.sheet: (r.is_table, r.n_columns) for r in H.detect_tables(df).collect()} == {"s": (True, 5), "t": (False, 0)}
    grid = {(r.sheet, r.row): r.cells for r in H.to_grid(df).collect()}
    assert grid["s", 3] == ["", "31", "", "33", "34", "35"] and grid["t", 0] == ["x"]
    assert col(spark, ["A2", "B1", None, "?"], H.frozen_rows) == [1, 0, 0, 0]
    rows = spark.createDataFrame([("d", "s", i, [str(i)]) for i in range(34)] + [("d", "one", 0, ["h"])], "doc string, sheet string, row long, cells array<string>")
    p = H.paginate(rows, frozen=2).collect()
    assert max(r.page for r in p) == 3 and {len(r.headers) for r in p} == {2} and all(r.sheet == "s" for r in p)
    assert "Table page 3 of 3 (Sheet: s)" in {r.label for r in p}


def test_report(spark):
    rows = [("a/b/x.py", 1, "s\n1"), ("a/y", None, "p|q"), ("z.txt", 3, ""), ("logs/q.txt", 4, "")]
    df = spark.createDataFrame(rows, "path string, size long, summary string").where(P.not_excluded(F.col("path")))
    e = P.walk_order(P.entries(df))
    assert [r.path for r in e.collect()] == [".", "z.txt", "a", "a/y", "a/b", "a/b/x.py"]
    assert {r.path: r.summary for r in P.folders(df).collect()} == {
        ".": "Contains 1 file and 1 subfolder", "a": "Contains 1 file and 1 subfolder", "a/b": "Contains 1 file"}
    lines = [r.line for r in P.markdown_rows(e).collect()]
    assert "| ./a/y | file |  | p\\|q |" in lines and lines[0].startswith("| ./ | folder |")
    assert spark.range(1).select(P.folder_sentence(F.lit(0), F.lit(0))).first()[0] == "Empty folder"


def test_summaries(spark):
    assert col(spark, ["a\r\nb\n", "", "x" * 10, "word   more"], lambda c: P.placeholder_summary(c, 7)) == ["a b", "(empty or binary file)", "xxxxxxx ...", "word ..."]
    assert col(spark, ["Hello World", "aé😀b"], lambda c: P.truncate_bytes(c, 5)) == ["Hello", "aé"]
    for n in range(0, 9):
        text = "aé😀b日"
        assert col(spark, [text], lambda c: P.truncate_bytes(c, n)) == [text.encode()[:n].decode("utf-8", "ignore")]
    df = spark.createDataFrame([("a.md", "x"), ("b", "y")], "path string, text string")
    assert [r.summary for r in P.summarize(df, [".md"]).orderBy("path").collect()] == ["x", "Summary skipped for extension <no extension>"]


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.docx").write_bytes(_zip({"word/document.xml": "<d><t> Hello </t><t>docx</t></d>", "other.xml": "<a>no</a>"}))
    (root / "sub" / "b.XLSX").write_bytes(_zip({"xl/sharedStrings.xml": "<s>cell</s>", "xl/worksheets/s1.xml": "<v>7</v>"}))
    (root / "c.pptx").write_bytes(b"no archive \xff at all")
    (root / "d.txt").write_bytes(b"Hello text")
    assert S.file_inventory(spark, str(root), [".docx", ".xlsx"]).count() == 2
    got = {r.path.rsplit("/", 1)[1]: r.text for r in S.read_texts(spark, str(root)).collect()}
    assert got == {"a.docx": "Hello docx", "b.XLSX": "cell\n7", "c.pptx": "no archive  at all", "d.txt": "Hello text"}
    assert {r.text for r in S.read_texts(spark, str(root), max_bytes=5).where("path LIKE '%d.txt'").collect()} == {"Hello"}
    (tmp_path / "t.csv").write_bytes(b"name,v\nx\xff,1\ny,\n")
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("x", "1", None), ("y", "", None)]
    (tmp_path / "q.csv").write_bytes('a,n\n"x\ny",1\n"he said ""hi, you""",2\np,4,extra\n"\ufffd é",\n'.encode())
    got = [tuple(r) for r in S.read_csv(spark, str(tmp_path / "q.csv")).collect()]
    assert [r[:2] for r in got] == [("x\ny", "1"), ('he said "hi, you"', "2"), ("p", "4"), ("\ufffd é", "")]
    assert "extra" in got[2][2] and [r[2] for r in got[:2]] == [None, None]


def test_html_and_logs(spark):
    page = "<html><head><title>t</title></head><body><nav>n</nav><script>if(a<b){}</script><h1>HEAD</h1><p>One &amp; two<br>three &lt;b&gt;</p><!-- x --></body></html>"
    out = html.page_blocks(spark.createDataFrame([(page,)], "html string")).select(F.transform("blocks", lambda b: b["content"])).first()[0]
    assert out == ["HEAD", "One & two", "three <b>"]
    line = '1.2.3.4 - bob [10/Oct/2024:13:55:36 +0200] "GET /x HTTP/1.1" 404 12 "-" "ua" "-" rt=1.5 uct="-" uht="0.1" urt="0.2"'
    a, b = logs.parse_access_lines(spark.createDataFrame([(line,), ("junk",)], "value string")).collect()
    assert (a.ok, a.remote_user, a.status, a.path, a.request_time, a.connect_time, a.response_time) == (True, "bob", 404, "/x", 1.5, None, 0.2)
    assert not b.ok and b.status is None and b.path is None
    lines = ["", "nope", "[1]", '{"response": "a", "done": false}', '{"message": {"content": "b"}, "done": true, "eval_count": 3}']
    d = logs.parse_delta_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.text, r.done, r.completion_tokens) for r in d] == [("a", False, 0), ("b", True, 3)]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s/{i}", f"f{i}", "text here") for i in range(40)], "doc_id int, source_path string, filename string, text string")
    chunks = C.chunk_documents(blocks_from_text(docs), ["doc_id"])
    sinks.write_chunks(chunks, str(tmp_path / "c"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 40 and back.select("bucket").distinct().count() > 1
    e = P.entries(spark.createDataFrame([("a/x.py", 1, "s")], "path string, size long, summary string"))
    sinks.write_markdown(e, str(tmp_path / "m"), "root", "conf")
    text = [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert text[0] == "# Structure map for `root`" and text[5].startswith("| ---") and text[-1] == "| ./a/x.py | file | 1 | s |"
    sinks.write_entries_json(e, str(tmp_path / "j"))
    assert {r.path: r.size for r in spark.read.json(str(tmp_path / "j")).collect()} == {"./": "", "./a": "", "./a/x.py": "1"}
