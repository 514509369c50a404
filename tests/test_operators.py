"""Operators on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import edits, flow, forms, graph, layout, models, pages, rows, tables, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


# text


@pytest.mark.parametrize(
    "cell, want",
    [
        ("1.234", 1234.0), ("1 234,56", 1234.56), ("12.3456", None), ("42%", 0.42), ("$1,234.50", 1234.5), ("1.234,5 €", 1234.5), ("-7", -7.0), ("−7,25", -7.25), ("+3", 3.0), ("1,2,3", None), ("1234,567", None), ("12,34,567", None), ("", None), ("  ", None),
        ("abc", None), ("$", None), ("%", None), ("-", None), ("1234567890123456", None), ("123456789012345", 123456789012345.0), ("1 000", 1000.0), ("0.5%", 0.005), ("$5%", None), ("1.", None), ("99.9", 99.9), ("12 345 678", 12345678.0), ("1.234.567,89", 1234567.89),
    ],
)
def test_number(spark, cell, want):
    assert one(spark, text.number, cell) == (pytest.approx(want) if want is not None else None)


def test_search_semantics(spark):
    df = spark.createDataFrame([(1, "aXa axa\nxx"), (2, "Find the cat. The cat sat."), (3, None), (4, "a.b\na+b \\E q")], "doc_id long, text string")
    assert text.search(df, "cat").count() == 2
    assert [tuple(r) for r in text.search(df, "A", ignore_case=True).where("doc_id = 1").orderBy("match_no").collect()] == [(1, 1, 1, "a"), (1, 1, 2, "a"), (1, 1, 3, "a"), (1, 1, 4, "a")]
    assert text.search(df, "x*", regex=True).where("doc_id = 1").orderBy("line_no", "match_no").first().match == "x"
    assert text.search(df, "a.b").count() == 1 and text.search(df, "a+b \\E").count() == 1
    assert text.search(df, "a\nx").count() == 0
    with pytest.raises(ValueError):
        text.search(df, "")
    for bad in ("(?=x)", r"(a)\1", "(?<!x)y", "a++"):
        with pytest.raises(ValueError):
            text.search(df, bad, regex=True)


def test_replace_is_literal(spark):
    df = spark.createDataFrame([(1, "cost $5\n$5")], "doc_id long, text string")
    r = text.replace(df, "$5", "$1\\").first()
    assert (r.text, r.n_replaced) == ("cost $1\\\n$1\\", 2)


@pytest.mark.parametrize("raw, want", [("a  \n\n\n\n\nb\t", "a\n\n\nb"), ("\n\n a\n", "a"), ("a\n\n\nb", "a\n\n\nb"), ("a \n \n \n \nb", "a\n\n\nb"), ("", ""), (" a ", "a")])
def test_clean(spark, raw, want):
    assert one(spark, text.clean, raw) == want


@pytest.mark.parametrize("n, roman, alpha", [(1, "i", "a"), (4, "iv", "d"), (26, "xxvi", "z"), (27, "xxvii", "aa"), (28, "xxviii", "ab"), (702, "dccii", "zz"), (703, "dcciii", "aaa"), (3999, "mmmcmxcix", "ewu"), (0, "", "")])
def test_number_styles(spark, n, roman, alpha):
    assert one(spark, text.roman, n, "int") == roman and one(spark, text.alphabetic, n, "int") == alpha


@pytest.mark.parametrize("raw, want", [("D:20240131", "2024-01-31T00:00:00"), ("D:2024", "2024-01-01T00:00:00"), ("D:20240131120000Z", "2024-01-31T12:00:00Z"), ("20240131120000-05'30'", "2024-01-31T12:00:00-05:30"), ("soon", None)])
def test_dates(spark, raw, want):
    assert one(spark, text.document_date, raw) == want


def test_fonts_and_markers(spark):
    assert one(spark, text.font_family, "/ABCDEF+Sans") == "Sans" and one(spark, text.font_family, "ABCDEF+") == "ABCDEF+"
    assert one(spark, text.list_marker, "12) x") == "ordered" and one(spark, text.list_marker, "• x") == "bullet" and one(spark, text.list_marker, "1234. x") is None


# pages


def test_labels_follow_the_list_order(spark):
    df = spark.range(1, 31).toDF("page_no")
    got = [r.label for r in pages.labels(df, [(0, "r", "", 1), (4, "D", "", 5), (20, "a", "A-", 1)]).orderBy("page_no").collect()]
    assert got[:6] == ["i", "ii", "iii", "iv", "5", "6"] and got[20] == "A-a" and got[29] == "A-j"
    assert pages.labels(df, []).first().label == "1"


def test_booklet_of_five(spark):
    df = spark.range(1, 6).select(F.col("id").alias("page_no"), F.lit(5).alias("n"))
    got = {r.page_no: (r.side, r.half) for r in df.select("page_no", *(c.alias(k) for k, c in pages.booklet(F.col("page_no"), F.col("n")).items())).collect()}
    assert got == {1: (0, "right"), 2: (1, "left"), 3: (2, "right"), 4: (3, "left"), 5: (3, "right")}


def test_page_sets(spark):
    df = spark.range(1, 5).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page_no"))
    assert [r.page_no for r in pages.extract(df, [(2, 3), (1, 2)]).orderBy("new_no").collect()] == [2, 3, 1, 2]
    assert [r.page_no for r in pages.reorder(df, [3, 3, 1]).orderBy("new_no").collect()] == [3, 3, 1]
    assert [(r.page_no, r.new_no) for r in pages.delete(df, [2, 2], ["doc"]).orderBy("new_no").collect()] == [(1, 1), (3, 2), (4, 3)]
    with pytest.raises(ValueError):
        pages.extract(df, [(3, 2)])


# rows and layout


def test_nearest_ties(spark):
    df, marks = spark.createDataFrame([(2.0,), (9.0,)], "x double"), spark.createDataFrame([(1.0,), (3.0,)], "m double")
    assert [r.nearest for r in rows.nearest(df, "x", marks, "m", 1.5).orderBy("x").collect()] == [1.0, None]
    assert [r.nearest for r in rows.nearest(df, "x", marks, "m", 1.5, last=True).orderBy("x").collect()] == [3.0, None]


def frags(spark, items):
    return spark.createDataFrame([(1, k, *i, "F", t, 0.0) for k, (*i, t) in enumerate(items)], "page int, seq int, x double, y double, end_x double, size double, font string, text string, rotation double")


@pytest.mark.parametrize("second, want", [((150.0, 100.0, 190.0, 12.0, "World"), "Hello World"), ((140.0, 100.0, 160.0, 12.0, "World"), "HelloWorld"), ((142.0, 100.0, 160.0, 12.0, "World"), "HelloWorld"), ((142.5, 100.0, 160.0, 12.0, "World"), "Hello World")])
def test_spaces(spark, second, want):
    lined = layout.assemble(layout.with_lines(frags(spark, [(100.0, 100.0, 140.0, 12.0, "Hello"), second]), ["page"]), ["page"])
    assert lined.first().text == want


def test_reading_and_drawing_order(spark):
    df = frags(spark, [(50.0, 100.0, 90.0, 12.0, "SECOND"), (50.0, 200.0, 90.0, 12.0, "FIRST")])
    assert layout.page_text(layout.assemble(layout.with_lines(df, ["page"]), ["page"]), ["page"]).first().text == "FIRST\n\nSECOND"
    assert layout.raw_text(df, ["page"]).first().text == "SECOND\nFIRST"


def test_scripts_and_baseline(spark):
    line = layout.assemble(layout.with_lines(frags(spark, [(10.0, 100.0, 20.0, 12.0, "x"), (20.0, 103.0, 24.0, 7.0, "2")]), ["page"]), ["page"]).collect()
    by_text = {f.text: f.script for r in line for f in r.fragments}
    assert len(line) == 1 and line[0].y == 100.0 and by_text == {"x": None, "2": "super"}


def test_two_columns(spark):
    items = [(x, 700.0 - 14 * k, x + 200, 10.0, f"{c}{k}") for k in range(8) for x, c in ((50.0, "a"), (330.0, "b"))]
    got = layout.page_paragraphs(frags(spark, items), ["page"], F.lit(600.0)).orderBy("col_no", "par_no").collect()
    assert [r.text for r in got] == [" ".join(f"{c}{k}" for k in range(8)) for c in "ab"]


# tables


def grid(n_rows, n_cols, skip=()):
    h = [(700 - 20 * r, 50, 50 + 100 * n_cols) for r in range(n_rows + 1)]
    v = [(50 + 100 * c, 700 - 20 * n_rows, 700) for c in range(n_cols + 1)]
    texts = [(55 + 100 * c, 685 - 20 * r, 75 + 100 * c, 10, "F", f"r{r}c{c}") for r in range(n_rows) for c in range(n_cols) if (r, c) not in skip]
    return texts, h, v


def test_ruled_table():
    found = tables.page_tables(*grid(3, 3))
    assert len(found) == 1 and found[0]["kind"] == "lattice"
    assert found[0]["cells"] == [(r, c, 1, 1, f"r{r}c{c}") for r in range(3) for c in range(3)]


def test_spanning_cell():
    texts, h, v = grid(2, 2, skip={(0, 1)})
    v[1] = (150, 660, 680)  # the rule between the first row's cells is missing
    cells = tables.page_tables(texts, h, v)[0]["cells"]
    assert (0, 0, 1, 2, "r0c0") in cells and len(cells) == 3


def borderless(rows_of, xs=(60, 200, 300)):
    return [(x, 700 - 16 * k, x + 6 * len(t), 10, "F", t) for k, row in enumerate(rows_of) for x, t in zip(xs, row)]


def test_borderless_table():
    found = tables.page_tables(borderless([("Name", "Qty", "Price"), *((f"item {k}", str(k * 3), f"{k}.50") for k in range(4))]), [], [])
    assert [t["kind"] for t in found] == ["stream"] and len(found[0]["cells"]) == 15


@pytest.mark.parametrize(
    "rows_of",
    [
        [(f"This is a line of plain prose number {k} that goes on",) for k in range(6)],
        [(f"Chapter about something long {k} ...........", str(10 + k)) for k in range(6)],
        [(f"{k}.", f"entry number {k}") for k in range(1, 7)],
        [(str(k), f"value {k}") for k in range(1, 7)],
        [("many words stand in this cell", "and many words stand in that one") for _ in range(5)],
    ],
)
def test_what_is_no_table(rows_of):
    assert tables.page_tables(borderless(rows_of, (60, 330)), [], []) == []


def test_rules_are_joined(spark):
    lines = spark.createDataFrame([(1, 0.0, 100.0, 50.0, 100.0), (1, 52.0, 101.0, 90.0, 101.0), (1, 0.0, 300.0, 5.0, 300.0), (1, 10.0, 0.0, 10.0, 80.0), (1, 0.0, 0.0, 50.0, 50.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r)[1:] for r in tables.normalise_rules(lines, ["page"]).collect())
    assert got == [(False, pytest.approx((100 * 50 + 101 * 38) / 88), 0.0, 90.0), (True, 10.0, 0.0, 80.0)]


def test_stitching(spark):
    def cells(page, signature, rows_of):
        return [("d", page, 1, signature, r, c, t) for r, row in enumerate(rows_of) for c, t in enumerate(row)]

    data = cells(1, "0;9", [("h", "i"), ("1", "2")]) + cells(2, "0;9", [("h", "i"), ("3", "4")]) + cells(3, "0;8", [("x", "y")]) + cells(5, "0;8", [("z", "w")])
    got = tables.stitched(spark.createDataFrame(data, "doc string, page int, table_no int, signature string, row int, col int, text string"), "doc", "page")
    assert sorted((r.sheet_no, r.sheet_row, r.text) for r in got.where("col = 0").collect()) == [(1, 0, "h"), (1, 1, "1"), (1, 2, "3"), (2, 0, "x"), (3, 0, "z")]


# graphs


def test_cycles_and_islands(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (9, 9)], "src long, dst long")
    assert {(r.node, r.depth) for r in graph.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 9)}


def test_long_chain(spark):
    edges = spark.range(60).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.component for r in graph.components(edges).collect()} == {0}


def least_of_components(pairs):
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {(n, find(n)) for n in root}


@pytest.mark.parametrize("sent", [0, 500_000])
def test_components_of_odd_graphs(spark, monkeypatch, sent):
    monkeypatch.setattr(graph, "SENT", sent, raising=False)
    r = random.Random(5)
    ids = r.sample(range(-500, 500), 400)
    pairs = [*zip(ids[:80], ids[1:80], strict=False), *((ids[80], k) for k in ids[81:120]), *((r.choice(ids[120:300]), r.choice(ids[120:300])) for _ in range(150)), (ids[300], ids[300]), (ids[0], ids[0]), (ids[5], ids[4])]
    got = graph.components(spark.createDataFrame([*pairs, (None, 7000), (7001, None), (None, None)], "src long, dst long")).collect()
    assert {(x.node, x.component) for x in got} == least_of_components(pairs) and len(got) == len({x.node for x in got})
    words = [(f"n{a}", f"n{b}") for a, b in pairs]
    assert {(x.node, x.component) for x in graph.components(spark.createDataFrame(words, "src string, dst string")).collect()} == least_of_components(words)
    assert graph.components(spark.createDataFrame([], "src long, dst long")).collect() == []
    assert [tuple(x) for x in graph.components(spark.createDataFrame([(4, 4)], "src long, dst long")).collect()] == [(4, 4)]


def test_components_shuffle_what_is_left_of_the_edges(spark):
    """Rounds that follow all edges, each in both directions, shuffle 11 rows an edge here."""
    sc = spark.sparkContext
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda found: [found.apply(k) for k in range(found.size())])(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))}
    n = 40_000
    edges = spark.range(n).selectExpr("xxhash64(id) % 10000 AS src", "100000 + abs(xxhash64(id, 1)) % 1500 AS dst")
    before = set(stages())
    assert graph.components(edges).select("component").distinct().count() < 100
    assert sum(v for k, v in stages().items() if k not in before) < 4 * n


def test_outline(spark):
    tree = spark.createDataFrame([(1, None, 1, "A"), (2, 1, 2, "C"), (3, 1, 1, "B"), (4, None, 2, "D"), (5, 6, 1, "loop"), (6, 5, 1, "loop")], "id long, parent long, seq int, title string")
    assert [(r.path, r.level) for r in graph.outline(tree).orderBy("place").collect()] == [("A", 1), ("A / B", 2), ("A / C", 2), ("D", 1)]


# forms


def test_xfdf_and_fdf():
    pairs = [("a.b", "1"), ("a.c", "x\ny"), ("d", "<&>(é)")]
    assert sorted(forms.parse_xfdf(forms.export_xfdf(pairs))) == pairs
    assert sorted(forms.parse_fdf(forms.export_fdf([("a", "1"), ("b.c", "(x) \\")]))) == [("a", "1"), ("b.c", "(x) \\")]
    twice = '<xfdf xmlns="u"><fields><field name="p"><field name="q"><value>1</value><value>2</value></field></field><field name="p"><field name="q"><value>3</value></field></field></fields></xfdf>'
    assert forms.parse_xfdf(twice) == [("p.q", "3")]


def test_form_tables(spark):
    fields = spark.createDataFrame([("d", "b", "text", "2", 1), ("d", "a", "text", "1", 2), ("d", "b", "text", "3", 3), ("d", "e", "text", "", 4)], "doc string, name string, type string, value string, seq int")
    made = forms.export_json(fields, ["doc"])
    assert made.first().form == '{"a":{"type":"text","value":"1"},"b":{"type":"text","value":"3"},"e":{"type":"text","value":""}}'
    assert '"e"' not in forms.export_json(fields, ["doc"], omit_empty=True).first().form
    back = forms.import_json(made, ["doc"], "form")
    assert {(r.name, r.value) for r in back.collect()} == {("a", "1"), ("b", "3"), ("e", "")}
    assert {r.value for r in forms.apply_values(fields.where("name = 'b'"), back, ["doc"]).collect()} == {"3"}
    nodes = spark.createDataFrame([(1, None, 1, "top", "Tx", 2, None), (2, 1, 1, "x", None, None, "v"), (3, 2, 1, None, None, None, None), (4, 1, 2, "y", "Btn", None, "w")], "id long, parent long, seq int, partial string, type string, flags long, value string")
    assert {(r.name, r.type, r.flags, r.value) for r in forms.leaf_fields(nodes).collect()} == {("top.x", "Tx", 2, "v"), ("top.y", "Btn", 2, "w")}
    texts = spark.createDataFrame([(1, forms.export_xfdf([("n", "v")])), (2, "<broken"), (3, None)], "id long, x string")
    assert [tuple(r) for r in forms.imported(texts, ["id"], "x").collect()] == [(1, "n", "v")]


# models


def test_packing(spark):
    df = spark.createDataFrame([("d", k, n) for k, n in enumerate([5, 5, 11, 1, 9, 1])], "doc string, seq long, n int")
    assert [r.chunk_no for r in models.pack(df, ["doc"], "seq", "n", 10).orderBy("seq").collect()] == [1, 1, 2, 3, 3, 4]


def test_calls(spark):
    def client():
        calls = []

        def ask(prompt):
            calls.append(prompt)
            if len(calls) == 1:
                raise ConnectionError
            return f"  <{len(prompt)}>  "

        return models.with_retry(ask, wait=0)

    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, None)], "id long, q string")
    assert {r.id: r.answer for r in models.complete(df, F.col("q"), client).collect()} == {1: "<3>", 2: None, 3: None}
    texts = spark.createDataFrame([("d", 1, "aaaa"), ("d", 2, "bbbb"), ("e", 1, "cc"), ("e", 2, "  ")], "doc string, seq long, text string")
    got = {r.doc: r for r in models.summarise(texts, ["doc"], "seq", "text", client, 5).collect()}
    assert got["d"].n_chunks == 2 and got["e"].n_chunks == 1 and got["d"].summary.startswith("<")
    with pytest.raises(TimeoutError):
        models.with_retry(lambda p: (_ for _ in ()).throw(TimeoutError()), 2, 0)("x")


# flow and edits


def test_furniture(spark):
    paras = spark.createDataFrame([("d", p, 10.0, 20.0, f"Page {p} of 9") for p in range(1, 5)] + [("d", p, 400.0, 420.0, f"Body {p}") for p in range(1, 5)], "doc string, page int, lly double, ury double, text string")
    found = flow.furniture(paras, "doc", "page", F.lit(800.0))
    assert [(r.key, r.n) for r in found.collect()] == [("Page # of #", 4)]
    assert flow.without_furniture(paras, found, "doc", F.lit(800.0)).count() == 4


def test_flow_blocks(spark):
    paras = spark.createDataFrame([("d", 1, 20.0, 10.0, "Title"), ("d", 2, 10.0, 10.0, "- a_b"), ("d", 3, 10.0, 10.0, "- c"), ("d", 4, 10.0, 10.0, "text <x>")], "doc string, o int, size double, body double, text string")
    made = flow.blocks(paras, "doc")
    assert flow.to_markdown(made, "doc", "o").first().markdown == "# Title\n\n- a\\_b\n- c\n\ntext \\<x\\>\n"
    assert flow.to_html(made, "doc", "o").first().html == "<h1>Title</h1>\n<ul>\n<li>a_b</li>\n<li>c</li>\n</ul>\n<p>text &lt;x&gt;</p>\n"


def test_redaction_and_merge(spark):
    f = frags(spark, [(10.0, 100.0, 20.0, 10.0, "keep"), (50.0, 100.0, 60.0, 10.0, "secret")])
    regions = spark.createDataFrame([(1, 40.0, 90.0, 70.0, 120.0)], "page int, llx double, lly double, urx double, ury double")
    assert [r.text for r in edits.redact(f, regions, ["page"]).collect()] == ["keep"]
    changed = edits.merge(f, spark.createDataFrame([(0, "new"), (9, "x")], "seq int, text string"), ["seq"])
    assert {r.text for r in changed.collect()} == {"new", "secret"}
    assert edits.insert(f, spark.createDataFrame([(1, 5)], "page int, seq int")).count() == 3


def test_http_client():
    import io
    import json
    import urllib.error

    asked = []

    def opener(request, timeout):
        asked.append((request.full_url, json.loads(request.data), request.headers))
        if len(asked) < 3:
            raise urllib.error.HTTPError(request.full_url, (429, 503)[len(asked) - 1], "", {}, None)
        return io.BytesIO(b'{"choices": [{"message": {"content": "hi"}}]}')

    ask = models.with_retry(models.HttpClient("http://h/v1/", "m", "k", "be kind", opener=opener), wait=0)
    assert ask("hello") == "hi" and len(asked) == 3
    assert asked[0][0] == "http://h/v1/chat/completions" and [m["role"] for m in asked[0][1]["messages"]] == ["system", "user"]
    with pytest.raises(ValueError):
        models.HttpClient("http://h", "")


def test_recognition(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, None)], "id int, image binary")
    assert {r.id: r.text for r in models.recognise(df, "image", lambda: lambda i: str(len(i))).collect()} == {1: "3", 2: None}


def test_markdown_in_sql(spark):
    from foliospark.functions import markdown

    markdown.register(spark)
    got = spark.sql("SELECT seq, kind, level FROM md_blocks('# a\n\nb')").collect()
    assert [tuple(r) for r in got] == [(0, "heading", 1), (1, "paragraph", 0)]


def test_asof_rate_of_many_types(spark, tmp_path):
    from foliospark.plans import catalogue

    spark.range(1500).selectExpr("id AS event_id", "concat('t', id) AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    assert [r.rate for r in catalogue.asof_rate(spark, str(tmp_path)).collect()] == [1.0] * 1500


def test_search_of_line_ends(spark):
    df = spark.createDataFrame([(1, "first\nfoo bar"), (2, "foo x\nend"), (3, "x\r\nfoo"), (4, None), (5, "")], "doc_id int, text string")
    found = lambda pattern: [(r.doc_id, r.line_no, r.match) for r in text.search(df, pattern, regex=True).orderBy("doc_id", "line_no").collect()]
    assert found("^foo") == [(1, 2, "foo"), (2, 1, "foo"), (3, 2, "foo")]
    assert found("x$") == [(2, 1, "x")]  # a line ends at its line feed; what stands before it belongs to the line
    assert found(r"\Afoo") == found("^foo") and found(r"bar\z") == [(1, 2, "bar")] and found("q*") == []


def test_components_and_closure_against_brute_force(spark):
    from foliospark.plans import catalogue

    sf = "/root/testdata/sf0.001"
    pairs = [(r.l_orderkey, 100_000_000 + r.l_partkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {(r.node, r.component) for r in catalogue.QUERIES["components"](spark, sf).collect()} == {(n, find(n)) for n in root}


def test_conversations_are_cut(spark):
    df = spark.createDataFrame([(1, 0, "user", "a" * 30_000), (1, 1, "assistant", "b" * 30_000), (2, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    a, b = models.conversation(df, ["conv_id"], "turn", "role", "text").orderBy("conv_id").collect()
    assert len(a.history) == 48_000 and a.truncated and a.history.startswith("user: aaa") and (b.history, b.truncated) == ("user: hi", False)


@pytest.mark.parametrize("buckets", [1, 5, 256])
def test_as_of_in_ranges(spark, buckets):
    r = random.Random(3)
    here = [(i, r.choice(["a", "b", None]), r.choice([None, *range(100)])) for i in range(500)]
    there = [(r.choice(["a", "b", None]), r.randrange(100), r.random()) for _ in range(60)] + [("c", 1, 1.0)]
    df, table = spark.createDataFrame(here, "id int, g string, at int"), spark.createDataFrame(there, "g string, k int, v double")
    got = {x.id: x.v for x in rows.as_of(df, "at", table, "k", ["v"], ["g"], buckets).collect()}
    assert got == {i: max(((k, v) for h, k, v in there if h == g and at is not None and k <= at), default=(0, None))[1] for i, g, at in here}
    got = {x.id: x.v for x in rows.as_of(df.drop("g"), "at", table, "k", ["v"], None, buckets).collect()}
    assert got == {i: max(((k, v) for _, k, v in there if at is not None and k <= at), default=(0, None))[1] for i, _, at in here}


def test_outlines_of_many_documents(spark):
    nodes = [(d, 1, None, 5, f"A{d}") for d in "xy"] + [(d, 2 + k, 1, seq, f"B{seq}") for d in "xy" for k, seq in enumerate((1_000_001, 1_000_002, 100_000))] + [("x", 9, 9, 1, "loop")]
    tree = spark.createDataFrame(nodes, "doc string, id int, parent int, seq int, title string")
    got = [(r.doc, r.path) for r in graph.outline(tree, by=["doc"]).orderBy("doc", "place").collect()]
    assert got == [(d, p) for d in "xy" for p in (f"A{d}", f"A{d} / B100000", f"A{d} / B1000001", f"A{d} / B1000002")]


def test_fields_of_many_documents(spark):
    nodes = spark.createDataFrame([(d, *r) for d in ("x", "y") for r in ((1, None, 1, "top", "Tx", 2, None), (2, 1, 1, "a", None, None, f"of {d}"), (3, 2, 1, None, None, None, None))], "doc string, id int, parent int, seq int, partial string, type string, flags int, value string")
    assert {tuple(r) for r in forms.leaf_fields(nodes, ["doc"]).collect()} == {("x", 2, "top.a", "Tx", 2, "of x"), ("y", 2, "top.a", "Tx", 2, "of y")}


def test_packing_keeps_groups_without_a_key(spark):
    df = spark.createDataFrame([(None, 1, 6), (None, 2, 6), ("a", 1, 20), ("a", 2, 1), ("a", 3, None)], "doc string, seq int, n int")
    assert {(r.doc, r.seq, r.chunk_no) for r in models.pack(df, ["doc"], "seq", "n", 10).collect()} == {(None, 1, 1), (None, 2, 2), ("a", 1, 1), ("a", 2, 2), ("a", 3, 2)}


def test_a_document_keeps_a_page(spark):
    from foliospark.operators import pages

    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)], "doc string, page_no int")
    assert {(r["doc"], r["page_no"], r["new_no"]) for r in pages.delete(df, [1, 1], ["doc"], keep_one=True).collect()} == {("a", 2, 1), ("a", 3, 2), ("b", 2, 1)}
    for wrong in ([1, 2], [3]):  # b would lose both, or has no third
        with pytest.raises(Exception, match="keep a page|no such page"):
            pages.delete(df, wrong, ["doc"], keep_one=True).collect()


def test_rectangles_cluster_as_by_pairs(spark):
    import random

    from foliospark.operators import rows

    rng = random.Random(5)
    boxes = {p: [(x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for x, y in ((rng.randint(0, 90), rng.randint(0, 90)) for _ in range(40))] for p in range(4)}

    def merged(found, gap):
        found = [(*b, 1) for b in found]
        while True:
            pair = next(((i, j) for i in range(len(found)) for j in range(i + 1, len(found)) if all(found[i][k] - gap <= found[j][k + 2] and found[j][k] - gap <= found[i][k + 2] for k in (0, 1))), None)
            if pair is None:
                return sorted(found)
            b, a = found.pop(pair[1]), found.pop(pair[0])
            found.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]))

    df = spark.createDataFrame([(p, *map(float, b)) for p, found in boxes.items() for b in found], "page int, llx double, lly double, urx double, ury double")
    got = rows.cluster_rects(df, ["page"], 1.0).collect()
    for p, found in boxes.items():
        assert sorted(tuple(r)[1:] for r in got if r["page"] == p) == merged(found, 1.0)


def test_typed_forms_come_back(spark):
    from foliospark.operators import forms

    df = spark.createDataFrame([("d", "a\"b", "listbox", "x\ny", 1), ("d", "c", "checkbox", "Off", 2), ("d", "c", "checkbox", "On", 3), ("d", "e", "text", None, 4), ("d", "p", "push_button", "z", 5)], "doc string, name string, kind string, value string, seq int")
    form = forms.export_typed_json(df, ["doc"])
    assert form.first()["form"] == '{"a\\"b":{"type":"listbox","value":["x","y"]},"c":{"type":"checkbox","value":true},"e":{"type":"text","value":""}}'
    assert {(r["name"], r["value"]) for r in forms.import_json(form, ["doc"], "form").collect()} == {('a"b', "x\ny"), ("c", "true"), ("e", "")}
    assert forms.export_typed_json(df, ["doc"], omit_empty=True).first()["form"].count("type") == 2


def test_segments_without_fragments(spark):
    from foliospark.operators import flow

    kind = "par int, line_no int, y double, text string, fragments array<struct<text:string,x:double,size:double,font:string>>"
    df = spark.createDataFrame([(1, 1, 50.0, "a", []), (1, 2, 40.0, "1. b", [("1. b", 9.0, 12.0, "F")]), (1, 3, 30.0, "c", [("c", 5.0, 12.0, None)])], kind)
    got = [(r["seg_no"], r["text"], r["size"], r["marker"], r["indent"]) for r in flow.segments(df, ["par"]).orderBy("seg_no").collect()]
    assert got == [(1, "a", 12.0, None, 0.0), (2, "1. b c", 12.0, "ordered", 9.0)]
