"""What must not grow with the input: broadcasts, rows that are shuffled, groups of one task, batches."""

from pathlib import Path

from pyspark.sql import functions as F

from foliospark.operators import spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rectangles_of_many_rows_are_not_broadcast(spark):
    """Both sides look small to the planner: a row becomes several only in its cells."""
    box = lambda n, end: spark.range(n).selectExpr("id AS page", f"cast(id % 7 as double) AS llx{end}", f"0D AS lly{end}", f"cast(id % 7 + 3 as double) AS urx{end}", f"2D AS ury{end}")
    both = spatial.meets(box(60_000, ""), box(60_000, "_r"), spatial.BOX, tuple(f"{c}_r" for c in spatial.BOX), ["page"])
    assert "Broadcast" not in plan(both) and both.count() == 60_000
    assert "Broadcast" in plan(spatial.meets(box(60_000, ""), box(3, "_r"), spatial.BOX, tuple(f"{c}_r" for c in spatial.BOX), ["page"]))


def test_thin_and_small_rectangles_are_tried_by_their_place(spark):
    """What is tried stays near what meets, though widths run from a point to a fifth of the plane."""
    a = spark.range(2000).selectExpr("id", "cast(id * 7919 % 10000 as double) AS llx", "cast(id * 104729 % 10000 as double) AS lly", "cast(id * 7919 % 10000 + id % 40 as double) AS urx", "cast(id * 104729 % 10000 + id % 30 as double) AS ury")
    b = spark.range(2000).selectExpr("id AS k", "cast(id * 6151 % 10000 as double) AS x0", "cast(id * 3079 % 10000 as double) AS y0", "cast(id * 6151 % 10000 + id % 50 * (id % 50) as double) AS x1", "cast(id * 3079 % 10000 + id % 50 as double) AS y1")
    both = spatial.meets(a, b, spatial.BOX, ("x0", "y0", "x1", "y1"))
    want = a.crossJoin(b).where("llx < x1 AND urx > x0 AND lly < y1 AND ury > y0")
    assert sorted((r.id, r.k) for r in both.collect()) == sorted((r.id, r.k) for r in want.collect())
    rows = [{0: None, "count": 5}, {0: 2, "count": 3}, {0: 6, "count": 4}]
    assert spatial._middle(rows, 0) == 6 and spatial._middle(rows[:1], 0) == 0


def _stacked(spark, n):
    """``n`` cells and ``n`` covers in a few places each."""
    place = lambda w: ["cast(id % 3 as double) AS llx", "0D AS lly", f"cast(id % 3 + {w} as double) AS urx", f"{w}D AS ury"]
    return spark.range(n).selectExpr("id", *place(4)), spark.range(n).selectExpr("id AS nth", "concat('l', id % 2) AS label", *place(2))


def test_shares_of_equal_rectangles_are_worked_out_once(spark, monkeypatch):
    """Pairs of equal rectangles grow with the square of their number; rows that share their keys are added up."""
    rows, meets = [], spatial.meets
    monkeypatch.setattr(spatial, "meets", lambda left, right, *a, **b: [rows.append((left.count(), right.count())), meets(left, right, *a, **b)][1])
    cells, covers = _stacked(spark, 6000)
    got = {(r.id, r.label): (r.area, r.share) for r in spatial.area_shares(cells, ["id"], covers, "label").collect()}
    wide = lambda a, b: 2 * max(0, min(a + 4, b + 2) - max(a, b))
    want = {(k, f"l{m}"): sum(1000 * wide(k % 3, b) for b in range(3)) for k in range(6000) for m in range(2)}
    assert got == {k: (area, area / 16) for k, area in want.items()}
    assert max(map(max, rows), default=0) <= 6
    twice = spatial.area_shares(cells.limit(0).unionByName(cells.where("id < 6")).withColumn("id", F.expr("id % 3")), ["id"], covers, "label")
    assert {(r.id, r.label): r.share for r in twice.collect()} == {(k, m): 2 * want[k, m] / 16 for k in range(3) for m in ("l0", "l1")}


def test_pairs_of_equal_rectangles_are_rows_in_the_result_alone(spark, monkeypatch):
    """Each place meets each place once, whatever the keys there, null ones included; lists of keys are cut."""
    rows, meets = [], spatial.meets
    monkeypatch.setattr(spatial, "meets", lambda left, right, *a, **b: [rows.append((left.count(), right.count())), meets(left, right, *a, **b)][1])
    monkeypatch.setattr(spatial, "LISTED", 7, raising=False)
    cells, covers = _stacked(spark, 90)
    cells, covers = cells.withColumn("id", F.when(F.col("id") != 5, F.col("id"))), covers.withColumnsRenamed({c: f"r_{c}" for c in spatial.BOX})
    other = tuple(f"r_{c}" for c in spatial.BOX)
    got = spatial.meeting_keys(cells, "id", covers, "nth", spatial.BOX, other)
    want = cells.crossJoin(covers).where("llx < r_urx AND urx > r_llx").select("id", "nth", spatial.common_area(spatial.BOX, other).alias("area"))
    assert got.columns == want.columns and got.count() == want.count() == 7200 and got.exceptAll(want).isEmpty()
    assert rows == [(15, 15)]


def test_wide_rectangles_come_to_small_cells_where_that_makes_fewer_rows(spark):
    """Many small rectangles come to one cell size each, not to one for each width of the few others, unless these are very wide."""
    class Shape(tuple):
        def __getitem__(self, key):
            return tuple.__getitem__(self, 2 if key == "count" else key)

    small, wide = [Shape((4, 4, 9_000_000))], [Shape((x, y, 1000)) for x in (10, 12) for y in (8, 10)]
    assert spatial._widest(small, wide, [10, 8], 2) == [10, 8]
    assert spatial._widest([Shape((4, 4, 10))], [Shape((4, 4, 10)), Shape((30, 30, 1))], [4, 4], 2) == [30, 30]
    assert spatial._widest([], [], [0, 0], 2) == [0, 0]


def test_cells_that_the_least_colour_covers_are_not_held_against_all_fills(spark, monkeypatch):
    """Shades as a plain loop finds them, with few cells tried; rows that share a key have one shade, those without a key none."""
    import random

    tried, meets = [], spatial.meets
    monkeypatch.setattr(spatial, "meets", lambda left, right, *a, **b: [tried.append((left.count(), right.count())), meets(left, right, *a, **b)][1])
    r = random.Random(4)
    at = lambda n, wide: [(k, *(v := [float(r.randint(0, 200)) for _ in range(2)]), v[0] + r.randint(1, wide), v[1] + r.randint(1, wide)) for k in range(n)]
    cells = [(k % 350 if k % 50 else None, *c) for k, *c in at(400, 12)] * 5
    fills = [(*f, c / 10, 0.5, 0.25) for k, *f in at(250, 120) for c in [k % 5]] * 4 + [(0.0, 0.0, 900.0, 900.0, 0.98, 0.99, 1.0)]
    best = {}
    for k, x0, y0, x1, y1 in cells:
        for a, b, c, d, red, green, _ in fills:
            w, h = min(x1, c) - max(x0, a), min(y1, d) - max(y0, b)
            if k is not None and w > 0 and h > 0 and w * h >= 0.6 * (x1 - x0) * (y1 - y0) and green < 0.97:
                best[k] = min(best.get(k, (0, 0)), (-w * h, red))
    names = "llx double, lly double, urx double, ury double"
    got = spatial.shades(spark.createDataFrame(cells, f"id long, {names}"), ["id"], spark.createDataFrame(fills, f"{names}, r double, g double, b double")).collect()
    assert len(got) == len(cells) and all((x.shade and x.shade.r) == (best[x.id][1] if x.id in best else None) for x in got)
    assert len(tried) == 1 and tried[0][0] < 200 and tried[0][1] <= 250


def test_partitions_grow_with_rows_and_stay_on_all_cores(spark):
    from foliospark.operators import rows

    cores = spark.sparkContext.defaultParallelism
    assert rows.dealt(spark.range(1000), ["id"], 10).rdd.getNumPartitions() == 100
    assert rows.dealt(spark.range(3), ["id"], 10).rdd.getNumPartitions() == cores


def test_many_partitions_are_written_in_two_steps(spark):
    """A shuffle into more than 200 partitions holds what a task reads: a first one into 200 leaves each task its share."""
    from foliospark.operators import rows

    few, many = (rows.dealt(spark.range(n).withColumn("v", F.col("id") * 2), ["id"], 10) for n in (2000, 2010))
    assert plan(few).count("Exchange hashpartitioning") == 1 and plan(many).count("Exchange hashpartitioning") == 2
    assert many.columns == ["id", "v"] and many.rdd.getNumPartitions() == 201 and many.where("v = 2 * id").count() == 2010


def test_files_and_texts_are_on_all_cores_and_in_small_batches(spark):
    from foliospark.plans import catalogue
    from foliospark.sources import scan

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for name in ("pdf_field_kinds", "pdf_fields", "pdf_text", "pdf_issues", "markdown_blocks", "layout_text", "match_boxes"):
        assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")), name
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == scan.HANDED


def test_outlines_of_files_are_read_once(spark):
    """Levels below the first come from a checkpoint, not from the files again."""
    from foliospark.plans import catalogue

    assert "MapInArrow" not in plan(catalogue.QUERIES["pdf_outlines"](spark, "/root/testdata/sf0.001"))


def test_strings_with_and_without_escapes():
    from foliospark.sources.pdf import Lexer

    for raw, want in ((b"(plain)x", b"plain"), (b"(a(b)c\\051\\n\\\r\nd\\0501)", b"a(b)c)\nd(1"), (b"(open", b"open"), (b"(a\\", b"a"), (b"()", b"")):
        assert Lexer(raw).next() == want


def test_columns_shuffle_once_and_make_no_row_of_a_bin(spark):
    from foliospark.plans import catalogue

    text = plan(catalogue.QUERIES["layout_columns"](spark, "/root/testdata/sf0.001"))
    assert text.count("Exchange") == 1 and "sequence(" not in text


def test_loops_follow_what_roots_share_once(spark, monkeypatch):
    """A thousand pages that name one object: the rounds hold that object's pairs, not the pages'."""
    from foliospark.operators import graph

    pages = spark.range(1000).selectExpr("id AS node")
    edges = pages.selectExpr("node AS src", "5000L AS dst").unionByName(spark.range(5).selectExpr("5000 + id AS src", "5001 + id AS dst"))
    rows, kept = [], graph._checkpoint

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "_checkpoint", counted)
    got = graph.dependencies(edges, pages, barred=pages)
    assert got.count() == 7000 and got.where("node = 5005").first().depth == 6
    assert max(rows) <= 1005 and sorted(rows)[-2] <= 6
    rows.clear()
    owned = graph.ownership(edges, pages.selectExpr("node", "node AS owner", "0 AS users"), barred=pages)
    assert owned.count() == 1006 and sorted(rows)[-2] <= 6


def test_edges_of_barred_roots_are_kept_once_and_as_columns(spark, monkeypatch):
    """A thousand pages, each with three edges of its own: the rounds keep the few edges behind them, not the pages'."""
    from foliospark.operators import graph

    pages = spark.range(1000).selectExpr("id AS node")
    edges = pages.selectExpr("node AS src", "explode(array(5000L, 5001L, (node + 1) % 1000, 5000L)) AS dst").unionByName(spark.range(5).selectExpr("5000 + id AS src", "5001 + id AS dst")).unionByName(spark.range(9000, 9050).selectExpr("id AS src", "id + 1 AS dst"))
    kept, written, checkpoint, write = [], [], graph._checkpoint, graph._written
    monkeypatch.setattr(graph, "_checkpoint", lambda df: [out := checkpoint(df), kept.append(out.count())][0])
    monkeypatch.setattr(graph, "_written", lambda df: [out := write(df), written.append(out.count())][0])
    got = graph.dependencies(edges, pages, barred=pages)
    assert got.count() == 7000 and got.where("node = 5001").agg(F.max("depth")).first()[0] == 1
    assert kept[0] == 55 + 2 and max(kept) <= 60 and written == [4055]
    more = graph.dependencies(edges, pages.unionByName(spark.createDataFrame([(9000,)], "node long")), barred=pages)
    assert more.count() == 7051 and more.where("root = 9000").count() == 51


def test_rectangles_are_merged_without_a_frame_a_page(spark):
    from foliospark.operators import rows

    boxes = spark.range(40).selectExpr("id % 10 AS page", "cast(id as double) AS llx", "0D AS lly", "cast(id + 12 as double) AS urx", "1D AS ury")
    got = rows.cluster_rects(boxes, ["page"])
    assert "FlatMapGroupsInPandas" not in plan(got) and sorted((r.page, r.n) for r in got.collect()) == [(k, 4) for k in range(10)]


def test_lines_are_turned_where_they_are(spark):
    from foliospark.operators import bidi

    lines = spark.createDataFrame([(1, "abc (\u05d0\u05d1 12) x"), (2, "plain"), (3, None), (4, "\u05d0 \U0001f600 b")], "k int, t string")
    got = bidi.visual(lines, ["k"], "t")
    assert "Exchange" not in plan(got) and "Window" not in plan(got)
    assert [r.visual for r in got.orderBy("k").collect()] == ["abc (12 \u05d1\u05d0) x", "plain", None, "\U0001f600 b \u05d0"]


def test_outlines_order_siblings_alone(spark):
    """No window takes a whole document."""
    from foliospark.operators import graph

    nodes = spark.range(40).selectExpr("1 AS doc", "id", "CASE WHEN id > 0 THEN div(id - 1, 3) END AS parent", "id AS seq", "'t' AS title", "id % 4 <> 1 AS open")
    spans = graph.counted(nodes, ["doc"])
    kept = graph.without_subtrees(spans, spark.createDataFrame([(1, 2)], "doc int, id long"), ["doc"])
    assert "Window" not in plan(spans) and "Window" not in plan(kept)
    found = {r.id: r for r in spans.collect()}
    assert [k for k in sorted(found, key=lambda k: found[k].pre)][:6] == [0, 1, 4, 13, 14, 15] and found[0].last == 40
    assert {r.id for r in kept.collect()} == {k for k in range(40) if not found[2].pre <= found[k].pre <= found[2].last}


def test_regions_below_a_cover_are_not_tried(spark):
    """On one plane many regions lie above each other: a point meets few of them, and gets what the cross join finds."""
    from foliospark.operators import spatial as s

    points = spark.range(400).selectExpr("id", "cast(id * 37 % 200 as double) AS x", "cast(id * 91 % 200 as double) AS y")
    regions = spark.range(3000).selectExpr("id AS nth", "cast(id * 53 % 190 - 40 as double) AS llx", "cast(id * 29 % 190 - 40 as double) AS lly", "cast(id * 53 % 190 + 20 + id % 40 as double) AS urx", "cast(id * 29 % 190 + 20 + id % 30 as double) AS ury")
    got = s.first_containing(points, ["id"], "x", "y", regions, "nth", ["nth"])
    want = points.join(regions, F.expr("x BETWEEN llx AND urx AND y BETWEEN lly AND ury")).groupBy("id").agg(F.min("nth").alias("nth"))
    assert {r.id: r.nth for r in got.where("nth IS NOT NULL").collect()} == {r.id: r.nth for r in want.collect()} and got.count() == 400
    named = s._scaled(regions.withColumn("v_", F.struct("nth")), s.BOX)
    assert "until_" in plan(got) and s._cut(named, s.BOX, s._grid(named)).count() <= s.PIECES * 3000


def test_rectangles_inside_one_region_are_looked_up(spark):
    """Rectangles whose cells one region covers, of any number of cells, meet no region; results are those of the cross join."""
    from foliospark.operators import spatial as s

    boxes = spark.range(600).selectExpr("id", "cast(id * 37 % 200 as double) AS llx", "cast(id * 91 % 200 as double) AS lly", "cast(id * 37 % 200 + CASE WHEN id % 9 = 0 THEN 60 ELSE id % 5 END as double) AS urx", "cast(id * 91 % 200 + id % 7 as double) AS ury")
    regions = spark.range(300).selectExpr("cast(id * 53 % 190 - 40 as double) AS llx", "cast(id * 29 % 190 - 40 as double) AS lly", "cast(id * 53 % 190 + 20 + id % 40 as double) AS urx", "cast(id * 29 % 190 + 20 + id % 30 as double) AS ury")
    got = s.mostly_inside(boxes, ["id"], regions)
    other = regions.toDF("a", "b", "c", "d")
    want = boxes.join(other, F.expr("llx < c AND urx > a AND lly < d AND ury > b AND (least(urx, c) - greatest(llx, a)) * (least(ury, d) - greatest(lly, b)) >= 0.9 * (urx - llx) * (ury - lly)")).where("urx > llx AND ury > lly")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.select("id").distinct().collect()) and "sure_" in plan(got)


def test_files_are_read_with_few_steps(monkeypatch):
    """Rows of a cross-reference table that are as they should be aren't read token by token; others are, with the same result."""
    from foliospark.sources import pdf

    made = pdf.write([[(40, 700, 10, "a")]], objects=[b"<< /A#42 (x) % note\n /C 5 >>"] * 40)
    seen, step = [], pdf.Lexer.next
    monkeypatch.setattr(pdf.Lexer, "next", lambda self: seen.append(1) or step(self))
    doc = pdf.Document(made)
    assert doc.status == "ok" and len(seen) < 100 and doc.get(5) == {"AB": b"x", "C": 5}
    odd = pdf.Document(made.replace(b" 00000 n ", b"  0000 n "))
    assert odd.status == "ok" and odd.where == doc.where and odd.get(5) == doc.get(5)


def test_the_reader_of_files_is_pickled_whole():
    """Executors need no copy of the package: nothing in the module is named by it."""
    import subprocess
    import sys

    here = "import sys; sys.path.insert(0, %r); import __spark_entry__; from pyspark import cloudpickle; from foliospark.sources import pdf; sys.stdout.buffer.write(cloudpickle.dumps(lambda: pdf.write([[(40, 700, 10, 'a')]])))" % str(Path(__file__).parents[1])
    away = "import sys, pickle; print(len(pickle.load(sys.stdin.buffer)()))"
    sent = subprocess.run([sys.executable, "-c", here], capture_output=True, check=True, cwd="/").stdout
    assert int(subprocess.run([sys.executable, "-c", away], input=sent, capture_output=True, check=True, cwd="/").stdout) > 500
