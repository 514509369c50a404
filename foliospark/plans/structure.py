"""Queries over the given tables for operators on places, graphs, trees, references and flows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import bidi, edits, flow, graph, references, spatial
from foliospark.plans.registry import query, read

# --- ranges and rectangles


@query("""
WITH r AS (SELECT p_partkey % 3 AS font, p_partkey * 37 AS lo, p_partkey * 37 + p_size * 3 - 1 AS hi, p_partkey * 1000 AS base FROM part),
s AS (SELECT p_partkey % 3 AS font, p_partkey * 7 AS code, min(p_size) AS value FROM part WHERE p_size % 10 = 0 GROUP BY ALL),
c AS (SELECT DISTINCT l_linenumber % 3 AS font, l_orderkey AS code FROM lineitem),
m AS (SELECT c.font, c.code, arg_min(base + c.code - lo, (hi, -lo, base)) AS mapped FROM c JOIN r ON c.font = r.font AND c.code BETWEEN lo AND hi GROUP BY c.font, c.code)
SELECT l_orderkey AS code, CAST(l_linenumber % 3 AS BIGINT) AS font, CAST(coalesce(s.value, m.mapped, 0) AS BIGINT) AS cid
FROM lineitem l LEFT JOIN m ON m.font = l_linenumber % 3 AND m.code = l_orderkey LEFT JOIN s ON s.font = l_linenumber % 3 AND s.code = l_orderkey
""")
def range_lookup(spark, sf):
    """Codes of order lines in the ranges and single codes that parts make, by font."""
    parts = read(spark, sf, "part")
    ranges = parts.selectExpr("p_partkey % 3 AS font", "p_partkey * 37 AS lo", "p_partkey * 37 + p_size * 3 - 1 AS hi", "p_partkey * 1000 AS base")
    singles = parts.where("p_size % 10 = 0").selectExpr("p_partkey % 3 AS font", "p_partkey * 7 AS code", "p_size AS value")
    codes = read(spark, sf, "lineitem").selectExpr("l_orderkey AS code", "cast(l_linenumber % 3 as long) AS font")
    return spatial.lookup(codes, "code", ranges, "lo", "hi", "base", ["font"], singles, out="cid")


def _boxes(spark, sf):
    """Orders as boxes on a plane, some of them without a width, in sizes from a point to a tenth of it."""
    return read(spark, sf, "orders").selectExpr(
        "o_orderkey", "cast(o_orderkey * 7919 % 10000 as double) AS llx", "cast(o_custkey * 104729 % 10000 as double) AS lly",
        "cast(o_orderkey * 7919 % 10000 + case when o_orderkey % 50 = 0 then 1000 else o_custkey % 40 end as double) AS urx", "cast(o_custkey * 104729 % 10000 + o_orderkey % 30 as double) AS ury",
    )


def _regions(spark, sf):
    """Parts as regions on the same plane, from tiny to wide."""
    return read(spark, sf, "part").selectExpr(
        "p_partkey", "cast(p_partkey * 6151 % 10000 as double) AS r_llx", "cast(p_partkey * 3079 % 10000 as double) AS r_lly",
        "cast(p_partkey * 6151 % 10000 + p_size * p_size as double) AS r_urx", "cast(p_partkey * 3079 % 10000 + p_size * (p_partkey % 20) as double) AS r_ury", "p_brand",
    )


_REGION_BOX = ("r_llx", "r_lly", "r_urx", "r_ury")
_PLANE = """
WITH b AS (SELECT o_orderkey, (o_orderkey * 7919 % 10000)::DOUBLE AS llx, (o_custkey * 104729 % 10000)::DOUBLE AS lly, (o_orderkey * 7919 % 10000 + CASE WHEN o_orderkey % 50 = 0 THEN 1000 ELSE o_custkey % 40 END)::DOUBLE AS urx,
  (o_custkey * 104729 % 10000 + o_orderkey % 30)::DOUBLE AS ury FROM orders),
r AS (SELECT p_partkey, p_brand, (p_partkey * 6151 % 10000)::DOUBLE AS r_llx, (p_partkey * 3079 % 10000)::DOUBLE AS r_lly, (p_partkey * 6151 % 10000 + p_size * p_size)::DOUBLE AS r_urx, (p_partkey * 3079 % 10000 + p_size * (p_partkey % 20))::DOUBLE AS r_ury FROM part),
m AS (SELECT *, (least(urx, r_urx) - greatest(llx, r_llx)) * (least(ury, r_ury) - greatest(lly, r_lly)) AS area FROM b, r WHERE llx < r_urx AND urx > r_llx AND lly < r_ury AND ury > r_lly)
"""


@query(_PLANE + "SELECT o_orderkey, p_partkey, area FROM m")
def overlap_pairs(spark, sf):
    return spatial.meeting_keys(_boxes(spark, sf), "o_orderkey", _regions(spark, sf), "p_partkey", spatial.BOX, _REGION_BOX)


@query(_PLANE + """, f AS (SELECT o_orderkey, min(p_partkey) AS p_partkey FROM b, r WHERE llx BETWEEN r_llx AND r_urx AND lly BETWEEN r_lly AND r_ury GROUP BY o_orderkey)
SELECT o.o_orderkey, f.p_partkey, p_brand FROM orders o LEFT JOIN f ON o.o_orderkey = f.o_orderkey LEFT JOIN part p ON f.p_partkey = p.p_partkey""")
def first_region(spark, sf):
    """The first part whose region holds an order's corner, as a link's target is found."""
    points = _boxes(spark, sf).select("o_orderkey", F.col("llx").alias("x"), F.col("lly").alias("y"))
    return spatial.first_containing(points, ["o_orderkey"], "x", "y", _regions(spark, sf), "p_partkey", ["p_partkey", "p_brand"], box=_REGION_BOX).select("o_orderkey", "p_partkey", "p_brand")


@query(_PLANE + "SELECT o_orderkey, p_brand, sum(area) AS area, sum(area) / any_value((urx - llx) * (ury - lly)) AS share FROM m WHERE (urx - llx) * (ury - lly) > 0 GROUP BY o_orderkey, p_brand")
def area_shares(spark, sf):
    covers = _regions(spark, sf).withColumnsRenamed(dict(zip(_REGION_BOX, spatial.BOX)))
    return spatial.area_shares(_boxes(spark, sf), ["o_orderkey"], covers, "p_brand")


@query(_PLANE + """, k AS (SELECT *, (p_partkey % 10) / 10.0::DOUBLE AS r_, CASE WHEN p_partkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0.5 END AS g_, CASE WHEN p_partkey % 7 = 0 THEN 0.98::DOUBLE ELSE 0.25 END AS b_, CASE WHEN p_partkey % 7 = 0 THEN 0.99::DOUBLE ELSE (p_partkey % 10) / 10.0 END AS red FROM m),
h AS (SELECT o_orderkey, arg_min({'r': red, 'g': g_, 'b': b_}, (-area, red, g_, b_)) AS shade FROM k WHERE area >= 0.6 * (urx - llx) * (ury - lly) AND (urx - llx) * (ury - lly) > 0 AND NOT (red > 0.97 AND g_ > 0.97 AND b_ > 0.97) GROUP BY o_orderkey)
SELECT o.o_orderkey, shade.r AS r, shade.g AS g, shade.b AS b FROM orders o LEFT JOIN h ON o.o_orderkey = h.o_orderkey""")
def cell_shades(spark, sf):
    """Orders as cells, parts as filled rectangles: the colour that shades each cell, paper left out."""
    fills = _regions(spark, sf).withColumnsRenamed(dict(zip(_REGION_BOX, spatial.BOX))).selectExpr(
        *spatial.BOX, "case when p_partkey % 7 = 0 then 0.99D else (p_partkey % 10) / 10.0D end AS r", "case when p_partkey % 7 = 0 then 1.0D else 0.5D end AS g", "case when p_partkey % 7 = 0 then 0.98D else 0.25D end AS b"
    )
    return spatial.shades(_boxes(spark, sf), ["o_orderkey"], fills).select("o_orderkey", "shade.r", "shade.g", "shade.b")


@query(_PLANE + "SELECT DISTINCT o_orderkey FROM m WHERE area >= 0.9 * (urx - llx) * (ury - lly) AND (urx - llx) * (ury - lly) > 0")
def mostly_inside(spark, sf):
    regions = _regions(spark, sf).withColumnsRenamed(dict(zip(_REGION_BOX, spatial.BOX)))
    return spatial.mostly_inside(_boxes(spark, sf), ["o_orderkey"], regions).select("o_orderkey")


# --- graphs


def _objects(spark, sf):
    """A file's objects: orders as pages, which name their customer, parts and often the next page; customers name nations, these their region, regions their first nation; even parts name half of theirs."""
    orders, lines = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    nations = read(spark, sf, "nation")
    edges = [
        orders.selectExpr("o_orderkey AS src", "1000000000 + o_custkey AS dst"),
        orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS src", "o_orderkey + 1 AS dst"),
        lines.selectExpr("l_orderkey AS src", "4000000000 + l_partkey AS dst"),
        read(spark, sf, "customer").selectExpr("1000000000 + c_custkey AS src", "2000000000 + c_nationkey AS dst"),
        nations.selectExpr("2000000000 + n_nationkey AS src", "3000000000 + n_regionkey AS dst"),
        nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")).selectExpr("3000000000 + n_regionkey AS src", "2000000000 + n AS dst"),
        read(spark, sf, "part").where("p_partkey % 2 = 0").selectExpr("4000000000 + p_partkey AS src", "4000000000 + div(p_partkey, 2) AS dst"),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out, orders.select(F.col("o_orderkey").alias("node"))


_OBJECTS = """
WITH RECURSIVE e AS (
  SELECT o_orderkey AS src, 1000000000 + o_custkey AS dst FROM orders UNION SELECT l_orderkey, 4000000000 + l_partkey FROM lineitem UNION SELECT 1000000000 + c_custkey, 2000000000 + c_nationkey FROM customer
  UNION SELECT 2000000000 + n_nationkey, 3000000000 + n_regionkey FROM nation UNION SELECT 3000000000 + n_regionkey, 2000000000 + min(n_nationkey) FROM nation GROUP BY n_regionkey
  UNION SELECT 4000000000 + p_partkey, 4000000000 + p_partkey // 2 FROM part WHERE p_partkey % 2 = 0),
"""


@query(_OBJECTS + """
t(root, node, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION SELECT root, dst, depth + 1 FROM t JOIN e ON node = src WHERE depth < 24)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY root, node""")
def page_dependencies(spark, sf):
    """What each page needs, for all pages at once; other pages are not entered."""
    edges, pages = _objects(spark, sf)
    return graph.dependencies(edges, pages, barred=pages)


@query(_OBJECTS + """
g AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey > (SELECT min(o_orderkey) FROM orders) THEN o_orderkey END AS owner, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 1 ELSE 0 END AS users FROM orders
  UNION ALL SELECT 3000000000 + r_regionkey, NULL, 2 FROM region WHERE r_regionkey = 0 UNION ALL SELECT 2000000000 + n_nationkey, NULL, 4 FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 4000000000 + p_partkey, NULL, 8 FROM part WHERE p_size = 1),
t(root, owner, users, node) AS (SELECT node, owner, users, node FROM g UNION SELECT root, owner, users, dst FROM t JOIN e ON node = src),
a AS (SELECT node, min(owner) AS least, max(owner) AS most, CAST(bit_or(users) AS INTEGER) AS users FROM t GROUP BY node)
SELECT *, CAST(CASE WHEN users & 2 <> 0 THEN 6 WHEN users & 4 <> 0 THEN 4 WHEN users & 1 <> 0 THEN 6 WHEN least = most AND users & 8 = 0 THEN 7 WHEN least < most THEN 8 ELSE 9 END AS INTEGER) AS part FROM a""")
def page_parts(spark, sf):
    """Which page owns each object, or whether several do, and the part of a file that it belongs to."""
    edges, pages = _objects(spark, sf)
    first = pages.agg(F.min("node").alias("first_"))
    roots = pages.crossJoin(F.broadcast(first)).select("node", F.when(F.col("node") > F.col("first_"), F.col("node")).alias("owner"), F.when(F.col("node") == F.col("first_"), graph.FIRST_PAGE).otherwise(0).alias("users"))  # one row
    for table, where, node, bit in (("region", "r_regionkey = 0", "3000000000 + r_regionkey", graph.OUTLINES), ("nation", "n_nationkey = 3", "2000000000 + n_nationkey", graph.OPENING), ("part", "p_size = 1", "4000000000 + p_partkey", graph.OTHER)):
        roots = roots.unionByName(read(spark, sf, table).where(where).selectExpr(f"{node} AS node", "cast(null as long) AS owner", f"{bit} AS users"))
    return graph.placed(graph.ownership(edges, roots, barred=pages))


def _items(spark, sf):
    """Regions as documents, nations as chapters, their suppliers as sections, and the parts that these sell as items."""
    nation = read(spark, sf, "nation").selectExpr("cast(n_regionkey as long) AS doc", "cast(n_nationkey as long) AS id", "cast(null as long) AS parent", "cast(n_nationkey as long) AS seq", "n_name AS title", "n_nationkey % 3 <> 0 AS open")
    home = read(spark, sf, "nation").selectExpr("n_nationkey", "cast(n_regionkey as long) AS doc")
    supplier = read(spark, sf, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    sold = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    sections = supplier.selectExpr("doc", "1000 + s_suppkey AS id", "cast(s_nationkey as long) AS parent", "s_suppkey AS seq", "s_name AS title", "s_suppkey % 2 = 1 AS open")
    return nation.unionByName(sections).unionByName(sold.selectExpr("doc", "1000000 + l_suppkey * 1000000 + l_partkey AS id", "1000 + l_suppkey AS parent", "l_partkey AS seq", "cast(l_partkey as string) AS title", "true AS open"))


_ITEMS = """
WITH s AS (SELECT n_regionkey::BIGINT AS doc, n_nationkey AS n, s_suppkey AS s, s_name, s_suppkey % 2 = 1 AS open FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
i AS (
  SELECT n_regionkey::BIGINT AS doc, n_nationkey::BIGINT AS id, 1 AS level, n_nationkey % 3 <> 0 AS open, [n_nationkey] AS path, n_nationkey AS n, NULL::BIGINT AS s FROM nation
  UNION ALL SELECT doc, 1000 + s, 2, open, [n, s], n, s FROM s
  UNION ALL SELECT doc, 1000000 + p.s * 1000000 + p, 3, true, [n, p.s, p], n, p.s FROM p JOIN s ON p.s = s.s),
k AS (SELECT s, count(*) AS parts FROM p GROUP BY s),
c AS (
  SELECT i.*, row_number() OVER (PARTITION BY i.doc ORDER BY path) AS pre,
    CASE level WHEN 1 THEN coalesce((SELECT sum(1 + coalesce(parts, 0)) FROM s LEFT JOIN k ON s.s = k.s WHERE s.n = i.n), 0) WHEN 2 THEN coalesce(k.parts, 0) ELSE 0 END AS below,
    CASE level WHEN 1 THEN coalesce((SELECT sum(1 + CASE WHEN s.open THEN coalesce(parts, 0) ELSE 0 END) FROM s LEFT JOIN k ON s.s = k.s WHERE s.n = i.n), 0) WHEN 2 THEN coalesce(k.parts, 0) ELSE 0 END AS visible
  FROM i LEFT JOIN k ON i.s = k.s)
"""


@query(_ITEMS + "SELECT doc, id, CAST(level AS INTEGER) AS level, CAST(pre AS INTEGER) AS pre, CAST(pre + below AS INTEGER) AS last, CAST(below AS BIGINT) AS below, CAST(visible AS BIGINT) AS visible, CAST(CASE WHEN open THEN visible ELSE -visible END AS BIGINT) AS count FROM c")
def outline_counts(spark, sf):
    return graph.counted(_items(spark, sf), ["doc"]).select("doc", "id", "level", "pre", "last", "below", "visible", "count")


@query(_ITEMS + "SELECT doc, id FROM c WHERE NOT (n % 5 = 2 OR (level >= 2 AND s % 7 = 3))")
def outline_pruned(spark, sf):
    """Outlines without some chapters and sections, and what lies below them."""
    items = _items(spark, sf)
    removed = items.where("(id < 1000 AND id % 5 = 2) OR (id BETWEEN 1001 AND 999999 AND (id - 1000) % 7 = 3)").select("doc", "id")
    return graph.without_subtrees(graph.counted(items, ["doc"]), removed, ["doc"]).select("doc", "id")


# --- redaction


def _runs(spark, sf):
    """Order lines as runs of text on their order's page."""
    return read(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS page", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq",
        "cast(20 + (l_partkey % 5) * 70 as double) AS x", "cast(700 - (l_suppkey % 6) * 14 as double) AS y", "cast(20 + (l_partkey % 5) * 70 + 8 * length(concat(l_returnflag, cast(l_partkey * l_suppkey as string))) as double) AS end_x",
        "8.0D AS size", "concat(l_returnflag, cast(l_partkey * l_suppkey as string)) AS text",
    )


def _marks(spark, sf):
    """Three regions a page, two of which may overlap."""
    boxes = ", ".join(f"{k}, cast(o_custkey * {m} % 360 as double), cast(620 + o_orderkey * {m} % 60 as double), cast(o_custkey * {m} % 360 + o_orderkey % {w} as double), cast(650 + o_orderkey * {m} % 60 as double)" for k, m, w in ((1, 7, 90), (2, 11, 50), (3, 7, 30)))
    return read(spark, sf, "orders").selectExpr("o_orderkey AS page", f"stack(3, {boxes}) AS (region, llx, lly, urx, ury)")


_RUNS = """
WITH f AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, (20 + (l_partkey % 5) * 70)::DOUBLE AS x, (700 - (l_suppkey % 6) * 14)::DOUBLE AS y, l_returnflag || (l_partkey * l_suppkey) AS text FROM lineitem),
r AS (SELECT o_orderkey AS page, k AS region, (o_custkey * m % 360)::DOUBLE AS llx, (620 + o_orderkey * m % 60)::DOUBLE AS lly, (o_custkey * m % 360 + o_orderkey % w)::DOUBLE AS urx, (650 + o_orderkey * m % 60)::DOUBLE AS ury FROM orders, (VALUES (1, 7, 90), (2, 11, 50), (3, 7, 30)) v(k, m, w)),
c AS (SELECT page, seq, x, y, text, unnest(range(length(text))) AS i FROM f),
h AS (SELECT c.*, region FROM c JOIN r ON c.page = r.page AND x + (i + 0.5) * 8 BETWEEN llx AND urx AND y + 4 BETWEEN lly AND ury)
"""


@query(_RUNS + """, k AS (SELECT * FROM c ANTI JOIN h USING (page, seq, i)),
n AS (SELECT *, i - row_number() OVER (PARTITION BY page, seq ORDER BY i) AS run FROM k),
o AS (SELECT page, seq, y, min(x) + 8 * min(i) AS x, min(x) + 8 * (max(i) + 1) AS end_x, any_value(text)[min(i) + 1:max(i) + 1] AS text, min(i) AS first FROM n GROUP BY page, seq, y, run)
SELECT page, CAST(seq AS INTEGER) AS seq, x, y, end_x, text, CAST(row_number() OVER (PARTITION BY page, seq ORDER BY first) AS INTEGER) AS piece FROM o""")
def redact_pieces(spark, sf):
    """What redaction leaves of each run, in its place."""
    return edits.subtract(_runs(spark, sf), ["page", "seq"], _marks(spark, sf), ["page"]).select("page", "seq", "x", "y", "end_x", "text", "piece")


@query(_RUNS + ", g AS (SELECT page, region, count(DISTINCT seq) AS fragments, count(*) AS chars FROM h GROUP BY page, region) SELECT r.page, r.region, coalesce(fragments, 0) AS fragments, coalesce(chars, 0) AS chars FROM r LEFT JOIN g ON r.page = g.page AND r.region = g.region")
def redact_dry_run(spark, sf):
    return edits.redaction_report(_runs(spark, sf), ["page", "seq"], _marks(spark, sf), ["page"], ["page", "region"])


@query(_RUNS + "SELECT page, CAST(seq AS INTEGER) AS seq FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page = f.page AND x + 4 * length(text) BETWEEN llx AND urx AND y + 4 BETWEEN lly AND ury)")
def redact_runs(spark, sf):
    """Runs whose middle no region holds."""
    return edits.redact(_runs(spark, sf), _marks(spark, sf), ["page"]).select("page", "seq")


# --- references


@query("""
WITH k AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS keep FROM part),
s AS (SELECT p_partkey AS id, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS value FROM part WHERE p_partkey = (SELECT keep FROM k WHERE k.p_partkey = part.p_partkey)),
l AS (SELECT l_orderkey, string_agg('{"n":[{"ref":' || keep || '}]}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS kids FROM lineitem JOIN k ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT id, value FROM s UNION ALL SELECT 1000000000 + l_orderkey, '{"kids":[' || kids || '],"note":"a \\"ref\\":7 in a text","page":{"ref":' || (1000000000 + l_orderkey) || '}}' FROM l
""")
def merged_references(spark, sf):
    """Parts alike in brand and size become one; orders, whose values name parts, name the ones that are kept."""
    parts = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("value"), F.concat_ws("|", "p_brand", "p_size").alias("sig"))
    kid = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kids = F.transform(F.array_sort(F.collect_list(kid)), lambda k: F.struct(F.array(F.struct(k["l_partkey"].alias("ref"))).alias("n")))
    orders = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(kids.alias("kids")).withColumn("id", F.col("l_orderkey") + 1_000_000_000)
    value = F.to_json(F.struct("kids", F.lit('a "ref":7 in a text').alias("note"), F.struct(F.col("id").alias("ref")).alias("page")))
    objects = parts.unionByName(orders.select("id", value.alias("value"), F.concat(F.lit("order "), "id").alias("sig")))
    return references.merge_duplicates(objects, "id", "value", F.col("sig")).select("id", "value")


# --- flow


@query("""
WITH o AS (SELECT o_custkey AS page, o_orderkey AS nth, (o_orderkey * 7919 % 800)::DOUBLE AS top, left(o_orderpriority, 1) AS c FROM orders),
p AS (SELECT * FROM o WHERE c NOT IN ('1', '2')),
b AS (SELECT page, nth, CASE c WHEN '1' THEN 'image' ELSE 'table' END AS kind, (SELECT min(nth) FROM p WHERE p.page = o.page AND p.top < o.top) AS spot FROM o WHERE c IN ('1', '2')),
u AS (SELECT page, spot IS NULL AS last, spot, 0 AS own, nth, kind, nth AS id FROM b UNION ALL SELECT page, false, nth, 1, 0, 'paragraph', nth FROM p)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY last, spot, own, nth, id) AS INTEGER) AS place, kind, id FROM u
""")
def flow_order(spark, sf):
    """Customers as pages: orders of two priorities are images and tables, which go between the others as paragraphs."""
    blocks = read(spark, sf, "orders").selectExpr("o_custkey AS page", "o_orderkey AS nth", "o_orderkey AS id", "cast(o_orderkey * 7919 % 800 as double) AS top", "left(o_orderpriority, 1) AS c")
    others = blocks.where("c IN ('1', '2')").withColumn("kind", F.when(F.col("c") == "1", "image").otherwise("table"))
    return flow.interleave(blocks.where("c NOT IN ('1', '2')").drop("c"), others.drop("c"), ["page"])


_TABLE_TEXT = """
WITH f AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, CAST(l_suppkey % 6 AS BIGINT) AS line, (20 + (l_partkey % 5) * 70)::DOUBLE AS llx, (700 - (l_suppkey % 6) * 14)::DOUBLE AS lly, (60 + (l_partkey % 5) * 70)::DOUBLE AS urx, (708 - (l_suppkey % 6) * 14)::DOUBLE AS ury FROM lineitem),
t AS (SELECT o_orderkey AS page, k AS table_no, (o_custkey * 13 % 200 + 150 * (k - 1))::DOUBLE AS llx, (630 + o_orderkey % 20)::DOUBLE AS lly, (o_custkey * 13 % 200 + 150 * k)::DOUBLE AS urx, (650 + o_orderkey % 50)::DOUBLE AS ury FROM orders, (VALUES (1), (2)) v(k)),
i AS (SELECT f.page, line, table_no, count(*) AS n FROM f JOIN t ON f.page = t.page AND (f.llx + f.urx) / 2 BETWEEN t.llx - 2 AND t.urx + 2 AND (f.lly + f.ury) / 2 BETWEEN t.lly - 2 AND t.ury + 2 GROUP BY ALL),
a AS (SELECT page, line, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT DISTINCT i.page, i.line FROM i JOIN a ON i.page = a.page AND i.line = a.line WHERE 2 * i.n > a.n),
k AS (SELECT f.* FROM f ANTI JOIN g ON f.page = g.page AND f.line = g.line)
"""


def _table_text(spark, sf):
    frags = read(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS page", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq", "l_suppkey % 6 AS line",
        "cast(20 + (l_partkey % 5) * 70 as double) AS llx", "cast(700 - (l_suppkey % 6) * 14 as double) AS lly", "cast(60 + (l_partkey % 5) * 70 as double) AS urx", "cast(708 - (l_suppkey % 6) * 14 as double) AS ury",
    )
    tables = read(spark, sf, "orders").selectExpr("o_orderkey AS page", "explode(array(1, 2)) AS table_no", "o_custkey", "o_orderkey").selectExpr(
        "page", "table_no", "cast(o_custkey * 13 % 200 + 150 * (table_no - 1) as double) AS llx", "cast(630 + o_orderkey % 20 as double) AS lly", "cast(o_custkey * 13 % 200 + 150 * table_no as double) AS urx", "cast(650 + o_orderkey % 50 as double) AS ury"
    )
    return frags, tables


@query(_TABLE_TEXT + "SELECT page, CAST(seq AS INTEGER) AS seq, line FROM k")
def text_outside_tables(spark, sf):
    frags, tables = _table_text(spark, sf)
    return flow.outside_tables(frags, tables, ["page"], ["line"]).select("page", "seq", "line")


@query(_TABLE_TEXT + """, l AS (SELECT page, line, EXISTS (SELECT 1 FROM k WHERE k.page = a.page AND k.line = a.line) AS kept FROM a),
s AS (SELECT *, CASE WHEN kept AND NOT coalesce(lag(kept) OVER (PARTITION BY page ORDER BY line), false) THEN 1 ELSE 0 END AS starts, row_number() OVER (PARTITION BY page ORDER BY line) = 1 AS head FROM l)
SELECT page, line, CAST(dense_rank() OVER (PARTITION BY page ORDER BY run) AS BIGINT) AS part_no FROM (SELECT *, sum(starts) OVER (PARTITION BY page ORDER BY line) AS run FROM s) WHERE kept""")
def parts_outside_tables(spark, sf):
    """Each page's lines as one paragraph, which its tables part."""
    frags, tables = _table_text(spark, sf)
    lines = frags.select("page", F.lit(1).alias("par"), "line").distinct()
    kept = flow.outside_tables(frags, tables, ["page"], ["line"]).select("page", F.lit(1).alias("par"), "line")
    out = flow.parts_outside(lines, ["page"], "par", "line", kept)
    return out.select("page", "line", F.dense_rank().over(flow.Window.partitionBy("page").orderBy("part_no")).cast("long").alias("part_no"))


_HEBREW = "אבגדהוזחטיכלמנסעפצקרשת"


@query(f"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN translate(lower(p_name), 'abcdefghijklmnopqrstuv', '{_HEBREW}') ELSE p_name END AS name FROM part),
q AS (SELECT *, p_partkey % 3 = 0 AND NOT regexp_matches(name, '[a-zA-Z0-9]') AS whole FROM p)
SELECT p_partkey, name, CASE WHEN whole THEN reverse(name) ELSE name END AS visual FROM q WHERE whole OR p_partkey % 3 <> 0
""")
def bidi_names(spark, sf):
    """Names of parts, a third of them in Hebrew letters, as they are drawn; those that mix letters of both ways have no plain SQL."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuv", _HEBREW)).otherwise(F.col("p_name"))
    lines = read(spark, sf, "part").select("p_partkey", name.alias("name"))
    plain = (F.col("p_partkey") % 3 != 0) | ~F.col("name").rlike("[a-zA-Z0-9]")
    return bidi.visual(lines, ["p_partkey"], "name").where(plain)


@query()
def bidi_documents(spark, sf):
    """Every line of all documents, German ones in Hebrew letters as far as these go, in the order in which it is drawn. Tests hold the order against a plain reading of the rules."""
    from foliospark.operators.text import lines

    text = F.when(F.col("lang") == "de", F.translate("text", "abcdefghijklmnopqrstuv", _HEBREW)).otherwise(F.col("text"))
    return bidi.visual(lines(read(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id", "text"), ["doc_id", "line_no"], "line")


# --- tables without rulings


def _part_pages(spark, sf):
    """Twenty parts a page, in two or three columns; kinds of pages by turns: a table, numbered lines, a list, prose, leaders, a table of two columns, code, contents."""
    p = read(spark, sf, "part").selectExpr("div(p_partkey, 20) AS page", "cast(p_partkey % 20 as int) AS row", "div(p_partkey, 20) % 8 AS kind", "p_partkey", "p_name", "p_brand", "cast(p_size as string) AS size_")
    first = "CASE kind WHEN 1 THEN cast(p_partkey as string) WHEN 2 THEN concat('• ', p_name) WHEN 3 THEN concat(p_name, ' and then some') WHEN 4 THEN concat(p_name, ' .....') WHEN 7 THEN concat('Chapter on the ', p_name) ELSE p_name END"
    second = "CASE kind WHEN 3 THEN 'words of a text here' WHEN 7 THEN concat('see page ', size_) ELSE p_brand END"
    placed = p.selectExpr("page", "row", "kind", f"posexplode(CASE WHEN kind = 0 THEN array({first}, {second}, concat(size_, '.50')) ELSE array({first}, {second}) END) AS (col, text)")
    return placed.selectExpr("page", "cast(row * 3 + col as long) AS seq", "cast(60 + 220 * col as double) AS x", "cast(740 - 16 * row as double) AS y", "cast(60 + 220 * col + 5 * length(text) as double) AS end_x", "10.0D AS size", "CASE kind WHEN 6 THEN 'Courier' ELSE 'Sans' END AS font", "text", "kind", "row", "col")


_PART_PAGES = """
WITH q AS (SELECT p_partkey // 20 AS page, CAST(p_partkey % 20 AS INTEGER) AS row, (p_partkey // 20) % 8 AS kind, p_partkey, p_name, p_brand, p_size FROM part),
c AS (
  SELECT page, row, kind, 0 AS col, CASE kind WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN '• ' || p_name WHEN 3 THEN p_name || ' and then some' WHEN 4 THEN p_name || ' .....' WHEN 7 THEN 'Chapter on the ' || p_name ELSE p_name END AS text FROM q
  UNION ALL SELECT page, row, kind, 1, CASE kind WHEN 3 THEN 'words of a text here' WHEN 7 THEN 'see page ' || p_size ELSE p_brand END FROM q UNION ALL SELECT page, row, kind, 2, p_size || '.50' FROM q WHERE kind = 0)
"""


@query(_PART_PAGES + "SELECT page, CAST(row - min(row) OVER (PARTITION BY page) AS INTEGER) AS row, col, text FROM c WHERE kind IN (0, 5) QUALIFY count(*) FILTER (col = 0) OVER (PARTITION BY page) >= 3")
def borderless_tables(spark, sf):
    """Pages of parts with their columns found; lists, prose, leaders, code and contents are no tables."""
    from foliospark.operators import borderless

    return borderless.tables(_part_pages(spark, sf), ["page"]).select("page", "row", "col", "text")


@query(_PART_PAGES + "SELECT page, row AS line, col + 1 AS cell, text FROM c")
def borderless_cells(spark, sf):
    """The cells of all pages of parts, by line, from the first part on a page."""
    from foliospark.operators import borderless

    found = borderless.cells(_part_pages(spark, sf), ["page"])
    first = _part_pages(spark, sf).groupBy("page").agg(F.min("row").alias("first_"))
    return found.join(first, "page").select("page", (F.col("line") - 1 + F.col("first_")).cast("int").alias("line"), F.col("cell").cast("int").alias("cell"), "text")


@query(_PART_PAGES + "SELECT page, CAST(row - min(row) OVER (PARTITION BY page) AS INTEGER) AS row, col, text FROM c")
def full_page_grid(spark, sf):
    from foliospark.operators import tables

    return tables.full_page(_part_pages(spark, sf), ["page"])


@query("""
WITH t AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderpriority AS signature, o_orderkey FROM orders),
s AS (SELECT *, CASE WHEN lag(signature) OVER (PARTITION BY doc ORDER BY page) = signature THEN 0 ELSE 1 END AS starts FROM t),
n AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY page) AS sheet_no FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, sheet_no ORDER BY page) AS nth FROM n)
SELECT doc, CAST(page AS INTEGER) AS page, CAST(sheet_no AS BIGINT) AS sheet_no, CAST(CASE WHEN nth = 1 THEN r ELSE 1 + 2 * (nth - 1) + r - 1 END AS BIGINT) AS sheet_row, CASE r WHEN 0 THEN 'head' ELSE o_orderkey || '/' || r END AS text
FROM k, range(0, 3) g(r) WHERE r > 0 OR nth = 1
""")
def stitched_sheets(spark, sf):
    """A customer's orders as tables on consecutive pages: those of one shape become a sheet, with one head."""
    from foliospark.operators import tables

    pages = read(spark, sf, "orders").selectExpr("o_custkey AS doc", "row_number() over (partition by o_custkey order by o_orderkey) AS page", "1 AS table_no", "o_orderpriority AS signature", "0 AS col", "o_orderkey").withColumn("row", F.explode(F.array(*map(F.lit, range(3)))))
    cells = pages.withColumn("text", F.when(F.col("row") == 0, F.lit("head")).otherwise(F.concat_ws("/", "o_orderkey", "row"))).drop("o_orderkey")
    return tables.stitched(cells, "doc", "page").select("doc", "page", "sheet_no", F.col("sheet_row").cast("long").alias("sheet_row"), "text")


# --- forms, boxes of matches, clusters, components


@query("""
WITH w AS (SELECT s_nationkey, s_suppkey FROM supplier),
l AS (
  SELECT n_regionkey::BIGINT AS doc, 1000 + s_suppkey AS id, n_name || '.s' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Ch' WHEN n_nationkey % 2 = 0 THEN 'Tx' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE n_nationkey % 4 END AS flags, s_name AS value
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Tx' END, n_nationkey % 4, NULL FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM w))
SELECT doc, id, name, type, CAST(flags AS BIGINT) AS flags, value FROM l
""")
def form_leaves(spark, sf):
    """Nations as fields with their suppliers below, which take over kinds and flags; some suppliers have widgets without a name."""
    from foliospark.operators import forms

    nation, supplier = read(spark, sf, "nation"), read(spark, sf, "supplier")
    top = nation.selectExpr("cast(n_regionkey as long) AS doc", "cast(n_nationkey as long) AS id", "cast(null as long) AS parent", "cast(n_nationkey as long) AS seq", "n_name AS partial", "CASE WHEN n_nationkey % 2 = 0 THEN 'Tx' END AS type", "cast(n_nationkey % 4 as long) AS flags", "cast(null as string) AS value")
    home = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    below = home.selectExpr("cast(n_regionkey as long) AS doc", "1000 + s_suppkey AS id", "cast(n_nationkey as long) AS parent", "s_suppkey AS seq", "concat('s', s_suppkey) AS partial", "CASE WHEN s_suppkey % 3 = 0 THEN 'Ch' END AS type", "CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS flags", "s_name AS value")
    widgets = below.where("seq % 5 = 0").selectExpr("doc", "id + 100000000 AS id", "id AS parent", "1L AS seq", "cast(null as string) AS partial", "cast(null as string) AS type", "cast(null as long) AS flags", "cast(null as string) AS value")
    return forms.leaf_fields(top.unionByName(below).unionByName(widgets), ["doc"])


@query("""
WITH f AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, (20 + (l_partkey % 5) * 70)::DOUBLE AS x, (700 - (l_suppkey % 6) * 14)::DOUBLE AS y, l_returnflag || l_linenumber AS text FROM lineitem),
l AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY y DESC) AS line_no FROM f)
SELECT page, CAST(line_no AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY page, line_no ORDER BY x, seq) AS INTEGER) AS match_no, text AS match, x AS llx, y AS lly, x + 20 AS urx, y + 8 AS ury FROM l WHERE text LIKE 'R%'
""")
def match_boxes(spark, sf):
    """Matches within the lines of orders as pages, with the boxes that they take."""
    from foliospark.operators import layout
    from foliospark.plans.catalogue import order_lines

    frags = order_lines(spark, sf).selectExpr(
        "l_orderkey AS page", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq", "cast(20 + (l_partkey % 5) * 70 as double) AS x", "cast(700 - (l_suppkey % 6) * 14 as double) AS y",
        "cast(40 + (l_partkey % 5) * 70 as double) AS end_x", "8.0D AS size", "'Sans' AS font", "concat(l_returnflag, cast(l_linenumber as string)) AS text", "0.0D AS rotation",
    )
    return layout.search(layout.assemble(layout.with_lines(frags, ["page"]), ["page"]), ["page"], r"R\d")


@query("""
WITH b AS (SELECT o_custkey AS page, (o_orderkey * 37 % 5000)::DOUBLE AS llx, (o_orderkey * 37 % 5000 + o_orderkey % 400)::DOUBLE AS urx FROM orders),
m AS (SELECT *, CASE WHEN llx <= max(urx) OVER (PARTITION BY page ORDER BY llx, urx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS starts FROM b),
r AS (SELECT *, sum(starts) OVER (PARTITION BY page ORDER BY llx, urx ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT page, min(llx) AS llx, 0::DOUBLE AS lly, max(urx) AS urx, 10::DOUBLE AS ury, count(*) AS n FROM r GROUP BY page, run
""")
def rect_clusters(spark, sf):
    """Each customer's orders as rectangles in one row, so that what grows together are merged intervals."""
    from foliospark.operators import rows

    boxes = read(spark, sf, "orders").selectExpr("o_custkey AS page", "cast(o_orderkey * 37 % 5000 as double) AS llx", "0.0D AS lly", "cast(o_orderkey * 37 % 5000 + o_orderkey % 400 as double) AS urx", "10.0D AS ury")
    return rows.cluster_rects(boxes, ["page"], 1.0)


@query("WITH e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey > 0 AND o_orderkey % 2 = 0), n AS (SELECT k FROM e UNION SELECT k // 2 FROM e) SELECT k AS node, k // (k & -k) AS component FROM n")
def component_halves(spark, sf):
    """Orders joined to those of half their number: a component is an odd number times the powers of two."""
    even = read(spark, sf, "orders").where("o_orderkey > 0 AND o_orderkey % 2 = 0")
    return graph.components(even.selectExpr("o_orderkey AS src", "div(o_orderkey, 2) AS dst"))
