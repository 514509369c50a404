"""Queries over the given tables, one for each operator, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import forms, graph, layout, models, pages, rows, tables, text
from foliospark.plans.registry import ORACLES, QUERIES, query, read  # noqa: F401

# --- search and replacement


_SEARCH = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
m AS (SELECT doc_id, line_no, list_filter(regexp_extract_all(line, '{pattern}'), lambda x: length(x) > 0) AS hits FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(generate_subscripts(hits, 1) AS INTEGER) AS match_no, unnest(hits) AS match FROM m WHERE len(hits) > 0
"""


@query(_SEARCH.format(pattern="token ="))
def search_literal(spark, sf):
    return text.search(read(spark, sf, "documents"), "token =")


@query(_SEARCH.format(pattern="(?i)thing"))
def search_ci(spark, sf):
    return text.search(read(spark, sf, "documents"), "THING", ignore_case=True)


@query(_SEARCH.format(pattern="[0-9a-f]{6,}|[A-Z]{3,}!"))
def search_regex(spark, sf):
    return text.search(read(spark, sf, "documents"), "[0-9a-f]{6,}|[A-Z]{3,}!", regex=True)


@query(_SEARCH.format(pattern="^[A-Z][a-z]+"))
def search_line_starts(spark, sf):
    return text.search(read(spark, sf, "documents"), "^[A-Z][a-z]+", regex=True)


@query(_SEARCH.format(pattern="\\b[a-z]+[.]$"))
def search_line_ends(spark, sf):
    return text.search(read(spark, sf, "documents"), r"\b[a-z]+[.]$", regex=True)


@query(_SEARCH.format(pattern="\\A(#.*)?"))
def search_empty_matches(spark, sf):
    """Of lines' starts, those with a mark; empty matches are dropped."""
    return text.search(read(spark, sf, "documents"), r"\A(#.*)?", regex=True)


@query("""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {'n': len(regexp_extract_all(x, '(?i)\\bof\\b')), 't': regexp_replace(x, '(?i)\\bof\\b', 'OF', 'g')}) AS p FROM documents)
SELECT doc_id, CAST(list_sum(list_transform(p, lambda x: x.n)) AS INTEGER) AS n_replaced, sha256(array_to_string(list_transform(p, lambda x: x.t), chr(10))) AS text_sha256 FROM l
""")
def replace_count(spark, sf):
    out = text.replace(read(spark, sf, "documents").select("doc_id", "text"), r"\bof\b", "OF", regex=True, ignore_case=True)
    return out.select("doc_id", "n_replaced", F.sha2("text", 256).alias("text_sha256"))


# --- text


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, rtrim(unnest(string_split(text, chr(10))), ' ' || chr(9)) AS line FROM documents),
i AS (SELECT *, sum(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island, line = '' ORDER BY k) AS nth FROM i)
SELECT doc_id, sha256(trim(string_agg(line, chr(10) ORDER BY k), ' ' || chr(9) || chr(10) || chr(13))) AS clean_sha256 FROM r WHERE line <> '' OR nth <= 2 GROUP BY doc_id
""")
def clean_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.clean(F.col("text")), 256).alias("clean_sha256"))


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT *, trim(line, ' ' || chr(9)) = '' AS blank FROM l),
i AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM b),
p AS (SELECT doc_id, island, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS t FROM i WHERE NOT blank GROUP BY doc_id, island)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) AS INTEGER) AS par_no, CAST(n AS INTEGER) AS n_lines, sha256(t) AS sha FROM p
""")
def paragraph_split(spark, sf):
    return text.paragraphs(read(spark, sf, "documents")).select("doc_id", "par_no", "n_lines", F.sha2("paragraph", 256).alias("sha"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 1 WHEN o_totalprice / 50000.0 >= 1.7 THEN 1 WHEN o_totalprice / 50000.0 >= 1.35 THEN 2 WHEN o_totalprice / 50000.0 >= 1.14 THEN 3 ELSE 0 END AS level FROM orders
""")
def heading_levels(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.heading_level(F.col("o_totalprice"), F.lit(50000.0), F.col("o_orderpriority")).alias("level"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, ['$', '', '€', ''][l_linenumber % 4 + 1] || CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ['', '.5', ',25', '.125'][l_linenumber % 4 + 1] || CASE WHEN l_linenumber % 4 = 3 THEN '%' ELSE '' END AS cell FROM lineitem)
SELECT l_orderkey, l_linenumber, cell, CASE WHEN l_linenumber % 4 = 3 AND length(regexp_extract(cell, '([0-9]+)', 1)) > 3 THEN NULL
  ELSE CASE WHEN l_linenumber % 4 = 3 THEN CAST(regexp_extract(cell, '([0-9]+)', 1) || '125' AS DOUBLE) / 100
  ELSE CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * (CAST(regexp_extract(cell, '([0-9]+)', 1) AS DOUBLE) + [0, 0.5, 0.25, 0][l_linenumber % 4 + 1]) END END AS value FROM t
""")
def number_parse(spark, sf):
    n = F.col("l_linenumber") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), n + 1)
    cell = F.concat(pick("$", "", "€", ""), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(""), F.floor("l_extendedprice").cast("string"), pick("", ".5", ",25", ".125"), F.when(n == 3, "%").otherwise(""))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell")).withColumn("value", text.number(F.col("cell")))


@query("""
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ', ;'), ','), lambda x: trim(trim(trim(x), ';'))), lambda x: x <> ''), '|') AS keys,
       replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM part
""")
def keywords_and_escapes(spark, sf):
    parts = text.keywords(F.replace(F.col("p_type"), F.lit(" "), F.lit(", ;")))
    return read(spark, sf, "part").select("p_partkey", F.array_join(parts, "|").alias("keys"), text.xml_escape(F.col("p_name")).alias("escaped"))


@query("""
SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || ['Z', '+02''00''', ''][CAST(o_orderkey % 3 AS INTEGER) + 1] AS raw,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ['Z', '+02:00', ''][CAST(o_orderkey % 3 AS INTEGER) + 1] AS iso FROM orders
""")
def document_dates(spark, sf):
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+02'00'"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    raw = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), zone)
    return read(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("iso", text.document_date(F.col("raw")))


@query("""
SELECT CAST(n AS INTEGER) AS n, array_to_string(list_transform(range(0, 4), lambda i: CASE i WHEN 0 THEN repeat('m', CAST(n // 1000 AS INTEGER))
  WHEN 1 THEN ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][CAST(n // 100 % 10 AS INTEGER) + 1]
  WHEN 2 THEN ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][CAST(n // 10 % 10 AS INTEGER) + 1]
  ELSE ['','i','ii','iii','iv','v','vi','vii','viii','ix'][CAST(n % 10 AS INTEGER) + 1] END), '') AS roman,
  CASE WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(96 + (n - 1) // 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER))
  ELSE chr(CAST(96 + (n - 27) // 676 AS INTEGER)) || chr(CAST(97 + (n - 27) // 26 % 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) END AS alpha
FROM range(1, 3001) t(n)
""")
def number_styles(spark, sf):
    n = F.col("id").cast("int")
    return spark.range(1, 3001).select(n.alias("n"), text.roman(n).alias("roman"), text.alphabetic(n).alias("alpha"))


# --- pages


def _numbered(spark, sf):
    """The pages of each site as a document's pages."""
    site = F.regexp_extract("url", "://([^/?#]*)", 1)
    return pages.number_pages(read(spark, sf, "pages").select("page_id", site.alias("site")), ["site"], ["page_id"])


_NUMBERED = "n AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS site, CAST(row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY page_id) AS INTEGER) AS page_no FROM pages)"


@query(f"WITH {_NUMBERED}" + """
, r(a, b, before) AS (VALUES (2, 3, 0), (1, 2, 2))
SELECT page_id, site, page_no, CAST(before + page_no - a + 1 AS INTEGER) AS new_no FROM n JOIN r ON page_no BETWEEN a AND b
""")
def extract_ranges(spark, sf):
    return pages.extract(_numbered(spark, sf), [(2, 3), (1, 2)])


@query(f"WITH {_NUMBERED}" + ", o(p, new_no) AS (VALUES (3, 1), (1, 2), (3, 3)) SELECT page_id, site, page_no, CAST(new_no AS INTEGER) AS new_no FROM n JOIN o ON page_no = p")
def reorder(spark, sf):
    return pages.reorder(_numbered(spark, sf), [3, 1, 3])


@query(f"WITH {_NUMBERED} SELECT page_id, site, page_no, CAST(row_number() OVER (PARTITION BY site ORDER BY page_no) AS INTEGER) AS new_no FROM n WHERE page_no NOT IN (1, 3)")
def delete_pages(spark, sf):
    return pages.delete(_numbered(spark, sf), [1, 3, 3], ["site"])


@query(f"WITH {_NUMBERED} SELECT page_id, CAST((page_no * 90 - 180 + 3600) % 360 AS INTEGER) AS rotation FROM n")
def rotate_pages(spark, sf):
    return _numbered(spark, sf).select("page_id", pages.rotate(F.col("page_no") * 90, -180).alias("rotation"))


@query(f"WITH {_NUMBERED}" + """
SELECT page_id, (page_no - 1) // 6 AS sheet, (page_no - 1) % 6 // 3 AS sheet_row, (page_no - 1) % 3 AS sheet_col, (page_no - 1) % 6 % 2 AS down_row, (page_no - 1) % 6 // 2 AS down_col FROM n
""")
def nup(spark, sf):
    across, down = pages.n_up(F.col("page_no"), 2, 3), pages.n_up(F.col("page_no"), 2, 3, True)
    return _numbered(spark, sf).select("page_id", *(c.alias(k) for k, c in across.items()), down["sheet_row"].alias("down_row"), down["sheet_col"].alias("down_col"))


@query(f"WITH {_NUMBERED}" + """
, c AS (SELECT site, count(*) AS n, (count(*) + 3) // 4 * 4 AS padded FROM n GROUP BY site),
s AS (SELECT site, n, i, CASE WHEN i % 2 = 0 THEN padded - i ELSE i + 1 END AS l, CASE WHEN i % 2 = 0 THEN i + 1 ELSE padded - i END AS r FROM c, range(0, 100000) t(i) WHERE i < padded // 2)
SELECT page_id, site, i AS side, half FROM (SELECT site, i, l AS p, 'left' AS half FROM s WHERE l <= n UNION ALL SELECT site, i, r, 'right' FROM s WHERE r <= n) JOIN n USING (site) WHERE page_no = p
""")
def booklet(spark, sf):
    numbered = _numbered(spark, sf)
    counted = numbered.join(numbered.groupBy("site").agg(F.count("*").alias("n")), "site")
    return counted.select("page_id", "site", *(c.alias(k) for k, c in pages.booklet(F.col("page_no"), F.col("n")).items()))


@query("""
WITH r AS (SELECT page_id, page_id AS i FROM pages)
SELECT page_id, CASE WHEN i < 4 THEN ['i', 'ii', 'iii', 'iv'][i + 1] WHEN i < 20 THEN CAST(i - 4 + 5 AS VARCHAR)
  WHEN i < 60 THEN 'A-' || CASE WHEN i - 20 < 26 THEN chr(CAST(97 + i - 20 AS INTEGER)) ELSE chr(CAST(96 + (i - 20) // 26 AS INTEGER)) || chr(CAST(97 + (i - 20) % 26 AS INTEGER)) END ELSE 'x' END AS label FROM r
""")
def page_label(spark, sf):
    at = read(spark, sf, "pages").select("page_id", (F.col("page_id") + 1).alias("page_no"))
    return pages.labels(at, [(0, "r", "", 1), (4, "D", "", 5), (20, "a", "A-", 1), (60, None, "x", 1)]).select("page_id", "label")


@query("""
SELECT doc_id, n_chars FROM documents UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM documents), n_chars FROM documents WHERE lang = 'de'
""")
def append_rebase(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return pages.append(docs.drop("lang"), docs.where("lang = 'de'").drop("lang"), "doc_id")


# --- rows


@query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS s FROM events)
SELECT event_id, user_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run_no FROM g
""")
def sessionise(spark, sf):
    events = read(spark, sf, "events")
    out = rows.sessions(events, ["user_id"], ["ts", "event_id"], lambda lag: F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(lag("ts").cast("timestamp")) > 1_800_000_000)
    return out.select("event_id", "user_id", "run_no")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 60 + event_id % 3000 AS hi FROM events),
m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM r GROUP BY user_id, run HAVING max(hi) - min(lo) >= 120
""")
def interval_merge(spark, sf):
    lo = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    spans = read(spark, sf, "events").select("user_id", lo.alias("lo"), (lo + 60 + F.col("event_id") % 3000).alias("hi"))
    return rows.merge_intervals(spans, ["user_id"], "lo", "hi", 300, 120)


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
l AS (SELECT user_id, list(gap ORDER BY gap) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY user_id)
SELECT user_id, gaps[len(gaps) // 2 + 1] AS median FROM l
""")
def upper_median(spark, sf):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = read(spark, sf, "events").select("user_id", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap"))
    return rows.upper_median(gaps, ["user_id"], "gap")


@query("""
WITH s AS (SELECT p_brand, p_size, sum(p_retailprice) AS w FROM part GROUP BY p_brand, p_size),
c AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size) AS u, sum(w) OVER (PARTITION BY p_brand) AS t FROM s)
SELECT p_brand, min(p_size) AS median FROM c WHERE 2 * u >= t GROUP BY p_brand
""")
def weighted_median(spark, sf):
    return rows.weighted_median(read(spark, sf, "part"), ["p_brand"], "p_size", "p_retailprice")


@query("""
WITH c AS (SELECT l_orderkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_quantity AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_quantity DESC) = 1
""")
def modal_ties_high(spark, sf):
    return rows.mode(read(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity")


@query("""
WITH c AS (SELECT l_suppkey, l_linenumber, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_linenumber AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) = 1
""")
def dominant_ties_low(spark, sf):
    return rows.mode(read(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber", F.col("l_quantity"), high=False)


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type AS exemplar, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1
""")
def top_exemplar(spark, sf):
    return rows.mode(read(spark, sf, "part"), ["p_brand"], "p_type", high=False, out="exemplar")


@query("SELECT l_orderkey, 2 * sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) > count(*) AS mostly FROM lineitem GROUP BY l_orderkey")
def majority_vote(spark, sf):
    return rows.majority(read(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "N", "mostly")


@query("""
SELECT p_partkey, p_size, (SELECT m FROM (VALUES (5), (15), (25), (40)) t(m) WHERE abs(p_size - m) <= 5 ORDER BY abs(p_size - m), m LIMIT 1)::DOUBLE AS first_mark,
       (SELECT m FROM (VALUES (5), (15), (25), (40)) t(m) WHERE abs(p_size - m) <= 5 ORDER BY abs(p_size - m), m DESC LIMIT 1)::DOUBLE AS last_mark FROM part
""")
def nearest_tolerance(spark, sf):
    marks = spark.createDataFrame([(5,), (15,), (25,), (40,)], "m int")
    out = rows.nearest(read(spark, sf, "part").select("p_partkey", "p_size"), "p_size", marks, "m", 5).withColumnRenamed("nearest", "first_mark")
    return rows.nearest(out, "p_size", marks, "m", 5, last=True).withColumnRenamed("nearest", "last_mark")


@query("""
WITH r(k, rate) AS (VALUES (0, 1.0::DOUBLE), (2000, 1.1::DOUBLE), (4500, 1.25::DOUBLE), (8000, 0.9::DOUBLE))
SELECT e.event_id, rate FROM events e ASOF LEFT JOIN r ON e.event_id >= r.k
""")
def asof_rate(spark, sf):
    rates = spark.createDataFrame([(0, 1.0), (2000, 1.1), (4500, 1.25), (8000, 0.9)], "k long, rate double")
    return rows.as_of(read(spark, sf, "events").select("event_id"), "event_id", rates, "k", ["rate"])


@query("""
WITH b AS (SELECT event_type, least(floor(value / 5.0)::BIGINT, 239) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 1200 GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT *, lag(bin) OVER (PARTITION BY event_type ORDER BY bin) AS p FROM b)
SELECT event_type, p + 1 AS first_bin, bin - 1 AS last_bin FROM g WHERE bin - p - 1 >= 2
""")
def histogram_gutters(spark, sf):
    return rows.gutters(read(spark, sf, "events"), ["event_type"], "value", 0.0, 1200.0, 240, 2, 2)


_REGIONS = [("a", 5.0, 0.0, 20.0, 0.05), ("b", 15.0, 0.04, 40.0, 0.08), ("c", 45.0, 0.0, 60.0, 0.2)]


@query("""
WITH r(region_id, llx, lly, urx, ury) AS (VALUES ('a', 5.0::DOUBLE, 0.0::DOUBLE, 20.0::DOUBLE, 0.05::DOUBLE), ('b', 15.0, 0.04, 40.0, 0.08), ('c', 45.0, 0.0, 60.0, 0.2))
SELECT region_id, count(*) AS n, sum(l_linenumber) AS lines FROM lineitem, r WHERE l_quantity < urx AND l_quantity + 2 > llx AND l_discount < ury AND l_discount + 0.005 > lly GROUP BY region_id
""")
def rect_overlap(spark, sf):
    boxes = read(spark, sf, "lineitem").select("l_linenumber", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_quantity") + 2).alias("x1"), (F.col("l_discount") + 0.005).alias("y1"))
    regions = spark.createDataFrame(_REGIONS, "region_id string, llx double, lly double, urx double, ury double")
    return rows.overlaps(boxes, "x0", "y0", "x1", "y1", regions).groupBy("region_id").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 30 THEN 1 WHEN l_quantity >= 30 AND l_quantity < 45 THEN 2 END AS cell_col,
       CASE WHEN l_tax >= 0 AND l_tax < 0.03 THEN 0 WHEN l_tax >= 0.03 AND l_tax < 0.07 THEN 1 END AS cell_row FROM lineitem
""")
def point_in_cell(spark, sf):
    return rows.cell_of(read(spark, sf, "lineitem"), "l_quantity", "l_tax", [1.0, 10.0, 30.0, 45.0], [0.0, 0.03, 0.07]).select("l_orderkey", "l_linenumber", "cell_col", "cell_row")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keep_id FROM documents")
def dedupe_exact(spark, sf):
    return rows.canonical(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.sha2("text", 256)).select("doc_id", "keep_id")


@query("""
WITH l AS (SELECT DISTINCT source, doc_id, regexp_replace(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')), '[0-9]+', '#', 'g') AS key FROM documents),
t AS (SELECT source, count(*) AS rows_ FROM documents GROUP BY source)
SELECT source, key, count(*) AS n FROM l JOIN t USING (source) WHERE length(key) BETWEEN 1 AND 120 GROUP BY source, key, rows_ HAVING count(*) >= greatest(3, floor(rows_ * 0.01) + 1)
""")
def furniture_lines(spark, sf):
    return rows.repeated_lines(read(spark, sf, "documents"), "source", "doc_id", "text", 0.01)


@query("""
WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_partkey % 3 AS sig, lag(l_linenumber) OVER w AS p, lag(l_partkey % 3) OVER w AS ps FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(sum(CASE WHEN l_linenumber = p + 1 AND sig = ps THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS table_group FROM g
""")
def stitch_tables(spark, sf):
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_partkey") % 3).alias("sig"))
    return rows.stitch(items, ["l_orderkey"], "l_linenumber", "sig", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "table_group")


# --- graphs


def _edges(spark, sf):
    """Orders that lead to others of the same customer: a sparse reference graph with cycles."""
    o = read(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000 + 1).alias("dst"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 1000 + 1 AS dst FROM orders),
t(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM t JOIN e ON node = src WHERE depth < 40)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY node
""")
def closure(spark, sf):
    return graph.reachable(_edges(spark, sf), spark.createDataFrame([(1,)], "node long"))


@query()
def components(spark, sf):
    """Orders and parts that order lines join. Recursive SQL takes the square of a component, so tests hold it against brute force."""
    items = read(spark, sf, "lineitem")
    return graph.components(items.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 100_000_000).alias("dst")))


def _tree(spark, sf):
    """Regions, nations and customers' segments as an outline."""
    region = read(spark, sf, "region").selectExpr("cast(r_regionkey as long) AS id", "cast(null as long) AS parent", "cast(r_regionkey as int) AS seq", "r_name AS title")
    nation = read(spark, sf, "nation").selectExpr("cast(100 + n_nationkey as long) AS id", "cast(n_regionkey as long) AS parent", "cast(n_nationkey as int) AS seq", "n_name AS title")
    supplier = read(spark, sf, "supplier").selectExpr("cast(1000 + s_suppkey as long) AS id", "cast(100 + s_nationkey as long) AS parent", "cast(s_suppkey as int) AS seq", "s_name AS title")
    return region.unionByName(nation).unionByName(supplier)


@query("""
SELECT r_regionkey::BIGINT AS id, r_name AS title, 1 AS level, r_name AS path, lpad(r_regionkey::VARCHAR, 19, '0') AS place FROM region
UNION ALL SELECT 100 + n_nationkey, n_name, 2, r_name || ' / ' || n_name, lpad(r_regionkey::VARCHAR, 19, '0') || '.' || lpad(n_nationkey::VARCHAR, 19, '0') FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000 + s_suppkey, s_name, 3, r_name || ' / ' || n_name || ' / ' || s_name, lpad(r_regionkey::VARCHAR, 19, '0') || '.' || lpad(n_nationkey::VARCHAR, 19, '0') || '.' || lpad(s_suppkey::VARCHAR, 19, '0')
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def toc_outline(spark, sf):
    return graph.outline(_tree(spark, sf))


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) = 1")
def xref_first_wins(spark, sf):
    items = read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return graph.first_wins(items, ["l_partkey"], "l_orderkey")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1")
def xref_last_wins(spark, sf):
    items = read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return graph.last_wins(items, ["l_partkey"], "l_orderkey")


# --- forms and models


@query("""
WITH f AS (SELECT user_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT user_id, '{' || string_agg('"' || name || '":{"type":"text","value":"' || value || '"}', ',' ORDER BY name) || '}' AS form FROM f GROUP BY user_id
""")
def form_json(spark, sf):
    fields = read(spark, sf, "events").select("user_id", F.col("event_type").alias("name"), F.lit("text").alias("type"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("seq"))
    return forms.export_json(fields, ["user_id"])


@query("""
WITH f AS (SELECT c_nationkey, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN '"checkbox","value":' || (c_custkey % 8 = 0) WHEN 1 THEN '"listbox","value":["' || c_mktsegment || '","b"]' ELSE '"text","value":"' || c_mktsegment || '"' END AS v FROM customer WHERE c_custkey % 4 < 3)
SELECT c_nationkey, '{' || string_agg('"' || name || '":{"type":' || v || '}', ',' ORDER BY name) || '}' AS form FROM f GROUP BY c_nationkey
""")
def form_typed_json(spark, sf):
    nth = F.col("c_custkey") % 4
    kind = F.when(nth == 0, "checkbox").when(nth == 1, "listbox").when(nth == 2, "text").otherwise("push_button")
    value = F.when(nth == 0, F.when(F.col("c_custkey") % 8 == 0, "Yes").otherwise("Off")).when(nth == 1, F.concat("c_mktsegment", F.lit("\nb"))).otherwise(F.col("c_mktsegment"))
    fields = read(spark, sf, "customer").select("c_nationkey", F.col("c_name").alias("name"), kind.alias("kind"), value.alias("value"), F.col("c_custkey").alias("seq"))
    return forms.export_typed_json(fields, ["c_nationkey"])


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, (8 + l_partkey % 4)::DOUBLE AS size, l_suppkey % 5 = 0 AS mono,
    (700 - 12 * l_linenumber - 5 * (l_partkey % 3))::DOUBLE AS y, l_suppkey % 7 = 0 AS marked FROM lineitem),
s AS (SELECT l_orderkey, i, size, mono, y, 1 AS seg_no FROM l WHERE i = 1 UNION ALL
  SELECT l_orderkey, i, CASE WHEN fresh THEN size ELSE greatest(size, top) END, mono, y, seg_no + fresh::INTEGER FROM (
    SELECT l.*, s.size AS top, s.seg_no, l.marked OR l.mono <> s.mono OR l.size / s.size > 1.12 OR s.size / l.size > 1.12 OR s.y - l.y > 1.6 * l.size AS fresh FROM s JOIN l ON l.l_orderkey = s.l_orderkey AND l.i = s.i + 1))
SELECT l_orderkey, seg_no, max(size) AS size, any_value(mono) AS mono, count(*) AS n_lines FROM s GROUP BY ALL
""")
def paragraph_segments(spark, sf):
    """Lines of an order as a paragraph's, with sizes, fonts, places and markers by their parts and suppliers."""
    from pyspark.sql import Window

    from foliospark.operators import flow

    text = F.when(F.col("l_suppkey") % 7 == 0, "- item").otherwise("word")
    size, y = (8 + F.col("l_partkey") % 4).cast("double"), (700 - 12 * F.col("l_linenumber") - 5 * (F.col("l_partkey") % 3)).cast("double")
    drawn = F.struct(text.alias("text"), F.lit(72.0).alias("x"), y.alias("y"), F.lit(20.0).alias("width"), F.when(F.col("l_suppkey") % 5 == 0, "Courier").otherwise("Arial").alias("font"), size.alias("size"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = read(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(order).alias("line_no"), y.alias("y"), text.alias("text"), F.array(drawn).alias("fragments"))
    return flow.segments(lines, ["l_orderkey"]).select("l_orderkey", "seg_no", "size", "mono", "n_lines")


@query("""
SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events
""")
def form_import(spark, sf):
    wrapped = F.concat(F.lit('{"k":{"type":"text","value":"'), F.get_json_object("props", "$.k"), F.lit('"}}'))
    return forms.import_json(read(spark, sf, "events").select("event_id", wrapped.alias("form")), ["event_id"], "form").select("event_id", "name", "value")


@query("""
WITH c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(substr(whole, 1, 48000)) AS history_sha256, length(whole) > 48000 AS truncated FROM c
""")
def chat_assemble(spark, sf):
    out = models.conversation(read(spark, sf, "conversations"), ["conv_id"], "turn", "role", "text")
    return out.select("conv_id", "n_turns", F.sha2("history", 256).alias("history_sha256"), "truncated")


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
t AS (SELECT source, doc_id, k, n_chars AS held, 1 AS chunk_no FROM d WHERE k = 1
      UNION ALL SELECT d.source, d.doc_id, d.k, CASE WHEN held > 0 AND held + n_chars > 24000 THEN n_chars ELSE held + n_chars END, CASE WHEN held > 0 AND held + n_chars > 24000 THEN chunk_no + 1 ELSE chunk_no END
      FROM t JOIN d ON d.source = t.source AND d.k = t.k + 1)
SELECT source, doc_id, CAST(chunk_no AS INTEGER) AS chunk_no FROM t
""")
def chunk_pack(spark, sf):
    return models.pack(read(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars").select("source", "doc_id", "chunk_no")


@query("""
SELECT 0 AS part, doc_id AS seq, length(text) AS n FROM documents WHERE trim(text) <> '' UNION ALL SELECT 1, item_id, length(text) FROM benchmark WHERE trim(text) <> ''
""")
def gather_texts(spark, sf):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    return models.gather(docs, items, "doc_id", "text").select("part", "seq", F.length("text").cast("long").alias("n"))


# --- validation


@query("""
SELECT 'documents' AS part, doc_id AS id, 'length' AS rule FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'documents', doc_id, 'short' FROM documents WHERE length(text) < 50
UNION ALL SELECT 'documents', d.doc_id, 'unlabelled' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'pages', page_id, 'unclosed' FROM pages WHERE html NOT LIKE '%</html>%'
UNION ALL SELECT 'pages', page_id, 'insecure' FROM pages WHERE url LIKE 'http://%'
""")
def issues_union(spark, sf):
    docs, web, labels = (read(spark, sf, t) for t in ("documents", "pages", "labels"))
    rule = lambda df, part, key, name: df.select(F.lit(part).alias("part"), F.col(key).alias("id"), F.lit(name).alias("rule"))
    checks = [
        rule(docs.where(F.col("n_chars") != F.length("text")), "documents", "doc_id", "length"),
        rule(docs.where(F.length("text") < 50), "documents", "doc_id", "short"),
        rule(docs.join(labels, "doc_id", "left_anti"), "documents", "doc_id", "unlabelled"),
        rule(web.where(~F.col("html").contains("</html>")), "pages", "page_id", "unclosed"),
        rule(web.where(F.col("url").startswith("http://")), "pages", "page_id", "insecure"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT o_orderkey, (o_orderkey & 4) <> 0 AS can_print, (o_orderkey & 8) <> 0 AS can_modify, (o_orderkey & 16) <> 0 AS can_copy, (o_orderkey & 32) <> 0 AS can_annotate FROM orders")
def permission_bits(spark, sf):
    from foliospark.sources import scan

    return read(spark, sf, "orders").select("o_orderkey", *(scan.permission(F.col("o_orderkey"), x).alias(f"can_{x}") for x in ("print", "modify", "copy", "annotate")))


# --- layout: order lines as fragments of a page


def order_lines(spark, sf):
    """Order lines, those of an order together, a tenth of a million to a task: what follows by page needs no other shuffle."""
    return rows.dealt(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag"), ["l_orderkey"], 100_000)


def _fragments(spark, sf):
    """Each order is a page; its lines are fragments on a grid with some jitter."""
    return order_lines(spark, sf).selectExpr(
        "l_orderkey AS page", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq",
        "cast(20 + (l_partkey % 5) * 70 as double) AS x", "cast(700 - (l_suppkey % 6) * 14 + (l_linenumber % 2) * 0.25 as double) AS y", "cast(20 + (l_partkey % 5) * 70 + 20 + l_quantity as double) AS end_x",
        "cast(8 + (l_linenumber % 3) * 2 as double) AS size", "'/ABCDEF+Sans' AS font", "concat(l_returnflag, cast(l_linenumber as string)) AS text", "0.0D AS rotation",
    )


_FRAGMENTS = """
WITH f AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, (20 + (l_partkey % 5) * 70)::DOUBLE AS x,
  (700 - (l_suppkey % 6) * 14 + (l_linenumber % 2) * 0.25)::DOUBLE AS y, (20 + (l_partkey % 5) * 70 + 20 + l_quantity)::DOUBLE AS end_x, (8 + (l_linenumber % 3) * 2)::DOUBLE AS size, l_returnflag || l_linenumber AS text FROM lineitem),
g AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > greatest(1, 0.3 * size) OR lag(y) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY page ORDER BY -round(y * 2), x, seq)),
n AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY -round(y * 2), x, seq) AS line FROM g),
p AS (SELECT *, CASE WHEN x - lag(end_x) OVER v > greatest(1, 0.2 * least(size, lag(size) OVER v)) THEN ' ' || text ELSE text END AS piece, row_number() OVER v AS nth FROM n WINDOW v AS (PARTITION BY page, line ORDER BY x, seq)),
l AS (SELECT page, line, string_agg(piece, '' ORDER BY nth) AS text, arg_min(y, {'s': -size, 'n': nth}) AS y, arg_min(size, nth) AS size FROM p GROUP BY page, line),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, line) AS line_no FROM l)
"""


@query(_FRAGMENTS + "SELECT page, CAST(line_no AS INTEGER) AS line_no, y, size, text FROM o")
def layout_lines(spark, sf):
    return layout.assemble(layout.with_lines(_fragments(spark, sf), ["page"]), ["page"]).select("page", "line_no", "y", "size", "text")


@query(_FRAGMENTS + """, t AS (SELECT *, CASE WHEN line_no = 1 THEN '' WHEN lag(y) OVER (PARTITION BY page ORDER BY line_no) - y > 1.5 * size THEN chr(10) || chr(10) ELSE chr(10) END || text AS led FROM o)
SELECT page, string_agg(led, '' ORDER BY line_no) AS text FROM t GROUP BY page""")
def layout_text(spark, sf):
    return layout.page_text(layout.assemble(layout.with_lines(_fragments(spark, sf), ["page"]), ["page"]), ["page"])


@query(_FRAGMENTS + """, r AS (SELECT page, seq, CASE WHEN abs(y - lag(y) OVER w) > 0.5 * size THEN chr(10) WHEN x - lag(end_x) OVER w > 0.2 * size THEN ' ' ELSE '' END || text AS led FROM f WINDOW w AS (PARTITION BY page ORDER BY seq))
SELECT page, string_agg(led, '' ORDER BY seq) AS text FROM r GROUP BY page""")
def layout_raw_text(spark, sf):
    return layout.raw_text(_fragments(spark, sf), ["page"])


@query(_FRAGMENTS + """, b AS (SELECT DISTINCT page, floor(y + 0.5) AS line, unnest(range(least(floor(x / 1.6)::INTEGER, 239), least(floor(end_x / 1.6)::INTEGER, 239) + 1)) AS bin FROM f),
c AS (SELECT page, bin, count(*) AS n, (SELECT count(DISTINCT line) FROM b b2 WHERE b2.page = b.page) AS lines FROM b GROUP BY page, bin),
d AS (SELECT *, lag(bin) OVER (PARTITION BY page ORDER BY bin) AS prev FROM c WHERE n >= CASE WHEN lines >= 6 THEN 2 ELSE 1 END),
e AS (SELECT *, sum(CASE WHEN prev IS NULL OR bin - prev - 1 >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY bin) AS col FROM d)
SELECT page, CAST(col AS BIGINT) AS col_no, min(bin) * 384.0::DOUBLE / 240 AS x0, (max(bin) + 1) * 384.0::DOUBLE / 240 AS x1 FROM e GROUP BY page, col""")
def layout_columns(spark, sf):
    return layout.columns(_fragments(spark, sf), ["page"], F.lit(384.0))


@query(_FRAGMENTS + """, k AS (SELECT *, lag(y) OVER w - y AS gap, lag(size) OVER w AS before FROM o WINDOW w AS (PARTITION BY page ORDER BY line_no)),
m AS (SELECT page, list(gap ORDER BY gap) AS gaps FROM k WHERE gap IS NOT NULL GROUP BY page),
q AS (SELECT k.*, coalesce(gaps[len(gaps) // 2 + 1], 0) AS typical FROM k LEFT JOIN m USING (page)),
z AS (SELECT *, sum(CASE WHEN before IS NULL OR (typical > 0 AND gap > 1.6 * typical) OR size > 1.3 * before OR size < 0.7 * before THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no) AS par FROM q)
SELECT page, CAST(par AS BIGINT) AS par_no, string_agg(text, ' ' ORDER BY line_no) AS text, count(*) AS n_lines FROM z GROUP BY page, par""")
def layout_paragraphs(spark, sf):
    lines = layout.assemble(layout.with_lines(_fragments(spark, sf), ["page"]), ["page"])
    return layout.paragraphs(lines, ["page"]).select("page", "par_no", "text", "n_lines")


# --- files


#: Files that a task makes and reads.
FILES = 2000


def _as_files(spark, sf):
    """Every document as a file of its own: a text line a line, fifty to a page."""
    from foliospark.sources import pdf

    def made(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                lines = (t or "").split("\n")
                sheets = [lines[k : k + 50] for k in range(0, len(lines), 50)]
                out.append(pdf.write([[(40, 760 - 14 * i, 10, x) for i, x in enumerate(s)] for s in sheets], info={"Title": str(len(lines))}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    # Reading a file costs far more than its bytes do, so files are dealt over all cores.
    return rows.dealt(read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], FILES).mapInArrow(made, "doc_id bigint, content binary")


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST((k - 1) // 50 + 1 AS INTEGER) AS page_no, sha256(string_agg(line, chr(10) ORDER BY k)) AS text_sha256 FROM l WHERE line <> '' GROUP BY ALL
""")
def pdf_text(spark, sf):
    from foliospark.sources import scan

    frags = scan.fragments(_as_files(spark, sf), ["doc_id"])
    by = ["doc_id", "page_no"]
    lines = layout.assemble(layout.with_lines(frags, by), by)
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda t: t["text"]), "\n")
    return lines.groupBy(*by).agg(F.sha2(text_of, 256).alias("text_sha256"))


@query("""
SELECT doc_id, 'ok' AS status, '1.7' AS version, CAST((len(string_split(text, chr(10))) + 49) // 50 AS INTEGER) AS n_pages, CAST(len(string_split(text, chr(10))) AS VARCHAR) AS title FROM documents
""")
def pdf_documents(spark, sf):
    from foliospark.sources import scan

    return scan.documents(_as_files(spark, sf), ["doc_id"]).select("doc_id", "status", "version", "n_pages", F.col("info")["Title"].alias("title"))


def _uneven_files(spark, sf):
    """Every document as a file with one of six states, by its id: whole, no file at all, without its table of objects, with a language, without a title, without pages."""
    from foliospark.sources import pdf

    def made(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind = doc % 6
                data = pdf.write([[(40, 760, 10, x)] for x in (t or "").split("\n", 1)] if kind != 5 else [], info={} if kind == 4 else {"Title": "t"}, catalog="/Lang (en)" if kind == 3 else "")
                out.append(b"no file " + str(doc).encode() if kind == 1 else data[: data.rindex(b"\nxref")] if kind == 2 else data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return rows.dealt(read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], FILES).mapInArrow(made, "doc_id bigint, content binary")


@query("""
SELECT doc_id, rule, detail FROM documents, (VALUES (0, 'language', 'missing'), (0, 'tagged', 'no structure tree'), (1, 'header', 'no %PDF- at the start'), (1, 'structure', 'no catalogue'),
  (2, 'cross_reference', 'rebuilt'), (2, 'language', 'missing'), (2, 'tagged', 'no structure tree'), (2, 'title', 'missing'), (3, 'tagged', 'no structure tree'), (4, 'title', 'missing'), (4, 'language', 'missing'), (4, 'tagged', 'no structure tree'),
  (5, 'cross_reference', 'rebuilt'), (5, 'pages', 'none'), (5, 'language', 'missing'), (5, 'tagged', 'no structure tree')) i(kind, rule, detail) WHERE doc_id % 6 = kind
""")
def pdf_issues(spark, sf):
    from foliospark.sources import scan

    return scan.issues(_uneven_files(spark, sf), ["doc_id"])


def _rich_files(spark, sf):
    """Every customer as a file of two turned pages with a note, a link, an outline, a form, an attachment, a destination and page labels."""
    from foliospark.sources import pdf

    def made(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for key, name, segment in zip(*(b.column(i).to_pylist() for i in range(3))):
                note = f"{name} {segment}".encode()
                objects = [
                    b"<< /Type /Annot /Subtype /Text /Rect [10 20 %d 60] /Contents (%s) /F 4 >>" % (30 + key % 100, note),
                    b"<< /Type /Annot /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (https://example.org/%d) >> >>" % key,
                    b"<< /First 8 0 R /Last 9 0 R /Count 2 >>",
                    b"<< /Title (%s) /Parent 7 0 R /Next 9 0 R /First 10 0 R /Last 10 0 R /Count 1 >>" % segment.encode(),
                    b"<< /Title (End) /Parent 7 0 R /Prev 8 0 R >>",
                    b"<< /Title (%s) /Parent 8 0 R >>" % name.encode(),
                    b"<< /T (who) /FT /Tx /Ff 2 /Kids [12 0 R 13 0 R] >>",
                    b"<< /T (name) /Parent 11 0 R /V (%s) >>" % name.encode(),
                    b"<< /T (buys) /Parent 11 0 R /FT /Btn /V /%s >>" % (b"Yes" if key % 2 else b"Off"),
                    b"<< /Type /EmbeddedFile /Length %d >>\nstream\n%s\nendstream" % (len(note), note),
                    b"<< /Type /Filespec /F (note.txt) /Desc (of %d) /EF << /F 14 0 R >> >>" % key,
                ]
                catalog = "/Outlines 7 0 R /AcroForm << /Fields [11 0 R] >> /Names << /EmbeddedFiles << /Names [(note.txt) 15 0 R] >> /Dests << /Names [(last) [18 0 R /Fit]] >> >> /PageLabels << /Nums [0 << /S /r >> 1 << /S /D /P (A-) /St 5 >>] >>"
                out.append(pdf.write([[(40, 700, 10, name)], [(40, 700, 10, segment)]], objects=objects, catalog=catalog, page=f"/Rotate {90 * (key % 4)} /Annots [5 0 R 6 0 R]"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["custkey", "content"])

    return rows.dealt(read(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_mktsegment"), ["custkey"], FILES).mapInArrow(made, "custkey bigint, content binary")


_PAGES_OF = "SELECT c_custkey AS custkey, p AS page_no, c_name, c_mktsegment FROM customer, (VALUES (1), (2)) t(p)"


@query("SELECT custkey, page_no, 0::DOUBLE AS llx, 612::DOUBLE AS urx, 792::DOUBLE AS ury, CAST(90 * (custkey % 4) AS INTEGER) AS rotation, 2 AS n_annotations FROM (" + _PAGES_OF + ")")
def pdf_pages(spark, sf):
    from foliospark.sources import scan

    return scan.pages(_rich_files(spark, sf), ["custkey"]).select("custkey", "page_no", "llx", "urx", "ury", "rotation", "n_annotations")


@query("SELECT custkey, page_no, seq, subtype, urx, contents, uri, flags FROM (" + _PAGES_OF + """) c, LATERAL (VALUES (0, 'Text', (30 + custkey % 100)::DOUBLE, c_name || ' ' || c_mktsegment, NULL, 4::BIGINT), (1, 'Link', 3::DOUBLE, NULL, 'https://example.org/' || custkey, 0::BIGINT)) a(seq, subtype, urx, contents, uri, flags)
""")
def pdf_annotations(spark, sf):
    from foliospark.sources import scan

    return scan.annotations(_rich_files(spark, sf), ["custkey"]).select("custkey", "page_no", "seq", "subtype", "urx", "contents", "uri", "flags")


@query("SELECT custkey, page_no, 1 AS match_no, c_mktsegment AS match, 10::DOUBLE AS llx FROM (" + _PAGES_OF + ")")
def pdf_annotation_search(spark, sf):
    from foliospark.sources import scan

    notes = scan.annotations(_rich_files(spark, sf), ["custkey"])
    return layout.search_annotations(notes, ["custkey", "page_no"], "[A-Z]{3,}$").select("custkey", "page_no", "match_no", "match", "llx")


@query("""
SELECT c_custkey AS custkey, title, level, path FROM customer, LATERAL (VALUES (c_mktsegment, 1, c_mktsegment), (c_name, 2, c_mktsegment || ' / ' || c_name), ('End', 1, 'End')) o(title, level, path)
""")
def pdf_outlines(spark, sf):
    """Outlines of all files at once, with their paths."""
    from foliospark.sources import scan

    found = scan.outlines(_rich_files(spark, sf), ["custkey"]).select("custkey", "id", "parent", "seq", "title")
    return graph.outline(found, by=["custkey"]).select("custkey", "title", "level", "path")


@query("""
SELECT c_custkey AS custkey, name, type, flags, value FROM customer, LATERAL (VALUES ('who.name', 'Tx', 2::BIGINT, c_name), ('who.buys', 'Btn', 2::BIGINT, CASE WHEN c_custkey % 2 = 1 THEN 'Yes' ELSE 'Off' END)) f(name, type, flags, value)
""")
def pdf_fields(spark, sf):
    from foliospark.sources import scan

    return scan.fields(_rich_files(spark, sf), ["custkey"])


@query("SELECT c_custkey AS custkey, 'note.txt' AS name, 'of ' || c_custkey AS description, length(c_name || ' ' || c_mktsegment) AS size, sha256(c_name || ' ' || c_mktsegment) AS content_sha256 FROM customer")
def pdf_attachments(spark, sf):
    from foliospark.sources import scan

    files = _rich_files(spark, sf).withColumnRenamed("content", "data")
    return scan.embedded_files(files, ["custkey"], "data").select("custkey", "name", "description", "size", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT c_custkey AS custkey, 'last' AS name, 2 AS page_no, 'Fit' AS fit FROM customer")
def pdf_destinations(spark, sf):
    from foliospark.sources import scan

    return scan.destinations(_rich_files(spark, sf), ["custkey"])


@query("SELECT c_custkey AS custkey, first, style, prefix, start FROM customer, (VALUES (0, 'r', '', 1), (1, 'D', 'A-', 5)) l(first, style, prefix, start)")
def pdf_page_labels(spark, sf):
    from foliospark.sources import scan

    return scan.page_labels(_rich_files(spark, sf), ["custkey"])


def _layered_files(spark, sf):
    """Every supplier as a file with two layers, two scripts, a metadata packet and a field of each kind."""
    from foliospark.sources import pdf

    def made(batches):
        import pyarrow as pa

        stream = lambda body: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
        kinds = ["/FT /Btn", "/FT /Btn /Ff 32768", "/FT /Btn /Ff 65536", "/FT /Ch /Ff 131072", "/FT /Ch", "/FT /Tx /Ff 8192", "/FT /Tx /Ff 1048576", "/FT /Tx /Ff 33554432", "/FT /Tx /AA << /F << /S /JavaScript /JS (AFNumber_Format\\(2\\);) >> >>", "/FT /Tx /AA << /F << /JS (AFDate_FormatEx\\(1\\);) >> >>", "/FT /Tx", "/FT /Sig"]
        packet = '<?xpacket begin=""?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:o="urn:own/" xmp:CreatorTool="tool"><dc:title><rdf:Alt><rdf:li>{name}</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>a</rdf:li><rdf:li>{key}</rdf:li></rdf:Seq></dc:creator><o:key>{key}</o:key></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
        for b in batches:
            out = []
            for key, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                objects = [
                    b"<< /Type /OCG /Name (%s) >>" % name.encode(), b"<< /Type /OCG /Name (Draft) >>",
                    b"<< /S /JavaScript /JS (first) >>", b"<< /S /JavaScript /JS 9 0 R >>", stream(b"show %d" % key),
                    stream(packet.format(name=name, key=key).encode()), *(f"<< /T (f{k:02d}) {kind} >>".encode() for k, kind in enumerate(kinds)),
                ]
                fields = " ".join(f"{11 + k} 0 R" for k in range(len(kinds)))
                catalog = f"/OCProperties << /OCGs [5 0 R 6 0 R] /D << {'/OFF [6 0 R]' if key % 2 else ''} >> >> /Names << /JavaScript << /Names [(open) 8 0 R (close) 7 0 R] >> >> /Metadata 10 0 R /AcroForm << /Fields [{fields}] >>"
                out.append(pdf.write([[(40, 700, 10, name)]], objects=objects, catalog=catalog))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["suppkey", "content"])

    return rows.dealt(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_name"), ["suppkey"], FILES).mapInArrow(made, "suppkey bigint, content binary")


@query("SELECT s_suppkey AS suppkey, seq, CASE seq WHEN 0 THEN s_name ELSE 'Draft' END AS name, seq = 0 OR s_suppkey % 2 = 0 AS visible FROM supplier, (VALUES (0), (1)) t(seq)")
def pdf_layers(spark, sf):
    from foliospark.sources import scan

    return scan.layers(_layered_files(spark, sf), ["suppkey"])


@query("SELECT s_suppkey AS suppkey, name, CASE name WHEN 'close' THEN 'first' ELSE 'show ' || s_suppkey END AS script FROM supplier, (VALUES ('open'), ('close')) t(name)")
def pdf_scripts(spark, sf):
    from foliospark.sources import scan

    return scan.scripts(_layered_files(spark, sf), ["suppkey"])


@query("SELECT s_suppkey AS suppkey, s_name AS title, 'a|' || s_suppkey AS authors, 'tool' AS creator_tool, CAST(s_suppkey AS VARCHAR) AS own_key FROM supplier")
def pdf_xmp(spark, sf):
    from foliospark.sources import scan

    found = scan.xmp(_layered_files(spark, sf), ["suppkey"])
    return found.select("suppkey", "title", F.array_join("authors", "|").alias("authors"), "creator_tool", F.col("custom")["urn:own/key"].alias("own_key"))


@query("""
SELECT s_suppkey AS suppkey, name, kind FROM supplier, (VALUES ('f00', 'checkbox'), ('f01', 'radio'), ('f02', 'push_button'), ('f03', 'combobox'), ('f04', 'listbox'), ('f05', 'password'), ('f06', 'file'), ('f07', 'rich_text'),
  ('f08', 'number'), ('f09', 'date'), ('f10', 'text'), ('f11', 'unknown')) k(name, kind)
""")
def pdf_field_kinds(spark, sf):
    from foliospark.sources import scan

    return scan.typed_fields(_layered_files(spark, sf), ["suppkey"]).select("suppkey", "name", "kind")


# --- tables


def _ruled_files(spark, sf):
    """Every nation with its suppliers as a ruled table: a sheet for forty keys, so at most forty rows, a nation."""
    from foliospark.sources import pdf

    def made(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for rows_of in b.column(1).to_pylist():
                pages_of, grids = [], []
                for k in range(0, len(rows_of), 40):
                    part = [("name", "balance"), *((r["name"], r["balance"]) for r in rows_of[k : k + 40])]
                    pages_of.append([(55 + 200 * c, 743 - 16 * i, 9, v) for i, row in enumerate(part) for c, v in enumerate(row)])
                    bottom = 754 - 16 * len(part)
                    grids.append(" ".join([*(f"50 {754 - 16 * i} m 450 {754 - 16 * i} l S" for i in range(len(part) + 1)), *(f"{x} 754 m {x} {bottom} l S" for x in (50, 250, 450))]))
                out.append(pdf.write(pages_of, extra=grids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["nation", "content"])

    listed = read(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_suppkey") / 40).cast("int").alias("sheet"), F.struct("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").cast("string").alias("balance")).alias("r"))
    listed = listed.groupBy((F.col("nation") * 1000000000 + F.col("sheet")).alias("nation")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return listed.mapInArrow(made, "nation bigint, content binary")


@query("""
WITH s AS (SELECT CAST(s_nationkey AS BIGINT) * 1000000000 + CAST(trunc(s_suppkey / 40) AS INTEGER) AS nation, s_name, s_acctbal, row_number() OVER (PARTITION BY CAST(s_nationkey AS BIGINT) * 1000000000 + CAST(trunc(s_suppkey / 40) AS INTEGER) ORDER BY s_suppkey) AS k FROM supplier)
SELECT CAST(nation AS BIGINT) AS nation, CAST(k AS INTEGER) AS row, 0 AS col, s_name AS text FROM s UNION ALL SELECT nation, CAST(k AS INTEGER), 1, CAST(s_acctbal AS VARCHAR) FROM s
UNION ALL SELECT DISTINCT nation, 0, 0, 'name' FROM s UNION ALL SELECT DISTINCT nation, 0, 1, 'balance' FROM s
""")
def table_cells(spark, sf):
    from foliospark.sources import scan

    files = _ruled_files(spark, sf)
    by = ["nation", "page_no"]
    return tables.detect(scan.fragments(files, ["nation"]), scan.rules(files, ["nation"]), by).where("kind = 'lattice'").select("nation", "row", "col", "text")


@query("""
WITH r AS (SELECT user_id AS page, event_id % 2 = 0 AS vertical, CAST(event_id % 7 * 50 AS DOUBLE) AS pos, CAST(floor(value) AS DOUBLE) AS lo, CAST(floor(value) + 10 + event_id % 90 AS DOUBLE) AS hi FROM events),
m AS (SELECT *, max(hi) OVER (PARTITION BY page, vertical, pos ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page, vertical, pos ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT page, vertical, pos, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY page, vertical, pos, run HAVING max(hi) - min(lo) >= 8
""")
def table_rules(spark, sf):
    e = read(spark, sf, "events")
    v, pos, lo = F.col("event_id") % 2 == 0, (F.col("event_id") % 7 * 50).cast("double"), F.floor("value").cast("double")
    hi = lo + 10 + F.col("event_id") % 90
    rules = e.select(F.col("user_id").alias("page"), F.when(v, pos).otherwise(lo).alias("x0"), F.when(v, lo).otherwise(pos).alias("y0"), F.when(v, pos).otherwise(hi).alias("x1"), F.when(v, hi).otherwise(pos).alias("y1"))
    return tables.normalise_rules(rules, ["page"])


@query("""
WITH c AS (SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_name, n_nationkey FROM nation)
SELECT CAST(region AS BIGINT) AS region, '| name | key |' || chr(10) || '| --- | ---: |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY k) AS markdown FROM c GROUP BY region
""")
def table_markdown(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("region"), "n_nationkey", "n_name")
    n = pages.number_pages(n, ["region"], ["n_nationkey"], "row")
    head = n.select("region").distinct()
    cells = n.select("region", "row", F.lit(0).alias("col"), F.col("n_name").alias("text")).unionByName(n.select("region", "row", F.lit(1).alias("col"), F.col("n_nationkey").cast("string").alias("text")))
    cells = cells.unionByName(head.select("region", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("name").alias("text"))).unionByName(head.select("region", F.lit(0).alias("row"), F.lit(1).alias("col"), F.lit("key").alias("text")))
    return tables.markdown(cells, ["region"])


# --- flow and Markdown


def _flow(spark, sf):
    """Brands as chapters, their parts as items and paragraphs."""
    p = read(spark, sf, "part")
    head = p.groupBy("p_brand").agg(F.min("p_partkey").alias("k")).selectExpr("'all' AS doc", "concat(p_brand, '!') AS o", "'heading' AS kind", "1 AS level", "p_brand AS content")
    body = p.selectExpr("'all' AS doc", "concat(p_brand, '#', lpad(cast(p_partkey as string), 8, '0')) AS o", "case when p_size % 2 = 0 then 'bullet' else 'paragraph' end AS kind", "0 AS level", "p_name AS content")
    return head.unionByName(body).withColumn("doc", F.substring("o", 1, 7))


_FLOW = """
WITH f AS (SELECT substr(p_brand, 1, 7) AS doc, p_brand || '!' AS o, 'heading' AS kind, 1 AS level, p_brand AS content FROM part GROUP BY p_brand
UNION ALL SELECT substr(p_brand, 1, 7), p_brand || '#' || lpad(p_partkey::VARCHAR, 8, '0'), CASE WHEN p_size % 2 = 0 THEN 'bullet' ELSE 'paragraph' END, 0, p_name FROM part)
"""


@query(_FLOW + """, g AS (SELECT *, regexp_replace(content, '([\\\\`*_\\[\\]<>|#])', '\\\\\\1', 'g') AS safe, lag(kind) OVER (PARTITION BY doc ORDER BY o) AS before, row_number() OVER (PARTITION BY doc ORDER BY o) AS n FROM f)
SELECT doc, string_agg(CASE WHEN n = 1 THEN '' WHEN before = kind AND kind = 'bullet' THEN chr(10) ELSE chr(10) || chr(10) END || CASE kind WHEN 'heading' THEN '# ' WHEN 'bullet' THEN '- ' ELSE '' END || safe, '' ORDER BY n) || chr(10) AS markdown FROM g GROUP BY doc""")
def markdown_export(spark, sf):
    from foliospark.operators import flow

    return flow.to_markdown(_flow(spark, sf), "doc", "o")


@query(_FLOW + "SELECT doc, o, CAST(sum(CASE WHEN kind = 'heading' AND level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY o) AS BIGINT) AS chapter_no FROM f")
def chapter_split(spark, sf):
    from foliospark.operators import flow

    return flow.chapters(_flow(spark, sf), "doc", "o").select("doc", "o", "chapter_no")


@query(_FLOW + """, g AS (SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS after, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY doc ORDER BY o))
SELECT doc, string_agg(CASE kind WHEN 'heading' THEN '<h1>' || content || '</h1>' || chr(10) WHEN 'bullet' THEN CASE WHEN before IS DISTINCT FROM 'bullet' THEN '<ul>' || chr(10) ELSE '' END || '<li>' || content || '</li>' || chr(10) || CASE WHEN after IS DISTINCT FROM 'bullet' THEN '</ul>' || chr(10) ELSE '' END
  ELSE '<p>' || content || '</p>' || chr(10) END, '' ORDER BY n) AS html FROM g GROUP BY doc""")
def html_export(spark, sf):
    from foliospark.operators import flow

    return flow.to_html(_flow(spark, sf), "doc", "o")


@query("""
SELECT p_partkey, b.seq, b.depth, b.kind, b.level, b.block_text FROM part, LATERAL (VALUES (0, 0, 'heading', 2, p_name), (1, 0, 'list', 0, ''), (2, 1, 'item', 0, ''), (3, 2, 'paragraph', 0, p_type), (4, 1, 'item', 0, ''), (5, 2, 'paragraph', 0, p_brand), (6, 0, 'quote', 0, ''), (7, 1, 'paragraph', 0, CAST(p_size AS VARCHAR) || chr(10) || 'lazy')) b(seq, depth, kind, level, block_text)
""")
def markdown_blocks(spark, sf):
    from foliospark.functions import markdown

    text_of = F.concat(F.lit("## "), "p_name", F.lit("\n- *"), "p_type", F.lit("*\n- `"), "p_brand", F.lit("`\n\n> "), F.col("p_size").cast("string"), F.lit("\nlazy\n"))
    texts = rows.dealt(read(spark, sf, "part").select("p_partkey", text_of.alias("md")), ["p_partkey"], 10 * FILES)  # a small file, much work
    return markdown.blocks(texts, ["p_partkey"], "md").select("p_partkey", "seq", "depth", "kind", "level", "block_text")


@query()
def markdown_documents(spark, sf):
    """The blocks of whole documents read as Markdown."""
    from foliospark.functions import markdown

    return markdown.blocks(read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query("""
WITH c AS (SELECT user_id, CAST(round(value * 10) AS INTEGER) % 7 AS tenths, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, tenths FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tenths) = 1
""")
def dominant_size(spark, sf):
    return rows.mode(read(spark, sf, "events").select("user_id", (F.round(F.col("value") * 10).cast("int") % 7).alias("tenths")), ["user_id"], "tenths", high=False, out="tenths").select("user_id", "tenths")


@query("""
SELECT user_id, event_type, CASE WHEN event_type = 'click' THEN 1 ELSE value END AS value FROM events WHERE event_type <> 'view'
""")
def edited_rows(spark, sf):
    from foliospark.operators import edits

    e = edits.remove(read(spark, sf, "events").select("user_id", "event_type", "value"), F.col("event_type") == "view")
    return edits.update(e, F.col("event_type") == "click", {"value": F.lit(1)})


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def alt_audit(spark, sf):
    from foliospark.operators import edits

    alt = read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "text").otherwise(" ").alias("alt"))
    return edits.without_alt(read(spark, sf, "documents").select("doc_id"), alt, ["doc_id"])


@query("""
SELECT p.page_id, strlen(trim(coalesce(d.text, ''))) < 3 AND coalesce(m.area >= 0.7 * 1000, false) AS needs_ocr FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id LEFT JOIN (SELECT o_custkey AS page_id, max(o_totalprice / 200) AS area FROM orders GROUP BY o_custkey) m ON m.page_id = p.page_id
""")
def scanned_pages(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    web = read(spark, sf, "pages").select("page_id").join(docs, "page_id", "left").withColumn("page_area", F.lit(1000.0))
    images = read(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), (F.col("o_totalprice") / 200).alias("area"))
    return models.needs_ocr(web, images, ["page_id"], "text", "page_area", "area").select("page_id", "needs_ocr")


from foliospark.plans import structure  # noqa: E402, F401  registers its queries
