"""Documents as a flow of blocks: body size, headings, lists, furniture, chapters, and their Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators import spatial
from foliospark.operators.rows import sessions, weighted_median
from foliospark.operators.text import collapse, heading_level, list_marker

#: Share of a page's height, from either end, in which running heads and feet stand.
EDGE = 0.12


def body_size(frags: DataFrame, by: list[str]) -> DataFrame:
    """The body size of each document: the median of sizes, weighed by characters."""
    return weighted_median(frags.withColumn("w_", F.length("text")), by, "size", "w_", "body")


def dominant_size(frags: DataFrame, by: list[str]) -> DataFrame:
    """The size, in tenths, of most characters of each line or page; the smaller on ties."""
    from foliospark.operators.rows import mode

    return mode(frags.withColumn("tenths", F.round(F.col("size") * 10).cast("int")), by, "tenths", F.length("text"), high=False, out="tenths")


def furniture_key(text: Column) -> Column:
    """A paragraph with its white space collapsed and its numbers masked."""
    return F.regexp_replace(collapse(text), r"\d+", "#")


def furniture(paras: DataFrame, doc: str, page: str, height: Column) -> DataFrame:
    """Keys of running heads and feet: those that stand near an edge on at least three pages and over half of them."""
    near = (F.col("lly") < height * EDGE) | (F.col("ury") > height * (1 - EDGE))
    keyed = paras.where(near & (F.length("text") <= 120)).select(doc, page, furniture_key(F.col("text")).alias("key"), "text").where("key <> ''")
    pages = paras.groupBy(doc).agg(F.countDistinct(page).alias("pages_"))
    counts = keyed.select(doc, page, "key").distinct().groupBy(doc, "key").agg(F.count("*").alias("n"))
    return counts.join(pages, doc).where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages_") / 2) + 1)).drop("pages_")


def without_furniture(paras: DataFrame, found: DataFrame, doc: str, height: Column) -> DataFrame:
    near = (F.col("lly") < height * EDGE) | (F.col("ury") > height * (1 - EDGE))
    keyed = paras.withColumn("key", F.when(near & (F.length("text") <= 120), furniture_key(F.col("text"))))
    return keyed.join(found.select(doc, "key"), [doc, "key"], "left_anti").drop("key")


def blocks(paras: DataFrame, doc: str) -> DataFrame:
    """Adds ``kind`` (heading, ordered, bullet, paragraph), ``level`` and ``content``: a list item's is without its marker."""
    level = heading_level(F.col("size"), F.col("body"), F.col("text"))
    marker = list_marker(F.col("text"))
    kind = F.when(level > 0, "heading").when(marker.isNotNull(), marker).otherwise("paragraph")
    bare = F.regexp_replace("text", r"\A\s*(?:\d{1,3}[.)]|[•‣◦▪·\-*–])\s+", "")
    return paras.withColumns({"kind": kind, "level": level, "content": F.when((level == 0) & marker.isNotNull(), bare).otherwise(F.col("text"))})


#: How far a table's edges are moved out before text is looked for in it. Fixed value.
TABLE_SLACK = 2.0


def outside_tables(frags: DataFrame, tables: DataFrame, by: list[str], line: list[str]) -> DataFrame:
    """Fragments (by, line, seq, llx, lly, urx, ury) of lines that lie in no table (by, table_no, box): one leaves the flow with most of its fragments' middles in one table."""
    grown = tables.select(*by, "table_no", *((F.col(c) + (TABLE_SLACK if c.startswith("u") else -TABLE_SLACK)).alias(f"{c}_t_") for c in spatial.BOX))
    keys = [*by, *line]
    points = frags.select(*keys, ((F.col("llx") + F.col("urx")) / 2).alias("mx_"), ((F.col("lly") + F.col("ury")) / 2).alias("my_"))
    inside = spatial.meets(points, grown, ("mx_", "my_", "mx_", "my_"), tuple(f"{c}_t_" for c in spatial.BOX), by, touching=True)
    held = inside.groupBy(*keys, "table_no").agg(F.count("*").alias("in_"))
    gone = held.join(frags.groupBy(*keys).agg(F.count("*").alias("all_")), keys).where("2 * in_ > all_").select(*keys).distinct()
    return frags.join(gone, keys, "left_anti").select(*frags.columns)


def parts_outside(lines: DataFrame, by: list[str], par: str, line: str, kept: DataFrame) -> DataFrame:
    """``lines`` that are ``kept`` (by, par, line), with ``part_no``: what is left of a paragraph on the two sides of a table are parts of their own."""
    keys = [*by, par, line]
    marked = lines.join(kept.select(*keys).distinct().withColumn("kept_", F.lit(True)), keys, "left")
    runs = sessions(marked, [*by, par], [line], lambda lag: ~F.coalesce(lag("kept_"), F.lit(False)) & F.coalesce("kept_", F.lit(False)), "part_no")
    return runs.where("kept_").select(*lines.columns, "part_no")


def interleave(paras: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """One order of unlike blocks: ``by``, ``place`` from 1, ``kind``, ``id``. ``paras`` (by, nth, id, top) are in reading order; ``others`` (by, nth, id, kind, top) are images, graphics and tables.

    A block goes before the first paragraph in reading order whose top is below its own, after blocks of a lower ``nth`` that go there
    too, or to the end. Reading order isn't sorted by tops, but least tops so far are: among the paragraphs that lower them, the
    first one below a block is the one with the greatest top below it, so one sort of tops finds it for all blocks of a page.
    """
    w = Window.partitionBy(*by).orderBy("nth")
    least = F.min("top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    lower = paras.withColumn("least_", least).where("least_ IS NULL OR top < least_")
    steps = lower.select(*by, F.col("top").alias("t_"), F.lit(1).alias("side_"), F.col("nth").alias("at_"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast(others.schema["id"].dataType).alias("id"), F.lit(None).cast(others.schema["nth"].dataType).alias("nth"))
    asked = others.select(*by, F.col("top").alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast(paras.schema["nth"].dataType).alias("at_"), "kind", "id", "nth")
    upto = Window.partitionBy(*by).orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    found = steps.unionByName(asked).withColumn("at_", F.last("at_", ignorenulls=True).over(upto)).where("side_ = 0")
    both = found.select(*by, F.col("at_").isNull().alias("end_"), "at_", F.lit(0).alias("own_"), "nth", "kind", "id")
    both = both.unionByName(paras.select(*by, F.lit(False).alias("end_"), F.col("nth").alias("at_"), F.lit(1).alias("own_"), F.lit(0).cast(others.schema["nth"].dataType).alias("nth"), F.lit("paragraph").alias("kind"), "id"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("end_", "at_", "own_", "nth", "id"))).select(*by, "place", "kind", "id")


#: Parts of the names of fonts with letters of one width. Fixed values.
MONO = ("courier", "mono", "consol")


def segments(lines: DataFrame, by: list[str]) -> DataFrame:
    """Parts of each paragraph: by, ``seg_no`` from 1, text, size, mono, marker, indent, n_lines. ``by`` names the paragraph; lines are as ``layout.assemble`` gives them.

    A part begins at a list marker, where most characters change between letters of one width and others, where the size
    departs by over 1.12 from the part's largest so far, or at a gap of over 1.6 sizes. As the largest so far depends on
    where the part began, lines are folded in order; a paragraph's lines, at most a page's, are one row for that.
    """
    tenths = lambda f: F.floor(f["size"] * 10 + 0.5).cast("int")
    letters = lambda frags: F.aggregate(frags, F.lit(0), lambda n, f: n + F.length(f["text"]))
    found = F.col("fragments")
    sizes = F.array_distinct(F.transform(found, tenths))
    best = F.array_max(F.transform(sizes, lambda s: F.struct(letters(F.filter(found, lambda f: tenths(f) == s)).alias("w"), (-s).alias("s"))))
    mono = F.coalesce(2 * letters(F.filter(found, lambda f: F.lower(f["font"]).rlike("|".join(MONO)))) > letters(found), F.lit(False))
    told = lines.withColumns({"size_": F.coalesce(-best["s"] / 10, F.lit(12.0)), "mono_": mono, "marker_": list_marker(F.col("text")), "x_": F.coalesce(F.try_element_at(found, F.lit(1))["x"], F.lit(0.0)).cast("double")})
    one = F.struct("line_no", F.col("y").cast("double").alias("y"), "text", "size_", "mono_", "marker_", "x_")
    whole = told.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("lines_"))
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("size"), F.lit(False).alias("mono"), F.lit(0.0).alias("y"), F.array().cast("array<int>").alias("ks"))

    def step(s: Column, line: Column) -> Column:
        size = line["size_"]
        jump = (s["size"] > 0) & (size > 0) & ((size / s["size"] > 1.12) | (s["size"] / size > 1.12))
        fresh = (s["k"] == 0) | line["marker_"].isNotNull() | (line["mono_"] != s["mono"]) | jump | ((size > 0) & (s["y"] - line["y"] > 1.6 * size))
        k = F.when(fresh, s["k"] + 1).otherwise(s["k"])
        return F.struct(k.alias("k"), F.when(fresh, size).otherwise(F.greatest(s["size"], size)).alias("size"), F.when(fresh, line["mono_"]).otherwise(s["mono"]).alias("mono"), line["y"].alias("y"), F.concat(s["ks"], F.array(k)).alias("ks"))

    parts = whole.withColumn("ks_", F.aggregate("lines_", start, step, lambda s: s["ks"])).select(*by, F.explode(F.arrays_zip("lines_", "ks_")).alias("z_")).select(*by, F.col("z_.ks_").alias("seg_no"), "z_.lines_.*")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda t: t["text"]), " ")
    head = lambda c: F.min_by(c, "line_no")
    return parts.groupBy(*by, "seg_no").agg(texts.alias("text"), F.max("size_").alias("size"), head("mono_").alias("mono"), head("marker_").alias("marker"), head("x_").alias("indent"), F.count("*").alias("n_lines"))


def chapters(flow: DataFrame, doc: str, order: str) -> DataFrame:
    """Adds ``chapter_no``: each heading of level 1 begins one; what comes before the first is chapter 0."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when((F.col("kind") == "heading") & (F.col("level") == 1), 1).otherwise(0)
    return flow.withColumn("chapter_no", F.sum(starts).over(w))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>|#])", r"\\$1")


def to_markdown(flow: DataFrame, doc: str, order: str) -> DataFrame:
    """The Markdown of each document; items of one list follow each other, other blocks are apart."""
    w = Window.partitionBy(doc).orderBy(order)
    kind = F.col("kind")
    nth = F.row_number().over(w)
    body = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), _escaped(F.col("content")))).when(kind == "bullet", F.concat(F.lit("- "), _escaped(F.col("content"))))
        .when(kind == "ordered", F.concat(F.lit("1. "), _escaped(F.col("content")))).when(kind == "table", F.col("content")).otherwise(_escaped(F.col("content")))
    )
    joined = F.lag("kind").over(w).eqNullSafe(kind) & kind.isin("bullet", "ordered")
    led = F.concat(F.when(nth == 1, "").when(joined, "\n").otherwise("\n\n"), body)
    parts = flow.select(doc, nth.alias("n_"), led.alias("led_"))
    return parts.groupBy(doc).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_", "led_"))), lambda p: p["led_"]), ""), F.lit("\n")).alias("markdown"))


def to_html(flow: DataFrame, doc: str, order: str) -> DataFrame:
    """The HTML body of each document in flow mode."""
    from foliospark.operators.text import xml_escape

    w = Window.partitionBy(doc).orderBy(order)
    kind, before, after = F.col("kind"), F.lag("kind").over(w), F.lead("kind").over(w)
    safe = xml_escape(F.col("content"))
    tag = F.when(kind == "bullet", "ul").when(kind == "ordered", "ol")
    listed = kind.isin("bullet", "ordered")
    level = F.col("level").cast("string")
    item = F.concat(F.when(listed & ~before.eqNullSafe(kind), F.concat(F.lit("<"), tag, F.lit(">\n"))).otherwise(""), F.lit("<li>"), safe, F.lit("</li>\n"), F.when(listed & ~after.eqNullSafe(kind), F.concat(F.lit("</"), tag, F.lit(">\n"))).otherwise(""))
    body = F.when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(">"), safe, F.lit("</h"), level, F.lit(">\n"))).when(listed, item).otherwise(F.concat(F.lit("<p>"), safe, F.lit("</p>\n")))
    parts = flow.select(doc, F.row_number().over(w).alias("n_"), body.alias("body_"))
    return parts.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_", "body_"))), lambda p: p["body_"]), "").alias("html"))
