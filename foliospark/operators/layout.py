"""From text fragments to lines, columns, paragraphs and page text.

Fragments are rows of (by…, seq, x, y, end_x, size, font, text, rotation). All windows are partitioned by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.rows import merge_intervals, sessions, upper_median
from foliospark.operators.text import font_family, trim


def with_lines(frags: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``line_key``: fragments near each other in y are a line. Rotated ones are lines of their own.

    Heights within half a point count as equal, by rounding to half points so that the order is total; a line ends
    where y moves by more than a point and three tenths of the fragment's size from the one before.
    """
    kept = frags.where(F.length("text") > 0)
    upright = kept.where(F.abs(F.coalesce("rotation", F.lit(0.0))) <= 1).withColumn("row_", -F.round(F.col("y") * 2))
    grouped = sessions(upright, by, ["row_", "x", "seq"], lambda lag: F.abs(F.col("y") - lag("y")) > F.greatest(F.lit(1.0), 0.3 * F.col("size")), "n_").drop("row_")
    turned = kept.where(F.abs("rotation") > 1).withColumn("n_", F.col("seq").cast("long"))
    return grouped.withColumn("turned_", F.lit(0)).unionByName(turned.withColumn("turned_", F.lit(1))).withColumn("line_key", F.struct("turned_", "n_")).drop("turned_", "n_")


def assemble(lined: DataFrame, by: list[str]) -> DataFrame:
    """A row for each line: ``line_no`` from the top, y (of the first of the largest fragments), text, size, bounds, fragments.

    A space stands where the gap is over a point and a fifth of the smaller of the two sizes. Fragments under 0.85
    of the largest size are super- or subscripts where they are over a fifth of it off the baseline.
    """
    w = Window.partitionBy(*by, "line_key").orderBy("x", "seq")
    gap = F.col("x") - F.lag("end_x").over(w)
    space = F.coalesce(gap > F.greatest(F.lit(1.0), 0.2 * F.least(F.col("size"), F.lag("size").over(w))), F.lit(False))
    pieces = lined.withColumns({"piece_": F.when(space, F.concat(F.lit(" "), "text")).otherwise(F.col("text")), "nth_": F.row_number().over(w)})
    one = F.struct("nth_", "piece_", "text", "x", "y", "end_x", "size", font_family(F.col("font")).alias("font"))
    lines = pieces.groupBy(*by, "line_key").agg(
        F.array_sort(F.collect_list(one)).alias("all_"), F.max("size").alias("most_"), F.min_by("y", F.struct((-F.col("size")).alias("s"), "nth_")).alias("line_y"),
        F.min("x").alias("llx"), F.min("y").alias("lly"), F.max("end_x").alias("urx"), F.max(F.col("y") + F.col("size")).alias("ury"),
    )

    def script(f: Column) -> Column:
        small = f["size"] < 0.85 * F.col("most_")
        return F.when(small & (f["y"] - F.col("line_y") > 0.2 * F.col("most_")), "super").when(small & (f["y"] - F.col("line_y") < -0.2 * F.col("most_")), "sub")

    shown = F.transform("all_", lambda f: F.struct(f["text"].alias("text"), f["x"].alias("x"), f["y"].alias("y"), (f["end_x"] - f["x"]).alias("width"), f["font"].alias("font"), f["size"].alias("size"), script(f).alias("script")))
    lines = lines.withColumns({"text": F.array_join(F.transform("all_", lambda f: f["piece_"]), ""), "size": F.element_at("all_", 1)["size"], "fragments": shown})
    order = Window.partitionBy(*by).orderBy(F.col("line_y").desc(), "line_key")
    return lines.withColumn("line_no", F.row_number().over(order)).select(*by, "line_no", F.col("line_y").alias("y"), "text", "size", "llx", "lly", "urx", "ury", "fragments")


def page_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """The text of each page in reading order; a gap of over one and a half sizes leaves a blank line."""
    w = Window.partitionBy(*by).orderBy("line_no")
    wide = F.coalesce(F.lag("y").over(w) - F.col("y") > 1.5 * F.col("size"), F.lit(False))
    led = lines.withColumn("led_", F.concat(F.when(F.col("line_no") == 1, "").when(wide, "\n\n").otherwise("\n"), "text"))
    return led.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "led_"))), lambda t: t["led_"]), "").alias("text"))


def raw_text(frags: DataFrame, by: list[str]) -> DataFrame:
    """The text of each page in drawing order: a line feed where y moves by over half a size, else a space at a gap of over a fifth."""
    w = Window.partitionBy(*by).orderBy("seq")
    size = F.when(F.col("size") == 0, 12.0).otherwise(F.col("size"))
    moved = F.abs(F.col("y") - F.lag("y").over(w)) > 0.5 * size
    apart = F.col("x") - F.lag("end_x").over(w) > 0.2 * size
    led = frags.where(F.length("text") > 0).withColumn("led_", F.concat(F.when(moved, "\n").when(apart, " ").otherwise(""), "text"))
    return led.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "led_"))), lambda t: t["led_"]), "").alias("text"))


#: Bins across a page, and the least width of a gutter as a share of it.
BINS, GUTTER = 240, 0.045


def columns(frags: DataFrame, by: list[str], width: Column) -> DataFrame:
    """Columns of each page: by, ``col_no`` from the left, ``x0``, ``x1``.

    Bins count distinct lines; on pages of six lines or more, those of one line are empty. Empty runs of 4.5 hundredths
    of the page, two bins at least, part columns. A bin is never a row: the spans of a line are merged, and where they
    begin and end is summed along the page.
    """
    bin_w = width / BINS
    cut = lambda x: F.least(F.greatest(F.floor(x / bin_w), F.lit(0)), F.lit(BINS - 1)).cast("int")
    spans = frags.select(*by, width.alias("w_"), F.floor(F.col("y") + 0.5).alias("line_"), cut(F.col("x")).alias("a_"), F.greatest(cut(F.col("x")), cut(F.col("end_x"))).alias("b_")).where("a_ IS NOT NULL AND b_ IS NOT NULL")
    merged = merge_intervals(spans, [*by, "w_", "line_"], "a_", "b_", gap=1)
    whole = Window.partitionBy(*by)
    merged = merged.withColumn("new_", F.when(F.row_number().over(Window.partitionBy(*by, "line_").orderBy("w_", "a_")) == 1, 1).otherwise(0))
    edges = merged.select(*by, "w_", F.explode(F.array(F.struct(F.col("a_").alias("bin_"), F.lit(1).alias("d_"), F.col("new_").alias("new_")), F.struct((F.col("b_") + 1).alias("bin_"), F.lit(-1).alias("d_"), F.lit(0).alias("new_")))).alias("e_"))
    steps = edges.groupBy(*by, "w_", "e_.bin_").agg(F.sum("e_.d_").alias("d_"), F.sum("e_.new_").alias("new_"))
    w = Window.partitionBy(*by, "w_").orderBy("bin_")
    full = steps.withColumns({"n_": F.sum("d_").over(w.rowsBetween(Window.unboundedPreceding, 0)), "to_": F.lead("bin_").over(w) - 1, "lines_": F.sum("new_").over(whole)})
    full = full.where(F.col("n_") >= F.when(F.col("lines_") >= 6, 2).otherwise(1))
    wide = F.greatest(F.lit(2), F.floor(F.lit(GUTTER * BINS)))
    runs = sessions(full, by, ["bin_"], lambda lag: F.col("bin_") - lag("to_") - 1 >= wide, "col_no")
    return runs.groupBy(*by, "col_no").agg((F.min("bin_") * F.first("w_") / BINS).alias("x0"), ((F.max("to_") + 1) * F.first("w_") / BINS).alias("x1"))


def in_columns(frags: DataFrame, cols: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``col_no`` of the column that holds the fragment's middle, else of the one with the nearest edge, the left one on ties."""
    listed = cols.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("col_no", "x0", "x1"))).alias("cols_"))
    mid = (F.col("x") + F.col("end_x")) / 2
    away = F.array_min(F.transform("cols_", lambda c: F.struct(F.when((mid >= c["x0"]) & (mid < c["x1"]), -1.0).otherwise(F.least(F.abs(mid - c["x0"]), F.abs(mid - c["x1"]))).alias("d"), c["col_no"].alias("n"))))
    return frags.join(listed, by, "left").withColumn("col_no", F.coalesce(away["n"], F.lit(1))).drop("cols_")


def paragraphs(lines: DataFrame, by: list[str]) -> DataFrame:
    """Paragraphs of each page (or column): by, ``par_no``, text, n_lines and bounds.

    One begins at a gap of over 1.6 times the page's upper median gap, or where the size grows by over 1.3 or shrinks below 0.7.
    """
    w = Window.partitionBy(*by).orderBy("line_no")
    gaps = lines.withColumn("gap_", F.lag("y").over(w) - F.col("y"))
    typical = upper_median(gaps, by, "gap_", "typical_")
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(12.0)
    marked = gaps.join(typical, by, "left").withColumn("fs_", size)
    runs = sessions(marked, by, ["line_no"], lambda lag: ((F.coalesce("typical_", F.lit(0.0)) > 0) & (F.col("gap_") > 1.6 * F.col("typical_"))) | (F.col("fs_") > 1.3 * lag("fs_")) | (F.col("fs_") < 0.7 * lag("fs_")), "par_no")
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda t: trim(t["text"])), lambda t: F.length(t) > 0)
    return runs.groupBy(*by, "par_no").agg(F.array_join(texts, " ").alias("text"), F.count("*").alias("n_lines"), *(f(c).alias(c) for f, c in ((F.min, "llx"), (F.min, "lly"), (F.max, "urx"), (F.max, "ury"))))


def page_paragraphs(frags: DataFrame, by: list[str], width: Column) -> DataFrame:
    """Paragraphs of a page's columns, from left to right: by, col_no, par_no, text, n_lines, bounds."""
    placed = in_columns(frags, columns(frags, by, width), by)
    keys = [*by, "col_no"]
    return paragraphs(assemble(with_lines(placed, keys), keys), keys)


def nest_depth(x: Column, left: Column, step: float = 18.0, slack: float = 6.0) -> Column:
    """How deep a list item is nested by its indent."""
    return F.greatest(F.lit(0), F.floor((x - left + slack) / step)).cast("int")



#: Noncharacters that no text holds, around matches.
_MARKS = ("\uFDD0", "\uFDD1")
MATCHES = "line_no int, match_no int, match string, llx double, lly double, urx double, ury double"


def search(lines: DataFrame, by: list[str], pattern: str, ignore_case: bool = False) -> DataFrame:
    """Matches of a regular expression within lines, with their boxes: by, then ``MATCHES``.

    The ends of a match lie inside their fragments in proportion to the characters. Matches are found by the engine
    that ``text.search`` has; boxes alone are worked out in Python. Empty matches are dropped; lines without a match aren't handed on.
    """
    from foliospark.operators.text import compile_pattern

    compiled = compile_pattern(pattern, True, ignore_case)
    marked = F.regexp_replace("text", f"({compiled})" if not compiled.startswith("(?d") else compiled[: compiled.index(")") + 1] + f"({compiled[compiled.index(')') + 1:]})", f"{_MARKS[0]}$1{_MARKS[1]}")
    rows = lines.where(F.col("text").rlike(compiled)).select(*by, "line_no", F.split(marked, f"[{''.join(_MARKS)}]", -1).alias("parts"), "fragments")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(by)]), MATCHES])
    names = [*by, *(c.split()[0] for c in MATCHES.split(", "))]

    def boxes(text: str, fragments: list[dict]) -> list[tuple]:
        edges, at = [], 0  # of each character: left, right, bottom, top
        for f in fragments:
            gap = text.startswith(" ", at) and not f["text"].startswith(" ") and text[at + 1 : at + 1 + len(f["text"])] == f["text"]
            if gap:
                left = edges[-1][1] if edges else f["x"]
                edges.append((left, f["x"], f["y"], f["y"] + f["size"]))
                at += 1
            wide = f["width"] / max(1, len(f["text"]))
            edges += [(f["x"] + k * wide, f["x"] + (k + 1) * wide, f["y"], f["y"] + f["size"]) for k in range(len(f["text"]))]
            at += len(f["text"])
        return edges

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 4]
        for b in batches:
            at, out = [], []
            for k, (no, parts, fragments) in enumerate(zip(*(b.column(len(by) + i).to_pylist() for i in range(3)))):
                edges, start, nth = boxes("".join(parts), fragments), 0, 0
                for odd, part in enumerate(parts):
                    start += len(part)
                    if odd % 2 == 0 or not part:
                        continue
                    e, nth = edges[start - len(part) : start], nth + 1
                    at.append(k)
                    out.append((no, nth, part, min(x[0] for x in e), min(x[2] for x in e), max(x[1] for x in e), max(x[3] for x in e)))
            if out:
                keys = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns[: len(by)], *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=names)

    return rows.mapInArrow(run, schema)


def search_annotations(annotations: DataFrame, by: list[str], pattern: str, ignore_case: bool = False) -> DataFrame:
    """Matches in annotations' contents, each with its annotation's box: by, match_no, match, llx, lly, urx, ury."""
    from foliospark.operators.text import compile_pattern

    hits = F.regexp_extract_all("contents", F.lit(compile_pattern(pattern, True, ignore_case)), F.lit(0))
    out = annotations.select(*by, "llx", "lly", "urx", "ury", F.posexplode(hits).alias("k_", "match"))
    return out.select(*by, (F.col("k_") + 1).alias("match_no"), "match", "llx", "lly", "urx", "ury")
