"""Tables without rulings, by windows: lines in cells, runs of lines, and what keeps a run from being a table.

All of a page's lines, cells, runs and columns are rows of tables, and each guard is a condition on sums over a run. Windows
and groups are those of a page and smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators import spatial
from foliospark.operators.graph import _checkpoint as checkpointed
from foliospark.operators.rows import mode, sessions
from foliospark.operators.text import trim

#: Least gap between cells in points and in mean sizes; the most that lines of a run are apart in sizes; least lines; most columns. Fixed values.
CELL_GAP, CELL_SIZES, LINE_GAP, LEAST_LINES, MOST_COLUMNS = 4.0, 0.56, 2.6, 3, 15
#: A marker of a list's item, and names of fonts with letters of one width. Fixed values.
MARKER, MONO = r"^(?:[•‣◦▪·–*-]|\d{1,3}[.)])", "Courier|Mono|Consol"


def cells(frags: DataFrame, by: list[str]) -> DataFrame:
    """Lines of each page, from the top, parted into cells at wide gaps: by, ``line``, ``cell`` (both from 1), lo, hi, text.

    Fragments are (by, seq, x, y, end_x, size, font, text); blank ones are left out. A line ends where the height moves by more than a point and three tenths
    of the size; a cell begins at a gap, from all that stands before it in the line, of four points and 0.56 of the mean size of both sides.
    """
    return _cells(_parted(frags, by), by)


def _parted(frags: DataFrame, by: list[str]) -> DataFrame:
    """Fragments with the line and the cell that they stand in."""
    some = frags.where(F.length(trim(F.col("text"))) > 0).withColumn("row_", -F.bround(F.col("y") * 2))
    lined = sessions(some, by, ["row_", "x", "seq"], lambda lag: F.abs(F.col("y") - lag("y")) > F.greatest(F.lit(1.0), 0.3 * F.col("size")), "line")
    w = Window.partitionBy(*by, "line").orderBy("x", "row_", "seq")
    reach = F.max("end_x").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = reach.isNull() | (F.col("x") - reach >= F.greatest(F.lit(CELL_GAP), CELL_SIZES * (F.col("size") + F.lag("size").over(w)) / 2))
    marked = lined.withColumns({"starts_": F.when(starts, 1).otherwise(0), "nth_": F.row_number().over(w)})
    return marked.withColumn("cell", F.sum("starts_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts_")


def _cells(parted: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by, "line", "cell").orderBy("row_", "x", "nth_")
    before, end = F.lag("y").over(w), F.lag("end_x").over(w)
    led = F.when(F.abs(F.col("y") - before) > F.greatest(F.lit(1.0), 0.3 * F.col("size")), "\n").when(F.col("x") - end > 0.15 * F.col("size"), " ").otherwise("")
    pieces = parted.withColumns({"led_": F.concat(F.coalesce(led, F.lit("")), "text"), "at_": F.row_number().over(w)})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at_", "led_"))), lambda p: p["led_"]), "")
    return pieces.groupBy(*by, "line", "cell").agg(F.min("x").alias("lo"), F.max("end_x").alias("hi"), trim(joined).alias("text"))


def _lines(parted: DataFrame, by: list[str]) -> DataFrame:
    """by, line, y, size (of most characters, the greater on ties), cells, chars, mono, leader."""
    halves = parted.withColumn("half_", F.floor(F.col("size") * 2 + 0.5) / 2)
    size = mode(halves, [*by, "line"], "half_", F.length("text"), high=True, out="size").drop("n")
    mono = F.when(F.col("font").rlike(MONO), F.length("text")).otherwise(0)
    rows = parted.groupBy(*by, "line").agg(F.min_by("y", "nth_").alias("y"), F.max("cell").alias("cells"), F.sum(F.length("text")).alias("chars"), F.sum(mono).alias("mono"), F.max(F.col("text").contains(".....")).alias("leader"))
    return rows.join(size, [*by, "line"])


def runs(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines of two cells or more with the ``run`` they are in: neighbours, one below the other, no further apart than 2.6 times the larger size."""
    def breaks(lag) -> Column:
        gap = lag("y") - F.col("y")
        return (F.col("cells") < 2) | (lag("cells") < 2) | ~((gap > 0) & (gap <= LINE_GAP * F.greatest(lag("size"), F.col("size"))))

    return sessions(lines, by, ["line"], breaks, "run").where("cells >= 2")


def tables(frags: DataFrame, by: list[str], rules: DataFrame | None = None, ruled: DataFrame | None = None) -> DataFrame:
    """The cells of borderless tables: by, ``table_no`` from the top and then the left, llx, lly, urx, ury, signature, row, col (from 0), text.

    A run is a table if three lines or more have its usual number of cells, of 2 to 15; lines before the first and after the last of these
    go. Its columns span their cells in those lines and lie apart, and each border between them is crossed in few lines. These are no
    tables: dot leaders, more than three sizes, a horizontal rule (``rules``: by, vertical, pos, lo, hi) for each line or so but not quite,
    numbered lines, lists by their markers, columns of prose, contents, code, and few lines amid flowing text. Fragments inside
    ``ruled`` tables (by, box) are left out. Lines, cells and runs are checkpointed, since many sums are made of them.
    """
    if ruled is not None:
        numbered = frags.withColumn("at_", F.struct("x", "y"))
        points = numbered.select(*by, F.col("x").alias("px_"), F.col("y").alias("py_")).distinct()
        boxes = ruled.select(*by, *(F.col(c).alias(f"{c}_r_") for c in spatial.BOX))
        held = spatial.meets(points, boxes, ("px_", "py_", "px_", "py_"), tuple(f"{c}_r_" for c in spatial.BOX), by, touching=True)
        frags = numbered.join(held.select(*by, F.struct(F.col("px_").alias("x"), F.col("py_").alias("y")).alias("at_")).distinct(), [*by, "at_"], "left_anti").drop("at_")
    parted = checkpointed(_parted(frags, by))
    whole, every = checkpointed(_cells(parted, by)), checkpointed(_lines(parted, by))
    key = [*by, "run"]
    rows = runs(every, by)

    usual = mode(rows, key, "cells", high=True, out="modal").where((F.col("n") >= LEAST_LINES) & F.col("modal").between(2, MOST_COLUMNS)).drop("n")
    rows = rows.join(usual, key).withColumn("full", F.col("cells") == F.col("modal"))
    ends = rows.where("full").groupBy(*key).agg(F.min("line").alias("from_"), F.max("line").alias("to_"))
    rows = checkpointed(rows.join(ends, key).where("line BETWEEN from_ AND to_").drop("from_", "to_"))
    sums = rows.groupBy(*key, "modal").agg(
        F.count("*").alias("n"), F.count_if("full").alias("n_full"), F.count_if("leader").alias("leaders"), F.sum("mono").alias("mono"), F.sum("chars").alias("chars"),
        (F.max_by(F.col("y") + F.col("size"), -F.col("line"))).alias("ury"), F.max_by("y", "line").alias("lly"),
    ).where(F.col("n") >= LEAST_LINES)

    inside = checkpointed(rows.select(*key, "line", "full", "modal").join(whole, [*by, "line"]))
    full = inside.where("full").withColumn("col", F.col("cell") - 1)
    words = F.size(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)))
    ranked = full.withColumns({"words_": words, "rank_": F.row_number().over(Window.partitionBy(*key, "col").orderBy(words)), "of_": F.count("*").over(Window.partitionBy(*key, "col"))})
    columns = ranked.groupBy(*key, "col").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.when(F.expr("rank_ = div(of_, 2) + 1"), F.col("words_"))).alias("words"),
        F.count_if(F.col("text").rlike(MARKER)).alias("marked"), F.count_if(F.col("text").rlike(r"\A[1-9]\d{0,3}\z")).alias("numbers"), F.count_if(F.col("text").rlike(r"\A\d+\z")).alias("digits"),
    )
    w = Window.partitionBy(*key).orderBy("col")
    columns = columns.withColumn("next_", F.lead("lo").over(w))
    borders = columns.where("next_ IS NOT NULL").select(*key, "col", ((F.col("hi") + F.col("next_")) / 2).alias("border"))
    crossed = inside.join(borders.drop("col"), key).groupBy(*key, "border", "line").agg(F.max((F.col("lo") - 0.5 < F.col("border")) & (F.col("border") < F.col("hi") + 0.5)).alias("crosses"))
    crossed = crossed.groupBy(*key, "border").agg(F.count_if(~F.col("crosses")).alias("clear_")).groupBy(*key).agg(F.min("clear_").alias("clear"))
    shape = columns.groupBy(*key).agg(
        F.min("lo").alias("llx"), F.max("hi").alias("urx"), F.max(F.coalesce(F.col("next_") <= F.col("hi") + 1, F.lit(False))).alias("overlaps"),
        F.min("words").alias("least_words"), F.max(F.when(F.col("col") == 0, F.col("words"))).alias("words_0"), F.max(F.when(F.col("col") == 1, F.col("words"))).alias("words_1"),
        F.max(F.when(F.col("col") == 0, F.col("marked"))).alias("marked"), F.max(F.when(F.col("col") == 0, F.col("digits"))).alias("digits"), F.max(F.when(F.col("col") == 1, F.col("numbers"))).alias("numbers"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("next_").isNotNull(), (F.col("hi") + F.col("next_")) / 2))), lambda x: x).alias("borders"),
    )

    first = full.where("col = 0 AND modal = 2").withColumn("before_", F.lag("text").over(Window.partitionBy(*key).orderBy("line")))
    steps = first.groupBy(*key).agg(F.count_if(F.col("before_").isNotNull() & (F.expr("try_cast(text AS decimal(38,0))") != F.expr("try_cast(before_ AS decimal(38,0)) + 1"))).alias("jumps"))
    pairs = full.where("modal = 2").groupBy(*key, "line").agg(F.concat_ws(" ", F.max(F.when(F.col("col") == 0, F.col("text"))), F.max(F.when(F.col("col") == 1, F.col("text")))).alias("t"))
    pairs = pairs.groupBy(*key).agg(F.count_if(F.octet_length("t") >= 25).alias("long_"), F.count_if(F.col("t").rlike(r"(?:^|\s)\d+$")).alias("paged"))
    halves = parted.join(rows.select(*key, "line"), [*by, "line"]).groupBy(*key, (F.floor(F.col("size") * 2 + 0.5) / 2).alias("half_")).agg(F.sum(F.length("text")).alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy(*key).orderBy(F.col("n_").desc(), "half_").rowsBetween(Window.unboundedPreceding, -1))
    halves = halves.withColumns({"upto_": F.coalesce(upto, F.lit(0)), "all_": F.sum("n_").over(Window.partitionBy(*key))})
    kinds = halves.groupBy(*key).agg(F.count_if(F.col("upto_") < 0.9 * F.col("all_")).alias("sizes"))

    found = sums.join(shape, key).join(crossed, key, "left").join(kinds, key).join(steps, key, "left").join(pairs, key, "left")
    two, share = F.col("modal") == 2, lambda c, s: F.col(c) >= s * F.col("n_full")
    refused = (
        F.col("overlaps") | (F.coalesce("clear", F.col("n")) < 0.85 * F.col("n")) | (F.col("leaders") >= 0.3 * F.col("n")) | (F.col("sizes") > 3)
        | (two & (F.col("digits") == F.col("n_full")) & (F.coalesce("jumps", F.lit(0)) == 0)) | share("marked", 0.7) | (F.col("least_words") >= 4) | (two & (F.col("words_1") >= 4))
        | (two & share("long_", 0.6) & share("paged", 0.6)) | (two & share("numbers", 0.7) & (F.col("words_0") >= 3)) | (two & (F.col("mono") >= 0.8 * F.col("chars")))
    )
    found = found.where(~F.coalesce(refused, F.lit(False)))
    if rules is not None:
        wide = 0.5 * (F.col("urx") - F.col("llx"))
        level = rules.where(~F.col("vertical")).select(*(F.col(c).alias(f"{c}_h_") for c in by), "pos", F.col("lo").alias("lo_h_"), F.col("hi").alias("hi_h_"))
        near = (F.col("pos") >= F.col("lly") - 2) & (F.col("pos") <= F.col("ury") + 2) & (F.least("hi_h_", "urx") - F.greatest("lo_h_", "llx") > wide)
        counted = found.join(level, [F.col(c) == F.col(f"{c}_h_") for c in by] + [near]).groupBy(*key).agg(F.count("*").alias("ruled_"))
        found = found.join(counted, key, "left")
        ratio = F.col("n") / F.nullif(F.col("ruled_") - 1, F.lit(0))
        found = found.where(~F.coalesce((F.col("ruled_") >= 3) & ~((ratio > 0.65) & (ratio < 1.5)), F.lit(False)))
    single = every.where("cells = 1").join(whole.select(*by, "line", "lo", "hi"), [*by, "line"])
    share_of = every.groupBy(*by).agg((F.count_if(F.col("cells") == 1) >= 0.7 * F.count("*")).alias("flowing_"))
    over = single.select(*(F.col(c).alias(f"{c}_s_") for c in by), F.col("y").alias("y_s_"), F.col("size").alias("size_s_"), F.col("lo").alias("lo_s_"), F.col("hi").alias("hi_s_"))
    within = (F.col("y_s_") >= F.col("lly")) & (F.col("y_s_") <= F.col("ury"))
    covered = found.join(over, [F.col(c) == F.col(f"{c}_s_") for c in by] + [within]).groupBy(*key).agg(F.sum(F.greatest(F.lit(0.0), F.least("hi_s_", "urx") - F.greatest("lo_s_", "llx")) * F.col("size_s_")).alias("prose_"))
    found = found.join(share_of, by).join(covered, key, "left")
    prose = F.col("flowing_") & (F.coalesce("prose_", F.lit(0.0)) >= 0.8 * (F.col("urx") - F.col("llx")) * (F.col("ury") - F.col("lly")))
    found = found.where(~prose)

    edges = F.concat(F.array("llx"), "borders", F.array("urx"))
    signature = F.array_join(F.transform(edges, lambda x: F.floor((x - F.col("llx")) / 3 + 0.5).cast("int").cast("string")), ";")
    placed = found.withColumns({"signature": signature, "table_no": F.row_number().over(Window.partitionBy(*by).orderBy(F.col("ury").desc(), "llx", "run"))})
    placed = placed.select(*key, "table_no", *spatial.BOX, "signature", "borders")
    slots = inside.select(*key, "line", "cell", "lo", "hi", "text").join(placed, key)
    slots = slots.withColumns({"col": F.size(F.filter("borders", lambda x: x <= (F.col("lo") + F.col("hi")) / 2)), "row": F.dense_rank().over(Window.partitionBy(*key).orderBy("line")) - 1})
    texts = F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"])
    return slots.groupBy(*by, "table_no", *spatial.BOX, "signature", "row", "col").agg(F.array_join(texts, " ").alias("text"))
