"""Operations on ordered sets of pages. Positions count from 1 within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.text import alphabetic, roman


def number_pages(df: DataFrame, by: list[str], order: list[str], out: str = "page_no") -> DataFrame:
    """Numbers the pages of each document; a document is never larger than a task, so the window is partitioned by it."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def extract(df: DataFrame, ranges: list[tuple[int, int]], page_no: str = "page_no") -> DataFrame:
    """Pages of inclusive ranges, in the ranges' order; overlaps repeat. Adds ``new_no``."""
    spark = df.sparkSession
    total = 0
    rows = []
    for first, last in ranges:
        if first < 1 or last < first:
            raise ValueError(f"bad range {first}-{last}")
        rows.append((first, last, total))
        total += last - first + 1
    wanted = spark.createDataFrame(rows, "first int, last int, before int")
    # A row a range: the list is the caller's, not the data's.
    return df.join(F.broadcast(wanted), F.col(page_no).between(F.col("first"), F.col("last"))).withColumn("new_no", F.col("before") + F.col(page_no) - F.col("first") + 1).drop("first", "last", "before")


def reorder(df: DataFrame, order: list[int], page_no: str = "page_no") -> DataFrame:
    """Pages in the given order; pages may repeat or be left out. Adds ``new_no``."""
    wanted = df.sparkSession.createDataFrame([(p, k + 1) for k, p in enumerate(order)], "wanted int, new_no int")
    return df.join(F.broadcast(wanted), F.col(page_no) == F.col("wanted")).drop("wanted")


def delete(df: DataFrame, pages: list[int], by: list[str], page_no: str = "page_no", keep_one: bool = False) -> DataFrame:
    """Without the given pages (repeats don't matter), numbered anew in ``new_no``.

    With ``keep_one``, a document that would lose all its pages, or has fewer than a given number, is an error as the job runs.
    """
    gone = F.col(page_no).isin(*set(pages)) if pages else F.lit(False)
    if keep_one and pages:
        w = Window.partitionBy(*by)
        bad = F.when(F.max(page_no).over(w) < max(pages), "no such page").when(F.count_if(~gone).over(w) == 0, "a document must keep a page")
        df = df.withColumn("bad_", bad).where(F.when(F.col("bad_").isNotNull(), F.raise_error(F.col("bad_")).cast("boolean")).otherwise(True)).drop("bad_")
    kept = df.where(~gone)
    return number_pages(kept, by, [page_no], "new_no")


def rotate(rotation: Column, by: int) -> Column:
    """The rotation turned by a multiple of 90 degrees, 0 to 359."""
    if by % 90:
        raise ValueError("pages turn by multiples of 90 degrees")
    return F.pmod(rotation + by, F.lit(360))


def append(first: DataFrame, second: DataFrame, id_col: str) -> DataFrame:
    """Both tables' rows; ids of the second are moved beyond those of the first."""
    offset = first.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).alias("offset_"))
    moved = second.crossJoin(F.broadcast(offset)).withColumn(id_col, F.col(id_col) + F.col("offset_")).drop("offset_")  # one row
    return first.unionByName(moved)


def n_up(page_no: Column, rows: int, cols: int, column_major: bool = False) -> dict[str, Column]:
    """Sheet, row and column, from 0, of each page."""
    i = page_no - 1
    cell = i % (rows * cols)
    row, col = (cell % rows, F.floor(cell / rows)) if column_major else (F.floor(cell / cols), cell % cols)
    return {"sheet": F.floor(i / (rows * cols)).cast("long"), "sheet_row": row.cast("long"), "sheet_col": col.cast("long")}


def booklet(page_no: Column, count: Column, right_bound: bool = False) -> dict[str, Column]:
    """The sheet side, from 0, and half on which a page lies when its document is folded."""
    padded = 4 * F.ceil(count / 4)
    side = F.least(page_no - 1, padded - page_no)
    low = page_no <= padded / 2
    left = (low & (side % 2 == 1)) | (~low & (side % 2 == 0))
    return {"side": side.cast("long"), "half": F.when(left != F.lit(right_bound), "left").otherwise("right")}


def labels(df: DataFrame, ranges: list[tuple[int, str | None, str, int]], page_no: str = "page_no") -> DataFrame:
    """``label`` of every page: the last range in the list whose first index (from 0) isn't beyond the page.

    ranges: first index, style (D, r, R, a, A or None for the prefix alone), prefix, first number.
    Pages before any range have no style. Without ranges, labels are page numbers.
    """
    index = F.col(page_no) - 1
    if not ranges:
        return df.withColumn("label", F.col(page_no).cast("string"))
    label = F.lit("")
    for first, style, prefix, start in ranges:
        n = index - first + max(1, start)
        made = {"D": n.cast("string"), "r": roman(n), "R": F.upper(roman(n)), "a": alphabetic(n), "A": F.upper(alphabetic(n))}.get(style, F.lit(""))
        label = F.when(index >= first, F.concat(F.lit(prefix), made)).otherwise(label)
    return df.withColumn("label", label)
