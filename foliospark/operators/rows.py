"""Relational operators of layout analysis: gaps and islands, intervals, nearest and as-of matches, modes, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Partitions up to which a shuffle writes each row at once to its partition's file; for more it holds a task's whole input.
WRITTEN = 200


def dealt(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``df`` in partitions by ``keys``, one for each ``least`` rows, which are counted, but one a core at least.

    So what a task holds stays as it is while the input grows, and work that costs far more than its bytes isn't put on few cores.
    More than ``WRITTEN`` partitions are made in two steps, the first of as many, so that a task that writes many holds but its share.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // least))
    if n > WRITTEN:  # the column keeps the two steps apart
        df = df.withColumn("deal_", F.xxhash64(*keys)).repartition(WRITTEN, "deal_").drop("deal_")
    return df.repartition(n, *keys)


def sessions(df: DataFrame, by: list[str], order: list[str], breaks, out: str = "run_no") -> DataFrame:
    """Numbers runs from 1: a row begins a run where ``breaks(lag)`` holds; ``lag(column)`` gives the row before's value."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.coalesce(breaks(lambda c: F.lag(c).over(w)), F.lit(True))
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merge_intervals(df: DataFrame, by: list[str], lo: str, hi: str, gap: float = 0.0, least: float = 0.0) -> DataFrame:
    """Spans that overlap or are up to ``gap`` apart become one; those shorter than ``least`` go. Returns by, lo, hi, ``n``."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    reached = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = reached.isNull() | (F.col(lo) > reached + gap)
    marked = df.withColumn("starts_", F.when(starts, 1).otherwise(0))
    marked = marked.withColumn("run_", F.sum("starts_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*by, "run_").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n"))
    return out.where(F.col(hi) - F.col(lo) >= least).drop("run_")


def upper_median(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """The upper middle value of each group, by rank: no list of a group is held."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(w.orderBy(value)).alias("r_"), F.count("*").over(w).alias("n_"))
    return ranked.where("r_ = div(n_, 2) + 1").select(*by, F.col(value).alias(out))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, out: str = "median") -> DataFrame:
    """The first value at which twice the weights so far reach the total. Equal values are summed first."""
    w = Window.partitionBy(*by)
    summed = df.where(F.col(weight) > 0).groupBy(*by, value).agg(F.sum(weight).alias("w_"))
    upto = F.sum("w_").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumns({"upto_": upto, "all_": F.sum("w_").over(w)}).where("2 * upto_ >= all_").groupBy(*by).agg(F.min(value).alias(out))


def mode(df: DataFrame, by: list[str], value: str, weight: Column | None = None, high: bool = True, out: str = "mode") -> DataFrame:
    """The value of most rows, or most weight, of each group; of ties, the highest or the lowest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("n_"))
    best = F.max(F.struct("n_", value)) if high else F.min(F.struct((-F.col("n_")).alias("n_"), value))
    return counts.groupBy(*by).agg(best.alias("b_")).select(*by, F.col(f"b_.{value}").alias(out), F.abs("b_.n_").alias("n"))


def nearest(df: DataFrame, value: str, marks: DataFrame, mark: str, tolerance: float | None = None, last: bool = False) -> DataFrame:
    """Adds the nearest row of ``marks`` (few: the caller's grid), within ``tolerance``; of ties, the first or the last mark."""
    listed = [r[0] for r in marks.select(mark).distinct().orderBy(mark).limit(10_001).collect()]
    if len(listed) > 10_000:
        raise ValueError("nearest() matches against at most 10,000 marks; bucket the marks and join by bucket")
    grid = F.array(*(F.lit(float(m)) for m in listed))
    away = F.transform(grid, lambda m: F.struct(F.abs(F.col(value) - m).alias("d"), (-m if last else m).alias("tie"), m.alias("m")))
    best = F.array_min(away)
    near = best["m"] if tolerance is None else F.when(best["d"] <= tolerance, best["m"])
    return df.withColumn("nearest", near)


#: Rows of a table that are looked through for each row instead of being put in one order with them.
FEW = 64


def as_of(df: DataFrame, at: str, table: DataFrame, key: str, values: list[str], by: list[str] | None = None, buckets: int = 256, few: int = FEW) -> DataFrame:
    """Adds ``values`` of the last row of ``table`` with ``key`` not beyond ``at``, within ``by``; null before the first.

    A table of up to ``few`` rows, which are counted, is told to all tasks as a sorted list for each ``by``. Of a larger one,
    both sides are put in one order and the last known values are carried on, so there is no range join. Keys are cut
    into ranges of about equal numbers of rows, each ordered by itself, and what is known at a range's end goes on to
    those behind it: no task holds a whole group, and a value that fills several ranges is dealt to as many, since all its rows find the same. Of
    equal keys, the row with the greatest values holds. The result is the same either way.
    """
    by = by or []
    known = F.struct(*(F.col(v) for v in values))
    some = table.where(F.col(key).isNotNull())
    if some.limit(few + 1).count() <= few:
        listed = some.groupBy(*(F.col(c).alias(f"{c}_by_") for c in by)).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), known.alias("v")))).alias("known_"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}_by_")) for c in by]
        both = df.join(F.broadcast(listed), same or F.lit(True), "left")
        upto = F.filter("known_", lambda x: x["k"] <= F.col(at))
        best = F.try_element_at(upto, F.lit(-1))["v"]
        return both.withColumn("best_", best).select(*(f"`{c}`" for c in df.columns), *(F.col(f"best_.{v}").alias(v) for v in values))
    numeric = buckets > 1 and df.schema[at].dataType.simpleString() not in ("string", "binary")
    cuts = sorted(df.select(F.col(at).cast("double").alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.25 / buckets)) if numeric else []
    ends = sorted(set(cuts))
    times = [cuts.count(e) for e in ends]
    listed = F.array(*map(F.lit, ends)) if ends else None  # one number a range
    wide = 16

    def bucket(k: str) -> Column:
        """How many ends lie below: first by steps of 16, then among 16."""
        if not ends:
            return F.lit(0)
        value = F.col(k).cast("double")
        coarse = F.size(F.filter(F.array(*map(F.lit, ends[::wide])), lambda e: e < value))
        start = F.greatest(coarse - 1, F.lit(0)) * wide
        return start + F.size(F.filter(F.slice(listed, start + 1, F.lit(wide)), lambda e: e < value))

    most = max(times, default=1) + 1
    here = df.select(*by, F.col(at).alias("k_"), bucket(at).alias("b_"), F.lit(1).alias("side_"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row_"), F.lit(None).cast(table.select(known.alias("v")).schema["v"].dataType).alias("v_"))
    salt = F.lit(0)
    if most > 2:  # rows of a value that fills several ranges: the bucket ends with it, so what they find is known at its end
        own = F.try_element_at(F.array(*map(F.lit, times)), F.col("b_") + 1)
        salt = F.when(F.col("k_").cast("double") == F.try_element_at(listed, F.col("b_") + 1), F.pmod(F.xxhash64("row_"), own)).otherwise(0)
    here = here.withColumn("b_", (F.col("b_") * most + salt).cast("bigint"))
    there = some.select(*by, F.col(key).alias("k_"), (bucket(key) * most).cast("bigint").alias("b_"), F.lit(0).alias("side_"), F.lit(None).cast(here.schema["row_"].dataType).alias("row_"), known.alias("v_"))
    ends_of = there.groupBy(*by, "b_").agg(F.max(F.struct("k_", "v_")).alias("e_"))
    steps = here.select(*by, "b_").distinct().withColumn("e_", F.lit(None).cast(ends_of.schema["e_"].dataType)).unionByName(ends_of)
    steps = steps.groupBy(*by, "b_").agg(F.max("e_").alias("e_"))
    over = Window.partitionBy(*by).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = steps.withColumn("e_", F.last("e_", ignorenulls=True).over(over)).select(*(F.col(c).alias(f"{c}_by_") for c in by), F.col("b_").alias("b_of_"), F.col("e_.v_").alias("first_"))
    w = Window.partitionBy(*by, "b_").orderBy("k_", "side_", "v_").rowsBetween(Window.unboundedPreceding, 0)
    own = here.unionByName(there).withColumn("c_", F.last("v_", ignorenulls=True).over(w)).where("side_ = 1")
    found = own.join(before, [own[c].eqNullSafe(before[f"{c}_by_"]) for c in by] + [F.col("b_") == F.col("b_of_")], "left")
    value = F.when(F.col("k_").isNotNull(), F.coalesce("c_", "first_"))
    return found.withColumn("c_", value).select("row_.*", *(F.col(f"c_.{v}").alias(v) for v in values))


def majority(df: DataFrame, by: list[str], holds: Column, out: str = "majority") -> DataFrame:
    """Whether a condition holds for more than half of each group's rows."""
    return df.groupBy(*by).agg((2 * F.count_if(holds) > F.count("*")).alias(out))


def gutters(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int, least: int = 1, wide: int = 2) -> DataFrame:
    """Runs of ``wide`` or more bins with under ``least`` rows between the first and last occupied ones: by, first_bin, last_bin.

    Only occupied bins are rows: a gutter is the distance from one to the next.
    """
    width = (hi - lo) / bins
    binned = df.where(F.col(value).between(lo, hi)).withColumn("bin_", F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)))
    full = binned.groupBy(*by, "bin_").count().where(F.col("count") >= least)
    w = Window.partitionBy(*by).orderBy("bin_")
    gaps = full.withColumn("before_", F.lag("bin_").over(w)).where(F.col("bin_") - F.col("before_") - 1 >= wide)
    return gaps.select(*by, (F.col("before_") + 1).cast("long").alias("first_bin"), (F.col("bin_") - 1).cast("long").alias("last_bin"))


def overlaps(df: DataFrame, x0: str, y0: str, x1: str, y1: str, regions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows with each of the ``regions`` (region_id, llx, lly, urx, ury) that they overlap by a positive area, found by their place and the keys ``by``."""
    from foliospark.operators import spatial

    return spatial.meets(df, regions, (x0, y0, x1, y1), by=by)


def cell_of(df: DataFrame, x: str, y: str, xs: list[float], ys: list[float]) -> DataFrame:
    """Adds ``cell_col`` and ``cell_row``, from 0, of a grid with the given edges; null outside. The upper edge belongs to the next cell."""
    def slot(value: Column, edges: list[float]) -> Column:
        n = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
        return F.when((n >= 0) & (n < len(edges) - 1), n)

    return df.withColumns({"cell_col": slot(F.col(x), xs), "cell_row": slot(F.col(y), ys)})


def canonical(df: DataFrame, id_col: str, signature: Column) -> DataFrame:
    """Adds ``keep_id``, the least id of the rows with the same signature. The least is found before the join, so a hot group is one row there."""
    signed = df.withColumn("sig_", signature)
    least = signed.groupBy("sig_").agg(F.min(id_col).alias("keep_id"))
    return signed.join(least, "sig_").drop("sig_")


def repeated_lines(df: DataFrame, by: str, id_col: str, text_col: str, share: float = 0.5, least: int = 3, most_chars: int = 120) -> DataFrame:
    """Lines, with digits masked, that stand in at least ``least`` rows and more than ``share`` of a group's: by, key, n."""
    key = F.regexp_replace(F.trim(F.regexp_replace("line", r"\s+", " ")), r"\d+", "#")
    from foliospark.operators.text import lines

    totals = df.groupBy(by).agg(F.count("*").alias("rows_"))
    keyed = lines(df.select(by, id_col, text_col).withColumn("both_", F.struct(by, id_col)), "both_", text_col)
    keyed = keyed.select(F.col(f"both_.{by}").alias(by), F.col(f"both_.{id_col}").alias(id_col), key.alias("key")).where((F.length("key") > 0) & (F.length("key") <= most_chars)).distinct()
    counted = keyed.groupBy(by, "key").agg(F.count("*").alias("n"))
    return counted.join(totals, by).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("rows_") * share) + 1)).drop("rows_")


def stitch(df: DataFrame, by: list[str], page: str, signature: str, order: list[str]) -> DataFrame:
    """Tables on consecutive pages with the same signature belong together: adds ``table_group`` from 1."""
    return sessions(df, by, order, lambda lag: (F.col(page) != lag(page) + 1) | (F.col(signature) != lag(signature)), "table_group")


def cluster_rects(df: DataFrame, by: list[str], gap: float = 0.0) -> DataFrame:
    """Rectangles whose bounds, grown by ``gap``, meet become one, until none meet: by, llx, lly, urx, ury, ``n``.

    A page is of one task, and of one batch of pages that are handed over together. What has grown may meet others, so this
    isn't a matter of components; any order of merging ends in the same boxes.
    """
    names = ("llx", "lly", "urx", "ury")
    whole = df.select(*by, F.array(*(F.col(c).cast("double") for c in names)).alias("b_")).where(F.forall("b_", lambda v: v.isNotNull() & ~F.isnan(v)))
    held = whole.groupBy(*by).agg(F.collect_list("b_").alias("boxes_"))

    @F.udf("array<struct<llx:double,lly:double,urx:double,ury:double,n:bigint>>", useArrow=True)
    def merged(boxes):
        found: list[tuple] = []
        for x0, y0, x1, y1 in boxes:
            n = 1
            while True:
                apart = []
                for f in found:
                    if f[0] - gap <= x1 and f[1] - gap <= y1 and x0 - gap <= f[2] and y0 - gap <= f[3]:
                        x0, y0, x1, y1, n = min(x0, f[0]), min(y0, f[1]), max(x1, f[2]), max(y1, f[3]), n + f[4]
                    else:
                        apart.append(f)
                if len(apart) == len(found):
                    break
                found = apart
            found.append((x0, y0, x1, y1, n))
        return found

    return held.select(*by, F.inline(merged("boxes_")))
