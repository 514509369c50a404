"""Changes to layers of a document, as new tables: setting, adding, removing, moving rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators import spatial
from foliospark.operators.rows import merge_intervals


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with the columns set where the condition holds."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` and new rows; columns that they lack are null."""
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def remove(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def merge(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Sets the columns of ``changes`` on rows with the same keys; nulls leave a value as it is, unknown keys are ignored."""
    new = changes.select(*keys, *(F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys))
    out = df.join(new, keys, "left")
    return out.select(*(F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in new.columns else F.col(c) for c in df.columns))


def overlapping(df: DataFrame, region: tuple[float, float, float, float]) -> Column:
    """Whether a row's box (llx, lly, urx, ury) overlaps a region by a positive area."""
    x0, y0, x1, y1 = region
    return (F.col("llx") < x1) & (F.col("urx") > x0) & (F.col("lly") < y1) & (F.col("ury") > y0)


def redact(frags: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """Fragments outside all regions (by…, llx, lly, urx, ury): those with their middle inside one are gone."""
    mid, half = (F.col("x") + F.col("end_x")) / 2, F.col("y") + F.col("size") / 2
    numbered = frags.withColumn("mid_", F.struct(mid.alias("x"), half.alias("y")))
    places = numbered.select(*by, F.col("mid_.x").alias("mx_"), F.col("mid_.y").alias("my_")).distinct()
    r = regions.select(*by, *(F.col(c).alias(f"r_{c}") for c in spatial.BOX))
    hit = spatial.meets(places, r, ("mx_", "my_", "mx_", "my_"), tuple(f"r_{c}" for c in spatial.BOX), by, touching=True)
    hit = hit.select(*by, F.struct(F.col("mx_").alias("x"), F.col("my_").alias("y")).alias("mid_")).distinct()
    return numbered.join(hit, [*by, "mid_"], "left_anti").select(*frags.columns)


def holes(frags: DataFrame, keys: list[str], regions: DataFrame, by: list[str], extra: list[str] | None = None) -> DataFrame:
    """``keys``, ``extra`` columns of the region, and ``lo`` to ``hi``: the characters of a fragment, from 0, whose middles a region holds.

    A fragment (x, y, end_x, size, text) gives each character the same width; the middle is at half the size over the
    baseline, and edges count as inside. A fragment without a width has all characters in one place. Regions are found by their place.
    """
    extra = extra or []
    half = F.col("y") + F.col("size") / 2
    width = (F.col("end_x") - F.col("x")) / F.length("text")
    runs = frags.where((F.length("text") > 0) & (F.col("x") <= F.col("end_x"))).select(*dict.fromkeys([*by, *keys]), F.col("x").alias("x_"), F.col("end_x").alias("end_"), half.alias("half_"), width.alias("width_"), F.length("text").alias("n_"))
    r = regions.select(*by, *extra, *(F.col(c).alias(f"r_{c}") for c in spatial.BOX))
    both = spatial.meets(runs, r, ("x_", "half_", "end_", "half_"), tuple(f"r_{c}" for c in spatial.BOX), by, touching=True)
    wide = F.nullif(F.col("width_"), F.lit(0.0))
    lo = F.coalesce(F.greatest(F.lit(0), F.ceil((F.col("r_llx") - F.col("x_")) / wide - 0.5)), F.lit(0))
    hi = F.coalesce(F.least(F.col("n_") - 1, F.floor((F.col("r_urx") - F.col("x_")) / wide - 0.5)), F.col("n_") - 1)
    return both.select(*dict.fromkeys([*keys, *extra]), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")).where("lo <= hi")


def subtract(frags: DataFrame, keys: list[str], regions: DataFrame, by: list[str]) -> DataFrame:
    """What is left of each fragment outside all regions (by, llx, lly, urx, ury): its pieces, in their places, with ``piece`` from 1.

    ``keys`` tell fragments (x, y, end_x, size, text) apart. The characters that regions hold become intervals,
    overlapping ones are merged, and what lies between them stays; a fragment that no region holds stays as it is, one that is held whole
    has no rows. The regions of a fragment are merged in ranges of its own, never those of a page.
    """
    merged = merge_intervals(holes(frags, keys, regions, by), keys, "lo", "hi", gap=1)
    w = Window.partitionBy(*keys).orderBy("lo")
    edges = merged.select(*keys, F.coalesce(F.lag("hi").over(w) + 1, F.lit(0)).alias("from_"), "lo", "hi", F.lead("lo").over(w).isNull().alias("last_"))
    span = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    between = F.when(F.col("last_"), F.array(span(F.col("from_"), F.col("lo") - 1), span(F.col("hi") + 1, F.lit(2**31)))).otherwise(F.array(span(F.col("from_"), F.col("lo") - 1)))
    left = edges.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(between))).alias("left_"))
    named = left.select(*(F.col(k).alias(f"{k}_k_") for k in keys), "left_")
    own = [F.col(f"`{c}`") for c in frags.columns]
    n = F.length("text")
    cut = frags.join(named, [F.col(k) == F.col(f"{k}_k_") for k in keys], "left")
    cut = cut.withColumn("left_", F.filter(F.transform(F.coalesce("left_", F.array(span(F.lit(0), F.lit(2**31)))), lambda s: span(s["a"], F.least(s["b"], n - 1))), lambda s: (s["a"] <= s["b"]) | (n == 0)))
    cut = cut.select(*own, F.posexplode("left_").alias("nth_", "s_"))
    whole = (F.col("s_.a") == 0) & (F.col("s_.b") >= n - 1)
    width = (F.col("end_x") - F.col("x")) / F.nullif(n, F.lit(0))
    moved = {"x": F.when(whole, F.col("x")).otherwise(F.col("x") + F.col("s_.a") * width), "end_x": F.when(whole, F.col("end_x")).otherwise(F.col("x") + (F.col("s_.b") + 1) * width), "text": F.when(whole, F.col("text")).otherwise(F.substring("text", (F.col("s_.a") + 1).cast("int"), (F.col("s_.b") - F.col("s_.a") + 1).cast("int")))}
    return cut.select(*(moved[c].alias(c) if c in moved else F.col(f"`{c}`") for c in frags.columns), (F.col("nth_") + 1).alias("piece"))


def redaction_report(frags: DataFrame, keys: list[str], regions: DataFrame, by: list[str], region_keys: list[str]) -> DataFrame:
    """A dry run of ``subtract``: for each region (by, region_keys, box) the ``fragments`` that it touches and the ``chars`` that it takes, 0 if none."""
    hit = holes(frags, list(dict.fromkeys([*by, *keys])), regions.select(*dict.fromkeys([*by, *region_keys, *spatial.BOX])), by, [c for c in region_keys if c not in by])
    found = hit.groupBy(*region_keys).agg(F.count("*").alias("fragments"), F.sum(F.col("hi") - F.col("lo") + 1).alias("chars"))
    return regions.select(*region_keys).distinct().join(found, region_keys, "left").select(*region_keys, F.coalesce("fragments", F.lit(0)).alias("fragments"), F.coalesce("chars", F.lit(0)).alias("chars"))


def without_alt(figures: DataFrame, alt: DataFrame, keys: list[str]) -> DataFrame:
    """Figures that have no alternative text, or a blank one."""
    return figures.join(alt.where(F.length(F.trim("alt")) > 0), keys, "left_anti")
