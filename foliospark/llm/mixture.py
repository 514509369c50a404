"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import materialize

#: Weights of the sources in order of code point, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Copies of a document at most.
MOST_COPIES = 3
#: Ranks are counted in so many bins a source before those of one bin are put in order.
BINS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def likelihood(size: Column) -> Column:
    """Relative expected copies of a document: those of under 16 words count half."""
    return F.when(size < 16, 0.5).otherwise(1.0)


def random_odds(doc_id: Column, seed: int) -> Column:
    """The odds of a uniform number made from the id's digest: the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 0.5) / float(2**48)
    return u / (1.0 - u)


def _until_capped(order: list[Column], within: list[str], part: Column, cap: Column, whole: Column) -> tuple[Column, Window]:
    """The level at which ``least(cap, level * part)`` adds up to ``whole``, on each row as if all before it were
    capped, and the order: that of cap by part. The first row that its level doesn't cap has the level of all.
    Null where nothing is left to part."""
    w = Window.partitionBy(*within).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    left = whole - F.coalesce(F.sum(cap).over(before), F.lit(0))
    return F.try_divide(left, F.sum(part).over(w.rowsBetween(0, Window.unboundedFollowing))), w


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``target`` of each row of ``totals`` (source, source_size): all sizes dealt out by weight, none above ``most`` times its own.

    The windows here see one row a source.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    weighed = weighed.withColumns({"cap": most * F.col("source_size"), "total": F.sum("source_size").over(Window.partitionBy())})
    level, order = _until_capped([(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], [], F.col("weight"), F.col("cap"), F.col("total"))
    leveled = weighed.withColumns({"level": level, "nth": F.row_number().over(order)})
    leveled = leveled.withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("nth"))).over(Window.partitionBy()))
    return leveled.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def _expected(classes: DataFrame, most: int) -> DataFrame:
    """``expected`` copies of each class of likelihood in a source, so that they add up to the source's target."""
    c = F.col("likelihood") * F.col("class_size")
    level, order = _until_capped([F.col("likelihood").desc()], ["source"], c, most * F.col("class_size"), F.col("target"))
    leveled = classes.withColumns({"level": level, "nth": F.row_number().over(order)})
    leveled = leveled.withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("likelihood") <= most, F.col("nth"))).over(Window.partitionBy("source")))
    return leveled.withColumn("expected", F.coalesce(F.least(F.lit(float(most)), F.col("level") * F.col("likelihood")), F.lit(float(most)))).drop("level", "nth")


def _ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows (id, source, size, likelihood) with their class's plan, ``rank`` (random odds by inclusion odds; null where nothing is left to chance) and ``bin``."""
    p = plan.withColumnsRenamed({"source": "source_", "likelihood": "likelihood_"})
    found = rows.join(p, F.col("source").eqNullSafe(F.col("source_")) & (F.col("likelihood") == F.col("likelihood_"))).drop("source_", "likelihood_")
    found = found.withColumn("rank", F.when(F.col("chance") > 0, F.col("odds") / (F.col("chance") / (1.0 - F.col("chance")))))
    return found.withColumn("bin", F.floor(F.col("rank") / (F.col("rank") + 1.0) * BINS))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42) -> DataFrame:
    """What each class of each source takes: ``whole`` certain copies, the ``chance`` of one more, and where the sample's order is cut.

    ``rows`` has id, source, size, likelihood and odds. The sample is of fixed size in words: the order is cut
    where the words so far come up to what the whole copies leave of the target. What the document at the cut leaves
    open is filled from beyond it: of each quarter of a doubling of size, from the largest down, the next document in
    order is taken if it fits. Sources are ranked in
    ``BINS`` counted bins, and only the bin with the cut is put in order, so no source is sorted as a whole.
    """
    classes = materialize(rows.groupBy("source", "likelihood").agg(F.sum("size").alias("class_size")), "classes")
    totals = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    goal = targets(totals, weights, most).withColumnRenamed("source", "source_")
    wide = classes.join(goal, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    wide = _expected(wide, most).withColumns({"whole": F.floor("expected"), "chance": F.col("expected") - F.floor("expected")})
    left = F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("source"))
    wide = materialize(wide.withColumn("left", left).select("source", "likelihood", "source_size", "target", "whole", "chance", "left"), "classes")

    ranked = _ranked(rows, wide, seed).where("rank is not null and size > 0")
    binned = ranked.groupBy("source", "left", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    binned = binned.withColumn("upto", upto).where("upto > left")
    edge = binned.groupBy("source").agg(F.min(F.struct("bin", F.expr("upto - words").alias("before"))).alias("e"))
    edge = materialize(edge.select(F.col("source").alias("source_"), F.col("e.bin").alias("cut_bin"), F.col("e.before").alias("before")), "edge")

    inside = ranked.join(edge, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bin") == F.col("cut_bin")))
    inside = inside.groupBy("source", "left", "before", "rank", "id").agg(F.sum("size").alias("size"))  # repeated rows go together
    ends = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_last()))).where("upto <= left")
    ends = ends.groupBy("source").agg(F.max(F.struct("upto", "rank", F.col("id").isNull().alias("last"), "id")).alias("c"))
    ends = ends.select(F.col("source").alias("cut_source"), F.col("c.upto").alias("cut_upto"), F.col("c.rank").alias("cut_rank"), F.col("c.id").alias("cut_id"))
    cuts = materialize(edge.join(ends, F.col("source_").eqNullSafe(F.col("cut_source")), "left").select("source_", "cut_bin", "cut_rank", "cut_id", F.coalesce("cut_upto", "before").alias("upto")), "cuts")

    beyond = ranked.join(cuts, F.col("source").eqNullSafe(F.col("source_"))).where(~before_cut())
    beyond = beyond.groupBy("source", "left", "upto", "rank", "id").agg(F.sum("size").alias("size"))
    bits = F.length(F.bin("size"))
    quarter = bits * 8 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 3, F.lit(0))).cast("int")
    first = beyond.groupBy("source", "left", "upto", quarter.alias("quarter")).agg(F.min(F.struct("rank", "id", "size")).alias("first"))
    listed = first.groupBy(F.col("source").alias("close_source"), "left", "upto").agg(F.sort_array(F.collect_list(F.struct("quarter", "first")), asc=False).alias("firsts"))
    none = F.struct((F.col("left") - F.col("upto")).alias("gap"), F.array().cast(rows_type(beyond)).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["first"]["size"] <= acc["gap"]
        more = F.struct((acc["gap"] - x["first"]["size"]).alias("gap"), F.concat(acc["taken"], F.array(F.struct(x["first"]["rank"].alias("rank"), x["first"]["id"].alias("id")))).alias("taken"))
        return F.when(fits, more).otherwise(acc)

    close = listed.select("close_source", F.aggregate("firsts", none, step)["taken"].alias("closing"))
    out = wide.join(cuts.drop("upto"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    return materialize(out.join(close, F.col("source").eqNullSafe(F.col("close_source")), "left").drop("close_source"), "plan")


def rows_type(df: DataFrame) -> str:
    return f"array<struct<rank:double,id:{df.schema['id'].dataType.simpleString()}>>"


def before_cut() -> Column:
    """Whether a ranked row comes before its source's cut. Without a cut, all of the source does."""
    same = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("id").eqNullSafe(F.col("cut_id")) | F.coalesce(F.col("id") <= F.col("cut_id"), F.col("cut_id").isNull())))
    return F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.col("cut_rank").isNotNull() & same)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42, likely=likelihood, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, source, ``size`` in words, ``source_size``, ``target``, ``copies`` and ``keep`` of every row.

    All sizes together are dealt out over the sources by ``weights``, in order of the source's code points,
    null last; targets stop at ``most`` times the source's size. ``likely`` gives documents relative expected
    copies (few distinct values); the whole part of what is expected is certain, and one more copy is drawn by
    Pareto order sampling. The text is read for its size alone; documents aren't shuffled: the plan has a row
    for each source and likelihood, joined to the rows where they lie while it is small, else by a shuffle.

    A null text has size 0 and takes nothing; a null source is a source of its own; a null id draws as an
    empty one. Rows repeated under an id share their draw. An empty table gives an empty one. Extra columns
    are ignored unless named in ``keep``.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    sized = sized.withColumns({"likelihood": likely(F.col("size")), "odds": random_odds(F.col("id"), seed)})
    sized = materialize(sized, "sizes")
    found = plan(sized, weights, most, seed)
    if keep:
        whole = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.struct(*(F.col(f"`{k}`") for k in keep)).alias("kept"))
        sized = whole.withColumns({"likelihood": likely(F.col("size")), "odds": random_odds(F.col("id"), seed)})
    ranked = _ranked(sized, found, seed)
    more = F.col("rank").isNotNull() & (F.col("size") > 0) & (before_cut() | F.coalesce(F.exists("closing", lambda c: (c["rank"] == F.col("rank")) & c["id"].eqNullSafe(F.col("id"))), F.lit(False)))
    copies = (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")
    return ranked.select("id", "source", "size", "source_size", "target", copies.alias("copies"), *([] if not keep else ["kept"]))


def op1(docs: DataFrame) -> DataFrame:
    """The words that the mix takes of every document."""
    out = mix(docs)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  (CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
r AS (SELECT *, CASE WHEN size < 16 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS p, u / (1.0::DOUBLE - u) AS odds FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM r GROUP BY source),
sw AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * ss AS cap, CAST(sum(ss) OVER () AS BIGINT) AS total FROM s),
sl AS (SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev, row_number() OVER o AS nth
       FROM sw WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
st AS (SELECT source, ss, coalesce(least(cap::DOUBLE, (SELECT arg_min(lev, nth) FROM sl WHERE lev * w <= cap) * w), cap::DOUBLE) AS target FROM sl),
c AS (SELECT source, p, CAST(sum(size) AS BIGINT) AS cs FROM r GROUP BY source, p),
cl AS (SELECT c.source, p, cs, ss, target, (target - coalesce(sum(3 * cs) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(p * cs) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev, row_number() OVER o AS nth
       FROM c JOIN st ON c.source IS NOT DISTINCT FROM st.source WINDOW o AS (PARTITION BY c.source ORDER BY p DESC)),
ce AS (SELECT *, coalesce(least(3.0::DOUBLE, (arg_min(lev, nth) FILTER (WHERE lev * p <= 3) OVER (PARTITION BY source)) * p), 3.0::DOUBLE) AS e FROM cl),
cp AS (SELECT *, floor(e) AS whole, e - floor(e) AS chance, target - sum(floor(e) * cs) OVER (PARTITION BY source) AS rest FROM ce),
q AS (SELECT r.doc_id, r.source, r.size, ss, target, whole, rest, CASE WHEN chance > 0 AND r.size > 0 THEN odds / (chance / (1.0::DOUBLE - chance)) END AS rank
      FROM r JOIN cp ON r.source IS NOT DISTINCT FROM cp.source AND r.p = cp.p),
f AS (SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST) AS upto FROM q),
g AS (SELECT *, rank IS NOT NULL AND upto <= rest AS inside, coalesce(max(CASE WHEN rank IS NOT NULL AND upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS reached FROM f),
h AS (SELECT source, rest - reached AS gap, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS quarter, doc_id, size FROM g WHERE rank IS NOT NULL AND NOT inside
      QUALIFY row_number() OVER (PARTITION BY source, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) ORDER BY rank, doc_id) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quarter DESC) AS nth FROM h),
c2(source, nth, doc_id, fits, gap) AS (
  SELECT source, nth, doc_id, size <= gap, CASE WHEN size <= gap THEN gap - size ELSE gap END FROM k WHERE nth = 1
  UNION ALL SELECT k.source, k.nth, k.doc_id, k.size <= c2.gap, CASE WHEN k.size <= c2.gap THEN c2.gap - k.size ELSE c2.gap END FROM c2 JOIN k ON k.source IS NOT DISTINCT FROM c2.source AND k.nth = c2.nth + 1),
t AS (SELECT g.*, CASE WHEN inside OR (rank IS NOT NULL AND EXISTS (SELECT 1 FROM c2 WHERE c2.fits AND c2.doc_id = g.doc_id AND c2.source IS NOT DISTINCT FROM g.source)) THEN 1 ELSE 0 END AS more FROM g)
SELECT doc_id, size, ss AS source_size, target, CAST(whole + more AS BIGINT) * size AS taken, source, CAST(whole + more AS INTEGER) AS copies FROM t
"""
