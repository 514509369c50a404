"""URL rules held in cascades of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import aside, forget, materialize

#: Rules of the query: verdict, host and the path that a url's must start with. Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bytes of a cascade that expressions may carry; a longer list of keys is dealt out over several.
MOST_BYTES = 4_000_000
#: Hash functions of a level at most.
MOST_HASHES = 40


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Array of the keys under which a rule could list a url: suffixes of its host, of up to ``labels`` labels
    or whole, each with the starts of its path that have one of the ``lengths`` of listed paths."""
    parts = F.split(host, r"\.")
    found = []
    for k in range(1, labels + 1):
        suffix = F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), "."))
        for n in lengths:
            found.append(F.when(F.length(path) >= n, F.concat(suffix, F.substring(path, 1, n))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


@dataclass
class Level:
    bits: int
    hashes: int
    data: bytes

    def has(self, key: Column, nth: int) -> Column:
        """Whether the filter has a key; false positives occur, false negatives don't."""
        data = F.lit(bytearray(self.data))  # one literal, whatever its size
        out = F.lit(True)
        for at in _places(key, nth, self.hashes, self.bits):
            byte = F.conv(F.hex(F.substring(data, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1)
        return out


def _places(key: Column, nth: int, hashes: int, bits: int) -> list[Column]:
    """Bit positions of a key in the ``nth`` level: two hashes, combined."""
    a, b = (F.xxhash64(F.lit(n), key).bitwiseAND((1 << 40) - 1) for n in (nth, ~nth))
    return [(a + b.bitwiseOR(1) * i) % bits for i in range(hashes)]


def _level(keys: DataFrame, count: int, rate: float, nth: int) -> Level:
    hashes = min(MOST_HASHES, max(1, round(-math.log2(rate))))
    bits = -(-max(64, math.ceil(count * hashes / math.log(2))) // 64) * 64
    at = keys.select(F.explode(F.array(*_places(F.col("key"), nth, hashes, bits))).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
    rows = found.toPandas()  # no more than the filter has words, which is checked before
    words = np.zeros(bits // 64, "<i8")
    words[rows["word"].to_numpy(int)] = rows["bits"].to_numpy(np.int64)
    return Level(bits, hashes, words.tobytes())


class Cascade:
    """An exact set over a closed universe of keys: level 0 encodes the listed keys, each further level what
    the one before takes in by mistake, by turns unlisted and listed keys, until none is mistaken."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, key: Column) -> Column:
        """Exact for keys of the universe that the cascade was made over."""
        out = F.lit(len(self.levels) % 2 == 1)  # what passes all levels belongs to the set that the last encodes
        for nth in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[nth].has(key, nth), F.lit(nth % 2 == 1)).otherwise(out)
        return out


def bytes_needed(listed: int, universe: int, rate: float | None = None) -> float:
    """About the bytes of a cascade's levels."""
    first = -math.log2(rate or first_rate(listed, universe))
    return listed * (max(1.0, first) + 3) * 1.45 / 8


def first_rate(listed: int, universe: int) -> float:
    """The first level's error: about the listed share of the universe, so that few keys reach the second."""
    return max(2.0**-MOST_HASHES, min(0.5, listed * math.sqrt(0.5) / max(1, universe)))


def cascade(listed: DataFrame, universe: DataFrame, rate: float | None = None) -> Cascade:
    """A cascade for the distinct, non-null ``key`` of ``listed``, exact over ``universe`` (``key``, which may repeat)."""
    listed = materialize(listed.where("key is not null").select("key").distinct(), "listed")
    count = listed.count()
    if not count:
        return Cascade([Level(64, 1, bytes(8))])
    rate = rate or first_rate(count, universe.count())
    inside, others = listed, universe.select("key").where("key is not null").join(listed, "key", "left_anti")
    levels: list[Level] = []
    made = [listed]
    while count:
        levels.append(_level(inside, count, rate, len(levels)))
        wrong = others.where(levels[-1].has(F.col("key"), len(levels) - 1)).distinct()
        wrong = materialize(wrong, "mistaken")
        made.append(wrong)
        inside, others = wrong, inside
        count, rate = inside.count(), 0.5
    forget(*made)
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", rate: float | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with ``host_``, ``path_``, ``rule_`` and ``verdict_``; ``rules`` has verdict, host and path.

    A rule fits its host and all subdomains where the url's path starts with its own; the longest that fits
    decides. Allowed and blocked keys have a cascade each, over all keys that the urls of ``pages`` could be listed
    under, so membership is exact and urls are judged where they lie, without a join. A list whose filters would
    exceed ``most_bytes`` is dealt out by hash over several cascades, which are applied one after the other, not to pages but to the distinct keys: each
    writes the keys that it lists alone, and the pages' distinct hosts and paths meet them in one join in the end.

    A url that no rule fits is not in the list of blocked keys and gets ``default``. A null url, or one without
    ``://``, has an empty host and path, which no rule fits. Very long urls are judged whole. Rules with a null are ignored; of a key both allowed
    and blocked, the allowing rule holds. Repeated rows are judged alike; an empty table gives an empty one; other
    columns pass through, whatever their names, but the four above are replaced.
    """
    pages, own = aside(pages.drop("host_", "path_", "rule_", "verdict_"), "allow_", "block_", "of_host_", "of_path_")
    out = pages.withColumns({"host_": host_of(F.col(url_col)), "path_": path_of(F.col(url_col))})
    listed = materialize(rules.where("verdict is not null and host is not null and path is not null").select("verdict", F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")), "rules")
    labels = listed.agg(F.max("labels")).first()[0] or 0
    lengths = sorted(r[0] for r in listed.select("length").distinct().collect())  # as many as paths have lengths
    keys = F.array_distinct(keys_of(F.col("host_"), F.col("path_"), labels, lengths)) if lengths else F.array().cast("array<string>")
    universe = materialize(out.select(F.explode(keys).alias("key")).groupBy("key").count(), "universe")
    sizes = {v: int(bytes_needed(listed.where(F.col("verdict") == v).count(), universe.count(), rate) // most_bytes) + 1 for v in ("allow", "block")}
    members = []
    for verdict, parts in sizes.items():
        mine = listed.where(F.col("verdict") == verdict)
        for k in range(parts):
            part = lambda key, k=k: F.pmod(F.xxhash64(key), F.lit(parts)) == k  # noqa: E731, B023
            found = cascade(mine.where(part(F.col("key"))), universe.where(part(F.col("key"))), rate)
            if max(sizes.values()) == 1:
                out = out.withColumn(f"{verdict}_", F.filter(keys, found.has))
            else:
                members.append(materialize(universe.where(part(F.col("key")) & found.has(F.col("key"))).select("key", F.lit(verdict).alias("verdict")), "members"))
    forget(listed, universe)
    if members:
        known = members[0]
        for m in members[1:]:
            known = known.unionByName(m)
        places = out.select("host_", "path_").distinct()
        met = places.withColumn("key", F.explode(keys)).join(known, "key").groupBy(F.col("host_").alias("of_host_"), F.col("path_").alias("of_path_"))
        listed_keys = lambda v: F.collect_set(F.when(F.col("verdict") == v, F.col("key"))).alias(f"{v}_")  # noqa: E731  no more than a url has keys
        out = out.join(met.agg(listed_keys("allow"), listed_keys("block")), (F.col("host_") == F.col("of_host_")) & (F.col("path_") == F.col("of_path_")), "left").drop("of_host_", "of_path_")
    out = out.withColumns({v: F.array_max(F.transform(v, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))) for v in ("allow_", "block_")})
    return _decide(out, default).select(*own, "host_", "path_", "rule_", "verdict_")


def _decide(out: DataFrame, default: str) -> DataFrame:
    block = F.coalesce(F.col("block_.n") > F.coalesce(F.col("allow_.n"), F.lit(0)), F.lit(False))
    rule = F.when(block, F.col("block_.k")).otherwise(F.col("allow_.k"))
    verdict = F.when(block, "block").when(F.col("allow_").isNotNull(), "allow").otherwise(default)
    return out.withColumns({"rule_": rule, "verdict_": verdict})


def op8(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "verdict string, host string, path string")
    out = judge(pages.select("page_id", "url"), rules)
    return out.select("page_id", F.col("host_").alias("host"), F.col("path_").alias("path"), F.col("rule_").alias("rule"), F.col("verdict_").alias("verdict"))


ORACLE = r"""
WITH p AS (SELECT page_id, url, strpos(url, '://') AS k FROM pages),
s AS (SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
