"""Bidirectional text: classes, levels and visual order of lines, character by character in window passes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of code points by class, in the order that they are looked up in; all others are L. Fixed values.
CLASSES: list[tuple[str, list[tuple[int, int]]]] = [
    ("WS", [(0x20, 0x20), (0x09, 0x09), (0x0B, 0x0C), (0x2028, 0x2028)]),
    ("EN", [(0x30, 0x39)]),
    ("ES", [(0x2B, 0x2B), (0x2D, 0x2D)]),
    ("ET", [(0x23, 0x25), (0xA2, 0xA5), (0xB0, 0xB1), (0x2030, 0x2030)]),
    ("CS", [(0x2C, 0x2C), (0x2E, 0x2F), (0x3A, 0x3A), (0xA0, 0xA0)]),
    ("NSM", [(0x0591, 0x05BD), (0x05BF, 0x05BF), (0x05C1, 0x05C2), (0x05C4, 0x05C5), (0x05C7, 0x05C7)]),
    ("R", [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)]),
    ("AN", [(0x0660, 0x0669), (0x06F0, 0x06F9)]),
    ("NSM", [(0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED)]),
    ("AL", [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("ON", [(0x21, 0x2F), (0x3B, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0x2010, 0x2027), (0x2031, 0x205E)]),
]
#: Characters and their mirror images. Fixed values.
MIRRORED, MIRRORS = "()[]{}<>«»", ")(][}{><»«"
#: Letters of right-to-left scripts, marks and digits left out.
_RTL = "[\\x{0590}\\x{05BE}\\x{05C0}\\x{05C3}\\x{05C6}\\x{05C8}-\\x{05FF}\\x{FB1D}-\\x{FB4F}\\x{0600}-\\x{064A}\\x{066A}-\\x{066F}\\x{0671}-\\x{06D5}\\x{06DD}-\\x{06DE}\\x{06E5}-\\x{06E6}\\x{06E9}\\x{06EE}-\\x{06EF}\\x{06FA}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"


def char_class(code: Column) -> Column:
    """The class of a code point: L, R, AL, EN, ES, ET, AN, CS, NSM, WS or ON."""
    out = None
    for name, spans in CLASSES:
        held = F.lit(False)
        for a, b in spans:
            held = held | (code == a if a == b else code.between(a, b))
        out = F.when(held, name) if out is None else out.when(held, name)
    return out.otherwise("L")


def has_right_to_left(text: Column) -> Column:
    """Whether a text has a letter that runs from right to left."""
    return text.rlike(_RTL)


def levels(lines: DataFrame, keys: list[str], text: str, rtl: Column | None = None) -> DataFrame:
    """A row a character of each line: ``keys``, ``base`` (0 or 1), ``at`` from 1, ``ch`` and its embedding ``level``.

    ``keys`` tell lines apart. Without ``rtl`` (whether a line runs from right to left whatever it holds) the first strong
    letter tells the base. Each rule is a pass over the same order: marks take the class before them, numbers after
    Arabic letters are Arabic, separators between equal numbers and terminators beside them are numbers, numbers after
    Latin letters are Latin, and neutrals between equal neighbours are as these, else as the base.
    """
    w = Window.partitionBy(*keys).orderBy("at")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    behind, whole = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nearest = lambda value, where: F.last(F.when(where, value), ignorenulls=True).over(before)
    following = lambda value, where: F.first(F.when(where, value), ignorenulls=True).over(behind)
    cls = F.col("c_")
    chars = lines.select(*keys, (rtl if rtl is not None else F.lit(False)).alias("rtl_"), F.posexplode(F.split(text, "(?s)(?<=.)(?=.)")).alias("at", "ch")).withColumn("at", F.col("at") + 1).where("ch <> ''")
    out = chars.withColumn("c_", char_class(F.ascii("ch")))
    strong = cls.isin("L", "R", "AL")
    first = F.first(F.when(strong, cls), ignorenulls=True).over(whole)
    out = out.withColumn("base", F.when(F.col("rtl_") | first.isin("R", "AL"), 1).otherwise(0))
    edge = F.when(F.col("base") == 0, "L").otherwise("R")
    step = lambda value: out.withColumn("c_", value)
    out = step(F.coalesce(F.last(F.when(cls != "NSM", cls), ignorenulls=True).over(so_far), edge))
    out = step(F.when((cls == "EN") & (nearest(cls, strong) == "AL"), "AN").otherwise(cls))
    out = step(F.when(cls == "AL", "R").otherwise(cls))
    left, right = F.lag("c_").over(w), F.lead("c_").over(w)
    out = step(F.when(cls.isin("ES", "CS") & (left == "EN") & (right == "EN"), "EN").when((cls == "CS") & (left == "AN") & (right == "AN"), "AN").otherwise(cls))
    out = step(F.when((cls == "ET") & ((nearest(cls, cls != "ET") == "EN") | (following(cls, cls != "ET") == "EN")), "EN").otherwise(cls))
    out = step(F.when(cls.isin("ES", "ET", "CS"), "ON").otherwise(cls))
    out = step(F.when((cls == "EN") & (F.coalesce(nearest(cls, cls.isin("L", "R")), edge) == "L"), "L").otherwise(cls))
    neutral, side = cls.isin("ON", "WS"), F.when(cls == "L", "L").otherwise("R")
    a, b = F.coalesce(nearest(side, ~neutral), edge), F.coalesce(following(side, ~neutral), edge)
    out = step(F.when(neutral, F.when(a == b, a).otherwise(edge)).otherwise(cls))
    level = F.when(F.col("base") == 0, F.when(cls == "R", 1).when(cls == "L", 0).otherwise(2)).otherwise(F.when(cls == "R", 1).otherwise(2))
    return out.select(*keys, "base", "at", "ch", level.alias("level"))


#: Lines that are looked at in one array.
LINES = 1000
_NO = {name: k for k, name in enumerate(["L", *dict.fromkeys(name for name, _ in CLASSES)])}
_TABLE = np.zeros(0x10000, np.int8)
for _name, _spans in reversed(CLASSES):  # of several classes the first holds
    for _a, _b in _spans:
        _TABLE[_a : _b + 1] = _NO[_name]


def drawn(texts: list[str], turned: list[bool]) -> list[str]:
    """Lines in the order in which they are drawn, all of them at once: the rules of ``levels`` as passes over one array of characters."""
    no, table = _NO, _TABLE
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").copy()
    sizes = np.array([len(t) for t in texts])
    n, at = len(codes), np.arange(len(codes))
    line = np.repeat(np.arange(len(texts)), sizes)
    begin, end = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.cumsum(sizes), sizes)
    is_in = lambda c, *of: np.isin(c, [no[x] for x in of])

    def last(where, upto):
        """Of each character, the place of the last one of its line where it holds, up to itself or before; -1 if none."""
        found = np.maximum.accumulate(np.where(where, at, -1))
        found = found if upto else np.concatenate([[-1], found[:-1]])
        return np.where(found >= begin, found, -1)

    def following(where, upto):
        found = np.minimum.accumulate(np.where(where, at, n)[::-1])[::-1]
        found = found if upto else np.concatenate([found[1:], [n]])
        return np.where(found < end, found, -1)

    value = lambda c, place, other: np.where(place < 0, other, c[place])
    c = table[np.minimum(codes, 0xFFFF)].astype(np.int64)
    first = following(is_in(c, "L", "R", "AL"), True)[begin]
    base = np.array(turned, bool)[line] | ((first >= 0) & is_in(c[first], "R", "AL"))
    edge = np.where(base, no["R"], no["L"])
    c = value(c, last(~is_in(c, "NSM"), True), edge)
    c = np.where(is_in(c, "EN") & (value(c, last(is_in(c, "L", "R", "AL"), False), -1) == no["AL"]), no["AN"], c)
    c = np.where(is_in(c, "AL"), no["R"], c)
    every = np.ones(n, bool)
    left, right = value(c, last(every, False), -1), value(c, following(every, False), -1)
    between = lambda x: (left == no[x]) & (right == no[x])
    c = np.where(is_in(c, "ES", "CS") & between("EN"), no["EN"], np.where(is_in(c, "CS") & between("AN"), no["AN"], c))
    other = ~is_in(c, "ET")
    c = np.where(~other & ((value(c, last(other, False), -1) == no["EN"]) | (value(c, following(other, False), -1) == no["EN"])), no["EN"], c)
    c = np.where(is_in(c, "ES", "ET", "CS"), no["ON"], c)
    c = np.where(is_in(c, "EN") & (value(c, last(is_in(c, "L", "R"), False), edge) == no["L"]), no["L"], c)
    neutral, side = is_in(c, "ON", "WS"), np.where(c == no["L"], no["L"], no["R"])
    before, behind = value(side, last(~neutral, False), edge), value(side, following(~neutral, False), edge)
    c = np.where(neutral, np.where(before == behind, before, edge), c)
    level = np.where(c == no["R"], 1, np.where(~base & (c == no["L"]), 0, 2))
    ahead = value(level, last(every, False), 0)
    run = lambda least: last((level < least) | (ahead < least), True)
    mirror = {ord(a): ord(b) for a, b in zip(MIRRORED, MIRRORS)}
    odd = np.flatnonzero((level == 1) & np.isin(codes, list(mirror)))
    codes[odd] = [mirror[x] for x in codes[odd]]
    text = codes[np.lexsort((at, -run(2), run(1), line))].tobytes().decode("utf-32-le")
    ends = np.cumsum(sizes)
    return [text[b - k : b] for b, k in zip(ends, sizes)]


def visual(lines: DataFrame, keys: list[str], text: str, out: str = "visual", rtl: Column | None = None) -> DataFrame:
    """``lines`` with their text in the order in which it is drawn from left to right, mirrored where it runs the other way.

    Lines without a right-to-left letter, and that don't run from right to left, stay as they are and are not
    handed over. Of the others the characters of level 1 and more make runs, which are turned round, and those of level 2 make runs inside
    them, which keep their order: so a character's place is its run's start, then its inner run's start from behind, then
    its own. Lines stay where they are: nothing is shuffled, and no character is a row.
    """

    @F.pandas_udf("string")
    def turn(texts: pd.Series, turned: pd.Series) -> pd.Series:
        made = texts.astype(object).where(texts.notna(), None)
        some = [k for k, t in enumerate(made) if t]
        for k in range(0, len(some), LINES):
            part = some[k : k + LINES]
            made.iloc[part] = drawn([made.iloc[x] for x in part], [bool(turned.iloc[x]) for x in part])
        return made

    turned = F.coalesce(rtl, F.lit(False)) if rtl is not None else F.lit(False)
    mine = F.when(has_right_to_left(F.col(text)) | turned, F.col(text))
    return lines.select(*(f"`{c}`" for c in lines.columns if c != out), F.coalesce(turn(mine, turned), text).alias(out))
