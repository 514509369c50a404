"""Borderless tables by windows, against the walk over one page's lines that the grouped detector makes."""

import random
from collections import Counter

import pytest

from foliospark.operators import borderless, tables

FRAGS = "page long, seq long, x double, y double, end_x double, size double, font string, text string"
RULES = "page long, vertical boolean, pos double, lo double, hi double"


def page_of(r, kind):
    """Fragments and rules of a page; each kind is near what one of the guards looks for."""
    out, rules = [], []
    n, cols = r.randint(3, 8), r.choice([2, 2, 3, 4])
    xs = [60 + 130 * c for c in range(cols)]
    font, size, step = "Sans", 10.0, 16.0
    if kind == "code":
        font, cols, xs = "CourierNew", 2, xs[:2]
    if kind in ("numbered", "contents", "paged", "prose2"):
        cols, xs = 2, xs[:2]
    if kind == "spread":
        step = 40.0
    for i in range(n):
        y, first = 700 - step * i, i
        for c, x in enumerate(xs):
            text = r.choice(["ab", "cell", "two words", "7", "3.5", "x y z"])
            if kind == "numbered" and c == 0:
                text = str(first + 1)
            if kind == "list" and c == 0:
                text = r.choice(["• a", "2) b", "- c", "1. d"])
            if kind in ("prose", "prose2") and (c or kind == "prose"):
                text = "four plain words here again"[: 40 if kind == "prose" else 22]
            if kind == "contents":
                text = "A long heading of a chapter" if c == 0 else f"part {i} page {i * 7 + 1}"
            if kind == "paged":
                text = "three short words" if c == 0 else str(r.randint(1, 900))
            if kind == "leader" and c == 0:
                text = "intro ......"
            own = size + (2.0 * (i % 5) if kind == "sizes" else 0)
            if kind == "uneven" and r.random() < 0.25:
                continue
            out.append([x + r.choice([0, 0, 3]), y + r.choice([0, 0.2]), None, own, font, text])
            if kind == "split" and c == 0:
                out.append([x + len(text) * 5 + 2.0, y, None, own, font, "on"])
        if kind == "straddle" and r.random() < 0.5:
            out.append([xs[0] + 40.0, y, xs[-1] - 5.0, size, font, "wide wide wide"])
        if kind == "ruled":
            rules += [(False, y - 3, 50.0, 600.0)] * r.choice([1, 2])
    if kind == "flow":
        out += [[50.0, 690.0 - 8 * k, 500.0, 12.0, font, "flowing text of a paragraph"] for k in range(40)]
    if r.random() < 0.3:
        out.append([60.0, 720.0, None, 14.0, font, "A heading"])
    return [(float(x), float(y), float(end) if end is not None else x + 5.0 * len(t), s, f, t) for x, y, end, s, f, t in out], rules


@pytest.fixture(scope="module")
def pages():
    r = random.Random(21)
    kinds = ["plain"] * 6 + ["code", "numbered", "list", "prose", "prose2", "contents", "paged", "leader", "sizes", "uneven", "uneven", "split", "straddle", "ruled", "ruled", "flow", "spread"]
    return {k: page_of(r, kinds[k % len(kinds)]) for k in range(3 * len(kinds))}


def walked(frags, rules):
    rows = tables.text_rows([f for f in frags if f[5].strip()])
    found = [t for run in tables.runs_of_rows(rows) if (t := tables.stream_table(run, rows, [r[1:] for r in rules]))]
    found.sort(key=lambda t: (-t["box"][3], t["box"][0]))
    return Counter((n, tuple(round(float(v), 6) for v in t["box"]), row, col, text) for n, t in enumerate(found, 1) for row, col, _, _, text in t["cells"])


def test_tables_against_a_walk(spark, pages):
    frags = [(p, k, *f) for p, (found, _) in pages.items() for k, f in enumerate(found)]
    rules = [(p, *x) for p, (_, found) in pages.items() for x in found]
    got = borderless.tables(spark.createDataFrame(frags, FRAGS), ["page"], spark.createDataFrame(rules, RULES)).collect()
    by_page = {p: Counter() for p in pages}
    for x in got:
        by_page[x.page][(x.table_no, tuple(round(x[c], 6) for c in ("llx", "lly", "urx", "ury")), x.row, x.col, x.text)] += 1
    want = {p: walked(found, rules_) for p, (found, rules_) in pages.items()}
    assert {p: w for p, w in want.items() if w != by_page[p]} == {}
    assert sum(bool(w) for w in want.values()) > 15 and sum(not w for w in want.values()) > 15


def test_text_in_ruled_tables_and_no_text(spark, pages):
    frags = spark.createDataFrame([(0, k, *f) for k, f in enumerate(pages[0][0])], FRAGS)
    whole = spark.createDataFrame([(0, 0.0, 0.0, 1000.0, 1000.0)], "page long, llx double, lly double, urx double, ury double")
    assert not borderless.tables(frags, ["page"]).isEmpty() and borderless.tables(frags, ["page"], ruled=whole).isEmpty()
    assert borderless.tables(frags.limit(0), ["page"]).isEmpty()
    assert borderless.cells(frags, ["page"]).count() == sum(len(r["cells"]) for r in tables.text_rows(pages[0][0]))
