"""Operators on places, graphs, trees, references and flows, against plain loops on small fixtures."""

import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.operators import bidi, edits, flow, graph, references, rows, spatial

# --- ranges


@pytest.mark.parametrize("keyed", [False, True])
def test_lookup(spark, keyed):
    r = random.Random(3)
    by = ["font"] if keyed else []
    font = lambda: r.choice("ab") if keyed else "a"
    ranges = [(font(), lo := r.randint(-50, 3000), lo + r.choice([0, 1, 7, 100, 2500]), r.randint(0, 9) * 1000) for _ in range(120)] + [("a", 10, 5, 1), ("a", None, 5, 1), ("a", 2**40, 2**40 + 2**33, 7)]
    singles = [(font(), r.randint(0, 3000), r.randint(0, 99)) for _ in range(40)] + [("a", 5, None), ("a", None, 3)]
    codes = [(font(), r.randint(-100, 6000)) for _ in range(500)] + [("a", 77)] * 300 + [("a", None), ("a", 2**40 + 12345)]

    def want(f, code):
        if code is None:
            return -1
        own = [v for g, c, v in singles if g == f and c == code and v is not None]
        held = [(hi, -lo, base, base + code - lo) for g, lo, hi, base in ranges if g == f and lo is not None and lo <= code <= hi]
        return min(own) if own else min(held)[3] if held else -1

    got = spatial.lookup(
        spark.createDataFrame(codes, "font string, code long"), "code", spark.createDataFrame(ranges, "font string, lo long, hi long, base long"), "lo", "hi", "base", by,
        spark.createDataFrame(singles, "font string, code long, value long"), missing=-1,
    )
    assert Counter(tuple(x) for x in got.collect()) == Counter((f, c, want(f, c)) for f, c in codes)
    assert spatial.lookup(got.drop("mapped"), "code", spark.createDataFrame([], "font string, lo long, hi long, base long"), "lo", "hi", "base", by).where("mapped <> 0").isEmpty()


def test_lookup_has_no_nested_loop(spark):
    ranges = spark.range(1_000_000).selectExpr("id * 3 AS lo", "id * 3 + 1 AS hi", "id AS base")
    got = spatial.lookup(spark.range(0, 3_000_000, 100_000).withColumnRenamed("id", "code"), "code", ranges, "lo", "hi", "base", missing=None)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert {r.code: r.mapped for r in got.collect()} == {c: c // 3 + c % 3 if c % 3 < 2 else None for c in range(0, 3_000_000, 100_000)}


# --- rectangles


def made_boxes(r, n, name):
    out = []
    for k in range(n):
        x, y = r.choice([r.uniform(-100, 100), float(r.randint(-20, 20))]), r.uniform(-100, 100)
        w, h = r.choice([0.0, 0.001, 1.0, r.uniform(0, 30), 500.0]), r.choice([0.0, 0.5, r.uniform(0, 30), 4.0])
        out.append((f"{name}{k}", r.choice("uv"), x, y, x + w, y + h))
    return out + [(f"{name}x", "u", None, 0.0, 1.0, 1.0), (f"{name}y", "u", 5.0, 5.0, 4.0, 6.0)]


@pytest.mark.parametrize("touching", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_meets(spark, touching, keyed):
    r = random.Random(8)
    a, b = made_boxes(r, 150, "a"), made_boxes(r, 90, "b")
    left = spark.createDataFrame(a, "a string, page string, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "b string, page string, llx double, lly double, urx double, ury double")
    got = spatial.meets(left, right if keyed else right.withColumnRenamed("page", "other"), ("x0", "y0", "x1", "y1"), by=["page"] if keyed else None, touching=touching)

    def meet(p, q):
        if None in (*p[2:], *q[2:]) or p[2] > p[4] or q[2] > q[4] or (keyed and p[1] != q[1]):
            return False
        if touching:
            return p[2] <= q[4] and p[4] >= q[2] and p[3] <= q[5] and p[5] >= q[3]
        return p[2] < q[4] and p[4] > q[2] and p[3] < q[5] and p[5] > q[3]

    assert Counter((x.a, x.b) for x in got.collect()) == Counter((p[0], q[0]) for p in a for q in b if meet(p, q))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert rows.overlaps(left.limit(0), "x0", "y0", "x1", "y1", right.drop("page")).isEmpty()


def test_first_containing(spark):
    r = random.Random(9)
    points = [(k, r.uniform(0, 50), float(r.randint(0, 50))) for k in range(200)] + [(900, None, 1.0), (901, 3.0, 3.0)]
    regions = [(k, r.randint(0, 40), r.randint(0, 40)) for k in range(60)]
    boxes = [(k, float(x), float(y), x + 6.0, y + 8.0, f"u{k % 7}") for k, x, y in regions]
    got = spatial.first_containing(spark.createDataFrame(points, "id long, x double, y double"), ["id"], "x", "y", spark.createDataFrame(boxes, "nth long, llx double, lly double, urx double, ury double, uri string"), "nth", ["uri"])
    want = {k: next((b[5] for b in boxes if x is not None and b[1] <= x <= b[3] and b[2] <= y <= b[4]), None) for k, x, y in points}
    assert {x.id: x.uri for x in got.collect()} == want and got.count() == len(points)


def test_shades(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 20.0, 0.0, 30.0, 10.0), (3, 40.0, 0.0, 40.0, 10.0)], "id long, llx double, lly double, urx double, ury double")
    fills = [(1, 0.0, 0.0, 10.0, 5.9, 0.1, 0.1, 0.1), (2, 0.0, 0.0, 6.0, 10.0, 0.2, 0.2, 0.2), (3, 0.0, 0.0, 10.0, 9.0, 0.3, 0.3, 0.3), (4, 0.0, 0.0, 50.0, 50.0, 0.98, 0.99, 1.0), (5, 20.0, 0.0, 25.0, 10.0, 0.5, 0.5, 0.5), (6, 25.0, 0.0, 30.0, 10.0, 0.5, 0.5, 0.5)]
    given = spark.createDataFrame(fills, "nth long, llx double, lly double, urx double, ury double, r double, g double, b double")
    most = {x.id: x.shade and x.shade.r for x in spatial.shades(cells, ["id"], given).collect()}
    first = {x.id: x.shade and x.shade.r for x in spatial.shades(cells, ["id"], given, order="nth").collect()}
    assert most == {1: 0.3, 2: None, 3: None} and first == {1: 0.2, 2: None, 3: None}
    shares = {(x.id, x.r): x.share for x in spatial.area_shares(cells, ["id"], given, "r").collect()}
    assert shares[2, 0.5] == 1.0 and shares[1, 0.1] == pytest.approx(0.59)
    assert {x.id for x in spatial.mostly_inside(cells, ["id"], given.where("nth IN (3, 5, 6)")).collect()} == {1}


# --- graphs


def made_graph(r, n=60, m=110):
    return [(r.choice("uv"), r.randint(0, n), r.randint(0, n)) for _ in range(m)]


def reach(edges, doc, root, barred):
    seen, todo, depth = {root: 0}, [root], 0
    while todo:
        depth += 1
        todo = list({d for n in todo for g, s, d in edges if g == doc and s == n and (doc, d) not in barred and d not in seen})
        seen.update(dict.fromkeys(todo, depth))
    return seen


def test_dependencies(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 2)
    r = random.Random(5)
    edges = made_graph(r) + [("u", k, k + 1) for k in range(70, 80)] + [("u", 80, 70)]
    roots = [("u", 0), ("u", 1), ("u", 70), ("v", 0), ("v", 5), ("v", 5), ("w", 1), ("u", None)]
    barred = {("u", 0), ("u", 1), ("u", 7), ("v", 9)}
    got = graph.dependencies(spark.createDataFrame(edges, "doc string, src long, dst long"), spark.createDataFrame(roots, "doc string, node long"), ["doc"], spark.createDataFrame(sorted(barred), "doc string, node long"))
    want = {(d, n, m, k) for d, n in roots if n is not None for m, k in reach(edges, d, n, barred).items()}
    rows_ = [tuple(x) for x in got.select("doc", "root", "node", "depth").collect()]
    assert set(rows_) == want and len(rows_) == len(want)


def test_ownership(spark):
    r = random.Random(6)
    edges = made_graph(r, 80, 130)
    roots = [("u", k, k, 0) for k in range(1, 8)] + [("u", 0, None, 1), ("u", 20, None, 8), ("u", 30, None, 4), ("v", 3, 3, 0), ("v", 3, 4, 0), ("v", 11, None, 2)]
    barred = {("u", k) for k in range(8)}
    want = defaultdict(lambda: (set(), 0))
    for d, n, owner, users in roots:
        for m in reach(edges, d, n, barred):
            owners, bits = want[d, m]
            want[d, m] = (owners | ({owner} if owner is not None else set()), bits | users)
    got = graph.placed(graph.ownership(spark.createDataFrame(edges, "doc string, src long, dst long"), spark.createDataFrame(roots, "doc string, node long, owner long, users int"), ["doc"], spark.createDataFrame(sorted(barred), "doc string, node long"))).collect()
    assert {(x.doc, x.node): (x.least, x.most, x.users) for x in got} == {k: (min(o, default=None), max(o, default=None), b) for k, (o, b) in want.items()}
    for x in got:
        assert x.part == (6 if x.users & 2 else 4 if x.users & 4 else 6 if x.users & 1 else 7 if x.least is not None and x.least == x.most and not x.users & 8 else 8 if x.least is not None and x.least < x.most else 9)


def test_counted_trees(spark):
    r = random.Random(7)
    nodes = []
    for doc in "uv":
        for k in range(60):
            nodes.append((doc, k, r.choice([None, *range(k)]) if k else None, r.randint(0, 3) * 1000 + k, f"t{k}", r.choice([True, True, False, None])))
    nodes.append((None, 1, None, 0, "alone", True))
    kids = defaultdict(list)
    for d, i, p, s, _, o in nodes:
        kids[d, p].append((s, i, o))
    want = {}

    def walk(d, i, o, n):
        pre, below, visible = n + 1, 0, 0
        n = pre
        for _, j, p in sorted(kids[d, i]) if i is not None else []:
            n, b, v = walk(d, j, p, n)
            below, visible = below + 1 + b, visible + 1 + (v if p else 0)
        want[d, i] = (pre, n, below, visible, visible if o else -visible)
        return n, below, visible

    for d in ("u", "v", None):
        n = 0
        for _, j, o in sorted(kids[d, None]):
            n = walk(d, j, o, n)[0]
    spans = graph.counted(spark.createDataFrame(nodes, "doc string, id long, parent long, seq long, title string, open boolean"), ["doc"])
    got = spans.collect()
    assert {(x.doc, x.id): (x.pre, x["last"], x.below, x.visible, x["count"]) for x in got} == want
    parent = {(d, i): p for d, i, p, *_ in nodes}
    removed = {("u", 2), ("u", 5), ("v", 0), ("v", 59)}

    def gone(d, i):
        return i is not None and ((d, i) in removed or gone(d, parent[d, i]))

    left = graph.without_subtrees(spans, spark.createDataFrame(sorted(removed), "doc string, id long"), ["doc"]).collect()
    assert {(x.doc, x.id) for x in left} == {k for k in want if not gone(*k)}


# --- redaction


def test_subtract(spark):
    r = random.Random(4)
    frags = [(r.choice("uv"), k, float(x := r.randint(0, 50)), float(r.randint(0, 30)), x + 4.0 * (n := r.randint(1, 12)), 2.0, "".join(r.choices("abcdé中", k=n))) for k in range(120)]
    frags += [("u", 900, 5.0, 5.0, 5.0, 2.0, "flat"), ("u", 901, 5.0, 5.0, 9.0, 2.0, ""), ("w", 902, 0.0, 0.0, 8.0, 2.0, "ab")]
    regions = [(r.choice("uv"), k, float(x := r.randint(0, 60)), float(y := r.randint(0, 30)), x + float(r.randint(0, 20)), y + float(r.randint(0, 9))) for k in range(25)]
    regions.append(("u", 99, 4.0, 5.0, 6.0, 7.0))
    given = spark.createDataFrame(frags, "page string, seq long, x double, y double, end_x double, size double, text string")
    marks = spark.createDataFrame(regions, "page string, region long, llx double, lly double, urx double, ury double")
    want, taken = [], Counter()
    for p, k, x, y, end, size, text in frags:
        width = (end - x) / len(text) if text else 0.0
        keep, piece = [], 0
        for i in range(len(text)):
            hit = [g for q, g, a, b, c, d in regions if q == p and a <= x + (i + 0.5) * width <= c and b <= y + size / 2 <= d]
            for g in hit:
                taken[g] += 1
            keep.append(not hit)
        for m in re.finditer("1+", "".join(str(int(v)) for v in keep)) if text else []:
            piece += 1
            want.append((p, k, piece, text[m.start() : m.end()], round(x + m.start() * width, 6)))
        if not text:
            want.append((p, k, 1, "", x))
    got = edits.subtract(given, ["seq"], marks, ["page"])
    assert got.columns == [*given.columns, "piece"]
    assert sorted((x.page, x.seq, x.piece, x.text, round(x.x, 6)) for x in got.collect()) == sorted(want)
    report = edits.redaction_report(given, ["seq"], marks, ["page"], ["page", "region"])
    assert {x.region: x.chars for x in report.collect()} == {g: taken[g] for _, g, *_ in regions}
    whole = {x.seq for x in edits.redact(given, marks, ["page"]).collect()}
    mid = lambda f: (f[2] + f[4]) / 2
    assert whole == {f[1] for f in frags if not any(q == f[0] and a <= mid(f) <= c and b <= f[3] + f[5] / 2 <= d for q, _, a, b, c, d in regions)}
    assert edits.redact(given, marks.drop("page"), []).count() <= len(whole)


# --- references


def renamed(v, names, there=None):
    if isinstance(v, dict):
        if isinstance(v.get("ref"), int) and not isinstance(v["ref"], bool):
            new = names.get(v["ref"], v["ref"])
            new = None if there is not None and v["ref"] not in there and v["ref"] not in names else new
            return {k: (new if k == "ref" else renamed(x, names, there)) for k, x in v.items()}
        return {k: renamed(x, names, there) for k, x in v.items()}
    return [renamed(x, names, there) for x in v] if isinstance(v, list) else v


def test_rewrite(spark):
    r = random.Random(2)

    def value(depth=0):
        kind = r.random()
        if kind < 0.4 or depth > 4:
            return r.choice([{"ref": r.randint(-3, 30)}, 7, "text", 'a "ref":5 in text', "back\\", None, {"ref": "no number"}, {"ref": 1.5}, {"ref": 3, "z": 1}, {"preref": 5}])
        return [value(depth + 1) for _ in range(r.randint(0, 4))] if kind < 0.7 else {f"k{i}": value(depth + 1) for i in range(r.randint(0, 4))}

    values = [(k, value()) for k in range(40)]
    names = {3: 1, 5: 1, 9: 29, 30: 2, -2: 8}
    compact = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    df = spark.createDataFrame([(k, compact(v), "x") for k, v in values] + [(99, None, "y")], "id long, value string, target string")
    known = spark.createDataFrame([*names.items(), (3, 4), (None, 4), (6, None)], "old long, new long")
    got = references.rewrite(df, "id", "value", known, "old", "new")
    assert got.columns == df.columns
    assert {x.id: x.value for x in got.collect()} == {99: None, **{k: compact(renamed(v, names)) for k, v in values}}
    nulled = references.rewrite(df, "id", "value", known, "old", "new", dangling="null")
    there = {k for k, _ in values} | {99}
    assert {x.id: x.value for x in nulled.collect()} == {99: None, **{k: compact(renamed(v, names, there)) for k, v in values}}


def test_merged_duplicates(spark):
    rows_ = [(1, '{"a":1}', "s"), (2, '{"a":1}', "s"), (3, '{"to":{"ref":2}}', "t"), (4, '[{"ref":2},{"ref":1},{"ref":5}]', "u"), (5, '{"a":1}', "s")]
    got = references.merge_duplicates(spark.createDataFrame(rows_, "id long, value string, sig string"), "id", "value", F.col("sig"))
    assert {x.id: x.value for x in got.collect()} == {1: '{"a":1}', 3: '{"to":{"ref":1}}', 4: '[{"ref":1},{"ref":1},{"ref":1}]'}


# --- flow


def test_interleave(spark):
    r = random.Random(12)
    paras = [(p, k, f"p{k}", float(r.randint(0, 20))) for p in "uv" for k in range(12)]
    others = [(p, k, f"o{k}", r.choice(["image", "table"]), float(r.randint(-2, 22))) for p in "uvw" for k in range(9)]
    want = {}
    for page in "uvw":
        blocks = [("paragraph", i, top) for p, _, i, top in paras if p == page]
        for p, _, i, kind, top in others:
            if p == page:
                at = next((n for n, b in enumerate(blocks) if b[0] == "paragraph" and b[2] < top), len(blocks))
                blocks.insert(at, (kind, i, top))
        want |= {(page, n + 1): b[:2] for n, b in enumerate(blocks)}
    got = flow.interleave(spark.createDataFrame(paras, "page string, nth long, id string, top double"), spark.createDataFrame(others, "page string, nth long, id string, kind string, top double"), ["page"])
    assert {(x.page, x.place): (x.kind, x.id) for x in got.collect()} == want


# --- bidirectional text


def plain_visual(text, rtl=False):
    """The rules one after the other over a list of classes."""
    def cls(c):
        return next((n for n, spans in bidi.CLASSES if any(a <= ord(c) <= b for a, b in spans)), "L")

    c = [cls(x) for x in text]
    first = next((x for x in c if x in ("L", "R", "AL")), "L")
    base = 1 if rtl or first != "L" else 0
    edge = "R" if base else "L"
    n = len(c)
    for i in range(n):
        c[i] = (c[i - 1] if i else edge) if c[i] == "NSM" else c[i]
    strong = edge
    for i in range(n):
        strong = c[i] if c[i] in ("L", "R", "AL") else strong
        c[i] = "AN" if c[i] == "EN" and strong == "AL" else c[i]
    c = ["R" if x == "AL" else x for x in c]
    for i in range(1, n - 1):
        if c[i] in ("ES", "CS") and c[i - 1] == c[i + 1] == "EN":
            c[i] = "EN"
        elif c[i] == "CS" and c[i - 1] == c[i + 1] == "AN":
            c[i] = "AN"
    for m in list(re.finditer("T+", "".join("T" if x == "ET" else "." for x in c))):
        if (m.start() and c[m.start() - 1] == "EN") or (m.end() < n and c[m.end()] == "EN"):
            c[m.start() : m.end()] = ["EN"] * (m.end() - m.start())
    c = ["ON" if x in ("ES", "ET", "CS") else x for x in c]
    strong = edge
    for i in range(n):
        strong = c[i] if c[i] in ("L", "R") else strong
        c[i] = "L" if c[i] == "EN" and strong == "L" else c[i]
    for m in list(re.finditer("N+", "".join("N" if x in ("ON", "WS") else "." for x in c))):
        side = lambda k: edge if k < 0 or k >= n else "L" if c[k] == "L" else "R"
        a, b = side(m.start() - 1), side(m.end())
        c[m.start() : m.end()] = [a if a == b else edge] * (m.end() - m.start())
    level = [({"L": 0, "R": 1}.get(x, 2) if base == 0 else 1 if x == "R" else 2) for x in c]
    order = list(range(n))
    for k in (2, 1):
        for m in re.finditer("1+", "".join("1" if level[i] >= k else "0" for i in order)):
            order[m.start() : m.end()] = order[m.start() : m.end()][::-1]
    mirror = str.maketrans(bidi.MIRRORED, bidi.MIRRORS)
    return "".join(text[i].translate(mirror) if level[i] % 2 else text[i] for i in order)


def test_visual_order(spark):
    a, b, g = "אבג"
    known = {a + b + g: g + b + a, "abc " + a + b + g: "abc " + g + b + a, a + b + g + " 123": "123 " + g + b + a, "Hello 123": "Hello 123", f"({a})": f"({a})", "": "", "one": "one"}
    r = random.Random(10)
    letters = [a, b, g, "ا", "س", "a", "B", "1", "2", "٣", " ", "(", ")", "+", "-", "%", "$", ",", ".", "ً", "ְ", "«", "!", "é", "\t", "𝒳"]
    texts = [*known, *("".join(r.choices(letters, k=r.randint(1, 30))) for _ in range(250)), "x" * 3000 + a]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9999, None)], "id long, line string")
    got = {x.id: x.visual for x in bidi.visual(df, ["id"], "line").collect()}
    assert [got[k] for k in range(len(known))] == list(known.values()) and got[9999] is None
    for k, t in enumerate(texts):
        assert got[k] == (plain_visual(t) if any(c in t for c in (a, b, g, "ا", "س")) else t), t
    forced = {x.id: x.visual for x in bidi.visual(df, ["id"], "line", rtl=F.lit(True)).collect()}
    for k, t in enumerate(texts[: len(known) + 80]):
        assert forced[k] == plain_visual(t, True), t


def test_strong_letters_and_classes(spark):
    seen = spark.createDataFrame([("plain latin 123", False), ("hello א", True), ("السلام", True), ("ְ ٣", False)], "t string, want boolean")
    assert seen.where(bidi.has_right_to_left(F.col("t")) != F.col("want")).isEmpty()
    cases = {"A": "L", "5": "EN", "א": "R", "ا": "AL", "١": "AN", " ": "WS", "(": "ON", ",": "CS", "+": "ES", "%": "ET", "ً": "NSM"}
    got = spark.createDataFrame(list(cases.items()), "ch string, want string").select("want", bidi.char_class(F.ascii("ch")).alias("got"))
    assert got.where("want <> got").isEmpty()


def test_graph_folder_is_local_for_any_local_master():
    import inspect

    assert "local-cluster" in inspect.getsource(graph._checkpoint)


# --- patterns, dates of rates, labels


@pytest.mark.parametrize("pattern, text, found", [
    ("[*+]x", "*x +x", ["*x", "+x"]), ("[+*+/-]", "a+b/c-d", ["+", "/", "-"]), (r"\d[?+]", "1? 2+ 3", ["1?", "2+"]), ("[[:alpha:]]+", "ab1cd", ["ab", "cd"]), ("[^[:digit:]]+", "1ab2", ["ab"]), ("[]a]+", "x]a]", ["]a]"]),
    ("[a[b]+", "[ab]", ["[ab"]), ("[x&&y]+", "x&y", ["x&y"]), (r"\p{Greek}+", "abγδ", ["γδ"]), ("(?P<name>a)b", "ab", ["ab"]), (r"\Qa+[\E+", "a+[[", ["a+[["]), (r"\bof\b", "of offer of", ["of", "of"]), (r"\b\w+ing\b", "sing singer king", ["sing", "king"]),
    (r"\ba*b", "aab xb b", ["aab", "b"]), (r"x\bé", "xé", ["xé"]), (r"\Bb", "ab b", ["b"]), (r"(a|é)\b", "a é éa", ["a", "é", "a"]), (r"[\]\[]+", "a][b", ["]["]), (r"\v", "a\x0bb", ["\x0b"]), ("a{2}?", "aaa", ["aa"]),
])
def test_patterns(spark, pattern, text, found):
    from foliospark.operators.text import search

    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [x.match for x in search(df, pattern, regex=True).orderBy("match_no").collect()] == found


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)b", "(?<=a)b", "(?<!a)b", r"(a)\1", "a++", "a*+", "x?+", "a{2}+", "(?>a)", r"(?<n>a)\k<n>"])
def test_refused_patterns(pattern):
    from foliospark.operators.text import compile_pattern

    with pytest.raises(ValueError):
        compile_pattern(pattern, True)


@pytest.mark.parametrize("pattern", [r"\bof\b", "o[a-z]+", r"of\s", "^of", "f$", "[^x]f"])
def test_replacement_by_line_and_by_text_agree(spark, pattern):
    from foliospark.operators.text import replace

    texts = ["of of\noffer of", "of\n\nof", "", None, "x\nOf of$1"]
    got = {x.id: (x.text, x.n_replaced) for x in replace(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), pattern, r"$1\z", regex=True).collect()}
    for k, t in enumerate(texts):
        done = [re.subn(pattern, lambda m: r"$1\z", x, flags=re.A) for x in (t or "").split("\n")]
        assert got[k] == (("\n".join(x for x, _ in done), sum(n for _, n in done)) if t is not None else (None, 0))


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("buckets", [1, 8, 64])
def test_as_of_with_hot_values(spark, few, buckets):
    r = random.Random(11)
    table = [(r.choice("xy"), float(r.randint(0, 50)), r.randint(0, 9)) for _ in range(60)] + [("x", 25.0, 3), ("x", 25.0, 7), (None, 10.0, 1), ("x", None, 5)]
    data = [(k, r.choice("xyz"), 25.0 if k % 3 else float(r.randint(-5, 60))) for k in range(600)] + [(900, None, 12.0), (901, "x", None)]
    got = rows.as_of(spark.createDataFrame(data, "id long, g string, at double"), "at", spark.createDataFrame(table, "g string, k double, v long"), "k", ["v"], ["g"], buckets, few)
    want = {i: max(((k, v) for h, k, v in table if h == g and k is not None and at is not None and k <= at), default=(0, None))[1] for i, g, at in data}
    assert {x.id: x.v for x in got.collect()} == want and got.count() == len(data)


def test_alphabetic_labels_of_any_length(spark):
    from foliospark.operators.text import alphabetic

    def plain(n):
        out = ""
        while n > 0:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out

    numbers = [0, -3, 1, 26, 27, 52, 703, 321_272_406, 321_272_407, 2**40, 2**62]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", alphabetic(F.col("n")).alias("t")).collect()
    assert {x.n: x.t for x in got} == {n: plain(n) for n in numbers}


def test_a_turn_without_a_text_stays(spark):
    from foliospark.operators.models import conversation

    df = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "bot", None), (1, 3, "user", "so")], "c long, turn long, role string, text string")
    assert conversation(df, ["c"], "turn", "role", "text").first().history == "user: hi\nbot: \nuser: so"
