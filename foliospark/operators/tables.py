"""Tables on pages: rulings, ruled grids, borderless runs, cell text, stitching, Markdown."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.rows import merge_intervals, sessions

#: Distances in points. Fixed values.
SAME_LINE, JOIN_GAP, LEAST_RULE, CROSS, TOUCH = 2.0, 3.0, 8.0, 3.0, 6.0


def normalise_rules(rules: DataFrame, by: list[str]) -> DataFrame:
    """Rulings as straight lines: by, ``vertical``, ``pos``, ``lo``, ``hi``.

    Lines up to two points apart are one, at the mean of their places weighed by length; spans with gaps up to three
    points are joined; what is left under eight points goes. Slanted lines are dropped.
    """
    across, down = F.abs(F.col("y1") - F.col("y0")) <= 1, F.abs(F.col("x1") - F.col("x0")) <= 1
    straight = rules.where(across | down).select(
        *by, (down & ~(across & (F.abs(F.col("x1") - F.col("x0")) >= F.abs(F.col("y1") - F.col("y0"))))).alias("vertical"), "x0", "y0", "x1", "y1"
    )
    v = F.col("vertical")
    spans = straight.select(*by, "vertical", F.when(v, (F.col("x0") + F.col("x1")) / 2).otherwise((F.col("y0") + F.col("y1")) / 2).alias("pos"), F.when(v, F.least("y0", "y1")).otherwise(F.least("x0", "x1")).alias("lo"), F.when(v, F.greatest("y0", "y1")).otherwise(F.greatest("x0", "x1")).alias("hi"))
    keys = [*by, "vertical"]
    lines = sessions(spans, keys, ["pos", "lo", "hi"], lambda lag: F.col("pos") - lag("pos") > SAME_LINE, "line_")
    weight = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.1))
    at = lines.groupBy(*keys, "line_").agg((F.sum(F.col("pos") * weight) / F.sum(weight)).alias("pos"))
    merged = merge_intervals(lines.select(*keys, "line_", "lo", "hi"), [*keys, "line_"], "lo", "hi", JOIN_GAP, LEAST_RULE)
    return merged.join(at, [*keys, "line_"]).select(*by, "vertical", "pos", "lo", "hi")


def snap(values: list[float], tolerance: float = TOUCH) -> list[float]:
    """Means of runs of values that lie within the tolerance of the one before."""
    out, run = [], []
    for v in sorted(values):
        if run and v - run[-1] > tolerance:
            out.append(sum(run) / len(run))
            run = []
        run.append(v)
    return [*out, sum(run) / len(run)] if run else out


def nearest_index(positions: list[float], value: float, tolerance: float) -> int:
    """The nearest position within the tolerance, the last on ties; -1 if there is none."""
    near = [(abs(p - value), -k) for k, p in enumerate(positions) if abs(p - value) <= tolerance]
    return -min(near)[1] if near else -1


def ruled_cells(horizontal: list[tuple[float, float, float]], vertical: list[tuple[float, float, float]]) -> list[tuple[float, float, float, float]]:
    """The smallest rectangles (llx, lly, urx, ury) that rulings (pos, lo, hi) close on all sides."""
    def covered(rules, pos, lo, hi) -> bool:
        return any(abs(p - pos) <= CROSS and a <= lo + CROSS and b >= hi - CROSS for p, a, b in rules)

    corners = defaultdict(list)  # x: ys of crossings
    for x, y0, y1 in vertical:
        for y, x0, x1 in horizontal:
            if x0 - CROSS <= x <= x1 + CROSS and y0 - CROSS <= y <= y1 + CROSS:
                corners[x].append(y)
    xs, out = sorted(corners), []
    for i, left in enumerate(xs):
        for top in corners[left]:
            found = None
            for right in xs[i + 1 :]:
                if not any(abs(y - top) <= CROSS for y in corners[right]) or not covered(horizontal, top, left, right):
                    continue
                for bottom in sorted((y for y in corners[left] if y < top - CROSS), reverse=True):
                    if any(abs(y - bottom) <= CROSS for y in corners[right]) and covered(horizontal, bottom, left, right) and covered(vertical, left, bottom, top) and covered(vertical, right, bottom, top):
                        found = (left, bottom, right, top)
                        break
                if found:
                    break
            if found:
                out.append(found)
    return out


def touching(boxes: list[tuple[float, float, float, float]], tolerance: float = TOUCH) -> list[list[int]]:
    """Groups of boxes that touch each other, directly or through others, in order of their first."""
    root = list(range(len(boxes)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, a in enumerate(boxes):
        for j in range(i):
            b = boxes[j]
            if a[0] <= b[2] + tolerance and b[0] <= a[2] + tolerance and a[1] <= b[3] + tolerance and b[1] <= a[3] + tolerance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k in range(len(boxes)):
        groups[find(k)].append(k)
    return [groups[k] for k in sorted(groups)]


#: A fragment: x, y, end_x, size, font, text.
Fragment = tuple[float, float, float, float, str, str]


def cell_text(found: list[Fragment]) -> str:
    """Fragments in reading order: lines by y, spaces at gaps of over 0.15 of the size."""
    out, last = [], None
    for f in sorted(found, key=lambda f: (-round(f[1] * 2), f[0])):
        if last is not None:
            if abs(f[1] - last[1]) > max(1.0, 0.3 * f[3]):
                out.append("\n")
            elif f[0] - last[2] > 0.15 * f[3]:
                out.append(" ")
        out.append(f[5])
        last = f
    return "".join(out).strip()


def lattice_tables(horizontal: list, vertical: list, frags: list[Fragment]) -> list[dict]:
    """Ruled tables: bounds, column edges and cells (row, col, row_span, col_span, text). Single boxes are no tables."""
    boxes, out = ruled_cells(horizontal, vertical), []
    for group in touching(boxes):
        if len(group) < 2:
            continue
        mine = [boxes[k] for k in group]
        xs, ys = snap([v for b in mine for v in (b[0], b[2])]), snap([v for b in mine for v in (b[1], b[3])])[::-1]
        cells = []
        for b in mine:
            col, right = nearest_index(xs, b[0], TOUCH), nearest_index(xs, b[2], TOUCH)
            row, below = nearest_index(ys, b[3], TOUCH), nearest_index(ys, b[1], TOUCH)
            inside = [f for f in frags if b[0] <= (f[0] + f[2]) / 2 < b[2] and b[1] <= f[1] + 0.3 * f[3] < b[3]]
            cells.append((row, col, max(1, below - row), max(1, right - col), cell_text(inside)))
        out.append({"kind": "lattice", "box": (min(xs), min(ys), max(xs), max(ys)), "xs": xs, "cells": sorted(cells)})
    return out


# --- tables without rulings

_MARK = re.compile(r"^(?:[•‣◦▪·–*-]|\d{1,3}[.)])")


def _mode_high(values: list) -> tuple:
    counts = Counter(values)
    return max(((n, v) for v, n in counts.items()), default=(0, None))


def text_rows(frags: list[Fragment]) -> list[dict]:
    """Lines split into cells at gaps of four points and 0.56 of the mean size of both sides."""
    lines: list[list[Fragment]] = []
    for f in sorted(frags, key=lambda f: (-round(f[1] * 2), f[0])):
        if lines and abs(lines[-1][-1][1] - f[1]) <= max(1.0, 0.3 * f[3]):
            lines[-1].append(f)
        else:
            lines.append([f])
    rows = []
    for line in lines:
        line.sort(key=lambda f: f[0])
        cells, end, before = [[line[0]]], line[0][2], line[0]
        for f in line[1:]:
            if f[0] - end >= max(4.0, 0.56 * (f[3] + before[3]) / 2):
                cells.append([])
            cells[-1].append(f)
            end, before = max(end, f[2]), f
        weights = Counter()
        for f in line:
            weights[int(f[3] * 2 + 0.5) / 2] += len(f[5])
        size = max(weights, key=lambda s: (weights[s], s))
        rows.append({"y": line[0][1], "size": size, "sizes": weights, "leader": any("....." in f[5] for f in line), "mono": sum(len(f[5]) for f in line if re.search("Courier|Mono|Consol", f[4])), "chars": sum(len(f[5]) for f in line), "cells": [{"lo": min(f[0] for f in c), "hi": max(f[2] for f in c), "text": cell_text(c)} for c in cells]})
    return rows


def runs_of_rows(rows: list[dict], least: int = 3) -> list[list[dict]]:
    """Runs of lines of two cells or more, no further apart than 2.6 times the larger size."""
    out, run = [], []
    for r in rows:
        gap = run[-1]["y"] - r["y"] if run else 0
        if len(r["cells"]) < 2 or (run and not 0 < gap <= 2.6 * max(run[-1]["size"], r["size"])):
            out.append(run)
            run = []
        if len(r["cells"]) >= 2:
            run.append(r)
    return [r for r in [*out, run] if len(r) >= least]


def _upper(values: list) -> float:
    return sorted(values)[len(values) // 2] if values else 0


def stream_table(run: list[dict], rows: list[dict], horizontal: list) -> dict | None:
    """The run as a table, or None where a guard has it for prose, a list, contents, code or ruled lines."""
    count, modal = _mode_high([len(r["cells"]) for r in run])
    if modal < 2 or modal > 15 or count < 3:
        return None
    while run and len(run[0]["cells"]) != modal:
        run = run[1:]
    while run and len(run[-1]["cells"]) != modal:
        run = run[:-1]
    if len(run) < 3:
        return None
    full = [r for r in run if len(r["cells"]) == modal]
    cols = [(min(r["cells"][c]["lo"] for r in full), max(r["cells"][c]["hi"] for r in full)) for c in range(modal)]
    if any(b[0] <= a[1] + 1 for a, b in zip(cols, cols[1:])):
        return None
    edges = [(a[1] + b[0]) / 2 for a, b in zip(cols, cols[1:])]
    for x in edges:
        if sum(not any(c["lo"] - 0.5 < x < c["hi"] + 0.5 for c in r["cells"]) for r in run) < 0.85 * len(run):
            return None
    if sum(r["leader"] for r in run) >= 0.3 * len(run):
        return None
    sizes = Counter()
    for r in run:
        sizes.update(r["sizes"])
    held, total = 0, sum(sizes.values())
    for nth, (_, n) in enumerate(sizes.most_common()):
        held += n
        if held >= 0.9 * total:
            break
    if nth >= 3:
        return None
    left, right, top, bottom = cols[0][0], cols[-1][1], run[0]["y"] + run[0]["size"], run[-1]["y"]
    lines = [p for p, lo, hi in horizontal if bottom - 2 <= p <= top + 2 and min(hi, right) - max(lo, left) > 0.5 * (right - left)]
    if len(lines) >= 3 and not 0.65 < len(run) / (len(lines) - 1) < 1.5:
        return None
    texts = [[r["cells"][c]["text"] for r in full] for c in range(modal)]
    numbers = [int(t) for t in texts[0] if t.isdecimal()]
    if modal == 2 and len(numbers) == len(texts[0]) and all(b == a + 1 for a, b in zip(numbers, numbers[1:])):
        return None
    if sum(bool(_MARK.match(t)) for t in texts[0]) >= 0.7 * len(texts[0]):
        return None
    words = [_upper([len(t.split()) for t in col]) for col in texts]
    if all(w >= 4 for w in words) or (modal == 2 and words[1] >= 4):
        return None
    if modal == 2:
        joined = [f"{a} {b}" for a, b in zip(*texts)]
        if sum(len(t.encode()) >= 25 for t in joined) >= 0.6 * len(joined) and sum(bool(re.search(r"(?:^|\s)\d+$", t)) for t in joined) >= 0.6 * len(joined):
            return None
        if sum(bool(re.fullmatch(r"[1-9]\d{0,3}", t)) for t in texts[1]) >= 0.7 * len(texts[1]) and words[0] >= 3:
            return None
        if sum(r["mono"] for r in run) >= 0.8 * sum(r["chars"] for r in run):
            return None
    single = [r for r in rows if len(r["cells"]) == 1]
    if len(single) >= 0.7 * len(rows):
        area = sum(max(0.0, min(r["cells"][0]["hi"], right) - max(r["cells"][0]["lo"], left)) * r["size"] for r in single if bottom <= r["y"] <= top)
        if area >= 0.8 * (right - left) * (top - bottom):
            return None
    cells = []
    for i, r in enumerate(run):
        slots = defaultdict(list)
        for c in r["cells"]:
            slots[sum((c["lo"] + c["hi"]) / 2 >= x for x in edges)].append(c["text"])
        cells += [(i, c, 1, 1, " ".join(t)) for c, t in sorted(slots.items())]
    return {"kind": "stream", "box": (left, bottom, right, top), "xs": [left, *edges, right], "cells": cells}


def page_tables(frags: list[Fragment], horizontal: list, vertical: list) -> list[dict]:
    """A page's tables, ruled ones first found, from the top and then the left. Text inside a ruled one belongs to it."""
    found = lattice_tables(horizontal, vertical, frags)
    free = [f for f in frags if not any(t["box"][0] <= f[0] <= t["box"][2] and t["box"][1] <= f[1] <= t["box"][3] for t in found)]
    rows = text_rows([f for f in free if f[5].strip()])
    found += [t for run in runs_of_rows(rows) if (t := stream_table(run, rows, horizontal))]
    return sorted(found, key=lambda t: (-t["box"][3], t["box"][0]))


CELLS = "table_no int, kind string, llx double, lly double, urx double, ury double, signature string, row int, col int, row_span int, col_span int, text string"


def detect(frags: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """The cells of all tables: by, then ``CELLS``. Pages are independent; each is one group."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frags.select(*by).schema.fields)
    names = [c.split()[0] for c in CELLS.split(", ")]

    def run(key: tuple, texts: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        page = [tuple(r) for r in texts.sort_values("seq")[["x", "y", "end_x", "size", "font", "text"]].itertuples(index=False)]
        ruled = [(bool(v), p, lo, hi) for v, p, lo, hi in lines[["vertical", "pos", "lo", "hi"]].itertuples(index=False)]
        out = []
        for n, t in enumerate(page_tables(page, [r[1:] for r in ruled if not r[0]], [r[1:] for r in ruled if r[0]]), 1):
            signature = ";".join(str(int((x - t["box"][0]) / 3 + 0.5)) for x in t["xs"])
            out += [(*key, n, t["kind"], *map(float, t["box"]), signature, *c) for c in t["cells"]]
        return pd.DataFrame(out, columns=[*by, *names])

    return frags.groupBy(*by).cogroup(normalise_rules(rules, by).groupBy(*by)).applyInPandas(run, f"{kinds}, {CELLS}")


def stitched(cells: DataFrame, doc: str, page: str) -> DataFrame:
    """Adds ``sheet_no`` and ``sheet_row``: tables on consecutive pages with one signature are one sheet, and a first
    row that repeats the sheet's first is dropped."""
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row") == 0, F.struct("col", "text")))), lambda c: c["text"]), "\x1f")
    tables = cells.groupBy(doc, page, "table_no", "signature").agg(head.alias("head_"), (F.max("row") + 1).alias("rows_"))
    tables = sessions(tables, [doc], [page, "table_no"], lambda lag: (F.col(page) != lag(page) + 1) | (F.col("signature") != lag("signature")), "sheet_no")
    s = Window.partitionBy(doc, "sheet_no").orderBy(page, "table_no")
    tables = tables.withColumn("cut_", F.when((F.row_number().over(s) > 1) & (F.col("head_") == F.first("head_").over(s)), 1).otherwise(0))
    tables = tables.withColumn("before_", F.coalesce(F.sum(F.col("rows_") - F.col("cut_")).over(s.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = cells.join(tables.drop("signature", "head_", "rows_"), [doc, page, "table_no"]).where(F.col("row") >= F.col("cut_"))
    return out.withColumn("sheet_row", F.col("before_") + F.col("row") - F.col("cut_")).drop("before_", "cut_")


def markdown(cells: DataFrame, by: list[str], numeric=None) -> DataFrame:
    """Each table (by) as Markdown, the first row as its head; columns of which most body cells are numbers align right."""
    from foliospark.operators.text import number

    is_number = (numeric or (lambda c: number(c).isNotNull()))(F.col("text"))
    flat = F.replace(F.regexp_replace("text", r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    size = cells.groupBy(*by).agg(F.max("col").alias("last_"))
    right = cells.where("row > 0 AND text <> ''").groupBy(*by, "col").agg((2 * F.sum(F.when(is_number, 1).otherwise(0)) > F.count("*")).alias("right_"))
    aligned = right.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("col", "right_"))).alias("align_"))
    rows = cells.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", flat.alias("t")))).alias("texts_")).join(size, by)
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("last_")), lambda c: F.coalesce(F.element_at("texts_", c), F.lit(""))), " | "), F.lit(" |"))
    body = rows.withColumn("line_", line).groupBy(*by, "last_").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line_"))), lambda r: r["line_"]).alias("lines_"))
    body = body.join(aligned, by, "left")
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("last_")), lambda c: F.when(F.coalesce(F.element_at("align_", c), F.lit(False)), "---:").otherwise("---")), " | "), F.lit(" |"))
    return body.select(*by, F.array_join(F.concat(F.slice("lines_", 1, 1), F.array(rule), F.slice("lines_", 2, F.size("lines_"))), "\n").alias("markdown"))



def edge_columns(edges: list[float], tolerance: float = 6.0) -> list[float]:
    """Left edges that begin a column: those over the tolerance beyond the last one that did."""
    out: list[float] = []
    for e in sorted(edges):
        if not out or e - out[-1] > tolerance:
            out.append(e)
    return out


GRID = "row int, col int, text string"


def full_page(frags: DataFrame, by: list[str]) -> DataFrame:
    """Each page's whole text on one grid: a row for each line, cells where wide gaps part it, columns by their left edges."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frags.select(*by).schema.fields)

    def run(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
        page = [tuple(r) for r in texts.sort_values("seq")[["x", "y", "end_x", "size", "font", "text"]].itertuples(index=False) if r[5].strip()]
        rows = text_rows(page)
        cols = edge_columns([c["lo"] for r in rows for c in r["cells"]])
        slots = defaultdict(list)
        for n, r in enumerate(rows):
            for c in r["cells"]:
                nearest = min(range(len(cols)), key=lambda k: (abs(cols[k] - c["lo"]), k))
                slots[n, nearest].append(c["text"])
        return pd.DataFrame([(*key, n, c, " ".join(t)) for (n, c), t in sorted(slots.items())], columns=[*by, "row", "col", "text"])

    return frags.groupBy(*by).applyInPandas(run, f"{kinds}, {GRID}")
