"""Form fields as rows, and their interchange as JSON, FDF and XFDF."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.graph import descend


def export_json(fields: DataFrame, by: list[str], omit_empty: bool = False) -> DataFrame:
    """One JSON object a document, of name to type and value, in order of name. A name's last row (by ``seq``) holds."""
    kept = fields.where(F.length("value") > 0) if omit_empty else fields
    last = kept.groupBy(*by, "name").agg(F.max_by(F.struct("type", "value"), "seq").alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("name", "v")))
    return last.groupBy(*by).agg(F.to_json(F.map_from_entries(pairs)).alias("form"))


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", 1)


def export_typed_json(fields: DataFrame, by: list[str], omit_empty: bool = False) -> DataFrame:
    """``export_json`` with values of their ``kind``: checkboxes are true or false, list boxes are arrays (items are lines of the value), push buttons are left out."""
    value = F.coalesce("value", F.lit(""))
    items = F.filter(F.split(value, "\n"), lambda x: x != "")
    off = value.isin("", "Off")
    told = F.when(F.col("kind") == "checkbox", F.when(off, "false").otherwise("true")).when(F.col("kind") == "listbox", F.to_json(items)).otherwise(_quoted(value))
    empty = F.when(F.col("kind") == "checkbox", off).otherwise(value == "")
    entry = F.concat(_quoted(F.col("name")), F.lit(':{"type":'), _quoted(F.col("kind")), F.lit(',"value":'), told, F.lit("}"))
    kept = fields.where(F.col("kind") != "push_button").select(*by, "name", "seq", entry.alias("entry_"), empty.alias("empty_"))
    last = kept.groupBy(*by, "name").agg(F.max_by("entry_", "seq").alias("entry_"), F.max_by("empty_", "seq").alias("empty_"))
    last = last.where(~F.col("empty_")) if omit_empty else last
    entries = F.transform(F.array_sort(F.collect_list(F.struct("name", "entry_"))), lambda p: p["entry_"])
    return last.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("form"))


def import_json(df: DataFrame, by: list[str], json_col: str) -> DataFrame:
    """A row for each field of a form's JSON: by, name, type, value. Items of a list box are joined by line feeds; true and false come as such."""
    parsed = F.from_json(json_col, "map<string,struct<type:string,value:string>>")
    rows = df.select(*by, F.explode(parsed).alias("name", "v")).select(*by, "name", "v.type", "v.value")
    items = F.from_json("value", "array<string>")
    return rows.withColumn("value", F.when((F.col("type") == "listbox") & F.col("value").startswith("["), F.array_join(items, "\n")).otherwise(F.col("value")))


def apply_values(fields: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """``fields`` with the imported values; names without a field are ignored, fields without a value keep theirs."""
    new = values.select(*by, "name", F.col("value").alias("new_"))
    return fields.join(new, [*by, "name"], "left").withColumn("value", F.coalesce("new_", "value")).drop("new_").select(*fields.columns)


def leaf_fields(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Terminal fields of (by, id, parent, seq, partial, type, flags, value): dotted names, with type and flags inherited.

    A node without a partial name is a widget of the field above it. ``by`` keeps documents apart.
    """
    by = by or []
    named = nodes.where("partial IS NOT NULL").select(*by, "id", "parent", "partial", "type", "flags", "value")
    top = named.where("parent IS NULL").select(*by, "id", F.col("partial").alias("name"), "type", "flags", "value")

    def step(both: DataFrame) -> DataFrame:
        return both.select(*(F.col(f"c.{c}").alias(c) for c in by), "c.id", F.concat("t.name", F.lit("."), "c.partial").alias("name"), F.coalesce("c.type", "t.type").alias("type"), F.coalesce("c.flags", "t.flags").alias("flags"), "c.value")

    found = descend(named, by, top, step)
    inner = named.where("parent IS NOT NULL").select(*by, F.col("parent").alias("id")).distinct()
    return found.join(inner, [found[c].eqNullSafe(inner[c]) for c in [*by, "id"]], "left_anti").select(*by, "id", "name", "type", "flags", "value")


def parse_xfdf(text: str) -> list[tuple[str, str]]:
    """(dotted name, value) of each valued field; several values are joined by line feeds. Of a repeated name, the last holds."""
    root = ElementTree.fromstring(text)
    out: dict[str, str] = {}

    def walk(node: ElementTree.Element, name: str) -> None:
        for child in node:
            if child.tag.rpartition("}")[2] == "field":
                own = child.get("name") or ""
                full = f"{name}.{own}" if name and own else name or own
                values = [v.text or "" for v in child if v.tag.rpartition("}")[2] == "value"]
                if values:
                    out[full] = "\n".join(values)
                walk(child, full)

    for node in root.iter():
        if node.tag.rpartition("}")[2] == "fields":
            walk(node, "")
    return list(out.items())


def export_xfdf(pairs: list[tuple[str, str]]) -> str:
    """An XFDF document; dotted names become nested fields, in order of name."""
    root = ElementTree.Element("xfdf", {"xmlns": "http://ns.adobe.com/xfdf/", "xml:space": "preserve"})
    top = ElementTree.SubElement(root, "fields")
    made = {"": top}
    for name, value in sorted(pairs):
        at = ""
        for part in name.split("."):
            full = f"{at}.{part}" if at else part
            if full not in made:
                made[full] = ElementTree.SubElement(made[at], "field", {"name": part})
            at = full
        ElementTree.SubElement(made[at], "value").text = value
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ElementTree.tostring(root, encoding="unicode")


def _literal(text: str) -> str:
    return "(" + re.sub(r"([\\()])", r"\\\1", text).replace("\r", "\\r").replace("\n", "\\n") + ")"


def export_fdf(pairs: list[tuple[str, str]]) -> str:
    fields = "\n".join(f"<< /T {_literal(n)} /V {_literal(v)} >>" for n, v in sorted(pairs))
    return f"%FDF-1.2\n1 0 obj\n<< /FDF << /Fields [\n{fields}\n] >> >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n"


def parse_fdf(text: str) -> list[tuple[str, str]]:
    """(dotted name, value) of an FDF's fields, nested by /Kids."""
    from foliospark.sources.pdf import Document, Name

    doc = Document.from_objects(text.encode("latin-1", "replace"))
    out: dict[str, str] = {}

    def walk(fields, name: str) -> None:
        for f in doc.resolve(fields) or []:
            d = doc.resolve(f)
            if not isinstance(d, dict):
                continue
            own = doc.text(d.get("T"))
            full = f"{name}.{own}" if name and own else name or own
            value = doc.resolve(d.get("V"))
            if value is not None:
                out[full] = str(value) if isinstance(value, Name) else "\n".join(doc.text(v) for v in value) if isinstance(value, list) else doc.text(value)
            walk(d.get("Kids"), full)

    for obj in doc.all_objects():
        if isinstance(obj, dict) and "FDF" in obj:
            walk((doc.resolve(obj["FDF"]) or {}).get("Fields"), "")
    return list(out.items())


def imported(df: DataFrame, by: list[str], text_col: str, parse=parse_xfdf) -> DataFrame:
    """A row for each field of each document's XFDF or FDF text: by, name, value. Damaged texts give no rows."""
    rows = df.select(*by, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", name string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k, text in enumerate(b.column(len(by)).to_pylist()):
                try:
                    pairs = parse(text) if text else []
                except (ValueError, ElementTree.ParseError):
                    pairs = []
                at += [k] * len(pairs)
                found += pairs
            keys = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns[: len(by)], pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.string())], names=[*by, "name", "value"])

    return rows.mapInArrow(run, schema)
