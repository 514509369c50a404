"""PDF files as tables: one scan for each layer, over a binary column, in Arrow batches.

A file is read whole by one task, which is also the unit of recovery; nothing else is gathered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.sources.pdf import FILTERS, Document, Interpreter, Name, Ref, Stream


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """``path, modificationTime, length, content`` of the files in a folder and those below it. Files without a byte aren't listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


#: Files in one Arrow batch that is written, and in one that is handed to Python.
BATCH, HANDED = 16, 64


def layer(df: DataFrame, by: list[str], content: str, schema: str, rows: Callable[[Document], Iterator[tuple]], password: str = "") -> DataFrame:
    """The rows that ``rows`` finds in each file, after the columns of ``by``. A file that can't be read has none."""
    kinds = StructType.fromDDL(schema)
    if clash := {*by} & {*kinds.names}:
        raise ValueError(f"the layer has columns {sorted(clash)} of its own; rename the key")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(HANDED))  # a worker holds a batch whole
    wanted = df.select(*by, content)
    full = StructType([wanted.schema[c] for c in by] + list(kinds))
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), BATCH):
                b = whole.slice(start, BATCH)
                out = []
                for *keys, data in zip(*(b.column(i).to_pylist() for i in range(len(by) + 1))):
                    out += [(*keys, *r) for r in rows(Document(data or b"", password))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return wanted.mapInArrow(run, full)


DOCUMENTS = "status string, version string, n_pages int, n_objects int, encrypted boolean, permissions bigint, info map<string,string>, language string, has_form boolean, has_outlines boolean, tagged boolean, labelled boolean"


def _document(doc: Document) -> Iterator[tuple]:
    at = doc.data.find(b"%PDF-")
    version = doc.data[at + 5 : at + 8].decode("latin-1") if at >= 0 else None
    if doc.status == "failed":
        yield doc.status, version, 0, len(doc.where), False, None, [], None, False, False, False, False
        return
    root = doc.root
    info = doc.resolve(doc.trailer.get("Info"))
    info = {k: doc.text(v) for k, v in info.items()} if isinstance(info, dict) else {}
    yield doc.status, version, len(doc.pages()), len(doc.where), "Encrypt" in doc.trailer, doc.permissions, list(info.items()), doc.text(root["Lang"]) if "Lang" in root else None, "AcroForm" in root, "Outlines" in root, "StructTreeRoot" in root, "PageLabels" in root


def documents(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """One row for each file: how it opened, and what its trailer and catalogue say."""
    return layer(df, by, content, DOCUMENTS, _document, password)


def readable(rows):
    """Locked and damaged files have no rows in the layers below the document."""
    return lambda doc: rows(doc) if doc.status in ("ok", "recovered") else iter(())


PAGES = "page_no int, llx double, lly double, urx double, ury double, crop array<double>, rotation int, n_annotations int"


@readable
def _pages(doc: Document) -> Iterator[tuple]:
    for n, p in enumerate(doc.pages(), 1):
        box = doc.box(p.get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
        crop = doc.box(p.get("CropBox"))
        turn = doc.resolve(p.get("Rotate"))
        yield n, *box, list(crop or box), turn % 360 if isinstance(turn, int) else 0, len(doc.resolve(p.get("Annots")) or [])


def pages(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    return layer(df, by, content, PAGES, _pages, password)


def _shown(doc: Document) -> Iterator[tuple[int, Interpreter]]:
    for n, p in enumerate(doc.pages(), 1):
        found = Interpreter(doc)
        found.run(doc.content(p), p.get("Resources"))
        yield n, found


FRAGMENTS = "page_no int, seq int, x double, y double, end_x double, size double, font string, text string, rotation double"


@readable
def _fragments(doc: Document) -> Iterator[tuple]:
    for n, found in _shown(doc):
        for k, f in enumerate(found.fragments):
            yield n, k, f.x, f.y, f.end_x, f.size, f.font, f.text, f.rotation


def fragments(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Runs of text as drawn, in the form that the layout operators take."""
    return layer(df, by, content, FRAGMENTS, _fragments, password)


RULES = "page_no int, seq int, x0 double, y0 double, x1 double, y1 double"


@readable
def _rules(doc: Document) -> Iterator[tuple]:
    for n, found in _shown(doc):
        for k, r in enumerate(found.rules):
            yield n, k, *r


def rules(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Straight lines and sides of rectangles that are painted."""
    return layer(df, by, content, RULES, _rules, password)


IMAGES = "page_no int, seq int, name string, llx double, lly double, urx double, ury double, width int, height int"


@readable
def _images(doc: Document) -> Iterator[tuple]:
    for n, found in _shown(doc):
        for k, i in enumerate(found.images):
            yield n, k, *i


def images(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Where images are drawn, and their size in pixels; none is decoded."""
    return layer(df, by, content, IMAGES, _images, password)


IMAGE_DATA = "num int, width int, height int, bits int, colour_space string, encoding string, data binary"


@readable
def _image_data(doc: Document) -> Iterator[tuple]:
    for num in sorted(doc.where):
        v = doc.get(num)
        if isinstance(v, Stream) and v.head.get("Subtype") == "Image":
            number = lambda key: n if isinstance(n := doc.resolve(v.head.get(key)), int) else 0
            names = doc.resolve(v.head.get("Filter")) or []
            left = [str(n) for n in (names if isinstance(names, list) else [names]) if str(n) not in FILTERS]
            space = doc.resolve(v.head.get("ColorSpace"))
            yield num, number("Width"), number("Height"), number("BitsPerComponent"), doc.text(space[0] if isinstance(space, list) and space else space), left[0] if left else "raw", doc.decode(v)


def image_data(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Images as they are stored: raw samples, or the bytes of the image format that ``encoding`` names."""
    return layer(df, by, content, IMAGE_DATA, _image_data, password)


def _plain(doc: Document, v, depth: int = 0):
    if isinstance(v, Ref):
        return f"{v.num} {v.gen} R"
    if isinstance(v, Name):
        return f"/{v}"
    if isinstance(v, bytes):
        return doc.text(v)
    if depth > 20:
        return None
    if isinstance(v, Stream):
        return _plain(doc, v.head, depth + 1)
    if isinstance(v, list):
        return [_plain(doc, x, depth + 1) for x in v]
    return {k: _plain(doc, x, depth + 1) for k, x in v.items()} if isinstance(v, dict) else v


def _refs(v) -> set[int]:
    if isinstance(v, Ref):
        return {v.num}
    parts = v.head.values() if isinstance(v, Stream) else v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return set().union(*map(_refs, parts))


OBJECTS = "num int, kind string, type string, value string, refs array<int>, stream_sha256 string, stream_bytes bigint"


@readable
def _objects(doc: Document) -> Iterator[tuple]:
    import hashlib

    for num in sorted(doc.where):
        v = doc.get(num)
        if v is None:
            continue
        head = v.head if isinstance(v, Stream) else v
        kind = "stream" if isinstance(v, Stream) else {dict: "dict", list: "array", bytes: "string", Name: "name", bool: "boolean"}.get(type(v), "number")
        data = doc.decode(v) if isinstance(v, Stream) else None
        plain = _plain(doc, {k: x for k, x in head.items() if k != "Length"} if isinstance(v, Stream) else v)
        yield num, kind, doc.text(head.get("Type")) or None if isinstance(head, dict) else None, json.dumps(plain, sort_keys=True, ensure_ascii=False), sorted(_refs(v)), hashlib.sha256(data).hexdigest() if data is not None else None, len(data) if data is not None else None


def objects(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """All objects: their value as JSON, what they refer to, and the digest of their decoded stream."""
    return layer(df, by, content, OBJECTS, _objects, password)


def duplicate_streams(objs: DataFrame, by: list[str]) -> DataFrame:
    """Stream objects with ``keep_num``, the least number of those with equal dictionaries and bytes."""
    streams = objs.where("kind = 'stream'")
    least = streams.groupBy(*by, "value", "stream_sha256").agg(F.min("num").alias("keep_num"))
    return streams.join(least, [*by, "value", "stream_sha256"])


OUTLINES = "id int, parent int, seq int, title string, level int"
_outlines = readable(lambda doc: iter(doc.outlines()))


def outlines(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    return layer(df, by, content, OUTLINES, _outlines, password)


FIELDS = "name string, type string, flags bigint, value string"
_fields = readable(lambda doc: (f[:4] for f in doc.fields()))


def fields(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Leaf fields of the form with dotted names; type, flags and value are inherited."""
    return layer(df, by, content, FIELDS, _fields, password)


#: Bits of fields' flags, from 1. Fixed values.
FIELD_BITS = {"radio": 16, "push_button": 17, "combobox": 18, "password": 14, "file": 21, "rich_text": 26}


def field_kind(type: Column, flags: Column, script: Column) -> Column:
    """One of eleven kinds of field by its type, flags and formatting script, or ``unknown``."""
    has = lambda name: flags.bitwiseAND(1 << (FIELD_BITS[name] - 1)) != 0
    button = F.when(has("push_button"), "push_button").when(has("radio"), "radio").otherwise("checkbox")
    choice = F.when(has("combobox"), "combobox").otherwise("listbox")
    entry = F.when(has("file"), "file").when(has("password"), "password").when(has("rich_text"), "rich_text").when(script.contains("AFNumber"), "number").when(script.contains("AFDate"), "date").otherwise("text")
    return F.when(type == "Btn", button).when(type == "Ch", choice).when(type == "Tx", entry).otherwise("unknown")


def typed_fields(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """``fields`` with their formatting ``script`` (or null) and their ``kind``."""
    found = layer(df, by, content, FIELDS + ", script string", readable(lambda doc: iter(doc.fields())), password)
    return found.withColumn("kind", field_kind(F.col("type"), F.col("flags"), F.col("script")))


LAYERS = "seq int, name string, visible boolean"


@readable
def _layers(doc: Document) -> Iterator[tuple]:
    about = doc.resolve(doc.root.get("OCProperties"))
    if not isinstance(about, dict):
        return
    usual = doc.resolve(about.get("D"))
    hidden = {r.num for r in (doc.resolve(usual.get("OFF")) if isinstance(usual, dict) else None) or [] if isinstance(r, Ref)}
    for k, ref in enumerate(doc.resolve(about.get("OCGs")) or []):
        group = doc.resolve(ref)
        if isinstance(group, dict):
            yield k, doc.text(group.get("Name")), not (isinstance(ref, Ref) and ref.num in hidden)


def layers(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Layers of optional content in the file's order, and whether they show by default."""
    return layer(df, by, content, LAYERS, _layers, password)


SCRIPTS = "name string, script string"


@readable
def _scripts(doc: Document) -> Iterator[tuple]:
    tree = (doc.resolve(doc.root.get("Names")) or {}).get("JavaScript")
    found = {name: doc.script(action) if isinstance(action, dict) else "" for name, action in doc.names(tree)}
    yield from sorted(found.items())


def scripts(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """The document's named scripts in order of name; of a repeated name, the last holds. None is run."""
    return layer(df, by, content, SCRIPTS, _scripts, password)


#: Metadata properties and their columns. Fixed values.
PROPERTIES = {
    "{http://purl.org/dc/elements/1.1/}title": "title", "{http://purl.org/dc/elements/1.1/}creator": "authors", "{http://purl.org/dc/elements/1.1/}description": "description", "{http://purl.org/dc/elements/1.1/}subject": "keywords",
    "{http://ns.adobe.com/xap/1.0/}CreatorTool": "creator_tool", "{http://ns.adobe.com/pdf/1.3/}Producer": "producer",
    "{http://ns.adobe.com/xap/1.0/}CreateDate": "create_date", "{http://ns.adobe.com/xap/1.0/}ModifyDate": "modify_date", "{http://ns.adobe.com/xap/1.0/}MetadataDate": "metadata_date",
}
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XMP = "title string, authors array<string>, description string, keywords array<string>, creator_tool string, producer string, create_date string, modify_date string, metadata_date string, custom map<string,string>"


@readable
def _xmp(doc: Document) -> Iterator[tuple]:
    from xml.etree import ElementTree

    stream = doc.resolve(doc.root.get("Metadata"))
    if not isinstance(stream, Stream):
        return
    try:
        top = ElementTree.fromstring(doc.decode(stream).strip(b"\x00 \t\r\n"))
    except (ElementTree.ParseError, ValueError, LookupError):
        return
    known: dict[str, list[str]] = {}
    custom: dict[str, str] = {}
    for about in top.iter(f"{_RDF}Description"):
        found = [(k, [v]) for k, v in about.attrib.items() if not k.startswith(_RDF)]
        for e in about:
            items = [(i.text or "").strip() for i in e.iter(f"{_RDF}li")]
            found.append((e.tag, items or [(e.text or "").strip()]))
        for key, values in found:
            if key in PROPERTIES:
                known[PROPERTIES[key]] = values
            else:
                custom[key.replace("{", "").replace("}", "")] = "\n".join(values)
    one = lambda key: known[key][0] if known.get(key) else None
    yield one("title"), known.get("authors", []), one("description"), known.get("keywords", []), *map(one, ("creator_tool", "producer", "create_date", "modify_date", "metadata_date")), list(custom.items())


def xmp(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """The metadata packet of each file that has a well-formed one; properties without a column are in ``custom``, by their full names."""
    return layer(df, by, content, XMP, _xmp, password)


def resource_names(images: DataFrame, by: list[str], data: str = "data", seq: str = "num") -> DataFrame:
    """Adds ``sha256`` and ``resource_no``: equal images of a document share the number, which counts from 1 in order of their first.

    Only digests and positions are shuffled; bytes stay where they are until a number is joined to them.
    """
    from pyspark.sql import Window

    digested = images.withColumn("sha256", F.sha2(data, 256))
    first = digested.groupBy(*by, "sha256").agg(F.min(seq).alias("first_"))
    numbers = first.select(*by, "sha256", F.row_number().over(Window.partitionBy(*by).orderBy("first_", "sha256")).alias("resource_no"))
    return digested.join(numbers, [*by, "sha256"])


def optimise_report(objs: DataFrame, by: list[str]) -> DataFrame:
    """What could be saved in each document: by, n_objects, n_streams, duplicate_streams, duplicate_bytes, uncompressed_streams, uncompressed_bytes.

    Of equal streams, one is kept. Bytes are of decoded streams. Two aggregations by the same prefix of keys; nothing is collected.
    """
    stream = F.col("kind") == "stream"
    plain = stream & F.get_json_object("value", "$.Filter").isNull()
    alike = objs.withColumn("value", F.when(stream, F.sha2("value", 256))).groupBy(*by, "value", "stream_sha256").agg(
        F.count("*").alias("n_"), F.count_if(stream).alias("s_"), F.count_if(plain).alias("p_"), F.sum(F.when(plain, F.col("stream_bytes"))).alias("pb_"), F.max("stream_bytes").alias("one_"),
    )
    extra = F.greatest(F.col("s_") - 1, F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return alike.groupBy(*by).agg(
        total("n_").alias("n_objects"), total("s_").alias("n_streams"), total(extra).alias("duplicate_streams"), total(extra * F.coalesce("one_", F.lit(0))).alias("duplicate_bytes"),
        total("p_").alias("uncompressed_streams"), total("pb_").alias("uncompressed_bytes"),
    )


ANNOTATIONS = "page_no int, seq int, subtype string, llx double, lly double, urx double, ury double, contents string, uri string, flags bigint"


@readable
def _annotations(doc: Document) -> Iterator[tuple]:
    for n, p in enumerate(doc.pages(), 1):
        for k, ref in enumerate(doc.resolve(p.get("Annots")) or []):
            a = doc.resolve(ref)
            if isinstance(a, dict):
                action = doc.resolve(a.get("A"))
                uri = doc.text(action["URI"]) if isinstance(action, dict) and "URI" in action else None
                flags = doc.resolve(a.get("F"))
                yield n, k, doc.text(a.get("Subtype")), *(doc.box(a.get("Rect")) or (None,) * 4), doc.text(a.get("Contents")) if "Contents" in a else None, uri, flags if isinstance(flags, int) else 0


def annotations(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    return layer(df, by, content, ANNOTATIONS, _annotations, password)


LABELS = "first int, style string, prefix string, start int"


@readable
def _labels(doc: Document) -> Iterator[tuple]:
    for key, d in doc.names(doc.root.get("PageLabels")):
        if isinstance(d, dict) and isinstance(key, int):
            start = doc.resolve(d.get("St"))
            yield key, doc.text(d["S"]) if "S" in d else None, doc.text(d.get("P")), start if isinstance(start, int) and start >= 1 else 1


def page_labels(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """The ranges that the file's page labels are made of."""
    return layer(df, by, content, LABELS, _labels, password)


EMBEDDED = "name string, description string, size bigint, content binary"


@readable
def _embedded(doc: Document) -> Iterator[tuple]:
    tree = (doc.resolve(doc.root.get("Names")) or {}).get("EmbeddedFiles")
    for name, about in sorted(doc.names(tree), key=lambda p: p[0]):
        files_of = doc.resolve(about.get("EF")) if isinstance(about, dict) else None
        stream = doc.resolve(files_of.get("UF") or files_of.get("F")) if isinstance(files_of, dict) else None
        if isinstance(stream, Stream):
            data = doc.decode(stream)
            yield name, doc.text(about.get("Desc")), len(data), data


def embedded_files(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Attached files in order of name."""
    return layer(df, by, content, EMBEDDED, _embedded, password)


DESTINATIONS = "name string, page_no int, fit string"


@readable
def _destinations(doc: Document) -> Iterator[tuple]:
    numbers = {}
    for n, p in enumerate(doc.pages(), 1):
        numbers[json.dumps(_plain(doc, p), sort_keys=True)] = n
    old = doc.resolve(doc.root.get("Dests"))
    pairs = list(old.items()) if isinstance(old, dict) else []
    pairs += doc.names((doc.resolve(doc.root.get("Names")) or {}).get("Dests"))
    where = {}

    def walk(ref, n):
        node = doc.resolve(ref)
        if isinstance(ref, Ref) and isinstance(node, dict) and ref.num not in where:
            if "Kids" in node:
                where[ref.num] = None
                for kid in doc.resolve(node["Kids"]) or []:
                    n = walk(kid, n)
                return n
            where[ref.num] = n
            return n + 1
        return n

    walk(doc.root.get("Pages"), 1)
    for name, v in pairs:
        v = doc.resolve(v)
        v = doc.resolve(v.get("D")) if isinstance(v, dict) else v
        if isinstance(v, list) and v:
            page = where.get(v[0].num) if isinstance(v[0], Ref) else v[0] + 1 if isinstance(v[0], int) else None
            yield name, page, doc.text(v[1]) if len(v) > 1 else None


def destinations(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Named destinations and the pages that they lead to."""
    return layer(df, by, content, DESTINATIONS, _destinations, password)


#: Bits of the permissions, from 1. Fixed values.
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "extract": 10, "assemble": 11, "print_high": 12}


def permission(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(1 << (PERMISSIONS[name] - 1)) != 0


#: First bytes of kinds of files. Fixed values.
MAGIC = {"pdf": "25504446", "png": "89504e47", "jpeg": "ffd8ff", "gif": "474946", "zip": "504b0304", "gzip": "1f8b", "tiff_le": "49492a00", "tiff_be": "4d4d002a", "bmp": "424d"}


def sniff(content: Column) -> Column:
    """The kind of file by its first bytes, or null."""
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    out = F.lit(None).cast("string")
    for kind, start in MAGIC.items():
        out = F.when(head.startswith(start), kind).otherwise(out)
    return out


ISSUES = "rule string, detail string"


def _issues(doc: Document) -> Iterator[tuple]:
    if not doc.data.startswith(b"%PDF"):
        yield "header", "no %PDF- at the start"
    if doc.status == "failed":
        yield "structure", "no catalogue"
        return
    if doc.status == "recovered":
        yield "cross_reference", "rebuilt"
    if "Encrypt" in doc.trailer:
        yield "encrypted", None if doc.permissions is None else str(doc.permissions)
    if doc.status not in ("ok", "recovered"):
        return
    info = doc.resolve(doc.trailer.get("Info"))
    found = doc.pages()
    if not found:
        yield "pages", "none"
    if not (isinstance(info, dict) and "Title" in info):
        yield "title", "missing"
    if "Lang" not in doc.root:
        yield "language", "missing"
    if "StructTreeRoot" not in doc.root:
        yield "tagged", "no structure tree"
    for n, p in enumerate(found, 1):
        x0, y0, x1, y1 = doc.box(p.get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
        if x1 <= x0 or y1 <= y0:
            yield "media_box", str(n)


def issues(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """What is wrong with each file: by, rule, detail. Each file is read once."""
    return layer(df, by, content, ISSUES, _issues, password)
