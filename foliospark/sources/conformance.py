"""Checks of archive (PDF/A) and accessibility (PDF/UA) profiles: a row for each breach, by rule."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from foliospark.sources.pdf import Document, Stream, operations
from foliospark.sources.scan import layer, readable

ISSUES = "rule string, detail string"
#: Operators that paint in device colours. Fixed values.
DEVICE_COLOUR = frozenset(("g", "G", "rg", "RG", "k", "K"))


def _dict(doc: Document, value) -> dict:
    v = doc.resolve(value)
    v = v.head if isinstance(v, Stream) else v
    return v if isinstance(v, dict) else {}


def _dicts(doc: Document) -> list[dict]:
    return [d for d in (o.head if isinstance(o, Stream) else o for o in doc.all_objects()) if isinstance(d, dict)]


def _metadata(doc: Document) -> str:
    found = doc.resolve(doc.root.get("Metadata"))
    return doc.decode(found).decode("utf-8", "replace") if isinstance(found, Stream) else ""


def _xmp(text: str, name: str, value: str) -> str:
    m = re.search(rf"{name}\s*=\s*[\"']({value})[\"']|<{name}\s*>\s*({value})", text)
    return (m[1] or m[2]) if m else ""


def _embedded(doc: Document, font: dict) -> bool:
    if font.get("Subtype") == "Type3":
        return True
    inner = _dict(doc, (doc.resolve(font.get("DescendantFonts")) or [None])[0]) if font.get("Subtype") == "Type0" else font
    return any(k in _dict(doc, inner.get("FontDescriptor")) for k in ("FontFile", "FontFile2", "FontFile3"))


def _tagging(doc: Document, marked: str, tree: str, language: str) -> Iterator[tuple[str, str]]:
    if doc.resolve(_dict(doc, doc.root.get("MarkInfo")).get("Marked")) is not True:
        yield marked, "not marked as tagged"
    if not _dict(doc, doc.root.get("StructTreeRoot")):
        yield tree, "no structure tree"
    if not doc.text(doc.root.get("Lang")):
        yield language, "no language"


def archive_issues(doc: Document, part: int = 1, level: str = "B") -> Iterator[tuple[str, str]]:
    """Breaches of PDF/A of the given part and level."""
    xmp = _metadata(doc)
    own_part, own_level = _xmp(xmp, "pdfaid:part", r"\d+"), _xmp(xmp, "pdfaid:conformance", "[A-Za-z]")
    if not xmp:
        yield "XMP_MISSING", "no metadata stream"
    elif not own_part or not own_level:
        yield "XMP_PDFAID_MISSING", "no part or conformance in the metadata"
    else:
        if own_part != str(part):
            yield "XMP_PART_MISMATCH", own_part
        if own_level.upper() != level.upper():
            yield "XMP_CONFORMANCE_MISMATCH", own_level
    if "Encrypt" in doc.trailer:
        yield "ENCRYPTED", "encrypted"
    found = _dicts(doc)
    for d in found:
        if d.get("Type") == "Font" and d.get("Subtype") not in ("CIDFontType0", "CIDFontType2") and not _embedded(doc, d):
            yield "FONT_NOT_EMBEDDED", doc.text(d.get("BaseFont"))
    actions = {doc.text(d.get("S")) for d in [*found, _dict(doc, doc.root.get("OpenAction"))]}
    if "JavaScript" in actions or "JavaScript" in _dict(doc, doc.root.get("Names")):
        yield "JAVASCRIPT", "script"
    if "Launch" in actions:
        yield "LAUNCH_ACTION", "launches a program"
    intents = doc.resolve(doc.root.get("OutputIntents")) or []
    if not any("DestOutputProfile" in _dict(doc, i) for i in intents):
        for n, p in enumerate(doc.pages(), 1):
            used = next((op for op, _ in operations(doc.content(p)) if op in DEVICE_COLOUR), None)
            if used:
                yield "COLOR_NO_OUTPUT_INTENT", f"{used} on page {n}"
                break
    if part == 1:
        for d in found:
            if doc.text(d.get("S")) == "Transparency" or "SMask" in d and doc.text(d.get("SMask")) != "None" or any(isinstance(v, (int, float)) and v < 1 for v in (doc.resolve(d.get("ca")), doc.resolve(d.get("CA")))):
                yield "TRANSPARENCY", "transparency"
                break
        if any("LZWDecode" in (f if isinstance(f, list) else [f]) for f in (doc.resolve(d.get("Filter")) for d in found)):
            yield "LZW_FILTER", "LZWDecode"
        if "EmbeddedFiles" in _dict(doc, doc.root.get("Names")):
            yield "EMBEDDED_FILES", "attached files"
    for n, p in enumerate(doc.pages(), 1):
        for ref in doc.resolve(p.get("Annots")) or []:
            a = _dict(doc, ref)
            flags = doc.resolve(a.get("F"))
            flags = flags if isinstance(flags, int) else 0
            if a.get("Subtype") != "Popup" and (not flags & 4 or flags & 0x22):
                yield "ANNOTATION_FLAGS", f"page {n}: {flags}"
            if a.get("Subtype") not in ("Popup", "Link") and "AP" not in a:
                yield "ANNOTATION_APPEARANCE", f"page {n}"
    stream = doc.resolve(doc.root.get("Metadata"))
    if isinstance(stream, Stream) and "Filter" in stream.head:
        yield "METADATA_COMPRESSED", "compressed"
    if level.upper() == "A":
        yield from _tagging(doc, "NOT_TAGGED", "NO_STRUCT_TREE", "NO_LANG")


def _elements(doc: Document) -> list[dict]:
    out, seen, todo = [], set(), [doc.root.get("StructTreeRoot")]
    while todo and len(seen) < 1_000_000:
        d = _dict(doc, todo.pop())
        if id(d) in seen:
            continue
        seen.add(id(d))
        if "S" in d:
            out.append(d)
        kids = doc.resolve(d.get("K"))
        todo += [k for k in (kids if isinstance(kids, list) else [kids]) if not isinstance(k, int)]
    return out


def accessibility_issues(doc: Document) -> Iterator[tuple[str, str]]:
    """Breaches of PDF/UA-1."""
    yield from _tagging(doc, "UA_NOT_TAGGED", "UA_NO_STRUCT_TREE", "UA_NO_LANG")
    tree = _dict(doc, doc.root.get("StructTreeRoot"))
    if tree:
        elements, roles = _elements(doc), _dict(doc, tree.get("RoleMap"))
        if not elements:
            yield "UA_STRUCT_TREE_EMPTY", "no elements"
        if "ParentTree" not in tree:
            yield "UA_NO_PARENT_TREE", "no parent tree"
        for e in elements:
            role = doc.text(e.get("S"))
            if doc.text(roles.get(role, role)) == "Figure" and not doc.text(e.get("Alt")).strip() and not doc.text(e.get("ActualText")).strip():
                yield "UA_FIGURE_NO_ALT", role
    info = _dict(doc, doc.trailer.get("Info"))
    if not doc.text(info.get("Title")) and not re.search(r"<dc:title", _metadata(doc)):
        yield "UA_NO_TITLE", "no title"
    if doc.resolve(_dict(doc, doc.root.get("ViewerPreferences")).get("DisplayDocTitle")) is not True:
        yield "UA_DISPLAY_DOCTITLE", "shows the file's name"
    permissions = doc.permissions
    if isinstance(permissions, int) and not permissions & 0x200:
        yield "UA_ACCESSIBILITY_DENIED", "text can't be extracted"


def archive(df: DataFrame, by: list[str], part: int = 1, level: str = "B", content: str = "content", password: str = "") -> DataFrame:
    return layer(df, by, content, ISSUES, readable(lambda doc: archive_issues(doc, part, level)), password)


def accessibility(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    return layer(df, by, content, ISSUES, readable(accessibility_issues), password)


FIGURES = "role string, alt string"


@readable
def _figures(doc: Document) -> Iterator[tuple]:
    roles = _dict(doc, _dict(doc, doc.root.get("StructTreeRoot")).get("RoleMap"))
    for e in _elements(doc):
        role = doc.text(e.get("S"))
        if doc.text(roles.get(role, role)) == "Figure":
            yield role, doc.text(e.get("Alt")) if "Alt" in e else None


def figures(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Figures of the structure tree and their alternative texts."""
    return layer(df, by, content, FIGURES, _figures, password)


# --- signatures


def _der(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes, int]]:
    """(tag, content, offset of the content) of the elements of a DER value."""
    end = len(data) if end is None else end
    while at + 2 <= end:
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        yield tag, data[at : at + size], at
        at += size


#: Object identifiers of the digest attribute and of hashes, in DER. Fixed values.
MESSAGE_DIGEST = bytes.fromhex("2a864886f70d010904")
HASHES = {bytes.fromhex("2b0e03021a"): "sha1", bytes.fromhex("608648016503040201"): "sha256", bytes.fromhex("608648016503040202"): "sha384", bytes.fromhex("608648016503040203"): "sha512"}


def _signed_digests(data: bytes) -> tuple[set[str], list[bytes]]:
    """The hashes that a signature names, and the digests of the signed bytes that it holds."""
    names, digests = set(), []

    def walk(value: bytes, depth: int) -> None:
        items = list(_der(value))
        for k, (tag, body, _) in enumerate(items):
            if tag == 6 and body in HASHES:
                names.add(HASHES[body])
            if tag == 6 and body == MESSAGE_DIGEST and k + 1 < len(items):
                digests.extend(b for t, b, _ in _der(items[k + 1][1]) if t == 4)
            if tag & 0x20 and depth < 30:
                walk(body, depth + 1)

    walk(data, 0)
    return names, digests


SIGNATURES = "field string, signer string, reason string, signed_at string, sub_filter string, covers_file boolean, digest_matches boolean"


@readable
def _signatures(doc: Document) -> Iterator[tuple]:
    for d in _dicts(doc):
        value = _dict(doc, d.get("V"))
        if d.get("FT") != "Sig" or "ByteRange" not in value:
            continue
        spans = [doc.resolve(x) for x in doc.resolve(value["ByteRange"]) or []]
        if len(spans) != 4 or not all(isinstance(x, int) and x >= 0 for x in spans):
            continue
        signed = doc.data[spans[0] : spans[0] + spans[1]] + doc.data[spans[2] : spans[2] + spans[3]]
        names, digests = _signed_digests(doc.resolve(value.get("Contents")) or b"")
        matches = any(hashlib.new(n, signed).digest() in digests for n in names)
        yield doc.text(d.get("T")), doc.text(value.get("Name")), doc.text(value.get("Reason")), doc.text(value.get("M")), doc.text(value.get("SubFilter")), spans[2] + spans[3] == len(doc.data), matches


def signatures(df: DataFrame, by: list[str], content: str = "content", password: str = "") -> DataFrame:
    """Signed fields: whether the signature covers the whole file, and whether its digest is that of the signed bytes.
    Certificates and the cipher of the digest aren't checked."""
    return layer(df, by, content, SIGNATURES, _signatures, password)
