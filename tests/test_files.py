"""The PDF reader and its layers, over files made here."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.operators import layout, tables
from foliospark.sources import aes, conformance, pdf, scan
from foliospark.streaming import arrivals

EXTRA = [
    b"<< /Title (Outline \\(1\\)) /Next 6 0 R /First 7 0 R >>", b"<< /Title <FEFF00E9> >>", b"<< /Title (Child) >>",
    b"<< /T (form) /FT /Tx /Ff 4 /Kids [9 0 R 10 0 R] >>", b"<< /T (a) /V (one) /Parent 8 0 R >>", b"<< /T (b) /FT /Btn /V /Yes /Parent 8 0 R >>",
    b"<< /Type /Filespec /UF (x.txt) /Desc (note) /EF << /F 12 0 R >> >>", b"<< /Length 5 >>\nstream\nhello\nendstream",
    b"<< /Subtype /Link /Rect [10 20 0 5] /A << /S /URI /URI (http://u/) >> /Contents (see) /F 4 >>", b"<< /Length 5 >>\nstream\nhello\nendstream",
]
CATALOG = "/Lang (en) /Outlines << /First 5 0 R >> /AcroForm << /Fields [8 0 R] >> /Names << /EmbeddedFiles << /Names [(x.txt) 11 0 R] >> >> /PageLabels << /Nums [0 << /S /r >> 1 << /S /D /P (A-) /St 3 >>] >>"


def sample(**how):
    return pdf.write([[(72, 700, 12, "Hello (World) é"), (72, 680, 12, "second line")], [(72, 700, 10, "page two")]], info={"Title": "T"}, objects=EXTRA, catalog=CATALOG, **how)


def revised(data):
    """The file with a later revision of its first outline."""
    start = data.rfind(b"startxref")
    old = int(data[start + 10 :].split()[0])
    at = len(data)
    data += b"5 0 obj\n<< /Title (New) >>\nendobj\n"
    where = len(data)
    return data + b"xref\n5 1\n%010d 00000 n \ntrailer\n<< /Size 99 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old, where)


def encrypted(data, user=b"", owner=b"o"):
    """The file under RC4 with a 40-bit key."""
    pad = pdf._PAD
    o = pdf._rc4(hashlib.md5((owner + pad)[:32]).digest()[:5], (user + pad)[:32])
    key = hashlib.md5((user + pad)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + b"id").digest()[:5]
    doc = pdf.Document(data)
    out, offsets = bytearray(b"%PDF-1.4\n"), {}
    hexed = lambda b: b"<" + b.hex().encode() + b">"

    def form(v, num):
        k = hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0").digest()[:10]
        if isinstance(v, pdf.Name):
            return b"/" + str(v).encode()
        if isinstance(v, pdf.Ref):
            return b"%d %d R" % (v.num, v.gen)
        if isinstance(v, bytes):
            return hexed(pdf._rc4(k, v))
        if isinstance(v, list):
            return b"[" + b" ".join(form(x, num) for x in v) + b"]"
        if isinstance(v, dict):
            return b"<<" + b" ".join(b"/" + a.encode() + b" " + form(b, num) for a, b in v.items()) + b">>"
        if isinstance(v, pdf.Stream):
            return form(v.head, num) + b"\nstream\n" + pdf._rc4(k, v.raw) + b"\nendstream"
        return str(v).encode()

    for num in sorted(n for n in doc.where if n):
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num + form(doc.get(num), num) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % p for p in offsets.items())
    out += b"trailer << /Root 1 0 R /Info 4 0 R /ID [<6964> <6964>] /Encrypt << /Filter /Standard /V 1 /R 2 /P -4 /O %s /U %s >> >>\nstartxref\n%d\n%%%%EOF" % (hexed(o), hexed(pdf._rc4(key, pad)), at)
    return bytes(out)


def packed(data):
    """The file with its plain objects in an object stream, behind a cross-reference stream."""
    doc = pdf.Document(data)
    plain = [n for n in sorted(doc.where) if n and not isinstance(doc.get(n), pdf.Stream)]
    spans = {}
    for n in plain:
        at = doc.where[n][0]
        body = data[at : data.index(b"endobj", at)].split(b"obj", 1)[1].strip()
        spans[n] = body
    head, body = b"", b""
    for n, b in spans.items():
        head += b"%d %d " % (n, len(body))
        body += b + b" "
    out, where = bytearray(b"%PDF-1.5\n"), {}
    for n in sorted(doc.where):
        if n and n not in spans:
            at = doc.where[n][0]
            where[n] = (1, len(out), 0)
            out += data[at : data.index(b"endobj", at)] + b"endobj\n"
    top = max(doc.where) + 1
    where |= {n: (2, top, k) for k, n in enumerate(plain)} | {top: (1, len(out), 0)}
    raw = zlib.compress(head + body)
    out += b"%d 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (top, len(plain), len(head), len(raw)) + raw + b"\nendstream endobj\n"
    at = len(out)
    where[top + 1] = (1, at, 0)
    rows = b"".join((bytes([0, *([0] * 6)]) if n not in where else bytes([0, where[n][0]]) + where[n][1].to_bytes(3, "big") + where[n][2].to_bytes(2, "big")) for n in range(top + 2))
    raw = zlib.compress(rows)
    out += b"%d 0 obj << /Type /XRef /Size %d /W [1 3 2] /Root 1 0 R /Info 4 0 R /Filter /FlateDecode /DecodeParms << /Predictor 10 /Columns 6 >> /Length %d >>\nstream\n" % (top + 1, top + 2, len(raw)) + raw + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at
    return bytes(out)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pdf")
    whole = sample()
    for name, data in {"plain": whole, "raw": sample(compress=False), "cut": whole[: len(whole) - 400], "junk": b"junk", "revised": revised(whole), "locked": encrypted(whole, b"u"), "open": encrypted(whole), "packed": packed(whole)}.items():
        (at / f"{name}.pdf").write_bytes(data)
    return at


@pytest.fixture(scope="module")
def files(spark, folder):
    return scan.files(spark, str(folder)).withColumn("file", F.regexp_extract("path", r"([^/]+)\.pdf$", 1)).select("file", "content")


def test_how_files_open(files):
    got = {r.file: r for r in scan.documents(files, ["file"]).collect()}
    assert {n: r.status for n, r in got.items()} == {"plain": "ok", "raw": "ok", "cut": "recovered", "junk": "failed", "revised": "ok", "locked": "encrypted", "open": "ok", "packed": "ok"}
    for n in ("plain", "raw", "cut", "revised", "open", "packed"):
        assert got[n].n_pages == 2 and got[n].has_form and got[n].language == "en", n
    assert got["plain"].info == {"Title": "T"} and got["open"].encrypted and got["open"].permissions == -4


def test_password(files):
    got = {r.file: r.status for r in scan.documents(files.where("file = 'locked'"), ["file"], password="u").collect()}
    assert got == {"locked": "ok"}
    assert scan.documents(files.where("file = 'locked'"), ["file"], password="o").first().status == "ok"


def test_text(files):
    frags = scan.fragments(files, ["file"])
    by = ["file", "page_no"]
    got = {(r.file, r.page_no): r.text for r in layout.page_text(layout.assemble(layout.with_lines(frags, by), by), by).collect()}
    for n in ("plain", "raw", "revised", "open", "packed"):
        assert got[n, 1] == "Hello (World) é\n\nsecond line" and got[n, 2] == "page two", n
    assert ("junk", 1) not in got and ("locked", 1) not in got


def test_layers(files):
    plain = files.where("file = 'plain'")
    rows = lambda layer: [tuple(r)[1:] for r in layer(plain, ["file"]).collect()]
    assert rows(scan.pages) == [(1, 0.0, 0.0, 612.0, 792.0, [0.0, 0.0, 612.0, 792.0], 0, 0), (2, 0.0, 0.0, 612.0, 792.0, [0.0, 0.0, 612.0, 792.0], 0, 0)]
    assert rows(scan.outlines) == [(0, None, 1, "Outline (1)", 1), (1, 0, 1, "Child", 2), (2, None, 2, "é", 1)]
    assert rows(scan.fields) == [("form.a", "Tx", 4, "one"), ("form.b", "Btn", 4, "Yes")]
    assert rows(scan.page_labels) == [(0, "r", "", 1), (1, "D", "A-", 3)]
    assert rows(scan.embedded_files) == [("x.txt", "note", 5, bytearray(b"hello"))]
    assert [tuple(r)[1:] for r in scan.outlines(files.where("file = 'revised'"), ["file"]).collect()] == [(0, None, 1, "New", 1)]
    streams = {r.num: r.keep_num for r in scan.duplicate_streams(scan.objects(plain, ["file"]), ["file"]).collect()}
    assert streams[12] == streams[14] == 12


def test_clashing_keys(files):
    with pytest.raises(ValueError):
        scan.fields(files.withColumnRenamed("file", "name"), ["name"])


def test_issues(files):
    got = {(r.file, r.rule) for r in scan.issues(files, ["file"]).collect()}
    assert {("junk", "header"), ("cut", "cross_reference"), ("open", "encrypted"), ("plain", "tagged"), ("junk", "structure")} <= got
    assert ("plain", "title") not in got


@pytest.mark.parametrize(
    "name, raw, want",
    [("ASCIIHexDecode", b"48 65 6C6>", b"Hel`"), ("ASCII85Decode", b"<~87cURD]i,\"Ebo80~>", b"Hello World!"), ("RunLengthDecode", b"\x02abc\xfex\x80", b"abcxxx"), ("LZWDecode", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), b"-----A---B"), ("FlateDecode", zlib.compress(b"abc"), b"abc")],
)
def test_filters(name, raw, want):
    doc = pdf.Document(b"")
    assert doc.decode(pdf.Stream({"Filter": pdf.Name(name)}, raw)) == want


@pytest.mark.parametrize("how", range(5))
def test_predictors(how):
    rows = [bytes([10, 20, 30]), bytes([11, 22, 33])]
    paeth = lambda a, b, c: min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
    out, above = b"", bytes(3)
    for r in rows:
        line = []
        for i, v in enumerate(r):
            a, b, c = r[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            line.append((v - (0, a, b, (a + b) // 2, paeth(a, b, c))[how]) & 255)
        out += bytes([how, *line])
        above = r
    assert pdf._predict(out, {"Predictor": 12, "Columns": 3}) == b"".join(rows)


def test_lexer():
    v = pdf.Lexer(b"<< /A#20B [1 -2.5 (a\\(b\\051\\n(c)) <4 1> true null 3 0 R] % c\n /C /D >>").next()
    assert v == {"A B": [1, -2.5, b"a(b)\n(c)", b"A", True, None, pdf.Ref(3, 0)], "C": "D"}


def test_cmaps_and_glyphs():
    m = pdf.parse_cmap(b"1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <03> <0062> <04> <05> [<0078> <00790079>] endbfrange")
    assert m == {b"\x01": "A", b"\x02": "b", b"\x03": "c", b"\x04": "x", b"\x05": "yy"}
    assert [pdf.glyph_text(g) for g in ("a", "eacute", "uni00E9", "fi", "five", "Scaron", "a.alt", "nonsense")] == ["a", "é", "é", "ﬁ", "5", "Š", "a", ""]


def test_operators_of_content():
    doc = pdf.Document(pdf.write([[]]))
    run = pdf.Interpreter(doc)
    page = doc.pages()[0]
    run.run(b"q 1 0 0 1 10 20 cm BT /F1 10 Tf 14 TL 5 5 Td (a) Tj T* [(b) -2000 (c)] TJ (d) ' ET Q 0 0 m 10 0 l S 5 5 20 10 re f 100 0 0 50 1 2 cm BI /W 4 /H 2 ID \x00EI\x01 EI Q", page["Resources"])
    assert [f.text for f in run.fragments] == ["a", "b", "c", "d"] and run.fragments[0].x == 15 and run.fragments[1].y == 11
    assert run.rules[0] == (0, 0, 10, 0) and len(run.rules) == 5
    assert run.images == [("inline", 1, 2, 101, 52, 4, 2)]


def test_arrivals(spark, folder, tmp_path):
    steps = lambda batch: scan.documents(batch, ["path"])
    for _ in range(2):
        arrivals.process(arrivals.files(spark, str(folder)), steps, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 8 and got.where("status = 'ok'").count() == 5


def test_sniff(spark):
    df = spark.createDataFrame([(b"%PDF-1.4",), (b"\x89PNG\r\n",), (b"PK\x03\x04",), (b"",), (None,)], "b binary")
    assert [r.k for r in df.select(scan.sniff(F.col("b")).alias("k")).collect()] == ["pdf", "png", "zip", None, None]


def test_aes_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        keys = aes.round_keys(bytes(range(size)))
        assert aes.encrypt_block(plain, keys).hex() == want and aes.decrypt_block(bytes.fromhex(want), keys) == plain
    iv = bytes(range(16))
    assert aes.decrypt_cbc(bytes(16), iv + aes.encrypt_cbc(bytes(16), b"abc" + b"\x0d" * 13, iv)) == b"abc"


def locked_256(data, user=b"", revision=6):
    """The file under AES-256."""
    key, doc = bytes(range(32)), pdf.Document(data)
    iv, salts = bytes(16), b"saltsaltkeysalt!"
    wrap = lambda pw, more: (pdf._digest_256(pw, salts[:8], more, revision) + salts, aes.encrypt_cbc(pdf._digest_256(pw, salts[8:], more, revision), key, iv))
    u, ue = wrap(user, b"")
    o, oe = wrap(b"owner", u)
    pad = lambda b: iv + aes.encrypt_cbc(key, b + bytes([16 - len(b) % 16]) * (16 - len(b) % 16), iv)
    hexed = lambda b: b"<" + b.hex().encode() + b">"

    def form(v):
        if isinstance(v, pdf.Name):
            return b"/" + str(v).encode()
        if isinstance(v, pdf.Ref):
            return b"%d %d R" % (v.num, v.gen)
        if isinstance(v, bytes):
            return hexed(pad(v))
        if isinstance(v, list):
            return b"[" + b" ".join(map(form, v)) + b"]"
        if isinstance(v, dict):
            return b"<<" + b" ".join(b"/" + a.encode() + b" " + form(b) for a, b in v.items()) + b">>"
        if isinstance(v, pdf.Stream):
            raw = pad(v.raw)
            return form(v.head | {"Length": len(raw)}) + b"\nstream\n" + raw + b"\nendstream"
        return str(v).encode()

    out, offsets = bytearray(b"%PDF-2.0\n"), {}
    for num in sorted(n for n in doc.where if n):
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num + form(doc.get(num)) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % p for p in offsets.items())
    out += b"trailer << /Root 1 0 R /Info 4 0 R /Encrypt << /Filter /Standard /V 5 /R %d /P -4 /Length 256 /O %s /U %s /OE %s /UE %s /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >> >>\nstartxref\n%d\n%%%%EOF" % (revision, hexed(o), hexed(u), hexed(oe), hexed(ue), at)
    return bytes(out)


@pytest.mark.parametrize("revision", [5, 6])
def test_aes_256(revision):
    data = locked_256(sample(), "pässword".encode(), revision)
    assert pdf.Document(data).status == "encrypted"
    for password in ("pässword", "owner"):
        doc = pdf.Document(data, password)
        assert doc.status == "ok" and doc.text(doc.resolve(doc.trailer["Info"])["Title"]) == "T"
        run = pdf.Interpreter(doc)
        run.run(doc.content(doc.pages()[0]), doc.pages()[0]["Resources"])
        assert run.fragments[0].text == "Hello (World) é"


def test_profiles(spark, files):
    plain = files.where("file in ('plain', 'open')")
    archive = {(r.file, r.rule) for r in conformance.archive(plain, ["file"], 1, "A").collect()}
    assert {("plain", "XMP_MISSING"), ("plain", "FONT_NOT_EMBEDDED"), ("plain", "EMBEDDED_FILES"), ("plain", "NOT_TAGGED"), ("plain", "NO_STRUCT_TREE"), ("open", "ENCRYPTED")} <= archive
    assert ("plain", "NO_LANG") not in archive and ("plain", "ENCRYPTED") not in archive
    ua = {r.rule for r in conformance.accessibility(plain.where("file = 'plain'"), ["file"]).collect()}
    assert ua == {"UA_NOT_TAGGED", "UA_NO_STRUCT_TREE", "UA_DISPLAY_DOCTITLE"}
    tree = "/Lang (en) /MarkInfo << /Marked true >> /ViewerPreferences << /DisplayDocTitle true >> /StructTreeRoot << /ParentTree << >> /RoleMap << /Pic /Figure >> /K [<< /S /P >> << /S /Pic >> << /S /Figure /Alt (a cat) >>] >>"
    tagged = spark.createDataFrame([("t", pdf.write([[(10, 10, 9, "x")]], info={"Title": "T"}, catalog=tree))], "file string, content binary")
    assert [r.rule for r in conformance.accessibility(tagged, ["file"]).collect()] == ["UA_FIGURE_NO_ALT"]
    assert {(r.role, r.alt) for r in conformance.figures(tagged, ["file"]).collect()} == {("Pic", None), ("Figure", "a cat")}


def test_signatures(spark):
    body = pdf.write([[(10, 10, 9, "x")]], objects=[b"<< /FT /Sig /T (s) /V 6 0 R >>", b"<< /Type /Sig /Name (N) /ByteRange [0 AAAAAAAAAA BBBBBBBBBB CCCCCCCCCC] /Contents <" + b"0" * 200 + b"> >>"])
    start = body.index(b"<" + b"0" * 200)
    end = start + 202
    body = body.replace(b"AAAAAAAAAA", b"%010d" % start).replace(b"BBBBBBBBBB", b"%010d" % end).replace(b"CCCCCCCCCC", b"%010d" % (len(body) - end))
    digest = hashlib.sha256(body[:start] + body[end:]).digest()
    tlv = lambda tag, b: bytes([tag, len(b)]) + b
    der = tlv(0x30, tlv(6, bytes.fromhex("608648016503040201")) + tlv(0x30, tlv(6, conformance.MESSAGE_DIGEST) + tlv(0x31, tlv(4, digest))))
    signed = body[: start + 1] + der.hex().encode().ljust(200, b"0") + body[end - 1 :]
    rows = spark.createDataFrame([("good", signed), ("changed", signed.replace(b"(x)", b"(y)").replace(b"/Name (N)", b"/Name (M)")), ("longer", signed + b"\n% more")], "file string, content binary")
    got = {r.file: r for r in conformance.signatures(rows, ["file"]).collect()}
    assert got["good"].covers_file and got["good"].digest_matches and got["good"].signer == "N"
    assert not got["changed"].digest_matches and not got["longer"].covers_file and got["longer"].digest_matches


def test_search_boxes(files):
    by = ["file", "page_no"]
    lines = layout.assemble(layout.with_lines(scan.fragments(files.where("file = 'plain'"), ["file"]), by), by)
    r = layout.search(lines, by, "world", ignore_case=True).first()
    assert (r.match, r.match_no, r.line_no) == ("World", 1, 1) and r.llx == pytest.approx(72 + 7 * 6) and r.urx == pytest.approx(72 + 12 * 6) and r.lly == 700


def test_full_page_grid(spark):
    texts = [(1, k, x, 700.0 - 20 * row, x + 30, 10.0, "F", f"{row}-{x:g}") for k, (row, x) in enumerate([(0, 50.0), (0, 200.0), (1, 52.0), (1, 203.0), (1, 400.0)])]
    df = spark.createDataFrame(texts, "page int, seq int, x double, y double, end_x double, size double, font string, text string")
    assert [tuple(r)[1:3] for r in tables.full_page(df, ["page"]).collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


def test_metadata_layers_and_scripts_of_plain_files_are_empty(spark):
    df = spark.createDataFrame([("a", bytearray(sample())), ("b", bytearray(b"no file")), ("c", None)], "file string, content binary")
    for rows in (scan.layers, scan.scripts, scan.xmp):
        assert rows(df, ["file"]).collect() == []


def test_damaged_metadata_has_no_row(spark):
    packet = b"<x><unclosed>"
    data = pdf.write([[(10, 10, 9, "x")]], objects=[b"<< /Length %d >>\nstream\n%s\nendstream" % (len(packet), packet)], catalog="/Metadata 5 0 R")
    assert scan.xmp(spark.createDataFrame([("a", bytearray(data))], "file string, content binary"), ["file"]).collect() == []


def test_reports_count_equal_and_plain_streams(spark):
    objs = scan.objects(spark.createDataFrame([("a", bytearray(sample(compress=False)))], "file string, content binary"), ["file"])
    row = scan.optimise_report(objs, ["file"]).first()
    streams = objs.where("kind = 'stream'").collect()
    assert row["n_objects"] == objs.count() and row["n_streams"] == len(streams)
    assert (row["duplicate_streams"], row["duplicate_bytes"]) == (1, 5)  # "hello" is there twice
    assert row["uncompressed_streams"] == len(streams) and row["uncompressed_bytes"] == sum(s["stream_bytes"] for s in streams)


def test_equal_images_share_a_resource(spark):
    images = spark.createDataFrame([("a", 7, b"x"), ("a", 3, b"y"), ("a", 9, b"y"), ("b", 1, b"x")], "file string, num int, data binary")
    got = {(r["file"], r["num"]): r["resource_no"] for r in scan.resource_names(images, ["file"]).collect()}
    assert got == {("a", 3): 1, ("a", 9): 1, ("a", 7): 2, ("b", 1): 1}
