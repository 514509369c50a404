"""Search, replacement and clean-up of text, with built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that is trimmed at the ends of a text: Unicode's, not spaces alone.
SPACE = r"[\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What linear-time engines refuse outside classes: look-around, atomic groups, back-references, and quantifiers of quantifiers.
_REFUSED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k|[*+?}]\+")
#: Parts of a pattern: a quotation, an escape, a class, or a character.
_PART = re.compile(r"\\Q.*?(?:\\E|\Z)|\\[pPx]\{[^}]*\}|\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\[pPx]\{[^}]*\}|\\.|[^\]\\])*\]|.", re.S)
_IN_CLASS = re.compile(r"\[:(\^?)(\w+):\]|\\[pP]\{[^}]*\}|\\.|.", re.S)
#: Named classes and their Java forms. Fixed values.
_NAMED = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
_WORD, _NO_WORD = r"(?<!\w)", r"(?!\w)"
_EDGE = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}
#: Patterns of these parts alone match no line feed and ask for no end of a line, so a text needn't be parted for them.
_INSIDE_LINES = re.compile(r"(?:\\[bBdw]|\\[.*+?|()\[\]{}\\/-]|\[[\w .,;:!#%/-]+\]|\((?:\?:)?|\)|[\w ,;:!\"'#%&=@~<>/|*+?-]|\{\d+(?:,\d*)?\})+\Z")


def _java_class(part: str) -> str:
    """A class with the meaning that it has where classes don't nest."""
    negated = part.startswith("[^")
    body, out = part[2 if negated else 1 : -1], []
    for m in _IN_CLASS.finditer(body):
        x = m[0]
        if m[2]:
            name = r"\w" if m[2] == "word" else r"\p{%s}" % _NAMED.get(m[2], m[2])
            x = (r"\W" if m[2] == "word" else name.replace("\\p", "\\P")) if m[1] else name
        elif x.startswith(("\\p{", "\\P{")):
            x = _script(x)
        elif x in "[&]" or (x == "^" and not out):
            x = "\\" + x
        out.append(r"\x0B" if x == r"\v" else x)
    return ("[^" if negated else "[") + "".join(out) + "]"


def _script(part: str) -> str:
    """``\\p{Greek}`` as Java names it."""
    name = part[3:-1].lstrip("^")
    turned = part[3:4] == "^"
    letter = {"p": "P", "P": "p"}[part[1]] if turned else part[1]
    return rf"\{letter}{{{'Is' if len(name) > 2 else ''}{name}}}"


def _sure_word(part: str, then: str) -> bool:
    """Whether a part, followed by another, surely begins with a word character."""
    return (re.fullmatch(r"(?a)\w|\\[wd]", part) is not None) and then not in ("*", "?", "{", "")


def compile_pattern(query: str, regex: bool = False, ignore_case: bool = False) -> str:
    """The pattern of a query, as Java reads it; a literal is quoted. An empty query is an error, as is a pattern with look-around or back-references.

    Classes don't nest, and know names such as ``[:alpha:]``; word boundaries are those of ASCII words, as classes are (Java's differ by
    version): beside a word character one look suffices, elsewhere two are tried.
    """
    if not query:
        raise ValueError("the query is empty")
    if not regex:
        return ("(?diu)" if ignore_case else "") + "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = _PART.findall(query)
    if _REFUSED.search("".join("x" if len(p) > 1 and p[0] in "[\\" and not re.fullmatch(r"\\[1-9k]", p) else p for p in parts)):
        raise ValueError("look-around, back-references and possessive quantifiers aren't supported")
    out = []
    for k, p in enumerate(parts):
        before, after = parts[k - 1] if k else "", parts[k + 1] if k + 1 < len(parts) else ""
        if p in _EDGE:
            ends = before in ("+",) and k > 1 and re.fullmatch(r"(?a)\w|\\[wd]", parts[k - 2]) or re.fullmatch(r"(?a)\w|\\[wd]", before)
            if p == r"\b" and _sure_word(after, parts[k + 2] if k + 2 < len(parts) else "end"):
                p = _WORD
            else:
                p = _NO_WORD if p == r"\b" and ends else _EDGE[p]
        elif p.startswith("[") and len(p) > 1:
            p = _java_class(p)
        elif p.startswith(("\\p{", "\\P{")):
            p = _script(p)
        out.append(r"\x0B" if p == r"\v" else p)
    body = re.sub(r"\(\?P<\w+>", "(", "".join(out))
    return ("(?diu)" if ignore_case else "(?d)") + body  # lines end at line feeds alone


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line: id, ``line_no`` from 1, ``line``. Nulls have none."""
    return df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def search(df: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Non-overlapping matches within lines: id, ``line_no``, ``match_no`` (both from 1), ``match``. Empty matches are dropped.

    Rows without any match are filtered before lines are made, unless the pattern asks for a line's start or end: in
    the whole text these are elsewhere.
    """
    pattern = compile_pattern(query, regex, ignore_case)
    anchored = regex and re.search(r"(?<!\[)\^|\$|\\[AzZG]", query)
    likely = df if anchored else df.where(F.col(text_col).rlike(pattern)) if regex or ignore_case else df.where(F.col(text_col).contains(query))
    found = F.filter(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda m: F.length(m) > 0)
    hits = lines(likely, id_col, text_col).select(id_col, "line_no", F.posexplode(found).alias("match_no", "match"))
    return hits.withColumn("match_no", F.col("match_no") + 1)


def replace(df: DataFrame, query: str, by: str, text_col: str = "text", regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """``df`` with the replaced text and ``n_replaced``, line by line (no match spans lines); the replacement is literal."""
    pattern = compile_pattern(query, regex, ignore_case)
    quoted = by.replace("\\", "\\\\").replace("$", "\\$")
    if _INSIDE_LINES.match(query) if regex else "\n" not in query:
        count, text = F.regexp_count(text_col, F.lit(pattern)), F.regexp_replace(text_col, pattern, quoted)
    else:
        parts = F.split(F.col(text_col), "\n", -1)
        count = F.aggregate(parts, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(pattern)))
        text = F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, pattern, quoted)), "\n")
    return df.withColumns({"n_replaced": F.coalesce(count, F.lit(0)), text_col: text})


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def clean(text: Column) -> Column:
    """Spaces and tabs before a line's end go, at most two blank lines stay in a row, and the whole is trimmed."""
    stripped = F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")
    return trim(F.regexp_replace(stripped, r"\n{4,}", "\n\n\n"))


def collapse(text: Column) -> Column:
    """White space becomes single spaces, trimmed."""
    return trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks between blank lines: id, ``par_no`` from 1, ``n_lines``, ``paragraph``."""
    blocks = F.filter(F.split(F.regexp_replace(F.col(text_col), r"\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\z", ""), r"\n(?:[ \t]*\n)+", -1), lambda b: F.length(F.translate(b, " \t", "")) > 0)
    out = df.select(id_col, F.posexplode(blocks).alias("par_no", "paragraph"))
    return out.select(id_col, (F.col("par_no") + 1).alias("par_no"), F.size(F.split("paragraph", "\n", -1)).alias("n_lines"), "paragraph")


def font_family(name: Column) -> Column:
    """A font name without its slash and six-letter subset prefix."""
    return F.regexp_replace(name, r"\A/?(?:[A-Z]{6}\+(?=.))?", "")


def keywords(text: Column) -> Column:
    """Parts between commas or semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[,;]"), trim), lambda k: F.length(k) > 0)


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def document_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` with missing parts at their least, as ISO 8601 with its zone; null if it isn't such a date."""
    part = lambda n: F.regexp_extract(text, r"\A(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:Z|([+-])(\d\d)'?(\d\d)?'?)?", n)
    field = lambda n, least: F.when(part(n) == "", least).otherwise(part(n))
    zone = F.when(part(7) == "", F.when(text.contains("Z"), "Z").otherwise("")).otherwise(F.concat(part(7), part(8), F.lit(":"), field(9, "00")))
    made = F.concat(part(1), F.lit("-"), field(2, "01"), F.lit("-"), field(3, "01"), F.lit("T"), field(4, "00"), F.lit(":"), field(5, "00"), F.lit(":"), field(6, "00"), zone)
    return F.when(part(1) != "", made)


#: Currency signs that may stand at either end of a number. Fixed values.
CURRENCY = "$€£¥₽"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(text: Column) -> Column:
    """The value of a cell's text, whatever its locale; null for what isn't plainly a number.

    One currency sign at either end or a percent sign, a sign, digits grouped in threes by points, commas or spaces;
    the last separator before one or two digits is the decimal one, before three it groups. At most 24 bytes and
    15 digits before the decimal separator.
    """
    return _let(trim(text), _number)


def _number(s: Column) -> Column:
    leading, trailing = F.substring(s, 1, 1), F.substring(s, -1, 1)
    has = lambda c: F.lit(CURRENCY).contains(c)
    percent = ~has(leading) & ~has(trailing) & (trailing == "%")
    body = F.when(has(leading), F.substr(s, F.lit(2))).when(has(trailing) | percent, F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s)

    def parted(body: Column) -> Column:
        signed = F.substring(body, 1, 1).isin("-", "−", "+")
        bare = F.translate(F.when(signed, F.substr(body, F.lit(2))).otherwise(body), " \u00a0\u2009\u202f", "")
        return F.struct(F.substring(body, 1, 1).isin("-", "−").alias("negative"), bare.alias("bare"), F.regexp_extract(bare, r"[.,](\d{1,2})\z", 1).alias("fraction"))

    def whole(p: Column) -> Column:
        part = F.when(p["fraction"] != "", F.substr(p["bare"], F.lit(1), F.length(p["bare"]) - F.length(p["fraction"]) - 1)).otherwise(p["bare"])
        return F.struct(p["negative"].alias("negative"), p["bare"].alias("bare"), p["fraction"].alias("fraction"), part.alias("whole"), F.translate(part, ".,", "").alias("digits"))

    def value(p: Column) -> Column:
        grouped = p["whole"].rlike(r"\A[.,]*(?:\d{1,3}(?:[.,]+\d{3})+|\d+)[.,]*\z") & ((p["fraction"] != "") | p["bare"].rlike(r"\A[^.,]*\z|[.,]\d{3}\z"))
        found = F.try_to_number(p["digits"], F.lit("999999999999999")).cast("double") + F.when(p["fraction"] == "", 0.0).otherwise(p["fraction"].try_cast("double") / F.pow(F.lit(10.0), F.length(p["fraction"])))
        found = F.when(p["negative"], -found).otherwise(found)
        return F.when(grouped & (F.length(p["digits"]) <= 15), F.when(percent, found / 100).otherwise(found))

    made = _let(trim(body), lambda b: _let(parted(b), lambda p: _let(whole(p), value)))
    return F.when((F.octet_length(s) <= 24) & (F.length(s) > 0), made)


def heading_level(size: Column, body: Column, text: Column) -> Column:
    """1 to 3 by the size over the body's, 0 for plain text or 200 characters and more."""
    r = size / body
    return F.when(F.length(text) >= 200, 0).when(r >= 1.7, 1).when(r >= 1.35, 2).when(r >= 1.14, 3).otherwise(0)


def list_marker(line: Column) -> Column:
    """``ordered``, ``bullet`` or null by the line's start."""
    return F.when(line.rlike(r"\A\s*\d{1,3}[.)]\s+"), "ordered").when(line.rlike(r"\A\s*[•‣◦▪·\-*–]\s+"), "bullet")


def roman(n: Column) -> Column:
    """Lower-case Roman numerals; empty below 1."""
    digit = lambda by, signs: F.element_at(F.array(*map(F.lit, signs.split(","))), (F.floor(n / by) % 10 + 1).cast("int"))
    made = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(100, ",c,cc,ccc,cd,d,dc,dcc,dccc,cm"), digit(10, ",x,xx,xxx,xl,l,lx,lxx,lxxx,xc"), digit(1, ",i,ii,iii,iv,v,vi,vii,viii,ix"))
    return F.when(n > 0, made).otherwise("")


def alphabetic(n: Column) -> Column:
    """a to z, aa, ab and so on; empty below 1. Letters are taken from behind, for as many as the number has."""
    more = lambda s: F.struct(F.floor((s["n"] - 1).cast("decimal(20,0)") / 26).cast("bigint").alias("n"), F.concat(F.char((97 + (s["n"] - 1) % 26).cast("int")), s["t"]).alias("t"))
    start = F.struct(F.greatest(n.cast("bigint"), F.lit(0)).alias("n"), F.lit("").alias("t"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, lambda s, _: F.when(s["n"] > 0, more(s)).otherwise(s), lambda s: s["t"])
