"""Fill-in-middle: texts cut at token offsets and put into another order, and back."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from foliospark.llm.common import aside, small_batches

#: A token: a word with the white space before it, or white space that no word follows. Fixed values.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: In percent: documents that are rearranged, and of those the ones that begin with the suffix.
RATE, SPM = 50, 80
SEED = 42

#: Code points that are handed to the pre-tokenizer at once; a piece ends where a word does, so that no token is cut.
PIECE = 1 << 18
_WORD_ENDS = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def splitter():
    """The pre-tokenizer whose isolated matches are the tokens; it knows no vocabulary and needs no training."""
    return pre_tokenizers.Split(Regex(TOKEN), "isolated")


def offsets(text: str, split, piece: int = PIECE) -> array:
    """Where the tokens of a text end, in code points; their number is the array's length.

    Long texts are tokenized piece by piece, so that what is held at once is a piece's tokens and the offsets.
    """
    ends, at = array("q"), 0
    while at < len(text):
        if len(text) - at <= piece:
            end = len(text)
        else:
            found = _WORD_ENDS.search(text, at + piece - 1)
            end = found.end() if found else len(text)
        ends.extend(at + stop for _, (_, stop) in split.pre_tokenize_str(text[at:end]))
        at = end
    return ends


def draws(seed: int, id_col: str) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:id`` as numbers; of a null id, of ``seed:``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, piece: int = PIECE) -> DataFrame:
    """``docs`` with a struct ``fim``: ``n`` tokens, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``, ``output``.

    The pre-tokenizer gives the tokens' offsets; two draws from the hashed id rank them, and the text is sliced there.
    Whole texts are cut where they lie, so there is no shuffle, and long ones are tokenized piece by piece. A null text is an empty one: plain, with an empty output.
    Texts that contain a mark stay plain. A null id draws from the seed alone. Rows with one id and text come out alike;
    an empty table gives an empty one; other columns pass through, but ``fim`` is replaced. Marks must be such that none ends
    as another, or itself, begins, or an output couldn't be taken apart.
    """
    if any(x.endswith(y[:k]) for i, x in enumerate(marks) for j, y in enumerate(marks) for k in range(1, len(y) + (i != j))):
        raise ValueError("no mark may end as a mark begins")
    small_batches(docs.sparkSession)
    kept, own = aside(docs.drop("fim"), "draws_")
    kept = kept.withColumn("draws_", F.array(*draws(seed, f"`{id_col}`")))
    names = kept.columns
    k, d = names.index(text_col), names.index("draws_")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for b in batches:
            rows = []
            for at in range(len(b)):
                text = b.column(k)[at].as_py() or ""
                h1, h2, h3, h4 = b.column(d)[at].as_py()
                ends = offsets(text, split, piece)
                n = len(ends)
                if not text or h3 % 100 >= rate or any(x in text for x in marks):
                    rows.append({"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text})
                    continue
                first, last = (ends[x - 1] if x else 0 for x in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = text[:first], text[first:last], text[last:]
                form = "spm" if h4 % 100 < spm else "psm"
                output = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
                rows.append({"n": n, "form": form, "prefix_chars": first, "middle_chars": last - first, "output": output})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*names, "fim"])

    out = kept.mapInArrow(run, f"{kinds}, fim struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")
    return out.select(*own, "fim")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output and its form were made of. Null if either is."""
    p, s, m = marks

    def parts(first: str, second: str) -> Column:
        """What stands after the first mark, the second, and the middle's; no slice contains a mark."""
        return F.split(F.substring(output, len(first) + 1, 2**31 - 1), rf"\Q{second}\E|\Q{m}\E", 3)

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0]))


def op12(docs: DataFrame) -> DataFrame:
    """Tokens, form, slices and the digests of the output and of the text rebuilt from it, of every document."""
    out = rearrange(docs.select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest(F.col("fim.output")).alias("output_sha256"), digest(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
s AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""
