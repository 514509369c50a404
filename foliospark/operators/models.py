"""Texts prepared for language models: gathering, packing, conversations, and calls of an injected client."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.text import trim

#: Characters of a chunk, and of the context of a conversation, at most.
CHUNK = 24_000
CONTEXT = 48_000


def gather(documents: DataFrame, texts: DataFrame, order: str, text: str) -> DataFrame:
    """Documents' texts first, then raw ones, in order; blank ones are dropped. Adds ``part`` (0 or 1)."""
    both = documents.select(F.lit(0).alias("part"), F.col(order).alias("seq"), F.col(text).alias("text")).unionByName(texts.select(F.lit(1).alias("part"), F.col(order).alias("seq"), F.col(text).alias("text")))
    return both.where(F.length(trim(F.col("text"))) > 0)


def pack(df: DataFrame, by: list[str], order: str, size: str, limit: int = CHUNK) -> DataFrame:
    """Adds ``chunk_no`` from 1: rows are put together in order while their sizes stay within ``limit``; a larger one stands alone.

    A new chunk begins where a row no longer fits, which depends on all rows before it in its group, so a group's
    sizes are read in order by one task, as a stream: keys and sizes alone, a row at a time. Nulls in ``by`` are a group;
    ``order`` is unique in a group.
    """
    rows = df.select(*by, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size_"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "chunk_no int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, chunk = None, 0, 1
        for b in batches:
            out = []
            for *own, n in zip(*(b.column(i).to_pylist() for i in [*range(len(by)), len(by) + 1])):
                if own != group:
                    group, held, chunk = own, 0, 1
                if held and held + n > limit:
                    held, chunk = 0, chunk + 1
                held += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by) + 1], pa.array(out, pa.int32())], names=[*by, order, "chunk_no"])

    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    placed = dealt.sortWithinPartitions(*by, order).mapInArrow(run, schema)
    keys = [*by, order]
    placed = placed.toDF(*(f"{c}_" for c in keys), "chunk_no")
    return df.join(placed, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys]).drop(*(f"{c}_" for c in keys))


def conversation(df: DataFrame, by: list[str], order: str, role: str, text: str, limit: int = CONTEXT) -> DataFrame:
    """Each conversation's turns in order, as one text cut at ``limit`` characters: by, n_turns, history, truncated. A turn with a null text is an empty turn of its role."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit(""))).alias("line")))), lambda t: t["line"])
    out = df.groupBy(*by).agg(F.count("*").alias("n_turns"), F.array_join(turns, "\n").alias("whole"))
    return out.select(*by, "n_turns", F.substring("whole", 1, limit).alias("history"), (F.length("whole") > limit).alias("truncated"))


def with_retry(call: Callable[[str], str], attempts: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep, retry: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)) -> Callable[[str], str]:
    """Calls again after failures that may pass, with doubling pauses."""
    def run(prompt: str) -> str:
        for n in range(attempts):
            try:
                return call(prompt)
            except retry:
                if n + 1 == attempts:
                    raise
                sleep(wait * 2**n)
        raise AssertionError

    return run


class HttpClient:
    """Asks a chat-completions service over HTTP; meant to be made once a task, inside ``complete``."""

    def __init__(self, base_url: str, model: str, key: str = "", system: str = "", timeout: float = 60.0, most_bytes: int = 16 << 20, opener=None):
        if not model:
            raise ValueError("a model's name is required")
        self.url, self.model, self.key, self.system, self.timeout, self.most_bytes = base_url.rstrip("/") + "/chat/completions", model, key, system, timeout, most_bytes
        self.open = opener or urllib.request.urlopen

    def __call__(self, prompt: str) -> str:
        messages = [*([{"role": "system", "content": self.system}] if self.system else []), {"role": "user", "content": prompt}]
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "messages": messages}).encode(), head)
        try:
            with self.open(request, timeout=self.timeout) as answer:
                raw = answer.read(self.most_bytes + 1)
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise ConnectionError(f"HTTP {e.code}") from e
            raise ValueError(f"HTTP {e.code}") from e
        if len(raw) > self.most_bytes:
            raise ValueError("the answer is too long")
        return json.loads(raw)["choices"][0]["message"]["content"]


def recognise(df: DataFrame, image: str, engine: Callable[[], Callable[[bytes], str]], out: str = "text") -> DataFrame:
    """Adds the text that an engine, made once a task, reads from each image; a null image has none."""
    names, k = [*df.columns, out], df.columns.index(image)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = engine()
        for b in batches:
            texts = [see(i) if i else None for i in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, schema)


def complete(df: DataFrame, prompt: Column, client: Callable[[], Callable[[str], str]], out: str = "answer") -> DataFrame:
    """Adds the answer of a client, made once a task, to each prompt; a blank prompt has none."""
    rows = df.withColumn(out, prompt)
    names, k = rows.columns, rows.columns.index(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()
        for b in batches:
            answers = [ask(p).strip() if p and p.strip() else None for p in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(answers, pa.string()), *b.columns[k + 1 :]], names=names)

    return rows.mapInArrow(run, rows.schema)


def summarise(df: DataFrame, by: list[str], order: str, text: str, client: Callable[[], Callable[[str], str]], limit: int = CHUNK) -> DataFrame:
    """A summary of each group: texts are packed into chunks, chunks are summarised, and the summaries once more if there are several."""
    sized = df.where(F.length(trim(F.col(text))) > 0).withColumn("n_", F.length(text))
    chunks = pack(sized, by, order, "n_", limit).groupBy(*by, "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda t: t[text]), "\n\n").alias("chunk"))
    partial = complete(chunks, F.concat(F.lit("Summarise this text.\n\n"), F.col("chunk")), client)
    joined = partial.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "answer"))), lambda t: t["answer"]), "\n\n").alias("partials"))
    asked = complete(joined, F.when(F.col("n_chunks") > 1, F.concat(F.lit("Combine these summaries into one.\n\n"), F.col("partials"))), client)
    return asked.select(*by, "n_chunks", F.coalesce("answer", "partials").alias("summary"))


def needs_ocr(pages: DataFrame, images: DataFrame, by: list[str], text: str, page_area: str, image_area: str) -> DataFrame:
    """Adds ``needs_ocr``: under three bytes of trimmed text, and an image over seven tenths of the page or more."""
    largest = images.groupBy(*by).agg(F.max(image_area).alias("largest_"))
    out = pages.join(largest, by, "left")
    bare = F.octet_length(trim(F.coalesce(F.col(text), F.lit("")))) < 3
    return out.withColumn("needs_ocr", bare & F.coalesce(F.col("largest_") >= 0.7 * F.col(page_area), F.lit(False))).drop("largest_")
