"""A deterministic, sharded WARC writer, and a reader of its archives."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Places, materialize, scratch_path, small_batches, units, weighted_ranges

#: Compressed bytes from which a file is full.
FILE_BYTES = 16 << 20
#: Rows of one range of ids; those of over 6 kB count as several, so this is about 64 MB at most.
RANGE_ROWS = 10_922
MOST_RANGES = 65_536
#: Records carry a fixed time, so that archives are the same in every run.
DATE = "2000-01-01T00:00:00Z"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with one record. A revisit keeps headers and digests but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c if " " < c != "\x7f" else "%%%02X" % ord(c) if ord(c) < 256 else c for c in url or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Bytes": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page": str(refers_to)}
    head["Content-Length"] = str(len(block))
    text = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in head.items())]) + "\r\n\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + made.flush()


def read_records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip-member-a-record stream; holds one record at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("the archive ends inside a record")
            out.append(member.decompress(rest))
            rest = member.unused_data
        data = b"".join(out)
        head, _, body = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if version != VERSION:
            raise ValueError(f"not a record: {version[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        block = body[: int(headers["Content-Length"])]
        if f"sha1:{sha1_base32(block)}" != headers["WARC-Block-Digest"] or body[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        yield headers, block


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def _whole(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: that of Hadoop's default file system, if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


class _Roller:
    """Writes the records of one range to files of about ``FILE_BYTES``, each under a temporary name until it is whole."""

    def __init__(self, folder: str, part: int, attempt: str, file_bytes: int):
        self.fs, self.folder = _file_system(folder)
        self.part, self.attempt, self.file_bytes = part, attempt, file_bytes
        self.nth, self.sink, self.made = 0, None, []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.sink is None:
            self.name = f"part-{self.part:06d}-{self.nth:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{self.name}-{self.attempt}"
            self.sink, self.size, self.rows, self.first, self.sum = self.fs.open_output_stream(self.temporary), 0, 0, page_id, hashlib.sha256()
        self.sink.write(data)
        self.sum.update(data)
        self.size, self.rows, self.last = self.size + len(data), self.rows + 1, page_id
        if self.size >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")  # a later attempt writes the same bytes to the same name
            self.made.append((self.name, self.size, self.rows, self.first, self.last, self.sum.hexdigest()))
            self.sink, self.nth = None, self.nth + 1


#: Parts that rows of one payload and no id may be dealt to.
SALTS = 16
MANIFEST = "file string, bytes bigint, records bigint, first_id bigint, last_id bigint, sha256 string"


def decisions(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """``id_``, ``digest_`` (hex) and ``refers_to_`` of every row: of equal payloads of ``least`` bytes or more, the least
    id is the response and others refer to it, those without an id too; where none has an id, all are responses. Payloads are hashed where they lie; digests alone are shuffled."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id_"), F.sha1(payload).alias("digest_"), (F.octet_length(payload) >= least).alias("whole_"))
    rows = materialize(rows, "digests")
    first = rows.where("whole_").groupBy("digest_").agg(F.min("id_").alias("first_"))
    found = rows.join(first, "digest_", "left")
    return found.select("id_", "digest_", F.when(F.col("whole_") & (F.col("id_").isNull() | (F.col("id_") != F.col("first_"))), F.col("first_")).alias("refers_to_"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, file_bytes: int = FILE_BYTES, rows: int = RANGE_ROWS) -> DataFrame:
    """Writes a record for each row of ``pages`` to ``folder`` and returns the manifest.

    Records are ordered by id in ranges cut by ids and bytes, null last, so files have the same names and bytes in
    every run and with any partitions. An id that outweighs two ranges is dealt to several by its payloads' digests; rows without an id by
    their urls too, in ``SALTS`` parts a payload, each of which gets its decision. Payloads are shuffled once, next to their decision; each is at most one row in memory. Files
    are written under temporary names and renamed when whole; a repeated attempt replaces a file by an equal one.
    The manifest, written last, commits: a folder without it is no archive.

    A null html is an empty payload; a null url has an empty target. Rows repeated under one id are all written:
    those of the least id and equal payloads are all responses; only equal payloads under one id, or under none with urls of one hash, share a task. Ids are numbers. An empty table makes an empty manifest. Other columns
    are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    keyed = pages.select(F.col(id_col).cast("bigint").alias("id_"), F.col(url_col).alias("url_"), F.coalesce(F.col(html_col), F.lit("")).alias("html_"))
    folder = _whole(spark, folder)
    most, total = keyed.select(F.max("id_"), F.sum(units(F.col("html_")))).first()
    key = F.coalesce("id_", F.lit((most or 0) + 1))
    places = Places(spark, weighted_ranges(keyed.withColumn("key_", key), "key_", units(F.col("html_")), max(rows, (total or 0) // MOST_RANGES)))
    digest = F.when(F.col("kind_") == 0, F.col("url_")).otherwise(F.sha1(F.col("html_").cast("binary")))
    part = F.when(F.col("p_.parts") == 1, 0).otherwise(F.pmod(F.xxhash64(digest, "salt_"), F.col("p_.parts")))
    salt = F.when(F.col("id_").isNull(), F.pmod(F.xxhash64("url_"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("id_").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    chosen = decisions(pages, id_col, html_col, least).where("refers_to_ is not null").distinct()
    none = F.lit(None)
    sorted_rows = (
        keyed.select(key.alias("key_"), F.lit(1).alias("kind_"), "id_", "url_", "html_", none.cast("bigint").alias("refers_to_"), salt.alias("salt_"))
        .unionByName(chosen.select(key.alias("key_"), F.lit(0).alias("kind_"), "id_", F.col("digest_").alias("url_"), none.cast("string").alias("html_"), "refers_to_", F.explode(salts).alias("salt_")))
        .withColumn("p_", places.of(F.col("key_")))
        .withColumn("range_", (F.col("p_.base") + part).cast("int"))
        .drop("p_", "salt_")
        .repartitionById(places.total, "range_")
        .sortWithinPartitions("range_", "key_", "kind_", "url_", "html_")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, made = None, []
        refers, owner = {}, None  # of the id whose records come next: what its payloads of a digest refer to
        attempt = str(TaskContext.get().taskAttemptId()) if TaskContext.get() else "0"
        for b in batches:
            for part, kind, doc, url, html, other in zip(*(b.column(c).to_pylist() for c in ("range_", "kind_", "id_", "url_", "html_", "refers_to_"))):
                if roller is None or roller.part != part:
                    if roller:
                        roller.close()
                        made += roller.made
                    roller = _Roller(folder, part, attempt, file_bytes)
                if not kind:
                    refers, owner = refers if owner == doc else {}, doc
                    refers[url] = other
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                target = refers.get(hashlib.sha1(payload).hexdigest()) if refers and owner == doc else None
                roller.add(doc, record(doc, url, payload, sha1_base32(payload), target))
        if roller:
            roller.close()
            made += roller.made
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "bytes", "records", "first_id", "last_id", "sha256"), m)) for m in made], schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())]))

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    sorted_rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    for left in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary-*")) or []:  # of attempts that were lost
        fs.delete(left.getPath(), False)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists. Each file's bytes and each record's digests are checked.

    ``payload`` is null for revisits, or for all if ``payloads`` is false.
    """
    small_batches(spark)
    folder = _whole(spark, folder)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for name, size, count in zip(*(b.column(c).to_pylist() for c in ("file", "bytes", "records"))):
                fs, top = _file_system(folder)
                held, weight, seen = [], 0, 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for head, block in read_records(stream):
                        payload = block.partition(b"\r\n\r\n")[2]
                        whole = head["WARC-Type"] == "response"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if whole and (sha1_base32(payload) != digest or len(payload) != int(head["X-Payload-Bytes"])):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                        number = lambda key: int(head[key]) if head.get(key) else None
                        held.append((number("X-Page-Id"), head["WARC-Target-URI"], int(head["X-Payload-Bytes"]), digest, head["WARC-Type"], number("X-Refers-To-Page"), payload if whole and payloads else None))
                        weight, seen = weight + (len(payload) if payloads else 200), seen + 1
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                            held, weight = [], 0
                if seen != count:
                    raise ValueError(f"{name} has {seen} records; the manifest says {count}")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(parts, "file").mapInArrow(run, READ)


def op9(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns what their records say."""
    folder = scratch_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder, payloads=False).drop("payload", "url")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT page_id, n, first, list_transform(range(0, 32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || digest[1 + 10 * (i // 8):10 + 10 * (i // 8)] AS BIGINT) >> (35 - 5 * (i % 8))) & 31)]) AS chars FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(chars, '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b
"""
