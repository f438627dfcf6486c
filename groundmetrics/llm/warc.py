"""WARC archives: writing, normalising whole-file gzip streams into one member per record, and indexed reading.

Spark's text writer puts a column's bytes and a separator into a file as they are. Archives therefore need no file system but
Spark's: records end with a newline, which the writer adds; a gzip member ends with the high byte of its length, which is zero
below 16 MiB (longer records get an empty member appended), so that the writer's separator is the member's last byte.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmetrics.llm.common import map_batches, shared_folder, written

LEAST_SHARED, RECORDS_PER_FILE = 1000, 1000


def plan_records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): revisits refer to the largest page_id with the same long payload.

    Null html is an empty payload. Null ids are never referred to; repeated ids with one payload are one page more than once:
    every row of the largest id is a response. Only digests that occur more than once are joined.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    dup = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("to")).filter("n > 1").select("digest", "to")
    dup = written(dup)
    long = (F.octet_length("payload") >= least)
    joined = rows.join(dup.withColumn("_long", F.lit(True)), (rows["digest"] == dup["digest"]) & long, "left").drop(dup["digest"])
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("to")), F.col("to")).alias("refers_to"))


def record_text() -> Column:
    """A record as text without its last newline. Fields of our own carry ids and the length of a revisit's payload."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    one_line = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), field("WARC-Target-URI", one_line),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), field("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        field("X-Payload-Length", F.octet_length("payload").cast("string")), F.when(revisit, field("X-Refers-To", F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.octet_length("payload").cast("string"))), F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")), F.lit("\r\n\r"))


def write_monolithic(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives as one gzip stream each, of at most ``records_per_file`` records."""
    records.select(record_text().alias("value")).write.option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


class _Chunks(io.RawIOBase):
    """The inflated content of gzip bytes, any number of members, without holding all of it."""

    def __init__(self, data: bytes):
        self.file = gzip.GzipFile(fileobj=io.BytesIO(data))

    def readable(self):
        return True

    def readinto(self, b):
        got = self.file.read(len(b))
        b[: len(got)] = got
        return len(got)


def records_of(stream):
    """(header lines, header bytes, payload) of each record of an inflated archive."""
    reader = io.BufferedReader(stream, 1 << 16)
    while line := reader.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one must start")
        raw, fields = [line], {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            raw.append(line)
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        size = int(fields.get("content-length", 0))
        payload = reader.read(size)
        if len(payload) != size:
            raise ValueError("truncated record")
        yield fields, b"".join(raw) + b"\r\n", payload


def member(data: bytes, level: int = 1) -> bytes:
    """``data`` as gzip whose last byte is zero."""
    out = gzip.compress(data, level, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", level, mtime=0)


INDEX = "record_no long, offset long, length long, page_id string, record_type string"


def normalise(spark: SparkSession, source: str, target: str, glob: str = "*.gz") -> DataFrame:
    """Rewrites the archives in ``source``: each record its own member, below ``target``/kind=warc/archive=<name>, with a sidecar
    index of JSON entries below ``target``/kind=index/archive=<name>.

    Each file is inflated once, as a stream, by the task that read it; members and index entries leave in one write without a
    shuffle (a file is never split, so an archive's members keep their order within the task). Returns the index: archive,
    record_no, offset, length, page_id, record_type. An archive without records leaves no file. Files must fit a task
    (they are read whole, compressed).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(source).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("archive").to_pylist(), b.column("content"), strict=True):
                rows, at, n, held = [], 0, 0, 0

                def batch(rows, name=name):
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.binary()], strict=True))],
                                                      ["archive", "kind", "record_no", "value"])

                for fields, head, payload in records_of(_Chunks(content.as_py())):
                    m = member(head + payload + b"\r\n\r\n")
                    entry = {"record_no": n, "offset": at, "length": len(m), "page_id": fields.get("x-page-id"), "record_type": fields.get("warc-type")}
                    rows += [("warc", n, m[:-1]), ("index", n, json.dumps(entry).encode())]
                    at, n, held = at + len(m), n + 1, held + len(m)
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    lines = map_batches(files, run, "archive string, kind string, record_no long, value binary").withColumn("value", F.col("value").cast("string"))
    lines.sortWithinPartitions("kind", "archive", "record_no").select("kind", "archive", "value").write.partitionBy("kind", "archive").option("lineSep", "\0").text(target)
    return read_index(spark, target)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar entries of all archives below ``target``; none if there are no archives."""
    lines = spark.read.option("lineSep", "\0").text(target)
    if "kind" not in lines.columns:
        return spark.createDataFrame([], f"archive string, {INDEX}").withColumn("page_id", F.col("page_id").cast("long"))
    lines = lines.filter("kind = 'index'").select(F.col("archive").cast("string"), F.from_json("value", INDEX).alias("x"))
    return lines.select("archive", "x.*").withColumn("page_id", F.expr("try_cast(page_id as long)"))


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _archives(spark: SparkSession, target: str) -> DataFrame:
    """(archive, content); the index files are left out by their folder."""
    if "kind" not in spark.read.text(target).columns:
        return spark.createDataFrame([], "archive string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{target}/kind=warc")
    return files.select(F.regexp_extract("path", "/archive=([^/]+)/", 1).alias("archive"), "content")


def _record(part: bytes, offset: int, length: int, archive: str) -> tuple:
    fields, _, payload = next(records_of(io.BytesIO(part)))
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload differs from its digest")
    page, to = fields.get("x-page-id"), fields.get("x-refers-to")
    return (int(page) if page else None, int(fields["x-payload-length"]) if revisit else len(payload), digest, fields["warc-type"], int(to) if to else None, archive, offset, length)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """Reads whole normalised archives, member after member, and holds each record against its index entry: a row per record.

    Columns: page_id, payload_bytes, payload_digest (of the payload itself for responses, from the header for revisits),
    record_type, refers_to, archive, offset, length. Payloads stay in the task that reads the archive; only these rows meet
    the index. A record that the index lacks, or an entry without its record, is an error.
    """

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("archive").to_pylist(), b.column("content"), strict=True):
                data, at, rows = memoryview(content.as_buffer()), 0, []
                while at < len(data):
                    start, part = at, b""
                    while at == start or data[at - 1]:  # a record's last byte is zero, if need be that of an empty member
                        d = zlib.decompressobj(31)
                        while not d.eof:
                            if at >= len(data):
                                raise ValueError("truncated member")
                            piece = data[at : at + (1 << 16)]
                            part += d.decompress(piece)
                            at += len(piece) - len(d.unused_data)
                    rows.append(_record(part, start, at - start, name))
                yield _record_batch(rows)

    found = map_batches(_archives(spark, target), run, RECORD)
    index = read_index(spark, target).select("archive", "offset", "length", F.lit(True).alias("_listed"))
    both = found.withColumn("_read", F.lit(True)).join(index, ["archive", "offset", "length"], "full")
    agreed = F.when(F.col("_listed") & F.col("_read"), F.col("page_id")).otherwise(F.raise_error(F.lit("archive and index differ")).cast("long"))
    return both.withColumn("page_id", agreed).select([x.split()[0] for x in RECORD.split(", ")])


def read_records(spark: SparkSession, target: str, page_ids: DataFrame) -> DataFrame:
    """The records of the wanted pages (column page_id) at the offsets of the index; other members are not inflated."""
    at = read_index(spark, target).join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    where = at.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("at"))  # at most the records of one file
    files = _archives(spark, target).join(where, "archive")

    def run(batches):
        for b in batches:
            for name, content, at in zip(b.column("archive").to_pylist(), b.column("content"), b.column("at").to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                yield _record_batch([_record(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]), x["offset"], x["length"], name) for x in at])

    return map_batches(files, run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to monolithic archives, normalised, and read back. An empty table gives no rows."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_monolithic(plan_records(pages), f"{folder}/raw")
    normalise(spark, f"{folder}/raw", f"{folder}/normal")
    return read_archives(spark, f"{folder}/normal")
