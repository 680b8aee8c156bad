"""WARC archives as a PySpark Python data source.

Reading: files are planned into partitions of about `partitionBytes`, and at least `minPartitions` if there are files enough; equality and IN predicates on record_type,
record_id, target_uri, payload_digest and refers_to are pushed to the reader, which parses each record's header block
first and steps over the body of records that fail them by their Content-Length.  Bodies are decoded only for records
that pass, and not at all with option payload=false.  Plain .warc files and .warc.gz (one gzip member a record) are
read; files are streamed, so memory is bounded by one record.

Writing: one file a task, rolled at `fileBytes`; bodies are HTTP responses whose entity is gzip-coded, so that a
reader can step over them without inflating.  The driver's commit lists the files of successful attempts in a
manifest.  Of a folder that holds manifests a reader reads only the files they list, and all of those, so files of lost
attempts are never seen; folders without one, above or below, are read whole.

Defined cases: a null payload is an empty one; a null id gets a record id of its own and is never revisited; rows that
repeat an id and payload are all responses; revisit records carry length and digest of the full payload but no body.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from quillstone.llm.common import scratch, table

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
ARROW = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()),
    ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])
#: Header lines that predicates and columns read.
NAMED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
BATCH_BYTES = 4_000_000


def place(path: str):
    """(file system, path without a slash at its end) of a URI or a local path."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, path.rstrip("/") or path[:1]


def bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" else value


def columns_of(head: dict[str, str]) -> dict:
    """The columns of NAMED as they are returned and as predicates see them: without <> and a digest's algorithm."""
    row = {c: bare(head.get(n)) for c, n in NAMED.items()}
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    return row


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Written(WriterCommitMessage):
    def __init__(self, files: list[str], records: int):
        self.files, self.records = files, records


class Members(io.RawIOBase):
    """The records of a .warc.gz as one stream."""

    def __init__(self, raw):
        self.raw, self.z, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            data = self.rest or self.raw.read(1 << 16)
            if not data:
                return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, len(out))
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                out[: len(got)] = got
                return len(got)


def header_block(stream) -> dict[str, str] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip()] = value.strip()
    return found


def entity(body: bytes, kind: str) -> bytes:
    """The payload of a record's body: of an HTTP message what follows its head, with gzip coding undone."""
    if not kind.startswith("application/http"):
        return body
    head, _, rest = body.partition(b"\r\n\r\n")
    return gzip.decompress(rest) if b"content-encoding: gzip" in head.lower() else rest


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 128_000_000)))
        self.parts = int(options.get("minpartitions", options.get("minPartitions", 1)))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in NAMED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                values -= {None}  # null equals nothing
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        system, root = place(self.path)
        top = system.get_file_info(root)
        if top.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = {x.path: x.size for x in system.get_file_info(FileSelector(root, recursive=True)) if x.type == FileType.File} if top.type == FileType.Directory else {root: top.size}
        folder = lambda p: p.rpartition("/")[0]
        named: dict[str, set[str]] = {}
        for p in found:
            if p.endswith(".manifest.json"):
                with system.open_input_stream(p) as file:
                    named.setdefault(folder(p), set()).update(f"{folder(p)}/{x}" for x in json.loads(file.read())["files"])
        missing = sorted(set().union(*named.values()) - set(found))
        if missing:
            raise FileNotFoundError(f"{len(missing)} files that manifests list, the first: {missing[0]}")
        found = {p: n for p, n in found.items() if p.endswith((".warc", ".warc.gz")) and p in named.get(folder(p), {p})}
        plan, room, most = [], 0, min(self.most, sum(found.values()) // self.parts + 1)
        for p, n in sorted(found.items()):
            if not plan or room < n:
                plan.append([])
                room = most
            plan[-1].append(p)
            room -= n
        return [Files(x) for x in plan or [[]]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as raw:
                stream = io.BufferedReader(Members(raw) if path.endswith(".gz") else raw, 1 << 20)
                for row in self.records(stream):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def records(self, stream) -> Iterator[dict]:
        while (head := header_block(stream)) is not None:
            length = int(head.get("Content-Length", 0))
            row = columns_of(head)
            if any(row[c] not in values for c, values in self.wanted.items()):
                step(stream, length)
                continue
            if self.payload and row["record_type"] != "revisit":
                row["payload"] = entity(stream.read(length), head.get("Content-Type", ""))
            else:
                step(stream, length)
                row["payload"] = None
            stated = head.get("X-Payload-Length")
            row["payload_length"] = int(stated) if stated else len(row["payload"]) if row["payload"] is not None else None
            row["headers"] = list(head.items())
            yield row


def step(stream, length: int) -> None:
    while length > 0 and (got := len(stream.read(min(length, 1 << 20)))):
        length -= got


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_type, record_id, target_uri, payload_digest, payload_length, refers_to, payload."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("filebytes", options.get("fileBytes", 1_000_000_000)))
        self.level = int(options.get("level", 4))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        files, out, size, count = [], None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size > self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc")
                    out, size = system.open_output_stream(f"{root}/{files[-1]}", buffer_size=1 << 20), 0
                data = self.record(row)
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            out.close()
        return Written(files, count)

    def record(self, row: dict) -> bytes:
        revisit = row["record_type"] == "revisit"
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        body += b"\r\n" if revisit else b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(row["payload"] or b"", self.level, mtime=0)
        clean = lambda x: "".join(c if c >= " " else " " for c in x)
        lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", "WARC-Date: 1970-01-01T00:00:00Z"]
        lines += [f"WARC-Target-URI: {clean(row['target_uri'])}"] if row["target_uri"] else []
        lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_length']}"]
        if revisit:
            lines += [f"WARC-Refers-To: <{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
        return "\r\n".join(lines).encode() + body + b"\r\n\r\n"

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{root}/{uuid.uuid4().hex}.manifest.json") as out:
            out.write(json.dumps({"files": [f for m in done for f in m.files], "records": sum(m.records for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{root}/{f}")


class Warc(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def records_of(pages: DataFrame, least: int = 1000, salts: int = 16) -> DataFrame:
    """One record a page; of equal payloads of at least `least` bytes the largest page_id is kept, others revisit it.

    Digests are counted before anything is joined; the join back is salted, so a payload that fills a third of the
    table is spread over `salts` tasks.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_length"))
    many = page.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null")
    many = many.select("payload_digest", "kept", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    page = page.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)), F.lit(0)).cast("int"))
    revisits = F.col("kept").isNotNull() & (F.col("page_id") != F.col("kept")) & (F.col("payload_length") >= least)
    return page.join(many, ["payload_digest", "salt"], "left").select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(F.concat(F.lit("urn:page:"), F.col("page_id")), F.concat(F.lit("urn:uuid:"), F.uuid())).alias("record_id"),
        F.col("url").alias("target_uri"), "payload_digest", "payload_length",
        F.when(revisits, F.concat(F.lit("urn:page:"), F.col("kept"))).alias("refers_to"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    register(spark)
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    records_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")).write.format("warc").mode("append").save(path)
    read = lambda payload: spark.read.format("warc").option("minPartitions", spark.sparkContext.defaultParallelism).option("payload", payload).load(path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+)$', 1) as bigint)")
    # revisits are told by their headers alone; payloads are decoded of the others only, and digested anew
    whole = read("true").where("record_type = 'response'").select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read("false").where("record_type = 'revisit'").select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))
    return whole.unionByName(again)


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h from p),
g as (select h, max(page_id) as kept from d where n >= 1000 group by h)
select page_id, n::bigint as payload_bytes, h as payload_digest,
  case when n >= 1000 and page_id <> kept then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> kept then kept end as refers_to
from d left join g using (h)
"""
