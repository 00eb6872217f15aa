"""WARC records in ZIP-packaged archives, written by tasks and range-read without extraction.

An archive is a ZIP file of stored members: `archive/data.warc.gz`, WARC records each compressed on
its own, and `indexes/index.cdx`, a line a record with its place and length. A reader parses the
central directory (ZIP64 too), finds both members, reads the index, and then any record by a
read of its own bytes.

Records of equal payloads of REVISIT_BYTES or more are written once, as the response of the smallest page
id; the others are revisits that refer to it. A record's id follows from page id and payload
digest. Copies are found on page ids and digests alone, with the first page of each digest written before it is
joined, and payloads only meet the marks of their own page: no group of copies and no empty
page makes a large task. Archives are closed after ARCHIVE_RECORDS or ARCHIVE_BYTES; each attempt of a task
writes names of its own, and the archives that count are listed in `committed`.

Defined cases: a null html is an empty payload; null ids and addresses are left out of the record and
read back as null; a null id counts as the largest when the response is chosen; rows that repeat a page id and
payload are written each, all as the response if the id is the smallest, and share a record id; an empty
table gives no archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia import session
from stipendia.llm import files, zipdir
from stipendia.llm.tables import free, written

REVISIT_BYTES = 100
ARCHIVE_RECORDS = 50_000
ARCHIVE_BYTES = 256 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Records that lie closer than this are read at once.
GAP = 64 << 10
#: The table of archives beside them.
COMMITTED, ARCHIVES = "committed", "path string, records bigint, bytes bigint"
LONGEST_READ = 8 << 20


def record_id(page: int | None, digest: str) -> str:
    name = hashlib.md5(f"{page}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{uuid.UUID(name)}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str,
           refers: int | None, revisit: bool) -> bytes:
    """A WARC record. Revisits have the HTTP head, but no payload."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
              ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if page is not None:
        fields.append(("Page-ID", str(page)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, digest))]
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record whose digests hold."""
    text, _, rest = data.partition(b"\r\n\r\n")
    lines = text.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("damaged record")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a record's block does not match its digest")
    if fields["WARC-Type"] == "response" and \
            fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError("a record's payload does not match its digest")
    return fields, payload


class Archive:
    """A ZIP-packaged archive being written."""

    def __init__(self, path: str) -> None:
        self.path, self.lines, self.at = path, [], 0
        self.out = files.Output(path)
        self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)

    def add(self, data: bytes, url: str | None, kind: str, digest: str) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.member.write(packed)
        entry = {"url": url or "", "mime": "text/html", "type": kind, "digest": f"sha256:{digest}",
                 "offset": self.at, "length": len(packed), "filename": RECORDS}
        self.lines.append(f"{search_key(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}\n")
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)).encode())
        self.zip.close()
        self.out.close()


class _Stream(io.RawIOBase):
    """What zipfile needs to write to a file that cannot go back."""

    def __init__(self, out: files.Output) -> None:
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def search_key(url: str | None) -> str:
    """An address with its host turned round, as indexes are sorted."""
    found = re.match(r"^[a-z]+://(?:www\.)?([^/:?#]*)(?::\d+)?(.*)$", (url or "").lower())
    if not found:
        return quote(url or "-", safe="/?=&")
    return ",".join(reversed(found[1].split("."))) + ")" + quote(found[2] or "/", safe="/?=&")


def write(pages: DataFrame, folder: str | None = None, id_column: str = "page_id",
          url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages below `folder`; one row an archive: path, records, bytes."""
    spark = pages.sparkSession
    folder = folder or session.scratch_path(spark, "archives")
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    plain = pages.select(F.col(id_column).cast("long").alias("page"), F.col(url).alias("url"),
                         body.alias("html"), F.sha2(body, 256).alias("digest"))
    # Pages by digest meet without their text, and small ones not at all. Most pages are no revisit, so
    # only the marks of those that are go to the pages, by page and digest, which no group of copies shares.
    narrow = written(plain.where(F.octet_length("html") >= REVISIT_BYTES).select("page", "digest"), "digests")
    firsts = written(narrow.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where(
        "n > 1").drop("n"), "firsts")
    revisits = written(narrow.where("page is not null").distinct().join(firsts, "digest").where(
        "page <> first").select(F.col("page").alias("p"), F.col("digest").alias("d"), "first"), "revisits")
    missing = narrow.where("page is null").select("digest").distinct().join(firsts, "digest").where(
        "first is not null").select(F.lit(None).cast("long").alias("p"), F.col("digest").alias("d"), "first")
    marks = revisits.unionByName(missing)
    marked = plain.join(marks, plain["page"].eqNullSafe(marks["p"]) & (plain["digest"] == marks["d"]), "left").drop(
        "p", "d")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, number, part, attempt = None, 0, TaskContext.get().partitionId(), uuid.uuid4().hex
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page, address, text, digest, first in zip(*(
                    batch.column(c).to_pylist() for c in ("page", "url", "html", "digest", "first"))):
                if archive and (len(archive.lines) >= ARCHIVE_RECORDS or archive.at >= ARCHIVE_BYTES):
                    archive.close()
                    done.append((archive.path, len(archive.lines), archive.at))
                    archive, number = None, number + 1
                if not archive:
                    # Every attempt of a task has names of its own; those it returns when it ends count.
                    archive = Archive(f"{folder}/pages-{part:06d}-{number:04d}-{attempt}.wacz")
                revisit = first is not None and page != first
                archive.add(record(page, address, text.encode(), digest, first, revisit), address,
                            "revisit" if revisit else "response", digest)
        if archive:
            archive.close()
            done.append((archive.path, len(archive.lines), archive.at))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    listed = f"{folder}/{COMMITTED}"
    marked.mapInArrow(rows, ARCHIVES).write.mode("overwrite").parquet(listed)
    free(spark)
    return spark.read.schema(ARCHIVES).parquet(listed)


def index(archives: DataFrame) -> DataFrame:
    """A row a record: path, place and size in the archive file, url, type, digest.

    Reads the directory and the index member of each archive only.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from entries(path)

    def entries(path: str, most: int = 10_000) -> Iterator[pa.RecordBatch]:
        def read(begin: int, size: int) -> bytes:
            return files.read_range(path, begin, size)

        found = {m.name: m for m in zipdir.members(read, files.file_size(path))}
        listing, data = found[INDEX], found[RECORDS]
        if not (listing.stored and data.stored):
            raise zipdir.DamagedZip(f"compressed members in {path}")
        begin = data.begin(read)
        lines = read(listing.begin(read), listing.size).decode().splitlines()
        for at in range(0, len(lines), most):
            each = [json.loads(line.split(" ", 2)[2]) for line in lines[at:at + most]]
            yield pa.RecordBatch.from_arrays([
                pa.array([path] * len(each)), pa.array([begin + e["offset"] for e in each], pa.int64()),
                pa.array([e["length"] for e in each], pa.int64()), pa.array([e["url"] for e in each]),
                pa.array([e["type"] for e in each]), pa.array([e["digest"] for e in each])],
                names=["path", "place", "size", "url", "type", "digest"])

    # Rows are small and stand for whole files, so each gets a task of its own.
    tasks = max(1, archives.count())
    return archives.select("path").repartition(tasks).mapInArrow(
        rows, "path string, place bigint, size bigint, url string, type string, digest string")


def records(found: DataFrame) -> DataFrame:
    """The records of index rows: page_id, url, type, record_id, digest, refers_to, payload."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("path", "place", "size"))))
            for path, begin, stop, group in stretches(wanted):
                data = files.read_range(path, begin, stop - begin)
                out = []
                for place, size in group:
                    fields, payload = parsed(gzip.decompress(data[place - begin:place - begin + size]))
                    page = fields.get("Page-ID")
                    out.append((None if page is None else int(page), fields.get("WARC-Target-URI"),
                                fields["WARC-Type"], fields["WARC-Record-ID"],
                                fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                                fields.get("WARC-Refers-To"),
                                payload if fields["WARC-Type"] == "response" else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), *[pa.string()] * 5, pa.binary()))],
                    names=["page_id", "url", "type", "record_id", "digest", "refers_to", "payload"])

    ordered = found.select("path", "place", "size").sortWithinPartitions("path", "place")
    return ordered.mapInArrow(rows, "page_id bigint, url string, type string, record_id string, "
                                    "digest string, refers_to string, payload binary")


def stretches(wanted: list[tuple[str, int, int]]) -> Iterator[tuple]:
    """Ranges to read at once, each with the records in it, from rows in order of place."""
    held: list[tuple[int, int]] = []
    now, begin, stop = "", 0, 0
    for path, place, size in wanted:
        if held and (path != now or place > stop + GAP or place + size - begin > LONGEST_READ):
            yield now, begin, stop, held
            held = []
        if not held:
            now, begin = path, place
        held.append((place, size))
        stop = place + size
    if held:
        yield now, begin, stop, held


def summary(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    What a revisit refers to is looked up among the responses that were read.
    """
    narrow = written(found.select("page_id", "type", "record_id", "digest", "refers_to",
                                  F.octet_length("payload").cast("long").alias("n")), "records")
    target = narrow.where("type = 'response'").select(
        F.col("record_id").alias("target"), F.col("page_id").alias("response"),
        F.col("n").alias("full")).dropDuplicates(["target"])
    revisits = narrow.where("type = 'revisit'").join(
        target, F.col("refers_to") == F.col("target"), "left").select(
        "page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("response").alias("refers_to"))
    return narrow.where("type = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(revisits)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder: those that were committed, or in a folder without such a list
    all there are."""
    if session.exists(spark, f"{folder}/{COMMITTED}"):
        return records(index(spark.read.schema(ARCHIVES).parquet(f"{folder}/{COMMITTED}")))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder)
    return records(index(listed.select("path")))
