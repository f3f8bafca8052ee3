"""WARC archives: a writer with revisits and a reader that salvages damaged files."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import materialize, scratch_path, small_batches, small_side

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
CHUNK = 1 << 20
FIRST_READ = 1 << 16
#: What may still become a header where its end is not read yet.
OPEN_HEADER = re.compile(rb"WARC/1\.\d+\r\n(?:[!-9;-~]{1,100}:[^\r\n]*\r\n|[ \t][^\r\n]*\r\n)*(?:[!-9;-~]{0,100}|[!-9;-~]{1,100}:[^\r\n]*|[ \t][^\r\n]*)\r?\Z")
RECORD_SCHEMA = (
    "path string, offset long, length long, status string, reason string, record_type string, page_id long, "
    "target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long, "
    "inner_offset long, inner_length long"
)


def _uri(page_id: int) -> str:
    return f"<urn:recollect:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit (refers_to given) leaves the payload out."""
    block = payload if refers_to is None else b""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _uri(page_id) if page_id is not None else f"<urn:recollect:payload:{digest}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else _uri(refers_to),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + b"\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


#: Schemes of the paths that tasks can open; an object store's rename is a copy.
SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")


def _openable(uri: str) -> str:
    scheme = uri.partition(":")[0] if ":" in uri else "file"
    if scheme not in SCHEMES:
        raise ValueError(f"WARC files can't be opened under {scheme}:, only under {', '.join(SCHEMES)}")
    return uri


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", _openable(uri)))


def _writer(folder: str, level: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        # Each attempt writes a file of its own; the rename at the end puts one of them in place.
        own, n = f"{root}/.{name}.{task.taskAttemptId()}", 0
        with files.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    page = int(row.page_id) if row.page_id else None
                    first = int(row.refers_to) if row.refers_to else None
                    one = record(page, row.url, (row.html or "").encode("utf-8", "replace"), row.digest, first)
                    out.write(gzip.compress(one, level, mtime=0))
                    n += 1
        files.move(own, f"{root}/{name}")
        yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})

    return write


def write_warc(pages: DataFrame, folder: str, least: int = 100, level: int = 4) -> DataFrame:
    """Write a record for every (page_id, url, html) into .warc.gz files, a member each; gives the manifest.

    Of pages with equal payloads of at least `least` bytes the one of the smallest page_id is a
    response and the others revisit it. Digests are found first, so only the table of
    repeated digests meets the pages: broadcast if small, else by a shuffle join.
    """
    _openable(folder)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")), 256).alias("digest"),
    )
    long_ = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc-repeats")
    rows = rows.join(small_side(first), "digest", "left")
    # A null page_id is never the smallest one where another page has an id.
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("refers_to", F.when(other, F.col("first")))
    # As strings, for pandas would make floats of whole numbers among nulls.
    ids = [F.col(x).cast("string").alias(x) for x in ("page_id", "refers_to")]
    rows = rows.select("url", "html", "digest", *ids)
    return materialize(small_batches(rows).mapInPandas(_writer(folder, level), "path string, records long"), "warc-manifest")


class Source:
    """A file read at any offset, a chunk in memory at a time."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.at, self.data = 0, b""

    def read(self, offset: int, n: int) -> bytes:
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.at = offset
            self.data = self.file.read_at(min(max(n, CHUNK), self.size - offset), offset) if offset < self.size else b""
        low = offset - self.at
        return self.data[low : low + n]

    def find(self, marks: tuple[bytes, ...], offset: int) -> int | None:
        """First place of any of the marks from offset on."""
        while offset < self.size:
            part = self.read(offset, CHUNK)
            found = [i for m in marks if (i := part.find(m)) >= 0]
            if found:
                return offset + min(found)
            if offset + len(part) >= self.size:
                return None
            offset += len(part) - max(map(len, marks)) + 1
        return None


def _member(source: Source, offset: int) -> tuple[bytes, int]:
    """A gzip member's content and its end; raises on damage (the format's own check included)."""
    inflate, out, at = zlib.decompressobj(31), [], offset
    while not inflate.eof:
        part = source.read(at, 1 << 16)
        if not part:
            raise ValueError("cut member")
        out.append(inflate.decompress(part))
        at += len(part)
    return b"".join(out), at - len(inflate.unused_data)


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that stands in data at a place; raises if a check fails."""
    end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/1.", at) else -1
    if end < 0:
        raise ValueError("no version line")
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        raise ValueError("no length")
    stop = end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("length is wrong")
    block = data[end + 4 : stop]
    if head.get("warc-type") == "response":
        said = head.get("warc-payload-digest", "")
        if said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
            raise ValueError("digest is wrong")
    return head, block, stop + 4


def _plain(source: Source, offset: int) -> tuple[dict[str, str], bytes, int]:
    n, left = FIRST_READ, source.size - offset
    data = source.read(offset, n)
    # A header may be of any length, as long as it still looks like one.
    while n < left and b"\r\n\r\n" not in data and OPEN_HEADER.match(data):
        n *= 4
        data = source.read(offset, min(n, left))
    said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\r\n", data)
    end = data.find(b"\r\n\r\n")
    if end >= 0 and said and said.start() < end:
        # The end is looked at first: a damaged length is found out by four bytes and not by reading what it claims.
        whole = end + 8 + int(said[1])
        if whole > left or source.read(offset + whole - 4, 4) != b"\r\n\r\n":
            raise ValueError("length is wrong")
        data = source.read(offset, whole)
    head, block, n = parse_record(data)
    return head, block, offset + n


def _records(content: bytes) -> list[tuple[str, dict[str, str], bytes, int, int]]:
    """(reason, headers, block, place, length) of all records and gaps of a member's content; raises where no record is valid."""
    out, at, bad, why = [], 0, None, ""
    while 0 <= at < len(content):
        try:
            head, block, end = parse_record(content, at)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            at = content.find(b"WARC/1.", at + 1)
            continue
        if bad is not None:
            out.append((why, {}, b"", bad, at - bad))
            bad = None
        out.append(("", head, block, at, end - at))
        at = end
    if not any(head for _, head, *_ in out):
        raise ValueError(why or "empty member")
    return out + ([(why, {}, b"", bad, len(content) - bad)] if bad is not None else [])


def salvage(source: Source) -> Iterator[tuple[int, int, str, dict[str, str], bytes, int | None, int | None]]:
    """(offset, length, reason, headers, block, inner offset, inner length) of every record, and of gaps (reason given) between.

    Records are gzip members or plain. Where one fails its checks, the next place is searched
    where a member opens or a version line stands and a whole valid record follows; the
    bytes up to there are a gap. All that a member holds has the member's offset, and what comes
    after its first record or gap has length 0; its place and length in the member's content are the inner ones,
    which are None outside of members. A member is inflated whole; a plain record is read only after its claimed end was found to be one.
    """
    at, bad, why = 0, None, ""
    while at < source.size:
        try:
            if source.read(at, 3) == MEMBER:
                content, end = _member(source, at)
                records = _records(content)
            else:
                head, block, end = _plain(source, at)
                records = [("", head, block, None, None)]
        except (ValueError, zlib.error) as e:
            if bad is None:
                bad, why = at, str(e)
            at = source.find((MEMBER, b"WARC/1."), at + 1)
            if at is None:
                break
            continue
        if bad is not None:
            yield bad, at - bad, why, {}, b"", None, None
            bad = None
        for i, one in enumerate(records):
            yield at, 0 if i else end - at, *one
        at = end
    if bad is not None:
        yield bad, source.size - bad, why, {}, b"", None, None


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:recollect:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _reader(with_payload: bool):
    def rows_of(path: str) -> Iterator[tuple]:
        files, name = _filesystem(path)
        with files.open_input_file(name) as f:
            for offset, length, why, head, block, *inner in salvage(Source(f)):
                if why:
                    yield path, offset, length, "gap", why, None, None, None, None, None, None, None, *inner
                    continue
                kind = head.get("warc-type")
                full = kind != "revisit"
                said = head.get("warc-payload-digest", "").removeprefix("sha256:")
                n = len(block) if full else int(head.get("x-payload-length") or 0)
                yield (
                    path, offset, length, "record", None, kind, _page(head.get("warc-record-id")),
                    head.get("warc-target-uri"), block if with_payload else None, n,
                    hashlib.sha256(block).hexdigest() if full else said, _page(head.get("warc-refers-to")), *inner,
                )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        whole = {x: "Int64" for x in ("offset", "length", "page_id", "payload_bytes", "refers_to", "inner_offset", "inner_length")}
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                for row in rows_of(path):
                    rows.append(row)
                    held += len(row[8] or b"") + 200
                    if held > 8 * CHUNK:
                        yield pd.DataFrame(rows, columns=names).astype(whole)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(whole)

    return read


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records and gaps of all .warc and .warc.gz files of a folder, a row each (RECORD_SCHEMA).

    status is `record` or `gap`; gaps are the quarantine log: path, offset, length, reason, and inner_offset
    and inner_length where the gap lies in a gzip member's content. Files
    are streamed; a record or gzip member is the most that is in memory.
    """
    _openable(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    files = files.select("path")
    return files.mapInPandas(_reader(payload), RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write pages as WARC files in the shared folder and give what reading them back finds.

    One row a page: page_id, payload_bytes, payload_digest, record_type, refers_to, path,
    offset. A null html is an empty payload, a null url has no target line, a page without an
    id has null page_id; rows that repeat a page are records each (all responses if theirs is the
    smallest id). An empty table gives an empty result. Raises if other than all written records are read.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_warc(pages, folder, least)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = materialize(read_warc(spark, folder, payload=False).where("status = 'record'"), "warc-found")
    written, read = manifest.agg(F.sum("records")).first()[0], found.count()
    if written != read:
        raise ValueError(f"{written} records were written and {read} read")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.element_at(F.split("path", "/"), -1).alias("file"), "offset")
