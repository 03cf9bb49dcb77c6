"""WARC archives compressed with Zstandard: one frame per record after a skippable frame that holds the dictionary.

Writing and reading are both tasks over shared storage. Equal payloads are kept once: the other records revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, sampled, scratch_path

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"

#: A dictionary is trained on so many pages at most, and has so many bytes at most.
SAMPLE_PAGES, DICTIONARY_BYTES = 200, 32 << 10
#: An archive is closed when it holds so many bytes of payload.
ARCHIVE_BYTES = 64 << 20
CHUNK = 64 << 10

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, payload binary"


def sha1_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page))}>"


def record(page: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """One WARC record; response is the page id whose record holds an equal payload, null where this one does."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = sha1_digest(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE)]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if response is None:
        block += payload
    else:
        fields[0] = ("WARC-Type", "revisit")
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(response)), ("X-Refers-To-Page-Id", str(response))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{sha1_digest(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, archive: str) -> tuple:
    """The fields of a record, after checking its version, named fields, lengths and digests."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{archive}: {what}")

    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    need(bool(gap) and version in ("WARC/1.0", "WARC/1.1"), f"no WARC version line: {version[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    need(all(k in fields for k in NAMED), "a named field is missing")
    n = int(fields["Content-Length"])
    need(len(rest) == n + 4 and rest[n:] == b"\r\n\r\n", f"Content-Length is {n}, the frame has {len(rest) - 4}")
    block = rest[:n]
    need(fields["WARC-Block-Digest"] == f"sha1:{sha1_digest(block)}", "the block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    need(bool(gap), "no end of the HTTP header")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        need(len(payload) == size and sha1_digest(payload) == digest, "the payload differs from its length or digest")
    else:
        need(kind == "revisit" and fields.get("WARC-Profile") == REVISIT_PROFILE and not payload, f"not a revisit record: {kind}")
    page, of = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return (page and int(page), fields.get("WARC-Target-URI"), size, digest, kind, of and int(of), archive, payload)


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages, chosen by hash; raw content where they are too few to train on."""
    rows = sampled(pages.where("html is not null").select("page_id", F.substring("html", 1, DICTIONARY_BYTES * 2).alias("html")), "page_id", SAMPLE_PAGES).limit(SAMPLE_PAGES).collect()
    samples = [r["html"].encode() for r in sorted(rows, key=lambda r: (r["page_id"], r["html"]))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"<!DOCTYPE html><html><head>"


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as archives under path (any file system of pyarrow); returns (archive, records).

    Null html is an empty payload. Of records with equal payloads that with the largest page_id is the response; rows that
    repeat both its id and payload are responses too. A null page_id ranks below all. Each archive gets its name only when it is
    complete, and a task that runs again writes the same bytes under the same name.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("content", F.sha2("html", 256))
    # pages with equal payloads are told by ids and hashes alone; html moves by page, so a crowd of empty pages meets in no task
    owners = rows.select("page_id", "content").distinct()
    groups = owners.groupBy("content").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    answers = owners.join(groups, "content").select(F.col("page_id").alias("own"), F.col("content").alias("hash"), "response")
    same = rows["page_id"].eqNullSafe(answers["own"]) & (rows["content"] == answers["hash"])
    ready = rows.join(answers, same, "left").withColumn("response", F.coalesce("response", "page_id")).sortWithinPartitions("page_id", "content", "url")
    shared = dictionary(pages)
    base, root = filesystem(path)
    base.create_dir(root, recursive=True)

    def each(batches):
        context = TaskContext.get()
        files, root = filesystem(path)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared), write_checksum=True)
        out, done, held, n, k = None, [], 0, 0, 0
        for b in batches:
            for page, url, html, response in zip(*(b[c] for c in ("page_id", "url", "html", "response")), strict=True):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{k:04d}.warc.zst"
                    draft = f"{root}/{name}.{context.taskAttemptId()}.tmp"
                    out = files.open_output_stream(draft, compression=None)
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(shared)) + shared)
                page, response = (None if x is None else int(x) for x in (page, response))
                payload = html.encode()
                out.write(compressor.compress(record(page, url, payload, None if page == response else response)))
                held, n = held + len(payload), n + 1
                if held >= archive_bytes:
                    out.close()
                    files.move(draft, f"{root}/{name}")
                    done.append((name, n))
                    out, held, n, k = None, 0, 0, k + 1
        if out is not None:
            out.close()
            files.move(draft, f"{root}/{name}")
            done.append((name, n))
        yield pd.DataFrame(done, columns=["archive", "records"])

    return ready.select(F.col("page_id").cast("string"), "url", "html", F.col("response").cast("string")).mapInPandas(each, "archive string, records long")


def frames(stream) -> Iterator[bytes]:
    """The content of each frame of an archive, read in chunks; the leading skippable frame is the dictionary."""
    decoder, held = None, b""

    def more() -> bool:
        nonlocal held
        chunk = stream.read(CHUNK)
        held += chunk
        return bool(chunk)

    while True:
        while len(held) < 8 and more():
            pass
        if not held:
            return
        if len(held) < 8:
            raise ValueError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", held)
        if magic in SKIPPABLE_FRAMES:
            while len(held) < 8 + size:
                if not more():
                    raise ValueError("the archive ends within a skippable frame")
            if magic == DICTIONARY_FRAME and decoder is None:
                content = held[8 : 8 + size]
                if content[:4] == b"\x28\xb5\x2f\xfd":
                    content = zstandard.ZstdDecompressor().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            held = held[8 + size :]
            continue
        decoder = decoder or zstandard.ZstdDecompressor()
        one, parts = decoder.decompressobj(), []
        while True:
            parts.append(one.decompress(held))
            if one.eof:
                held = one.unused_data
                break
            held = b""
            if not more():
                raise ValueError("the archive ends within a frame")
        yield b"".join(parts)


def read_archives(archives: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records of archives(archive) under path, one frame each, with headers, lengths and digests checked.

    A damaged archive fails the job with its name. Without payloads the last column is null.
    """

    def each(batches):
        files, root = filesystem(path)
        for b in batches:
            for name in b["archive"]:
                rows, held = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in frames(stream):
                        *row, payload = parsed(data, name)
                        rows.append((*row, payload if payloads else None))
                        held += len(payload) if payloads else 300
                        if held > 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    return archives.select("archive").mapInPandas(each, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.array(c, "Int64") if n in ("page_id", "refers_to") else list(c) for n, c in zip(names, columns, strict=True)})


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = scratch_path(spark, "warc")
    write_archives(pages, path).write.parquet(f"{path}-list")
    listed = spark.read.schema("archive string, records long").parquet(f"{path}-list")
    tasks = spark.sparkContext.defaultParallelism
    return read_archives(listed.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive"), path, payloads)


def op9(spark, sf_dir):
    """Every page as the archives give it back. Repeated rows give a record each; an empty table gives none."""
    from .common import table

    return round_trip(spark, table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP9_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT html, max(page_id) AS response FROM p GROUP BY html),
h AS (SELECT page_id, url, strlen(html) AS n, sha1(html) AS hex, response FROM p JOIN r USING (html))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS INT) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to, url
FROM h
"""
