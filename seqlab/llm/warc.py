"""WARC archives: written by tasks, and read back by verifying chains of record boundaries.

Writing: each task writes files of about `file_bytes` under names of its own, and returns their names and lengths. Only
files that a task returned are read, so what a lost or repeated task leaves behind does no harm.

Reading: files are cut into blocks. In each block a task looks for every "WARC/1.0" that starts a header with a
Content-Length, and emits (offset, offset of the first successor outside the block): the record-to-successor chain
followed through the block. Pointer jumping over (file, offset) from offset 0 then doubles the reach in every round,
so that after log2(blocks in a file) rounds exactly the places where the chain enters a block are known. A second task
a block walks from that entry. Magic inside a payload is never reached, whatever it looks like.

Defined results: null html is an empty payload. Equal payloads of at least 100 bytes revisit the smallest page_id of
the group, and rows that repeat that page_id are responses too; a null page_id counts as larger than all others. An
empty table gives no files and no rows. Further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import only, scratch, staged

MAGIC = b"WARC/1.0\r\n"
FILE_BYTES, BLOCK_BYTES, LEAST_BYTES = 64 << 20, 8 << 20, 100
TASKS = 100_000  # a task reads one block, or several where there are more blocks than this
HEAD = re.compile(rb"WARC/1\.0\r\n(?:[A-Za-z-]+: [^\r\n]*\r\n)+\r\n")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""), f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages (page_id, url, html, digest, refers_to); returns the files that count: path, length."""
    def task(batches):
        system, base = opened(folder)
        out = path = None
        size, done = 0, []

        def close():
            if out is not None:
                out.close()
                done.append((path, size))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers in zip(*cols, strict=True):
                if out is None or size >= file_bytes:
                    close()
                    system.create_dir(base, recursive=True)
                    path, size = f"{folder}/{uuid.uuid4().hex}.warc", 0
                    out = system.open_output_stream(f"{base}/{path.rpartition('/')[2]}")
                data = record(page_id, url, (html or "").encode(), digest, refers)
                out.write(data)
                size += len(data)
        close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()),
                                          "length": pa.array([n for _, n in done], pa.int64())})

    return pages.mapInArrow(task, "path string, length long")


def header_at(data: bytes, at: int) -> tuple[int, int] | None:
    """(end of the header, Content-Length) of a record that starts at `at`."""
    m = HEAD.match(data, at)
    n = m and re.findall(rb"\r\nContent-Length: (\d+)\r\n", data[at:m.end()])
    return (m.end(), int(n[0])) if n and len(n) == 1 else None


def load(handle, start: int, end: int, length: int, more: int = 1 << 16) -> bytes:
    """Bytes from start to end, and after that until the header that began before `end` is over."""
    data = handle.read_at(min(end + more, length) - start, start)
    while start + len(data) < length and b"\r\n\r\n" not in data[end - start:]:
        data += handle.read_at(min(more, length - start - len(data)), start + len(data))
    return data


def tasks(files: DataFrame, block_bytes: int) -> int:
    n = files.agg(F.sum(F.ceil(F.col("length") / block_bytes))).first()[0] or 1
    return max(1, min(int(n), TASKS))


def blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, length, start, stop) of every block, a row each."""
    return (files.where("length > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))))
            .withColumn("stop", F.least(F.col("start") + block_bytes, "length")))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows of blocks over n tasks: the rows are tiny but what they name is not, so their number is fixed, not their size."""
    return rows.repartition(n, "path", "start")


def candidates(batches):
    """Every offset that looks like a record's start, with its chain's first offset outside the block."""
    for batch in batches:
        for path, length, start, stop in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "start", "stop")], strict=True):
            system, name = opened(path)
            with system.open_input_file(name) as handle:
                data = load(handle, start, stop, length)
            at, nexts = data.find(MAGIC), {}
            while 0 <= at < stop - start:
                if got := header_at(data, at):
                    nexts[start + at] = start + got[0] + got[1] + 4
                at = data.find(MAGIC, at + 1)
            exits: dict[int, int] = {}
            for x in sorted(nexts, reverse=True):  # successors lie behind, so theirs is known
                y = nexts[x]
                exits[x] = exits.get(y, y) if y < stop else y
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([path] * len(exits), pa.string()), "off": pa.array(list(exits), pa.int64()),
                "exit": pa.array(list(exits.values()), pa.int64())})


def entries(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, off): where the chain of real records enters each block it enters; by pointer jumping from offset 0."""
    cut = dealt(blocks(files, block_bytes), tasks(files, block_bytes))
    jump = staged(cut.mapInArrow(candidates, "path string, off long, exit long"), "warc-chain")
    reached = files.where("length > 0").select("path", F.lit(0).cast("long").alias("off"))
    longest = files.agg(F.max("length")).first()[0] or 0
    for _ in range(max(1, math.ceil(math.log2(max(1, longest / block_bytes) + 1)))):
        ahead = reached.join(jump, ["path", "off"]).select("path", F.col("exit").alias("off"))
        reached = staged(reached.unionByName(ahead).distinct(), "warc-reach")
        twice = jump.select("path", F.col("off").alias("from"), F.col("exit").alias("off")).join(jump, ["path", "off"])
        jump = staged(twice.select("path", F.col("from").alias("off"), "exit"), "warc-jump")
    return reached


def walk(batches):
    """Records of a block from its entry: header fields, payload length and digest as read."""
    for batch in batches:
        rows = []
        for path, length, stop, off in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "stop", "off")], strict=True):
            system, name = opened(path)
            with system.open_input_file(name) as handle:
                base, data, at = off, load(handle, off, stop, length), off
                while at < stop:
                    got = header_at(data, at - base)
                    if got is None:
                        raise ValueError(f"no record at {path}:{at}")
                    head, n = got
                    if base + head + n > base + len(data):  # a record that ends in a later block
                        data += handle.read_at(head + n - len(data), base + len(data))
                    body = data[head:head + n]
                    field = dict(re.findall(r"([A-Za-z-]+): ([^\r\n]*)", data[at - base:head].decode()))
                    ident = lambda k: (lambda x: int(x) if x else None)(field.get(k, "")[10:-1])
                    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].partition(":")[2]
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload at {path}:{at} does not have its digest")
                    rows.append((ident("WARC-Record-ID"), n if kind == "response" else int(field["X-Payload-Length"]),
                                 digest, kind, ident("WARC-Refers-To")))
                    at = base + head + n + 4
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def read(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    cut = blocks(files, block_bytes)
    start = (F.col("off") - F.col("off") % block_bytes)
    at = entries(files, block_bytes).withColumn("start", start)
    return dealt(cut.join(at, ["path", "start"]), tasks(files, block_bytes)).mapInArrow(
        walk, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def revisits(pages: DataFrame) -> DataFrame:
    """(digest, first): payloads of at least LEAST_BYTES that several rows have, with their smallest page_id."""
    seen = pages.where(f"bytes >= {LEAST_BYTES}").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return seen.where("n > 1 and first is not null").select("digest", "first")


def archive(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages as response and revisit records; returns the files."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    # Digests alone are shuffled; a written table's size is known, so a small one is broadcast and the html stays put.
    first = staged(revisits(base.drop("html", "url")), "warc-first")
    rows = base.join(first, "digest", "left").withColumn("refers_to", F.when(
        (F.col("bytes") >= LEAST_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return staged(write(rows.select("page_id", "url", "html", "digest", "refers_to"), folder, file_bytes), "warc-files")


def op9(spark, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/llm-warc-{uuid.uuid4().hex[:12]}"
    return read(archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder))
