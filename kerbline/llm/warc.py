"""WARC archives: writing, and reading by byte ranges with a verified record chain."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, filesystem, spread_join

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: A header block longer than this is no header.
MOST_HEADER = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    """Header values hold no control characters or blanks."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record: a response with its payload or, where first is the page it repeats, a revisit without."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    digest, revisit = base32_sha1(payload), first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {name(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return MAGIC + "\r\n".join(head).encode() + END + block + END


def _write(batches, folder: str, most: int):
    """Archives of about `most` bytes. A file counts once its row is in the manifest, so a repeated task does no harm."""
    import pyarrow as pa

    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    out, path, size, n, rows = None, None, 0, 0, []
    for b in batches:
        for page_id, url, html, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            data = record(page_id, url, html or b"", first)
            if out is None:
                path, size, n = f"{uuid.uuid4().hex}.warc", 0, 0
                out = fs.open_output_stream(f"{at}/{path}")
            out.write(data)
            size, n = size + len(data), n + 1
            if size >= most:
                out.close()
                rows.append((f"{folder}/{path}", size, n))
                out = None
    if out is not None:
        out.close()
        rows.append((f"{folder}/{path}", size, n))
    if rows:
        yield pa.RecordBatch.from_pydict({"path": [r[0] for r in rows], "bytes": [r[1] for r in rows], "records": [r[2] for r in rows]})


def firsts(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """(page_id, d, first): pages and payload digests of at least `least` bytes that an earlier page_id holds too.

    Only digests and ids are shuffled; minima are combined before the shuffle, and a payload that very many pages
    share has its pages dealt over several tasks.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    keys = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(body)).alias("d"), F.length(body).alias("size")).where(F.col("size") >= least)
    keys = scratch.save(keys.select("page_id", "d"), "digests")
    low = keys.groupBy("d").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n")).where("last > first")
    low = scratch.save(low.select("d", "first", "n"), "shared")
    total = low.agg(F.sum("n")).first()[0] or 0
    return spread_join(keys, low.select("d", "first"), ["d"], low.select("d", "n"), total).where("page_id > first").select("page_id", "d", "first")


def write_archives(pages: DataFrame, scratch: Scratch, least: int = 0, most: int = 64 << 20) -> DataFrame:
    """Writes pages(page_id, url, html) and returns the manifest (path, bytes, records).

    One record per row. Null html is an empty payload; a null url is urn:none; a row with a null page_id is always
    a response. Repeated rows with the smallest page_id are all responses; rows that repeat a page_id with other
    payloads are records of their own, each a response or a revisit by its own payload. Other columns are not read.
    No rows: an empty manifest.
    """
    seen = scratch.save(firsts(pages, scratch, least).distinct(), "firsts")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    p = p.withColumn("d", F.unhex(F.sha1(F.coalesce("html", F.lit("").cast("binary")))))
    todo = p.join(seen, ["page_id", "d"], "left").select("page_id", "url", "html", "first")
    folder = scratch.path("archives")
    return scratch.save(todo.mapInArrow(partial(_write, folder=folder, most=most), "path string, bytes long, records long"), "manifest")


#: What parse_header() gives where a header may go on beyond the data.
MORE = (0, {})


def parse_header(data: bytes, at: int = 0) -> tuple[int, dict[str, str]] | None:
    """(bytes up to the block, fields) of the header at `at`; MORE if it doesn't end in the data; None if none is there.

    Lines are read one by one and the first that can't be a header's ends it, so of magic lines in a row each costs
    the bytes up to the next."""
    if not MAGIC.startswith(data[at : at + len(MAGIC)]):
        return None
    line, fields = at + len(MAGIC), {}
    while (end := data.find(b"\r\n", line, at + MOST_HEADER)) != line:
        if end < 0:
            return MORE if len(data) - at < MOST_HEADER else None
        k, sep, v = data[line:end].partition(b":")
        if not sep:
            return None
        fields[k.strip().decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
        line = end + 2
    return (line + 2 - at, fields) if re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) else None


def _candidates(batches):
    """Per byte range, every place that looks like a record and where the chain from it leaves the range.

    exit is the offset of the record that stands at or after the range's end (or the file's end), -1 if the chain
    breaks inside. Magic in a payload gives a candidate too; only the chain from offset 0 tells them apart.
    """
    import pyarrow as pa

    for b in batches:
        out = {"path": [], "entry": [], "exit": []}
        for path, start, end, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            fs, at = filesystem(path)
            with fs.open_input_file(at) as f:
                data = f.read_at(min(size, end + len(MAGIC)) - start, start)
                ends = lambda at: at + len(END) > start + len(data) or data[at - start : at - start + len(END)] == END
                places = [start + m.start() for m in re.finditer(re.escape(MAGIC), data) if start + m.start() < end]
                succ = {}
                for p in places:
                    head = parse_header(data, p - start)
                    if head is MORE:  # at most one: a header that isn't over holds no other magic
                        head = parse_header(f.read_at(min(size - p, MOST_HEADER + len(END)), p))
                    if head and head is not MORE:
                        nxt = p + head[0] + int(head[1]["content-length"]) + len(END)
                        if nxt <= size and ends(nxt - len(END)):  # the end of a record that leaves the range is checked on reading
                            succ[p] = nxt
            exits = {}
            for p in sorted(succ, reverse=True):
                exits[p] = succ[p] if succ[p] >= end else exits.get(succ[p], -1)
            out["path"] += [path] * len(exits)
            out["entry"] += exits
            out["exit"] += exits.values()
        yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["entry"], pa.int64()), pa.array(out["exit"], pa.int64())], names=["path", "entry", "exit"])


def chain(manifest: DataFrame, scratch: Scratch, split: int = 16 << 20) -> DataFrame:
    """(path, start, end, size, entry): per byte range the first true record in it, by pointer jumping from offset 0.

    Within a range the chain is already shortened to one hop, so the jumps double over ranges: a file of 1 GB in
    ranges of 16 MB takes 6 rounds. Raises ValueError if some file's chain doesn't reach its end.
    """
    spark = manifest.sparkSession
    files = manifest.where("bytes > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"), F.col("bytes").alias("size"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "size").alias("end"), "size")
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split)), F.max(F.ceil(F.col("bytes") / split))).first()
    width = max(1, min(int(n[0] or 1), 4 * spark.sparkContext.defaultParallelism))
    got = ranges.repartition(width).mapInArrow(_candidates, "path string, entry long, exit long")
    jumps = candidates = scratch.save(got, "candidates")
    reached = files.select("path", F.lit(0).cast("long").alias("entry"))
    steps, k = max(0, int(n[1] or 1) - 1), 0
    while (1 << k) <= steps:  # after round k every record within 2^(k+1) ranges is reached
        step = reached.join(jumps, ["path", "entry"]).select("path", F.col("exit").alias("entry")).where("entry >= 0")
        reached = scratch.save(reached.union(step).distinct(), f"reached-{k}")
        k += 1
        if (1 << k) <= steps:
            twice = jumps.select("path", F.col("entry").alias("from"), F.col("exit").alias("entry")).join(jumps, ["path", "entry"])
            jumps = scratch.save(twice.select("path", F.col("from").alias("entry"), "exit").where("exit >= 0"), f"jumps-{k}")
    at = reached.withColumn("start", F.col("entry") - F.col("entry") % split)
    ends = scratch.save(ranges.join(at, ["path", "start"]).where("entry < end"), "entries")
    last = reached.join(candidates, ["path", "entry"]).groupBy("path").agg(F.max("exit").alias("to"))
    if (bad := files.join(last, "path", "left").where("coalesce(to, -1) <> bytes").select("path").first()) is not None:
        raise ValueError(f"the record chain of {bad[0]} breaks")
    return ends


def _records(batches, payloads: bool):
    """Reads each range's records one after another from its true entry on and checks their digests."""
    import pyarrow as pa

    page = lambda v: None if not v or v == "<urn:page:none>" else int(v[len("<urn:page:") : -1])
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *["payload"] * payloads]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * payloads]
    for b in batches:
        for path, end, entry in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            fs, where = filesystem(path)
            with fs.open_input_file(where) as f:
                buf, base, at, rows, held = b"", entry, entry, [], 0
                size = f.size()
                while at < end:
                    head = parse_header(buf, at - base)
                    if head is None or head is MORE or at - base + head[0] + int(head[1]["content-length"]) + len(END) > len(buf):
                        want = MOST_HEADER if head is None or head is MORE else head[0] + int(head[1]["content-length"]) + (1 << 20)
                        if head is None or at == base and len(buf) >= min(want, size - at):
                            raise ValueError(f"no record at {at} of {path}")
                        base, buf = at, f.read_at(min(size - at, want), at)
                        continue
                    n, h = head
                    block = buf[at - base + n : at - base + n + int(h["content-length"])]
                    if buf[(over := at - base + n + len(block)) : over + len(END)] != END:
                        raise ValueError(f"the record at {at} of {path} doesn't end")
                    if h.get("warc-block-digest") not in (None, f"sha1:{base32_sha1(block)}"):
                        raise ValueError(f"bad block digest at {at} of {path}")
                    http, _, body = block.partition(END)
                    digest, revisit = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "revisit"
                    if not revisit and digest != base32_sha1(body):
                        raise ValueError(f"bad payload digest at {at} of {path}")
                    full = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1]) if revisit else len(body)
                    rows.append((page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], digest, full, page(h.get("warc-refers-to")), *([None if revisit else body] * payloads)))
                    held += len(body) if payloads else 0
                    at += n + len(block) + len(END)
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(manifest: DataFrame, scratch: Scratch, split: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """Records of the archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to[, payload].

    payload is null for revisits. Every block and payload digest is checked; a broken chain or digest raises.
    """
    ends = chain(manifest, scratch, split)
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads
    width = max(1, 4 * scratch.spark.sparkContext.defaultParallelism)
    return ends.select("path", "end", "entry").repartition(width).mapInArrow(partial(_records, payloads=payloads), schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = read_archives(write_archives(pages, scratch), scratch, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
g AS (SELECT *, list_transform(range(8), lambda j: CAST('0x' || substr(x, CAST(5 * j + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""
