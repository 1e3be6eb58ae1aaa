"""WARC archives of pages, and the index of their captures by external merge.

``write_archives`` writes one record a page, each a gzip member of its own: a
response, or a revisit that refers to the page with an equal payload and the
largest id. ``index_archives`` reads the archives back. Each archive gives one
capture run, sorted by URL key, time and page id, as blocks. The key space is cut
at keys from a bounded sample of the blocks, Spark brings the pieces of all runs
that lie in a range together, and a loser tree merges them: a match a level
finds the next capture, whatever the number of runs. Ranges follow each other,
so ``place`` numbers the captures of the whole index, and the captures of a URL
stand together in the order of time.

A URL key is the host's labels from the last to the first, then the path, in
lower case and without scheme, "www", user, standard port and fragment; a null
URL has the empty key. The time is the column ``captured`` if the pages have it
as a timestamp, else EPOCH and as many seconds as the page id (modulo 2**31).

Cases: a null html is the empty payload; equal empty payloads are deduplicated
like others; a null page id is less than all others (payloads that only such
pages have are all responses); pages of equal id and payload are all responses
if the id is the largest; control characters of a URL are percent-encoded; html
of any length is written whole; an empty table gives an empty index; other
columns are ignored. Retried or speculative tasks write archives of other names,
and only those of tasks that succeeded are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_sequences import _file_system
from .shared import chunks, give_back, shared_folder, written

ARCHIVE_BYTES = 1 << 26    # an archive is closed beyond so many compressed bytes
ARCHIVE_RECORDS = 100_000  # ... or records, which bounds a run
EPOCH = 946_684_800        # 2000-01-01
HOT = 512                  # payloads of more than this part of all pages, fewer than HOT, are looked up by broadcast
BLOCK = 1024               # captures of a run that travel together
RANGE = 8192               # captures merged by one task, about
MOST_RANGES = 1 << 16      # beyond RANGE * MOST_RANGES captures ranges grow instead
READ = 1 << 20             # bytes of an archive read at a time
LEVEL = 6                  # of compression

NO_ID = "none"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """com,example,sub)/path?query of a URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host).rstrip(".")
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        host_key = ",".join(reversed(host.split("."))) + f":{port}"
    else:
        host_key = ",".join(reversed(host.split(".")))
    return f"{host_key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, captured (seconds), record_type, refers_to for each page.

    Payloads of fewer than ``least`` bytes are always responses.
    """
    captured = (F.unix_timestamp("captured") if dict(pages.dtypes).get("captured") in ("timestamp", "timestamp_ntz")
                else F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)).cast("bigint"), F.lit(1 << 31)))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"),
                        captured.cast("bigint").alias("captured"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    again = (rows.where(F.octet_length("html") >= least).groupBy("digest")
             .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null"))
    again = written(again, "warc-repeats")
    hot = again.where(F.col("n") * HOT > rows.count())
    rows = rows.join(F.broadcast(hot.select("digest", F.col("last").alias("hot_last"))), "digest", "left")
    # pages of hot payloads have their answer; the others meet it by digest
    apart = F.when(F.col("hot_last").isNull(), F.col("digest")).otherwise(F.unhex(F.sha1(F.encode(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "utf-8"))))
    cool = again.join(hot, "digest", "left_anti").select(F.col("digest").alias("apart"), F.col("last").alias("cool_last"))
    rows = rows.withColumn("apart", apart).join(cool, "apart", "left")
    last = F.when(F.octet_length("html") >= least, F.coalesce("hot_last", "cool_last"))
    revisit = last.isNotNull() & ~last.eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "html", "captured", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, last).alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:x-capture:{NO_ID if page_id is None else page_id}>"


def _id(uri: str) -> int | None:
    name = uri.rsplit(":", 1)[1].rstrip(">")
    return None if name == NO_ID else int(name)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, captured: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, so the length of its payload, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id)),
              ("WARC-Date", datetime.fromtimestamp(captured, UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), url)))
    if revisit:
        fields += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{_digest(payload)}"), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class _Archive:
    """An archive being written."""

    def __init__(self, folder: str):
        self.name = f"{folder}/capture-{uuid.uuid4().hex}.warc.gz"
        fs, where = _file_system(self.name)
        self.sink, self.size, self.records = fs.open_output_stream(where, compression=None), 0, 0
        info = "software: cursus\r\nformat: WARC File Format 1.1\r\n".encode()
        self._put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\n"
                  b"Content-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
                  % (str(uuid.uuid4()).encode(), datetime.fromtimestamp(EPOCH, UTC).strftime("%Y-%m-%dT%H:%M:%SZ").encode(), len(info), info))

    def _put(self, record: bytes) -> None:
        packed = _member(record)
        self.sink.write(packed)
        self.size += len(packed)

    def add(self, record: bytes) -> None:
        self._put(record)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.sink.close()
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([self.records]), pa.array([self.size])],
                                          ["file", "records", "bytes"])


def write_archives(records: DataFrame, folder: str | None = None, most_bytes: int = ARCHIVE_BYTES, most_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write planned records to ``folder`` (a new shared one by default); returns a written table (file, records, bytes)."""
    spark = records.sparkSession
    folder = folder or shared_folder(spark, "warc")
    fs, where = _file_system(folder)
    fs.create_dir(where, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for b in chunks(batch, "html"):
                payloads = b.column(2).cast(pa.large_binary())
                for page_id, url, payload, captured, kind, refers_to in zip(
                        b.column(0).to_pylist(), b.column(1).to_pylist(), payloads, b.column(3).to_pylist(),
                        b.column(4).to_pylist(), b.column(5).to_pylist()):
                    archive = archive or _Archive(folder)
                    archive.add(record_bytes(page_id, url, payload.as_py(), captured, refers_to, kind == "revisit"))
                    if archive.size > most_bytes or archive.records >= most_records:
                        yield archive.close()
                        archive = None
        if archive:
            yield archive.close()
        give_back()

    return written(records.mapInArrow(write, "file string, records bigint, bytes bigint"), "warc-archives")


def read_archive(file: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset and size of each member of an archive, with the fields and the block of its record."""
    fs, where = _file_system(file)
    with fs.open_input_stream(where, compression=None) as source:
        rest, offset = b"", 0
        while True:
            rest = rest or source.read(READ)
            if not rest:
                return
            unpacker, out, size = zlib.decompressobj(31), [], 0
            while not unpacker.eof:
                rest = rest or source.read(READ)
                if not rest:
                    raise EOFError(f"{file} ends within a record")
                out.append(unpacker.decompress(rest))
                size += len(rest) - len(unpacker.unused_data)
                rest = unpacker.unused_data
            head, _, tail = b"".join(out).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield offset, size, fields, tail[:int(fields["Content-Length"])]
            offset += size


_ENTRY = pa.schema([("key", pa.binary()), ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                    ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _key(url_key: str, captured: int, page_id: int | None) -> bytes:
    """Bytes that sort as (URL key, time, page id, null first)."""
    return (url_key.encode() + b"\0" + (captured + (1 << 63)).to_bytes(8, "big")
            + (b"\0" if page_id is None else b"\1" + (page_id + (1 << 63)).to_bytes(8, "big")))


def _entry(file: str, offset: int, size: int, fields: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record, its digest computed anew where the payload is there."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?mi)^content-length: (\d+)", head)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or _digest(payload) != digest):
        raise ValueError(f"{file}, {offset}: payload and digest differ")
    captured = int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
    url = fields.get("WARC-Target-URI")
    key, page_id = url_key(url), _id(fields["WARC-Record-ID"])
    return (_key(key, captured, page_id), key, captured, page_id, url, fields["WARC-Type"], digest, length,
            _id(fields["WARC-Refers-To"]) if revisit else None, file, offset, size)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


_BLOCKS = pa.schema([("run", pa.string()), ("block", pa.int32()), ("first", pa.binary()), ("last", pa.binary()),
                     ("n", pa.int64()), ("entries", pa.binary())])
_PIECES = pa.schema([("range", pa.int32()), ("run", pa.string()), ("block", pa.int32()), ("entries", pa.binary())])


def capture_runs(archives: DataFrame) -> DataFrame:
    """Blocks of the sorted run of each archive: run, block, first and last key, n, entries (Arrow)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                entries = sorted((_entry(file, *r) for r in read_archive(file) if r[2]["WARC-Type"] != "warcinfo"),
                                 key=lambda e: (e[0], e[10]))
                for k in range(0, len(entries), BLOCK):
                    some = entries[k:k + BLOCK]
                    rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _ENTRY.types)], schema=_ENTRY)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        ([file], [k // BLOCK], [some[0][0]], [some[-1][0]], [len(some)], [_packed(rows)]), _BLOCKS.types)], schema=_BLOCKS)
        give_back()

    tasks = max(1, min(archives.count(), 1 << 16))
    schema = "run string, block int, first binary, last binary, n bigint, entries binary"
    return archives.select("file").repartition(tasks, F.xxhash64("file")).mapInArrow(read, schema)


class LoserTree:
    """The least of the heads of k sorted sources: inner nodes keep the loser of their match, the root the winner.

    ``heads`` are keys, None for an empty source. Equal keys: the source of the smaller number wins.
    """

    def __init__(self, heads: list):
        self.k = max(1, len(heads))
        self.heads = heads + [None] * (self.k - len(heads))
        self.losers = [0] * self.k
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        """The winner below a node; leaves are the nodes from k on. No recursion: nodes are played from the last to the first."""
        won = [0] * (2 * self.k)
        for leaf in range(self.k):
            won[self.k + leaf] = leaf
        for at in range(self.k - 1, 0, -1):
            a, b = won[2 * at], won[2 * at + 1]
            won[at], self.losers[at] = (a, b) if self._beats(a, b) else (b, a)
        return won[node]

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def replace(self, head) -> None:
        """Give the winning source its next head, and play its matches again."""
        won = self.winner
        self.heads[won] = head
        node = (self.k + won) // 2
        while node:
            if self._beats(self.losers[node], won):
                self.losers[node], won = won, self.losers[node]
            node //= 2
        self.winner = won


def merged(runs: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(run, place in it) of all keys of sorted runs, in order."""
    at = [0] * len(runs)
    tree = LoserTree([r[0] if r else None for r in runs])
    while tree.heads[tree.winner] is not None:
        w = tree.winner
        yield w, at[w]
        at[w] += 1
        tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)


def _bounds(blocks: DataFrame, per_range: int) -> list[bytes]:
    """Keys that cut the captures into ranges of about equal size, from a bounded sample of the blocks."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = min(MOST_RANGES, -(-total // per_range))
    if ranges < 2:
        return []
    sample = sorted(bytes(r.first) for r in blocks.orderBy(F.xxhash64("run", "block")).limit(4 * MOST_RANGES).select("first").collect())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)})


INDEX = ("range int, in_range bigint, url_key string, captured bigint, page_id bigint, url string, record_type string, "
         "payload_digest string, payload_bytes bigint, refers_to bigint, file string, offset bigint, length bigint")


def merge_runs(blocks: DataFrame, per_range: int = RANGE) -> DataFrame:
    """The captures of all runs: INDEX columns, and ``place`` in the global order of URL key, time and page id."""
    spark = blocks.sparkSession
    bounds = _bounds(blocks, per_range)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's pieces by range; bounds are the first keys of all ranges but the first."""
        from bisect import bisect_left, bisect_right
        for batch in batches:
            for run, block, first, last, _, entries in zip(*(batch.column(c).to_pylist() for c in range(6))):
                lo, hi = bisect_right(bounds, first), bisect_right(bounds, last)
                if lo == hi:
                    pieces = [(lo, entries)]
                else:
                    rows = _unpacked(entries)
                    keys = rows.column(0).to_pylist()
                    edges = [0, *(bisect_left(keys, b) for b in bounds[lo:hi]), len(keys)]
                    pieces = [(lo + k, _packed(rows.slice(a, b - a))) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    ([p[0] for p in pieces], [run] * len(pieces), [block] * len(pieces), [p[1] for p in pieces]), _PIECES.types)], schema=_PIECES)

    def merge(group: pa.Table) -> pa.Table:
        """The pieces of one range, a source a run."""
        pieces = sorted(zip(group["run"].to_pylist(), group["block"].to_pylist(), group["entries"].to_pylist()), key=lambda p: p[:2])
        rows = pa.Table.from_batches([_unpacked(p[2]) for p in pieces])
        sizes, keys = {}, rows["key"].to_pylist()
        for (run, _, _), n in zip(pieces, (c.length() if hasattr(c, "length") else len(c) for c in rows["key"].chunks)):
            sizes[run] = sizes.get(run, 0) + n
        starts = np.append(0, np.cumsum(list(sizes.values()))).tolist()
        runs = [keys[a:b] for a, b in zip(starts, starts[1:])]
        order = [starts[r] + k for r, k in merged(runs)]
        rows = rows.take(pa.array(order)).drop_columns(["key"])
        n = rows.num_rows
        out = [pa.array(np.full(n, group["range"][0].as_py()), pa.int32()), pa.array(np.arange(n))]
        return pa.Table.from_arrays([*out, *rows.columns], names=["range", "in_range", *rows.column_names])

    pieces = blocks.mapInArrow(cut, "range int, run string, block int, entries binary")
    index = written(pieces.groupBy("range").applyInArrow(merge, INDEX), "warc-index")
    # one row a range, MOST_RANGES at most
    sizes = index.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return index.join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("in_range")).drop("before", "in_range")


def index_archives(archives: DataFrame, per_range: int = RANGE) -> DataFrame:
    """Read archives back and merge their capture runs; see ``merge_runs``."""
    return merge_runs(written(capture_runs(archives), "warc-runs"), per_range)


def captures_sql() -> str:
    """DuckDB SQL for the captures of ``pages`` as the query returns them."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    fives = " || ".join(f"substr('{letters}', 1 + ((v >> {s}) & 31)::INTEGER, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, string_agg({fives}, '' ORDER BY g) AS payload_digest
      FROM (SELECT h, g, ('0x' || substr(h, (5 * g + 1)::BIGINT, 5))::BIGINT AS v FROM (SELECT DISTINCT h FROM p), range(8) t(g)) GROUP BY h),
l AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN last END AS refers_to
FROM p JOIN d USING (h) JOIN l USING (h)"""
