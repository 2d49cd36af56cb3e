"""WARC archives of pages with deduplicated payloads, and an index merged externally from sorted runs.

Each task writes one archive of gzip members (a record each) and runs of RUN captures at most, sorted by URL key,
timestamp and page id, in batches with a sparse index of first keys. Runs are merged k-way by loser trees: while there are more
than fan runs, groups of fan are merged to longer ones; the last merge is split by key ranges, each of whose tasks
reads only the batches of its range and writes one part of the globally ordered index. Captures are then read back
from the archives by the index's offsets.

Of records with equal payloads (of at least least bytes) the one with the largest page id is a response, the others
are revisits that refer to it. Payloads are joined with those roles by digest; the payloads that most rows share are
joined by broadcast.

Files are written under temporary names and renamed, so repeated tasks replace files by equal ones.

Defined cases: a null html counts as an empty payload and a null URL as an empty one; a null page id is smaller than
all others, and where all ids of a payload are null its records are responses; rows that repeat the largest id are
all responses; other columns are ignored; an empty table gives no archives and no rows. White space and
control characters of a URL are percent-encoded in its record. A null time counts as 1970; the date in a record stays
within the years 1 and 9999, the index keeps the number. Payloads of any length are taken whole; a task holds one record
at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import put_in_place, release, shared_dir, stored
from quillgraph.llm.setjoin import with_keys

BATCH, FAN, RUN_ROWS = 2048, 64, 100_000
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
DATES = -62_135_596_800, 253_402_300_799
CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")
RUN = pa.schema([("key", pa.string()), ("ts", pa.int64()), ("page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
Place = tuple[str, int, int]


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query, in lower case."""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
        rest = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + rest


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str, ts: int, payload: bytes, refers: int | None) -> bytes:
    """The bytes of a record; refers makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>"]
    head += [f"WARC-Date: {(EPOCH + timedelta(seconds=min(max(ts, DATES[0]), DATES[1]))).strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Target-URI: {CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields, with the payload as it is and the payload's length as the HTTP header has it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    fields = dict((*x.split(": ", 1), "")[:2] for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    out = {"page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(named["Content-Length"]), "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    else:
        out["payload"] = payload
        if len(payload) != out["payload_bytes"] or digest(payload) != out["payload_digest"]:
            raise ValueError(f"the payload of page {page} isn't what its record says")
    return out


class LoserTree:
    """Merges sorted iterators of rows (key, ts, page, ...): inner nodes keep losers, so a step plays one path."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return x < y or (x == y and a < b)

    def _play(self, i: int) -> None:
        node = (i + self.k) >> 1
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._less(other, i):
                self.tree[node], i = i, other
            node >>= 1
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[w := self.tree[0]]) is not None:
            yield row
            self.heads[w] = next(self.sources[w], None)
            self._play(w)


class RunWriter:
    """Rows in order, in Arrow batches; a foot holds each batch's place and first row."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.temp = fs, path, f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.out, self.rows, self.foot, self.count = fs.open_output_stream(self.temp), [], [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= BATCH:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, RUN) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), RUN.types)], schema=RUN))
            data = sink.getvalue()
            self.foot.append((self.out.tell(), data.size, *self.rows[0][:3]))
            self.out.write(data)
            self.count += len(self.rows)
            self.rows = []

    def close(self) -> dict:
        self._flush()
        foot = json.dumps(self.foot).encode()
        self.out.write(foot + struct.pack("<I", len(foot)))
        self.out.close()
        put_in_place(self.fs, self.temp, self.path)
        step = max(1, len(self.foot) // 8)
        return {"path": self.path, "count": self.count, "sample": [json.dumps(f[2:]) for f in self.foot[::step]]}


def read_run(fs, path: str, low: Place | None = None, high: Place | None = None) -> Iterator[tuple]:
    """The rows of a run from low on and before high; only the batches that can hold them are read."""
    with fs.open_input_file(path) as f:
        size = f.size()
        n = struct.unpack("<I", f.read_at(4, size - 4))[0]
        foot = json.loads(f.read_at(n, size - 4 - n))
        for i, (at, length, *first) in enumerate(foot):
            if high is not None and tuple(first) >= high:
                return
            if low is not None and i + 1 < len(foot) and tuple(foot[i + 1][2:]) < low:
                continue
            for batch in pa.ipc.open_stream(f.read_at(length, at)):
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if (low is None or row[:3] >= low) and (high is None or row[:3] < high):
                        yield row


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> list[dict]:
    """Writes archives and runs into folder; gives a row per run: path, count, sample. time_col: seconds since 1970."""
    time = F.coalesce(F.col(time_col).cast("long"), F.lit(0)) if time_col else F.lit(0).cast("long")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), time.alias("ts"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload"))
    shared = keyed.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page").alias("response"), F.count("*").alias("c")).where("c > 1")
    cast = with_keys(keyed, stored(shared, "shared"), "c", "left", key="sha")
    out = cast.select("page", "url", "ts", "payload", F.when(F.coalesce(F.col("page") < F.col("response"), F.col("response").isNotNull()), F.col("response")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/{part:08d}.warc.gz"
        temp, f, at, index, runs = f"{name}.{TaskContext.get().taskAttemptId()}.tmp", None, 0, [], []

        def spill() -> None:
            run = RunWriter(fs, f"{root}/{part:08d}-{len(runs):04d}.run")
            for row in sorted(index):
                run.add(row)
            runs.append(run.close())
            index.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, ts, payload, refers = (c[i].as_py() for c in batch.columns)
                if f is None:
                    fs.create_dir(root, recursive=True)
                    f = fs.open_output_stream(temp)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(record(page, url, ts, payload, refers)) + z.flush()
                f.write(member)
                index.append((url_key(url), ts, -1 if page is None else page, name, at, len(member)))
                at += len(member)
                if len(index) >= RUN_ROWS:
                    spill()
        if f is None:
            return
        f.close()
        put_in_place(fs, temp, name)
        if index:
            spill()
        yield pa.RecordBatch.from_pylist(runs, schema=pa.schema([("path", pa.string()), ("count", pa.int64()), ("sample", pa.list_(pa.string()))]))

    found = [r.asDict() for r in out.mapInArrow(write, MANIFEST).collect()]
    release()
    return sorted(found, key=lambda r: r["path"])


MANIFEST = "path string, count long, sample array<string>"


def merge_index(spark: SparkSession, runs: list[dict], folder: str, fan: int = FAN, rows_each: int = 250_000) -> list[dict]:
    """Parts of the merged index, in global order: path, count, sample."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for job in batch.to_pylist():
                low, high = (tuple(json.loads(job[x])) if job[x] else None for x in ("low", "high"))
                run = RunWriter(fs, f"{root}/{job['name']}.run")
                for row in LoserTree([read_run(fs, p, low, high) for p in job["runs"]]):
                    run.add(row)
                yield pa.RecordBatch.from_pylist([run.close()], schema=pa.schema([("path", pa.string()), ("count", pa.int64()), ("sample", pa.list_(pa.string()))]))

    def work(jobs: list[tuple]) -> list[dict]:
        df = spark.createDataFrame(jobs, "name string, runs array<string>, low string, high string").repartition(len(jobs), "name")
        return sorted((r.asDict() for r in df.mapInArrow(merge, MANIFEST).collect()), key=lambda r: r["path"])

    level = 0
    while len(runs) > fan:
        level += 1
        runs = work([(f"merge{level}-{i // fan:06d}", [r["path"] for r in runs[i : i + fan]], None, None) for i in range(0, len(runs), fan)])
    if not runs:
        return []
    parts = -(-sum(r["count"] for r in runs) // rows_each)
    sample = sorted(tuple(json.loads(x)) for r in runs for x in r["sample"])  # at most some 16 of each of fan runs
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)})
    edges = [None, *(json.dumps(c) for c in cuts), None]
    return work([(f"index-{i:06d}", [r["path"] for r in runs], a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def captures(spark: SparkSession, index: list[dict], folder: str, payloads: bool = False) -> DataFrame:
    """A row per capture in the index, read from the archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, url_key, ts, position (place in the global order), and the payload where asked for."""
    base, at = [], 0
    for part in index:
        base.append((part["path"], at))
        at += part["count"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = batch.to_pylist()
            rows.sort(key=lambda r: (r["file"], r["offset"]))
            name, f, out, held = None, None, [], 0
            for r in rows:
                if r["file"] != name:
                    if f is not None:
                        f.close()
                    name, f = r["file"], fs.open_input_file(r["file"])
                x = parse(zlib.decompress(f.read_at(r["length"], r["offset"]), 31))
                held += len(x["payload"] or b"") if payloads else 0
                out.append(x | {"url_key": r["key"], "ts": r["ts"], "position": r["position"]})
                if held > 1 << 25:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out, held = [], 0
            if f is not None:
                f.close()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("ts", pa.int64()), ("position", pa.int64())]
    kind = pa.schema(fields + [("payload", pa.binary())] * payloads)
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, ts long, position long" + ", payload binary" * payloads
    places = index_rows(spark, base, folder)
    return places.repartition("file").mapInArrow(read, ddl)


def index_rows(spark: SparkSession, base: list[tuple[str, int]], folder: str) -> DataFrame:
    """The index in rows: key, ts, page, file, offset, length, position."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                rows, at = [], part["base"]
                for row in read_run(fs, part["path"]):
                    rows.append((*row, at))
                    at += 1
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    kind = pa.schema([*RUN, ("position", pa.int64())])
    parts = spark.createDataFrame(base, "path string, base long")
    return parts.repartition(max(1, len(base)), "path").mapInArrow(read, "key string, ts long, page long, file string, offset long, length long, position long")


def archive(pages: DataFrame, least: int = 0, time_col: str | None = None) -> tuple[str, list[dict]]:
    """Writes archives and their merged index to the shared folder; gives the folder and the index's parts."""
    folder = shared_dir(pages.sparkSession, "warc")
    return folder, merge_index(pages.sparkSession, write_archives(pages, folder, least, time_col=time_col), folder)
