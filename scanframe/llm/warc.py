"""WARC archives with a two-level capture index.

Each task writes its pages to one archive, every record a gzip member, and returns one line per capture: URL key (host
reversed), page, archive, offset and length. Payloads move once at most, those of a frequent payload to many tasks. The
lines alone are sorted by key over range partitions and written as index files: compressed blocks of lines in key
order, and behind them a sparse directory with each block's first key, place and size. The table of parts (bounds of the
keys, file, place of the directory) is the first level; it has one row per index file, at most MAX_PARTS rows with bounds
of at most CLIP characters, so it may be broadcast.

A lookup finds a key's parts, then the block, then the lines by binary search, reading only those ranges of the index;
the lines found are then dealt by archive and offset, so that records are read in the order in which they lie, neighbours
in one read.

Files go to the shared folder through Arrow's file systems (local, HDFS, S3, GCS); each task attempt writes
files of its own name, and only those named in the committed tables of lines and parts are ever read.

Defined results: null html is an empty payload; null urls have the empty key; of equal payloads the largest page id
is the response, captures without an id revisit it; captures that share page id and payload are all responses if it is the largest
id, and all are kept; if no capture of a payload has an id, all are responses; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import bucket_count, join_salted, materialize, shared_dir

BLOCK_LINES = 300
#: Captures of one index file, unless that made more than MAX_PARTS files.
PART_LINES, MAX_PARTS, CLIP = 10_000, 1 << 16, 200
#: Bytes of an archive that a task reads, and of neighbouring records that are read at once.
RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINES = "key string, capture string, url string, warc string, at bigint, size bigint"
_PARTS = "idx string, at bigint, size bigint, first string, last string, n bigint"
_ROWS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def url_key(url: Column) -> Column:
    """Reversed host, then port, path and query: http://a.example.com/x gives com,example,a)/x."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(u, pattern, 1)), r"\.")), ",")
    return F.when(u.rlike(pattern), F.concat(host, F.lit(")"), F.regexp_extract(u, pattern, 2))).otherwise(u)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    return (text or "").encode("unicode_escape").decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP headers, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{i}').urn}>"
    head = {
        "WARC-Type": "response" if revisit_of is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _line(url),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    body = http + payload
    if revisit_of is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(revisit_of), "Capture-Refers-To": str(revisit_of)}
        body = http
    if page_id is not None:
        head["Capture-ID"] = str(page_id)
    head["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record; a response's digest is computed from what was read and must equal its header."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines if ": " in x)
    body = rest[: int(h["Content-Length"])]
    if version != "WARC/1.1" or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = body.partition(b"\r\n\r\n")
    kind, stated = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (digest(payload) != stated or len(payload) != size):
        raise ValueError(f"the payload of {h['WARC-Record-ID']} is not what was archived")
    return {
        "page_id": int(h["Capture-ID"]) if "Capture-ID" in h else None, "payload_bytes": size, "payload_digest": stated, "record_type": kind,
        "refers_to": int(h["Capture-Refers-To"]) if "Capture-Refers-To" in h else None, "payload": payload if kind == "response" else None,
    }


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def plan_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, key and revisit_of; payloads are compared by digest, without moving them twice."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    first = p.where(F.length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response IS NOT NULL")
    j = join_salted(p, materialize(first, "responses"), "sha", F.struct("page_id", "url"), "left")
    of = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return j.select("page_id", "url", "payload", url_key(F.col("url")).alias("key"), of.cast("string").alias("revisit_of"), F.col("page_id").cast("string").alias("capture"))  # texts: pandas has no null integers


def _write_records(root_uri: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _file_system(root_uri)
        name, place, out = f"{root}/archive-{uuid.uuid4().hex}.warc.gz", 0, None
        for f in frames:
            if f.empty:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(name, compression=None)
            at, size = [], []
            for page_id, url, payload, of in zip(f["capture"], f["url"], f["payload"], f["revisit_of"], strict=True):
                raw = record(None if page_id is None else int(page_id), url, bytes(payload), None if of is None else int(of))
                out.write(raw)
                at.append(place)
                size.append(len(raw))
                place += len(raw)
            yield f[["key", "capture", "url"]].assign(warc=name, at=at, size=size)
        if out is not None:
            out.close()

    return run


def _write_index(root_uri: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _file_system(root_uri)
        name, idx, at, n, lines, blocks, first, last = f"{root}/part-{uuid.uuid4().hex}.cdx", None, 0, 0, [], [], None, None

        def close() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            idx.write(raw)
            blocks.append((lines[0][0], at, len(raw)))
            at += len(raw)
            lines.clear()

        for f in frames:
            if f.empty:
                continue
            if idx is None:
                idx, first = store.open_output_stream(name, compression=None), f["key"].iloc[0]
            for x in f[["key", "capture", "url", "warc", "at", "size"]].itertuples(index=False):
                lines.append([*x[:4], int(x[4]), int(x[5])])
                last, n = x[0], n + 1
                if len(lines) == BLOCK_LINES:
                    close()
        if idx is None:
            return
        if lines:
            close()
        directory = zlib.compress(json.dumps(blocks).encode())
        idx.write(directory)
        idx.close()
        upper = last if len(last) <= CLIP else last[:CLIP] + chr(0x10FFFF)
        yield pd.DataFrame([(name, at, len(directory), first[:CLIP], upper, n)], columns=[c.split()[0] for c in _PARTS.split(", ")])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write all pages as archives with their index; returns the table of parts, written to the shared folder."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    rows = plan_revisits(pages, least).select("key", "capture", "url", "payload", "revisit_of")
    lines = materialize(rows.mapInPandas(_write_records(folder), _LINES), "captures")
    by_key = lines.repartitionByRange(min(MAX_PARTS, bucket_count(lines, PART_LINES)), "key", "capture").sortWithinPartitions("key", "capture")
    return materialize(by_key.mapInPandas(_write_index(folder), _PARTS), "parts")


def _range(f, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


class _Part:
    """One index file: its directory, and the block read last."""

    def __init__(self, store, row: dict) -> None:
        self.idx = store.open_input_file(row["idx"])
        self.blocks = json.loads(zlib.decompress(_range(self.idx, row["at"], row["size"])))
        self.firsts = [b[0] for b in self.blocks]
        self.held: tuple[int, list[list], list[str]] = (-1, [], [])

    def block(self, k: int) -> tuple[list[list], list[str]]:
        if self.held[0] != k:
            _, at, size = self.blocks[k]
            lines = [json.loads(x) for x in zlib.decompress(_range(self.idx, at, size)).decode().split("\n")]
            self.held = k, lines, [x[0] for x in lines]
        return self.held[1:]

    def find(self, key: str) -> Iterator[list]:
        """Lists of lines of the key."""
        k = max(0, bisect_left(self.firsts, key) - 1)  # the block before the first that begins with key may end with it
        while k < len(self.blocks) and self.firsts[k] <= key:
            lines, keys = self.block(k)
            yield lines[bisect_left(keys, key) : bisect_right(keys, key)]
            k += 1

    def close(self) -> None:
        self.idx.close()


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in _ROWS.split(", ")]
    out = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in names})
    return out.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})


_FOUND = "url string, warc string, at bigint, size bigint"


def _lines_frame(lines: list[list]) -> pd.DataFrame:
    return pd.DataFrame([x[2:] for x in lines], columns=["url", "warc", "at", "size"])


def scan_index(parts: DataFrame, folder: str | None = None) -> DataFrame:
    """The lines of all captures, blocks in order."""
    root = folder or shared_dir(parts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _file_system(root)
        for f in frames:
            for row in f.to_dict("records"):
                part = _Part(store, row)
                for k in range(len(part.blocks)):
                    yield _lines_frame(part.block(k)[0])
                part.close()

    return parts.repartition(bucket_count(parts, 1), "idx").mapInPandas(run, _FOUND)


def locate(parts: DataFrame, keys: DataFrame, folder: str | None = None) -> DataFrame:
    """The lines of the captures with the given keys (column key, distinct), by binary search at both levels."""
    spark = parts.sparkSession
    root = folder or shared_dir(spark)
    rows = sorted((r["last"], r["first"], r["idx"], r["at"], r["size"]) for r in parts.collect())  # at most MAX_PARTS
    table = spark.sparkContext.broadcast(rows)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lasts = [r[0] for r in table.value]
        for f in frames:
            out = []
            for key in f["key"]:
                k = bisect_left(lasts, key)
                while k < len(lasts) and table.value[k][1] <= key:
                    out.append((k, key))
                    k += 1
            yield pd.DataFrame(out, columns=["part", "key"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _file_system(root)
        part, number = None, -1
        for f in frames:
            found: list[list] = []
            for k, key in zip(f["part"], f["key"], strict=True):
                if k != number:
                    if part is not None:
                        part.close()
                    number, row = k, table.value[k]
                    part = _Part(store, {"idx": row[2], "at": row[3], "size": row[4]})
                for lines in part.find(key):
                    found += lines
                    if len(found) >= 5000:
                        yield _lines_frame(found)
                        found = []
            yield _lines_frame(found)
        if part is not None:
            part.close()

    asked = keys.mapInPandas(place, "part int, key string").repartition(max(1, min(len(rows), 1 << 13)), "part").sortWithinPartitions("part", "key")
    return asked.mapInPandas(search, _FOUND)


def fetch(lines: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """The records that lines name, read in the order in which they lie in the archives."""
    root = folder or shared_dir(lines.sparkSession)
    ranges = bucket_count(lines, RANGE_BYTES, F.col("size"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _file_system(root)
        name, f = None, None
        for batch in frames:
            rows = list(batch[["warc", "at", "size", "url"]].itertuples(index=False, name=None))
            k = 0
            while k < len(rows):
                if rows[k][0] != name:
                    if f is not None:
                        f.close()
                    name, f = rows[k][0], store.open_input_file(rows[k][0])
                first, end, z = rows[k][1], rows[k][1] + rows[k][2], k + 1
                while z < len(rows) and rows[z][0] == name and rows[z][1] == end and end - first < READ_BYTES:
                    end += rows[z][2]
                    z += 1
                raw = _range(f, first, end - first)
                found = [parse(raw[at - first : at - first + size]) | {"url": url} for _, at, size, url in rows[k:z]]
                yield _frame(found if payloads else [x | {"payload": None} for x in found])
                k = z
        if f is not None:
            f.close()

    by = F.floor(F.col("at") / RANGE_BYTES)
    return lines.repartition(ranges, "warc", by).sortWithinPartitions("warc", "at").mapInPandas(run, _ROWS)


def read_archives(parts: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """All captures: every index block, then every record."""
    return fetch(materialize(scan_index(parts, folder), "lines"), folder, payloads)


def lookup(parts: DataFrame, urls: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Captures of the given urls (column url), with the columns of read_archives."""
    keys = urls.select(url_key(F.col("url")).alias("key")).distinct()
    return fetch(materialize(locate(parts, keys, folder), "lines"), folder, payloads)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, then looks the url of every page up in the index and reads what was archived for it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return lookup(write_archives(pages), pages, payloads=False).drop("payload", "url")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUARTERS = " || ".join(f"substr('{_B32}', (((('0x' || substr(s, {5 * k + 1}, 5))::INT >> {shift}) & 31) + 1)::INT, 1)" for k in range(8) for shift in (15, 10, 5, 0))
#: The rows of the query from the table alone; the ids of the tables are unique.
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), r AS (SELECT s, max(page_id) AS top FROM p GROUP BY s)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_QUARTERS.replace("substr(s,", "substr(p.s,")} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM p JOIN r ON p.s = r.s
"""
