"""WARC archives and their globally ordered capture index.

Writing: record heads are built by SQL functions; each record becomes a gzip member of its
own, so that a place in an archive can be read by itself. Spark's text writer writes the
members as they are, with an empty gzip member as the line separator; so archives reach
any store that Spark can write, committed task by task. An archive ends once it has
``ARCHIVE_BYTES``. Of captures with equal payloads of ``MIN_REVISIT`` bytes or more, the
one with the smallest id is a ``response`` and the others are ``revisit`` records without
a block. A response's block is a short HTTP head and the payload.

Reading: each archive is inflated member by member and parsed by ``Content-Length``,
whatever bytes a payload holds, and gives a *run*: its index entries sorted by URL key,
timestamp, id and place. Runs are written to the shared folder, cut into ranges of the whole
key of some ``RANGE_ROWS`` rows, and in every range the k runs meet in a loser tree. So
a task holds one range of the index, however many captures there are; ranges are in order,
and the index is as a whole. A capture's rank is its place in that order. The key ends with
archive and place, so one URL with a third of all captures is cut as well.

Null html is an empty payload, null url an empty URL. A null id is archived as ``none``:
it is never what others refer to, and revisits the smallest id with its payload, if there
is one. Repeated ids each give a record; of equal payloads under the smallest id all are
responses. Ties of URL key, time and id are in the order of archives. A very long page
is one record, held by one task at a time. Extra columns play no part. An empty table gives
an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from annalog.llm.durable import cut, new_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
RANGE_ROWS = 100_000
#: An empty gzip member, as characters of one byte each: it parts records and inflates to nothing.
SEPARATOR = gzip.compress(b"", 9, mtime=0).decode("latin-1")
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "url_key string, captured string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, archive string, place long"
)


def _decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, captured, digest, refers_to`` for each archived row.

    Only (digest, id) pairs are grouped; the html moves once, with its decision.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.col("captured"),
    )
    large = rows.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"))
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    revisits = large.join(groups, "digest").where("page_id is null or page_id > first_id").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first_id").distinct()
    held = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    return held.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select(
        "page_id", "url", "html", "captured", "digest", F.col("first_id").alias("refers_to")
    )


def _named(page_id: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("none")), F.lit(">"))


def _record() -> Column:
    """One record."""
    revisit = F.col("refers_to").isNotNull()
    # a URI can't hold line breaks; a percent sign keeps the escape reversible
    uri = F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _named("page_id"), F.lit("\r\nWARC-Date: "), F.col("captured"),
        F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.lower(F.hex("digest")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _named("refers_to"))).otherwise(F.lit("")),
        F.lit("\r\nPayload-Length: "), length,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return F.concat(head, block, F.lit(END))


def _members(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member, with the number of its archive of ``most`` bytes in this task."""
    archive = size = 0
    for batch in batches:
        for record in batch.column("value"):  # one at a time: pages may be long
            member = gzip.compress(record.as_buffer(), 6, mtime=0)
            if size and size + len(member) > most:
                archive, size = archive + 1, 0
            size += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([member], pa.binary()), pa.array([archive], pa.int32())], names=["member", "archive"])


def write(pages: DataFrame, path: str) -> None:
    """Archive ``pages`` (page_id, url, html, captured: ISO-8601 text) under ``path``."""
    members = _decided(pages).select(_record().cast("binary").alias("value")).mapInArrow(lambda batches, most=ARCHIVE_BYTES: _members(batches, most), "member binary, archive int")
    out = members.select(F.col("member").cast("string").alias("value"), "archive").write.partitionBy("archive")
    out.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, record) of each gzip member that isn't empty."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate, parts, place = zlib.decompressobj(31), [], at
        while not inflate.eof:
            chunk = view[at : at + (1 << 20)]
            if not len(chunk):
                raise ValueError(f"the member at byte {place} doesn't end")
            parts.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        if whole := b"".join(parts):
            yield place, whole


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    stop = record.find(b"\r\n\r\n")
    lines = record[: max(stop, 0)].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    end = stop + 4 + int(headers["Content-Length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where it says")
    return headers, record[stop + 4 : end]


def payload(block: bytes) -> bytes:
    """What follows the HTTP head of a response's block."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def url_key(url: str) -> str:
    """The sort key of a URL: host labels reversed, port kept unless usual, sorted query."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    labels = ",".join(reversed(host.split(".")))
    port_text = f":{port}" if port and port not in (80, 443) else ""
    query = "&".join(f"{k}={v}" if v else k for k, v in sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{labels}{port_text}){parts.path.rstrip('/') or '/'}" + (f"?{query}" if query else "")


def _id(field: str) -> int | None:
    name = field.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def _order(url_key: str, captured: str, page_id: int | None, archive: str, place: int) -> tuple:
    """A capture's place in the order; no id comes first."""
    return url_key, captured, -1 if page_id is None else 0, page_id or 0, archive, place


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            archive = "/".join(batch["path"][i].as_py().rsplit("/", 2)[1:])
            rows = []
            for place, record in members(batch["content"][i].as_buffer()):
                h, block = parse(record)
                response = h["WARC-Type"] == "response"
                body = payload(block) if response else b""
                uri = h["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                rows.append({
                    "url_key": url_key(uri), "captured": h["WARC-Date"], "page_id": _id(h["WARC-Record-ID"]), "url": uri,
                    "record_type": h["WARC-Type"], "refers_to": None if response else _id(h["WARC-Refers-To"]),
                    "payload_bytes": len(body) if response else int(h["Payload-Length"]),
                    "payload_digest": hashlib.sha256(body).hexdigest() if response else h["WARC-Payload-Digest"].removeprefix("sha256:"),
                    "archive": archive, "place": place,
                })
            rows.sort(key=lambda r: _order(r["url_key"], r["captured"], r["page_id"], r["archive"], r["place"]))
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[lo : lo + 10_000], schema=_SCHEMA)


_SCHEMA = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("place", pa.int64()),
])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of every archive under ``path``; each archive's are in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_index, INDEX)


class LoserTree:
    """Merge of k sorted iterators: one comparison a level for each item taken."""

    def __init__(self, runs: list[Iterator], key) -> None:
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] <= y[:2])

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, run after run, as one ordered sequence; with the range and the place in it."""
    parts = [b for b in batches if b.num_rows]  # RANGE_ROWS or so
    if not parts:
        return
    whole = pa.Table.from_batches(parts).combine_chunks()
    keys = list(map(_order, *(whole[c].to_pylist() for c in ("url_key", "captured", "page_id", "archive", "place"))))
    run = whole["archive"].to_pylist()
    edges = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
    order = list(LoserTree([iter(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)], lambda i: keys[i]))
    here = TaskContext.get().partitionId()
    for lo in range(0, len(order), 10_000):
        some = whole.take(pa.array(order[lo : lo + 10_000]))
        some = some.append_column("range", pa.array([here] * some.num_rows, pa.int32())).append_column("at", pa.array(range(lo, lo + some.num_rows), pa.int64()))
        yield from some.combine_chunks().to_batches()


def merge_runs(runs: DataFrame) -> DataFrame:
    """``runs`` as one index in the order of URL key, timestamp and id, with ``rank`` from 1.

    ``runs`` is read twice (once to find the ranges), so it should be a written table.
    """
    key = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_first(), F.col("archive"), F.col("place")]
    n = max(1, -(-runs.count() // RANGE_ROWS), min(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs.count() // 1000))
    ranged = runs.repartitionByRange(n, *key).sortWithinPartitions("archive", *key[:3], "place")
    kind = StructType([*runs.schema.fields, StructField("range", IntegerType()), StructField("at", LongType())])
    merged = cut(ranged.mapInArrow(_merge, kind), "index")
    starts, total = [], 1
    for r in merged.groupBy("range").count().orderBy("range").collect():  # a row a range
        starts.append((r["range"], total))
        total += r["count"]
    first = runs.sparkSession.createDataFrame(starts, "r int, start long")
    return merged.join(F.broadcast(first), F.col("range") == F.col("r")).select(*runs.columns, (F.col("start") + F.col("at")).alias("rank"))


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path)
    return merge_runs(cut(read_runs(spark, path), "runs"))
