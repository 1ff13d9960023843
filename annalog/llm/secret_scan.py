"""Secret scans over an incremental ledger of blobs.

Every text version is a blob, addressed by the SHA-256 of its UTF-8 bytes. A ledger
holds one row for each blob and rule version that has been scanned, findings or
none. A scan takes one carrier document of each blob that the ledger lacks under
the present rule version, scans it, appends to the ledger, and joins the ledger's
findings back to every document (path) that carries the blob.

Only hashes and ids are grouped; a text moves once, in the join that picks the
carriers, and a blob with any number of copies is scanned once; where a carrier's row is
itself repeated, once in each task that meets it. Spans are counted in code points, end
exclusive.

Null text is the empty blob. A null ``doc_id`` is kept as it is. Repeated rows each
get the findings of their blob. Very long texts are scanned whole. Extra columns
play no part. Equal spans of different kinds are all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.llm import bytescan as bs
from annalog.llm.durable import cut

RULE_VERSION = "1"
FINDINGS = "array<struct<kind:string,start:long,stop:long>>"
LEDGER = f"blob binary, rule_version string, findings {FINDINGS}"

#: Order of kinds that start at one place; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "github", "google", "slack", "url_login")
BASE = KINDS[:3]

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: kind, a literal that any match holds, pattern
_MORE = (
    ("private_key", b"-----BEGIN ", re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("jwt", b"eyJ", re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("github", b"gh", re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("google", b"AIza", re.compile(rb"AIza[A-Za-z0-9_-]{35}")),
    ("slack", b"xox", re.compile(rb"xox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("url_login", b"://", re.compile(rb"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@")),
)
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True


def find(text: bytes, hex_runs: list[tuple[int, int]] = ()) -> list[tuple[str, int, int]]:
    """(kind, start, stop) in bytes, in order; ``hex_runs``: maximal runs of 24+ hex digits."""
    found = [("hex", a, b) for a, b in hex_runs]
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for kind, literal, pattern in _MORE:
        if literal in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _code_points(text: bytes, found: list[tuple[str, int, int]]) -> list[dict]:
    """Byte places as counts of code points, one pass over the text."""
    places = sorted({p for _, a, b in found for p in (a, b)})
    at, last, count = {}, 0, 0
    for p in places:
        count += len(text[last:p].decode("utf-8", "replace"))
        at[p], last = count, p
    return [{"kind": k, "start": at[a], "stop": at[b]} for k, a, b in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    last = None
    for batch in batches:
        # repeated rows stand together: the join has sorted them
        blobs = batch.column("blob").to_pylist()
        fresh = [i for i, b in enumerate(blobs) if b != (blobs[i - 1] if i else last)]
        last = blobs[-1] if blobs else last
        batch, out = batch.take(pa.array(fresh, pa.int64())), []
        for _, _, data, offsets in bs.blocks(batch.column("text")):
            starts, ends = bs.spans(_HEX[data], offsets)
            long = ends - starts >= 24
            runs: dict[int, list[tuple[int, int]]] = {}
            for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                d = int(np.searchsorted(offsets, a, "right")) - 1
                runs.setdefault(d, []).append((a - int(offsets[d]), b - int(offsets[d])))
            raw = data.tobytes()
            for d in range(len(offsets) - 1):
                text = raw[offsets[d] : offsets[d + 1]]
                found = find(text, runs.get(d, ()))
                out.append(_code_points(text, found) if found else [])
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(out, type=kind)], names=["blob", "findings"])


def _addressed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def update(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of ``docs`` that ``ledger`` lacks under this version."""
    blobs = _addressed(docs)
    # the row of a carrier: by its id among rows with an id, else any one row; ids are unique but for repeated rows
    carriers = blobs.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("c"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        carriers = carriers.join(known, "blob", "left_anti")
    carriers = carriers.select(F.col("c.doc_id").alias("carrier"), F.col("blob").alias("wanted"))
    unseen = blobs.join(carriers, F.col("doc_id").eqNullSafe(F.col("carrier")) & (F.col("blob") == F.col("wanted")), "left_semi")
    scanned = unseen.select("blob", "text").mapInArrow(_scan, f"blob binary, findings {FINDINGS}")
    once = scanned.groupBy("blob").agg(F.first("findings").alias("findings"))
    return once.select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, findings) for each row of ``docs``, and the new ledger rows.

    Append the second frame to the ledger table; pass that table as ``ledger`` next time.
    """
    added = cut(update(docs, ledger, rule_version), "ledger")
    known = added if ledger is None else added.unionByName(ledger.where(F.col("rule_version") == rule_version).select(*added.columns).dropDuplicates(["blob"]))
    # blobs without findings need no join partner: few rows meet the paths
    hits = known.where(F.size("findings") > 0).select("blob", "findings")
    paths = _addressed(docs).select("doc_id", "blob").join(hits, "blob", "left")
    return paths.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS))), added


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the joined spans of each row of ``scan``."""
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )

