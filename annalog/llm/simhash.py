"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits, each set if over half of its word shingles'
XXH64 values (seed 42) have it set. Fingerprints within ``THRESHOLD`` bits are linked, and
a class is what links connect.

Anchors are a covering code: pairs of words of a Reed-Muller code of length 32 (first
order, with quadratic terms added one at a time as the corpus grows), one for each
half of a fingerprint. Every fingerprint x has a nearest anchor at some distance r(x), at
most the covering radius; that is its *home*. If x and y are linked and r(x) <= r(y),
then y lies within r(x) + THRESHOLD of x's home, so y *visits* every anchor within
r(y) + THRESHOLD, never more than the covering radius plus the threshold, and meets x
there. Each anchor compares its residents with its visitors in numpy, and reports
a spanning forest of the links found, not the pairs.

Only distinct fingerprints are compared, so exact copies cost nothing. An anchor whose
residents or visitors exceed ``TILE`` is cut into tiles, every resident tile against every
visitor tile, so that no task holds a hot anchor. Counts by anchor on the driver are
bounded by the size of the code.

Lower-casing touches A-Z only. Null or empty text, and text without words, has
fingerprint zero, linked like any other. Very long texts are hashed whole, in parts. A bit
set in exactly half the shingles is not set. A row with a null ``doc_id`` takes no part in
linking; its component is null. Repeated rows share a component; rows of one doc_id with
other texts may be in several. Extra columns play no part; an empty table gives no row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.llm import bytescan as bs
from annalog.llm.components import stars
from annalog.llm.durable import cut

SHINGLE = 4
SEED = 42
THRESHOLD = 4
TILE = 1 << 15
PART = 1 << 16
#: Dimension of the code of each half, by the number of distinct fingerprints.
DIMENSIONS = ((4_000_000, 6), (32_000_000, 7), (256_000_000, 8), (1 << 62, 9))


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each document of a block."""
    starts, ends, first = bs.words(data, offsets)
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    n_words = np.diff(first)
    some = np.flatnonzero(n_words)
    if not len(some):
        return out
    text, at = bs.spaced(data, starts, ends)
    stop = at + (ends - starts)
    count = np.maximum(n_words[some] - shingle + 1, 1)
    begin = np.repeat(first[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = begin + np.repeat(np.minimum(n_words[some], shingle) - 1, count)
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    ones = np.zeros((len(some), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(some)), count)
    for lo in range(0, len(begin), PART):  # a long text in parts
        a, b, of = at[begin[lo : lo + PART]].tolist(), stop[last[lo : lo + PART]].tolist(), owner[lo : lo + PART]
        h = np.array([digest(raw[x:y], SEED) for x, y in zip(a, b, strict=True)], dtype=np.uint64)
        # bit k of byte j, in little-endian order, is bit 8 * j + k
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    made = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little")
    out[some] = np.ascontiguousarray(made).view(np.uint64)[:, 0]
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp) for each row of ``docs``; fp is the fingerprint's bits as a signed long, mark a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprints_of(data, offsets) for _, _, data, offsets in bs.blocks(batch.column("text"))]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(np.concatenate(made).view(np.int64))], names=["doc_id", "mark", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, fp long")


def code(dimension: int) -> np.ndarray:
    """All words of the length-32 code: 1, five coordinates, then products of two of them."""
    x = np.arange(32)
    coordinate = [(x >> i) & 1 for i in range(5)]
    rows = [np.ones(32, dtype=int), *coordinate, *(a * b for a, b in itertools.combinations(coordinate, 2))]
    words = np.zeros(1, dtype=np.uint32)
    for row in rows[:dimension]:
        words = np.concatenate([words, words ^ np.uint32(int((row << x).sum()))])
    return words


def visits(fps: np.ndarray, words: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(home, r) of each fingerprint, and (fingerprint index, anchor) of each visit."""
    left, right = (fps >> np.uint64(32)).astype(np.uint32), fps.astype(np.uint32)
    d = [np.bitwise_count(half[:, None] ^ words[None, :]) for half in (left, right)]
    near = [x.argmin(axis=1) for x in d]
    r = [x.min(axis=1) for x in d]
    home = near[0].astype(np.int64) * len(words) + near[1]
    radius = r[0].astype(np.int64) + r[1]
    # in the left half at most the whole threshold over r, then the rest on the right
    row, a = np.nonzero(d[0] <= (r[0] + threshold)[:, None])
    spare = (radius + threshold)[row] - d[0][row, a]
    inner, b = np.nonzero(d[1][row] <= spare[:, None])
    return home, radius, row[inner], a[inner] * len(words) + b


def merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``label``, each node's root, once the links (u, v) are added; the array given may be overwritten."""
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:  # to the roots
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def forest(residents: np.ndarray, r_home: np.ndarray, visitors: np.ndarray, r_visit: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what residents and visitors of one anchor are connected to."""
    nodes, index = np.unique(np.concatenate([residents, visitors]), return_inverse=True)
    at_home, visiting = index[: len(residents)], index[len(residents) :]
    label = np.arange(len(nodes))
    order = np.argsort(r_visit, kind="stable")
    visitors, visiting, r_visit = visitors[order], visiting[order], r_visit[order]
    for radius in np.unique(r_home):
        here = np.flatnonzero(r_home == radius)
        lo = int(np.searchsorted(r_visit, radius))  # visitors at least as far from their homes
        step = max(1, (1 << 22) // max(1, len(visitors) - lo))
        for k in range(0, len(here), step):
            some = here[k : k + step]
            x, y = np.nonzero(np.bitwise_count(residents[some][:, None] ^ visitors[None, lo:]) <= threshold)
            u, v = at_home[some[x]], visiting[lo + y]
            keep = u != v
            u, v = u[keep], v[keep]
            label = merged(label, u, v)
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def _emit(anchor: np.ndarray, tile: np.ndarray, kind: int, fps: np.ndarray, r: np.ndarray) -> pa.RecordBatch | None:
    """A row for each (anchor, tile): its fingerprints and radii as bytes."""
    if not len(fps):
        return None
    order = np.lexsort((tile, anchor))
    anchor, tile, fps, r = anchor[order], tile[order], fps[order], r[order]
    edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])]))
    pack = lambda x, size: pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(np.append(edge, len(x)).astype(np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor[edge]), pa.array(tile[edge]), pa.array(np.full(len(edge), kind, np.int32)), pack(fps, 8), pack(r.astype(np.uint8), 1)],
        names=["anchor", "tile", "kind", "fps", "radii"],
    )


def link(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): links between fingerprints of ``distinct`` (fp; a written table, read twice) that
    connect all that are within ``threshold`` bits, directly or by others."""
    spark = distinct.sparkSession
    n = distinct.count()
    dimension = next(d for most, d in DIMENSIONS if n <= most)
    chunk = 2048

    def meet(batch: pa.RecordBatch, words: np.ndarray) -> Iterator[tuple]:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for lo in range(0, len(fps), chunk):
            part = fps[lo : lo + chunk]
            yield part, *visits(part, words, threshold)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = code(dimension)
        total = np.zeros((2, len(words) ** 2), dtype=np.int64)
        for batch in batches:
            for _, home, _, _, anchor in meet(batch, words):
                total[0] += np.bincount(home, minlength=total.shape[1])
                total[1] += np.bincount(anchor, minlength=total.shape[1])
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["anchor", "residents", "visitors"])

    # rows only for anchors over a tile: at most one a code word
    counts = distinct.mapInArrow(tally, "anchor long, residents long, visitors long").groupBy("anchor").agg(F.sum("residents").alias("residents"), F.sum("visitors").alias("visitors"))
    large = {r["anchor"]: (-(-r["residents"] // TILE), -(-r["visitors"] // TILE)) for r in counts.where((F.col("residents") > TILE) | (F.col("visitors") > TILE)).collect()}
    cut_up = spark.sparkContext.broadcast({k: (max(1, a), max(1, b)) for k, (a, b) in large.items()})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tiles = code(dimension), cut_up.value
        hot = np.array(sorted(tiles), dtype=np.int64)
        for batch in batches:
            held: tuple[list, list] = ([], [])
            for part, home, radius, who, anchor in meet(batch, words):
                held[0].append((home, part, radius))
                held[1].append((anchor, part[who], radius[who]))
            for kind in (0, 1):
                if not held[kind]:
                    continue
                anchor, fps, r = (np.concatenate(x) for x in zip(*held[kind], strict=True))
                tile = np.zeros(len(fps), dtype=np.int64)
                rows = [(anchor, tile, fps, r)]
                if len(hot):
                    is_hot = np.isin(anchor, hot)
                    rows = [(anchor[~is_hot], tile[~is_hot], fps[~is_hot], r[~is_hot])]
                    for a in np.unique(anchor[is_hot]):
                        own, (nr, nv) = anchor == a, tiles[int(a)]
                        mine = (bs.mix(fps[own]) % np.uint64(nr if kind == 0 else nv)).astype(np.int64)
                        for other in range(nv if kind == 0 else nr):  # meets every tile of the other kind
                            t = mine * nv + other if kind == 0 else other * nv + mine
                            rows.append((anchor[own], t, fps[own], r[own]))
                for x in rows:
                    if (made := _emit(x[0], x[1], kind, x[2], x[3])) is not None:
                        yield made

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        sides = []
        for kind in (0, 1):
            rows = table.filter(pc.equal(table["kind"], kind))
            sides.append(np.frombuffer(b"".join(rows["fps"].to_pylist()), dtype=np.uint64))
            sides.append(np.frombuffer(b"".join(rows["radii"].to_pylist()), dtype=np.uint8))
        u, v = forest(*sides, threshold) if len(sides[0]) and len(sides[2]) else (np.zeros(0, np.uint64),) * 2
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    sent = distinct.mapInArrow(send, "anchor long, tile long, kind int, fps binary, radii binary")
    return sent.groupBy("anchor", "tile").applyInArrow(compare, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) for each row of ``docs``.

    root names the class, component_id is its least doc_id: classes may share one where rows of one id differ.
    """
    printed = cut(fingerprint(docs), "fingerprints")
    least = cut(printed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    star = stars(link(least.select("fp")))
    # only linked fingerprints take part; the others are their own class
    linked = least.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(best, "root").select("fp", "root", "component_id")
    return printed.join(named, "fp", "left").select("doc_id", "mark", "fp", "root", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_of(fp: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their classes in ``found`` (doc_id, mark, root, component_id), and those without an id.

    A class is stood for by its least doc_id, of several texts under that id by the one of the least hash.
    """
    stay = found.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("s"))
    stay = stay.select(F.col("s.doc_id").alias("_stay"), F.col("s.mark").alias("_mark")).distinct()
    rows = docs.where("doc_id is not null")
    key = F.xxhash64(rows["text"])
    with_id = rows.join(stay, (F.col("doc_id") == F.col("_stay")) & (key == F.col("_mark")), "left_semi")
    return with_id.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least doc_id.

    Of repeated rows with that id and text one stays. Rows with a null id all stay.
    """
    return keep_least(docs, classes(docs))
