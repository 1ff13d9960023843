"""Near-duplicates by SimHash, checked by exact Jaccard similarity of word shingles.

A document is the set of its ``SHINGLE``-word shingles (all its words, if they are fewer).
Two are linked if their sets have a Jaccard similarity of ``SIMILARITY`` or more, and a
class is what links connect. A set's fingerprint has ``PIECES`` words of 64 bits, each a SimHash:
a bit is set if over half of the shingles' hashes, mixed anew for each word, have it set. One word
can't find such pairs: at 0.8 two lie about 10 bits apart, where most of the space is
within reach of every anchor. So each word only visits the anchors of ``simhash`` nearest to it.

Candidates meet at an anchor of any word, one of them at its home, and differ in at most ``BITS``
bits of the first ``CHECKED`` words. Of 16,500 pairs of random sets of 4 to 500 shingles at just 0.8
all but 2 are candidates; more similar pairs are missed less. Only distinct sets are
compared. Each anchor first reports candidates that connect what it connects. Where
exact checks leave those in several classes, a second pass checks all their candidates of different
classes. So a class of true copies costs little more than its length, and only
unlike members of one anchor cost their square. Every candidate is either compared by its whole
sets or connected already. Different sets of fewer than ``LEAST`` shingles can't be alike.

Lower-casing touches A-Z only. Texts without words are alike. Very long texts are compared whole. A row with a null
``doc_id`` takes no part in linking; its component is null. Repeated rows share a component.
Extra columns play no part; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.llm import bytescan as bs
from annalog.llm import simhash
from annalog.llm.components import stars
from annalog.llm.durable import cut

SHINGLE = 5
SIMILARITY = 0.8
LEAST = 4
#: Sets of fewer shingles have uneven bits, so they visit all anchors within ``REACH`` of the nearest.
SMALL, REACH = 6, 2
PIECES = 32
CHECKED = 3
BITS = 54
DIMENSION = 6
#: Members of an anchor from which on classes are first gathered around pivots, and how many.
CROWD, PIVOTS = 512, 16

_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, PIECES, dtype=np.uint64)


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a block in order, and where each one's begin."""
    starts, ends, first = bs.words(data, offsets)
    n_words = np.diff(first)
    count = np.where(n_words > 0, np.maximum(n_words - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(count)), count)
    begin = first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    h = bs.range_hash(bs.span_hash(bs.lower(data), starts, ends), begin, np.minimum(begin + SHINGLE, first[owner + 1]))
    order = np.lexsort((h, owner))
    h = h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.searchsorted(owner[fresh], np.arange(len(count) + 1))


def _keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = bs.mix(np.add.reduceat(bs.mix(h), first[some]) + np.diff(first)[some].astype(np.uint64))
    return out


def prints_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(document, piece) SimHash words; those of documents without words are zero."""
    out = np.zeros((len(first) - 1, PIECES), dtype=np.uint64)
    n = np.diff(first)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # sums of up to 255 bits fit a byte: eight are added at once
    parts = -(-n[some] // 255)
    of = np.cumsum(parts) - parts
    begin = np.repeat(first[some] - 255 * of, parts) + 255 * np.arange(parts.sum())
    for k, seed in enumerate(_SEEDS):
        bits = np.unpackbits(bs.mix(h ^ seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits.view(np.uint64), begin, axis=0).view(np.uint8)
        ones = np.add.reduceat(sums, of, axis=0, dtype=np.int64)
        made = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little")
        out[some, k] = np.ascontiguousarray(made).view(np.uint64)[:, 0]
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in bs.blocks(batch.column("text")):
            h, first = sets_of(data, offsets)
            raw, size = prints_of(h, first).tobytes(), 8 * PIECES
            prints = [raw[i : i + size] for i in range(0, len(raw), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("mark").slice(lo, hi - lo), pa.array(_keys(h, first).view(np.int64)), pa.array(np.diff(first).astype(np.int64)), pa.array(prints, type=pa.binary())],
                names=["doc_id", "mark", "k", "n", "prints"],
            )


#: A visit to an anchor: set, the bits to check, the right half's anchor, whether this is the set's home; in the second pass its class so far.
_VISIT = [("k", "<i8"), ("fp", "<u8", CHECKED), ("right", "u1"), ("home", "?")]
_AGAIN = [*_VISIT, ("root", "<i8")]


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Visits packed by slot, which is a piece and the left half's anchor."""
    words = simhash.code(DIMENSION)
    for batch in batches:
        kind = np.dtype(_AGAIN if "root" in batch.schema.names else _VISIT)
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            prints = np.frombuffer(b"".join(part.column("prints").to_pylist()), dtype=np.uint64).reshape(-1, PIECES)
            small = part.column("n").to_numpy() < SMALL
            slots, packed = [], []
            for reach, some in ((0, np.flatnonzero(~small)), (REACH, np.flatnonzero(small))):
                for piece in range(PIECES if len(some) else 0):
                    home, _, who, anchor = simhash.visits(prints[some, piece], words, reach)
                    left = anchor // len(words)
                    order = np.argsort(left, kind="stable")
                    edge = np.searchsorted(left[order], np.arange(len(words) + 1))
                    who, anchor = who[order], anchor[order]
                    made = np.empty(len(who), dtype=kind)
                    made["fp"], made["right"], made["home"] = prints[some[who], :CHECKED], anchor % len(words), home[who] == anchor
                    for c in kind.names:
                        if c in part.schema.names:
                            made[c] = part.column(c).to_numpy()[some[who]]
                    for i in np.flatnonzero(np.diff(edge)):
                        slots.append(piece * len(words) + i)
                        packed.append(made[edge[i] : edge[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(slots, np.int32)), pa.array(packed, type=pa.binary())], names=["slot", "visits"])


def _within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints at most ``BITS`` bits apart."""
    found = [(np.zeros(0, np.int64),) * 2]
    step = max(1, (1 << 20) // max(1, len(b)))
    for lo in range(0, len(a), step):
        d = sum(np.bitwise_count(a[lo : lo + step, None, c] ^ b[None, :, c]) for c in range(CHECKED))
        x, y = np.nonzero(d <= BITS)
        found.append((x + lo, y))
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    return x, y


def _across(rows: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (u < v) of candidates with different labels at one anchor; none inside a large class is looked at."""
    names, of, size = np.unique(label, return_inverse=True, return_counts=True)
    large = np.flatnonzero(size > CROWD // 2)
    found = []
    for own, others in [(of == c, of != c) for c in large] + [(~np.isin(of, large), np.ones(len(rows), bool))]:
        a, b = np.flatnonzero(own & rows["home"]), np.flatnonzero(others)
        x, y = _within(rows["fp"][a], rows["fp"][b])
        found.append((a[x], b[y]))
    u, v = (np.concatenate(c) for c in zip(*found, strict=True))
    differ = of[u] != of[v]
    return np.minimum(u, v)[differ], np.maximum(u, v)[differ]


def _spanning(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect all candidates of one anchor; each member's least candidate is among them."""
    label, found = np.arange(len(rows)), []
    if len(rows) > CROWD:
        free = np.arange(len(rows))
        for _ in range(PIVOTS):
            if not len(free):
                break
            near = _within(rows["fp"][free[:1]], rows["fp"][free])[1]  # itself too
            label[free[near]] = free[0]
            found.append((np.full(len(near) - 1, free[0]), free[near[1:]]))
            free = np.delete(free, near)
    found.append(_across(rows, label))
    u, v = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(u):
        return u, v
    order = np.lexsort((u, v))
    u, v = u[order], v[order]
    least = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    alone = np.arange(len(rows))
    label, part = simhash.merged(alone.copy(), u, v), simhash.merged(alone.copy(), u[least], v[least])
    tied = np.flatnonzero((part == alone) & (label != alone))  # what least candidates leave apart
    return np.concatenate([u[least], label[tied]]), np.concatenate([v[least], tied])


def _anchors(table: pa.Table, kind: list, pairs_of: Callable) -> pa.Table:
    """(u, v): what ``pairs_of`` finds among the visits of each anchor of a slot."""
    rows = np.frombuffer(b"".join(table["visits"].to_pylist()), dtype=kind)
    rows = rows[np.lexsort((rows["k"], rows["right"]))]
    edge = np.searchsorted(rows["right"], np.arange(257))
    found = [(np.zeros(0, np.int64),) * 2]
    for i in np.flatnonzero(np.diff(edge) > 1):
        some = rows[edge[i] : edge[i + 1]]
        u, v = pairs_of(some)
        if len(u):
            found.append((some["k"][u], some["k"][v]))
    u, v = (np.concatenate(c) for c in zip(*found, strict=True))
    both = np.unique(np.stack([u, v]), axis=1)
    return pa.table({"u": both[0], "v": both[1]})


def _first_pass(key: tuple, table: pa.Table) -> pa.Table:
    return _anchors(table, _VISIT, _spanning)


def _second_pass(key: tuple, table: pa.Table) -> pa.Table:
    return _anchors(table, _AGAIN, lambda rows: _across(rows, rows["root"]))


def candidates(prints: DataFrame) -> DataFrame:
    """(u, v), u below v: pairs of keys of ``prints`` (k, n, prints) that meet at an anchor and are near.

    With a column root, all of different roots; without, as many as connect all.
    """
    compare = _second_pass if "root" in prints.columns else _first_pass
    return prints.mapInArrow(_send, "slot int, visits binary").groupBy("slot").applyInArrow(compare, "u long, v long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in bs.blocks(batch.column("text")):
            h, first = sets_of(data, offsets)
            key, raw = _keys(h, first).view(np.int64), h.tobytes()
            right = np.flatnonzero(key == batch.column("k").to_numpy()[lo:hi])  # other rows of that id have other texts
            made = [raw[8 * first[i] : 8 * first[i + 1]] for i in right.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(key[right]), pa.array(made, type=pa.binary())], names=["k", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            a, b = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = both >= SIMILARITY * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep))], names=["u", "v"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` that are similar enough, by their whole sets."""
    x, y = (sets.select(F.col("k").alias(f"k_{c}"), F.col("shingles").alias(c)) for c in ("x", "y"))
    met = pairs.join(x, F.col("u") == F.col("k_x")).join(y, F.col("v") == F.col("k_y"))
    return met.select("u", "v", "x", "y").mapInArrow(_alike, "u long, v long")


def linked(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(u, v): each linked key of ``distinct`` (k, least, n, prints) but the least of its class, with that one."""
    able = distinct.where(F.col("n") >= LEAST).select("k", "n", "prints")
    tried = cut(candidates(able), "pairs")
    nodes = cut(tried.select(F.col("u").alias("k")).union(tried.select("v")).distinct(), "nodes")
    wanted = distinct.join(nodes, "k").select("k", F.col("least").alias("id"))
    sets = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id")).select("text", "k").mapInArrow(_sets, "k long, shingles binary")
    sets = cut(sets.dropDuplicates(["k"]), "sets")
    star = stars(cut(_compared(tried, sets), "near"))
    # classes of what the first pass connects and the check doesn't
    named = nodes.join(star.select(F.col("u").alias("k"), F.col("v").alias("root")), "k", "left").withColumn("root", F.coalesce("root", "k"))
    group = stars(tried).select(F.col("u").alias("k"), F.col("v").alias("around"))
    named = cut(named.join(group, "k", "left").withColumn("around", F.coalesce("around", "k")), "named")
    parted = named.groupBy("around").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("around")
    again = cut(able.join(named.join(parted, "around", "left_semi").select("k", "root"), "k"), "again")
    if again.isEmpty():
        return star
    rest = cut(candidates(again).join(tried, ["u", "v"], "left_anti"), "pairs")
    return stars(star.unionByName(_compared(rest, sets)))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, root, component_id) for each row of ``docs``: a hash of the text, the class and its least doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    printed = cut(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_sketch, f"doc_id {kind}, mark long, k long, n long, prints binary"), "sketches")
    distinct = cut(printed.where("doc_id is not null").groupBy("k").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prints").alias("prints")), "distinct")
    star = linked(docs, distinct).select(F.col("u").alias("k"), F.col("v").alias("root"))
    every = distinct.select("k", "least").join(star, "k", "left").withColumn("root", F.coalesce("root", "k"))
    best = every.groupBy("root").agg(F.min("least").alias("component_id"))
    named = every.join(best, "root").select("k", "root", "component_id")
    return printed.select("doc_id", "mark", "k").join(named, "k", "left").select("doc_id", "mark", "root", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least doc_id.

    Of repeated rows with that id and text one stays. Rows with a null id all stay.
    """
    return simhash.keep_least(docs, classes(docs))
