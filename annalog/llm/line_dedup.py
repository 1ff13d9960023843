"""Line dedup by winnowing over word hashes.

Passages are repeated inside physical lines too, so a *line* is as short as it can be: one
word. What is found then doesn't depend on where lines, sentences or passages begin. A *gram*
is ``GRAM_WORDS`` words on end. The window of a gram holds the grams that begin at most
``SPAN`` words on; the one with the least hash (the last of equals) is a fingerprint. So
two runs alike over GRAM_WORDS + SPAN words have a fingerprint in common, wherever they
stand. Grams are longer than SPAN, so those of successive fingerprints touch, and a
repeated run is covered from its first fingerprint to its last without gaps.

Fingerprints are joined with the first position that holds them, in the order of
doc_id and position; no pairs of later positions are made, and hot fingerprints are
combined before the shuffle. The first position brings hashes of the ``REACH`` words on
either side, by which a match is extended both ways when the text meets it. A run's first
fingerprint begins at most SPAN words into it, and REACH is no less, so a run alike with
that first position is found to its exact ends; at an edge whose fingerprint stands
first in some other passage, up to SPAN words may stay. Words on either side are told
apart by 10 bits. Extents that touch are one run; runs of ``MIN_WORDS`` words or more
are deleted from the later document. The first occurrence stays. Only hashes are
grouped; a text moves once, to meet its deletions.

Null text stays null. Texts without a repeated run stay as they are, byte for byte.
Repeated rows (same doc_id and text) count as one document and all stay. A null
doc_id comes first in the order; texts of one doc_id are ordered by a hash. Very long texts
are processed whole. Extra columns pass through; ``dedup`` puts its own removed_words and
removed_runs in the place of a caller's, ``drop_repeats`` leaves a caller's alone. An empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annalog.llm import bytescan as bs
from annalog.llm.durable import cut

GRAM_WORDS = 16
SPAN = 12
REACH = 12
MIN_WORDS = 24
_BITS = 10
_SIDE = 6  # words of a context in one long
_LONGS = REACH // _SIDE
_CONTEXT = (*(f"before{k}" for k in range(_LONGS)), *(f"after{k}" for k in range(_LONGS)))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, number of words) of each line, and where each document's lines begin."""
    starts, ends, first = bs.words(data, offsets)
    return bs.span_hash(data, starts, ends), starts, np.ones(len(starts), np.int64), first


def grams(h: np.ndarray, n_words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, end line) of each gram."""
    whole = np.flatnonzero(np.arange(len(h)) + GRAM_WORDS <= np.repeat(first[1:], np.diff(first)))
    return whole, whole + GRAM_WORDS


def winnow(g: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the fingerprints among gram hashes; ``at``: words before each gram.

    The window of a gram holds those of its document that begin at most SPAN words on.
    """
    if not len(g):
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    p = at + owner * SPAN  # so that no window reaches the next document
    least = np.full(int(p[-1]) + SPAN + 1, ~np.uint64(0))
    least[p] = (g & ~low) | (low - p.astype(np.uint64))  # of equals the last is the least
    size = 1
    while size <= SPAN:  # windows of twice the size
        step = min(size, SPAN + 1 - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    picked = np.zeros(len(least) + SPAN, dtype=bool)
    picked[(low - (least[p] & low)).astype(np.int64)] = True
    return np.flatnonzero(picked[p])


def _short(h: np.ndarray) -> np.ndarray:
    """_BITS bits of a word's hash, never 0."""
    return np.maximum(h >> np.uint64(64 - _BITS), np.uint64(1))


def _context(short: np.ndarray, places: np.ndarray, step: int, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """REACH words from each place on, _SIDE to a long, the nearest lowest; 0 where there is none."""
    out = [np.zeros(len(places), dtype=np.uint64) for _ in range(0, REACH, _SIDE)]
    for k in range(REACH):
        at = places + step * k
        inside = (at >= lo) & (at < hi)
        out[k // _SIDE] |= np.where(inside, short[np.clip(at, 0, len(short) - 1)], 0).astype(np.uint64) << np.uint64(_BITS * (k % _SIDE))
    return out


def _agree(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many words of two contexts agree, from the nearest on."""
    count, open_ = np.zeros(len(own[0]), np.int64), np.ones(len(own[0]), bool)
    mask = np.uint64((1 << _BITS) - 1)
    for k in range(REACH):
        shift = np.uint64(_BITS * (k % _SIDE))
        a, b = (own[k // _SIDE] >> shift) & mask, (other[k // _SIDE] >> shift) & mask
        open_ &= (a == b) & (a > 0)
        count += open_
    return count


def _fingerprints(batches: Iterator[pa.RecordBatch], context: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in bs.blocks(batch.column("text")):
            h, _, n_words, first = lines(data, offsets)
            begin, stop = grams(h, n_words, first)
            if not len(begin):
                continue
            owner = np.searchsorted(first, begin, "right") - 1
            g = bs.range_hash(h, begin, stop)
            pick = winnow(g, begin, owner)
            begin, stop, owner, g = begin[pick], stop[pick], owner[pick], g[pick]
            mark = batch.column("mark").to_numpy()[lo:hi].astype(np.int64)
            out = {"g": pa.array(g.view(np.int64)), "doc_id": batch.column("doc_id").take(pa.array(lo + owner)), "at": pa.array((mark[owner] << 32) | (begin - first[owner]))}
            if context:
                short = _short(h)
                sides = _context(short, begin - 1, -1, first[owner], first[owner + 1]) + _context(short, stop, 1, first[owner], first[owner + 1])
                out |= {name: pa.array(x.view(np.int64)) for name, x in zip(_CONTEXT, sides, strict=True)}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mark``, 31 bits of the text's hash, which tells rows of one doc_id apart."""
    return docs.withColumn("mark", F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))


def fingerprints(docs: DataFrame, context: bool = True) -> DataFrame:
    """(g, doc_id, at) of each fingerprint, and the words around; at: mark, then number of the first line."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"g long, doc_id {kind}, at long" + "".join(f", {c} long" for c in _CONTEXT if context)
    return _marked(docs.select("doc_id", "text")).mapInArrow(lambda batches: _fingerprints(batches, context), schema)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line, and the words around the first position): fingerprints found earlier."""
    first = fingerprints(docs).groupBy("g").agg(F.min(F.struct("doc_id", "at", *_CONTEXT)).alias("f"), F.count("*").alias("n")).where("n > 1")
    # a written table: the join then has a shuffle on either side, which adaptive execution can split where g is hot
    first = cut(first, "firsts").select(F.col("g").alias("g0"), F.col("f.doc_id").alias("d0"), F.col("f.at").alias("at0"), *[F.col(f"f.{c}") for c in _CONTEXT])
    later = fingerprints(docs, context=False).join(first, F.col("g") == F.col("g0")).where(~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("at") == F.col("at0"))))
    return later.select("doc_id", F.shiftright("at", 32).cast("int").alias("mark"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("line"), *_CONTEXT)


def repeated(h: np.ndarray, first: np.ndarray, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, end line) of the runs to delete; ``found``: the matches of each document."""
    doc = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    rows = found.flatten()
    begin = first[doc] + rows.field("line").to_numpy().astype(np.int64)
    whole = begin + GRAM_WORDS <= first[doc + 1]
    doc, begin = doc[whole], begin[whole]
    theirs = [rows.field(c).to_numpy().view(np.uint64)[whole] for c in _CONTEXT]
    short, lo, hi, stop = _short(h), first[doc], first[doc + 1], begin + GRAM_WORDS
    gone = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(gone, begin - _agree(_context(short, begin - 1, -1, lo, hi), theirs[:_LONGS]), 1)
    np.add.at(gone, stop + _agree(_context(short, stop, 1, lo, hi), theirs[_LONGS:]), -1)
    a, b = bs.spans(np.cumsum(gone[:-1]) > 0, first)
    long = b - a >= MIN_WORDS
    return a[long], b[long]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, found = batch.column("text"), batch.column("found")
        rows = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        some = found.take(pa.array(rows))
        fresh, removed, runs = {}, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, offsets in bs.blocks(text.take(pa.array(rows))):
            h, starts, _, first = lines(data, offsets)
            if not len(h):
                continue
            a, b = repeated(h, first, some.slice(lo, hi - lo))
            raw, owner = data.tobytes(), np.searchsorted(first, a, "right") - 1
            for k in np.unique(owner).tolist():
                r, at, kept, own = int(rows[lo + k]), int(offsets[k]), [], owner == k
                for x, y in zip(a[own].tolist(), b[own].tolist(), strict=True):
                    kept.append(raw[at : int(starts[x]) if x > first[k] else int(offsets[k])])
                    at = int(starts[y]) if y < first[k + 1] else int(offsets[k + 1])
                fresh[r] = b"".join([*kept, raw[at : offsets[k + 1]]]).decode()
                removed[r], runs[r] = int((b - a)[own].sum()), int(own.sum())
        if fresh:
            mask = np.zeros(batch.num_rows, dtype=bool)
            mask[list(fresh)] = True
            text = pc.replace_with_mask(text, pa.array(mask), pa.array([fresh[r] for r in sorted(fresh)], type=text.type))
        named = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": text}
        names = [n for n in batch.schema.names if n != "found"]
        yield pa.RecordBatch.from_arrays([*(named[n] for n in names), pa.array(removed), pa.array(runs)], names=[*names, "removed_words", "removed_runs"])


def _cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text without repeated runs, rest: the other columns, removed_words, removed_runs) of each row."""
    found = matches(docs).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("line", *_CONTEXT)).alias("found"))  # a set: repeated rows have the same
    found = found.select(F.col("doc_id").alias("f_doc"), F.col("mark").alias("f_mark"), "found")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = _marked(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("rest")))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("mark") == F.col("f_mark")), "left").drop("mark", "f_doc", "f_mark")
    schema = StructType([f for f in met.schema.fields if f.name != "found"]).add("removed_words", "long").add("removed_runs", "long")
    return met.mapInArrow(_apply, schema)


def _given(columns: list[str]) -> list[Column]:
    return [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in columns]


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and removed_words and removed_runs."""
    return _cleaned(docs).select(*_given([c for c in docs.columns if c not in ("removed_words", "removed_runs")]), "removed_words", "removed_runs")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs deleted, ``n_chars`` (if there) as of the new text, without documents left without words."""
    out = _cleaned(docs)
    changed = F.col("removed_runs") > 0
    kept = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = _given(docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns[docs.columns.index("n_chars")] = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("rest.n_chars")).alias("n_chars")
    return kept.select(*columns)
