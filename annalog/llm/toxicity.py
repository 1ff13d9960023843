"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (and of itself), hashed
into a fixed number of buckets, so an unseen misspelling shares most of its vector
with the word it comes from. A passage of ``WINDOW`` consecutive words is the mean of
its words, and a two-class linear softmax reads it. A document's score is that of its
most toxic passage, so a long text can't water a short insult down. Vectors and
softmax are trained together, in numpy, by minibatch AdaGrad; each round first picks
every training document's top passage under the present model. One document in
``VALID`` of those to train on is kept out of the steps; the model of the round with the least
loss on them is the one that counts, and training ends when ``PATIENCE`` rounds bring none.

Training takes at most ``MAX_ROWS`` labelled documents of each class and ``MAX_BYTES`` of text
in all, the first ones by a hash of ``doc_id``, in one task; these bounds are what keeps the
task's memory and time bounded. Scoring covers every document and every word, in one pass
without a shuffle.

Null or empty text scores as the bias alone. Very long texts are scored whole, in parts. Null
labels and labels of unknown documents are not used; a document with several labels is toxic
if any says so. Repeated rows of a labelled doc_id count once in training; of several
texts under one doc_id the one of the least hash does. Of equal passages the first is a
document's top one. With no toxic label scores are below 1e-200, with no other label 0.5.
Extra columns play no part: only ``text`` reaches the score. An empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.llm import bytescan as bs

BUCKETS = 1 << 17
DIM = 4
WINDOW = 2
SIZES = (3, 4, 5, 6)
MAX_ROWS = 6000
MAX_BYTES = 48 << 20
PART = 1 << 16
ROUNDS = 8
PATIENCE = 2
VALID = 8
OTHERS = 3


@dataclass
class Model:
    """Bucket vectors, softmax weights (class, dimension) and biases."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def logits(self) -> tuple[np.ndarray, float]:
        """Each bucket's share in the toxic logit, and the bias: the model is linear after averaging."""
        w = self.weights[1] - self.weights[0]
        return (self.vectors @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram, and of every word as a whole; words in text order."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, at = bs.spaced(data, starts, ends)
    lengths = ends - starts
    solid = text != 0x20
    word_at = np.zeros(len(text), dtype=np.int64)
    word_at[at] = 1
    word_at = np.cumsum(word_at) - 1
    table = bs._RANDOM[text]
    owners = [np.arange(len(starts))]
    buckets = [(bs.span_hash(text, at, at + lengths) % np.uint64(BUCKETS)).astype(np.int64)]
    power = np.uint64(1)
    h = np.zeros(len(text), dtype=np.uint64)
    whole = np.ones(len(text), dtype=bool)
    for n in range(1, max(SIZES) + 1):
        m = len(text) - n + 1
        if m <= 0:
            break
        h = h[:m] + table[n - 1 :] * power
        power = np.uint64(int(power) * bs._BASE & (1 << 64) - 1)
        if n >= 3:  # positions 1 .. n-2 lie inside the word
            whole = whole[:m] & solid[n - 2 : n - 2 + m]
        if n in SIZES:
            place = np.flatnonzero(whole)
            owners.append(word_at[place + 1])
            buckets.append((bs.mix(h[place] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def _windows(values: np.ndarray, first: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the ``size`` words from each word on, within its document, and their number."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    end = np.repeat(first[1:], np.diff(first))
    here = np.arange(len(values))
    stop = np.minimum(here + size, end)
    # near a document's end the last full window stands for the shorter ones
    start = np.maximum(np.minimum(here, end - size), np.repeat(first[:-1], np.diff(first)))
    return (total[stop] - total[start]) / (stop - start), start


def _top(means: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest value of each document that has words; others get 0."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(means, first[some])
    return out


def word_logits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Each word's share in the toxic logit: the mean of its subwords'."""
    out = np.zeros(len(starts))
    for lo in range(0, len(starts), PART):  # a long text in parts: n-grams take many bytes for each of its own
        a, b = starts[lo : lo + PART], ends[lo : lo + PART]
        owner, bucket = subwords(data[a[0] : b[-1]], a - a[0], b - a[0])
        out[lo : lo + PART] = np.bincount(owner, weights=share[bucket]) / np.bincount(owner)
    return out


def score_block(data: np.ndarray, offsets: np.ndarray, share: np.ndarray, bias: float) -> np.ndarray:
    starts, ends, first = bs.words(data, offsets)
    means, _ = _windows(word_logits(data, starts, ends, share), first)
    # rounded: sums over a block depend on a text's neighbours in the last digits
    return 1 / (1 + np.exp(-np.clip(np.round(_top(means, first) + bias, 6), -500, 500)))


def fit(texts: list[bytes], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Vectors and softmax from labelled texts."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    weights = np.zeros((2, DIM), dtype=np.float32)
    weights[1, :] = 0.5
    weights[0, :] = -0.5
    bias = np.zeros(2, dtype=np.float32)
    toxic = np.asarray(toxic, dtype=np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros_like(vectors), weights * 0, np.array([0.0, 0.0] if toxic.any() else [500.0, -500.0], dtype=np.float32))

    # Words of all texts by hash; each distinct word once with its buckets.
    # Blocks are small and ids narrow: all this is one task's memory.
    hashes, first, names_of, counts_of, buckets_of = [], [0], [], [], []
    seen = np.zeros(0, np.uint64)
    for _, _, data, offsets in bs.blocks(pa.array(texts, type=pa.large_binary())):
        starts, ends, at = bs.words(data, offsets)
        h = bs.span_hash(bs.lower(data), starts, ends)
        first += (at[1:] + first[-1]).tolist()
        hashes.append(h)
        distinct, where = np.unique(h, return_index=True)
        where = np.sort(where[~np.isin(distinct, seen)])
        owner, bucket = subwords(data, starts[where], ends[where])
        buckets_of.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        counts_of.append(np.bincount(owner, minlength=len(where)))
        names_of.append(h[where])
        seen = np.concatenate([seen, h[where]])
    first = np.array(first)
    h, names, bucket = np.concatenate(hashes), np.concatenate(names_of), np.concatenate(buckets_of)
    row = np.concatenate([[0], np.cumsum(np.concatenate(counts_of))])
    del hashes, names_of, counts_of, buckets_of, seen
    by_name = np.argsort(names)
    token = by_name[np.searchsorted(names[by_name], h)].astype(np.int32)
    document = bs.owners(first).astype(np.int32)
    del h

    # The first passages: where words stand that toxic texts hold oftener than others.
    pairs = np.unique(document.astype(np.int64) * len(names) + token)
    label_of = toxic[pairs // len(names)]
    found = np.bincount(pairs % len(names), minlength=len(names))
    with_toxic = np.bincount(pairs % len(names), weights=label_of, minlength=len(names))
    odds = np.log((with_toxic + 0.5) / (toxic.sum() + 1)) - np.log((found - with_toxic + 0.5) / (len(toxic) - toxic.sum() + 1))
    odds[found < 5] = 0
    means, begin = _windows(odds[token], first)

    valid = np.arange(len(toxic)) % VALID == VALID - 1 if len(toxic) >= 8 * VALID else np.zeros(len(toxic), dtype=bool)
    best_model, least, since = None, np.inf, 0
    gv, gw, gb = np.full((BUCKETS, 1), 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    some = np.flatnonzero(np.diff(first))
    learn = some[~valid[some]]
    balance = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    for r in range(rounds + 1):
        if r:
            share = vectors @ (weights[1] - weights[0])
            logits = np.add.reduceat(share[bucket], row[:-1]) / np.diff(row)
            means, begin = _windows(logits[token], first)
            if valid.any():
                z = _top(means, first)[valid] + (bias[1] - bias[0])
                loss = float((balance[valid] * np.logaddexp(0, np.where(toxic[valid] == 1, -z, z))).mean())
                if loss < least:
                    best_model, least, since = Model(vectors.copy(), weights.copy(), bias.copy()), loss, 0
                else:
                    since += 1
            if r == rounds or since == PATIENCE:
                break
        best = np.repeat(np.maximum.reduceat(means, first[some]), np.diff(first)[some])
        hit = np.flatnonzero((means >= best) & ~valid[document])
        hit = hit[np.unique(document[hit], return_index=True)[1]]
        picked = [begin[hit]]
        # other passages of clean texts are clean as well
        clean = learn[toxic[learn] == 0]
        for _ in range(OTHERS):
            picked.append(begin[(first[clean] + rng.random(len(clean)) * np.diff(first)[clean]).astype(np.int64)])
        starts = np.concatenate(picked)
        starts = starts[rng.permutation(len(starts))]
        for lo in range(0, len(starts), 64):
            s = starts[lo : lo + 64]
            doc = document[s]
            size = np.minimum(WINDOW, first[doc + 1] - s)
            places = np.repeat(s, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            of = np.repeat(np.arange(len(s)), size)
            w = token[places]
            n = row[w + 1] - row[w]
            cells = bucket[np.repeat(row[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            scale = np.repeat(1 / (n * size[of]), n).astype(np.float32)
            of_cell = np.repeat(of, n)
            mean = np.zeros((len(s), DIM), dtype=np.float32)
            edge = np.searchsorted(of_cell, np.arange(len(s)))
            mean[:] = np.add.reduceat(vectors[cells] * scale[:, None], edge)
            z = mean @ weights.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(s)), toxic[doc]] -= 1
            p *= balance[doc][:, None]
            back = (p @ weights)[of_cell] * scale[:, None]
            which, inverse = np.unique(cells, return_inverse=True)
            g = np.stack([np.bincount(inverse, weights=back[:, k]) for k in range(DIM)], axis=1).astype(np.float32)
            gv[which] += (g * g).mean(axis=1, keepdims=True)
            vectors[which] -= 0.3 * g / np.sqrt(gv[which])
            grad = (p.T @ mean).astype(np.float32)
            gw += grad * grad
            weights -= 0.05 * grad / np.sqrt(gw)
            gb += p.sum(axis=0) ** 2
            bias -= (0.1 * p.sum(axis=0) / np.sqrt(gb)).astype(np.float32)
    return best_model or Model(vectors, weights, bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id")
    # at most 2 * max_rows ids: a bounded broadcast
    chosen = [known.where(F.col("toxic") == k).orderBy(key, "doc_id").limit(max_rows) for k in (0, 1)]
    met = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    # a row for each id, however often it is repeated
    one = met.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("m"))
    sizes = sorted(((r["mark"], r["size"], r["key"], r["doc_id"]) for r in one.select("doc_id", "m.mark", "m.size", key.alias("key")).collect()), key=lambda r: (r[2], r[3]))  # 2 * max_rows rows at most
    taken, room = [], max_bytes
    for mark, size, _, doc_id in sizes:
        if size <= room:
            taken.append((doc_id, mark))
            room -= size
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = docs.sparkSession.createDataFrame(taken, f"few_id {kind}, few_mark long")
    sample = met.join(F.broadcast(few), (F.col("doc_id") == F.col("few_id")) & (F.xxhash64("text") == F.col("few_mark")))
    sample = sample.groupBy("doc_id", "few_mark").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(d, t or b"", y) for b in batches for d, t, y in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.large_binary()).to_pylist(), b["toxic"].to_pylist(), strict=True)]
        rows.sort(key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0]))  # so that those kept out are any, not the last
        m = fit([t for _, t, _ in rows], np.array([int(y) for *_, y in rows], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([m.vectors.tobytes()]), pa.array([m.weights.tobytes()]), pa.array([m.bias.tobytes()])], names=["v", "w", "b"])

    made = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).mapInArrow(run, "v binary, w binary, b binary").collect()  # one row of fixed size
    if not made:  # no labelled row, no task
        return fit([], np.zeros(0, dtype=np.int64))
    v, w, b = (np.frombuffer(bytes(x), dtype=np.float32) for x in made[0])
    return Model(v.reshape(BUCKETS, DIM), w.reshape(2, DIM), b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    share, bias = model.logits()
    held = docs.sparkSession.sparkContext.broadcast((share, bias))  # 4 * BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, bias = held.value
        for batch in batches:
            made = [score_block(data, offsets, share, bias) for _, _, data, offsets in bs.blocks(batch.column("text"))]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(made))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
