"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

A word is reached by a path of choices: first its class, then groups of words inside the
class (a Huffman tree, so common words are near), at last the word itself. Each choice is
a softmax over at most ``WAYS`` outcomes, and P(word | context) is the product of those
on its path, so every factor, the word's own among them, depends on the context:

    logit(outcome | node, context) = log prior + sum over features of weight[hash(feature, node), outcome]

The features are the previous word, the one before it (a skip), and the pair of both (an
n-gram). Classes join two things: the commonest words are clustered by their
neighbours in all training texts, the other head words by their written form. Words
beyond the ``HEAD`` commonest are a class a form, in which a word has its share of the
counts, add-one smoothed, with one outcome a form for words never seen. At weight zero the
model is the smoothed unigram model; all probabilities of a context sum to one.

Training is distributed: texts are dealt to groups by a hash, each group takes minibatch
gradient steps from the present weights, and rows of weights are averaged over groups by
how often each met the row, so a row that one group alone met keeps all it learned. Groups
go in ``ROUNDS`` rounds or more; each training text is used in one of them. How many
groups there are, and in which order a group reads its texts, follows from the number of
training tokens and from the texts, not from the session: scores don't depend on cores
or partitions. A group has ``GROUP_FLOATS`` training tokens for each weight, so what
is sent is in proportion to the input, and less.

What is counted covers all training documents. Counts of words travel as (hash, count)
and grow with the corpus; rarer words meet their counts in a join of (document, word) rows,
combined by document before and after. Weights grow with the corpus, a row for each
``TOKENS_A_ROW`` training tokens, up to 2 ** ``MOST_BITS`` rows, which is what an executor
holds; beyond that features share rows. On the driver and in broadcasts are only the head
words, the weights and the tree.

Words are lower-cased A-Z and parted by spaces; each text ends in one end token. Null
text is empty: the end alone. Very long texts are read whole, in blocks of their own.
Repeated rows count as often as they stand. Words of equal count are ordered by their hash.
A null doc_id is scored like any other row and is part of the held-out share. Extra columns
play no part. With no training text every word is unknown and scores are those of a
uniform choice of form; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalog.llm import bytescan as bs
from annalog.llm.durable import cut

HEAD = 1 << 17
CLUSTERED = 4096
WAYS = 16
CLUSTERS = 16
FORMS = 8
TOKENS_A_ROW = 512
LEAST_BITS, MOST_BITS = 16, 20
ROUNDS = 2
GROUP_FLOATS = 1
LEAST_GROUP = 1 << 20
ROUND_GROUPS = 1024
PARTS = 128
BATCH, CHUNK = 512, 4096
RATE = 0.4
SETTLE = 1.0

END = np.uint64(0x1F3D5B79A2C4E681)
_START = np.uint64(0x0123456789ABCDEF)
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[0x61:0x7B] = True


@dataclass
class Tokens:
    """Tokens of a block: hash, written form, and where each document's begin (its end token is last)."""

    h: np.ndarray
    form: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data = bs.lower(data)
    starts, ends, first = bs.words(data, offsets)
    n = len(offsets) - 1
    where = first + np.arange(n + 1)  # one end token a document
    h = np.empty(len(starts) + n, dtype=np.uint64)
    form = np.zeros(len(h), dtype=np.int8)
    inside = np.ones(len(h), dtype=bool)
    inside[where[1:] - 1] = False
    h[~inside] = END
    h[inside] = bs.span_hash(data, starts, ends)
    if len(starts):
        high = np.concatenate([[0], np.cumsum(data >= 0x80)])
        form[inside] = (high[ends] > high[starts]) + 2 * ~(_ALPHA[data[ends - 1]] | (data[ends - 1] >= 0x80)) + 4 * (ends - starts > 7)
    return Tokens(h, form, where)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, Tokens]]:
    for batch in batches:
        for lo, hi, data, offsets in bs.blocks(batch.column("text")):
            yield batch, lo, hi, tokens(data, offsets)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, form, n): how often each token stands in ``docs``; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def combined() -> tuple:
            h, form, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, form[at], np.bincount(inverse, weights=n).astype(np.int64)

        def out(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["h", "form", "n"])

        size = 0
        for _, _, _, t in _blocks(batches):
            u, at, n = np.unique(t.h, return_index=True, return_counts=True)
            held.append((u, t.form[at], n))
            size += len(u)
            if size > 1 << 20:  # combine, and send on what stays large
                held = [combined()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(combined())

    counted = docs.select("text").mapInArrow(run, "h long, form int, n long")
    return cut(counted.groupBy("h").agg(F.max("form").alias("form"), F.sum("n").alias("n")), "words")


@dataclass
class Tree:
    """Paths of choices: leaf i has nodes[at[i]:at[i + 1]] and outcomes there; log priors by (node, outcome)."""

    at: np.ndarray
    nodes: np.ndarray
    outcomes: np.ndarray
    prior: np.ndarray


def huffman(mass: np.ndarray, ways: int = WAYS) -> list[list[tuple[int, int]]]:
    """The path, from the top, of (inner node, outcome) of each leaf; node 0 is the top."""
    n = len(mass)
    if n == 1:
        return [[]]
    up: dict[int, tuple[int, int]] = {}
    heap = [(float(m), i) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    made = n
    take = (n - 2) % (ways - 1) + 2  # so that all later nodes are full
    while len(heap) > 1:
        some = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
        for k, (_, i) in enumerate(some):
            up[i] = made, k
        heapq.heappush(heap, (sum(m for m, _ in some), made))
        made, take = made + 1, ways
    top = made - 1
    out = []
    for i in range(n):
        path = []
        while i != top:
            i, k = up[i]
            path.append((top - i, k))  # the last node made is the top
        out.append(path[::-1])
    return out


def tree(classes: np.ndarray, mass: np.ndarray, tail: np.ndarray) -> Tree:
    """Paths of head words (by ``classes``: a cluster, or CLUSTERS + form; ``mass``) and then of the tail's forms."""
    n = len(classes)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(n + FORMS)]
    members = [own for c in range(CLUSTERS + FORMS) if len(own := np.flatnonzero(classes == c))]
    above = huffman(np.concatenate([[mass[own].sum() for own in members], tail]))
    made = 1 + max(v for path in above for v, _ in path)
    for own, to_class in zip(members, above, strict=False):
        inner = huffman(mass[own])
        for i, path in zip(own.tolist(), inner, strict=True):
            paths[i] = to_class + [(made + v, k) for v, k in path]
        made += 1 + max((v for path in inner for v, _ in path), default=-1)
    for f in range(FORMS):
        paths[n + f] = above[len(members) + f]
    at = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    flat = np.array([x for p in paths for x in p], dtype=np.int32).reshape(-1, 2)
    each = np.repeat(np.concatenate([mass, tail]), np.diff(at))
    total = np.bincount(flat[:, 0].astype(np.int64) * WAYS + flat[:, 1], weights=each, minlength=made * WAYS).reshape(made, WAYS)
    with np.errstate(divide="ignore"):
        prior = np.log(total) - np.log(np.maximum(total.sum(axis=1, keepdims=True), 1e-300))
    return Tree(at, flat[:, 0].copy(), flat[:, 1].copy(), np.maximum(prior, -50).astype(np.float32))


@dataclass
class Model:
    """Head words with their counts, the tree of choices, the tail's mass by form, and the weights."""

    head: np.ndarray  # hashes in order
    head_count: np.ndarray
    total: float  # N
    distinct: float  # V
    tree: Tree
    tail: np.ndarray  # sum of (count + 1) over a form's rarer words, with one for unknown words
    weights: np.ndarray  # row, outcome

    def __post_init__(self) -> None:
        # where the hashes with each leading 20 bits begin: a look-up touches a few of them
        self.begin = np.searchsorted(self.head >> np.uint64(44), np.arange((1 << 20) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.begin).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each token among head words, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.head):
            return out
        at = self.begin[(h >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        left, place = np.arange(len(h)), np.minimum(at, len(self.head) - 1)
        for _ in range(self.deepest):
            same = self.head[place] == h
            out[left[same]] = place[same]
            go_on = ~same & (self.head[place] < h)
            left, place, h = left[go_on], np.minimum(place[go_on] + 1, len(self.head) - 1), h[go_on]
            if not len(left):
                break
        return out


@dataclass
class Choices:
    """The choices on the paths of a block's tokens, in order: token, node, outcome and weight rows."""

    token: np.ndarray
    node: np.ndarray
    outcome: np.ndarray
    rows: np.ndarray  # (feature, choice)


def features(t: Tokens) -> np.ndarray:
    """(feature, token) hashes of the previous word, the skipped-to word and the pair."""
    previous = np.empty_like(t.h)
    before = np.empty_like(t.h)
    previous[1:], before[2:] = t.h[:-1], t.h[:-2]
    heads = t.first[:-1]
    previous[heads] = _START
    before[heads] = _START
    second = heads + 1
    before[second[second < t.first[1:]]] = _START
    return np.stack([bs.mix(previous), bs.mix(before + np.uint64(1)), bs.mix(previous * np.uint64(3) + before)])


def choices(m: Model, t: Tokens, at: np.ndarray) -> Choices:
    """``at``: ``m.find`` of the tokens."""
    leaf = np.where(at >= 0, at, len(m.head) + t.form.astype(np.int64))
    n = (m.tree.at[1:] - m.tree.at[:-1])[leaf]
    token = np.repeat(np.arange(len(leaf)), n)
    place = np.repeat(m.tree.at[leaf], n) + np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    node = m.tree.nodes[place]
    salt = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - (len(m.weights).bit_length() - 1))
    rows = np.stack([(((f[token] ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int32) for f in features(t)])
    return Choices(token, node, m.tree.outcomes[place], rows)


def logits(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of each choice, kept in a range where exp() is safe."""
    z = weights.take(rows[0], 0, mode="clip")  # rows are in range: this only spares a check and a copy
    z += weights.take(rows[1], 0, mode="clip")
    z += weights.take(rows[2], 0, mode="clip")
    z += prior
    return np.clip(z, -60, 60, out=z)


_ONES, _ONE = np.ones(WAYS, np.float32), np.float32(1)


def steps(weights: np.ndarray, met: np.ndarray, prior: np.ndarray, c: Choices, rate: float = RATE) -> None:
    """Gradient steps over the choices, in place; ``met`` counts the steps of each row.

    A row moves the less the oftener it has moved; if a batch meets it several times, the last gradient is the one that counts.
    """
    whole = weights.view(f"V{weights.itemsize * WAYS}")[:, 0]  # a row as one item, which is copied faster
    for lo in range(0, c.rows.shape[1], BATCH):
        r, o = c.rows[:, lo : lo + BATCH], c.outcome[lo : lo + BATCH]
        w = [weights.take(f, 0, mode="clip") for f in r]
        z = w[0] + w[1]
        z += w[2]
        z += prior.take(c.node[lo : lo + BATCH], 0, mode="clip")
        p = np.exp(np.clip(z, -60, 60, out=z), out=z)
        p /= (p @ _ONES)[:, None]
        p.reshape(-1)[np.arange(len(o)) * WAYS + o] -= 1
        for f, own in zip(r, w, strict=True):
            n = met.take(f, mode="clip") + _ONE
            own -= p * (rate / np.sqrt(1 + n / SETTLE)).astype(np.float32)[:, None]
            whole[f], met[f] = own.view(whole.dtype)[:, 0], n


def gains(m: Model, c: Choices, n: int) -> np.ndarray:
    """log10 probability of each of ``n`` tokens by its choices."""
    out = np.zeros(len(c.token))
    for lo in range(0, len(out), CHUNK):
        z = logits(m.weights, m.tree.prior.take(c.node[lo : lo + CHUNK], 0, mode="clip"), c.rows[:, lo : lo + CHUNK])
        out[lo : lo + CHUNK] = z[np.arange(len(z)), c.outcome[lo : lo + CHUNK]] - np.log(np.exp(z) @ _ONES)
    return np.bincount(c.token, weights=out, minlength=n) / np.log(10)


def _neighbours(docs: DataFrame, common: np.ndarray) -> np.ndarray:
    """How often each common word has each of the 64 commonest words just before or after it."""
    context = 64
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(held.value)
        words = held.value[order]
        total, keys, size = np.zeros(len(words) * 2 * context, dtype=np.int64), [], 0
        for _, _, _, t in _blocks(batches):
            at = np.minimum(np.searchsorted(words, t.h), len(words) - 1)
            rank = np.where(words[at] == t.h, order[at], -1)
            same = np.ones(len(rank), dtype=bool)
            same[t.first[:-1]] = False  # the token before is another document's
            a, b = rank[:-1], rank[1:]
            ok = same[1:] & (a >= 0) & (b >= 0)
            a, b = a[ok], b[ok]
            for x, y, shift in ((a, b, 0), (b, a, context)):  # y's neighbour x
                near = x < context
                keys.append(y[near] * (2 * context) + x[near] + shift)
                size += len(keys[-1])
            if size > 1 << 20:
                total += np.bincount(np.concatenate(keys), minlength=len(total))
                keys, size = [], 0
        if size:
            total += np.bincount(np.concatenate(keys), minlength=len(total))
        total = total.reshape(len(words), 2 * context)
        rows, cols = np.nonzero(total)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(total[rows, cols])], names=["w", "c", "n"])

    rows = docs.select("text").mapInArrow(run, "w long, c long, n long").groupBy("w", "c").agg(F.sum("n").alias("n")).toArrow()  # at most CLUSTERED * 128 rows
    out = np.zeros((len(common), 2 * context))
    if rows.num_rows:
        out[rows["w"].to_numpy(), rows["c"].to_numpy()] = rows["n"].to_numpy()
    return out


def cluster(vectors: np.ndarray, mass: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k-means of the rows by direction, weighted by the square root of their mass."""
    x = np.sqrt(vectors)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.maximum(norm, 1e-9)
    rng = np.random.Generator(np.random.PCG64(seed))
    weight = np.sqrt(mass)
    centres = [x[int(np.argmax(weight))]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0) * weight + 1e-12
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
    centres = np.array(centres)
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(25):
        label = (x @ centres.T).argmax(axis=1)
        for j in range(k):
            own = label == j
            if own.any():
                c = (x[own] * weight[own, None]).sum(axis=0)
                centres[j] = c / max(np.linalg.norm(c), 1e-9)
    return label


def _begin(docs: DataFrame, counts: DataFrame) -> Model:
    """The model at weight zero: head words, classes and tree."""
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = float(sums[0] or 0), float(sums[1])
    # HEAD words at most: all that are commoner than a bound, which a histogram gives
    level = F.floor(F.log2("n") * 16).cast("int")
    bound, room = 1 << 30, HEAD
    for b, c in sorted(((r["b"], r["c"]) for r in counts.groupBy(level.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True):
        if c > room:
            break
        bound, room = b, room - c
    top = counts.where(level >= bound).toArrow()
    h, n, form = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["form"].to_numpy()
    by_count = np.lexsort((h, -n))
    h, n, form = h[by_count], n[by_count], form[by_count]
    own = CLUSTERS + form.astype(np.int64)
    common = min(CLUSTERED, len(h))
    if common > CLUSTERS:
        own[:common] = cluster(_neighbours(docs, h[:common]), n[:common], CLUSTERS)
    order = np.argsort(h)
    h, n, form, own = h[order], n[order], form[order], own[order]
    # the tail's mass: all words by their form from the table, less the head
    tail = np.ones(FORMS)
    for r in counts.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # FORMS rows
        tail[r["form"]] += r["n"] + r["v"]
    np.subtract.at(tail, form, n + 1.0)
    bits = min(max(int(total / TOKENS_A_ROW).bit_length(), LEAST_BITS), MOST_BITS)
    return Model(h, n, total, distinct, tree(own, n + 1.0, tail), tail, np.zeros((1 << bits, WAYS), np.float32))


def _apart(spark: SparkSession, column: str, low: int, high: int) -> Column:
    """A key for each of the integers low..high-1 such that they go to as many partitions, one each."""
    n = high - low
    tried = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("x"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("x"))
    keys = dict(tried.collect())
    return F.get(F.array(*[F.lit(keys.get(i, i)).cast("int") for i in range(n)]), F.col(column) - low)


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """A model of the texts of ``docs`` (doc_id, text); ``counts`` is their ``count_words``."""
    spark = docs.sparkSession
    model = _begin(docs, counts)
    groups = max(ROUNDS, round(model.total / max(LEAST_GROUP, GROUP_FLOATS * model.weights.size)))
    rounds = max(ROUNDS, -(-groups // ROUND_GROUPS))
    key = F.xxhash64(F.lit(7), F.col("doc_id").cast("string"), "text")
    dealt = docs.select(F.pmod(key, F.lit(groups)).cast("int").alias("group"), key.alias("key"), "text")
    if rounds > 2 * ROUNDS:  # written once in the order of groups, so that a round reads its own part
        dealt = cut(dealt.repartitionByRange("group").sortWithinPartitions("group"), "groups")
    size = len(model.weights) // PARTS
    for r in range(rounds):
        held = spark.sparkContext.broadcast(model)  # 2 ** MOST_BITS rows at most
        low, high = groups * r // rounds, groups * (r + 1) // rounds

        def run(batches: Iterator[pa.RecordBatch], held=held, rate=RATE / np.sqrt(1 + r)) -> Iterator[pa.RecordBatch]:
            m = held.value
            w, met = np.empty_like(m.weights), np.zeros(len(m.weights), np.float32)

            def sent(group: int) -> Iterator[pa.RecordBatch]:
                for k, (part, times) in enumerate(zip(np.split(w, PARTS), np.split(met, PARTS), strict=True)):
                    rows = np.flatnonzero(times).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([group], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([times[rows].tobytes()], pa.binary()), pa.array([part[rows].tobytes()], pa.binary())],
                        names=["k", "group", "rows", "met", "w"],
                    )

            now = None
            for batch in batches:  # in the order of groups
                of = batch.column("group").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in itertools.pairwise(edges):
                    if a == b:
                        continue
                    if of[a] != now:
                        if now is not None:
                            yield from sent(now)
                        now = int(of[a])
                        w[:], met[:] = m.weights, 0
                    for _, _, data, offsets in bs.blocks(batch.column("text").slice(a, b - a)):
                        t = tokens(data, offsets)
                        steps(w, met, m.tree.prior, choices(m, t, m.find(t.h)), rate)
            if now is not None:
                yield from sent(now)

        def average(rows: pd.DataFrame) -> pd.DataFrame:  # a row a group, 1/PARTS of the weights each
            total, mass = np.zeros((size, WAYS)), np.zeros(size)
            for x in rows.sort_values("group").itertuples():
                at, n = np.frombuffer(x.rows, dtype=np.int32), np.frombuffer(x.met, dtype=np.float32).astype(np.float64)
                total[at] += np.frombuffer(x.w, dtype=np.float32).reshape(-1, WAYS) * n[:, None]
                mass[at] += n
            some = np.flatnonzero(mass).astype(np.int32)
            out = (total[some] / mass[some, None]).astype(np.float32)
            return pd.DataFrame({"k": [int(rows["k"].iloc[0])], "rows": [some.tobytes()], "w": [out.tobytes()]})

        share = dealt.where((F.col("group") >= low) & (F.col("group") < high)).repartition(high - low, _apart(spark, "group", low, high)).sortWithinPartitions("group", "key")
        sent_rows = share.select("group", "text").mapInArrow(run, "k long, group int, rows binary, met binary, w binary")
        made = sent_rows.groupBy("k").applyInPandas(average, "k long, rows binary, w binary").collect()  # the weights, once
        for x in made:
            part = model.weights[x["k"] * size :]
            part[np.frombuffer(bytes(x["rows"]), dtype=np.int32)] = np.frombuffer(bytes(x["w"]), dtype=np.float32).reshape(-1, WAYS)
        held.unpersist()
    return model


def _local(docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, base, model, rare): all but the counts of rare words.

    base and model lack, for every rare word, log10(count + 1); rare lists their hashes.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        log_tail = np.log10(m.tail)
        log_count = np.log10(m.head_count + 1.0)
        for batch, lo, hi, t in _blocks(batches):
            at = m.find(t.h)
            known = at >= 0
            counted = np.where(known, log_count[np.maximum(at, 0)], 0.0) if len(m.head) else np.zeros(len(t.h))
            score = gains(m, choices(m, t, at), len(t.h)) - np.where(known, 0.0, log_tail[t.form])
            rare = np.flatnonzero(~known)
            owner = bs.owners(t.first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(t.first)), pa.array(bs.per_document(known, t.first)),
                    pa.array(bs.per_document(counted, t.first)), pa.array(bs.per_document(score, t.first)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[rare], np.arange(hi - lo + 1)).astype(np.int32)), pa.array(t.h[rare].view(np.int64))),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, model double, rare array<long>")


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learns from rows where ``held_out`` is false.
    """
    learn = docs.where(~F.coalesce(held_out, F.lit(True))).select("doc_id", "text")
    counts = count_words(learn)
    model = train(learn, counts)
    local = cut(_local(docs, model), "scores")
    rare = local.select("row", F.explode("rare").alias("h"))
    met = rare.join(counts.select("h", "n"), "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    unit = F.lit(float(np.log10(model.total + model.distinct + 1)))
    return local.join(met, "row", "left").select(
        "doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * unit).alias("base_score"), (F.col("model") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
