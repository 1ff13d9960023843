"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's place in its source's permutation is a 62-bit hash of its id. Cutting
the hash range into equal *blocks* gives disjoint permuted blocks. A source's target is
met by whole passes over it and one more pass over part of it: whole blocks in
permuted order, then a prefix of the block where the quota runs out, then single
documents of that block that fill what is left most closely. Every choice is a
hash bound or one of a few listed hashes, so documents need no join to learn it.

The blocks drawn from all sources are dealt to output shards by a binary tree: each
node holds a count of blocks by source and gives its left half a multivariate-
hypergeometric share. Every shard so has its exact quota of blocks from each source,
and inside a shard rows are put in hash order: a local shuffle.

The driver holds one row for each source and the tree: ``MAX_SOURCES`` rows at most, or
``plan`` refuses. Blocks are sums of at most ``BLOCKS`` rows a source. The block in which a
quota runs out is cut into blocks again until it has ``REGION_MOST`` documents or fewer,
or is one place, so what is chosen one by one is bounded whatever the size of a source.

Null text has size 0, and null ``source`` is a source of its own, last in order. Null
ids share one place; repeated rows, and others in one place, are taken or left together.
Documents of size 0 are never taken. Texts of any length count whole. Of equal sizes
that fill a rest, the first in permuted order is taken. An empty table gives an empty
mix. Extra columns pass through ``mix``; of a caller's own ``mix_shard`` and ``mix_copy``
those of the mix take the place.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.llm.durable import cut

BITS = 8
BLOCKS = 1 << BITS
SPACE_BITS = 62
MAX_SOURCES = 10_000
SHARDS = 16
EXTRAS = 48
PIECE_WORDS = 250_000
#: The region in which a draw ends: blocks about its end with so many documents, if there are.
REGION = (32, 256)
TRIES = 16
#: Documents in the block about a draw's end beyond which it is cut into blocks again.
REGION_MOST = 4096


def size_of(text: str = "text") -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(seed: int = 0, doc_id: str = "doc_id") -> Column:
    """A document's place in the permutation, in [0, 2**62)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 64 - SPACE_BITS)


def block_of(place: Column) -> Column:
    return F.shiftright(place, SPACE_BITS - BITS)


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """``total`` shared by weight; none above ``most`` times its size, the excess shared again."""
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free and left > 0:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def split_tree(counts: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """(shard, source) numbers of blocks: shards as even as can be, each source's sum exact."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    stack = [(0, shards, np.array(counts, dtype=np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have * 0
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


@dataclass(frozen=True)
class SourcePlan:
    """What is drawn from one source. A document is taken ``passes`` times, and once more
    if its place is below ``bound`` or listed in ``extra``."""

    source: str | None
    size: int
    target: float
    passes: int
    bound: int
    extra: tuple[int, ...]


def _fill(quota: int, rows: pd.DataFrame) -> tuple[int, list[int]]:
    """(bound of the places taken as a prefix, further places) of a region for ``quota`` words.

    Of the prefixes that end near the quota, the one that single documents of the rest
    fill up most closely.
    """
    rows = rows.sort_values("place")
    place, size = rows["place"].to_numpy(), rows["size"].to_numpy()
    total = np.concatenate([[0], np.cumsum(size)])
    longest = int(np.searchsorted(total, quota, "right")) - 1
    best: tuple[int, int, list[int]] | None = None
    for n in range(longest, max(-1, longest - TRIES), -1):
        left = quota - int(total[n])
        order = np.argsort(size[n:], kind="stable") + n
        ordered = size[order]
        chosen: list[int] = []
        hi = len(ordered)
        while left > 0 and len(chosen) < EXTRAS:  # largest that fits, again and again
            hi = min(hi, int(np.searchsorted(ordered, left, "right")))
            if hi == 0 or ordered[hi - 1] == 0:
                break
            hi -= 1
            chosen.append(int(order[hi]))
            left -= int(ordered[hi])
        unused = np.setdiff1d(np.flatnonzero(size > 0), [*range(n), *chosen])
        if left > 0 and len(unused):
            least = int(unused[np.argmin(size[unused])])
            if int(size[least]) - left < left:  # one more overshoots by less than it lacks
                chosen.append(least)
                left -= int(size[least])
        if best is None or abs(left) < best[0]:
            best = abs(left), n, chosen
        if left == 0:
            break
    _, n, chosen = best or (0, 0, [])
    return (int(place[n - 1]) + 1 if n else 0), [int(place[i]) for i in chosen]


def plan(sized: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0) -> list[SourcePlan]:
    """The draw from each source of ``sized`` (source, size, place); a written table, read twice."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"]) for r in totals]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    names = [r["source"] for r in totals]
    passes = [int(a // s) if s else 0 for a, s in zip(aims, sizes, strict=True)]
    quota = {n: round(a - p * s) for n, a, p, s in zip(names, aims, passes, sizes, strict=True)}

    spark = sized.sparkSession
    kind = "q_source string, quota long, low long, shift int"
    state = [(n, int(q), 0, SPACE_BITS - BITS) for n, q in quota.items()]
    filled: dict = {}

    def edge(rows: pd.DataFrame) -> pd.DataFrame:  # at most BLOCKS rows
        rows = rows.sort_values("block")
        total, q, docs, shift = rows["size"].cumsum().to_numpy(), int(rows["quota"].iloc[0]), rows["n"].to_numpy(), int(rows["shift"].iloc[0])
        end = min(int((total <= q).sum()), len(rows) - 1)
        block, low = rows["block"].to_numpy(), int(rows["low"].iloc[0])
        lo = hi = end
        again = bool(docs[end] > REGION_MOST and shift > 0)
        if not again:
            while lo > 0 and docs[lo:end].sum() < REGION[0]:
                lo -= 1
            while hi < len(rows) - 1 and docs[end : hi + 1].sum() < REGION[1]:
                hi += 1
        left = q - (int(total[lo - 1]) if lo else 0)
        return pd.DataFrame({"source": [rows["source"].iloc[0]], "quota": [left], "low": [low + (int(block[lo]) << shift)], "high": [low + (int(block[hi]) + 1 << shift)], "shift": [shift], "again": [again]})

    def fill(rows: pd.DataFrame) -> pd.DataFrame:  # a few blocks, a row for each place
        bound, extra = _fill(int(rows["quota"].iloc[0]), rows)
        return pd.DataFrame({"source": [rows["source"].iloc[0]], "bound": [bound], "extra": [extra]})

    while state:  # a round for each cut: some log of a source's size
        wanted = spark.createDataFrame(state, kind)
        met = sized.join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("q_source")))
        block = F.expr("shiftright(place - low, shift)")
        blocks = met.where((F.col("place") >= F.col("low")) & (block < BLOCKS)).groupBy("source", "quota", "low", "shift", block.alias("block"))
        at = blocks.agg(F.sum("size").alias("size"), F.count("*").alias("n")).groupBy("source").applyInPandas(edge, "source string, quota long, low long, high long, shift int, again boolean")
        at = cut(at, "mix-edges")  # a row for each source
        rows = at.collect()
        done = at.where("not again").select(F.col("source").alias("a_source"), "quota", "low", "high")
        inside = sized.join(F.broadcast(done), F.col("source").eqNullSafe(F.col("a_source")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
        places = inside.groupBy("source", "quota", "place").agg(F.sum("size").alias("size"))
        found = {r["source"]: r for r in places.groupBy("source").applyInPandas(fill, "source string, bound long, extra array<long>").collect()}
        filled |= {r["source"]: (max(r["low"], found[r["source"]]["bound"]), tuple(found[r["source"]]["extra"])) for r in rows if r["source"] in found}
        state = [(r["source"], r["quota"], r["low"], max(0, r["shift"] - BITS)) for r in rows if r["again"]]
    return [SourcePlan(n, s, a, p, *filled.get(n, (0, ()))) for n, s, a, p in zip(names, sizes, aims, passes, strict=True)]


def _plan_frame(docs: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    rows = [(p.source, p.size, p.target, p.passes, p.bound, list(p.extra)) for p in plans]
    return docs.sparkSession.createDataFrame(rows, "p_source string, source_size long, target double, passes int, bound long, extra array<long>")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, place) of each row: the small table the plan is made from."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of().alias("size"), place_of(seed).alias("place"))


def copies(rows: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """``rows`` (source, size, place) with source_size, target and copies: 0, 1 or 2."""
    once_more = (F.col("place") < F.col("bound")) | F.array_contains("extra", F.col("place"))
    joined = rows.join(F.broadcast(_plan_frame(rows, plans)), F.col("source").cast("string").eqNullSafe(F.col("p_source")), "left")  # MAX_SOURCES rows at most
    count = F.when(F.col("size") > 0, F.col("passes") + once_more.cast("int")).otherwise(0)
    return joined.withColumn("copies", count).drop("p_source", "passes", "bound", "extra")


def shard_table(plans: list[SourcePlan], shards: int, seed: int = 0) -> np.ndarray:
    """(source, pass, block) to shard, for every block that a pass draws from."""
    width_bits = SPACE_BITS - BITS
    out = np.zeros((len(plans), 3, BLOCKS), dtype=np.int32)
    last = [max([p.bound - 1, *p.extra]) for p in plans]
    drawn = [[BLOCKS] * p.passes + [(x >> width_bits) + 1 if x >= 0 else 0] for p, x in zip(plans, last, strict=True)]
    dealt = split_tree([sum(d) for d in drawn], shards, seed)
    for i, d in enumerate(drawn):
        rng = np.random.Generator(np.random.PCG64([seed, zlib.crc32((plans[i].source or "").encode()), i]))
        flat = rng.permutation(np.repeat(np.arange(shards), dealt[:, i]))
        at = 0
        for k, n in enumerate(d):
            out[i, k, :n] = flat[at : at + n]
            out[i, k, n:] = flat[at + n - 1] if n else i % shards
            at += n
    return out


def dealt(rows: DataFrame, plans: list[SourcePlan], shards: int, seed: int = 0) -> DataFrame:
    """``copies`` of ``rows`` with ``shards``: the shard of each copy, by the splitting tree."""
    where = shard_table(plans, shards, seed)
    flat = rows.sparkSession.createDataFrame([(p.source, [int(x) for x in where[i].reshape(-1)]) for i, p in enumerate(plans)], "s_source string, table array<int>")
    joined = copies(rows, plans).join(F.broadcast(flat), F.col("source").cast("string").eqNullSafe(F.col("s_source")), "left")  # 3 * BLOCKS numbers a source
    block = block_of(F.col("place")).cast("int")
    each = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.get("table", k * BLOCKS + block))
    return joined.withColumn("shards", each).drop("s_source", "table")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 0, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with ``mix_shard`` and ``mix_copy``, a row for each copy taken.

    Partitions are shards or parts of them; inside one, rows are in permuted order.
    """
    plans = plan(cut(sized(docs, seed), "mix-sizes"), **options)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = inner.select("row", F.col("row.source").alias("source"), F.col("row.text").alias("text"), F.col("row.doc_id").alias("doc_id"))
    rows = rows.select("row", "source", size_of().alias("size"), place_of(seed).alias("place"))
    each = dealt(rows, plans, shards, seed).select("row", "place", F.posexplode("shards").alias("mix_copy", "mix_shard"))
    order = F.xxhash64(F.lit(seed + 1), "place", "mix_copy")
    sent = each.select("row", "mix_shard", "mix_copy", order.alias("mix_order"))
    # a shard is dealt in pieces of PIECE_WORDS or so: neither it nor its source is one task
    pieces = max(1, round(sum(p.target for p in plans) / shards / PIECE_WORDS))
    out = sent.repartition("mix_shard", F.pmod("mix_order", F.lit(pieces))).sortWithinPartitions("mix_shard", "mix_order")
    names = [c for c in docs.columns if c not in ("mix_shard", "mix_copy")]
    return out.select(*[F.col(f"row.`{c}`") for c in names], "mix_shard", "mix_copy")


def taken(docs: DataFrame, shards: int = SHARDS, seed: int = 0, **options) -> DataFrame:
    """Each document's part in the mix: doc_id, size, source_size, target, taken, shards (one for each copy), source and block.

    What is taken is what the tree dealt to shards.
    """
    rows = cut(sized(docs, seed), "mix-sizes")
    each = dealt(rows, plan(rows, **options), shards, seed)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards", "source", block_of(F.col("place")).cast("int").alias("block"))
