"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

The benchmark's windows choose the test terms: of every window its rarest and second
rarest word, by their counts over all documents. The index is a written table of
postings, one for each place where a document holds a test term: document, position,
term and the words within reach on either side. A query intersects two offset-adjusted
posting lists, the rarest term's and the second rarest's; where both point at one place
of an item, give or take ``SLOP`` words, that is a proximity match, and where the
words around agree over a whole window it is an exact phrase.

Texts never move: the pass that makes postings also counts words, and only postings of
rare terms and their counts are joined. A test term is found by a bitmap of fixed size
in the plan; a false hit there finds no partner in the join. The benchmark's side of a
join is broadcast while the benchmark has ``BROADCAST_WORDS`` words or fewer; a larger
one is shuffled.

Lower-casing touches A-Z only. Null text has no words; a document without words has no
hits. Items without words match nothing; one with a null id hits words, and is in no list
or count of items. Repeated documents each get a row; repeated items count once. An item
shorter than a window is one window. Words of equal count are ranked by their place in the
item. Very long texts are indexed whole, in one row of postings. Extra columns play no
part. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.llm.durable import cut

WINDOW = 10
SLOP = 3
BROADCAST_WORDS = 500_000
#: Bits of the bitmap of terms, and at most so many times the terms.
BITMAP_BITS, BITMAP_MOST, BITS_A_TERM = 1 << 19, 1 << 22, 16

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: str = "text") -> Column:
    """Words of a text before lower-casing, which changes no word boundary here."""
    return F.coalesce(F.array_remove(F.split(text, _BETWEEN), ""), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    """A word with A-Z in lower case; ``lower`` does that where all of it is ASCII."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words(text: str = "text") -> Column:
    return F.transform(raw_words(text), lowered)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, size) of each different item that has words; ``item`` is a key."""
    rows = benchmark.select("item_id", "text").distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), words().alias("words"))
    return rows.withColumn("size", F.size("words")).where("size > 0")


def _sided(frame: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(frame) if small else frame


def document_counts(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(word, n): how often each word of ``vocabulary`` (word) stands in all documents."""
    tokens = docs.select(F.explode(raw_words()).alias("raw")).select(lowered(F.col("raw")).alias("word"))
    return tokens.join(_sided(vocabulary, small), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def seeds(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, size, p1, w1, p2, w2, before, after) for each choice of test terms.

    p1 is the place of a window's rarest word, p2 of its second rarest; before and after
    are the words on either side of p1, nearest first, null beyond the item's ends.
    """
    each = items.select("item", F.posexplode("words").alias("pos", "word"))
    ranked = each.join(counts, "word", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("ranked"))
    length = F.least(F.lit(window), F.col("size"))
    both = items.join(ranked, "item").select("*", length.alias("length"))
    by_rarity = F.transform(
        F.sequence(F.lit(1), F.col("size") - F.col("length") + 1),
        lambda s: F.sort_array(F.transform(F.slice("ranked", s, F.col("length")), lambda x: F.struct(x["n"], x["pos"]))),
    )
    pairs = both.select("*", F.explode(F.array_distinct(F.transform(by_rarity, lambda w: F.struct(w[0]["pos"].alias("p1"), F.coalesce(F.get(w, 1), w[0])["pos"].alias("p2"))))).alias("p"))
    reach = F.sequence(F.lit(1), F.lit(max(1, window - 1)))
    return pairs.select(
        "item", "item_id", "length", F.col("p.p1").alias("p1"), F.get("words", F.col("p.p1")).alias("w1"),
        F.col("p.p2").alias("p2"), F.get("words", F.col("p.p2")).alias("w2"),
        F.transform(reach, lambda k: F.get("words", F.col("p.p1") - k)).alias("before"),
        F.transform(reach, lambda k: F.get("words", F.col("p.p1") + k)).alias("after"),
    )


def _bitmap(terms: DataFrame, bits: int) -> Column:
    """A literal bitmap of term hashes."""
    place = F.xxhash64("word").bitwiseAND(F.lit(bits - 1))
    rows = terms.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    held = dict(rows.groupBy("at").agg(F.bit_or("bit")).collect())  # at most bits / 64 rows
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(bits // 64))), ",").cast("array<long>")


def index(docs: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, mark, n_words, postings) of each document: a written table; mark: a hash of the text.

    A posting is (pos, word, before, after) for each place of a word of ``terms`` (word).
    """
    bits = min(BITMAP_MOST, max(BITMAP_BITS, 1 << (BITS_A_TERM * terms.count()).bit_length()))
    bitmap = _bitmap(terms, bits)

    def listed(word: Column) -> Column:
        place = F.xxhash64(word).bitwiseAND(F.lit(bits - 1))
        return F.getbit(F.get(bitmap, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    reach = F.sequence(F.lit(1), F.lit(max(1, window - 1)))

    def posting(p: Column) -> Column:
        return F.struct(
            p.alias("pos"), F.get("words", p).alias("word"),
            F.transform(reach, lambda k: F.get("words", p - k)).alias("before"), F.transform(reach, lambda k: F.get("words", p + k)).alias("after"),
        )

    tokens = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("mark"), words().alias("words"))
    found = F.array_compact(F.transform("words", lambda w, i: F.when(listed(w), i)))
    placed = tokens.select("row", "doc_id", "mark", "words", found.alias("places"))
    return cut(placed.select("row", "doc_id", "mark", F.size("words").cast("long").alias("n_words"), F.transform("places", posting).alias("postings")), "postings")


def _agree(a: str, b: str) -> Column:
    """How many words of two lists agree before the first that don't."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """The index, and (row, item_id, start, stop, exact) of each match against it."""
    items = cut(_items(benchmark), "items")
    small = (items.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_WORDS
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    counts = document_counts(docs, vocabulary, small)
    seeded = cut(seeds(items, counts, window), "seeds")
    terms = seeded.select(F.col("w1").alias("word")).union(seeded.select("w2")).distinct()
    table = index(docs, terms, window)

    postings = table.select("row", F.explode("postings").alias("p")).select("row", "p.pos", "p.word", F.col("p.before").alias("left"), F.col("p.after").alias("right"))
    first = postings.join(_sided(seeded, small), F.col("word") == F.col("w1"))
    first = first.select("row", "item", "item_id", "length", "p1", "p2", "pos", (F.col("pos") - F.col("p1")).alias("at"), _agree("left", "before").alias("l"), _agree("right", "after").alias("r"))
    second = postings.select("row", "pos", "word").join(_sided(seeded.select("item", "p1", "p2", "w2"), small), F.col("word") == F.col("w2"))
    second = second.select("row", "item", "p1", "p2", (F.col("pos") - F.col("p2")).alias("near"))
    # the rarest term's list is the short one: it is the one to widen
    widened = first.withColumn("near", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)))
    both = widened.join(second, ["row", "item", "p1", "p2", "near"], "left_semi")
    return table, both.select("row", "item_id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop"), (F.col("l") + F.col("r") + 1 >= F.col("length")).alias("exact"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """For each row of ``docs``: doc_id, mark, n_words, n_hit, item_ids (sorted strings), n_near.

    n_near: items of which some window's two rarest words stand as far apart as in the item, give or take ``slop``.
    """
    table, found = search(docs, benchmark, window, slop)
    found = cut(found.distinct(), "matches")
    hit = found.where("exact").select("row", F.explode(F.sequence("start", "stop")).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    near = found.groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("item_ids"), F.count_distinct("item_id").alias("n_near"))
    return table.select("row", "doc_id", "mark", "n_words").join(near, "row", "left").join(hit, "row", "left").select(
        "row", "doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark.

    Rows of one doc_id and text go together; other texts under that id, or under none, are judged by themselves.
    """
    found = contamination(docs, benchmark).where("n_hit > 0")
    bad = found.select(F.col("doc_id").alias("_bad"), F.col("mark").alias("_mark")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.xxhash64(docs["text"]) == F.col("_mark")), "left_anti")
