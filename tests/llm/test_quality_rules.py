import collections
import random

from pyspark.sql import functions as F

from annalog.llm import quality_rules as q

from .conftest import prose, words


def brute(text):
    text, w = text or "", words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_figures_are_those_of_brute_force(docs, corpus):
    got = q.features(docs.select("doc_id", "text"), "doc_id", "text").collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"]), r["doc_id"]


def test_base_and_posterior(docs):
    for r in q.score(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_bad_texts_go_and_good_ones_stay(spark):
    rng = random.Random(1)
    good = [" ".join(("the" if i % 5 == 0 else "of" if i % 7 == 0 else w) for i, w in enumerate(prose(rng, 80, 5000).split())) for _ in range(60)]
    symbols = ["### " + " ".join(f"x{rng.randrange(5000)}%%%" for _ in range(60)) for _ in range(8)]
    table = [" | ".join(f"Cell{rng.randrange(5000)}" for _ in range(60)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(good + symbols + table)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in q.score(docs).where("kept").collect()}
    assert kept == set(range(60))
    stay = q.keep_good(docs)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} == kept


def test_rows_keep_their_columns(docs, empty):
    stay = q.keep_good(docs)
    assert stay.schema == docs.schema
    assert {r["votes"] for r in stay.collect()} <= {"votes!"}
    assert q.score(empty).count() == q.keep_good(empty).count() == 0


def test_estimation_prefers_the_larger_agreement():
    p = q.estimate(["ggg-----", "bbb-----"], [90, 10])
    assert p["ggg-----"] > 0.9 and p["bbb-----"] < 0.1 and q.estimate([], []) == {}


def test_columns_of_any_name_pass_through(spark, docs):
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("_kept_votes", "n_words", "failed", "c0", "posterior", "a.b"))])
    kept = q.keep_good(odd)
    assert kept.columns == odd.columns
    row = kept.first()
    assert (row["votes"], row["_kept_votes"], row["n_words"], row["failed"], row["c0"], row["posterior"], row["a.b"]) == ("votes!", 0, 1, 2, 3, 4, 5)


def test_a_poor_vocabulary_is_voted_bad_at_every_length(spark):
    frame = spark.createDataFrame([(n, d) for n, d in ((2000, 50), (2001, 50), (20000, 100), (20000, 2000), (100, 24), (100, 26))], "n_words long, n_distinct long")
    rule = dict((name, bad) for name, bad, _ in q.RULES)["variety"]
    assert [r[0] for r in frame.select(F.expr(rule)).collect()] == [True, True, True, False, True, False]
