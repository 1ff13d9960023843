import random

import numpy as np

from annalog.llm import bytescan as bs
from annalog.llm import toxicity as t

from .conftest import prose

INSULTS = ["idiot", "moron", "scum"]


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = prose(rng, rng.randrange(20, 120), 2000).split(" ")
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        out.append((i + seed * 10_000, " ".join(w), int(toxic)))
    return out


def test_subwords_of_each_word():
    data = np.frombuffer(b"Ab xyz", np.uint8)
    starts, ends, _ = bs.words(data, np.array([0, 6]))
    owner, bucket = t.subwords(data, starts, ends)
    # "ab": itself, " ab", "ab ", " ab "; "xyz": itself, " xy", "xyz", "yz ", " xyz", "xyz ", " xyz "
    assert np.bincount(owner).tolist() == [4, 7]
    again, same = t.subwords(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]))
    assert sorted(same.tolist()) == sorted(bucket[owner == 0].tolist())


def test_held_out_texts_and_misspellings(spark):
    train, test = texts(1, 400), texts(2, 200)
    docs = spark.createDataFrame([(*r[:2], "x") for r in train + test], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train] + [(None, 1), (train[0][0], None), (-5, 1)], "doc_id long, toxic int")
    model = t.train(docs, labels)
    score = {r["doc_id"]: r["score"] for r in t.score(docs, model).collect()}
    pairs = [(score[i] > score[j]) for i, _, y in test if y for j, _, z in test if not z]
    assert sum(pairs) / len(pairs) > 0.97  # few texts to learn from: the order is right, the bound less so
    right = [(score[i] >= 0.5) == bool(y) for i, _, y in test]
    assert sum(right) / len(right) > 0.9
    odd = spark.createDataFrame([(1, "what an idiiot you are"), (2, "what a lovely day it is"), (3, None), (4, ""), (5, "w1 " * 5000 + "moron" + " w2" * 5000)], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in t.score(odd, model).collect()}
    assert s[1] > s[2] and s[5] > 0.5 and s[3] == s[4] and all(0 <= x <= 1 for x in s.values())
    again = {r["doc_id"]: r["score"] for r in t.score(docs.repartition(5), t.train(docs.repartition(5), labels)).collect()}
    assert again == score  # reruns agree


def test_no_labels_or_one_class(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert max(r["score"] for r in t.score(docs, t.train(docs, none)).collect()) < 1e-200
    one = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    assert max(r["score"] for r in t.score(docs, t.train(docs, one)).collect()) < 0.5
    assert t.score(empty, t.train(docs, one)).count() == 0


def test_repeated_and_very_long_labelled_rows_are_bounded(spark):
    train = texts(3, 120)
    long = [(999, "w7 " * 20000, 0)]
    rows = [r[:2] for r in train + long] + [train[0][:2]] * 40 + [(train[1][0], "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in train + long], "doc_id long, toxic int")
    model = t.train(docs, labels, max_bytes=30_000)  # the long one doesn't fit
    once = t.train(docs.dropDuplicates(), labels, max_bytes=30_000)
    assert (model.vectors == once.vectors).all()
    few = t.train(docs, labels, max_rows=20)
    assert np.isfinite(few.vectors).all()


def test_training_ends_by_the_kept_out_share():
    rows = texts(4, 300)
    made = t.fit([r[1].encode() for r in rows], np.array([r[2] for r in rows]), rounds=8)
    more = t.fit([r[1].encode() for r in rows], np.array([r[2] for r in rows]), rounds=40)
    assert np.isfinite(made.vectors).all() and np.isfinite(more.vectors).all()
    share, bias = more.logits()
    data = b"".join(r[1].encode() for r in texts(5, 100))
    offsets = np.cumsum([0, *(len(r[1].encode()) for r in texts(5, 100))])
    got = t.score_block(np.frombuffer(data, np.uint8), offsets, share, bias)
    assert ((got >= 0.5) == (np.array([r[2] for r in texts(5, 100)]) == 1)).mean() > 0.9
