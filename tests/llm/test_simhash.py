import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from annalog.llm import components, near
from annalog.llm import simhash as s

from .conftest import low, prose


def brute_print(text):
    w = low(text).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(prints, threshold=4):
    """Root of each fingerprint by union-find over all pairs."""
    fps = sorted(set(prints))
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_prints_and_components_are_those_of_brute_force(docs, corpus, empty):
    got = s.classes(docs).select("doc_id", s.hex_of("fp").alias("h"), "component_id").collect()
    root = brute_classes([brute_print(t) for i, t, _ in corpus if i is not None])
    least = {}
    for i, t, _ in corpus:
        if i is not None:
            r = root[brute_print(t)]
            least[r] = min(i, least.get(r, i))
    text = {i: t for i, t, _ in corpus if i is not None}
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            fp = brute_print(text[r["doc_id"]])
            assert r["h"] == format(fp, "016x") and r["component_id"] == least[root[fp]]
    assert s.classes(empty).count() == 0


def chained(seed, n):
    """Fingerprints in groups: chains of steps of 1 to 5 bits from random points."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.append(x)
            for k in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << k
    return out


def links_of(spark, prints):
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in set(prints)], "fp long").repartition(3)
    return components.stars(s.link(frame)).collect()


def check_links(spark, prints):
    found = {int(np.int64(r["u"]).view(np.uint64)): int(np.int64(r["v"]).view(np.uint64)) for r in links_of(spark, prints)}
    root = brute_classes(prints)
    groups, want = {}, {}
    for f in root:
        groups.setdefault(found.get(f, f), set()).add(f)
        want.setdefault(root[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_no_link_is_lost(spark):
    check_links(spark, chained(1, 1500))


def test_no_link_is_lost_with_finer_anchors_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(s, "DIMENSIONS", ((1 << 62, 7),))
    monkeypatch.setattr(s, "TILE", 8)
    dense = [x for k in range(64) for x in (1 << k, 1 << k | 1 << (k * 7 + 3) % 64)]  # one hot anchor
    check_links(spark, chained(2, 300) + dense)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.lists(st.integers(0, 63), max_size=4))
def test_linked_prints_meet_at_the_nearer_ones_home(x, flips):
    y = x
    for k in flips:
        y ^= 1 << k
    words = s.code(6)
    home, radius, who, anchor = s.visits(np.array([x, y], np.uint64), words)
    near = int(np.argmin(radius))
    assert home[near] in set(anchor[who == 1 - near].tolist())
    assert radius.max() <= 24  # twice the covering radius of the first-order code of length 32


def test_the_code_is_linear_and_as_far_apart_as_it_should():
    words = s.code(6)
    assert len(set(words.tolist())) == 64
    assert min(int(w).bit_count() for w in words if w) == 16


def test_one_of_each_class_stays(docs, corpus):
    stay = s.drop_near_duplicates(docs)
    assert sorted(stay.columns) == sorted(docs.columns)
    rows = stay.collect()
    classes = {(r["doc_id"], r["component_id"]) for r in s.classes(docs).collect() if r["doc_id"] is not None}
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted({c for _, c in classes})
    assert sum(r["doc_id"] is None for r in rows) == 2


def test_stars_on_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, i) for i in range(1001, 1200)]
    noise = [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(path + hub + noise, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 1000 for i in range(1001, 1200)} | {5: 4}
    assert components.stars(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_of_one_id_with_other_texts_are_not_lost(spark):
    rng = random.Random(21)
    a, b = prose(rng, 60, 9000), prose(rng, 60, 9000)
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a), (3, b), (3, prose(rng, 60, 9000))], "doc_id long, text string")
    for drop in (s.drop_near_duplicates, near.drop_near_duplicates):
        got = sorted((r["doc_id"], r["text"]) for r in drop(docs).collect())
        assert [i for i, _ in got] == [1, 1, 3] and {t for _, t in got[:2]} == {a, b}
