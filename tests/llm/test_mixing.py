import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from annalog.llm import mixing as m

from .conftest import words


@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([1, 2, 3])), min_size=1, max_size=12))
def test_targets_share_all_and_stop_at_twice_the_size(rows):
    sizes, weights = zip(*rows, strict=True)
    total = 1.5 * sum(sizes)
    got = m.targets(list(sizes), list(weights), total)
    assert sum(got) == pytest.approx(total)
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    free = [t / w for t, s, w in zip(got, sizes, weights, strict=True) if t < 2 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.integers(1, 17))
def test_the_tree_deals_every_block_once_and_evenly(counts, shards):
    got = m.split_tree(counts, shards, 3)
    assert got.sum(axis=0).tolist() == counts and (got >= 0).all()
    assert np.ptp(got.sum(axis=1)) <= np.ceil(np.log2(shards)) + 1
    assert (got == m.split_tree(counts, shards, 3)).all()


def test_taken_comes_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 400), f"s{i % 5}" if i % 11 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = m.taken(docs).collect()
    by = {}
    for r in got:
        assert r["size"] == len(words(rows[r["doc_id"]][1])) and 0 <= r["taken"] <= 2 * r["size"]
        b = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        b[0] += r["size"]
        b[1] += r["taken"]
    names = sorted((n for n in by if n is not None)) + [None]
    want = m.targets([by[n][0] for n in names], [[3, 1, 2][i % 3] for i in range(len(names))], 1.5 * sum(b[0] for b in by.values()))
    for n, t in zip(names, want, strict=True):
        assert by[n][2] == pytest.approx(t) and by[n][3] == by[n][0] and abs(by[n][1] - t) < 10
    again = m.taken(docs.repartition(7)).collect()
    key = lambda rows: sorted((r["doc_id"], r["taken"], r["shards"]) for r in rows)
    assert key(got) == key(again)


def test_odd_rows(docs, corpus, empty):
    got = m.taken(docs).collect()
    assert len(got) == len(corpus)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert len({r["taken"] for r in got if r["doc_id"] == 3}) == 1
    assert m.taken(empty).count() == m.mix(empty).count() == 0


def test_the_mix_holds_what_was_taken(docs):
    mixed = m.mix(docs, shards=4)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_copy"]
    rows = mixed.collect()
    want = sorted((repr(r["doc_id"]), k, x) for r in m.taken(docs, shards=4).collect() for k, x in enumerate(r["shards"]))
    assert sorted((repr(r["doc_id"]), r["mix_copy"], r["mix_shard"]) for r in rows) == want
    assert len(rows) == len(want) and {r["mix_shard"] for r in rows} <= set(range(4)) and len({r["mix_shard"] for r in rows}) == 4
    assert {r["votes"] for r in rows} == {"votes!"}


def test_shards_have_their_exact_quota_of_blocks(spark):
    plans = [m.SourcePlan("a", 100, 150.0, 1, 1 << 61, ()), m.SourcePlan("b", 50, 25.0, 0, 1 << 60, (1 << 61,))]
    where = m.shard_table(plans, 8)
    drawn = [m.BLOCKS + m.BLOCKS // 2, m.BLOCKS // 2 + 1]
    dealt = m.split_tree(drawn, 8, 0)
    for i, n in enumerate(drawn):
        flat = np.concatenate([where[i, 0], where[i, 1, : n - m.BLOCKS]]) if plans[i].passes else where[i, 0, :n]
        assert np.bincount(flat, minlength=8).tolist() == dealt[:, i].tolist()


def test_a_bound_on_sources(spark, monkeypatch):
    monkeypatch.setattr(m, "MAX_SOURCES", 1)
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        m.taken(docs)


def spread(spark, n=3000):
    rows = [(i, "w " * (1 + i * 7919 % 40), f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_each_shards_quota_of_blocks_can_be_read_from_the_result(spark):
    docs = spread(spark)
    got = m.taken(docs, shards=8).collect()
    of_block = {}
    for r in got:
        for k, shard in enumerate(r["shards"]):
            assert of_block.setdefault((r["source"], k, r["block"]), shard) == shard  # a block is dealt whole
    plans = m.plan(m.sized(docs))
    width = 1 << m.SPACE_BITS - m.BITS
    drawn = [[(k, b) for k in range(p.passes) for b in range(m.BLOCKS)] + [(p.passes, b) for b in range(max([p.bound - 1, *p.extra], default=-1) // width + 1)] for p in plans]
    dealt = m.split_tree([len(d) for d in drawn], 8)
    for i, p in enumerate(plans):
        full = [of_block.get((p.source, k, b)) for k, b in drawn[i]]
        missing = full.count(None)  # blocks that hold no document
        counts = np.bincount([x for x in full if x is not None], minlength=8)
        assert (counts <= dealt[:, i]).all() and (dealt[:, i] - counts).sum() == missing < 0.4 * len(drawn[i])


def test_a_large_block_is_cut_again_and_targets_stay_met(spark, monkeypatch):
    docs = spread(spark, 6000)
    want = {r["source"]: r["target"] for r in m.taken(docs).collect()}
    monkeypatch.setattr(m, "REGION_MOST", 2)
    monkeypatch.setattr(m, "REGION", (1, 2))
    got = m.taken(docs).collect()
    for source, target in want.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) < 45


def test_many_rows_in_one_place(spark, monkeypatch):
    """Rows without an id share a place: they are taken together, in one region however small its bound."""
    monkeypatch.setattr(m, "REGION_MOST", 10)
    docs = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as doc_id", "'a b c' as text", "'x' as source")
    got = m.taken(docs).collect()
    assert len(got) == 300 and len({r["taken"] for r in got if r["doc_id"] is None}) == 1
    assert abs(sum(r["taken"] for r in got) - 1350) <= 300


def test_a_callers_columns_of_the_mixs_names_are_replaced(spark):
    docs = spread(spark, 60).selectExpr("*", "'mine' as mix_shard", "'row' as row", "7 as shards")
    mixed = m.mix(docs, shards=2)
    assert mixed.columns == ["doc_id", "text", "source", "row", "shards", "mix_shard", "mix_copy"]
    assert {(r["row"], r["shards"]) for r in mixed.collect()} == {("row", 7)}
