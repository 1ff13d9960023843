"""Reads against a plain version, on random facts and queries."""

import random
from datetime import datetime, timedelta

import pytest

from annalog.operators import reads, tag_index
from annalog.plans.tag_query import compile_query
from annalog.values import Direction, TagQuery, TagsOnly, TimeRange, TypesAndTags

KEYS, VALUES, TYPES = ["a", "b", "c"], ["", "1", "2"], ["x", "y", "z"]


def some_tags(rng, least=0):
    return {k: rng.choice(VALUES) for k in rng.sample(KEYS, rng.randrange(least, len(KEYS) + 1))}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    t = datetime(2024, 1, 1)
    return [(i, f"f{i}", rng.choice(TYPES), f"s{rng.randrange(4)}", t + timedelta(hours=rng.randrange(20)), some_tags(rng)) for i in range(1, 200)]


@pytest.fixture(scope="module")
def facts(spark, rows):
    return spark.createDataFrame(rows, "position long, fact_id string, type string, subject string, appended_at timestamp_ntz, tags map<string,string>").repartition(3).cache()


def carries(row, tags):
    return all(row[5].get(k) == v for k, v in tags.items())


def matches(row, query):
    return any(carries(row, i.tags) and (not isinstance(i, TypesAndTags) or row[2] in i.types) for i in query.items)


def some_query(rng):
    items = []
    for _ in range(rng.randrange(1, 4)):
        tags = some_tags(rng, 1)
        items.append(TypesAndTags(rng.sample(TYPES, rng.randrange(1, 3)), tags) if rng.random() < 0.5 else TagsOnly(tags))
    return TagQuery(*items)


def positions(frame):
    return [r["position"] for r in frame.collect()]


def test_tag_queries_and_their_negations(facts, rows):
    rng = random.Random(4)
    queries = [some_query(rng) for _ in range(40)]
    columns = [c for i, q in enumerate(queries) for c in (compile_query(q).alias(f"q{i}"), (~compile_query(q)).alias(f"n{i}"))]
    got = {r["position"]: r for r in facts.select("position", *columns).collect()}
    for row in rows:
        for i, q in enumerate(queries):
            assert got[row[0]][f"q{i}"] is matches(row, q) and got[row[0]][f"n{i}"] is not matches(row, q)


def test_the_index_finds_what_the_query_does(facts, rows):
    rng = random.Random(5)
    index = tag_index.entries(facts).cache()
    for _ in range(6):
        q = some_query(rng)
        want = [r[0] for r in rows if matches(r, q)]
        assert positions(tag_index.lookup(facts, tag_index.query_positions(index, q))) == want == positions(reads.by_tag_query(facts, q))


@pytest.mark.parametrize("direction", list(Direction))
@pytest.mark.parametrize("limit", [None, 1, 7, 1000])
def test_order_comes_before_the_limit(facts, rows, direction, limit):
    turn = (lambda x: x[::-1]) if direction is Direction.BACKWARD else (lambda x: x)
    span = TimeRange(datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 15))
    inside = sorted((r for r in rows if span.start <= r[4] < span.end), key=lambda r: (r[4], r[0]))
    assert positions(reads.in_time_range(facts, span, limit, direction)) == [r[0] for r in turn(inside)][:limit]
    assert positions(reads.by_subject(facts, "s1", limit, direction)) == turn([r[0] for r in rows if r[3] == "s1"])[:limit]
    assert positions(reads.by_tags(facts, {"a": "1"}, limit, direction)) == turn([r[0] for r in rows if r[5].get("a") == "1"])[:limit]


def test_last_facts_head_and_deltas(facts, rows):
    last = {r[3]: r[1] for r in rows}
    assert {r["subject"]: r["fact_id"] for r in reads.last_per_subject(facts).collect()} == last
    assert reads.head(facts).first()["head"] == 199
    assert sorted(positions(reads.between(facts, 50, 60))) == list(range(51, 61))
    assert positions(reads.between(facts, 60, 60)) == []
    assert reads.head(facts.limit(0)).first()["head"] is None
    assert reads.exists_by_id(facts, "f3").first()["found"] and not reads.exists_by_id(facts, "g").first()["found"]
