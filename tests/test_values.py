from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from annalog import values as v
from annalog.functions import parse


@pytest.mark.parametrize("n", [1, 100, 2**31 - 1, None])
def test_limits_that_can_be(n):
    assert v.limit(n) == n


@pytest.mark.parametrize("n", [0, -1, -100, -(2**31), True])
def test_limits_that_cannot(n):
    with pytest.raises(ValueError):
        v.limit(n)


@pytest.mark.parametrize("name", ["a", "Z9", "orders", "my-store_1", "a" * 255])
def test_store_names_that_can_be(name):
    assert v.store_name(name) == name


@pytest.mark.parametrize("name", ["", "1a", "-a", "a-", "a_", "a b", "a.b", "é", "a" * 256, "a\n"])
def test_store_names_that_cannot(name):
    with pytest.raises(ValueError):
        v.store_name(name)


def test_a_time_range_starts_before_it_ends():
    t = datetime(2024, 1, 1)
    assert v.TimeRange(t, t + timedelta(microseconds=1)).start == t
    assert v.TimeRange().end is None
    for end in (t, t - timedelta(1)):
        with pytest.raises(ValueError):
            v.TimeRange(t, end)


def test_queries_need_items_types_and_tags():
    for make in (lambda: v.TagQuery(), lambda: v.TagsOnly({}), lambda: v.TypesAndTags([], {"a": "b"}), lambda: v.TypesAndTags(["t"], {}), lambda: v.TagsOnly({" ": "x"}), lambda: v.AllOf()):
        with pytest.raises(ValueError):
            make()
    assert v.TagsOnly({"present": ""}).tags == {"present": ""}


@pytest.mark.parametrize("make", [lambda: v.FactInput(" ", "s"), lambda: v.FactInput("t", ""), lambda: v.FactInput("t", " s"), lambda: v.FactInput("t", "s", tags={"": "x"}), lambda: v.Payload(format=" "), lambda: v.Payload(schema_ref="")])
def test_facts_that_cannot_be(make):
    with pytest.raises(ValueError):
        make()


def test_an_append_key_is_an_id():
    assert v.AppendRequest(()).key != v.AppendRequest(()).key
    with pytest.raises(ValueError):
        v.AppendRequest((), key="x")


def test_directions():
    assert v.Direction.parse("BackWard") is v.Direction.BACKWARD
    assert v.Direction.parse(None) is v.Direction.FORWARD
    with pytest.raises(ValueError):
        v.Direction.parse("up")


def test_tags_from_text():
    assert parse.tag(" a =b=c") == ("a", "b=c")
    assert parse.tags(["a=1", "b=", "a=2"]) == {"a": "2", "b": ""}
    for bad in ("a", "=b", " =b"):
        with pytest.raises(ValueError):
            parse.tag(bad)


def test_instants_from_text():
    now = datetime(2024, 5, 1, tzinfo=UTC)
    assert parse.instant("15m", now) == now - timedelta(minutes=15)
    assert parse.instant("6h", now) == now - timedelta(hours=6)
    assert parse.instant("2d", now) == now - timedelta(days=2)
    assert parse.instant("2024-05-01T00:00:00Z") == now
    with pytest.raises(ValueError):
        parse.instant("yesterday")
    assert parse.PRESETS["24h"] == timedelta(days=1)


@given(st.integers(-62135596800, 253402300799), st.integers(0, 999_999))
def test_instants_as_seconds_and_nanos_come_back(seconds, micros):
    at = parse.from_seconds_and_nanos(seconds, micros * 1000 + 999)
    assert parse.seconds_and_nanos(at) == (seconds, micros * 1000)


def test_ids_and_lenient_limits():
    assert parse.fact_id("6F9619FF-8B86-D011-B42D-00C04FC964FF") == "6f9619ff-8b86-d011-b42d-00c04fc964ff"
    with pytest.raises(ValueError):
        parse.fact_id("nobody")
    assert [parse.lenient_limit(n) for n in (None, 0, -3, 7)] == [None, None, None, 7]


def test_tags_and_limits_of_a_command_line_and_of_a_query_string():
    assert parse.tags([" a =1=2", "b="]) == {"a": "1=2", "b": ""} and parse.tags([" a =1"], trim=False) == {" a ": "1"}
    assert parse.command_limit(None) == 100 and parse.command_limit(7) == 7
    with pytest.raises(ValueError):
        parse.command_limit(0)
