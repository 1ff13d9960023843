import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from annalog import queries as core
from annalog.functions import columns
from annalog.operators import reads, tag_index
from annalog.sources.tables import ACTIVITY
from annalog.values import TagQuery, TagsOnly

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(map(str, r)) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_agrees_with_sql(spark, data, duck, name):
    got, want = core.queries()[name](spark, data).toPandas(), duck.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == core.SHOWN


def test_every_query_has_sql_or_says_why(data):
    assert set(core.oracle_sql()) == set(core.queries())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_look_ups_reach_the_scan(spark, data):
    p = plan(core.find_by_id(spark, data))
    assert "EqualTo(event_id,500)" in p and "props" not in p
    p = plan(core.exists_by_id(spark, data))
    assert "EqualTo(event_id,501)" in p and "ReadSchema: struct<event_id:bigint>" in p
    assert "EqualTo(user_id,7)" in plan(core.subject_forward(spark, data))
    assert "GreaterThanOrEqual(ts," in plan(core.time_bounded(spark, data))


def test_limited_reads_take_the_top_without_a_full_sort(spark, data):
    assert "TakeOrderedAndProject" in plan(core.subject_backward_limit(spark, data))


def test_a_written_tag_index_answers_as_the_map_does(spark, data, tmp_path):
    facts = ACTIVITY.read(spark, data)
    tag_index.write(facts, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = tag_index.positions(index, {"user": "3"})
    assert "EqualTo(tag_key,user)" in plan(found)
    assert found.count() == facts.where(columns.has_tag("user", "3")).count() > 0


def test_a_range_of_the_tag_index_is_bounded_in_rows(spark, data, tmp_path, monkeypatch):
    """With few partitions for shuffles too; 4 here, which would have 500 entries each."""
    monkeypatch.setattr(reads, "TASK_FACTS", 100, raising=False)
    facts = ACTIVITY.read(spark, data)
    tag_index.write(facts, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    sizes = [r["count"] for r in index.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == tag_index.entries(facts).count() == 2000 and len(sizes) >= 15 and max(sizes) < 300
    one = TagQuery(TagsOnly({"user": "3"}))
    assert {r[0] for r in tag_index.query_positions(index, one).collect()} == {r[0] for r in reads.by_tag_query(facts, one).select("position").collect()}


def test_renderings(spark):
    at = "timestamp_ntz '2024-01-02 03:04:05.678'"
    df = spark.sql(f"select 'i' fact_id, 't' type, 's' subject, {at} appended_at, named_struct('data', cast('a\nb{'c' * 50}' as binary)) payload, map('m', '1') metadata, map() tags")
    row = df.select(*columns.table_row()).first()
    assert row["appended_at"] == "2024-01-02T03:04:05Z" and row["payload"] == "a b" + "c" * 37 + "…"
    assert '"payload":{"data":"' in df.select(columns.json_line().alias("j")).first()["j"]
    assert "\n" in df.select(columns.json_line(pretty=True).alias("j")).first()["j"] and "\n" not in df.select(columns.json_line().alias("j")).first()["j"]
    texts = spark.createDataFrame([("aGk=",), ("not base64!",), ("//4=",), (None,)], "t string")
    assert [r[0] for r in texts.select(columns.payload_text(texts["t"])).collect()] == ["hi", "not base64!", "//4=", None]
    odd = df.withColumn("payload", F.struct(F.lit(b"\xff\xfe ok").alias("data"), F.lit("f").alias("format"), F.lit("s").alias("schema_ref")))
    assert odd.select(*columns.table_row()).first()["payload"].endswith(" ok")
    message = odd.select(*columns.wire_message()).first()
    assert message["payload"]["schema"] == "s" and message["appended_at"]["seconds"] == 1704164645 and message["appended_at"]["nanos"] == 678_000_000
    for text, seconds, nanos in (("1969-12-31 23:59:59.5", -1, 500_000_000), ("2024-03-31 02:30:00", 1711852200, 0)):
        at = odd.withColumn("appended_at", F.lit(text).cast("timestamp_ntz")).select(*columns.wire_message()).first()["appended_at"]
        assert (at["seconds"], at["nanos"]) == (seconds, nanos)


def test_times_are_utc_whatever_the_session_says(spark):
    df = spark.sql("select 'i' fact_id, 't' type, 's' subject, timestamp_ntz '2024-03-31 02:30:00.5' appended_at, named_struct('data', cast('x' as binary)) payload")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # where that hour doesn't exist
    try:
        assert df.select(*columns.table_row()).first()["appended_at"] == "2024-03-31T02:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_tag_of_a_view_is_its_column(spark, data):
    p = plan(core.tags_multi_and(spark, data))
    assert "map(" not in p.split("Filter")[1].split("\n")[0]
