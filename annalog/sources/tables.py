"""Tables of the test data seen as stores of facts.

A view maps a table's rows to facts. Ids, subjects and times are renamings of single
columns, so a view can turn a look-up by id or subject into a predicate on the
table's own column, which reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """A store over a table: how to make facts, and the native side of an id or a subject."""

    table: str
    facts: Callable[[DataFrame], DataFrame]
    id_prefix: str
    id_column: str
    subject_prefix: str
    subject_column: str

    def read(self, spark: SparkSession, sf_dir: str, fact_id: str | None = None, subject: str | None = None) -> DataFrame:
        """All facts, or those a native predicate leaves for an id or a subject."""
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        for value, prefix, column in ((fact_id, self.id_prefix, self.id_column), (subject, self.subject_prefix, self.subject_column)):
            if value is not None:
                native = value.removeprefix(prefix)
                known = value.startswith(prefix) and native.isdecimal()
                rows = rows.where(F.col(column) == int(native) if known else F.lit(False))
        return self.facts(rows)


def _tags(**values: Column) -> Column:
    """A map of tags. A null value matches nothing and is not indexed: it is no tag.

    Left unfiltered, so that Catalyst sees through it: a look-up of a key becomes the column.
    """
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _activity(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("event_id").alias("position"), F.concat(F.lit("e-"), F.col("event_id")).alias("fact_id"), F.col("event_type").alias("type"),
        F.concat(F.lit("user/"), F.col("user_id")).alias("subject"), F.col("ts").alias("appended_at"),
        _tags(user=F.col("user_id").cast("string"), k=F.get_json_object("props", "$.k")).alias("tags"),
    )


def _orders(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("o_orderkey").alias("position"), F.concat(F.lit("o-"), F.col("o_orderkey")).alias("fact_id"), F.col("o_orderstatus").alias("type"),
        F.concat(F.lit("customer/"), F.col("o_custkey")).alias("subject"), F.col("o_orderdate").alias("appended_at"),
        _tags(priority=F.col("o_orderpriority")).alias("tags"),
    )


def _dialogue(rows: DataFrame) -> DataFrame:
    # turns of a conversation are numbered below a million
    return rows.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("position"), F.concat_ws("-", F.lit("c"), F.col("conv_id"), F.col("turn")).alias("fact_id"), F.col("role").alias("type"),
        F.concat(F.lit("conv/"), F.col("conv_id")).alias("subject"), F.lit(None).cast("timestamp_ntz").alias("appended_at"),
        _tags(turn=F.col("turn").cast("string")).alias("tags"),
    )


ACTIVITY = View("events", _activity, "e-", "event_id", "user/", "user_id")
ORDERS = View("orders", _orders, "o-", "o_orderkey", "customer/", "o_custkey")
DIALOGUE = View("conversations", _dialogue, "c-", "conv_id", "conv/", "conv_id")
STORES = {"activity": ACTIVITY, "orders": ORDERS, "dialogue": DIALOGUE}
