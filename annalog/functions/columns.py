"""Columns over facts: predicates that Catalyst can use, and renderings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_tag(key: str, value: str) -> Column:
    """True or false, never null: a missing key matches nothing, an empty value only itself."""
    return F.col("tags")[key].eqNullSafe(F.lit(value))


def has_tags(tags: Mapping[str, str]) -> Column:
    return reduce(and_, [has_tag(k, v) for k, v in sorted(tags.items())])


def of_types(types: Iterable[str]) -> Column:
    return F.col("type").isin(*sorted(types))


def any_of(predicates: list[Column]) -> Column:
    return reduce(or_, predicates)


def within(start=None, end=None, column: str = "appended_at") -> Column:
    """Half-open; a bound of None is open."""
    bounds = [F.col(column) >= F.lit(start)] if start is not None else []
    bounds += [F.col(column) < F.lit(end)] if end is not None else []
    return reduce(and_, bounds, F.lit(True))


def payload_base64() -> Column:
    return F.base64("payload.data")


def text_of(data: Column) -> Column:
    """Bytes as text; each byte that isn't part of UTF-8 is a replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def payload_text(encoded: Column) -> Column:
    """Base64 of UTF-8 as text, or what was given where it isn't that."""
    data = F.try_to_binary(encoded, F.lit("base64"))
    return F.coalesce(F.try_validate_utf8(data.cast("string")), encoded)


def one_line(text: Column, width: int = 40) -> Column:
    """Text without line breaks, cut at ``width`` characters with an ellipsis."""
    flat = F.regexp_replace(text, r"\R", " ")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("…"))).otherwise(flat)


def json_shape() -> list[Column]:
    """The envelope as the HTTP surface shows it: base64 data, no format or schema."""
    return [
        F.col("fact_id").alias("id"), "type", F.struct(payload_base64().alias("data")).alias("payload"),
        "subject", F.col("appended_at").alias("appendedAt"), "metadata", "tags",
    ]


def json_line(pretty: bool = False) -> Column:
    """A fact as JSON: one line, or indented."""
    return F.to_json(F.struct(*json_shape()), {"pretty": "true"} if pretty else {})


def to_the_second(at: str = "appended_at") -> Column:
    """An instant in UTC without its fraction, as ISO-8601; the session's zone plays no part."""
    return F.concat(F.replace(F.substring(F.col(at).cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def table_row() -> list[Column]:
    """A fact as a row of a text table: seconds, and a short payload."""
    return ["fact_id", "type", "subject", to_the_second().alias("appended_at"), one_line(text_of(F.col("payload.data"))).alias("payload")]


def wire_message() -> list[Column]:
    """The envelope as the binary surface carries it: bytes with format and schema, and an instant in two numbers."""
    micros = _micros(F.col("appended_at"))
    return [
        F.col("fact_id").alias("id"), "type",
        F.struct(F.col("payload.data").alias("data"), F.col("payload.format").alias("format"), F.col("payload.schema_ref").alias("schema")).alias("payload"),
        "subject", F.struct(F.floor(micros / 1_000_000).alias("seconds"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("nanos")).alias("appended_at"),
        "metadata", "tags",
    ]


def _micros(at: Column) -> Column:
    """Microseconds of the epoch of a time without a zone, which is UTC."""
    since = at - F.lit("1970-01-01").cast("timestamp_ntz")
    return (F.extract(F.lit("DAY"), since).cast("long") * 86_400 + F.extract(F.lit("HOUR"), since) * 3600 + F.extract(F.lit("MINUTE"), since) * 60) * 1_000_000 + (
        F.extract(F.lit("SECOND"), since) * 1_000_000
    ).cast("long")
