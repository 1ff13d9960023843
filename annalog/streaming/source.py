"""Structured Streaming over a store's log.

The offset is a position. A micro-batch goes from the last position to the head as Spark
asks for it, so a bounded run (``availableNow``) ends at the head it was started at.
What bounds the work is the partition: commits are read together up to ``most`` facts,
a larger commit and compacted facts file by file, and rows leave a file in batches.
Files that no commit or segment names are never looked at. Positions that are compacted
when the reader starts come from the runs, in their order; later ones from their commits.
A query resumes from its checkpoint, or from a position given as an option.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from annalog.sources import arrow_io
from annalog.sources.arrow_io import open_path

FORMAT = "annalog_facts"
SCHEMA = (
    "position bigint, fact_id string, type string, subject string, appended_at timestamp_ntz, "
    "payload struct<data:binary,format:string,schema_ref:string>, metadata map<string,string>, tags map<string,string>"
)
_NAMES = ["position", "fact_id", "type", "subject", "appended_at", "payload", "metadata", "tags"]


class Piece(InputPartition):
    """Facts after ``low`` up to ``high`` in some files or folders.

    ``places``: (path, first position and instant of its commit; both None where the file has them).
    """

    def __init__(self, places: list[tuple[str, int | None, str | None]], low: int, high: int, most: int) -> None:
        super().__init__(None)
        self.places, self.low, self.high, self.most = places, low, high, most


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.start = int(options.get("after", "0"))
        self.most = max(1, int(options.get("mostfacts", "10000")))
        self.segment: dict | None = None
        self.commits: list[dict] = []
        self.known = False

    def _read(self, name: str) -> dict | None:
        fs, path = open_path(f"{self.path}/{name}")
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _refresh(self) -> None:
        """The last segment, once, and the commits after it by their numbers."""
        if not self.known:
            fs, root = open_path(f"{self.path}/segments")
            if fs.get_file_info(root).type != pafs.FileType.NotFound:
                names = sorted(n for f in fs.get_file_info(pafs.FileSelector(root)) if not (n := os.path.basename(f.path)).startswith("."))
                self.segment = self._read(f"segments/{names[-1]}") if names else None
            self.known = True
        number = (self.segment["commits"] if self.segment else 0) + len(self.commits)
        while (commit := self._read(f"commits/{number:020d}.json")) is not None:
            self.commits.append(commit)
            number += 1

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        self._refresh()
        head = max((c["first_position"] + c["fact_count"] - 1 for c in self.commits if c["fact_count"]), default=self.segment["end"] - 1 if self.segment else 0)
        return {"position": max(self.start, head)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        low, high = start["position"], end["position"]
        if not self.known:
            self._refresh()
        out, held, size = [], [], 0
        for path, _, _, files in self.segment["runs"] if self.segment else []:
            out += [Piece([(f"{self.path}/{path}/facts/{name}", None, None)], low, high, self.most) for name, first, last in files if first <= high and last > low]
        for c in self.commits:
            if not c["fact_count"] or c["first_position"] > high or c["first_position"] + c["fact_count"] - 1 <= low:
                continue
            folder, first, at = f"{self.path}/data/{c['batch_id']}", c["first_position"], c["appended_at"]
            if c["fact_count"] > self.most:
                scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
                found = arrow_io.files(folder)[1]
                out += [Piece([(f if not scheme or scheme == "file://" else folder + "/" + os.path.basename(f), first, at)], low, high, self.most) for f in found]
                continue
            if held and size + c["fact_count"] > self.most:
                out.append(Piece(held, low, high, self.most))
                held, size = [], 0
            held.append((folder, first, at))
            size += c["fact_count"]
        return [*out, Piece(held, low, high, self.most)] if held else out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for place, first, at in partition.places:
            fs, path = open_path(place)
            files = [path] if path.endswith(".parquet") else arrow_io.files(place)[1]
            column, base = ("position", 0) if first is None else ("ordinal", first)
            for file in files:  # their names follow the order of facts
                inside = (pc.field(column) > partition.low - base) & (pc.field(column) <= partition.high - base)
                scanned = ds.dataset(file, filesystem=fs, format="parquet").to_batches(filter=inside, batch_size=partition.most, batch_readahead=1, fragment_readahead=1)
                for batch in scanned:
                    if not batch.num_rows:
                        continue
                    table = pa.Table.from_batches([batch])
                    if first is not None:
                        table = table.append_column("position", pc.add(table["ordinal"].cast(pa.int64()), first))
                        table = table.append_column("appended_at", pa.array([datetime.fromisoformat(at)] * table.num_rows, pa.timestamp("us")))
                    yield from table.select(_NAMES).sort_by("position").to_batches()

    def commit(self, end: dict) -> None:
        pass


class FactSource(DataSource):
    """``spark.readStream.format("annalog_facts")`` with path, after (a position) and mostFacts (of a task's batch)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(self.options)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver did; a cluster has it installed."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def read_stream(spark: SparkSession, log_path: str, after: int = 0, most: int = 10_000) -> DataFrame:
    """Facts of a log after a position, as a stream."""
    workers_find_package(spark)
    spark.dataSource.register(FactSource)
    return spark.readStream.format(FORMAT).option("path", log_path).option("after", str(after)).option("mostFacts", str(most)).load()


def counters(query) -> dict[str, int]:
    """Of a running or ended query: facts received, and how many more the log held when it was last asked."""
    progress = query.recentProgress
    received = sum(p["numInputRows"] for p in progress)
    sources = progress[-1]["sources"] if progress else []
    at = lambda offset: int(found[0]) if (found := re.search(r"\d+", str(offset))) else 0
    pending = sum(max(0, at(s.get("latestOffset")) - at(s.get("endOffset"))) for s in sources)
    return {"received": received, "pending": pending}
