"""The log of a store: immutable Parquet files, made visible by numbered commits.

An append writes its facts under a new batch id, then publishes the next commit by its
number; who loses that race evaluates its condition again at the new head, and reuses
its files. Readers see only batches named by commits up to a pinned one, so a read
is a snapshot, an append is whole or absent, and a lost race leaves nothing visible.

Position and time are in the commit, not in the data: they are known only once a
number has been claimed. One instant for all facts of an append is the contract.

Compaction turns commits into *runs*: facts in the order of positions, with side tables by
id, subject, tag and idempotency key. A run takes in those before it that are no more
than ``GROWTH`` times its size, so a fact is rewritten a logarithmic number of times. A
segment file names the runs; a log opens at the last segment and reads only later commits.
"""

from __future__ import annotations

import itertools
import json
import threading
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalog.operators import tag_index
from annalog.operators.reads import spread
from annalog.sources import arrow_io
from annalog.sources.files import Files
from annalog.values import FactInput

DATA = (
    "batch_id string, ordinal long, fact_id string, type string, subject string, "
    "payload struct<data:binary,format:string,schema_ref:string>, metadata map<string,string>, tags map<string,string>"
)
FACTS = (
    "position long, fact_id string, type string, subject string, appended_at timestamp_ntz, "
    "payload struct<data:binary,format:string,schema_ref:string>, metadata map<string,string>, tags map<string,string>"
)


#: Facts since the last compaction that conditions may keep in the driver's memory.
TAIL_FACTS = 20_000
#: Positions that a look-up by index brings to the driver; a look-up with more of them scans.
INDEX_POSITIONS = 10_000
#: Ranges of positions in a scan's filter.
RANGES = 64
#: A new run takes in an earlier one that is at most so many times as large.
GROWTH = 2
#: Facts in one file of a bulk load or a run, so that a task of a stream is bounded.
FILE_FACTS = 1_000_000
#: Facts of one commit that may meet its row in one task, where the rows of commits aren't broadcast.
BLOCK_FACTS = 100_000
#: Rows of commits, one for each ``BLOCK_FACTS`` of their facts, that are broadcast: some 10 MB.
BROADCAST_BLOCKS = 100_000
#: Of ``monotonically_increasing_id``, the bits below the number of a partition.
PLACE_BITS = 33
#: Commits after which an open log looks for a newer segment.
SEGMENT_CHECK = 256


@dataclass(frozen=True)
class Commit:
    """One append: where its facts begin, how many there are, and under which key."""

    number: int
    batch_id: str
    key: str
    appended_at: datetime
    first_position: int
    fact_count: int

    @property
    def name(self) -> str:
        return commit_name(self.number)

    @property
    def end(self) -> int:
        return self.first_position + self.fact_count

    def to_json(self) -> str:
        return json.dumps({
            "number": self.number, "batch_id": self.batch_id, "key": self.key, "appended_at": self.appended_at.isoformat(timespec="microseconds"),
            "first_position": self.first_position, "fact_count": self.fact_count,
        })

    @classmethod
    def from_json(cls, text: str) -> Commit:
        x = json.loads(text)
        return cls(x["number"], x["batch_id"], x["key"], datetime.fromisoformat(x["appended_at"]), x["first_position"], x["fact_count"])


def commit_name(number: int) -> str:
    return f"{number:020d}.json"


@dataclass(frozen=True)
class Run:
    """Compacted facts from ``first`` on, before ``end``; ``files``: (name, least position, greatest)."""

    path: str
    first: int
    end: int
    files: tuple[tuple[str, int, int], ...]


@dataclass(frozen=True)
class Segment:
    """What the first ``commits`` commits were compacted into."""

    commits: int
    end: int
    last_at: datetime
    runs: tuple[Run, ...]

    def to_json(self) -> str:
        return json.dumps({"commits": self.commits, "end": self.end, "last_at": self.last_at.isoformat(timespec="microseconds"), "runs": [[r.path, r.first, r.end, r.files] for r in self.runs]})

    @classmethod
    def from_json(cls, text: str) -> Segment:
        x = json.loads(text)
        runs = tuple(Run(p, a, b, tuple((n, lo, hi) for n, lo, hi in files)) for p, a, b, files in x["runs"])
        return cls(x["commits"], x["end"], datetime.fromisoformat(x["last_at"]), runs)


@dataclass(frozen=True)
class Snapshot:
    """A segment and the first ``count`` commits of a list that only grows."""

    segment: Segment | None
    recent: Sequence[Commit]
    count: int

    @property
    def commits(self) -> Iterable[Commit]:
        """Commits that aren't compacted."""
        return itertools.islice(self.recent, self.count)

    @property
    def number(self) -> int:
        """How many commits there are, which is the next one's number."""
        return (self.segment.commits if self.segment else 0) + self.count

    @property
    def last_at(self) -> datetime | None:
        return self.recent[self.count - 1].appended_at if self.count else self.segment.last_at if self.segment else None

    @property
    def compacted_end(self) -> int:
        return self.segment.end if self.segment else 1

    @property
    def end(self) -> int:
        """One more than the last position: positions start at 1."""
        return self.recent[self.count - 1].end if self.count else self.compacted_end

    @property
    def head(self) -> int:
        """The last position; 0 where there is no fact."""
        return self.end - 1


@dataclass(frozen=True)
class TailFact:
    """What conditions look at."""

    position: int
    fact_id: str
    type: str
    subject: str
    tags: dict[str, str]


def now() -> datetime:
    """UTC without a zone, to the microsecond, as facts keep it."""
    return datetime.now(UTC).replace(tzinfo=None)


def ranges(positions: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` closed ranges that hold all of ``positions``, the widest gaps left out."""
    if not positions:
        return []
    p = sorted(set(positions))
    gaps = sorted(range(1, len(p)), key=lambda i: p[i - 1] - p[i])[: most - 1]
    edges = [0, *sorted(i for i in gaps if p[i] - p[i - 1] > 1), len(p)]
    return [(p[a], p[b - 1]) for a, b in itertools.pairwise(edges)]


class Index:
    """Side tables of a segment's runs: positions by id, by subject and by tag."""

    def __init__(self, log: Log, segment: Segment) -> None:
        self.log, self.segment = log, segment

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.log.spark.read.schema(schema).parquet(*[f"{self.log.path}/{r.path}/{name}" for r in self.segment.runs])

    @property
    def ids(self) -> DataFrame:
        return self._table("ids", "fact_id string, position long")

    @property
    def subjects(self) -> DataFrame:
        return self._table("subjects", "subject string, position long, fact_id string")

    @property
    def tags(self) -> DataFrame:
        return self._table("tags", "tag_key string, tag_value string, position long, type string")

    def by_id(self, fact_id: str) -> DataFrame:
        return self.ids.where(F.col("fact_id") == fact_id).select("position")

    def by_subject(self, subject: str) -> DataFrame:
        return self.subjects.where(F.col("subject") == subject).select("position")

    def by_tags(self, tags) -> DataFrame:
        return tag_index.positions(self.tags, tags)

    def by_tag_query(self, query, after: int | None = None) -> DataFrame:
        table = self.tags
        return tag_index.query_positions(table if after is None else table.where(F.col("position") > after), query)

    # what a condition asks

    def last_fact(self, subject: str) -> str | None:
        return self.subjects.where(F.col("subject") == subject).agg(F.max_by("fact_id", "position")).first()[0]

    def position_of(self, fact_id: str) -> int | None:
        row = self.by_id(fact_id).first()
        return row[0] if row else None

    def matches_after(self, query, after: int | None) -> bool:
        return not self.by_tag_query(query, after).isEmpty()


class Log:
    """A store's commits and data below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self._by_arrow = arrow_io.can_open(self.path)
        self._keys_by_arrow: dict[str, object] = {}
        self._lock = threading.RLock()
        self._open(self._latest_segment())

    def _open(self, segment: Segment | None) -> None:
        self._base, self._recent, self._keys, self._checked = segment, [], set(), 0
        self._tail: list[TailFact] = []
        self._tail_commits = 0

    def _latest_segment(self) -> Segment | None:
        names = self.files.names("segments")
        return Segment.from_json(self.files.read(f"segments/{names[-1]}")) if names else None

    # --- commits ---

    def snapshot(self) -> Snapshot:
        """All commits as of now. Only those published since the last call are read; nothing is listed."""
        with self._lock:
            return self._snapshot()

    def _snapshot(self) -> Snapshot:
        if len(self._recent) - self._checked >= SEGMENT_CHECK:
            self._checked = len(self._recent)
            latest = self._latest_segment()
            if latest and latest.commits > (self._base.commits if self._base else 0):
                self._open(latest)
        number = (self._base.commits if self._base else 0) + len(self._recent)
        while (text := self.files.read(f"commits/{commit_name(number)}")) is not None:
            self._recent.append(Commit.from_json(text))
            self._keys.add(self._recent[-1].key)
            number += 1
        return Snapshot(self._base, self._recent, len(self._recent))

    def applied(self, key: str) -> bool:
        """Whether a commit of the last snapshot has this key."""
        if key in self._keys:
            return True
        for run in self._base.runs if self._base else ():
            path = f"{self.path}/{run.path}/keys"
            if self._by_arrow:
                if run.path not in self._keys_by_arrow:
                    self._keys_by_arrow[run.path] = arrow_io.sorted_table(path)
                if arrow_io.holds(self._keys_by_arrow[run.path], "key", key):
                    return True
            elif not self.spark.read.schema("key string").parquet(path).where(F.col("key") == key).isEmpty():
                return True
        return False

    def publish(self, commit: Commit) -> bool:
        return self.files.publish(f"commits/{commit.name}", commit.to_json())

    # --- data ---

    def write(self, facts: tuple[FactInput, ...]) -> tuple[str, tuple[str, ...]]:
        """(batch id, fact ids) of facts written but not visible yet."""
        batch, ids = uuid.uuid4().hex, tuple(str(uuid.uuid4()) for _ in facts)
        if not facts:
            return batch, ids
        path = f"{self.path}/data/{batch}"
        rows = [
            {
                "batch_id": batch, "ordinal": i, "fact_id": fact_id, "type": f.type, "subject": f.subject,
                "payload": {"data": f.payload.data, "format": f.payload.format, "schema_ref": f.payload.schema_ref}, "metadata": dict(f.metadata), "tags": dict(f.tags),
            }
            for i, (fact_id, f) in enumerate(zip(ids, facts, strict=True))
        ]
        if self._by_arrow:
            arrow_io.write_batch(path, rows)
        else:
            self.spark.createDataFrame([{**r, "payload": {**r["payload"], "data": bytearray(r["payload"]["data"])}} for r in rows], DATA).coalesce(1).write.parquet(path)
        return batch, ids

    def tail(self, snapshot: Snapshot) -> list[TailFact] | None:
        """Facts since the last compaction, oldest first; None if they are more than TAIL_FACTS.

        Kept in memory, so that a condition on recent facts takes no Spark job.
        """
        if not self._by_arrow or snapshot.end - snapshot.compacted_end > TAIL_FACTS or snapshot.recent is not self._recent:
            return None
        with self._lock:
            for c in itertools.islice(self._recent, self._tail_commits, snapshot.count):
                if c.fact_count:
                    read = arrow_io.read_batch(f"{self.path}/data/{c.batch_id}", ["ordinal", "fact_id", "type", "subject", "tags"])
                    self._tail += [TailFact(c.first_position + r["ordinal"], r["fact_id"], r["type"], r["subject"], r["tags"] or {}) for r in sorted(read, key=lambda r: r["ordinal"])]
                self._tail_commits += 1
            return self._tail if self._tail_commits == snapshot.count else self._tail[: snapshot.end - snapshot.compacted_end]

    def index(self, snapshot: Snapshot) -> Index | None:
        """The side tables of what is compacted; None if nothing is."""
        return Index(self, snapshot.segment) if snapshot.segment and snapshot.segment.runs else None

    def _compacted(self, snapshot: Snapshot, within: list[tuple[int, int]] | None = None) -> DataFrame | None:
        """Compacted facts; ``within``: only those in some ranges of positions, from the files that hold any."""
        if not snapshot.segment:
            return None
        files = [
            f"{self.path}/{r.path}/facts/{name}" for r in snapshot.segment.runs for name, lo, hi in r.files
            if within is None or any(a <= hi and b >= lo for a, b in within)
        ]
        if not files:
            return None
        facts = self.spark.read.schema(FACTS).parquet(*files)
        if within is None:
            return facts
        position = F.col("position")
        wanted: Column | None = None
        for a, b in within:
            one = (position >= a) & (position <= b)
            wanted = one if wanted is None else wanted | one
        return facts.where(wanted)

    def recent(self, snapshot: Snapshot, after: int | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame | None:
        """Facts that aren't compacted. Bounds drop whole batches before Spark plans."""
        kept = [
            c for c in snapshot.commits
            if c.fact_count and (after is None or c.end - 1 > after) and (start is None or c.appended_at >= start) and (end is None or c.appended_at < end)
        ]
        if not kept:
            return None
        data = self.spark.read.schema(DATA).parquet(*[f"{self.path}/data/{c.batch_id}" for c in kept])
        # a row a block of a commit, so that a large commit isn't one key of a join that has to shuffle
        rows = [(c.batch_id, block, c.first_position, c.appended_at) for c in kept for block in range(-(-c.fact_count // BLOCK_FACTS))]
        commits = self.spark.createDataFrame(rows, "batch_id string, block long, first_position long, appended_at timestamp_ntz")
        if len(rows) <= BROADCAST_BLOCKS:
            commits = F.broadcast(commits)
        placed = data.withColumn("block", F.expr(f"ordinal div {BLOCK_FACTS}"))
        joined = placed.join(commits, ["batch_id", "block"]).withColumn("position", F.col("first_position") + F.col("ordinal"))
        return joined.select("position", "fact_id", "type", "subject", "appended_at", "payload", "metadata", "tags")

    def _joined(self, *parts: DataFrame | None) -> DataFrame:
        some = [p for p in parts if p is not None]
        if not some:
            return self.spark.createDataFrame([], FACTS)
        return some[0] if len(some) == 1 else some[0].unionByName(some[1])

    def facts(self, snapshot: Snapshot, after: int | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Facts of a snapshot, after a position if one is given."""
        within = None if after is None else [(after + 1, snapshot.end)]
        recent = self.recent(snapshot, after, start, end)
        return self._joined(self._compacted(snapshot, within), recent if recent is None or after is None else recent.where(F.col("position") > after))

    def narrowed(self, snapshot: Snapshot, positions, limit: int | None = None, newest: bool = False) -> DataFrame:
        """Facts of a snapshot, those compacted only where an index says that a look-up may find some.

        ``positions`` makes the positions from an ``Index``; with a limit the first or the
        newest so many are enough. More than ``INDEX_POSITIONS`` are not brought to the driver:
        a look-up with so many hits is a scan. The look-up's own predicate is still to be applied.
        """
        index = self.index(snapshot)
        if index is None:
            return self.facts(snapshot)
        found = positions(index)
        bound = INDEX_POSITIONS + 1
        if limit is not None and limit < bound:
            found, bound = found.orderBy(F.desc("position") if newest else F.asc("position")), limit
        rows = [r[0] for r in found.limit(bound).collect()]
        if len(rows) > INDEX_POSITIONS:
            return self.facts(snapshot)
        return self._joined(self._compacted(snapshot, ranges(rows)), self.recent(snapshot))

    def compact(self) -> bool:
        """Turn the commits since the last compaction into a run with its side tables; False if there are none.

        Small files of single appends become few large ones. Batches and earlier runs stay
        where they are, for older snapshots.
        """
        self._open(self._latest_segment())
        snapshot = self.snapshot()
        if not snapshot.count:
            return False
        runs, first = list(snapshot.segment.runs) if snapshot.segment else [], snapshot.compacted_end
        merged: list[Run] = []
        while runs and runs[-1].end - runs[-1].first <= GROWTH * (snapshot.end - first):
            merged.insert(0, runs.pop())
            first = merged[0].first
        older = Snapshot(Segment(0, 0, now(), tuple(merged)), (), 0) if merged else None
        facts = self._joined(self._compacted(older) if older else None, self.recent(snapshot))
        path = f"compacted/{uuid.uuid4().hex}"
        keys = self.spark.createDataFrame([(c.key,) for c in snapshot.commits], "key string")
        if merged:
            keys = keys.unionByName(self.spark.read.schema("key string").parquet(*[f"{self.path}/{r.path}/keys" for r in merged]))
        keys.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/{path}/keys")
        rows = snapshot.end - first
        ordered = spread(facts, rows, "position").sortWithinPartitions("position")
        ordered.write.option("maxRecordsPerFile", FILE_FACTS).parquet(f"{self.path}/{path}/facts")
        written = self.spark.read.schema(FACTS).parquet(f"{self.path}/{path}/facts")
        for name, columns in (("ids", ["fact_id", "position"]), ("subjects", ["subject", "position", "fact_id"])):
            spread(written.select(*columns), rows, *columns[:2]).sortWithinPartitions(*columns[:2]).write.parquet(f"{self.path}/{path}/{name}")
        tag_index.write(written, f"{self.path}/{path}/tags")
        extents = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("position").alias("lo"), F.max("position").alias("hi")).orderBy("lo").collect()  # a row a file
        run = Run(path, first, snapshot.end, tuple((r["file"], r["lo"], r["hi"]) for r in extents))
        segment = Segment(snapshot.number, snapshot.end, snapshot.last_at, (*runs, run))
        if not self.files.publish(f"segments/{commit_name(segment.commits)}", segment.to_json()):
            return False
        self._open(segment)
        return True

    def unseen_batches(self) -> list[str]:
        """Batches that no commit names: lost races, and appends still under way."""
        named = set()
        for name in self.files.names("commits"):
            named.add(Commit.from_json(self.files.read(f"commits/{name}")).batch_id)
        return [n for n in self.files.names("data") if n not in named]

    def unnamed_runs(self) -> list[str]:
        """Compacted folders that the last segment doesn't name: merged into others, or given up."""
        latest = self._latest_segment()
        named = {r.path.rpartition("/")[2] for r in latest.runs} if latest else set()
        return [n for n in self.files.names("compacted") if n not in named]


def load(log: Log, facts: DataFrame) -> Commit:
    """Append a whole frame (position, fact_id, type, subject, tags, ...) as one commit.

    For large histories from elsewhere: rows are written by the executors, in the order of
    ``position``, and no row passes through the driver. Ordinals are dense: a count by
    partition gives each partition its first one, and its rows are numbered as they are written. Ids are those of the frame.
    """
    payload = F.struct(F.lit(b"").alias("data"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("schema_ref"))
    given = facts.columns
    rows = facts.select(
        "position", "fact_id", "type", "subject", (F.col("payload") if "payload" in given else payload).alias("payload"),
        (F.col("metadata") if "metadata" in given else F.create_map().cast("map<string,string>")).alias("metadata"), "tags",
    )
    spark, batch = log.spark, uuid.uuid4().hex
    staged = f"{log.path}/staged/{batch}"
    spread(rows, facts.count(), "position").sortWithinPartitions("position").withColumn("place", F.monotonically_increasing_id()).write.parquet(staged)
    # a place is the number of a partition and, below it, that of a row in it: nothing is dealt out or sorted again
    ordered = spark.read.parquet(staged).withColumn("part", F.shiftrightunsigned("place", PLACE_BITS))
    row = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = sorted(ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    if total:
        first = spark.createDataFrame(starts, "part long, start long")
        placed = ordered.join(F.broadcast(first), "part").withColumn("ordinal", F.col("start") + row)
        placed.select(F.lit(batch).alias("batch_id"), "ordinal", "fact_id", "type", "subject", "payload", "metadata", "tags").write.option("maxRecordsPerFile", FILE_FACTS).parquet(f"{log.path}/data/{batch}")
    log.files.delete(f"staged/{batch}")
    while True:
        seen = log.snapshot()
        at = max(now(), seen.last_at) if seen.last_at else now()
        commit = Commit(seen.number, batch, str(uuid.uuid4()), at, seen.end, total)
        if log.publish(commit):
            return commit
