"""The store's reads as queries over the test tables, each with its SQL equivalent.

``position`` is a log's order and shows it in results that have no order of their own;
limited reads add ``rn``, the place in the result. Those named ``store_`` load a table
into a log of a real store, append to it and compact it, and read through the facade.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalog.functions import parse
from annalog.functions.columns import has_tags, payload_text, text_of, to_the_second, wire_message
from annalog.operators import reads, tag_index
from annalog.plans import conditions
from annalog.sources.log import Log, load
from annalog.store import Annals
from annalog.sources.tables import ACTIVITY, DIALOGUE, ORDERS, STORES
from annalog.streaming.source import read_stream
from annalog.values import (
    After,
    AllOf,
    AppendRequest,
    Direction,
    ExpectedLastFact,
    FactInput,
    NoCondition,
    NoMatch,
    Payload,
    TagQuery,
    TagsOnly,
    TimeRange,
    TypesAndTags,
)

Query = Callable[[SparkSession, str], DataFrame]
BACK = Direction.BACKWARD
SHOWN = ["position", "fact_id", "type", "subject"]

#: The views in SQL.
WITH = """with activity as (select event_id as position, 'e-' || event_id as fact_id, event_type as type, 'user/' || user_id as subject, ts as appended_at,
  cast(user_id as varchar) as t_user, json_extract_string(props, '$.k') as t_k from events),
purchases as (select o_orderkey as position, 'o-' || o_orderkey as fact_id, o_orderstatus as type, 'customer/' || o_custkey as subject, o_orderdate as appended_at,
  o_orderpriority as t_priority from orders),
dialogue as (select conv_id * 1000000 + turn as position, 'c-' || conv_id || '-' || turn as fact_id, role as type, 'conv/' || conv_id as subject, cast(turn as varchar) as t_turn from conversations)
"""
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = WITH + sql
        return f

    return add


def _shown(facts: DataFrame) -> DataFrame:
    return facts.select(*SHOWN)


def _numbered(limited: DataFrame, *order) -> DataFrame:
    """``limited``, a few rows, with their places."""
    return limited.select(*SHOWN, F.row_number().over(Window.orderBy(*order)).alias("rn"))


_COLS = "position, fact_id, type, subject"

FEW = TagQuery(TypesAndTags({"click", "purchase"}, {"k": "87"}), TagsOnly({"user": "13"}))
FEW_SQL = "(type in ('click', 'purchase') and t_k = '87') or t_user = '13'"


@_query(f"select {_COLS} from activity where {FEW_SQL}")
def query_or_items(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tag_query(ACTIVITY.read(spark, d), FEW))


@_query(f"select {_COLS} from activity where fact_id = 'e-500'")
def find_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_id(ACTIVITY.read(spark, d, fact_id="e-500"), "e-500"))


@_query("select count(*) > 0 as found from activity where fact_id = 'e-501'")
def exists_by_id(spark: SparkSession, d: str) -> DataFrame:
    return reads.exists_by_id(ACTIVITY.read(spark, d, fact_id="e-501"), "e-501")


@_query("select count(*) > 0 as found from activity where fact_id = 'nobody'")
def exists_by_unknown_id(spark: SparkSession, d: str) -> DataFrame:
    return reads.exists_by_id(ACTIVITY.read(spark, d, fact_id="nobody"), "nobody")


@_query(f"select {_COLS} from activity where subject = 'user/7'")
def subject_forward(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_subject(ACTIVITY.read(spark, d, subject="user/7"), "user/7"))


@_query(f"select {_COLS}, row_number() over (order by position desc) as rn from activity where subject = 'user/7' order by position desc limit 5")
def subject_backward_limit(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(reads.by_subject(ACTIVITY.read(spark, d, subject="user/7"), "user/7", 5, BACK), F.desc("position"))


_FROM, _TO = datetime(2024, 1, 5), datetime(2024, 1, 8)


@_query(f"select {_COLS} from activity where appended_at >= timestamp '2024-01-05' and appended_at < timestamp '2024-01-08'")
def time_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.in_time_range(ACTIVITY.read(spark, d), TimeRange(_FROM, _TO)))


@_query(f"select {_COLS} from activity where appended_at >= timestamp '2024-01-05' and appended_at < timestamp '2024-01-08'")
def time_zoned_bounds(spark: SparkSession, d: str) -> DataFrame:
    """One bound with a zone, one from text: both are instants."""
    span = TimeRange(datetime(2024, 1, 5, 2, tzinfo=timezone(timedelta(hours=2))), parse.instant("2024-01-07T23:00:00-01:00"))
    return _shown(reads.in_time_range(ACTIVITY.read(spark, d), span))


@_query(f"select {_COLS} from activity where appended_at >= timestamp '2024-01-05'")
def time_from(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.in_time_range(ACTIVITY.read(spark, d), TimeRange(_FROM, None)))


@_query(f"select {_COLS} from activity where appended_at < timestamp '2024-01-08'")
def time_until(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.in_time_range(ACTIVITY.read(spark, d), TimeRange(None, _TO)))


@_query(f"select {_COLS} from activity")
def time_unbounded(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.in_time_range(ACTIVITY.read(spark, d), TimeRange()))


@_query(
    f"select {_COLS}, row_number() over (order by appended_at desc, position desc) as rn from purchases where appended_at < timestamp '1996-01-01' order by appended_at desc, position desc limit 20"
)
def time_backward_limit(spark: SparkSession, d: str) -> DataFrame:
    """On orders, whose dates don't rise with their keys: time order isn't log order."""
    facts = reads.in_time_range(ORDERS.read(spark, d), TimeRange(None, datetime(1996, 1, 1)), 20, BACK)
    return _numbered(facts, F.desc("appended_at"), F.desc("position"))


@_query(f"select {_COLS}, row_number() over (order by appended_at, position) as rn from purchases where appended_at >= timestamp '1995-03-01' order by appended_at, position limit 20")
def time_forward_limit(spark: SparkSession, d: str) -> DataFrame:
    facts = reads.in_time_range(ORDERS.read(spark, d), TimeRange(datetime(1995, 3, 1), None), 20)
    return _numbered(facts, "appended_at", "position")


@_query(f"select {_COLS} from purchases where t_priority = '1-URGENT'")
def tags_single(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tags(ORDERS.read(spark, d), {"priority": "1-URGENT"}))


@_query(f"select {_COLS} from activity where t_user = '13' and t_k = '87'")
def tags_multi_and(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tags(ACTIVITY.read(spark, d), {"user": "13", "k": "87"}))


@_query(f"select {_COLS} from activity where false")
def tags_no_match(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tags(ACTIVITY.read(spark, d), {"nothing": "here"}))


@_query(f"select {_COLS}, row_number() over (order by position desc) as rn from purchases where t_priority = '5-LOW' order by position desc limit 10")
def tags_backward_limit(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(reads.by_tags(ORDERS.read(spark, d), {"priority": "5-LOW"}, 10, BACK), F.desc("position"))


@_query(f"select {_COLS}, row_number() over (order by position desc) as rn from activity where t_user = '13' and t_k = '87' order by position desc limit 10")
def tags_multi_backward_limit(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(reads.by_tags(ACTIVITY.read(spark, d), {"user": "13", "k": "87"}, 10, BACK), F.desc("position"))


@_query(f"select {_COLS} from activity where type = 'click' and t_k = '87'")
def query_type_tag(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tag_query(ACTIVITY.read(spark, d), TagQuery(TypesAndTags({"click"}, {"k": "87"}))))


@_query(f"select {_COLS} from activity where type in ('click', 'error', 'view') and t_k = '12'")
def query_multi_type(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tag_query(ACTIVITY.read(spark, d), TagQuery(TypesAndTags({"click", "error", "view"}, {"k": "12"}))))


@_query(f"select {_COLS} from activity where type in (select type from activity where position = 500) and t_k in (select t_k from activity where position = 500) and t_user in (select t_user from activity where position = 500)")
def query_multi_tag(spark: SparkSession, d: str) -> DataFrame:
    """The type and both tags of fact 500, which is found at least."""
    one = ACTIVITY.read(spark, d, fact_id="e-500").first()
    return _shown(reads.by_tag_query(ACTIVITY.read(spark, d), TagQuery(TypesAndTags({one["type"]}, one["tags"]))))


@_query(f"select {_COLS} from activity where t_k = '3' and t_user = '21'")
def query_tag_only_multi(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tag_query(ACTIVITY.read(spark, d), TagQuery(TagsOnly({"k": "3", "user": "21"}))))


@_query(f"select {_COLS} from activity where t_user = '13' or (type = 'click' and t_user = '13') or t_k = '1'")
def query_overlapping_items(spark: SparkSession, d: str) -> DataFrame:
    """Facts that match several items are found once."""
    query = TagQuery(TagsOnly({"user": "13"}), TypesAndTags({"click"}, {"user": "13"}), TagsOnly({"k": "1"}))
    return _shown(reads.by_tag_query(ACTIVITY.read(spark, d), query))


@_query(f"select {_COLS} from activity where false")
def query_no_match(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tag_query(ACTIVITY.read(spark, d), TagQuery(TypesAndTags({"click"}, {"k": "none"}))))


@_query(f"select {_COLS} from dialogue where type = 'assistant' and t_turn = '1'")
def query_dialogue(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.by_tag_query(DIALOGUE.read(spark, d), TagQuery(TypesAndTags({"assistant"}, {"turn": "1"}))))


@_query("select subject, arg_max(fact_id, position) as fact_id, max(position) as position from activity group by subject")
def last_fact_per_subject(spark: SparkSession, d: str) -> DataFrame:
    return reads.last_per_subject(ACTIVITY.read(spark, d))


@_query("select max(position) as head from activity")
def head_position(spark: SparkSession, d: str) -> DataFrame:
    return reads.head(ACTIVITY.read(spark, d))


CONFLICT = TagQuery(TypesAndTags({"purchase"}, {"user": "13"}))


def _holds(spark: SparkSession, **cases: bool) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in cases.items()], "condition string, holds boolean")


@_query(
    """select 'last' as condition, (select max(position) from activity where subject = 'user/13') = (select max(position) from activity where type = 'click' and subject = 'user/13') as holds
    union all select 'none', not exists (select * from activity where subject = 'user/nobody') union all select 'some', not exists (select * from activity where subject = 'user/13')"""
)
def expected_last_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a subject's last click is its last fact, and whether it has none."""
    facts = ACTIVITY.read(spark, d)
    click = conditions.last_fact(facts.where("type = 'click'"), "user/13")
    held = lambda subject, fact_id=None: conditions.holds(ExpectedLastFact(subject, fact_id), conditions.Scan(facts))
    return _holds(spark, last=held("user/13", click), none=held("user/nobody"), some=held("user/13"))


@_query("select 'conflict' as condition, count(*) filter (where type = 'purchase' and t_user = '13') = 0 as holds from activity union all select 'free', count(*) filter (where type = 'purchase' and t_user = 'none') = 0 from activity")
def condition_tag_query_no_cursor(spark: SparkSession, d: str) -> DataFrame:
    base = conditions.Scan(ACTIVITY.read(spark, d))
    free = TagQuery(TypesAndTags({"purchase"}, {"user": "none"}))
    return _holds(spark, conflict=conditions.holds(NoMatch(CONFLICT), base), free=conditions.holds(NoMatch(free), base))


@_query(
    """select 'early' as condition, count(*) filter (where type = 'purchase' and t_user = '13' and position > 1) = 0 as holds from activity
    union all select 'late', count(*) filter (where type = 'purchase' and t_user = '13' and position > (select max(position) - 20 from activity)) = 0 from activity
    union all select 'unknown', false"""
)
def condition_tag_query_after(spark: SparkSession, d: str) -> DataFrame:
    """The cursor is a fact's id; an unknown one violates the condition."""
    facts = ACTIVITY.read(spark, d)
    late = facts.where(F.col("position") == reads.head(facts).first()[0] - 20).first()["fact_id"]
    held = lambda cursor: conditions.holds(NoMatch(CONFLICT, cursor), conditions.Scan(facts))
    return _holds(spark, early=held("e-1"), late=held(late), unknown=held("e-none"))


@_query(
    """select 'both' as condition, count(*) filter (where t_user = 'none') = 0 and count(*) filter (where subject = 'user/nobody') = 0 as holds from activity
    union all select 'one', count(*) filter (where t_user = 'none') = 0 and count(*) filter (where type = 'purchase' and t_user = '13') = 0 from activity"""
)
def condition_all(spark: SparkSession, d: str) -> DataFrame:
    base = conditions.Scan(ACTIVITY.read(spark, d))
    free = NoMatch(TagQuery(TagsOnly({"user": "none"})))
    return _holds(spark, both=conditions.holds(AllOf(free, ExpectedLastFact("user/nobody")), base), one=conditions.holds(AllOf(free, NoMatch(CONFLICT)), base))


@_query(f"select {_COLS} from activity")
def replay_all(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.between(ACTIVITY.read(spark, d), None, None))


@_query(f"select {_COLS} from activity where position > 600 and position <= 950")
def replay_after(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.in_log_order(reads.between(ACTIVITY.read(spark, d), 600, 950)))


@_query(f"select {_COLS} from activity where position > 950 and position <= 950")
def replay_empty_delta(spark: SparkSession, d: str) -> DataFrame:
    return _shown(reads.between(ACTIVITY.read(spark, d), 950, 950))


@_query(f"select {_COLS} from activity where t_user = '13' and t_k = '87'")
def tag_index_intersection(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as ``tags_multi_and``, by lists of positions."""
    facts = ACTIVITY.read(spark, d)
    return _shown(tag_index.lookup(facts, tag_index.positions(tag_index.entries(facts), {"user": "13", "k": "87"})))


@_query(f"select {_COLS} from activity where {FEW_SQL}")
def tag_index_union(spark: SparkSession, d: str) -> DataFrame:
    facts = ACTIVITY.read(spark, d)
    return _shown(tag_index.lookup(facts, tag_index.query_positions(tag_index.entries(facts), FEW)))


@_query("select 'activity' as store, (select count(*) from activity where fact_id = 'o-32') as hits union all select 'orders', (select count(*) from purchases where fact_id = 'o-32')")
def store_isolation(spark: SparkSession, d: str) -> DataFrame:
    """An id of one store isn't found in another."""
    parts = [STORES[n].read(spark, d, fact_id="o-32").agg(F.count("*").alias("hits")).select(F.lit(n).alias("store"), "hits") for n in ("activity", "orders")]
    return parts[0].unionByName(parts[1])


@_query("select fact_id, type, subject, strftime(date_trunc('second', appended_at), '%Y-%m-%dT%H:%M:%SZ') as at, t_user as user_tag from activity")
def project_rows(spark: SparkSession, d: str) -> DataFrame:
    """The text table's projection: time to the second, and a tag by its key."""
    return ACTIVITY.read(spark, d).select("fact_id", "type", "subject", to_the_second().alias("at"), F.col("tags")["user"].alias("user_tag"))


@_query("select position, epoch_us(appended_at) // 1000000 as seconds, (epoch_us(appended_at) % 1000000) * 1000 as nanos from activity")
def project_wire(spark: SparkSession, d: str) -> DataFrame:
    """An instant as seconds and nanoseconds, as the wire message has it."""
    empty = F.struct(F.lit(b"").alias("data"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("schema_ref"))
    facts = ACTIVITY.read(spark, d).withColumn("payload", empty).withColumn("metadata", F.create_map().cast("map<string,string>"))
    return facts.select("position", *wire_message()).select("position", "appended_at.seconds", F.col("appended_at.nanos").cast("long").alias("nanos"))


@_query(
    "select position, type || ' ' || subject as decoded, case when position % 2 = 0 then t_user else t_user || '!' end as given, "
    "case when position % 3 = 0 then chr(65533) || chr(65533) || type else type end as shown from activity"
)
def project_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Base64 to text, text that isn't base64 as it is, and bytes that aren't UTF-8 without a failure."""
    facts = ACTIVITY.read(spark, d)
    encoded = F.base64(F.concat_ws(" ", "type", "subject").cast("binary"))
    number = F.col("tags")["user"]
    # a number as base64 would be other text, or none: held against what isn't base64 and what isn't UTF-8
    given = F.when(F.col("position") % 2 == 0, F.concat(F.lit("~"), number)).otherwise(F.concat(F.lit("~"), number, F.lit("!")))
    broken = F.when(F.col("position") % 3 == 0, F.concat(F.lit(b"\xff\xfe"), F.col("type").cast("binary"))).otherwise(F.col("type").cast("binary"))
    return facts.select("position", payload_text(encoded).alias("decoded"), F.substring(payload_text(given), 2, 100).alias("given"), text_of(broken).alias("shown"))


@_query("select (select count(*) from activity where t_user = '13') as with_tag, (select count(*) from activity where not coalesce(t_user = '13', false)) as without_tag")
def tag_negation(spark: SparkSession, d: str) -> DataFrame:
    """A tag predicate is never null, so its negation holds for every other fact."""
    match = has_tags({"user": "13"})
    return ACTIVITY.read(spark, d).agg(F.count_if(match).alias("with_tag"), F.count_if(~match).alias("without_tag"))


# --- a real store -------------------------------------------------------------------

_STORES: dict[tuple[str, str], Annals] = {}


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a machine's own only where that machine is all there is."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"annalog-{name}-")


def _loaded(spark: SparkSession, d: str) -> Annals:
    """A store ``activity`` with the table's facts: all but the last tenth compacted, then two runs more, then a commit.

    Kept for the session: the entries that use it only read.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        store = Annals(spark, _scratch(spark, "store"))
        store.create_store("activity")
        log, facts = store.log("activity"), ACTIVITY.read(spark, d)
        head = reads.head(facts).first()[0]
        edges = [None, head * 9 // 10, head * 19 // 20, head * 39 // 40, head]
        for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            load(log, reads.between(facts, low, high))
            if i < 3:
                log.compact()
        _STORES[key] = store
    return _STORES[key]


_ROWS = "row_number() over (order by position) as position, fact_id, type, subject"
_LOGGED = f"(select {_ROWS}, t_user, t_k from activity) as logged"


@_query(f"select {_COLS} from {_LOGGED} where fact_id in ('e-500', 'e-990')")
def store_find_by_id(spark: SparkSession, d: str) -> DataFrame:
    """By the side table of ids, each of two facts in a look-up of its own."""
    store = _loaded(spark, d)
    found = [store.find_by_id("activity", i).value.asDict(recursive=True) for i in ("e-500", "e-990")]
    return spark.createDataFrame([tuple(f[c] for c in SHOWN) for f in found], "position long, fact_id string, type string, subject string")


@_query(f"select {_COLS} from {_LOGGED} where subject = 'user/7'")
def store_subject(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_loaded(spark, d).find_by_subject("activity", "user/7").value)


@_query(f"select {_COLS}, row_number() over (order by position desc) as rn from {_LOGGED} where subject = 'user/7' order by position desc limit 5")
def store_subject_backward_limit(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(_loaded(spark, d).find_by_subject("activity", "user/7", 5, BACK).value, F.desc("position"))


@_query(f"select {_COLS} from {_LOGGED} where t_user = '13' and t_k = '87'")
def store_tags(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_loaded(spark, d).find_by_tags("activity", {"user": "13", "k": "87"}).value)


@_query(f"select {_COLS} from {_LOGGED} where {FEW_SQL}")
def store_tag_query(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_loaded(spark, d).find_by_tag_query("activity", FEW).value)


@_query(f"select {_COLS} from {_LOGGED} where position > (select position from {_LOGGED} where fact_id = 'e-600')")
def store_replay_after(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_loaded(spark, d).replay("activity", After("e-600")).value)


@_query(
    f"""select 'last' as condition, true as holds union all select 'other', false union all select 'no_subject', true
    union all select 'match', (select count(*) from {_LOGGED} where type = 'purchase' and t_user = '13') = 0
    union all select 'match_after', (select count(*) from {_LOGGED} where type = 'purchase' and t_user = '13' and position > (select max(position) - 20 from {_LOGGED})) = 0
    union all select 'unknown', false union all select 'all', false"""
)
def store_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions held against side tables and recent facts, as an append would hold them."""
    store = _loaded(spark, d)
    mine = store.find_by_subject("activity", "user/7", 2, BACK).value.collect()
    late = store.facts("activity").value.orderBy(F.desc("position")).limit(21).collect()[-1]["fact_id"]
    ask = lambda condition: store.condition_holds("activity", condition)
    last = ExpectedLastFact("user/7", mine[0]["fact_id"])
    return _holds(
        spark, last=ask(last), other=ask(ExpectedLastFact("user/7", mine[1]["fact_id"])), no_subject=ask(ExpectedLastFact("user/nobody")),
        match=ask(NoMatch(CONFLICT)), match_after=ask(NoMatch(CONFLICT, late)), unknown=ask(NoMatch(CONFLICT, "e-none")), all=ask(AllOf(last, NoMatch(CONFLICT))),
    )


@_query(
    """select * from (values (1, 'Appended', 2), (2, 'AlreadyApplied', 2), (3, 'ConditionViolated', 2), (4, 'Appended', 3), (5, 'Appended', 4), (6, 'ConditionViolated', 4),
    (7, 'Appended', 5), (8, 'AlreadyApplied', 5), (9, 'StoreNotFound', 5)) as t(step, outcome, head)"""
)
def store_appends(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of appends in turn, with a compaction between, and the head after each."""
    store = Annals(spark, _scratch(spark, "appends"))
    store.create_store("main")
    one = lambda kind, subject, **tags: FactInput(kind, subject, Payload(b"{}"), tags=tags)
    once, free, later = str(uuid.uuid4()), str(uuid.uuid4()), str(uuid.uuid4())
    steps = []

    def step(request: AppendRequest, name: str = "main"):
        done = store.append_request(name, request)
        steps.append((len(steps) + 1, type(done).__name__, reads.head(store.facts("main").value).first()[0]))
        return done

    first = step(AppendRequest((one("placed", "order/1", region="eu"), one("placed", "order/2", region="us")), NoCondition(), once))
    step(AppendRequest((one("placed", "order/3"),), NoCondition(), once))
    step(AppendRequest((one("paid", "order/1"),), ExpectedLastFact("order/1", first.fact_ids[1]), free))
    step(AppendRequest((one("paid", "order/1"),), ExpectedLastFact("order/1", first.fact_ids[0]), free))  # the key was left free
    store.compact("main")
    step(AppendRequest((one("paid", "order/2", region="us"),), NoMatch(TagQuery(TypesAndTags({"paid"}, {"region": "us"})))))
    step(AppendRequest((one("paid", "order/2", region="us"),), NoMatch(TagQuery(TypesAndTags({"paid"}, {"region": "us"})))))
    step(AppendRequest((one("sent", "order/1"),), AllOf(ExpectedLastFact("order/9"), NoMatch(TagQuery(TagsOnly({"region": "eu"})), first.fact_ids[0])), later))
    store.compact("main")
    step(AppendRequest((one("sent", "order/1"),), NoCondition(), later))
    step(AppendRequest((one("sent", "order/1"),)), "none")
    return spark.createDataFrame(steps, "step int, outcome string, head int")


@_query(
    """select * from (values (1, 'create activity', 'StoreCreated', 'activity'), (2, 'create activity', 'StoreNameTaken', 'activity'), (3, 'create orders', 'StoreCreated', 'activity,orders'),
    (4, 'exists orders', 'Exists', 'activity,orders'), (5, 'exists dialogue', 'DoesNotExist', 'activity,orders'), (6, 'find orders', 'Found', 'activity,orders'), (7, 'find dialogue', 'NotFound', 'activity,orders'),
    (8, 'remove orders', 'StoreRemoved', 'activity'), (9, 'remove orders', 'StoreNotFound', 'activity'), (10, 'create orders', 'StoreCreated', 'activity,orders')) as t(step, call, outcome, names)"""
)
def store_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Stores made, found, listed and removed."""
    store = Annals(spark, _scratch(spark, "catalog"))
    calls = {"create": store.create_store, "exists": store.store_exists, "find": store.find_store, "remove": store.remove_store}
    steps = []
    for call in ("create activity", "create activity", "create orders", "exists orders", "exists dialogue", "find orders", "find dialogue", "remove orders", "remove orders", "create orders"):
        verb, name = call.split()
        outcome = type(calls[verb](name)).__name__
        steps.append((len(steps) + 1, call, outcome, ",".join(s.name for s in store.list_stores())))
    return spark.createDataFrame(steps, "step int, call string, outcome string, names string")


@_query("select 'activity' as name, (select count(*) from activity) as n, 0 as n_after union all select 'orders', (select count(*) from purchases), (select count(*) from purchases)")
def list_stores(spark: SparkSession, d: str) -> DataFrame:
    """Each store of a catalog with the number of its facts, before and after one is removed and made again."""
    store = Annals(spark, _scratch(spark, "list"))
    for name in ("activity", "orders"):
        store.create_store(name)
        load(store.log(name), STORES[name].read(spark, d))
    sizes = lambda: {s.name: store.facts(s.name).value.count() for s in store.list_stores()}
    before = sizes()
    store.remove_store("activity")
    store.create_store("activity")
    after = sizes()
    return spark.createDataFrame([(n, before[n], after[n]) for n in sorted(before)], "name string, n long, n_after int")


@_query("select name, name = 'activity' as found from (values ('activity'), ('dialogue')) as s(name)")
def store_exists(spark: SparkSession, d: str) -> DataFrame:
    store = _loaded(spark, d)
    return spark.createDataFrame([(n, type(store.store_exists(n)).__name__ == "Exists") for n in ("activity", "dialogue")], "name string, found boolean")


def _streamed(spark: SparkSession, log: Log, after: int, most: int) -> DataFrame:
    root = _scratch(spark, "stream")
    stream = read_stream(spark, log.path, after, most).select(*SHOWN, F.col("tags")["user"].alias("user_tag"))
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@_query(f"select {_ROWS}, t_user as user_tag from activity")
def subscribe_available_now(spark: SparkSession, d: str) -> DataFrame:
    """Facts of ``activity`` appended to a store of its own, then read as a stream until its end.

    The table keeps its order through the append; the stream's rows land in a table.
    """
    log = Log(spark, f"{_scratch(spark, 'stream')}/log")
    load(log, ACTIVITY.read(spark, d))
    return _streamed(spark, log, 0, 4000)


@_query(f"select {_COLS}, t_user as user_tag from {_LOGGED} where position > 300")
def subscribe_compacted(spark: SparkSession, d: str) -> DataFrame:
    """A stream from a position on, over three runs and a commit."""
    return _streamed(spark, _loaded(spark, d).log("activity"), 300, 1000)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
