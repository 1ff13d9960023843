import gzip
import hashlib
import random

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from annalog.llm import queries as q
from annalog.llm import warc as w


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree_merges_sorted_runs(runs):
    runs = [sorted(r) for r in runs]
    assert list(w.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert w.url_key("HTTPS://www.Example.com:443/A/?b=2&a=1#top") == "com,example)/a?a=1&b=2"
    assert w.url_key("http://m.example.org:8080") == "org,example,m:8080)/"
    assert w.url_key("") == ")/" and w.url_key("http://[bad") == "http://[bad"


def test_parse_checks_what_it_reads():
    good = b"WARC/1.1\r\nContent-Length: 7\r\n\r\na\r\n\r\nbc\r\n\r\n"
    assert w.parse(good)[1] == b"a\r\n\r\nbc"
    for bad in (b"JUNK\r\n\r\n", good.replace(b"7", b"5"), b""):
        with pytest.raises(ValueError):
            w.parse(bad)


@given(st.lists(st.binary(min_size=1, max_size=300)))
def test_members_come_back_with_their_places(records):
    held = [gzip.compress(r) for r in records]
    parted = w.SEPARATOR.encode("latin-1").join(held)
    got = list(w.members(parted))
    assert [r for _, r in got] == records and gzip.decompress(parted) == b"".join(records)
    assert all(parted[at:].startswith(m) for (at, _), m in zip(got, held, strict=True))
    if held:
        with pytest.raises(ValueError):
            list(w.members(held[0][:-1]))


BIG = "é" * 60  # 120 bytes
AT_LEAST, UNDER = "x" * 100, "x" * 99


def rows():
    rng = random.Random(3)
    out = [
        (5, "http://b.com/", BIG), (3, "http://a.com/x", BIG), (9, "http://a.com/x", BIG), (1, "http://a.com/", AT_LEAST), (2, None, AT_LEAST), (4, "u", UNDER), (6, "u", UNDER),
        (7, "http://a.com/%0A\n\r%", None), (8, "http://c.com/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 5), (10, "", "\r\n\r\n"), (11, "http://a.com/x", ""), (None, "gone", "gone"),
    ]
    out += [(100 + i, f"http://host{rng.randrange(5)}.com/{rng.randrange(9)}", f"page {i} " * 40) for i in range(60)]
    out += [(200 + i, "http://hot.com/", "hot " * 50) for i in range(40)]
    return [(*r, f"2024-01-01T00:{(r[0] or 0) % 7:02d}:00Z", "more") for r in out]


def test_archives_come_back_whole_and_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 2000)  # many runs to merge, in many ranges
    monkeypatch.setattr(w, "RANGE_ROWS", 9)
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string, captured string, digest string").repartition(4)
    path = f"file://{tmp_path}/archive"
    got = w.archive(pages, path).collect()
    want = {r[0]: r for r in rows()}
    assert len(got) == len(want)
    first = {}
    for i, r in sorted(want.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault((r[2] or "").encode(), i)
    for r in got:
        _, url, html, captured, _ = want[r["page_id"]]
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and first[raw] != r["page_id"]
        assert (r["url"], r["captured"], r["payload_bytes"], r["payload_digest"]) == (url or "", captured, len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[raw]) if revisit else ("response", None))
    by_rank = sorted(got, key=lambda r: r["rank"])
    keys = [(r["url_key"], r["captured"], r["page_id"] or -1) for r in by_rank]
    assert keys == sorted(keys) and [r["rank"] for r in by_rank] == list(range(1, len(got) + 1))
    # a place is where the record's own gzip member begins
    files = {f"{p.parent.name}/{p.name}": p.read_bytes() for p in (tmp_path / "archive").rglob("*.txt")}
    assert len(files) > 4 and all(len(f) < 2000 + 40 * len(rows()) or len(list(w.members(f))) == 1 for f in files.values())
    for r in got:
        record = next(w.members(files[r["archive"]][r["place"] :]))[1]
        head, block = w.parse(record)
        assert head["WARC-Record-ID"] == f"<urn:page:{'none' if r['page_id'] is None else r['page_id']}>"
        if r["record_type"] == "response":
            assert block.startswith(b"HTTP/1.1 200 OK\r\n") and w.payload(block) == (want[r["page_id"]][2] or "").encode()


def test_ids_that_are_null(spark):
    pages = spark.createDataFrame([(None, "u", BIG, "t"), (None, "v", BIG, "t"), (7, "u", BIG, "t"), (None, None, AT_LEAST, "t"), (None, None, AT_LEAST, "t")], "page_id long, url string, html string, captured string")
    got = sorted((r["page_id"] or 0, r["url"], r["record_type"], r["refers_to"] or 0) for r in w.archive(pages).collect())
    assert got == [(0, "", "response", 0), (0, "", "response", 0), (0, "u", "revisit", 7), (0, "v", "revisit", 7), (7, "u", "response", 0)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, captured string")
    assert w.archive(none).count() == 0


def test_repeated_ids(spark):
    pages = spark.createDataFrame([(1, "u", BIG, "t"), (1, "u", BIG, "t"), (2, "u", BIG, "t"), (2, "v", "other", "t")], "page_id long, url string, html string, captured string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in w.archive(pages).select("page_id", "record_type", "refers_to").fillna(0).collect())
    assert got == [(1, "response", 0), (1, "response", 0), (2, "response", 0), (2, "revisit", 1)]


def test_the_query_agrees_with_its_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{data}/pages.parquet')")
    want = con.execute(q.OP7_SQL).df().sort_values("page_id").reset_index(drop=True)
    got = q.op7_warc_index(spark, data).toPandas().sort_values("page_id").reset_index(drop=True)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert got[cols].astype(object).where(got[cols].notna(), None).astype(str).equals(want[cols].astype(object).where(want[cols].notna(), None).astype(str))
