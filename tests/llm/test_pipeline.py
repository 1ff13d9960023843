"""The pipeline against a plain version of each stage over the whole corpus, in order."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as p
from annalog.llm import bytescan as bs
from annalog.llm import line_dedup as ld
from annalog.llm import mixing
from annalog.llm import quality_rules as q

from . import test_decontaminate, test_quality_rules, test_simhash
from .conftest import words


def corpus():
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{k}" for a in ("ba", "ro", "ti") for b in ("lo", "ne") for k in range(60)]

    def prose(n):
        out = []
        for i in range(n):
            w = rng.choice(["the", "of", "and"]) if i % 4 == 0 else rng.choice(vocabulary)
            out.append(w.capitalize() if i % 11 == 0 else w + ("." if i % 11 == 10 else ""))
        return " ".join(out)

    bench = [(i, prose(30)) for i in range(4)]
    passage = prose(80)
    rows = [(i, prose(rng.randrange(40, 160)), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, prose(30) + " " + passage + " " + prose(60), "s1") for i in range(4)]
    rows += [(200 + i, rows[7][1], "hot") for i in range(6)]  # copies
    short = [prose(18), prose(20)]
    rows += [(300 + i, short[i % 2], "hot") for i in range(6)]  # too short to be a run, but alike
    rows += [(400 + i, prose(50) + " " + bench[i][1] + " " + prose(50), "s2") for i in range(3)]
    rows += [(500 + i, " | ".join(f"Cell{rng.randrange(10**6)}" for _ in range(60)), "s3") for i in range(9)]
    rows += [(600, None, None), (601, "", "s0"), (602, "too short", "s0"), (603, "again and again " * 30, "s0"), (604, prose(70), None)]
    return [(i, t, "xx", s, len(t or "")) for i, t, s in rows], bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, bench = corpus()
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def plain_quality(rows):
    """Vote patterns from brute-force figures, then the estimate over their counts."""
    stop = {w.encode() for w in q.FUNCTION_WORDS}
    seen = []
    for r in rows:
        n, chars, symbols, dup, again = test_quality_rules.brute(r[1])
        w, text = [x.lower() for x in words(r[1])], r[1] or ""
        n_lines = sum(bool(x.strip(" \t\v\f\r")) for x in text.split("\n"))
        env = dict(n_words=n, word_chars=chars, n_symbols=symbols, n_dup_lines=dup, n_repeat_words=again, n_lines=n_lines, n_distinct=len(set(w)), n_function=sum(x in stop for x in w), n_stops=sum(text.count(c) for c in ".!?"))
        holds = lambda rule, env=env: bool(eval(re.sub(r"(\w+) between (.+) and (.+)", r"\2 <= \1 <= \3", rule.replace("false", "False")), {}, env))  # noqa: E731, S307
        vote = "".join("b" if holds(bad) else "g" if holds(good) else "-" for _, bad, good in q.RULES)
        seen.append((r, vote, n < 10 or 100 * again > 20 * n))
    votes = [v for _, v, _ in seen]
    posterior = q.estimate(sorted(set(votes)), [votes.count(v) for v in sorted(set(votes))])
    return [r for r, v, failed in seen if not failed and posterior[v] >= 0.5]


def plain_lines(rows):
    """First occurrences in a dictionary, runs by comparing lines one by one."""
    parsed = {}
    for i, text, *_ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        h, starts, n, first = ld.lines(data, offsets)
        begin, stop = ld.grams(h, n, first)
        g = bs.range_hash(h, begin, stop)
        pick = ld.winnow(g, np.concatenate([[0], np.cumsum(n)])[begin], np.zeros(len(begin), int))
        own = [data[a:b].tobytes().split() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
        parsed[i] = (own, n, starts, [(int(begin[k]), int(stop[k])) for k in pick], text)
    first = {}
    for i in sorted(parsed):
        for a, b in sorted(parsed[i][3]):
            first.setdefault(str(parsed[i][0][a:b]), (i, a, b))
    out = []
    for r in rows:
        own, n, starts, picks, text = parsed[r[0]]
        gone = [False] * len(own)
        for a, b in picks:
            j, c, e = first[str(own[a:b])]
            if (j, c) == (r[0], a):
                continue
            other = parsed[j][0]
            x = y = 0
            while x < ld.REACH and a - x > 0 and c - x > 0 and own[a - x - 1] == other[c - x - 1]:
                x += 1
            while y < ld.REACH and b + y < len(own) and e + y < len(other) and own[b + y] == other[e + y]:
                y += 1
            gone[a - x : b + y] = [True] * (b + y - a + x)
        raw, kept, k, changed = text.encode(), b"", 0, False
        ends = [*starts[1:].tolist(), len(raw)]
        while k < len(own):
            e = k
            while e < len(own) and gone[e] == gone[k]:
                e += 1
            delete = gone[k] and sum(n[k:e]) >= ld.MIN_WORDS
            changed |= delete
            if not delete:
                kept += raw[0 if k == 0 else starts[k] : ends[e - 1]]
            k = e
        done = kept.decode()
        if done.split() or not changed:
            out.append((r[0], done if changed else text, *r[2:4], len(done) if changed else r[4]))
    return out


def plain_near(rows):
    prints = {r[0]: test_simhash.brute_print(r[1]) for r in rows}
    root = test_simhash.brute_classes(list(prints.values()))
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    return [r for r in rows if least[root[prints[r[0]]]] == r[0]]


def rows_of(frame):
    return sorted(map(tuple, frame.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_each_stage_is_its_plain_version(spark, tables):
    rows, bench = corpus()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for (name, stage), plain in zip(p.STAGES, (plain_quality, plain_lines, plain_near, lambda rs: [r for r in rs if not test_decontaminate.brute(r[1], bench)[1]], None), strict=True):
        out = p.cut(stage(spark, docs, tables), "test")
        if plain is None:
            break
        before, rows = len(rows), plain(rows)
        assert out.schema == docs.schema and rows_of(out) == sorted(rows), name
        assert len(rows) < before, name  # each has something to do here
        docs = out
    size = lambda r: len(words(r[1]))
    got = [tuple(r) for r in out.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert set(got) <= set(rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    sizes = [sum(size(r) for r in rows if r[3] == n) for n in names]
    want = mixing.targets(sizes, [[3, 1, 2][i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    for n, t in zip(names, want, strict=True):
        taken = sum(size(r) for r in got if r[3] == n)
        assert abs(taken - t) <= max(size(r) for r in rows if r[3] == n) / 2


def test_run_is_the_stages_in_order(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in p.STAGES:
        docs = p.cut(stage(spark, docs, tables), "test")
    want = sorted(map(tuple, docs.collect()), key=str)
    assert sorted(map(tuple, p.run(spark, tables).collect()), key=str) == want


def test_clean_documents_stay(spark, tables):
    kept = {r["doc_id"] for r in p.run(spark, tables).collect()}
    gone = set(range(60)) - kept
    # the mix may leave some out of one source; no filter does
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in p.STAGES[:4]:
        docs = p.cut(stage(spark, docs, tables), "test")
    stay = {r["doc_id"] for r in docs.collect()}
    assert set(range(60)) <= stay and gone <= set(range(60))


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = p.cut(stage(spark, docs, tables), "test")
    assert docs.count() == 0
