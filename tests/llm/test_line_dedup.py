import random

from annalog.llm import line_dedup as ld

from .conftest import prose, words


def run(spark, rows, schema="doc_id long, text string"):
    out = ld.dedup(spark.createDataFrame(rows, schema).repartition(3)).collect()
    return {r["doc_id"]: r for r in out}, out


def test_passages_go_from_later_documents_wherever_they_stand(spark):
    rng = random.Random(4)
    passage = prose(rng, 60, 5000)
    rows = [(i, prose(rng, 5 + 7 * i, 5000) + " " + passage + (" " if i % 2 else "\n") + prose(rng, 30, 5000)) for i in range(12)]
    got, _ = run(spark, rows)
    assert got[0]["text"] == rows[0][1] and got[0]["removed_words"] == 0
    inside = passage.split(" ")
    for i in range(1, 12):
        text = got[i]["text"]
        assert passage not in text and got[i]["removed_runs"] == 1
        assert got[i]["removed_words"] >= 60 - 2 * 12  # all but what a line at either edge holds
        assert len(words(text)) == len(words(rows[i][1])) - got[i]["removed_words"]
        kept = text.split()
        before, after = rows[i][1].split(passage)[0].split(), rows[i][1].split(passage)[1].split()
        assert kept[: len(before)] == before and kept[len(kept) - len(after) :] == after  # clean text isn't touched
        assert set(kept[len(before) : len(kept) - len(after)]) <= set(inside)


def test_copies_go_and_clean_texts_stay_as_they_are(spark, docs, corpus):
    out = ld.dedup(docs)
    assert out.columns == [*docs.columns, "removed_words", "removed_runs"]
    rows = out.collect()
    assert len(rows) == len(corpus)
    text = {(i, t) for i, t, _ in corpus}
    for r in rows:
        if not r["removed_runs"]:
            assert (r["doc_id"], r["text"]) in text
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["removed_runs"] for r in by[3]] == [0, 0]  # the first, in two equal rows
    for i in range(200, 205):
        assert len(words(by[i][0]["text"])) == 0
    for i in range(40):
        assert by[i][0]["text"] == corpus[i][1]  # all earlier, none alike
    assert by[400][0]["text"] is None and by[401][0]["text"] == ""


def test_short_repeats_stay(spark):
    rng = random.Random(5)
    line = "Licensed under the terms that follow, all rights are reserved."
    rows = [(i, f"{line}\n{prose(rng, 60, 5000)}\n{line}\n{prose(rng, 40, 5000)}") for i in range(10)]
    got, _ = run(spark, rows)
    assert all(got[i]["text"] == t for i, t in rows)


def test_a_repeat_inside_one_text(spark):
    rng = random.Random(6)
    a, b = prose(rng, 70, 5000) + ".", prose(rng, 50, 5000) + "."
    got, _ = run(spark, [(1, f"{a}\n{b}\n{a}")])
    assert got[1]["text"].startswith(f"{a}\n{b}\n") and got[1]["removed_words"] >= 50


def test_each_earlier_line_is_kept_somewhere(spark):
    """What is deleted stands in an earlier place: brute force over runs of words."""
    rng = random.Random(8)
    pool = [prose(rng, 45, 3000) + "." for _ in range(12)]
    rows = [(i, " ".join(rng.sample(pool, 4) + [prose(rng, 30, 3000)])) for i in range(30)]
    got, _ = run(spark, rows)
    left = " ".join(got[i]["text"] for i, _ in rows)
    total = sum(len(words(t)) for _, t in rows)
    assert sum(got[i]["removed_words"] for i, _ in rows) > 0.8 * (total - 30 * 30 - 12 * 45)
    for p in pool:
        if any(p in t for _, t in rows):
            assert p in left  # the first occurrence is whole
    for _, t in rows:
        assert " ".join(t.split()[-30:]) in left  # own words stay


def test_empty_and_ids_that_are_equal(spark, empty):
    assert ld.dedup(empty).count() == 0
    rng = random.Random(9)
    a, b = prose(rng, 80, 5000), prose(rng, 80, 5000)
    _, out = run(spark, [(1, a), (1, b), (2, a), (None, b)])
    done = sorted((r["doc_id"] or 0, r["removed_words"] > 0) for r in out)
    assert done == [(0, False), (1, False), (1, True), (2, True)]  # null ids come first


def embedded(rng, passage, own):
    """Two texts of ``own`` words on either side of ``passage``, mid-line."""
    fresh = lambda: " ".join(f"x{rng.randrange(10**9)}" for _ in range(own))
    return [f"{fresh()} {passage} {fresh()}" for _ in range(2)]


def test_passages_of_51_words_go_whole_wherever_lines_fall(spark):
    rng = random.Random(10)
    rows, want = [], {}
    for i in range(200):
        w = [f"p{rng.randrange(10**9)}" for _ in range(51)]
        if i % 2:  # long sentences, begun and ended outside the passage
            w = [x + "." if (k + i) % (14 + i % 15) == 0 else x for k, x in enumerate(w)]
        a, b = embedded(rng, " ".join(w), 30 + i % 17)
        rows += [(2 * i, a), (2 * i + 1, b)]
        want[2 * i + 1] = b.replace(" ".join(w) + " ", "")
    got, _ = run(spark, rows)
    assert all(got[2 * i]["text"] == rows[2 * i][1] for i in range(200))
    exact = sum(got[i]["text"] == t for i, t in want.items())
    assert all(got[i]["removed_runs"] == 1 and 51 <= got[i]["removed_words"] <= 52 for i in want)
    assert exact >= 198  # neighbouring words are told apart by 10 bits


def test_runs_of_very_short_lines_go_whole(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(100):
        w = [f"p{rng.randrange(10**9)}" for _ in range(52)]
        passage = "".join(x + (" " if i % 2 and k % 2 == 0 else "\n") for k, x in enumerate(w))  # one or two words a line
        for k in range(2):
            before, after = ("".join(f"x{rng.randrange(10**9)}\n" for _ in range(30 + i % 7)) for _ in range(2))
            rows.append((2 * i + k, before + passage + after))
        want[2 * i + 1] = before + after
    got, _ = run(spark, rows)
    assert all(got[2 * i]["text"] == rows[2 * i][1] for i in range(100))
    assert all(52 <= got[i]["removed_words"] <= 53 for i in want)
    assert sum(got[i]["text"] == t for i, t in want.items()) >= 98


def test_a_callers_columns_of_our_names(spark):
    rng = random.Random(12)
    p = prose(rng, 60, 5000)
    rows = [(1, p, "mine", 7, "r", 5), (2, p + " and more of it", "mine", 7, "r", 5), (3, p, "mine", 7, "r", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_words string, removed_runs int, rest string, n_chars int")
    out = {r["doc_id"]: r for r in ld.dedup(docs).collect()}
    assert out[2]["removed_words"] == 60 and out[2]["rest"] == "r" and out[1]["removed_runs"] == 0
    kept = ld.drop_repeats(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r for r in kept.collect()}
    assert sorted(got) == [1, 2] and got[2]["text"] == "and more of it" and got[2]["n_chars"] == 14 and got[1]["n_chars"] == 5
    assert all((r["removed_words"], r["removed_runs"], r["rest"]) == ("mine", 7, "r") for r in got.values())


def plain(rows):
    """Texts without runs that stand in an earlier document, by brute force over words: runs of GRAM_WORDS + SPAN or more."""
    least, seen, out = ld.GRAM_WORDS + ld.SPAN, set(), {}
    for i, t in sorted(rows):
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - least + 1):
            if tuple(w[k : k + least]) in seen:
                gone[k : k + least] = [True] * least
        seen |= {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def test_runs_of_one_origin_go_as_brute_force_says(spark):
    """Passages of 24 to 60 words, each with one origin, at random places: what has 28 words or more goes to the word."""
    rng = random.Random(13)
    rows, lengths = [], {}
    for i in range(150):
        n = 24 + i % 37
        passage = [f"p{rng.randrange(10**9)}" for _ in range(n)]
        for k in range(2):
            before, after = ([f"x{rng.randrange(10**9)}" for _ in range(20 + rng.randrange(60))] for _ in range(2))
            rows.append((2 * i + k, " ".join(before + passage + after)))
        lengths[2 * i + 1] = n
    got, _ = run(spark, rows)
    want = plain(rows)
    promised = [i for i, n in lengths.items() if n >= ld.GRAM_WORDS + ld.SPAN]
    assert sum(got[i]["text"].split() == want[i] for i in promised) >= len(promised) - 2  # 10 bits tell the words at an edge apart
    for i, n in lengths.items():
        assert got[i]["removed_words"] in ((n, n + 1) if i in promised else (0, n, n + 1))
