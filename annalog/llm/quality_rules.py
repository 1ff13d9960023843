"""Quality rules by weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document. Expectation-
maximisation over the counts of vote patterns estimates how often each rule votes
each way on good and on bad documents, and the posterior probability of a good
document replaces a test that all rules must pass.

What is gathered from the corpus is one count per vote pattern: at most
``3 ** len(RULES)`` rows whatever the size of the input, and no document text is
shuffled. Text is scanned once, in numpy blocks; the figures are written to the
shared folder and both the estimate and the answer read them from there.

Null or empty text has no words: every figure is 0 and the document fails the
base. Very long texts are scanned whole, and no rule depends on a text being short or long.
Repeated rows are judged row by row. A posterior of exactly one half keeps. Extra columns
play no part in ``score`` and pass through ``keep_good``, whatever their names. An empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annalog.llm import bytescan as bs
from annalog.llm.durable import cut

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he at are this from or have an they which one had but "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le de un et les la du pour que dans qui sur au avec par est une ce il ne pas plus se son sont "
    "el en y los del las por con una su para al lo como más o pero sus no"
).split()

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False  # bytes that go on a code point
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_function long, n_letters long, n_stops long"

WINDOW = 5


def _repeats(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each value is found twice or more in its document."""
    found = np.zeros(len(h), dtype=bool)
    if len(h) > 1:
        key = bs.mix(h ^ bs.mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        found[order[1:]] |= same
        found[order[:-1]] |= same
    return found


def _later(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each value is equal to an earlier one of its document."""
    found = np.zeros(len(h), dtype=bool)
    if len(h) > 1:
        key = bs.mix(h ^ bs.mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        found[order[1:]] = key[order][1:] == key[order][:-1]
    return found


def _function_hashes() -> np.ndarray:
    joined = np.frombuffer(" ".join(FUNCTION_WORDS).encode(), dtype=np.uint8)
    starts, ends, _ = bs.words(joined, np.array([0, len(joined)]))
    return np.unique(bs.span_hash(joined, starts, ends))


def measure(data: np.ndarray, offsets: np.ndarray, functions: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of FEATURES for the documents of one block."""
    starts, ends, first = bs.words(data, offsets)
    owner = bs.owners(first)
    n_words = np.diff(first)
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LEAD[data], out=lead[1:])
    h = bs.span_hash(data, starts, ends)

    again = np.zeros(len(h), dtype=bool)
    grams = bs.window_hash(h, WINDOW)
    if len(grams):
        whole = np.flatnonzero(owner[: len(grams)] == owner[WINDOW - 1 :])
        twice = whole[_repeats(grams[whole], owner[whole])]
        for k in range(WINDOW):
            again[twice + k] = True

    line_starts, line_ends = bs.spans(data != 0x0A, offsets)  # lines that aren't empty
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    solid = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[solid], line_ends[solid], line_owner[solid]
    dup = _later(bs.span_hash(data, line_starts, line_ends), line_owner)

    lowered = bs.span_hash(bs.lower(data), starts, ends)
    distinct = ~_later(lowered, owner)
    count = lambda flags, of: np.bincount(of, weights=flags, minlength=len(n_words)).astype(np.int64)
    per_bytes = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])[offsets])
    return {
        "n_words": n_words,
        "word_chars": count(lead[ends] - lead[starts], owner),
        "n_symbols": per_bytes(_SYMBOL),
        "n_dup_lines": count(dup, line_owner),
        "n_repeat_words": count(again, owner),
        "n_lines": np.bincount(line_owner, minlength=len(n_words)),
        "n_distinct": count(distinct, owner),
        "n_function": count(np.isin(lowered, functions), owner),
        "n_letters": per_bytes(_LETTER & _LEAD | (np.arange(256) >= 0xC0)),
        "n_stops": per_bytes(_STOP),
    }


def features(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default ``doc_id``) with FEATURES of the column ``text``, a row for each row of ``docs``."""
    keep = keep or ("doc_id",)
    chosen = docs.select(*keep, text) if text not in keep else docs.select(*keep)
    kept = [chosen.schema[k] for k in keep]
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _function_hashes()
        for batch in batches:
            parts = [measure(data, offsets, functions) for _, _, data, offsets in bs.blocks(batch.column(text))]
            if parts:
                made = [pa.array(np.concatenate([p[n] for p in parts]).astype(np.int64)) for n in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], names=[*keep, *names])

    schema = StructType([*kept, *StructType.fromDDL(FEATURES).fields])
    return chosen.mapInArrow(scan, schema)


#: name, SQL for a bad vote, SQL for a good vote; else the rule abstains. Rules
#: that only detect a fault say nothing in a document's favour.
RULES = (
    ("symbols", "n_symbols > 0.2 * n_words", "n_symbols < 0.05 * n_words"),
    ("function_words", "n_function < 0.03 * n_words", "n_function > 0.1 * n_words"),
    ("sentences", "n_stops < 0.01 * n_words", "n_stops > 0.03 * n_words"),
    ("length", "n_words < 10", "false"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 10 * n_words", "false"),
    ("dup_lines", "n_dup_lines > 0.3 * n_lines", "false"),
    ("repeats", "n_repeat_words > 0.2 * n_words", "false"),
    ("variety", "n_distinct < 0.25 * n_words and n_distinct * n_distinct < 64 * n_words", "false"),  # a text's vocabulary grows like a root of its length
)


def votes(frame: DataFrame) -> DataFrame:
    """``frame`` with a column ``votes``: one character for each rule, b, g or -."""
    one = [F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("-") for _, bad, good in RULES]
    return frame.withColumn("votes", F.concat(*one))


def estimate(patterns: list[str], counts: list[int], rounds: int = 100) -> dict[str, float]:
    """Posterior probability of a good document for each vote pattern, by EM.

    Rates start from a belief about rules that vote and rules that detect faults,
    which fixes the class that is the good one; it counts as a tenth more documents.
    """
    if not patterns:
        return {}
    n_rules = len(patterns[0])
    seen = np.array([["bg-".index(c) for c in p] for p in patterns])
    weight = np.array(counts, dtype=float)
    one_hot = np.eye(3)[seen]  # pattern, rule, vote
    voter, detector = [[0.6, 0.25, 0.15], [0.03, 0.85, 0.12]], [[0.25, 0.001, 0.749], [0.01, 0.001, 0.989]]
    belief = np.array([voter if good != "false" else detector for _, _, good in RULES])[:n_rules].swapaxes(0, 1)  # class bad, good; rule; vote
    rates = belief
    prior = start = np.array([0.2, 0.8])
    strength = 0.1 * weight.sum() + 10
    good = np.zeros(len(patterns))
    for _ in range(rounds):
        log = np.log(prior)[None] + np.einsum("prv,crv->pc", one_hot, np.log(rates))
        log -= log.max(axis=1, keepdims=True)
        post = np.exp(log)
        post /= post.sum(axis=1, keepdims=True)
        if np.abs(post[:, 1] - good).max() < 1e-9:
            break
        good = post[:, 1]
        share = post * weight[:, None]
        prior = (share.sum(axis=0) + strength * start) / (weight.sum() + strength)
        rates = (np.einsum("pc,prv->crv", share, one_hot) + (strength * start)[:, None, None] * belief) / (share.sum(axis=0) + strength * start)[:, None, None]
    return dict(zip(patterns, good.tolist(), strict=True))


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` (with FEATURES) plus votes, posterior, base_failed and kept.

    ``measured`` is read twice, so it should be a written table.
    """
    voted = votes(measured)
    rows = voted.groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    posterior = estimate([r["votes"] for r in rows], [r["count"] for r in rows])
    table = measured.sparkSession.createDataFrame(list(posterior.items()), "votes string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        voted.join(F.broadcast(table), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= 0.5))
    )


def score(docs: DataFrame) -> DataFrame:
    """doc_id with figures, posterior, base_failed and kept for each row of ``docs``."""
    return judge(cut(features(docs), "quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    Texts are scanned once: a written table carries each row with its votes, and the
    posterior depends on the pattern of votes alone, so texts need no join.
    """
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # names that clash with no figure
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scanned = votes(features(hidden, *hidden.columns, text=f"c{names.index('text')}"))
    written = cut(scanned.select(*hidden.columns, "votes", failed.alias("failed")), "judged")
    rows = written.groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    posterior = estimate([r["votes"] for r in rows], [r["count"] for r in rows])
    good = [p for p, v in posterior.items() if v >= 0.5]
    chosen = F.col("votes").isin(good) if good else F.lit(False)
    return written.where(~F.col("failed") & chosen).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
