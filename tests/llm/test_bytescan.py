import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from annalog.llm import bytescan as bs

TEXT = st.text(alphabet=st.sampled_from(list("abcAZ é\t\n\r\v\f  .日")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=12), st.integers(1, 60))
def test_words_and_hashes_are_those_of_each_text(texts, limit):
    seen = {}
    for lo, hi, data, offsets in bs.blocks(pa.array(texts, pa.string()), limit):
        starts, ends, first = bs.words(data, offsets)
        h = bs.span_hash(data, starts, ends)
        raw = data.tobytes()
        for k in range(hi - lo):
            got = [raw[a:b] for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            assert got == (texts[lo + k] or "").encode().split()
            for w, x in zip(got, h[first[k] : first[k + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_blocks_of_a_slice_and_of_one_long_text():
    column = pa.array(["x", "ab", None, "c" * 100, ""], pa.string()).slice(1)
    got = [(lo, hi, data.tobytes(), offsets.tolist()) for lo, hi, data, offsets in bs.blocks(column, 10)]
    assert [g[:2] for g in got] == [(0, 2), (2, 3), (3, 4)] or got[0][2].startswith(b"ab")
    assert b"".join(g[2] for g in got) == b"ab" + b"c" * 100


def test_a_text_longer_than_a_block_hashes_alike():
    word = b"needle"
    long = (b"x " * bs.BLOCK_BYTES) + word
    out = []
    for text in (word, long):
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = bs.words(data, np.array([0, len(data)]))
        out.append(bs.span_hash(data, starts[-1:], ends[-1:])[0])
    assert out[0] == out[1]


def test_spaced_and_lower():
    data = np.frombuffer("  Ab\tÉZ ".encode(), np.uint8)
    starts, ends, _ = bs.words(data, np.array([0, len(data)]))
    text, at = bs.spaced(data, starts, ends)
    assert text.tobytes() == " ab Éz ".encode() and at.tolist() == [1, 4]


def test_long_texts_in_parts_give_what_short_ones_do(monkeypatch):
    from annalog.llm import simhash, toxicity

    text = " ".join(f"word{i % 97} É{i % 13}" for i in range(3000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 4000, len(text)])
    starts, ends, _ = bs.words(data, offsets)
    share = np.arange(toxicity.BUCKETS, dtype=np.float32)
    whole = bs.span_hash(data, starts, ends), simhash.fingerprints_of(data, offsets), toxicity.word_logits(data, starts, ends, share)
    monkeypatch.setattr(bs, "BLOCK_BYTES", 64)
    monkeypatch.setattr(simhash, "PART", 50)
    monkeypatch.setattr(toxicity, "PART", 50)
    parts = bs.span_hash(data, starts, ends), simhash.fingerprints_of(data, offsets), toxicity.word_logits(data, starts, ends, share)
    for a, b in zip(whole, parts, strict=True):
        assert np.array_equal(a, b)
