import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm.common import chunks, mix64, powers, running, spans, utf8, word_table, words

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
texts = st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=40)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_are_those_of_the_patterns(some):
    raw, at = utf8(pa.array(some, pa.string()))
    for kind, pattern in (("blank", BLANK), ("alnum", ALNUM)):
        hashes, start, end, offsets = words(raw, at, word_table(kind))
        seen = {}
        for i, text in enumerate(some):
            want = pattern.findall((text or "").encode().lower())
            lo, hi = offsets[i], offsets[i + 1]
            assert [raw[s:e].tobytes().lower() for s, e in zip(start[lo:hi], end[lo:hi], strict=True)] == want
            for h, w in zip(hashes[lo:hi].tolist(), want, strict=True):
                assert seen.setdefault(h, w) == w


def test_chunks_are_whole_texts():
    column = pa.array(["a" * 10, None, "", "b" * 30, "é"])
    got = [(lo, hi, raw.tobytes().decode()) for lo, hi, raw, _ in chunks(column, 12)]
    assert "".join(t for _, _, t in got) == "a" * 10 + "b" * 30 + "é"
    assert [g[:2] for g in got][0][0] == 0 and got[-1][1] == 5
    sliced = pa.array(["xx", "yy", "zz"]).slice(1)
    assert utf8(sliced)[0].tobytes() == b"yyzz"


def test_hashes_of_ranges():
    x = mix64(np.arange(50, dtype=np.uint64))
    twice = running(np.concatenate([x, x]))
    at = np.arange(40)
    assert (spans(twice, at, at + 10) == spans(twice, at + 50, at + 60)).all()
    assert len(set(spans(twice, at, at + 10).tolist())) == 40
    up, down = powers(100)
    assert (up * down == 1).all()
