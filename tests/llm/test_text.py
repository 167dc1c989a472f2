from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import _text
from tallyweave.llm._ftrl import Ftrl


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abZ09_ .,\né字", max_size=30)), max_size=8))
def test_words_and_hashes(texts):
    w = _text.Words(pa.array(texts, pa.string()))
    want = [re.findall(r"[a-z0-9_é字]+", (t or "").lower()) for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    h = w.hashes()
    flat = [x for ws in want for x in ws]
    assert len({*flat}) == len({*h.tolist()})
    assert len({(a, b) for a, b in zip(flat, h.tolist(), strict=True)}) == len({*flat})
    for n in (1, 2, 3):
        g, bounds = _text.grams(h, w.first, n)
        runs = [[tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else [] for ws in want]
        assert np.diff(bounds).tolist() == [len(r) for r in runs]
        pairs = {(a, b) for a, b in zip([x for r in runs for x in r], g.tolist(), strict=True)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_slices_cover_all_rows():
    col = pa.array(["a" * 10, None, "b" * 100, "", "c"])
    assert [*_text.slices(col, 20)] == [(0, 2), (2, 3), (3, 5)]
    assert [*_text.slices(pa.array([], pa.string()))] == []


def test_segment_sum_with_empty_segments():
    assert _text.segment_sum(np.array([1.0, 2, 3]), np.array([0, 0, 2, 2, 3])).tolist() == [0, 3, 0, 3]


def test_ftrl_learns_and_shrinks():
    rows = [(np.array([k % 2, 2 + k % 7]), np.ones(2), k % 2) for k in range(400)]
    w, b = Ftrl(10, 1, l1=0.5).fit(rows, 3).weights()
    assert w[1, 0] > 1 and w[0, 0] < -1
    assert (w[9] == 0).all()
    w3, _ = Ftrl(10, 3).fit([(np.array([k % 3]), np.ones(1), k % 3) for k in range(300)], 2).weights()
    assert (w3[:3].argmax(1) == [0, 1, 2]).all()
