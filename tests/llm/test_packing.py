import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from codeweave.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "Hello, World! it's 42", "a<|endoftext|>b <|STARTOFTEXT|>", "İstanbul ﬁx é Σας", "x" * 300, "日本語 text　wide space", "thndor$$$ $$$ 'tis can't %%%,.", "\u0000 nul line"]


def ids(text):
    tokenizer = P.tokenizer(public_tokenizers.path(P.TOKENIZER))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_word_ids_equal_the_tokenizer():
    words = P.WordIds(public_tokenizers.path(P.TOKENIZER))
    for text, raw in zip(ODD * 2, words.ids([t.encode() for t in ODD] * 2)):
        assert raw == ids(text)[:-1].tobytes(), text


def least(histogram, capacity):
    """A lower bound of the sequences: pieces of over half a sequence are alone, and those of at least k can't join the longest of them."""
    best = 0
    for k in range(0, capacity // 2 + 1):
        long = sum(n for length, n in histogram.items() if length > capacity - k)
        half = {length: n for length, n in histogram.items() if capacity // 2 < length <= capacity - k}
        small = sum(length * n for length, n in histogram.items() if k <= length <= capacity // 2)
        room = sum((capacity - length) * n for length, n in half.items())
        best = max(best, long + sum(half.values()) + max(0, -(-(small - room) // capacity)))
    return best


def test_best_fit_equals_one_piece_at_a_time():
    rng = random.Random(3)
    for _ in range(40):
        need = np.zeros(31, np.int64)
        for _ in range(rng.randint(0, 60)):
            need[rng.randint(1, 30)] += rng.randint(1, 3)
        rooms, one = [], 0
        for length in range(30, 0, -1):
            for _ in range(need[length]):
                fit = min((r for r in rooms if r >= length), default=None)
                if fit is None:
                    one, fit = one + 1, 30
                else:
                    rooms.remove(fit)
                rooms.append(fit - length)
        found = P.best_fit(need, 30)
        assert sum(found.values()) == one
        assert sorted(30 - sum(k * m for k, m in c) for c, n in found.items() for _ in range(n)) == sorted(rooms)


@pytest.mark.parametrize("histogram", [{1500: 10**9}, {k: 1000 + k for k in range(1100, 1801)}, {k: 10**7 // k for k in range(1, 2049)}, {1025: 10**6, 1023: 10**6 + 7, 5: 3}])
def test_plans_take_seconds_whatever_the_counts(histogram):
    began = time.time()
    chosen = P.plan(histogram)
    assert time.time() - began < 60
    assert sum(m * copies for c, copies in chosen for _, m in c) == sum(histogram.values())
    assert sum(copies for _, copies in chosen) <= 1.01 * least(histogram, 2048) + 3


@pytest.mark.parametrize("seed, n, high", [(0, 0, 1), (1, 1, 64), (2, 300, 64), (3, 5000, 64), (4, 400, 20), (5, 3000, 40)])
def test_plan_holds_exactly_the_pieces(monkeypatch, seed, n, high):
    monkeypatch.setattr(P, "LEFT_OVER", 50)
    rng = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(n):
        histogram[rng.randint(1, high)] += 1
    chosen = P.plan(histogram, 64)
    held = defaultdict(int)
    for c, copies in chosen:
        assert copies > 0 and sum(k * m for k, m in c) <= 64
        for k, m in c:
            held[k] += m * copies
    assert held == histogram
    assert sum(c for _, c in chosen) <= 1.03 * least(histogram, 64) + 3


def test_pack(docs_of, corpus):
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(ODD)), (2000, "word " * 150)]
    got = P.pack(docs_of(rows), capacity=64).collect()
    want = []
    for i, t in rows:
        x = ids(t)
        want += [(i, k, at, len(x[at : at + 64]), zlib.crc32(x[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(x), 64))]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert P.pack(docs_of([])).collect() == []
