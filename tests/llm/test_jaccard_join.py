import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from codeweave.llm import common
from codeweave.llm import jaccard_join as J
from codeweave.llm.components import connected_components


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def sets_of(rows):
    out = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            out.setdefault(i, []).append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (max(map(len, s)), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("meet_rows, meet", [(64, 512), (1, 3)])
def test_equals_brute_force(docs_of, corpus, monkeypatch, meet_rows, meet):
    monkeypatch.setattr(J, "MEET_ROWS", meet_rows)
    monkeypatch.setattr(J, "MEET", meet)
    got = {r[0]: (r[1], r[2]) for r in J.jaccard_components(docs_of(corpus)).collect()}
    assert got == brute(corpus)


def test_beyond_the_broadcast_bound(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    assert {r[0]: (r[1], r[2]) for r in J.jaccard_components(docs_of(corpus)).collect()} == brute(corpus)


@pytest.mark.parametrize("meet_rows", [64, 1])
def test_repeated_ids_near_the_threshold(spark, docs_of, monkeypatch, meet_rows):
    """Without the links by first tokens all must come out of the prefixes, for documents of several rows too."""
    monkeypatch.setattr(J, "MEET_ROWS", meet_rows)
    monkeypatch.setattr(J, "first_token_links", lambda reps, percent: spark.createDataFrame([], "a long, b long"))
    rows = []
    for g in range(12):
        w = [f"g{g}w{k}" for k in range(104)]
        near = w[:-11] + [f"g{g}x{k}" for k in range(11)]
        rows += [(10 * g, " ".join(w)), (10 * g, " ".join(w)), (10 * g + 1, " ".join(near)), (10 * g + 2, " ".join(w[::-1])), (10 * g + 2, " ".join(near))]
        rows += [(10 * g + 3, " ".join(reversed(w)))] if g % 2 else [(10 * g + 1, " ".join(near)), (None, " ".join(w))]
    got = {r[0]: (r[1], r[2]) for r in J.jaccard_components(docs_of(rows)).collect()}
    assert got == brute(rows) and got[1] == (100, 0) and got[13] == (100, 10)


def test_many_copies_and_hubs(docs_of, monkeypatch):
    """Groups far above what a task takes of one key."""
    from codeweave.plans import joins

    monkeypatch.setattr(joins.frequent, "__defaults__", (5,))
    rng = np.random.RandomState(1)
    base = [[f"b{b}w{k}" for k in range(60)] for b in range(3)]
    rows = [(i, " ".join(base[0])) for i in range(5, 45)]
    for i in range(60):
        w = list(base[1 + i % 2])
        w[rng.randint(60)] = f"edit{i}"
        rows.append((100 + i, " ".join(w)))
    got = {r[0]: (r[1], r[2]) for r in J.jaccard_components(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_empty_table(docs_of):
    assert J.jaccard_components(docs_of([])).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 71), (71, 70), (80, 80), (None, 3)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 70: 70, 71: 70}


@pytest.mark.parametrize("rows", [3, 500])
def test_components_of_hubs(spark, monkeypatch, rows):
    from codeweave.plans import joins

    monkeypatch.setattr(joins.frequent, "__defaults__", (rows,))
    edges = [(5, i) for i in range(6, 60)] + [(59, 100), (100, 3)] + [(200 + i, 200 + i + 1) for i in range(9)] + [(208, i) for i in range(300, 320)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 3 for i in [3, *range(5, 60), 100]} | {i: 200 for i in [*range(200, 210), *range(300, 320)]}


def test_forest_joins_what_links():
    rng = np.random.RandomState(0)
    base = np.unique(rng.randint(0, 1 << 60, 100).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[k:], rng.randint(0, 1 << 60, k).astype(np.uint64)])) for k in (0, 2, 4, 60)]
    assert sorted(J.link_forest(sets, 80)) == [(1, 0), (2, 0)]


def test_word_hashes_don_t_depend_on_place():
    raw = "Äb cd  ab\tcd".encode()
    data = np.frombuffer(raw + raw, np.uint8)
    starts, ends, at = common.word_bounds(data, np.array([0, len(raw), 2 * len(raw)]))
    h = common.word_hashes(data, starts, ends)
    assert at.tolist() == [0, 4, 8] and (h[:4] == h[4:]).all() and h[1] == h[3] and len(set(h.tolist())) == 3
    assert max(Counter(common.word_hashes(np.frombuffer(b" ".join(b"%d" % i for i in range(5000)), np.uint8), *common.word_bounds(np.frombuffer(b" ".join(b"%d" % i for i in range(5000)), np.uint8), np.array([0, 23889]))[:2]).tolist()).values()) == 1
