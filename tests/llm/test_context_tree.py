import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.llm import context_tree as C

D = C.DEPTH


def tokens(t):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)) + [b"\n"]


def path(before, word):
    s = b" " * D + before[-(D - 1) :] + b" " + word + (b"" if word == b"\n" else b" ")
    for p in range(len(s) - len(word) - (word != b"\n"), len(s)):
        for j in range(8):
            node = (1 << j) | (s[p] >> (8 - j))
            yield [(s[p - d : p], node) for d in range(D + 1)], s[p] >> (7 - j) & 1


def brute(rows):
    """The tree by its recursive definition, over every token."""
    count, nodes, below = Counter(), defaultdict(lambda: [0, 0]), defaultdict(set)
    for _, t, train in rows:
        if train:
            w = tokens(t)
            count.update(w)
            for u, x in zip([b"", *w[:-1]], w):
                for keys, bit in path(u, x):
                    for d, k in enumerate(keys):
                        nodes[k][bit] += 1
                        if d < D:
                            below[k].add(keys[d + 1])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    @lru_cache(None)
    def weighted(k):
        own = kt(*nodes[k])
        return own if len(k[0]) == D else np.logaddexp(own, sum(weighted(x) for x in below[k])) - math.log(2)

    def beta(k):
        return 1 / (1 + math.exp(min(700, max(-700, sum(weighted(x) for x in below[k]) - kt(*nodes[k])))))

    n, v = sum(count.values()), len(count)
    out = []
    for i, t, train in rows:
        w, score = tokens(t), 0.0
        for u, x in zip([b"", *w[:-1]], w):
            for keys, bit in path(u, x):
                one = None
                for k in reversed(keys):
                    if k in nodes:
                        p = (nodes[k][1] + 0.5) / (sum(nodes[k]) + 1)
                        one = p if one is None else beta(k) * p + (1 - beta(k)) * one
                one = 0.5 if one is None else one
                score += math.log10(one if bit else 1 - one)
        out.append((i, not train, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), score))
    return out


ROWS = [(1, "The cat sat on the mat", True), (2, "the dog sat on the LOG", True), (3, "a cat and a dog\x00x", False), (4, None, True), (5, "", False), (6, "éàü the caterpillars", False), (7, "caterpillar the the", True), (7, "caterpillar the the", True)]


@pytest.mark.parametrize("words, pairs, group", [(400_000, 3_000_000, 20_000), (0, 3_000_000, 2), (3, 40, 0)])
def test_equals_the_recursive_definition(spark, monkeypatch, words, pairs, group):
    monkeypatch.setattr(C, "GROUP_PAIRS", group)
    monkeypatch.setattr(C, "TOP_WORDS", words)
    monkeypatch.setattr(C, "TOP_PAIRS", pairs)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, train boolean").withColumn("word", F.lit("clash"))
    got = sorted(tuple(r) for r in C.corpus_scores(docs).collect())
    want = sorted(brute(ROWS))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_without_rows_or_training_rows(spark):
    schema = "doc_id long, text string, train boolean"
    assert C.corpus_scores(spark.createDataFrame([], schema)).collect() == []
    row = C.corpus_scores(spark.createDataFrame([(1, "a", False)], schema)).first()
    assert row.train_tokens == 0 and row.n_tokens == 2 and row.n_known == 0 and row.score < 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e6 + 0.5])
    assert C.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
