"""Quality network, toxicity grammar, language field."""

import math
import random
import re

import numpy as np
import pytest

from codeweave.llm import langid as G
from codeweave.llm import quality as Q
from codeweave.llm import toxicity as T

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "ch ei sch en ung ver auf ä ü ge".split()}


def prose(rng, lang="en", n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def test_network_gradients():
    net = Q.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.RandomState(0)
    raw = rng.randint(97, 105, (5, 128)).astype(np.uint8)
    args = np.pad(raw, ((0, 0), (2, 2))), np.stack([Q.recurrence(r) for r in raw]), np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1], np.float32)
    _, grads = net.loss_and_grads(*args)
    for k in net.p:
        i = tuple(np.argwhere(np.abs(grads[k]) == np.abs(grads[k]).max())[0])
        old, e = net.p[k][i], 1e-5
        net.p[k][i] = old + e
        up, _ = net.loss_and_grads(*args)
        net.p[k][i] = old - e
        down, _ = net.loss_and_grads(*args)
        net.p[k][i] = old
        assert (up - down) / (2 * e) == pytest.approx(grads[k][i], rel=2e-2, abs=1e-6), k


@pytest.fixture(scope="module")
def judge():
    rng = random.Random(0)
    good = [prose(rng, n=rng.randint(20, 200)) for _ in range(120)]
    bad = [prose(rng, n=30) + (" " + prose(rng, n=1)[:-1]) * 60 if k % 2 else " | ".join(prose(rng, n=2) for _ in range(40)) for k in range(120)]
    return Q.fit(good + bad, [1] * 120 + [0] * 120)


def test_quality_of_held_out_rows(judge, docs_of):
    rng = random.Random(9)
    rows = [(k, prose(rng, n=100)) for k in range(20)] + [(100 + k, prose(rng, n=30) + " ered" * 60) for k in range(20)]
    rows += [(200, None), (201, ""), (202, prose(rng, n=60_000)), (None, "x"), (0, rows[0][1])]
    got = Q.quality(docs_of(rows), judge).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([score[k] > 0.5 for k in range(20)]) > 0.9 and np.mean([score[100 + k] < 0.5 for k in range(20)]) > 0.9
    assert score[200] == score[201] and Q.quality(docs_of([]), judge).collect() == []


def test_scores_don_t_depend_on_neighbours(judge):
    rng = random.Random(4)
    texts = [prose(rng, n=rng.randint(1, 900)).encode() for _ in range(30)] + [b"", b"x" * 512, b"ab" * 256]
    net = Q.Network(judge)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = net.scores(np.frombuffer(b"".join(texts), np.uint8), at)
    alone = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-5)


def test_fit_without_both_classes():
    for labels in ([], [1, 1], [0]):
        p = Q.fit(["a"] * len(labels), labels)
        assert 0 < Q.Network(p).scores(np.zeros(0, np.uint8), np.array([0, 0]))[0] < 1


def test_grammar_patterns():
    g = T.Grammar({"fool ": 5.0, "dolt": 4.0})
    found = lambda t: [sorted(s) for _, _, s in g.clauses(t)]
    assert found("You are a fool. Fine day") == [["insult_target"]]
    assert found("a fool ran, the foolish sat") == [["insult"]]
    assert found("nobody is not a fool") == [["negated"]]
    assert found("he said the fool left") == [["reported"]]
    assert found("we saw “fool” here") == [["reported"]]
    assert found("I will kill you") == [["threat_target"]]
    assert found("the kill was clean") == [] and found("tomfool") == [] and found("doltish") == [["insult"]]


def test_speech_and_negation_reach_over_borders():
    g = T.Grammar({"fool ": 5.0})
    found = lambda t: [sorted(s) for _, _, s in g.clauses(t)]
    assert found('"Listen, you fool," she said') == [["reported"]] and found("He said: you fool") == [["reported"]]
    assert found("You are not, in fact, a fool") == [["negated"]] and found("You are not happy, you hear, and a fool") == [["insult"]]
    assert found("“Go away. You fool. Go,” he said") == [["reported"]] and found("“Go,” he said. You fool") == [["insult_target"]]
    assert found('the 5" fool. You fool') == [["reported"], ["insult_target"]] and found("“Go\nYou fool”") == [["insult_target"]]
    assert found("You, a fool") == [["insult"]] and found("He said no. You fool") == [["insult_target"]]
    text = "Well, you fool, go; fool"
    assert [text[a:b] for a, b, _ in g.clauses(text)] == [" you fool", " fool"]


def test_composed_machine_equals_its_parts():
    rng = random.Random(0)
    whole, parts, seen = T.grammar(), T.machines(), set()
    for _ in range(3000):
        state, own = whole["start"], [m.start for m in parts]
        for _ in range(12):
            symbol = rng.choice(T.SYMBOLS)
            state, out = whole["table"][state, symbol]
            for k, m in enumerate(parts):
                own[k], symbol = m.step(own[k], symbol)
            assert (state, out) == (tuple(own), symbol)
            seen.add(out)
    assert seen >= set(T.PATTERNS)


def by_rule(g, text):
    """Pattern sums a document by the grammar's rules as plain code, over every sentence."""
    total = dict.fromkeys(T.PATTERNS, 0.0)
    for line in text.lower().split("\n"):
        marks = 0
        for sentence in re.split(r"[.!?]", line):
            rest = line.count('"') - marks
            speech = "quoted" if marks % 2 and rest else None
            scope, before, weight = 0, None, 0.0
            for token in re.findall(r"[a-z]+|[,;:\"]", sentence):
                symbol, w = g.lex(token)
                weight = w or weight
                if symbol == "Q":
                    marks += 1
                    speech = None if speech == "quoted" else "quoted"
                elif symbol == "R" and speech is None:
                    speech = "said"
                if symbol == "C":
                    before, weight = None, 0.0
                    continue
                kind = "reported" if speech else "negated" if scope else "plain"
                if symbol == "N":
                    scope = T.NEGATION_SCOPE
                else:
                    scope = 0 if symbol in "IT" else max(0, scope - 1)
                out = None
                if symbol == "I":
                    out = kind if kind != "plain" else "insult_target" if before == "target" else "insult"
                    before = "target" if before == "target" and kind != "plain" else "insulted"
                elif symbol == "T":
                    if before == "target":
                        out = kind if kind != "plain" else "threat_target"
                    elif kind == "plain":
                        before = "threat"
                elif symbol == "G":
                    out = {"threat": "threat_target", "insulted": "insult_target"}.get(before)
                    before = "target"
                if out:
                    total[out] += 0.5 * weight if out == "insult_target" and symbol != "I" else weight
    return total


def test_clauses_equal_plain_code():
    rng = random.Random(4)
    g = T.Grammar({"fool ": 5.0, "dolt": 4.0})
    words = ["you", "fool", "doltish", "not", "said", "kill", "tea", "hat", '"', ",", ";", ".", "!", "\n", "she", "and"]
    for _ in range(4000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        # A quotation mark is counted for its line, so one that stands in a sentence without an entry matters too.
        want = by_rule(g, text)
        got = dict.fromkeys(T.PATTERNS, 0.0)
        for _, _, sums in g.clauses(text):
            for k, v in sums.items():
                got[k] += v
        assert got == pytest.approx(want), text


def test_toxicity_of_odd_rows(docs_of):
    model = {"lexicon": {"fool ": 5.0}, "coef": T.PRIOR.tolist(), "bias": -3.0}
    rows = [(None, "you fool"), (1, "you fool"), (1, "you fool"), (2, "tea " * 100_000 + "you fool"), (3, None), (4, "")]
    got = [tuple(r) for r in T.toxicity(docs_of(rows), model).collect()]
    assert [r[0] for r in got] == [i for i, _ in rows] and len({r[1:] for r in got[:4]}) == 1 and got[0][2] == 1
    assert got[4][1:] == got[5][1:] == (pytest.approx(1 / (1 + math.exp(3))), 0)


def test_toxicity_of_held_out_rows(spark, docs_of):
    rng = random.Random(5)
    insults = ["vrekka", "moldoz", "trisk"]
    rows, marks = [], []
    for k in range(240):
        w = prose(rng, n=50).split()
        if k % 3 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        rows.append((k, " ".join(w)))
        marks.append((k, int(k % 3 == 0)))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = T.fit(*T.labelled_sample(docs_of(rows), labels, "toxic", "doc_id % 2 = 0", 1000))
    assert set(insults) <= {k.strip() for k in model["lexicon"]} | {i for i in insults if any(i.startswith(k) for k in model["lexicon"])}
    got = {r.doc_id: r.score >= 0.3 for r in T.toxicity(docs_of([*rows, (900, None), (901, "")]), model).collect()}
    assert np.mean([got[k] == (k % 3 == 0) for k in range(1, 240, 2)]) > 0.97 and not got[900] and not got[901]
    assert T.toxicity(docs_of([]), model).collect() == [] and T.fit([], [])["lexicon"] == {}


@pytest.mark.parametrize("run", [3, 128])
def test_marginals_equal_the_definition(monkeypatch, run):
    monkeypatch.setattr(G, "RUN", run)
    rng = np.random.RandomState(0)
    m = G.Crf(list("abc"), {"trans": rng.randn(3, 3), "start": rng.randn(3)})
    at = np.concatenate([[0], np.cumsum([0, 1, 3, 4, 13, 0, 6, 2])])
    e = rng.randn(at[-1], 3) * 2
    got = m.marginals(e, at)
    for a, b in zip(at[:-1], at[1:]):
        if b - a and b - a <= 6:
            total = np.zeros((b - a, 3))
            for k in range(3 ** (b - a)):
                y = [k // 3**j % 3 for j in range(b - a)]
                p = math.exp(m.p["start"][y[0]] + sum(e[a + j, y[j]] for j in range(b - a)) + sum(m.p["trans"][y[j], y[j + 1]] for j in range(b - a - 1)))
                total[np.arange(b - a), y] += p
            assert got[a:b] == pytest.approx(total / total.sum(1, keepdims=True))
    assert got.sum(1) == pytest.approx(np.ones(len(e)))


def test_languages_of_held_out_rows(docs_of, spark):
    rng = random.Random(7)
    texts = [(prose(rng, lang, 50), lang) for lang in SYLLABLES for _ in range(60)]
    model = G.fit([t for t, _ in texts], [lang for _, lang in texts], steps=60)
    rows = [(k, prose(rng, "en" if k % 2 else "de", 40)) for k in range(60)] + [(100, None), (101, " 12 .. "), (102, "é"), (None, prose(rng, "de", 3000))]
    got = {r.doc_id: r for r in G.languages(docs_of(rows), model).collect()}
    assert np.mean([got[k].lang_pred == ("en" if k % 2 else "de") for k in range(60)]) > 0.97
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred != "und" and got[None].lang_pred == "de"
    switched = G.stretches(docs_of([(1, prose(rng, "en", 40) + " " + prose(rng, "de", 40))]), model).collect()
    assert {r.lang for r in switched} == {"en", "de"} and sum(r.words for r in switched) == 80
    assert G.languages(docs_of([]), model).collect() == []
    assert G.languages(docs_of([(1, "a")]), G.fit([], [])).first().lang_pred == "und"
    assert G.labelled_texts(spark.createDataFrame([(1, "a", None), (2, None, "en"), (3, "b", "en")], "doc_id long, text string, lang string"), "doc_id > 0", 5) == (["b"], ["en"])
