import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from codeweave.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXT = "Écris à bob.x@mail.example.com or 10.0.0.255 and +1 (724) 555-7058, card 4111 1111 1111 1111."


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


def test_base_equals_the_patterns():
    rng = random.Random(1)
    alphabet = "0123456789.@+-() ab%_4é\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(70)) for _ in range(4000)]
    texts += [TEXT, "", "@", "a@b", "4" * 5000 + ".1", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 +123456789012 34567"]
    for t in texts:
        assert P.base_spans(t) == brute(t), t
    assert [k for *_, k in P.base_spans(TEXT)] == ["email", "ip", "phone", "card"]


def test_gradients():
    t = P.Tagger.fresh(classes=5, tags=3, hidden=3, width=2)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.RandomState(0)
    x, y = rng.randint(0, 5, (2, 6)), rng.randint(0, 3, (2, 6))
    _, grads = t.loss_and_grads(x, y)
    for k in t.p:
        i = tuple(rng.randint(0, s) for s in t.p[k].shape)
        old, e = t.p[k][i], 1e-3
        t.p[k][i] = old + e
        up, _ = t.loss_and_grads(x, y)
        t.p[k][i] = old - e
        down, _ = t.loss_and_grads(x, y)
        t.p[k][i] = old
        assert (up - down) / (2 * e) == pytest.approx(grads[k][i], abs=2e-5), k


def windows_of(texts):
    found = [w for k, t in enumerate(texts) for w in P.training_windows(t, k)]
    return np.array([w[2] for w in found]).astype(int), np.array([w[3] for w in found]).astype(int)


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    spans = [lambda: f"{word()}.{digits(2)}@{word()}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: "page " + digits(2)]
    texts = [" ".join(rng.choice(spans)() if rng.random() < 0.1 else word() for _ in range(60)) for _ in range(90)]
    t = P.Tagger.fresh()
    x, y = windows_of(texts)
    loss = t.fit(x, y, 14)
    assert loss < 0.08
    return t


def test_the_model_adds_what_the_patterns_miss(trained):
    text = "ask ana at 1 (724) 555-7058 or here +1 (724) 555-1111 then go " + "tea " * 60 + "or 1 (722) 555-9911 on"
    base = P.base_spans(text)
    (added,) = P.model_spans(trained, [text], [base])
    assert [text[a:b] for a, b, k in added if k == "phone"] == ["1 (724) 555-7058", "1 (722) 555-9911"]
    assert all(P.free(a, b, base) for a, b, _ in added)


def test_addresses_without_a_digit_or_an_at_sign():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    mail = lambda: f"{word()}@{word()}.example.com"
    some = [mail, mail, lambda: "+1 (724) 555-" + "".join(rng.choice("0123456789") for _ in range(4))]
    tagger = P.Tagger.fresh()
    tagger.fit(*windows_of([" ".join(rng.choice(some)() if rng.random() < 0.1 else word() for _ in range(60)) for _ in range(90)]), 14)
    prose = "she sat at noon and then tea " * 9
    texts = [prose + f"write {who} {prose}" for who in ("ana (at) mail.example.com", "ana(at)mail.example.com", "ana at mail.example.com")]
    texts += [prose + "bob@mail.example.com or ana(at)mail.example.com " + prose, prose]
    base = [P.base_spans(t) for t in texts]
    added = P.model_spans(tagger, texts, base)
    assert [[t[a:b] for a, b, _ in more] for t, more in zip(texts, added)] == [["ana (at) mail.example.com"], ["ana(at)mail.example.com"], ["ana at mail.example.com"], ["ana(at)mail.example.com"], []]
    assert P.redact(texts[0], base[0] + added[0]) == prose + "write [EMAIL] " + prose


def test_scores_equal_emissions(trained):
    rng = random.Random(8)
    x = np.array([P.classes("".join(rng.choice("abc 0123.@+-()") for _ in range(P.WINDOW))) for _ in range(150)])
    assert np.abs(trained.scores(x) - trained.emissions(x)[0].transpose(0, 2, 1)).max() < 1e-3


@pytest.mark.parametrize("batch, steps", [(1, 1), (1, 2), (5, 7), (129, 3), (300, 8)])
@pytest.mark.parametrize("by_exp", [False, True])
def test_scores_of_any_size(trained, batch, steps, by_exp, monkeypatch):
    monkeypatch.setattr(P, "slow_tanh", lambda: by_exp)
    x = np.random.RandomState(batch).randint(0, P.CLASSES, (batch, steps)).astype(np.int8)
    assert np.abs(trained.scores(x) - trained.emissions(x)[0].transpose(0, 2, 1)).max() < 1e-3


@pytest.mark.parametrize("by_exp", [False, True])
def test_gates_far_out_stay_finite(by_exp, monkeypatch):
    monkeypatch.setattr(P, "slow_tanh", lambda: by_exp)
    t = P.Tagger.fresh()
    t.p |= {k: v * 200 for k, v in t.p.items() if k[:2] in ("wx", "wh")}
    x = np.random.RandomState(5).randint(0, P.CLASSES, (9, 12)).astype(np.int8)
    with np.errstate(all="raise", under="ignore"):
        assert np.abs(t.scores(x) - t.emissions(x)[0].transpose(0, 2, 1)).max() < 1e-2


def test_scores_cost_less_than_a_recurrence_over_one_hot_classes(trained):
    """CPU time of all emissions against that of the steps alone (a fifth more, for noise), with one-hot products and a pass each for the halves of the gates."""
    hidden, tall = len(trained.p["wh_f"]), P.HELD // P.BLOCK
    rng = np.random.RandomState(4)
    x = rng.randint(1, P.CLASSES, (P.HELD, P.WINDOW)).astype(np.int8)
    w, s = rng.randn(4 * hidden, hidden + P.CLASSES).astype(np.float32), rng.rand(tall, hidden + P.CLASSES, P.BLOCK).astype(np.float32)
    z, (c, new) = np.empty((tall, 4 * hidden, P.BLOCK), np.float32), np.zeros((2, tall, hidden, P.BLOCK), np.float32)

    def steps():
        for _ in range(2 * P.WINDOW):
            np.tanh(np.matmul(w, s, out=z), out=z)
            gates = z[:, : 3 * hidden]
            gates *= 0.5
            gates += 0.5
            np.multiply(c, z[:, hidden : 2 * hidden], out=c)
            np.add(c, np.multiply(z[:, :hidden], z[:, 3 * hidden :], out=new), out=c)
            s[:, :hidden] = np.multiply(z[:, 2 * hidden : 3 * hidden], np.tanh(c, out=new), out=new)

    def cpu(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    took = [(cpu(lambda: trained.scores(x)), cpu(steps)) for _ in range(8)]
    assert min(a for a, _ in took) < 1.2 * min(b for _, b in took)


def test_viterbi_equals_enumeration():
    rng = np.random.RandomState(1)
    t = P.Tagger.fresh(classes=5, tags=3, hidden=3, width=2)
    t.p["trans"] = rng.randn(3, 3).astype(np.float32)
    e, lengths = rng.randn(6, 20, 3).astype(np.float32), rng.randint(1, 7, 20)
    got = t.viterbi(e, lengths)
    for b, n in enumerate(lengths.tolist()):
        path = lambda y: sum(e[k, b, y[k]] for k in range(n)) + sum(t.p["trans"][y[k], y[k + 1]] for k in range(n - 1))
        assert got[b, :n].tolist() == list(max(itertools.product(range(3), repeat=n), key=path))


def test_one_path_over_merged_emissions(trained):
    """Pruning changes nothing: the spans are those of one Viterbi over every character, its windows merged one by one."""
    rng = random.Random(8)
    piece = lambda: rng.choice(["tea ", "12 ", "a.b@c.example.com ", "1 (724) 555-7058 ", "10.0.0.1 ", "+"])
    texts = ["".join(piece() for _ in range(rng.randint(1, 160))).strip() for _ in range(40)] + ["7", "bob@x.example.com", "tea " * 200]
    ramp = (np.arange(P.SHARED) + 0.5) / P.SHARED
    seen = 0
    for t, got in zip(texts, P.decoded(trained, texts)):
        merged = np.zeros((len(t), len(P.TAGS)))
        starts = list(range(0, max(1, len(t) - P.SHARED), P.STRIDE))
        for s in starts:
            x = np.zeros((1, P.WINDOW), int)
            own = P.classes(t[s : s + P.WINDOW])
            x[0, : len(own)] = own
            w = np.ones(P.WINDOW)
            if s:
                w[: P.SHARED] = ramp
            if s != starts[-1]:
                w[-P.SHARED :] = 1 - ramp
            merged[s : s + P.WINDOW] += (trained.emissions(x)[0][:, 0] * w[:, None])[: len(own)]
        best = trained.viterbi(merged[:, None].astype(np.float32), np.array([len(t)]))[0]
        assert got == list(P.tagged(best)), t
        seen += len(got)
    assert seen > 200
    assert P.decoded(trained, texts[5:6]) == [P.decoded(trained, texts)[5]]


def test_few_characters_are_undecided_in_prose(trained):
    w = P.Windows(["tea or oat and hat " * 300])
    assert not trained.undecided(w.gains(trained), w.base, w.base + w.lengths - 1)[w.inside].any()


def test_a_long_text(trained):
    long = "7 " * 400 + "ask " + "tea " * 60_000 + "at 1 (724) 555-7058"
    assert [long[a:b] for a, b, _ in P.model_spans(trained, [long], [P.base_spans(long)])[0]][-1:] == ["1 (724) 555-7058"]


def test_training_windows_lie_anywhere():
    text = "ana@x.example.com " * 3 + "tea " * 3000 + "room 12 " * 30
    found = list(P.training_windows(text, 1))
    assert {w[0] for w in found} == {0, 1, 2} and sum(w[0] == 0 for w in found) == 9
    assert all(w[2].shape == w[3].shape == (P.TRAINED,) for w in found) and list(P.training_windows("", 1)) == []


def test_rows(spark, docs_of, trained):
    rows = [(1, TEXT), (2, None), (3, ""), (None, TEXT), (1, TEXT), (4, "none")]
    got = sorted((tuple(r)[:7] for r in P.personal_data(docs_of(rows), trained.p).collect()), key=str)
    digest = lambda t: hashlib.sha256(P.joined(P.base_spans(t or "")).encode()).hexdigest()
    want = sorted(((i, *([1, 1, 1, 1] if t == TEXT else [0] * 4), digest(t), P.joined(P.base_spans(t or ""))) for i, t in rows), key=str)
    assert got == want
    assert P.personal_data(docs_of([]), trained.p).collect() == []
    red = {r.doc_id: r for r in P.redacted(docs_of(rows[:3]), trained.p).collect()}
    assert red[1].text == "Écris à [EMAIL] or [IP] and [PHONE], card [CARD]." and red[2].text is None and red[1].word == "w"
    assert P.fit(docs_of([])).keys() == trained.p.keys()
