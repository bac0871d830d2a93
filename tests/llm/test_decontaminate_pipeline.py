import random

import numpy as np
import pytest

from codeweave.llm import decontaminate as D
from tests.llm.test_jaccard_join import brute as components


def words_of(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return D.words_of(raw, np.array([0, len(raw)]))[0]


def brute(rows, items):
    """All diagonals of all pairs; a seed's window must match somewhere on the diagonal."""
    out = {}
    for i, t in rows:
        doc = words_of(t)
        for k, x in items:
            item = words_of(x)
            for shift in range(-len(item) + 1, len(doc)):
                a, b = max(0, shift), min(len(doc), shift + len(item))
                same = doc[a:b] == item[a - shift : b - shift]
                masks = [[j for j, c in enumerate(m) if c == "1"] + [len(m) - 1] for m in D.MASKS] + ([list(range(len(item)))] if 0 < len(item) < D.SHORT else [])
                hit = any(all(same[s + j] for j in m) for m in masks for s in range(len(same) - max(m)))
                found = D.best_stretch(same)
                if hit and i is not None and D.accepted(*found, len(item)):
                    out[i, k] = max(out.get((i, k), (0, 0)), found)
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.choice([4, 9, 25, 40])))) for k in range(12)] + [(50, None), (51, "")]
    rows = []
    for k in range(40):
        w = [word() for _ in range(50)]
        if k % 2:
            part = items[k % 12][1].split()
            for _ in range(rng.randint(0, len(part) // 7)):
                part[rng.randrange(len(part))] = word()
            w[20:20] = [x.upper() + "," for x in part] if k % 4 == 1 else part
        rows.append((k, " ".join(w)))
    return rows + [(90, None), (91, ""), (None, items[3][1]), (1, rows[1][1])], items


@pytest.mark.parametrize("bound", [D.BROADCAST_SEEDS, 0])
def test_equals_brute_force(spark, docs_of, case, bound):
    rows, items = case
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in D.contaminations(docs_of(rows), table, bound).collect())
    assert got == brute(rows, items) and len(got) >= 15
    assert D.contaminations(docs_of([]), table, bound).collect() == []
    assert D.contaminations(docs_of(rows), table.where("false"), bound).collect() == []


def test_best_stretch():
    assert D.best_stretch(np.array([0, 1, 1, 0, 1, 1, 1, 0, 0, 1], bool)) == (5, 6)
    assert D.best_stretch(np.zeros(4, bool)) == (0, 0)


def by_rule(same, item_words):
    """(matches, length) of the stretch with the most matches (the shortest of equals) of all that meet the stated rule, or None."""
    found = [(int(same[a:b].sum()), a - b) for a in range(len(same)) for b in range(a + 1, len(same) + 1)]
    found = [(m, n) for m, n in found if m >= min(10, item_words) and 4 * m >= 3 * -n]
    return (max(found)[0], -max(found)[1]) if found else None


def test_stretches_by_the_rule():
    rng = np.random.RandomState(4)
    met = 0
    for _ in range(600):
        same = rng.rand(rng.randint(1, 45)) < rng.choice([0.5, 0.7, 0.8, 0.9])
        found, want = D.best_stretch(same), by_rule(same, len(same))
        assert D.accepted(*found, len(same)) == (want is not None), same
        assert want is None or found == want, same
        met += want is not None
    assert 100 < met < 500


def test_words_lose_all_marks_at_their_ends():
    assert (words_of("wait...... ((((((Ab.c)))))) ?!?!?!?! it's") == words_of("WAIT ab.c it's")).all()
    assert len(words_of(" .. ,,,, ")) == 0 and len(words_of("")) == 0


@pytest.mark.parametrize("bound", [D.BROADCAST_SEEDS, 0])
@pytest.mark.parametrize("n", [300, 2000])
def test_long_overlaps_count_whole(spark, docs_of, bound, n):
    item = [f"w{k}" for k in range(n)]
    copied = ["x" if k % 9 == 4 else w for k, w in enumerate(item)]
    table = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = docs_of([(1, "so " + " ".join(copied) + " on"), (1, "other text"), (2, " ".join(item[n // 2 :])), (2, " ".join(item[: n // 3]))])
    same = n - sum(k % 9 == 4 for k in range(n))
    got = sorted(tuple(r) for r in D.contaminations(docs, table, bound).collect())
    assert got == [(1, 7, same, n - (n % 9 == 5)), (2, 7, n - n // 2, n - n // 2)]


def test_seeds_reach_nearly_all_overlaps():
    """Against every diagonal: items of 12 to 60 words in a document, words substituted at random, the rule met by some stretch."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    met = seeded = 0
    for _ in range(900):
        item = [word() for _ in range(rng.randint(12, 60))]
        share = rng.choice([0.1, 0.15, 0.2, 0.25])
        doc = [word() for _ in range(10)] + [word() if rng.random() < share else w for w in item] + [word() for _ in range(10)]
        d, i = words_of(" ".join(doc)), words_of(" ".join(item))
        diagonals = [D.align(d, i, shift) for shift in range(-len(i) + 1, len(d))]
        if any(D.accepted(*f, len(i)) for f in diagonals):
            met += 1
            seeds = D.Seeds(np.array([0]), i, np.array([0, len(i)]))
            h, _ = seeds.windows(d, np.array([0, len(d)]))
            seeded += bool(np.isin(h, seeds.hash).any())
    assert met > 600 and seeded / met >= 0.97


@pytest.mark.parametrize("bound", [D.BROADCAST_SEEDS, 0])
def test_a_cleaner_core_does_not_hide_a_stretch(spark, docs_of, bound):
    item = [f"w{k}" for k in range(17)]
    copied = item[:9] + ["x", "y", "z"] + item[12:]
    table = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = docs_of([(1, "so " + " ".join(copied) + " on"), (2, " ".join(item[:9] + ["x", "y", "z", "v", "u"] + item[14:]))])
    assert [tuple(r) for r in D.contaminations(docs, table, bound).collect()] == [(1, 7, 14, 17)]


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from codeweave.llm import packing, pii, toxicity

    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(3)) for _ in range(n))
    rows = [(i, t) for i, t in corpus if i is not None and i != 0] + [(0, corpus[0][1])]
    rows += [(500 + k, prose(30) + (" vrekka " if k % 2 else " ") + prose(5)) for k in range(60)]
    items = [(k, prose(20)) for k in range(3)]
    rows += [(700 + k, prose(30) + " " + items[k][1] + " bob@mail.example.com " + prose(4)) for k in range(3)] + [(800, prose(9) + " mail bob.1@mail.example.com now")]
    rows += [(None, "a row without an id"), (None, "a row without an id"), (None, corpus[0][1]), (None, prose(30) + " vrekka"), (None, prose(9) + " " + items[1][1] + " end"), (None, None)]
    # One bad row doesn't take the others of its id along, and one row of an id stays.
    rows += [(900, prose(20) + " vrekka here"), (900, "the good row of an id"), (900, "a row without an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 1, 2, "r") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rows long, row long, _deal string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = spark.createDataFrame([(500 + k, 1, k % 2) for k in range(60)] + [(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = corpus_pipeline.toxicity_model(docs, marks)
    grammar = toxicity.Grammar(model["lexicon"])
    mad = lambda t: grammar.features(t or "")[0] @ np.array(model["coef"]) + model["bias"] >= np.log(0.3 / 0.7)
    kept = [(i, t) for i, t in rows if not mad(t)]
    assert {i for i, _ in rows} - {i for i, _ in kept} == {500 + k for k in range(1, 60, 2)} and len(rows) - len(kept) == 32
    # Rows without an id are documents of their text, after all others.
    texts = {t or "": (1 << 62) + k for k, t in enumerate(sorted({t or "" for i, t in kept if i is None}))}
    kept = [(texts[t or ""] if i is None else i, t) for i, t in kept]
    group = components(kept)
    kept = [(i, t) for i, t in kept if group[i][1] == i]
    kept = [(i, min(t or "" for j, t in kept if j == i)) for i in {i for i, _ in kept}]
    leaks = {i for i, *_ in brute(kept, items)}
    assert leaks >= {700, 701, 702} and len(leaks) == 4
    kept = [(None if i >= 1 << 62 else i, t) for i, t in kept if i not in leaks]
    assert (900, "a row without an id") in kept and sum(i is None for i, _ in kept) == 1
    want = {i: pii.redact(t or "", pii.base_spans(t or "")) for i, t in kept}
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, want)) and "[EMAIL]" in want[800]
    words = packing.WordIds(__import__("public_tokenizers").path(packing.TOKENIZER))
    size = {i: len(next(words.ids([t.encode()]))) // 4 + 1 for i, t in want.items()}
    assert {r.doc_id: r.length for r in got} == size
    assert len({r.sequence_id for r in got}) == -(-sum(size.values()) // packing.CAPACITY)


def test_pipeline_of_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
