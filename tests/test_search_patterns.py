from codeweave.operators import patterns, search
from codeweave.sources import wiki


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_patterns(spark):
    s = spark.createDataFrame([("B", "Base", "Class", ""), ("C1", "One", "Class", ""), ("C2", "Two", "Class", ""), ("mk", "create_it", "Method", ""), ("C1.get", "get_instance", "Method", "C1"), ("C1.i", "_instance", "Field", "C1"), ("C2.sub", "subscribe", "Method", "C2"), ("C2.n", "notify", "Method", "C2"), ("B.run", "run", "Method", "B"), ("C2.run", "run", "Method", "C2")], "id string, name string, kind string, parent string")
    calls = spark.createDataFrame([("mk", "C1"), ("mk", "C2"), ("C2.run", "B.run")], "src string, dst string")
    up = spark.createDataFrame([("C1", "B"), ("C2", "B"), ("C3", "B")], "src string, dst string")
    assert rows(patterns.detect(s, calls, up), "pattern", "id", "confidence") == [("Decorator", "C2", "medium"), ("Factory", "mk", "high"), ("Observer", "C2", "medium"), ("Singleton", "C1", "high"), ("Strategy", "B", "medium")]
    assert rows(patterns.detect(s, calls, up, ["Strategy"]), "id") == [("B",)]


def test_unified_search(spark):
    docs = spark.createDataFrame([(1, "parse the token stream"), (2, "token"), (3, "other thing")], "id int, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id int, embedding array<float>")
    symbols = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 2, 3)], "id int, file string, start_line int, end_line int")
    files = spark.createDataFrame([("a", "x\ntoken\ntoken y")], "path string, content string")
    plain = dict(rows(search.unified(docs, vectors, [1.0, 0.0], "token", 3)))
    hits = dict(rows(search.unified(docs, vectors, [1.0, 0.0], "token", 3, symbols, files)))
    assert round(hits[1] - plain[1], 6) == 0.1 and hits[2] == plain[2] and plain[3] < plain[2]


def test_wiki(spark):
    html = "<h2>T &amp; x</h2><p>a <b>bold</b> <a href='/u'>l</a></p><ul><li>one</li><li>two<ol><li>in</li></ol></li></ul><pre>x  y\nz</pre><table><tr><th>h</th><td>c</td></tr></table>"
    assert wiki.markdown(html) == "## T & x\n\na **bold** [l](/u)\n- one\n- two\n  1. in\n\n```\nx  y\nz\n```\n\n| h | c |"
    assert wiki.markdown(None) == ""
    pages = spark.createDataFrame([(1, "<p>x</p>")], "id long, html string")
    assert rows(wiki.pages_as_markdown(pages), "id", "text") == [(1, "x")]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 9)], "src long, dst long")
    assert rows(wiki.crawl(pages.select("id"), links, depth=2)) == [(1, 0), (2, 1), (3, 2), (9, 1)]
    assert rows(wiki.crawl(pages.select("id"), links, depth=5, most=2)) == [(1, 0), (2, 1)]
    remote = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01"), (4, "2023-01-01")], "id long, modified string")
    stored = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    write, gone = wiki.synchronised(stored, remote, "2024-02-01")
    assert rows(write, "id") == [(2,), (4,)] and rows(gone) == [(3,)]


def test_trigram_vectors_equal_plain_code():
    import re

    import numpy as np

    from codeweave.operators import vectors as V

    def fnv(raw):
        h = V.FNV_START
        for c in raw:
            h = (h ^ c) * V.FNV_FACTOR & 0xFFFFFFFFFFFFFFFF
        return h

    def one(low):
        v = np.zeros(256)
        short = [bytes((ord(c) & 255,)) for c in low] if len(low) < 3 else []
        for piece in short + ([low.encode()] if len(low) == 2 else []) + [low[i : i + 3].encode() for i in range(len(low) - 2)]:
            v[fnv(piece) % 256] += 1
        for t in re.split(r"[^\w]+", low):
            if len(t.encode()) > 1:
                v[fnv(t.encode()) % 256] += 0.5
        return v / np.sqrt((v * v).sum()) if v.any() else v

    texts = ["hello world", "ab", "a", "", "é", "the é x_y 12 日本語", "hello world"]
    assert np.allclose(V.trigram_vectors(texts), [one(t) for t in texts]) and V.trigram_vectors([]).shape == (0, 256)


def test_similar_pairs_over_many_blocks(spark):
    import random

    from codeweave.operators import vectors as V

    rng = random.Random(1)
    rows = [(i, rng.randint(0, 2), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, None, [1.0] * 4)]
    table = spark.createDataFrame(rows, "id long, owner int, embedding array<float>")
    f = {r.id: [float(x) for x in r.embedding] for r in table.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(f[a], f[b]))
    want = {(a, b) for a, oa, _ in rows for b, ob, _ in rows if a < b and oa != ob and dot(a, b) >= 1.5}
    assert {(r.a, r.b) for r in V.similar_pairs(table, 1.5, 7).collect()} == want and len(want) > 30


def test_route_handlers_equal_brute_force_and_meet_by_line(spark):
    import random

    from codeweave.functions.routes import handler_edges

    rng = random.Random(3)
    some = lambda n: None if rng.random() < 0.05 else rng.randint(0, n)
    made = [(i, rng.choice(["Route", "Function", "Method", "Class"]), rng.choice(["a", "b", None]), lo := some(40), None if lo is None else rng.choice([None, lo, lo + 2, lo + 9])) for i in range(300)]
    made += [(made[k][0], *made[k + 1][1:]) for k in range(20)]  # some ids twice
    want = {}
    for src, kind, file, low, high in made:
        for i, k, f, start, end in made:
            if kind == "Route" and k in ("Function", "Method") and file and f == file and None not in (low, high, start, end) and start <= high and end >= low:
                want[src] = min(want.get(src, (start, i)), (start, i))
    df = handler_edges(spark.createDataFrame(made, "id long, kind string, file string, start_line int, end_line int"))
    assert {r.src: r.dst for r in df.collect()} == {k: v[1] for k, v in want.items()}
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("line" in x for x in joins) and not any("end_line" in x for x in joins)
