"""The thin queries: columns, splits and thresholds of the contracts."""

import random
import zlib

import duckdb
import pytest

from codeweave.llm import registry as R

LONG, TEXT, REAL, FLAG = "bigint", "string", "double", "boolean"
COLUMNS = {
    "op1_tiff": {"doc_id": LONG, "n_bytes": LONG, "payload_bytes": LONG, "payload_sha256": TEXT, "tail_crc32": LONG, "media_bytes": LONG, "media_sha256": TEXT, "feature": TEXT},
    "op2_context_tree": {"doc_id": LONG, "held_out": FLAG, "n_tokens": LONG, "n_known": LONG, "train_tokens": LONG, "base_score": REAL, "score": REAL},
    "op3_warc": {"page_id": LONG, "payload_bytes": LONG, "payload_digest": TEXT, "record_type": TEXT, "refers_to": LONG},
    "op4_language_id": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL},
    "op5_best_fit_packing": {"doc_id": LONG, "piece": "int", "start": LONG, "length": LONG, "ids_crc32": LONG, "sequence_id": LONG, "offset": LONG},
    "op6_pii": {"doc_id": LONG, "n_email": LONG, "n_ip": LONG, "n_card": LONG, "n_phone": LONG, "base_sha256": TEXT, "spans": TEXT},
    "op7_quality": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": "int"},
    "op8_decontaminate": {"doc_id": LONG, "item_id": LONG},
    "op9_toxicity": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": "int"},
    "op10_jaccard_join": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG},
}
PARTS = {"op2_context_tree": (5, 1), "op4_language_id": (3, 1), "op7_quality": (5, 0), "op9_toxicity": (4, 2)}


def held(name, i):
    modulus, rest = PARTS[name]
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(0)
    syllables = {"en": "th er on an re he".split(), "de": "ch ei sch en ung ver".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word(("en", "de")[i % 2]) for _ in range(rng.randint(1, 60))) + (" Vrekka É!" if i % 5 == 0 else ""), ("en", "de")[i % 2] if i % 7 else None, "s") for i in range(120)]
    docs += [(200, None, "en", "s"), (201, "", "de", "s"), (202, "12 .. 34", "en", "s"), (203, "x" * 64, "en", "s")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, source, 1, 0.5) for i, t, lang, source in docs], "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(120)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "u", "<p>a" * 40), (2, None, "<p>a" * 40), (3, "u", None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, docs[3][1]), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_rows_and_splits(spark, tables, name, monkeypatch):
    folder, docs = tables
    text = {i: t for i, t, _, _ in docs}
    learned = []
    for f in ("fit_quality", "fit_toxicity"):
        monkeypatch.setattr(R, f, lambda texts, y, fit=getattr(R, f): learned.extend(texts) or fit(texts, y))
    monkeypatch.setattr(R.langid, "fit", lambda texts, y, fit=R.langid.fit: learned.extend(texts) or fit(texts, y, steps=20))
    df = R.queries()[name](spark, folder)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    if "predicted" in types:
        assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows) and len({r.predicted for r in rows}) == 2
    if name in PARTS:
        assert {r.doc_id: r.held_out for r in rows} == {i: held(name, i) for i in text} and len(rows) == len(docs)
        assert name == "op2_context_tree" or (learned and set(learned) <= {t for i, t in text.items() if not held(name, i)})
    if name == "op4_language_id":
        assert {r.doc_id for r in rows if r.lang_pred == "und"} == {200, 201, 202}


def test_base_columns_equal_sql(spark, tables):
    """What SQL can express of the queries without an oracle: the payload's digests, and the counts and base score."""
    folder, _ = tables
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = db.execute("""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
        SELECT doc_id, n, greatest(64, (n + 63) // 64 * 64) AS m, sha256(encode(t) || encode(repeat(chr(0), greatest(64, (n + 63) // 64 * 64) - n)))
        FROM t ORDER BY 1""").fetchall()
    got = R.op1_tiff(spark, folder).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    ids = db.execute("SELECT doc_id FROM documents").fetchall()
    db.execute("CREATE TABLE parts (doc_id BIGINT, held BOOLEAN)")
    db.executemany("INSERT INTO parts VALUES (?, ?)", [(i, held("op2_context_tree", i)) for (i,) in ids])
    want = db.execute(r"""
        WITH t AS (SELECT d.doc_id, p.held, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents d JOIN parts p USING (doc_id)),
        u AS (SELECT doc_id, held, unnest(w) AS w FROM t),
        c AS (SELECT w, count(*) AS c FROM u WHERE NOT held GROUP BY w),
        s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, any_value(held), count(*), count(c), any_value(n)::BIGINT, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) FROM u LEFT JOIN c USING (w), s GROUP BY doc_id ORDER BY 1""").fetchall()
    got = R.op2_context_tree(spark, folder).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").orderBy("doc_id").collect()
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_drawn_rows_are_the_smallest_of_each_group(spark):
    from pyspark.sql import functions as F

    from codeweave.llm import common

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 0, "few").otherwise("many").alias("g"))
    rows = rows.unionAll(rows.where("doc_id < 2000")).unionAll(spark.createDataFrame([(None, "none")], "doc_id long, g string").where("false"))
    got = common.drawn(rows, 40, "g").collect()
    hashes = {r.doc_id: (r.h, r.doc_id) for r in rows.select("doc_id", F.expr("pmod(xxhash64(doc_id), 2147483648)").alias("h")).distinct().collect()}
    many = sorted((i for i in range(5000) if i % 500), key=hashes.get)[:40]
    assert {r.doc_id for r in got if r.g == "many"} == set(many) and sum(r.g == "few" for r in got) == 10 and len(got) == 50
    assert common.drawn(rows.where("false"), 3, "g").collect() == []
