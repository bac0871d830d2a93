"""Vector operators: exact dot products, hybrid blends, similarity pairs and approximate neighbours."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, query: list[float], k: int | None = None) -> DataFrame:
    """(id, score) by dot product of vectors(id, embedding) with one query; the k best."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = vectors.select("id", dot(F.col("embedding"), q).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def hybrid(lexical: DataFrame, vector: DataFrame, alpha: float, k: int, times: int = 2) -> DataFrame:
    """(id, score): the best ``times`` k of either list, scaled by its best score and blended, the k best."""
    best = lambda d, name: d.orderBy(F.desc("score"), "id").limit(times * k).select("id", F.col("score").alias(name))
    a, b = best(lexical, "s"), best(vector, "v")
    top = a.agg(F.coalesce(F.greatest(F.max("s"), F.lit(0.001)), F.lit(0.001)).alias("ms")).crossJoin(b.agg(F.coalesce(F.greatest(F.max("v"), F.lit(0.001)), F.lit(0.001)).alias("mv")))
    both = a.join(b, "id", "full_outer").crossJoin(F.broadcast(top))
    score = F.lit(1 - alpha) * F.coalesce(F.col("s") / F.col("ms"), F.lit(0.0)) + F.lit(alpha) * F.coalesce(F.col("v") / F.col("mv"), F.lit(0.0))
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(a, b, score): pairs a < b of vectors(id, owner, embedding) of different owners with dot product >= threshold.

    Every pair has to be looked at, so vectors are packed into blocks by hash. Each block is dealt to the tasks of the pairs of blocks
    that it is in, and a pair is one matrix product; only pairs over the threshold come out. The work is quadratic, as an exact
    answer without an index is; a task holds two blocks, whatever the table.
    """
    blocks = max(1, -(-vectors.count() // block))
    packed = vectors.select("id", "owner", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = packed.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})

    def solve(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        x = np.stack(table["embedding"].to_numpy(zero_copy_only=False)).astype(np.float64)
        ids, owners = table["id"].to_numpy(), np.array(table["owner"].to_pylist(), dtype=object)
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        score = x[left] @ x[right].T
        ia, ib = ids[left], ids[right]
        fits = (score >= threshold) & (owners[left][:, None] != owners[right][None])
        i, j = np.nonzero(fits & ((ia[:, None] < ib[None]) if p == q else np.ones_like(fits)))
        return pa.table({"a": np.minimum(ia[i], ib[j]), "b": np.maximum(ia[i], ib[j]), "score": score[i, j]})

    return dealt.groupBy("p", "q").applyInArrow(solve, "a long, b long, score double")


# Start and factor of the 64-bit FNV-1a hash, set by its definition.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def fnv(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of many slices of one byte buffer at once: a step a byte of the longest."""
    h = np.full(len(starts), FNV_START, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    out = np.empty_like(h)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))
        h[:n] = (h[:n] ^ data[starts[:n] + k]) * np.uint64(FNV_FACTOR)
    out[order] = h
    return out


def trigram_vectors(texts: list[str], dim: int = 256) -> np.ndarray:
    """Unit vectors of hashed character trigrams (single characters and the pair of shorter texts), whole tokens at half weight."""
    rows, weights, pieces = [], [], []
    for row, low in enumerate(texts):
        short = len(low) < 3
        grams = [low[i : i + 3] for i in range(len(low) - 2)]
        tokens = [t for t in _NO_WORD.split(low) if len(t.encode()) > 1]
        some = [bytes((ord(c) & 255,)) for c in low] if short else []
        some += [low.encode()] if len(low) == 2 else []
        own = some + [g.encode() for g in grams] + [t.encode() for t in tokens]
        pieces += own
        rows += [row] * len(own)
        weights += [1.0] * (len(own) - len(tokens)) + [0.5] * len(tokens)
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    slot = (fnv(data, np.cumsum(sizes) - sizes, sizes) % np.uint64(dim)).astype(np.int64)
    v = np.bincount(np.array(rows, np.int64) * dim + slot, weights, len(texts) * dim).reshape(-1, dim) if len(pieces) else np.zeros((len(texts), dim))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=v, where=norm > 0)


_NO_WORD = re.compile(r"[^\w]+", re.UNICODE)


def trigram_embedding(dim: int = 256):
    """A vectorised function text -> unit vector, as ``trigram_vectors`` gives it; a null text is empty."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known = {t: k for k, t in enumerate(dict.fromkeys((t or "").lower() for t in texts))}
        vectors = trigram_vectors(list(known), dim).astype(float)
        return pd.Series([vectors[known[(t or "").lower()]].tolist() for t in texts])

    return embed


def hashed_neighbours(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 12, bits: int = 5, seed: int = 4, block: int = 2048) -> DataFrame:
    """(query, id, score): about the k nearest of each query by random hyperplanes and probes one bit away, re-ranked by exact dot products.

    A query meets the vectors whose signs in some table differ from its own in one bit at most. With few bits these are most of all
    vectors, so pairs are never rows: vectors and queries are packed into blocks by hash, a task takes one block of either, finds its
    pairs and scores by array operations and returns the k best of each of its queries. The work grows with the product of both tables,
    a task's memory does not. Vectors with nulls, NaN or another length than the first are left out; of rows with one id one counts.
    """
    fit = lambda d: d.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    vectors, queries = fit(vectors), fit(queries)
    first = vectors.select("embedding").first()
    kind = vectors.schema["id"].dataType.simpleString()
    out = f"query {queries.schema['id'].dataType.simpleString()}, id {kind}, score double"
    if first is None:
        return vectors.sparkSession.createDataFrame([], out)
    dim = len(first[0])
    vectors, queries = (d.where(F.size("embedding") == dim).select("id", "embedding") for d in (vectors, queries))
    planes = np.random.RandomState(seed).randn(tables, bits, dim).reshape(-1, dim)
    # A task a pair of blocks: every row goes to as many tasks as the other side has blocks, so those of the few queries are larger.
    left, right = (max(1, -(-d.count() // rows)) for d, rows in ((queries, 4 * block), (vectors, block)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = queries.select("id", "embedding", F.lit(True).alias("asks"), part(left).alias("p"), spread(right).alias("q"))
    b = vectors.select("id", "embedding", F.lit(False).alias("asks"), spread(left).alias("p"), part(right).alias("q"))

    def solve(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        if asks.all() or not asks.any():
            return pa.table({"query": table["id"].slice(0, 0), "id": table["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        codes, known = sign_codes(x, planes), table["id"].combine_chunks()
        named = known.dictionary_encode()
        key = np.argsort(pc.sort_indices(named.dictionary).to_numpy())[named.indices.to_numpy()]
        once = lambda rows: rows[np.sort(np.unique(key[rows], return_index=True)[1])]
        rows, others = once(np.flatnonzero(asks)), once(np.flatnonzero(~asks))
        # Slices of queries, so that the pairs in memory are a quarter of a million.
        step = max(1, (1 << 18) // len(others))
        best = [best_of(x, codes, key, rows[i : i + step], others, k, bits) for i in range(0, len(rows), step)]
        i, j, score = (np.concatenate(c) for c in zip(*best))
        return pa.table({"query": known.take(pa.array(i)), "id": known.take(pa.array(j)), "score": score})

    met = a.unionByName(b).groupBy("p", "q").applyInArrow(solve, out)
    # Each task keeps its own best rows of a query before any are shuffled, so no query's candidates are gathered.
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return best.where(F.col("rank") <= k).select("query", "id", "score")


def sign_codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Whether each row is on the upper side of each plane."""
    side = np.zeros((len(x), len(planes)))
    # Sums in order, as ``dot`` makes them.
    for i in range(x.shape[1]):
        side += x[:, i, None] * planes[:, i]
    return side >= 0


def best_of(x: np.ndarray, codes: np.ndarray, key: np.ndarray, rows: np.ndarray, others: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, score) of the k best others that each row meets, ties to the smallest key."""
    own, far = (np.where(codes[r], 1.0, -1.0).astype(np.float32) for r in (rows, others))
    met = np.zeros((len(rows), len(others)), bool)
    # One bit apart or none: the product of the signs is bits - 2 or bits.
    for t in range(0, codes.shape[1], bits):
        met |= own[:, t : t + bits] @ far[:, t : t + bits].T > bits - 3
    met &= key[rows][:, None] != key[others][None]
    about = np.where(met, x[rows] @ x[others].T, -np.inf)
    least = -np.partition(-about, min(k, len(others)) - 1, axis=1)[:, min(k, len(others)) - 1]
    # The product's sums come in another order: what is in doubt stays in, and the scores are summed in order.
    doubt = 1e-9 * (1 + np.linalg.norm(x[rows], axis=1) * np.linalg.norm(x[others], axis=1).max())
    i, j = np.nonzero(met & (about >= (least - doubt)[:, None]))
    i, j = rows[i], others[j]
    score = np.zeros(len(i))
    for c in range(x.shape[1]):
        score += x[i, c] * x[j, c]
    order = np.lexsort((key[j], -score, i))
    order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
    return i[order], j[order], score[order]
