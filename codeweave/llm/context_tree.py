"""Language-model scoring by context-tree weighting over bytes.

A token is the bytes of a word and a space; the end of a text is one byte of its own. Each byte is decomposed into eight binary
decisions; the context of a decision is the ``DEPTH`` bytes before it and the decisions taken in the byte. Contexts reach into the
word before and no farther (spaces stand for what lies beyond). Every context of every depth has a Krichevsky-Trofimov estimate
from the training counts, and the weighted tree mixes the estimates of all depths of a path. A context that training never saw
takes no part: the mixture ends at the deepest one seen.

The tree needs counts of pairs of a context and a byte. The first four bytes of a token (its head, with the end of the word
before) are counted as they stand; the others depend on the word alone and are counted, and later scored, once a distinct word.
Counts are summed by a shuffle, never in one place. Subtrees below the two nearest bytes (three, where two have many pairs) are
weighted in parallel, once; their sums give the contexts of two bytes, summed and weighted in the executors too. What lies above has
at most 256 contexts and is weighted on the driver. Documents look up the most frequent words and pairs in tables of bounded size and
join the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm import common
from codeweave.llm.common import LOWER, U64
from codeweave.session import materialize

DEPTH = 5
END = b"\n"
#: Words that every executor gets at most (24 bytes each), and pairs of context and byte (16 bytes each).
TOP_WORDS = 400_000
TOP_PAIRS = 3_000_000
#: Pairs with the same two nearest bytes that are weighted as one group; more are parted by the third (at most 256 ** 3 pairs a part).
GROUP_PAIRS = 20_000
_SPACE = 0x20
#: Fills heads of words of fewer than HEAD - 1 bytes; no word has this byte.
_NONE = 0x0B
HEAD = DEPTH - 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after a shift by eight."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift += np.where(small, np.log(np.where(small, y, 1)), 0)
        y = np.where(small, y + 1, y)
    inv = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 1.1447298858494002 - log_gamma(zeros + ones + 1.0)


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the lowered bytes between starts and ends."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(LOWER[data[where]].tobytes())])


def head_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the heads of all tokens, then of the rows' end tokens, and the row of each.

    A key holds the first HEAD bytes of the token with its space in the low half, first lowest, and the last HEAD bytes of the word
    before in the high half, last lowest.
    """
    rows = len(at) - 1
    n = len(starts)
    row = np.repeat(np.arange(rows), np.diff(at))
    before = np.concatenate([np.arange(n) - 1, at[1:] - 1])
    row_all = np.concatenate([row, np.arange(rows)])
    has = before >= at[row_all]
    key = np.full(n + rows, int.from_bytes(END + bytes([_NONE] * (HEAD - 1)), "little"), U64)
    low = np.zeros(n, U64)
    for k in range(HEAD):
        place = starts + k
        byte = np.where(place < ends, LOWER[data[np.minimum(place, max(0, len(data) - 1))]] if n else 0, np.where(place == ends, _SPACE, _NONE))
        low |= byte.astype(U64) << U64(8 * k)
    key[:n] = low
    last = np.where(has, before, 0)
    for k in range(HEAD):
        if n:
            place = ends[last] - 1 - k
            byte = np.where(has & (place >= starts[last]), LOWER[data[np.maximum(place, 0)]], _SPACE)
        else:
            byte = np.full(rows, _SPACE)
        key |= byte.astype(U64) << U64(8 * (HEAD + k))
    return key, row_all


def head_pairs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (keys, HEAD) of the bytes of each head, and which of them there are."""
    byte = lambda i: key >> U64(8 * i) & U64(255)
    pairs = np.zeros((len(key), HEAD), U64)
    for i in range(HEAD):
        pairs[:, i] = byte(i)
        for k in range(1, DEPTH + 1):
            near = byte(i - k) if k <= i else U64(_SPACE) if k == i + 1 else byte(HEAD + k - i - 2)
            pairs[:, i] |= near << U64(8 * k)
    there = np.stack([byte(i) != _NONE for i in range(HEAD)], 1)
    return pairs, there


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, pair, c): training counts of every distinct token (pair null; the end token as END) and of every pair in a head (word null)."""
    schema = pa.schema([("word", pa.binary()), ("pair", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_seen, any_row = 0, False
        for batch in common.by_bytes(batches, most=12 << 20):
            data, offsets = common.text_buffer(batch.column(0))
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            ends_seen, any_row = ends_seen + int(train.sum()), True
            starts, ends, at = common.word_bounds(data, offsets)
            key, row = head_keys(data, starts, ends, at)
            key, number = np.unique(key, return_inverse=True)
            c = np.bincount(number, train[row], len(key))
            pairs, there = head_pairs(key)
            pairs, number = np.unique(pairs[there], return_inverse=True)
            c = np.bincount(number, np.broadcast_to(c[:, None], there.shape)[there], len(pairs)).astype(np.int64)
            for i in range(0, len(pairs), 200_000):
                part = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(c[part]), pa.binary()), pa.array(pairs[part].view(np.int64)), pa.array(c[part])], schema=schema)
            _, first, number = np.unique(common.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            c = np.bincount(number, np.repeat(train, np.diff(at)), len(first)).astype(np.int64)
            starts, ends = starts[first], ends[first]
            for i in range(0, len(first), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([slices(data, starts[part], ends[part]), pa.nulls(len(c[part]), pa.int64()), pa.array(c[part])], schema=schema)
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.nulls(1, pa.int64()), pa.array([ends_seen], pa.int64())], schema=schema)

    return docs.select("text", "train").mapInArrow(run, "word binary, pair long, c long").groupBy("word", "pair").agg(F.sum("c").alias("c"))


def pairs_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every token after its head: its pair (the byte, then the DEPTH bytes before it, nearest first) and its word."""
    data, offsets = common.text_buffer(words)
    size = np.diff(offsets)
    # Each word after a space and before one.
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    buffer = np.full(begin[-1], _SPACE, np.uint8)
    buffer[np.repeat(begin[:-1] + 1 - offsets[:-1], size) + np.arange(len(data))] = data
    n = np.maximum(0, size + 1 - HEAD)
    word = np.repeat(np.arange(len(n)), n)
    place = np.repeat(begin[:-1] + 1 + HEAD - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    key = buffer[place].astype(U64)
    for d in range(1, DEPTH + 1):
        key |= buffer[place - d].astype(U64) << U64(8 * d)
    return key, word


def pair_counts(words: DataFrame, heads: DataFrame) -> DataFrame:
    """(pair, c): every pair in words(word, c) after the heads, and in heads(pair, c), with its count in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            key = np.concatenate([h[0] for h in held])
            c = np.concatenate([h[1] for h in held])
            key, number = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, number, c)
            for i in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 200_000].view(np.int64)), pa.array(total[i : i + 200_000])], ["pair", "c"])

        for batch in batches:
            key, word = pairs_of(batch.column(0))
            held.append((key, batch.column(1).to_numpy()[word]))
            size += len(key)
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    inner = words.select("word", "c").mapInArrow(run, "pair long, c long")
    return inner.union(heads.select("pair", "c")).groupBy("pair").agg(F.sum("c").alias("c"))


class Subtree:
    """The contexts of depth ``top`` to DEPTH of one group of pairs, and their weights."""

    def __init__(self, pair: np.ndarray, c: np.ndarray, top: int):
        pair = pair.view(U64)
        byte = (pair & U64(255)).astype(np.int64)
        self.byte, self.top = byte, top
        self.nodes: dict[tuple[int, int], tuple] = {}
        for j in range(8):
            node = (1 << j) | byte >> (8 - j)
            bit = byte >> (7 - j) & 1
            below = None
            for d in range(DEPTH, top - 1, -1):
                context = pair >> U64(8) & U64((1 << 8 * d) - 1)
                key, first, number = np.unique(context << U64(8) | node.astype(U64), return_index=True, return_inverse=True)
                zeros = np.bincount(number, c * (1 - bit), len(key))
                ones = np.bincount(number, c * bit, len(key))
                own = log_kt(zeros, ones)
                if below is None:
                    beta, weighted = np.ones(len(key)), own
                else:
                    deeper_first, deeper = below
                    under = np.bincount(number[deeper_first], deeper, len(key))
                    beta = 1 / (1 + np.exp(np.clip(under - own, -700, 700)))
                    weighted = np.logaddexp(own, under) - np.log(2.0)
                below = first, weighted
                self.nodes[d, j] = key, number, zeros, ones, beta, weighted

    def below(self) -> np.ndarray:
        """For each pair and bit of its byte (n, 8) the probability of a one that the contexts of ``top`` bytes and more give; NaN if none was seen."""
        out = np.full((len(self.byte), 8), np.nan)
        for j in range(8):
            for d in range(DEPTH, self.top - 1, -1):
                _, number, zeros, ones, beta, _ = self.nodes[d, j]
                kt, b, seen = ((ones + 0.5) / (zeros + ones + 1))[number], beta[number], (zeros + ones > 0)[number]
                out[:, j] = np.where(seen, mixed(out[:, j], kt, b), out[:, j])
        return out


def mixed(one: np.ndarray, kt: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """What a context makes of the probability from those that hold it; the estimate itself where there is none (NaN)."""
    return np.where(np.isnan(one), kt, beta * kt + (1 - beta) * one)


_WEIGHED = pa.schema([("near", pa.int64()), ("bucket", pa.int64()), ("pair", pa.int64()), ("below", pa.binary()), ("node", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("under", pa.float64())])
_WEIGHED_SQL = "near long, bucket long, pair long, below binary, node long, zeros double, ones double, under double"
_LEVEL = pa.schema([("near", pa.int64()), ("node", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("beta", pa.float64()), ("weighted", pa.float64())])
_LEVEL_SQL = "near long, node long, zeros double, ones double, beta double, weighted double"


def _weigh(table: pa.Table) -> pa.Table:
    """A group of pairs to a row a pair with what lies below, and a row a node with the sums over its contexts of three bytes."""
    pair = table["pair"].to_numpy()
    near, bucket = table["near"][0].as_py(), table["bucket"][0].as_py()
    tree = Subtree(pair, table["c"].to_numpy().astype(np.float64), 3)
    sums = np.zeros((4, 256))
    for j in range(8):
        key, _, zeros, ones, _, weighted = tree.nodes[3, j]
        node = (key & U64(255)).astype(np.int64)
        for k, value in enumerate((zeros, ones, weighted, np.ones(len(node)))):
            sums[k] += np.bincount(node, value, 256)
    below = tree.below()
    nodes = np.flatnonzero(sums[3])
    n, m = len(pair), len(nodes)
    of_pairs = [np.full(n, near), np.full(n, bucket), pair, pa.array([r.tobytes() for r in below], pa.binary()), *(pa.nulls(n, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
    of_nodes = [np.full(m, near), np.full(m, bucket), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), nodes, *(sums[k][nodes] for k in range(3))]
    return pa.concat_tables(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(part, _WEIGHED)], schema=_WEIGHED) for part in (of_pairs, of_nodes))


def _weigh_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        zeros, ones, under = (batch.column(k).to_numpy() for k in (2, 3, 4))
        beta, weighted = weighed(zeros, ones, under)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(beta), pa.array(weighted)], schema=_LEVEL)


def weighed(zeros: np.ndarray, ones: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of a context's own estimate in its mixture, and its weighted log probability; under: the sum of those one byte longer."""
    own = log_kt(zeros, ones)
    return 1 / (1 + np.exp(np.clip(under - own, -700, 700))), np.logaddexp(own, under) - np.log(2.0)


def upper_levels(level: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Depths 1 and 0 from sums (near, node, zeros, ones, under) over the contexts of two bytes by the nearest: (KT of one, beta, seen), each (contexts, 256 nodes)."""
    place = level["near"].to_numpy() * 256 + level["node"].to_numpy()
    sums = [np.bincount(place, level[k].to_numpy(), 256 * 256).reshape(256, 256) for k in ("zeros", "ones", "under")]
    out = {}
    for d in (1, 0):
        zeros, ones, under = sums
        beta, weighted = weighed(zeros, ones, under)
        out[d] = ((ones + 0.5) / (zeros + ones + 1), beta, zeros + ones > 0)
        sums = [s.sum(0, keepdims=True) for s in (zeros, ones, np.where(zeros + ones > 0, weighted, 0.0))]
    return out


def pair_scores(pairs: DataFrame) -> DataFrame:
    """(pair, score): log10 probability of the byte after its context, for every pair, seen in training or not."""
    near = pairs.withColumn("near", F.expr("shiftright(pair, 8) & 65535"))
    # At most 65536 of them, whatever the pairs.
    many = F.broadcast(near.groupBy("near").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_PAIRS).select("near", F.lit(True).alias("many")))
    bucket = F.when(F.col("many"), F.expr("shiftright(pair, 24) & 255")).otherwise(-1).cast("long")
    grouped = near.join(many, "near", "left").select("pair", "c", "near", bucket.alias("bucket"))
    weights = materialize(grouped.groupBy("near", "bucket").applyInArrow(_weigh, _WEIGHED_SQL), "subtrees")
    sums = weights.where("node is not null").groupBy("near", "node").agg(*(F.sum(k).alias(k) for k in ("zeros", "ones", "under")))
    level = materialize(sums.mapInArrow(_weigh_nodes, _LEVEL_SQL), "level")
    # At most 256 nearest bytes with 255 nodes.
    first = level.groupBy(F.expr("near & 255").alias("near"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("under"))
    shared = pairs.sparkSession.sparkContext.broadcast(upper_levels(first.toArrow()))

    def score(own: pa.Table, nodes: pa.Table) -> pa.Table:
        pair = own["pair"].to_numpy()
        parts = np.frombuffer(b"".join(own["below"].to_pylist())).reshape(-1, 8)
        zeros, ones, beta = np.zeros(256), np.zeros(256), np.ones(256)
        at = nodes["node"].to_numpy()
        for k, value in (("zeros", zeros), ("ones", ones), ("beta", beta)):
            value[at] = nodes[k].to_numpy()
        byte, nearest, out = pair & 255, pair >> 8 & 255, np.zeros(len(pair))
        for j in range(8):
            node = (1 << j) | byte >> (8 - j)
            one = parts[:, j]
            for kt, b, seen in (((ones + 0.5) / (zeros + ones + 1), beta, zeros + ones > 0), *(tuple(a[nearest if d else 0] for a in shared.value[d]) for d in (1, 0))):
                kt, b, seen = (a[np.arange(len(node)), node] if a.ndim == 2 else a[node] for a in (kt, b, seen))
                one = np.where(seen, mixed(one, kt, b), one)
            one = np.where(np.isnan(one), 0.5, one)
            out += np.log10(np.where(byte >> (7 - j) & 1 == 1, one, 1 - one))
        return pa.table({"pair": pair, "score": out})

    parts = weights.where("pair is not null").select("near", "bucket", "pair", "below")
    groups = parts.select(F.col("near").alias("near"), F.col("bucket").alias("bucket")).distinct()
    dealt = level.join(groups, "near").select("near", "bucket", "node", "zeros", "ones", "beta")
    return parts.groupBy("near", "bucket").cogroup(dealt.groupBy("near", "bucket")).applyInArrow(score, "pair long, score double")


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of table(c, ...) with the largest counts: as many bins of counts, from the top, as have at most ``most`` rows together."""
    # Sixteen bins a doubling, so a thousand rows at most.
    binned = table.withColumn("bin", F.floor(F.log2(F.greatest(F.col("c"), F.lit(1)).cast("double")) * 16).cast("int"))
    histogram = binned.groupBy("bin").count().collect()
    least, total = 1 << 30, 0
    for b, times in sorted(((r[0], r[1]) for r in histogram), reverse=True):
        total += times
        if total > most:
            break
        least = b
    return binned.where(F.col("bin") >= least).drop("bin")


def word_scores(words: DataFrame, scored: DataFrame, shared, whole: bool) -> DataFrame:
    """(word, c, score) for words(word, c): the log10 probability of what follows each token's head.

    scored(pair, score); ``shared``: broadcast sorted pairs and scores, of all pairs if ``whole``, else of the most frequent; the
    other pairs are joined.
    """
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("pair", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = np.frombuffer(shared.value[0], U64), np.frombuffer(shared.value[1])
        for batch in batches:
            pair, word = pairs_of(batch.column(0))
            k = np.minimum(np.searchsorted(key, pair), max(0, len(key) - 1))
            found = key[k] == pair if len(key) else np.zeros(len(pair), bool)
            total = np.bincount(word[found], value[k[found]], batch.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(batch.num_rows, pa.int64()), pa.array(total)], schema=schema)
            pair, word = pair[~found], word[~found]
            for i in range(0, len(pair), 100_000):
                n = len(pair[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(word[i : i + n])), pa.nulls(n, pa.int64()), pa.array(pair[i : i + n].view(np.int64)), pa.nulls(n, pa.float64())], schema=schema)

    rows = words.select("word", "c").mapInArrow(run, "word binary, c long, pair long, score double")
    if whole:
        return rows.select("word", "c", "score")
    rows = materialize(rows, "word-pairs")
    sums = rows.where("pair is not null").select("word", "pair").join(scored, "pair").groupBy("word").agg(F.sum("score").alias("more"))
    return rows.where("pair is null").join(sums, "word", "left").select("word", "c", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


_LOOKED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("pair", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_LOOKED_SQL = "row long, doc_id long, held_out boolean, word binary, pair long, n_tokens long, n_known long, base_score double, score double"


def _rest(rows: np.ndarray, times: np.ndarray, word: pa.Array | None = None, pair: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows for what the tables don't hold: n_tokens is its count in the document."""
    n = len(rows)
    none = pa.nulls(n, pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()) if word is None else word, pa.nulls(n, pa.int64()) if pair is None else pa.array(pair.view(np.int64)), pa.array(times.astype(np.int64)), pa.nulls(n, pa.int64()), none, none],
        schema=_LOOKED,
    )


def _look_up(top_words, top_pairs):
    """A row a document with the sums over frequent words and pairs, and one for each other distinct word and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c, score, low, end = top_words.value
        known, c, score = np.frombuffer(known, U64), np.frombuffer(c, np.int64), np.frombuffer(score)
        pair_key, pair_score = np.frombuffer(top_pairs.value[0], U64), np.frombuffer(top_pairs.value[1])
        base = np.log10(c + 0.5) + low
        row = TaskContext.get().partitionId() << 40
        for batch in common.by_bytes(batches, most=12 << 20):
            data, offsets = common.text_buffer(batch.column(1))
            n = batch.num_rows
            rows = np.arange(row, row + n)
            row += n
            starts, ends, at = common.word_bounds(data, offsets)

            key, owner = head_keys(data, starts, ends, at)
            key, number = np.unique(key, return_inverse=True)
            pairs, there = head_pairs(key)
            k = np.searchsorted(pair_key, pairs)
            k = np.minimum(k, max(0, len(pair_key) - 1))
            found = there & (pair_key[k] == pairs) if len(pair_key) else np.zeros_like(there)
            value = np.where(found, pair_score[k], 0.0).sum(1) if len(pair_key) else np.zeros(len(key))
            heads = np.bincount(owner, value[number], n).astype(np.float64)
            for i in range(HEAD):
                lost = (there & ~found)[:, i]
                if lost.any():
                    at_token = lost[number]
                    both = np.unique(np.stack([owner[at_token].astype(U64), pairs[number[at_token], i]], 1), axis=0, return_counts=True)
                    yield _rest(rows[both[0][:, 0].astype(np.int64)], both[1], pair=both[0][:, 1])

            h, first, number = np.unique(common.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            k = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            hit = known[k] == h if len(known) else np.zeros(len(h), bool)
            doc = np.repeat(np.arange(n), np.diff(at))
            here = hit[number]
            sums = [np.bincount(doc[here], v, n).astype(np.float64) for v in ((c > 0)[k][number][here], base[k][number][here], score[k][number][here])] if len(known) else [np.zeros(n)] * 3
            fixed = [np.diff(at) + 1, sums[0].astype(np.int64) + (end > 0), sums[1] + np.log10(end + 0.5) + low, sums[2] + heads]
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), batch.column(2), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), *map(pa.array, fixed)], schema=_LOOKED)
            rare, times = np.unique(doc[~here].astype(np.int64) * (len(h) + 1) + number[~here], return_counts=True)
            doc, number = np.divmod(rare, len(h) + 1)
            for i in range(0, len(rare), 100_000):
                part = slice(i, i + 100_000)
                yield _rest(rows[doc[part]], times[part], word=slices(data, starts[first[number[part]]], ends[first[number[part]]]))

    return run


@common.in_small_batches
def corpus_scores(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, train): held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty (its one token is the end); texts of any length are read whole; repeated rows and null ids give rows like
    others (a null train counts as training); other columns are ignored; an empty table gives an empty result. Without training
    rows every byte has the probability that an empty tree gives it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("train"), F.lit(True)).alias("train"))
    counts = materialize(token_counts(docs), "counts")
    words, heads = counts.where("word is not null"), counts.where("word is null")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    low = -float(np.log10(n + 0.5 * (v + 1)))
    pairs = materialize(pair_counts(words, heads), "pairs")
    scored = materialize(pair_scores(pairs), "pair-scores")
    whole = scored.count() <= TOP_PAIRS
    table = scored if whole else most_frequent(pairs, TOP_PAIRS).select("pair").join(scored, "pair")
    table = table.toArrow()
    key, value = table["pair"].to_numpy().view(U64), table["score"].to_numpy()
    order = np.argsort(key)
    top_pairs = spark.sparkContext.broadcast((key[order].tobytes(), value[order].tobytes()))
    del table, key, value, order
    named = materialize(word_scores(words, scored, top_pairs, whole), "word-scores")
    end = named.where(F.col("word") == F.lit(END)).select("c").first()
    top = most_frequent(named.where(F.col("word") != F.lit(END)), TOP_WORDS).toArrow()
    data, offsets = common.text_buffer(top["word"])
    h = common.word_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(h)
    top_words = spark.sparkContext.broadcast((h[order].tobytes(), top["c"].to_numpy()[order].tobytes(), top["score"].to_numpy()[order].tobytes(), low, int(end[0]) if end else 0))
    looked = docs.select("doc_id", "text", (~F.col("train")).alias("held_out")).mapInArrow(_look_up(top_words, top_pairs), _LOOKED_SQL)
    looked = materialize(looked, "looked-up")
    empty = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens")]
    of_words = looked.where("word is not null").select("row", "word", F.col("n_tokens").alias("n")).join(named, "word")
    of_words = of_words.select(
        "row",
        *empty,
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("n_known"),
        (F.col("n") * (F.log10(F.col("c") + 0.5) + F.lit(low))).alias("base_score"),
        (F.col("n") * F.col("score")).alias("score"),
    )
    parts = looked.where("word is null and pair is null").drop("word", "pair").unionByName(of_words)
    if not whole:
        of_pairs = looked.where("pair is not null").select("row", "pair", F.col("n_tokens").alias("n")).join(scored, "pair")
        parts = parts.unionByName(of_pairs.select("row", *empty, F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), (F.col("n") * F.col("score")).alias("score")))
    total = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
