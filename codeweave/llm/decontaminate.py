"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the tokens of a window and ignore the others, so a window still hashes alike when ignored tokens were
substituted. Test items and training documents meet on these hashes; each hit names a diagonal, on which the two are aligned token by
token from end to end, and of all its stretches with ``LEAST_SHARE`` of matches the one with the most is verified against the
thresholds.

Tokens are words, A-Z lowered, without punctuation at their ends. The items' seeds go to the executors when there are at most
``BROADCAST_SEEDS`` of them (16 bytes each); beyond that the documents' windows that pass a fixed-size bit filter are joined to
the seeds by a shuffle, and words meet only for the pairs that share a seed. Both ways verify the same diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm import common
from codeweave.llm.common import U64, mix64
from codeweave.plans.joins import dealt_join
from codeweave.session import materialize

# The masks; 1 keeps a token, 0 ignores it.
MASKS = ("11011011", "1110010111", "1010110011", "1110111", "110100111")
#: Items of fewer words than this use their whole sequence as one more seed.
SHORT = 12
#: A stretch counts from so many matching words (or the whole of a shorter item) and this share of matches.
LEAST_WORDS = 10
LEAST_SHARE = 0.75
#: What a mismatch takes off where a match adds 1: a stretch's sum is 0 or more just where its share is ``LEAST_SHARE`` or more.
MISMATCH = 3
BROADCAST_SEEDS = 2_000_000
FILTER_BITS = 22

_FACTORS = mix64(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(c) for c in ".,;:!?\"'()[]{}"]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row and the rows' offsets; words of punctuation only are left out."""
    starts, ends, at = common.word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), at
    marks = PUNCTUATION[data]
    trimmed = np.flatnonzero(marks[starts] | marks[ends - 1])
    if len(trimmed):
        # A word loses all marks before its first and after its last other byte.
        solid = np.flatnonzero(~marks)
        low, high = np.searchsorted(solid, starts[trimmed]), np.searchsorted(solid, ends[trimmed])
        none = low == high
        solid = np.append(solid, 0)
        starts[trimmed] = np.where(none, ends[trimmed], solid[np.where(none, -1, low)])
        ends[trimmed] = np.where(none, ends[trimmed], solid[high - 1] + 1)
    kept = ends > starts
    counts = np.concatenate([[0], np.cumsum(kept)])
    return common.word_hashes(data, starts[kept], ends[kept]), counts[at]


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """One hash for each window of the mask's span."""
    kept = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
    n = len(words) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, _FACTORS[60 - mask], U64)
    for i in kept:
        h = h + words[i : n + i] * _FACTORS[i]
    return mix64(h)


def whole_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, for items of exactly n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.full(m, _FACTORS[40 + n], U64)
    for i in range(n):
        h = h + words[i : m + i] * _FACTORS[i]
    return mix64(h)


class Seeds:
    """The items' words and a sorted table hash -> (item, position)."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, at: np.ndarray):
        self.ids, self.words, self.at = ids, words, at
        hashes, items, positions = [], [], []
        self.shorts = sorted({int(n) for n in np.diff(at) if 0 < n < SHORT})
        for i in range(len(ids)):
            w = words[at[i] : at[i + 1]]
            found = [seed_hashes(w, m) for m in range(len(MASKS))] + ([whole_hashes(w, len(w))] if 0 < len(w) < SHORT else [])
            for h in found:
                hashes.append(h)
                items.append(np.full(len(h), i, np.int64))
                positions.append(np.arange(len(h), dtype=np.int64))
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.hash, self.item, self.position = cat(hashes, U64), cat(items, np.int64), cat(positions, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.position = self.hash[order], self.item[order], self.position[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hash >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def windows(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position) of the windows that may hit and don't cross a row's border."""
        return filtered_windows(words, at, self.filter, self.shorts)


def filtered_windows(words: np.ndarray, at: np.ndarray, passes: np.ndarray, shorts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    hashes, positions = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    kinds = [(len(m), lambda k=k: seed_hashes(words, k)) for k, m in enumerate(MASKS)] + [(n, lambda n=n: whole_hashes(words, n)) for n in shorts]
    for span, make in kinds:
        h = make()
        p = np.flatnonzero(passes[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
        p = p[p + span <= at[np.searchsorted(at, p, "right")]] if len(p) else p
        hashes.append(h[p])
        positions.append(p)
    return np.concatenate(hashes), np.concatenate(positions)


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """Matches and length of the stretch with the most matches of those with ``LEAST_SHARE`` of them; the shortest of equals."""
    hits = np.flatnonzero(same)
    if not len(hits):
        return 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    count = np.concatenate([[0], np.cumsum(same)])
    # The earliest begin whose sum to each end is not negative has the most matches for that end.
    begin = np.searchsorted(-np.minimum.accumulate(total), -total)
    matches = count - count[begin]
    ends = np.flatnonzero(matches == matches.max())
    length = ends - hits[count[begin[ends]]]
    return int(matches[ends[0]]), int(length.min())


def accepted(matches: int, length: int, item_words: int) -> bool:
    return matches >= min(LEAST_WORDS, item_words) and matches >= LEAST_SHARE * length


def align(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """Best stretch of the diagonal that lays item[0] on doc[shift], over all words that the two have there."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    return best_stretch(doc[a:b] == item[a - shift : b - shift])


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("span", pa.int64())])
_OUT_SQL = "doc_id long, item_id long, matched long, span long"


def _local(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        for batch in common.by_bytes(batches):
            words, at = words_of(*common.text_buffer(batch.column(1)))
            h, p = seeds.windows(words, at)
            lo, hi = np.searchsorted(seeds.hash, h), np.searchsorted(seeds.hash, h, "right")
            n = hi - lo
            p = np.repeat(p, n)
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, q = seeds.item[k], seeds.position[k]
            doc = np.searchsorted(at, p, "right") - 1
            pairs = np.unique(np.stack([doc, item, p - at[doc] - q], 1), axis=0) if len(p) else np.zeros((0, 3), np.int64)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for d, i, shift in pairs.tolist():
                own = seeds.words[seeds.at[i] : seeds.at[i + 1]]
                found = align(words[at[d] : at[d + 1]], own, shift)
                if accepted(*found, len(own)):
                    best[d, i] = max(best.get((d, i), (0, 0)), found)
            if best:
                rows = [(batch.column(0)[d], int(seeds.ids[i]), m, s) for (d, i), (m, s) in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], schema=_OUT)

    return run


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.by_bytes(batches):
        words, at = words_of(*common.text_buffer(batch.column(1)))
        seeds = Seeds(np.arange(batch.num_rows), words, at)
        for k in range(0, len(seeds.hash), 100_000):
            part = slice(k, k + 100_000)
            owner = pa.array(seeds.item[part])
            yield pa.RecordBatch.from_arrays([pa.array(seeds.hash[part].view(np.int64)), batch.column(0).take(owner), batch.column(2).take(owner), pa.array(seeds.position[part])], ["h", "item_id", "item_key", "q"])


def _doc_rows(passes, shorts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(passes.value, np.uint8)).view(bool)
        for batch in common.by_bytes(batches):
            words, at = words_of(*common.text_buffer(batch.column(1)))
            h, p = filtered_windows(words, at, bits, shorts)
            doc = np.searchsorted(at, p, "right") - 1
            for k in range(0, len(h), 100_000):
                part = slice(k, k + 100_000)
                owner = pa.array(doc[part])
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), batch.column(0).take(owner), batch.column(2).take(owner), pa.array((p - at[doc])[part])], ["h", "doc_id", "doc_key", "p"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, key) to (id, key, words): eight bytes a word."""
    for batch in common.by_bytes(batches):
        words, at = words_of(*common.text_buffer(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["id", "key", "words"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, doc_key, item_id, shift, words) sorted by document: its own words first (item_id null), then its pairs."""
    own = np.zeros(0, U64)
    for batch in batches:
        rows = []
        for doc, item, shift, words in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if shift is None:
                own = np.frombuffer(words, U64)
                continue
            found = align(own, np.frombuffer(words, U64), shift)
            if accepted(*found, len(words) // 8):
                rows.append((doc, item, *found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], schema=_OUT)


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What ``_local`` finds, with seeds, pairs and words joined by shuffles; a row's key is a hash of its text, as ids may repeat."""
    keyed = lambda df: df.withColumn("key", F.xxhash64("text"))
    docs, items = keyed(docs), keyed(items)
    seeds = materialize(items.mapInArrow(_item_rows, "h long, item_id long, item_key long, q long"), "seeds")
    passes = np.zeros(1 << FILTER_BITS, bool)
    # At most 2 ** FILTER_BITS rows, whatever the number of items.
    for part in seeds.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("slot")).distinct().toLocalIterator(prefetchPartitions=True):
        passes[part[0]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(passes).tobytes())
    windows = materialize(docs.mapInArrow(_doc_rows(shared, list(range(1, SHORT))), "h long, doc_id long, doc_key long, p long"), "windows")
    pairs = dealt_join(windows, seeds, ["h"]).select("doc_id", "doc_key", "item_id", "item_key", (F.col("p") - F.col("q")).alias("shift")).distinct()
    pairs = materialize(pairs, "pairs")
    item_words = items.mapInArrow(_words, "item_id long, item_key long, words binary").dropDuplicates(["item_id", "item_key"])
    sides = dealt_join(pairs, item_words, ["item_id", "item_key"]).select("doc_id", "doc_key", "item_id", "shift", "words")
    chosen = docs.withColumnRenamed("key", "doc_key").join(pairs.select("doc_id", "doc_key").distinct(), ["doc_id", "doc_key"], "left_semi").dropDuplicates(["doc_id", "doc_key"])
    doc_words = chosen.select("doc_id", "text", "doc_key").mapInArrow(_words, "doc_id long, doc_key long, words binary")
    whole = doc_words.select("doc_id", "doc_key", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("shift"), "words")
    dealt = whole.unionByName(sides).repartition("doc_id", "doc_key").sortWithinPartitions("doc_id", "doc_key", F.col("shift").asc_nulls_first())
    return dealt.mapInArrow(_verify, _OUT_SQL)


def contaminations(docs: DataFrame, items: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, matched, span): each verified overlap of a document with a test item, one row a pair.

    matched: matching words of the best stretch; span: its length. Null and empty texts overlap with nothing, nor do rows with a
    null id; rows that repeat an id are one document (or item): the largest (matched, span) of a pair is returned; texts of any
    length are read whole; other columns are ignored; with an empty table on either side the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # An item has fewer words than half its bytes and one seed a word and mask.
    if size // 2 * (len(MASKS) + 1) <= broadcast_seeds * 2:
        table = items.toArrow().sort_by("item_id")
        words, at = words_of(*common.text_buffer(table["text"]))
        shared = spark.sparkContext.broadcast(Seeds(table["item_id"].to_numpy(), words, at))
        found = docs.mapInArrow(_local(shared), _OUT_SQL)
    else:
        found = _by_shuffle(docs, items)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "span")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched", "best.span")
