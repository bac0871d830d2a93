"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token pieces of at most ``capacity`` tokens. All decisions are taken on the histogram of piece lengths, which has
at most ``capacity`` entries whatever the corpus holds:

* a configuration is a multiset of lengths that fits a sequence; the program covers all pieces with the fewest of them;
* multiplicative weights price the lengths: a length covered ahead of schedule gets cheaper, one behind dearer. One knapsack
  dynamic program a round prices all configurations and yields the best one around every length;
* the fractional solution is rounded down to whole copies of configurations that no piece left over could extend, and solved anew
  for what is left; the last pieces are placed by best fit, longest first, all equal sequences at once.

The plan then is a table of intervals of ranks within each length, so each piece finds its sequence and offset from its own rank.
Ranks come from counts of salted groups: one length may hold any share of the pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweave.llm import common
from codeweave.session import materialize

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Words of each of the two generations whose ids a worker remembers, about 200 bytes each.
CACHE = 600_000
ROUNDS = 40
#: So many pieces or fewer go to best fit at once; of more, the program is solved again, TURNS times at most.
LEFT_OVER, TURNS = 20_000, 12

_kept: dict[tuple[str, str], object] = common.kept.setdefault("packing", {})


def tokenizer(path: str):
    if ("tokenizer", path) not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _kept["tokenizer", path] = Tokenizer.from_file(path)
    return _kept["tokenizer", path]


#: Words of these letters (ASCII and the letters of Latin-1, in UTF-8) are one token group that ends in a token that closes a word,
#: so many are encoded in one call; punctuation that follows is one more group.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


class WordIds:
    """Ids of whole texts, word by word: this tokenizer splits at white space first and drops it, so words are independent.

    It also lowers all letters, so ASCII is lowered first; a text that may hold a special token's string is left as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cache = CACHE
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> Iterator[bytes]:
        texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            yield from self._each(words)
            return
        raw, at = ids.tobytes(), 0
        for end in (ends * 4).tolist():
            yield raw[at:end]
            at = end

    def _learn(self, new: set[bytes]) -> None:
        plain, odd, marked, match, known = set(), set(), [], PLAIN.fullmatch, self.known
        for w in new:
            m = match(w)
            if m is None:
                odd.add(w)
                continue
            core, marks = m.groups()
            if core not in known:
                plain.add(core)
            if marks:
                marked.append((w, core, marks))
                if marks not in known:
                    odd.add(marks)
        if plain:
            plain = list(plain)
            known.update(zip(plain, self._together(b" ".join(plain).decode().split(" "))))
        if odd:
            odd = list(odd)
            known.update(zip(odd, self._each([w.decode() for w in odd])))
        for w, core, marks in marked:
            known[w] = known[core] + known[marks]

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > self.cache:
            self.known, self.older = {}, self.known
        new = {w for words in split for w in words if w not in self.known}
        if new and self.older:
            back = new & self.older.keys()
            self.known.update(zip(back, map(self.older.__getitem__, back)))
            new -= back
        if new:
            self._learn(new)
        get = self.known.__getitem__
        for words in split:
            yield b"".join(map(get, words))


def word_ids(path: str) -> WordIds:
    """One a worker process, so that what it knows outlives a task."""
    if ("words", path) not in _kept:
        _kept["words", path] = WordIds(path)
    return _kept["words", path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, cache: int = CACHE) -> DataFrame:
    """One row a piece of at most ``capacity`` ids of docs(doc_id, text): the text's ids, then END_ID. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = word_ids(public_tokenizers.path(name))
        words.cache = cache
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for batch in common.by_bytes(batches, most=1 << 20, operator="packing"):
            column = batch.column(1).cast(pa.binary())
            texts = [x or b"" for x in column.to_pylist()]
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), words.ids(texts)):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES_SQL)


def knapsack(price: np.ndarray, have: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each weight with lengths ``have``, and the length taken last (0: none; one unit is left empty)."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    p = price[have]
    for w in range(1, capacity + 1):
        n = int(np.searchsorted(have, w, "right"))
        value[w] = value[w - 1]
        if n:
            gains = value[w - have[:n]] + p[:n]
            k = int(np.argmax(gains))
            if gains[k] > value[w]:
                value[w], last[w] = gains[k], have[k]
    return value, last


def configuration(length: int, last: np.ndarray, have: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The best configuration around ``length`` as (length, count) pairs, none more often than there are pieces of it."""
    counts = {length: 1}
    w = capacity - length
    while w > 0:
        k = int(last[w])
        if not k:
            w -= 1
        elif counts.get(k, 0) < have[k]:
            counts[k] = counts.get(k, 0) + 1
            w -= k
        else:
            w -= 1
    return tuple(sorted(counts.items(), reverse=True))


def fractional(need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Copies (not whole) of configurations that cover ``need``, by multiplicative weights and knapsack pricing."""
    have = np.flatnonzero(need)
    covered, weight = np.zeros(capacity + 1), np.ones(capacity + 1)
    copies: dict[tuple, float] = {}
    for t in range(1, rounds + 1):
        price = np.zeros(capacity + 1)
        price[have] = have / capacity * weight[have]
        _, last = knapsack(price, have, capacity)
        goal = need * (t / rounds)
        for length in have[::-1].tolist():
            short = goal[length] - covered[length]
            if short <= 0:
                continue
            c = configuration(length, last, need, capacity)
            amount = short / dict(c)[length]
            copies[c] = copies.get(c, 0.0) + amount
            for k, m in c:
                covered[k] += m * amount
        ahead = covered[have] / need[have] - t / rounds
        weight[have] = np.clip(weight[have] * np.exp(-0.5 * np.clip(ahead * rounds, -2, 2)), 0.2, 5)
    return copies


def best_fit(need: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Whole configurations for the last pieces: longest first, each into the fullest sequence that has room.

    Sequences with equal contents are filled together, so the work depends on the number of lengths, not of pieces.
    """
    #: By room left: contents as (length, count) pairs, and how many sequences have them.
    groups: dict[int, dict[tuple, int]] = {capacity: {}}
    for length in np.flatnonzero(need)[::-1].tolist():
        n = int(need[length])
        for room in sorted(r for r in groups if r >= length):
            # One sequence takes so many before the next best one gets any.
            each = room // length
            there = groups[room]
            while n and (there or room == capacity):
                held, copies = there.popitem() if there else ((), -(-n // each))
                full = min(copies, n // each)
                short = n - full * each if full < copies else 0
                for m, k in ((each, full), (short, 1)):
                    if m and k:
                        new = groups.setdefault(room - m * length, {})
                        c = (*held, (length, m))
                        new[c] = new.get(c, 0) + k
                n -= full * each + short
                copies -= full + bool(short)
                if held and copies:
                    there[held] = there.get(held, 0) + copies
    out: dict[tuple, int] = {}
    for part in groups.values():
        for c, copies in part.items():
            out[c] = out.get(c, 0) + copies
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(configuration, copies) that hold exactly the pieces of the histogram."""
    need = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        need[length] = n
    out: list[tuple[tuple, int]] = []
    if need[capacity]:
        out.append((((capacity, 1),), int(need[capacity])))
        need[capacity] = 0
    for turn in range(TURNS):
        if not need.any() or (turn and need.sum() <= LEFT_OVER):
            break
        before = need.sum()
        solved = fractional(need, capacity)
        for c, x in sorted(solved.items(), key=lambda e: (-e[1], e[0])):
            room = capacity - sum(k * m for k, m in c)
            whole = min(int(x), *(int(need[k]) // m for k, m in c))
            if whole > 0:
                left = need.copy()
                for k, m in c:
                    left[k] -= m * whole
                # What a piece left over could still extend is left to the next turn, but for a room of two.
                if room <= 2 or not left[1 : room + 1].any():
                    out.append((c, whole))
                    need = left
        if need.sum() > 0.9 * before:
            break
    out += sorted(best_fit(need, capacity).items())
    return out


def intervals(chosen: list, histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Sorted intervals of (length, rank) with sequence and offset arithmetic; ``base`` starts each length."""
    base = np.zeros(capacity + 2, np.int64)
    for length, n in histogram.items():
        base[length + 1] = n
    base = np.cumsum(base)
    used = base.copy()
    rows, sequence = [], 0
    for c, copies in chosen:
        offset = 0
        for length, m in c:
            rows.append((used[length], m, sequence, offset))
            used[length] += m * copies
            offset += m * length
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"base": base, "from": table[:, 0], "m": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "sequences": np.array([sequence])}


_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            key = t["base"][length] + rank
            i = np.searchsorted(t["from"], key, "right") - 1
            copy, within = np.divmod(key - t["from"][i], t["m"][i])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(t["sequence"][i] + copy), pa.array(t["offset"][i] + within * length)], schema=_PLACED)

    return run


@common.in_small_batches
def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, cache: int = CACHE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row, placed in a sequence.

    Null and empty texts are one piece of one id; texts of any length are cut only where they exceed the capacity; null ids
    and repeated rows are packed like others; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, name, cache), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    salts = max(64, -(-sum(histogram.values()) // 100_000))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(order)).join(sizes, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") - 1 + F.col("before")).alias("rank"))
    shared = spark.sparkContext.broadcast(intervals(plan(histogram, capacity), histogram, capacity))
    return ranked.mapInArrow(_place(shared), f"{_PIECES_SQL}, sequence_id long, offset long")
