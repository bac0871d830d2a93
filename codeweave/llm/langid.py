"""Language identification by a linear-chain conditional random field over words.

A word's emission sums learned weights of its affixes, byte n-grams (hashed) and, for words of the training lexicon, of the
word itself; transitions between the labels of neighbouring words are learned too. Forward-backward gives every word of a text,
code-switched or not, a distribution over the labels; a document takes the label with the largest mean over its words with letters.

Texts are cut into runs of ``RUN`` words only for speed: messages are passed between runs through their transfer matrices, so the
marginals are those of the whole text. Trained by gradient steps on sequences from at most ``sample`` labelled rows a language, half
of them spliced from several languages, so that transitions are learned from switches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm import common
from codeweave.llm.common import LOWER, U64

SLOTS = 1 << 16
RUN = 128
UNKNOWN = "und"
LEXICON_LEAST, LEXICON_MOST = 4, 20_000
_TRIM = ~np.array([chr(b).isalpha() or b > 127 for b in range(256)])
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
# Odd multipliers of the feature hashes, one a position, and salts, one a kind of feature.
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_SALT = {"two": 0x1234567, "three": 0x7654321, "prefix": 0x51ED27, "suffix": 0x6A09E6}


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row offsets of the words, without ASCII non-letters at their ends; what has nothing left is left out."""
    starts, ends, at = common.word_bounds(data, offsets)
    while len(starts):
        last = (ends > starts) & _TRIM[data[ends - 1]]
        ends = ends - last
        first = (ends > starts) & _TRIM[data[np.minimum(starts, len(data) - 1)]]
        starts = starts + first
        if not last.any() and not first.any():
            break
    kept = ends > starts
    count = np.concatenate([[0], np.cumsum(kept)])
    return starts[kept], ends[kept], count[at]


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, first of each word) of every kind of feature; low: lowered bytes of the buffer."""
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    padded = np.full(begin[-1], 1, np.uint32)
    inner = np.repeat(starts - begin[:-1] - 1, size) + (np.arange(size.sum()) + np.repeat(np.arange(len(size)) * 2 + 1, size))
    padded[np.arange(size.sum()) + np.repeat(np.arange(len(size)) * 2 + 1, size)] = low[inner]
    padded[begin[1:] - 1] = 2
    slot = lambda h: ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)
    two = slot(padded[:-1] * _M[0] + padded[1:] * _M[1] + np.uint32(_SALT["two"]))
    three = slot(padded[:-2] * _M[0] + padded[1:-1] * _M[1] + padded[2:] * _M[2] + np.uint32(_SALT["three"]))
    inside = lambda n: np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(size + 3 - n)])[:-1], size + 3 - n) + np.arange((size + 3 - n).sum())
    at = np.arange(4)
    head = low[np.minimum(starts[:, None] + at, len(low) - 1)] * (at < size[:, None]).astype(np.uint32)
    tail = low[np.maximum(ends[:, None] - 1 - at, 0)] * (at < size[:, None]).astype(np.uint32)
    affix = []
    for name, part in (("prefix", head), ("suffix", tail)):
        for n in (3, 4):
            affix.append(slot((part[:, :n] * _M[:n]).sum(1, dtype=np.uint32) + np.uint32(_SALT[name] + n)))
    affix = np.stack(affix, 1)
    first = lambda n: np.concatenate([[0], np.cumsum(size + 3 - n)])[:-1]
    return [(two[inside(2)], first(2)), (three[inside(3)], first(3)), (affix.reshape(-1), np.arange(len(size)) * affix.shape[1])]


class Crf:
    """Parameters: weights (SLOTS, labels), lexicon hashes and weights, transitions (labels, labels), start (labels)."""

    def __init__(self, labels: list[str], p: dict[str, np.ndarray]):
        self.labels, self.p = labels, p

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, labels); equal words are computed once."""
        h = common.word_hashes(data, starts, ends)
        distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
        if not len(distinct):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.zeros((len(distinct), len(self.labels)), np.float32)
        low = LOWER[data].astype(np.uint32)
        for i in range(0, len(distinct), 50_000):
            part = slice(i, i + 50_000)
            for slots, begin in features(low, starts[first[part]], ends[first[part]]):
                out[part] += np.add.reduceat(self.p["weights"][slots], begin, 0)
        lexicon = self.p["lexicon"]
        if len(lexicon):
            k = np.minimum(np.searchsorted(lexicon, distinct), len(lexicon) - 1)
            out += self.p["lexical"][k] * (lexicon[k] == distinct)[:, None]
        return out[at]

    def marginals(self, e: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Posterior (words, labels) by forward-backward over each row's words e[at[i]:at[i + 1]]."""
        n, labels = len(e), e.shape[1]
        if not n:
            return np.zeros((0, labels))
        size = np.diff(at)
        runs = -(-size // RUN)
        row = np.repeat(np.arange(len(size)), runs)
        order = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = at[row] + order * RUN
        length = np.minimum(RUN, at[row + 1] - begin)
        where = np.minimum(begin[:, None] + np.arange(RUN), n - 1)
        real = np.arange(RUN) < length[:, None]
        p = np.exp(e - e.max(1, keepdims=True))[where]
        move = np.exp(self.p["trans"] - self.p["trans"].max())
        start = np.exp(self.p["start"] - self.p["start"].max())
        move, start = move / move.sum(), start / start.sum()
        eye = np.eye(labels)
        # Transfer matrix of each run: from the label before it to that of its last word.
        carry = np.repeat(eye[None], len(row), 0)
        for t in range(RUN):
            new = (carry @ move) * p[:, t, None]
            new /= new.sum((1, 2), keepdims=True)
            carry = np.where(real[:, t, None, None], new, carry)
        ahead = np.empty((len(row), labels))
        behind = np.ones((len(row), labels))
        head = np.cumsum(runs) - runs
        live = np.flatnonzero(runs > 0)
        # The start distribution stands for the move into the first word; it is divided out of the first transfer.
        message = np.zeros((len(size), labels))
        for k in range(int(runs.max())):
            now = live[runs[live] > k]
            ahead[head[now] + k] = message[now]
            if k == 0:
                first = self._first_carry(p[head[now]], real[head[now]], move, start)
                message[now] = first
            else:
                m = np.einsum("nl,nlk->nk", message[now], carry[head[now] + k])
                message[now] = m / m.sum(1, keepdims=True)
        back = np.ones((len(size), labels))
        for k in range(int(runs.max()) - 1, -1, -1):
            now = live[runs[live] > k]
            behind[head[now] + k] = back[now]
            m = np.einsum("nlk,nk->nl", carry[head[now] + k], back[now])
            back[now] = m / m.sum(1, keepdims=True)
        alpha = np.empty((RUN, len(row), labels))
        a = None
        for t in range(RUN):
            if t == 0:
                into = np.where((order == 0)[:, None], start, ahead @ move)
            else:
                into = a @ move
            a = into * p[:, t]
            a /= a.sum(1, keepdims=True)
            alpha[t] = a
        out = np.empty((n, labels))
        b = np.ones((len(row), labels))
        for t in range(RUN - 1, -1, -1):
            b = np.where((t == length - 1)[:, None], behind, b)
            m = alpha[t] * b
            m /= m.sum(1, keepdims=True)
            now = real[:, t]
            out[where[now, t]] = m[now]
            b = (p[:, t] * b) @ move.T
            b /= b.sum(1, keepdims=True)
        return out

    @staticmethod
    def _first_carry(p: np.ndarray, real: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
        a = start * p[:, 0]
        a /= a.sum(1, keepdims=True)
        for t in range(1, RUN):
            new = (a @ move) * p[:, t]
            new /= new.sum(1, keepdims=True)
            a = np.where(real[:, t, None], new, a)
        return a

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label index (-1: no letter) and score of each row."""
        starts, ends, at = words(data, offsets)
        post = self.marginals(self.emissions(data, starts, ends), at)
        total = np.zeros((len(offsets) - 1, len(self.labels)))
        size = np.diff(at)
        full = np.flatnonzero(size)
        if len(full):
            total[full] = np.add.reduceat(post, at[:-1][full], 0) / size[full][:, None]
        best = total.argmax(1)
        ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        for i in np.flatnonzero(ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            if not any(c.isalpha() for c in text):
                best[i] = -1
        return best, np.where(best < 0, 0.0, total[np.arange(len(best)), best])


def spliced(pieces: list[tuple[np.ndarray, int]], rng: np.random.RandomState, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A training sequence of word numbers and labels: one text's words, or stretches of several texts."""
    ids, labels = [], []
    one = rng.rand() < 0.5
    while len(ids) < length:
        word, label = pieces[rng.randint(len(pieces))]
        n = length - len(ids) if one else int(rng.randint(4, 24))
        at = int(rng.randint(0, max(1, len(word) - n)))
        part = word[at : at + n].tolist()
        ids += part
        labels += [label] * len(part)
        if not part:
            break
    return np.array(ids[:length]), np.array(labels[:length])


def fit(texts: list[str], langs: list[str], steps: int = 160, batch: int = 48, length: int = 60, rate: float = 0.3, seed: int = 2) -> Crf:
    """A model of the languages seen; steps of AdaGrad on the log likelihood of the labels."""
    labels = sorted(set(langs))
    rng = np.random.RandomState(seed)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, at = words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    n = len(labels)
    p = {"weights": np.zeros((SLOTS, n), np.float32), "lexicon": np.zeros(0, U64), "lexical": np.zeros((0, n), np.float32), "trans": np.zeros((n, n)), "start": np.zeros(n)}
    model = Crf(labels, p)
    if n < 2 or not len(starts):
        return model
    h = common.word_hashes(data, starts, ends)
    distinct, first, number, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count >= LEXICON_LEAST)
    often = np.sort(often[np.argsort(-count[often], kind="stable")][:LEXICON_MOST])
    p["lexicon"], p["lexical"] = distinct[often], np.zeros((len(often), n), np.float32)
    lexical = np.full(len(distinct), -1)
    lexical[often] = np.arange(len(often))
    pieces = [(number[at[i] : at[i + 1]], labels.index(langs[i])) for i in range(len(texts)) if at[i + 1] > at[i]]
    by_label = [[q for q in pieces if q[1] == k] for k in range(n)]
    pieces = [q for group in by_label for q in (group * (1 + max(map(len, by_label)) // max(1, len(group))))[: max(map(len, by_label))]]
    low = LOWER[data].astype(np.uint32)
    grown = {k: np.full_like(p[k], 1e-6, dtype=np.float64) for k in ("weights", "lexical", "trans", "start")}
    for _ in range(steps):
        seqs = [spliced(pieces, rng, length) for _ in range(batch)]
        seqs = [q for q in seqs if len(q[0]) == length]
        if not seqs:
            break
        ids, y = np.stack([q[0] for q in seqs]), np.stack([q[1] for q in seqs])
        used, place = np.unique(ids, return_inverse=True)
        kinds = features(low, starts[first[used]], ends[first[used]])
        e = sum(np.add.reduceat(p["weights"][slots], begin, 0) for slots, begin in kinds)
        lex = lexical[used]
        e = e + np.where(lex[:, None] >= 0, p["lexical"][lex], 0) if len(often) else e
        e = e.astype(np.float64)[place.reshape(ids.shape)]
        de, dtrans, dstart = _likelihood_grads(e, y, p["trans"], p["start"])
        dword = np.zeros((len(used), n))
        np.add.at(dword, place.ravel(), de.reshape(-1, n))
        grad = {"trans": dtrans, "start": dstart, "weights": np.zeros((SLOTS, n)), "lexical": np.zeros((len(often), n))}
        for slots, begin in kinds:
            times = np.diff(np.append(begin, len(slots)))
            value = np.repeat(dword, times, 0)
            for k in range(n):
                grad["weights"][:, k] += np.bincount(slots, value[:, k], SLOTS)
        if len(often):
            np.add.at(grad["lexical"], lex[lex >= 0], dword[lex >= 0])
        for k, g in grad.items():
            g = g + 1e-4 * p[k]
            grown[k] += g * g
            p[k] -= (rate * g / np.sqrt(grown[k])).astype(p[k].dtype)
    return model


def _likelihood_grads(e: np.ndarray, y: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Gradients of the mean negative log likelihood of y (B, T) by emissions, transitions and start."""
    batch, steps, n = e.shape
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = start + e[:, 0]
    for t in range(1, steps):
        alpha[:, t] = e[:, t] + lse(alpha[:, t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None], 2)
    z = lse(alpha[:, -1], 1)
    gold = np.eye(n)[y]
    de = np.exp(alpha + beta - z[:, None, None]) - gold
    pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None])
    dtrans = pair.sum((0, 1)) - np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    return de / batch, dtrans / batch, de[:, 0].sum(0) / batch


def labelled_texts(docs: DataFrame, train: str, sample: int) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``sample`` rows a language, chosen by the hash of doc_id; ``train``: a SQL condition.

    Languages are a closed set of a few names. Texts of more than ``common.TRAINING_BYTES`` bytes are no training rows, so what
    reaches the driver has a bound.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null").where(train)
    few = docs.sparkSession.createDataFrame(common.drawn(rows, sample, "lang").toArrow())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") <= common.TRAINING_BYTES)
    got = texts.join(F.broadcast(few), ["doc_id", "lang"]).toPandas().sort_values(["doc_id", "lang", "text"])
    return got["text"].tolist(), got["lang"].tolist()


def languages(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text, ...).

    Null texts and texts without a letter are UNKNOWN with score 0, as is everything if no language was learned; texts of any
    length are read whole; repeated rows and null ids give rows like others; ties go to the label that sorts first; other columns
    are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*shared.value)
        for batch in common.by_bytes(batches, most=2 << 20):
            if crf.labels:
                best, score = crf.predict(*common.text_buffer(batch.column(1)))
            else:
                best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            names = [crf.labels[k] if k >= 0 else UNKNOWN for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def stretches(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, first_word, words, lang, score): runs of words with one most likely label, for code-switched text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*shared.value)
        for batch in common.by_bytes(batches, most=2 << 20):
            data, offsets = common.text_buffer(batch.column(1))
            starts, ends, at = words(data, offsets)
            post = crf.marginals(crf.emissions(data, starts, ends), at) if crf.labels else np.zeros((0, 1))
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if b > a and len(post):
                    label = post[a:b].argmax(1)
                    edge = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [b - a]])
                    rows += [(doc, int(i), int(j - i), crf.labels[label[i]], float(post[a + i : a + j, label[i]].mean())) for i, j in zip(edge[:-1], edge[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["doc_id", "first_word", "words", "lang", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, first_word long, words long, lang string, score double")
