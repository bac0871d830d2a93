"""Quality classifier: a byte-level convolutional network in numpy.

Layer 1 slides ``TAPS`` bytes wide filters over the whole text, one lookup table a tap; a second input channel tells how lately
the four bytes at a place occurred before (a filter can't compare far bytes itself). Its outputs are max-pooled over segments of
``SEGMENT`` bytes. Layer 2 slides over ``REACH`` segments. Overlapping chunks of ``CHUNK`` bytes that cover the whole document take
maximum and mean of layer 2, and the document takes maximum and mean over its chunks, from which one logistic unit makes the
probability. Trained with Adam on at most ``sample`` labelled rows of either class and a few chunks of each a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm import common

TAPS, SEGMENT, REACH, CHUNK, STEP = 5, 16, 4, 512, 256
FILTERS, SECOND = 8, 8
PER = CHUNK // SEGMENT


def recurrence(data: np.ndarray) -> np.ndarray:
    """For each place of data: 0 if its four bytes (hashed to 16 bits) are new, else 1 to 3 by the distance back, near last."""
    kind = np.zeros(len(data), np.uint8)
    if len(data) < 4:
        return kind
    x = data.astype(np.uint32)
    h = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1])
    gap = order[again + 1] - order[again]
    kind[order[again + 1]] = (gap <= CHUNK).astype(np.uint8) + (gap <= 96) + (gap <= 24)
    return kind


class Network:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, seed: int = 11):
        rng = np.random.RandomState(seed)
        g = lambda s, *d: (rng.randn(*d) * s).astype(np.float32)
        return cls({"taps": g(0.25, TAPS, 256, FILTERS), "back": g(0.25, 4, FILTERS), "b1": np.zeros(FILTERS, np.float32), "w2": g(0.25, REACH * FILTERS, SECOND), "b2": np.zeros(SECOND, np.float32), "w3": g(0.3, 4 * SECOND), "b3": np.zeros(1, np.float32)})

    def first(self, x: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Layer 1 before its rectifier; x (n, m + TAPS - 1) padded on both sides, back (n, m)."""
        m = back.shape[1]
        out = np.take(self.p["back"] + self.p["b1"], back, axis=0)
        for k in range(TAPS):
            out += np.take(self.p["taps"][k], x[:, k : k + m], axis=0)
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Layer 1 as three lookups: by bytes 0 and 1, by bytes 2 and 3, by byte 4 and recurrence."""
        t = self.p["taps"]
        pair = lambda a, b: (t[b][:, None] + t[a][None]).reshape(-1, FILTERS)
        last = (self.p["back"] + self.p["b1"])[:, None] + t[4][None]
        return pair(0, 1), pair(2, 3), last.reshape(-1, FILTERS)

    def segments(self, x: np.ndarray, back: np.ndarray, tables: tuple) -> np.ndarray:
        """Layer 1, rectified and max-pooled, over x (m + TAPS - 1) and back (m)."""
        m = len(back)
        wide = x.astype(np.intp)
        pairs = wide[:-1] | wide[1:] << 8
        a = np.take(tables[0], pairs[:m], axis=0)
        a += np.take(tables[1], pairs[2 : m + 2], axis=0)
        a += np.take(tables[2], back.astype(np.intp) << 8 | wide[4 : m + 4], axis=0)
        a = a.reshape(-1, SEGMENT, FILTERS)
        while a.shape[1] > 1:
            a = np.maximum(a[:, : a.shape[1] // 2], a[:, a.shape[1] // 2 :])
        return np.maximum(a[:, 0], 0)

    def windows(self, s: np.ndarray) -> np.ndarray:
        """Layer 2 over segments (n, segments, FILTERS)."""
        k = s.shape[1] - REACH + 1
        full = np.concatenate([s[:, i : i + k] for i in range(REACH)], 2)
        return np.maximum(full @ self.p["w2"] + self.p["b2"], 0)

    def loss_and_grads(self, x: np.ndarray, back: np.ndarray, doc: np.ndarray, y: np.ndarray):
        """Log loss of documents y, whose chunks (rows of x) are told by doc, sorted, each with at least one."""
        n, m = back.shape
        a1 = self.first(x, back).reshape(n, -1, SEGMENT, FILTERS)
        top1 = a1.argmax(2)
        s = np.maximum(np.take_along_axis(a1, top1[:, :, None], 2)[:, :, 0], 0)
        k = s.shape[1] - REACH + 1
        full = np.concatenate([s[:, i : i + k] for i in range(REACH)], 2)
        a2 = np.maximum(full @ self.p["w2"] + self.p["b2"], 0)
        top2 = a2.argmax(1)
        chunk = np.concatenate([np.take_along_axis(a2, top2[:, None], 1)[:, 0], a2.mean(1)], 1)
        begin = np.searchsorted(doc, np.arange(len(y)))
        count = np.diff(np.append(begin, n))[:, None]
        mean = np.add.reduceat(chunk, begin, 0) / count
        high = np.maximum.reduceat(chunk, begin, 0)
        f = np.concatenate([high, mean], 1)
        z = f @ self.p["w3"] + self.p["b3"]
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((prob - y) / len(y)).astype(np.float32)
        g = {"w3": f.T @ dz, "b3": dz.sum(keepdims=True)}
        df = dz[:, None] * self.p["w3"]
        half = 2 * SECOND
        is_high = chunk == high[doc]
        share = is_high / np.maximum(np.add.reduceat(is_high, begin, 0, dtype=np.float32)[doc], 1)
        dchunk = df[doc][:, :half] * share + (df[:, half:] / count)[doc]
        da2 = np.repeat(dchunk[:, None, SECOND:] / k, k, 1)
        np.put_along_axis(da2, top2[:, None], np.take_along_axis(da2, top2[:, None], 1) + dchunk[:, None, :SECOND], 1)
        da2 *= a2 > 0
        g["w2"], g["b2"] = np.tensordot(full, da2, ((0, 1), (0, 1))), da2.sum((0, 1))
        dfull = da2 @ self.p["w2"].T
        ds = np.zeros_like(s)
        for i in range(REACH):
            ds[:, i : i + k] += dfull[:, :, i * FILTERS : (i + 1) * FILTERS]
        ds *= s > 0
        # Only the place that won a segment passes the gradient on.
        row, seg, fil = np.nonzero(ds)
        value = ds[row, seg, fil]
        place = seg * SEGMENT + top1[row, seg, fil]
        g["b1"] = np.bincount(fil, value, FILTERS).astype(np.float32)
        g["back"] = np.bincount(back[row, place].astype(np.int64) * FILTERS + fil, value, 4 * FILTERS).reshape(4, FILTERS).astype(np.float32)
        g["taps"] = np.stack([np.bincount(x[row, place + t].astype(np.int64) * FILTERS + fil, value, 256 * FILTERS).reshape(256, FILTERS) for t in range(TAPS)]).astype(np.float32)
        return float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9))), g

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 380, batch: int = 64, chunks: int = 4, rate: float = 0.01, seed: int = 1) -> float:
        rng = np.random.RandomState(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        n, loss = 0, 0.0
        for _ in range(-(-steps * batch // len(texts))):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                rows, doc, back = [], [], []
                for j, d in enumerate(part):
                    last = max(0, len(texts[d]) - CHUNK)
                    for _ in range(min(chunks, 1 + last // STEP)):
                        at = int(rng.randint(0, last + 1))
                        piece = texts[d][at : at + CHUNK]
                        rows.append(piece.ljust(CHUNK, b"\0"))
                        back.append(np.pad(recurrence(np.frombuffer(piece, np.uint8)), (0, CHUNK - len(piece))))
                        doc.append(j)
                raw = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, CHUNK)
                loss, g = self.loss_and_grads(np.pad(raw, ((0, 0), (TAPS // 2, TAPS // 2))), np.stack(back), np.array(doc), y[part])
                n += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
        return loss

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each row of a text buffer; whole texts, in pieces of chunks."""
        out = np.empty(len(offsets) - 1)
        i = 0
        while i < len(out):
            j, size = i, 0
            while j < len(out) and (j == i or size + offsets[j + 1] - offsets[j] < 1 << 19):
                size += offsets[j + 1] - offsets[j]
                j += 1
            out[i:j] = self._scores([data[offsets[k] : offsets[k + 1]] for k in range(i, j)])
            i = j
        return out

    def _scores(self, texts: list[np.ndarray]) -> np.ndarray:
        # A text of n bytes has chunks at 0, STEP, 2 STEP, ... until one reaches its end; zeros of a segment keep texts apart.
        count = [1 + max(0, -(-(len(t) - CHUNK) // STEP)) for t in texts]
        size = np.array([CHUNK + (c - 1) * STEP + SEGMENT for c in count])
        at = np.concatenate([[0], np.cumsum(size)])
        raw = np.zeros(at[-1] + TAPS - 1, np.uint8)
        back = np.zeros(at[-1], np.uint8)
        for t, a in zip(texts, at.tolist()):
            raw[a + TAPS // 2 : a + TAPS // 2 + len(t)] = t
            for low in range(0, len(t), 1 << 14):
                seen = min(low, CHUNK)
                back[a + low : a + min(len(t), low + (1 << 14))] = recurrence(t[low - seen : low + (1 << 14)])[seen:]
        s = np.empty((at[-1] // SEGMENT, FILTERS), np.float32)
        span, tables = STEP * 64, self.tables()
        for a in range(0, at[-1], span):
            b = min(a + span, at[-1])
            s[a // SEGMENT : b // SEGMENT] = self.segments(raw[a : b + TAPS - 1], back[a:b], tables)
        w = self.windows(s[None])[0]
        starts = np.concatenate([a // SEGMENT + np.arange(c) * (STEP // SEGMENT) for a, c in zip(at[:-1], count)])
        view = np.lib.stride_tricks.sliding_window_view(w, PER - REACH + 1, axis=0)[starts]
        chunk = np.concatenate([view.max(2), view.mean(2)], 1)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        f = np.concatenate([np.maximum.reduceat(chunk, begin, 0), np.add.reduceat(chunk, begin, 0) / np.array(count)[:, None]], 1)
        return 1 / (1 + np.exp(-np.clip(f @ self.p["w3"] + self.p["b3"], -30, 30)))


def fit(texts: list[str], labels: list[int]) -> dict[str, np.ndarray]:
    """Parameters; without rows of both classes, a network that gives the share of label 1 (or one half)."""
    net = Network.fresh()
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        net.p["w3"][:] = 0
        net.p["b3"][:] = np.log(share / (1 - share))
        return net.p
    net.fit([t.encode() for t in texts], y)
    return net.p


def quality(docs: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text, ...): the probability of label 1.

    A null text is scored as an empty one; texts of any length are read whole; repeated rows and null ids give rows like others;
    other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        for batch in common.by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(*common.text_buffer(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
