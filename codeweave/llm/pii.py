"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The base finds email, ip, card and phone by pattern, leftmost and non-overlapping per kind. The model (numpy) reads every text
whole, in overlapping windows. Where two windows overlap their emissions are merged, the more central window weighing more, and one
Viterbi path is decoded over the merged emissions of the whole text, so no window decides alone. Model spans count when they have
their kind's shape and touch no base span. It is trained from labelled spans: base spans of at most ``sample`` rows, some rewritten
(no plus sign before a phone, a spelled-out at-sign), so that it also finds what the patterns can't, and windows drawn from all
characters of the same rows, so that prose stays as it is.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm import common
from codeweave.session import materialize

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms: a greedy part that gives characters back could never help these match.
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base, by start, then kind as listed. Linear in the text but for runs of phone characters."""
    found: list[tuple[int, int, str]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        low = at
        while low > last and text[low - 1] in LOCAL:
            low -= 1
        m = DOMAIN.match(text, at + 1) if low < at else None
        if m:
            last = m.end()
            found.append((low, last, "email"))
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the network -----------------------------------------------------------------------------------------------------

#: Characters with a class of their own; others: letters by case, digits, white space, the rest.
SPECIAL = "@.-+()_%,:/'\"#*="
CLASSES = 6 + len(SPECIAL)
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Characters of a window in training, and of a window and of what two neighbours share in prediction.
TRAINED, WINDOW, SHARED = 96, 224, 32
STRIDE = WINDOW - SHARED
#: Windows a matrix product of the prediction: so few that BLAS starts no threads, which cost more CPU time than they save.
BLOCK = 128
#: Windows whose emissions are held at once, and the gain of a character that lies in no text.
HELD, OUTSIDE = 512, -1e4

_class_table = np.full(0x250, 5, np.int8)
for _c in range(0x250):
    _s = chr(_c)
    _class_table[_c] = 6 + SPECIAL.index(_s) if _s in SPECIAL else 1 if "0" <= _s <= "9" else 4 if _s.isspace() else 2 if _s.islower() else 3 if _s.isupper() else 5


def classes(text: str) -> np.ndarray:
    """Class of each code point; 0 is padding; letters beyond the table count as lower-case letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x250, _class_table[np.minimum(points, 0x24F)], 2).astype(np.int8)


@cache
def slow_tanh() -> bool:
    """Whether numpy's tanh of 32-bit floats takes longer than its exp and a division: where it has no AVX-512 form, or can't tell."""
    if not hasattr(np.lib, "introspect"):
        return True
    forms = np.lib.introspect.opt_func_info(func_name="^tanh$", signature="float32").get("tanh", {})
    return not any("AVX512" in form["current"] for form in forms.values())


class Tagger:
    """Embedding, forward and backward LSTM, linear emissions, CRF transitions; forward, gradients and Viterbi in numpy."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 7, width: int = 8, hidden: int = 12, classes: int = CLASSES, tags: int = len(TAGS)):
        rng = np.random.RandomState(seed)
        g = lambda *s: (rng.randn(*s) / np.sqrt(s[0])).astype(np.float32)
        p = {"emb": g(classes, width), "wo": g(2 * hidden, tags), "bo": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            p |= {f"wx_{d}": g(width, 4 * hidden), f"wh_{d}": g(hidden, 4 * hidden), f"b_{d}": np.zeros(4 * hidden, np.float32)}
            p[f"b_{d}"][hidden : 2 * hidden] = 1
        return cls(p)

    def tables(self) -> np.ndarray:
        """What each class adds to the gates, (2, classes, 4 H): forward, backward."""
        return np.stack([self.p["emb"] @ self.p[f"wx_{d}"] + self.p[f"b_{d}"] for d in "fb"])

    def lstm(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Over classes (T, B), both directions at once: per step (the backward one counts from the end) gates, candidates, cells and states."""
        steps, batch = x.shape
        wh = np.stack([self.p["wh_f"], self.p["wh_b"]])
        hidden = wh.shape[1]
        table = self.tables()
        put = np.stack([table[0][x], table[1][x[::-1]]], 1)
        gates, cand = np.empty((steps, 2, batch, 3 * hidden), table.dtype), np.empty((steps, 2, batch, hidden), table.dtype)
        cells, states = np.zeros((steps + 1, 2, batch, hidden), table.dtype), np.zeros((steps + 1, 2, batch, hidden), table.dtype)
        for t in range(steps):
            z = put[t] + states[t] @ wh
            gates[t] = 0.5 + 0.5 * np.tanh(0.5 * z[..., : 3 * hidden])
            cand[t] = np.tanh(z[..., 3 * hidden :])
            cells[t + 1] = gates[t][..., hidden : 2 * hidden] * cells[t] + gates[t][..., :hidden] * cand[t]
            states[t + 1] = gates[t][..., 2 * hidden :] * np.tanh(cells[t + 1])
        return gates, cand, cells, states

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(T, B, tags) for classes (B, T), and what gradients need."""
        x = np.ascontiguousarray(x.T)
        kept = self.lstm(x)
        h = np.concatenate([kept[3][1:, 0], kept[3][:0:-1, 1]], 2)
        return h @ self.p["wo"] + self.p["bo"], (x, h, kept)

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log likelihood a character of tags y (B, T), and the gradient of each parameter."""
        e, (xt, h, (gates, cand, cells, states)) = self.emissions(x)
        steps, batch, tags = e.shape
        # The field in probabilities, scaled at each step.
        trans = self.p["trans"].astype(np.float64)
        peak, top = e.max(2, keepdims=True).astype(np.float64), trans.max()
        likely, move = np.exp(e - peak), np.exp(trans - top)
        alpha, beta, scale = np.empty((steps, batch, tags)), np.ones((steps, batch, tags)), np.empty((steps, batch, 1))
        for t in range(steps):
            a = likely[t] if t == 0 else (alpha[t - 1] @ move) * likely[t]
            scale[t] = a.sum(1, keepdims=True)
            alpha[t] = a / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (likely[t + 1] * beta[t + 1]) @ move.T / scale[t + 1]
        z = (np.log(scale) + peak).sum((0, 2)) + (steps - 1) * top
        yt = y.T
        gold = np.take_along_axis(e, yt[..., None], 2).sum((0, 2)) + trans[yt[:-1], yt[1:]].sum(0)
        share = 1.0 / (steps * batch)
        de = alpha * beta
        np.put_along_axis(de, yt[..., None], np.take_along_axis(de, yt[..., None], 2) - 1, 2)
        later = likely[1:] * beta[1:] / scale[1:]
        dtrans = (alpha[:-1].reshape(-1, tags).T @ later.reshape(-1, tags)) * move
        dtrans -= np.bincount(yt[:-1].ravel() * tags + yt[1:].ravel(), minlength=tags * tags).reshape(tags, tags)
        de = (de * share).astype(h.dtype)
        g = {"trans": (dtrans * share).astype(h.dtype), "wo": h.reshape(-1, h.shape[2]).T @ de.reshape(-1, tags), "bo": de.sum((0, 1))}
        dh = de @ self.p["wo"].T
        wh = np.stack([self.p["wh_f"], self.p["wh_b"]])
        hidden = wh.shape[1]
        dh = np.stack([dh[..., :hidden], dh[::-1, :, hidden:]], 1)
        bent = np.tanh(cells[1:])
        i, f, o = (gates[..., k * hidden : (k + 1) * hidden] for k in range(3))
        # What a change of the cell does to each gate, and one of the state to the output gate and the cell.
        by_cell = np.concatenate([cand * i * (1 - i), cells[:-1] * f * (1 - f), np.zeros_like(i), i * (1 - cand * cand)], 3)
        by_state, to_cell = bent * o * (1 - o), o * (1 - bent * bent)
        dz = np.empty_like(by_cell)
        back = wh.transpose(0, 2, 1)
        gh, gc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        for t in range(steps - 1, -1, -1):
            gh = gh + dh[t]
            gc = gc + gh * to_cell[t]
            np.multiply(by_cell[t].reshape(2, batch, 4, hidden), gc[:, :, None], out=dz[t].reshape(2, batch, 4, hidden))
            dz[t][..., 2 * hidden : 3 * hidden] = gh * by_state[t]
            gh, gc = dz[t] @ back, gc * f[t]
        g["emb"] = np.zeros_like(self.p["emb"])
        one_hot = np.zeros((steps * batch, len(self.p["emb"])), h.dtype)
        one_hot[np.arange(steps * batch), xt.ravel()] = 1
        for k, d in enumerate("fb"):
            own = dz[:, k].reshape(-1, 4 * hidden)
            ordered = (dz[:, k] if d == "f" else dz[::-1, k]).reshape(-1, 4 * hidden)
            by_class = one_hot.T @ ordered
            g[f"wh_{d}"], g[f"b_{d}"], g[f"wx_{d}"] = states[:-1, k].reshape(-1, hidden).T @ own, by_class.sum(0), self.p["emb"].T @ by_class
            g["emb"] += by_class @ self.p[f"wx_{d}"].T
        return float((z - gold).sum() * share), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 3) -> float:
        """Adam; returns the last loss."""
        rng = np.random.RandomState(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        n, loss = 0, 0.0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                n += 1
                loss, g = self.loss_and_grads(x[order[i : i + batch]], y[order[i : i + batch]])
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
        return loss

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emissions (T, tags, B) for classes (B, T): those of ``emissions``, in less time.

        Both directions take their steps together, and one product a step gives the gates of the step and the emissions of the states
        before it. All gates share one tanh, as sigmoid(z) = (1 + tanh(z / 2)) / 2; the halves are in the weights and in one product.
        Where numpy's tanh is slow, 1 + tanh(z) = 2 / (1 + exp(-2 z)).
        """
        by_exp = slow_tanh()
        batch, steps = x.shape
        (width, hidden), tags = (self.p["emb"].shape[1], self.p["wh_f"].shape[0]), len(self.p["bo"])
        blocks = -(-batch // BLOCK)
        block = -(-batch // blocks)
        columns = blocks * block
        xt = np.zeros((steps, columns), np.intp)
        xt[:, :batch] = x.T
        seen = np.take(self.p["emb"].T.astype(np.float32), xt, axis=1, mode="clip").transpose(1, 0, 2)
        # Rows of the weights: input, forget and output gates, candidates, tags; columns: states (here twice the usual), embedding, one.
        w = np.zeros((2, 1, 4 * hidden + tags, hidden + width + 1), np.float32)
        for k, d in enumerate("fb"):
            w[k, 0, : 4 * hidden] = np.concatenate([self.p[f"wh_{d}"] / 2, self.p[f"wx_{d}"], self.p[f"b_{d}"][None]]).T
            w[k, 0, 4 * hidden :, :hidden] = self.p["wo"][k * hidden : (k + 1) * hidden].T / 2
        w[:, :, : 3 * hidden] *= 0.5
        if by_exp:
            w[:, :, : 4 * hidden] *= -2
        w[0, 0, 4 * hidden :, -1] = self.p["bo"]
        s, z = np.zeros((2, hidden + width + 1, columns), np.float32), np.empty((2, 4 * hidden + tags, columns), np.float32)
        s[:, -1] = 1
        c, bent = np.zeros((2, hidden, columns), np.float32), np.empty((2, hidden, columns), np.float32)
        s_blocks, z_blocks = (a.reshape(2, -1, blocks, block).transpose(0, 2, 1, 3) for a in (s, z))
        state, ahead, back, said = s[:, :hidden], s[0, hidden:-1], s[1, hidden:-1], z[:, 4 * hidden :]
        inner, gates = z[:, : 4 * hidden], z[:, : 3 * hidden]
        enter, forget, leave, cand = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
        e = np.empty((steps, tags, columns), np.float32)
        for t in range(steps + 1):
            if t < steps:
                ahead[:], back[:] = seen[t], seen[-1 - t]
            np.matmul(w, s_blocks, out=z_blocks)
            if t:
                # The directions meet in the middle; each character's second direction adds to its first.
                for k, at in enumerate((t - 1, steps - t)):
                    if 2 * t <= steps or (2 * t == steps + 1 and not k):
                        e[at] = said[k]
                    else:
                        e[at] += said[k]
            if t < steps:
                if by_exp:
                    with np.errstate(over="ignore"):
                        np.exp(inner, out=inner)
                    inner += 1
                    np.divide(2, inner, out=inner)
                    cand -= 1
                else:
                    np.tanh(inner, out=inner)
                    gates += 1
                c *= forget
                enter *= cand
                c += enter
                c *= 0.5
                np.multiply(leave, np.tanh(c, out=bent), out=state)
        return e[:, :, :batch]

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tags (B, T) of the best path over the first ``lengths`` steps of e (T, B, tags); ties go to the tag that comes first."""
        steps, batch, tags = e.shape
        back = np.empty((steps, batch, tags), np.int8)
        score = e[0]
        for t in range(1, steps):
            full = score[:, :, None] + self.p["trans"]
            on = (t < lengths)[:, None]
            back[t] = np.where(on, full.argmax(1), np.arange(tags))
            score = np.where(on, full.max(1) + e[t], score)
        out = np.empty((batch, steps), np.int8)
        out[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(batch), out[:, t]]
        return out

    def undecided(self, gain: np.ndarray, first: np.ndarray, last: np.ndarray, slack: float = 0.01) -> np.ndarray:
        """Which characters the best path may tag: the others lie in no stretch outside O whose upper bound reaches O's score.

        gain: upper bounds of what any tag scores above O, OUTSIDE between texts; first, last: the texts' first and last characters.
        """
        trans = self.p["trans"].astype(np.float64) - self.p["trans"][0, 0]
        enter, stay, leave = trans[0, 1:].max(), trans[1:, 1:].max(), trans[1:, 0].max()
        total = np.zeros(len(gain) + 1)
        np.add(gain, stay, out=total[1:])
        # Nothing is entered before a text's first character nor left after its last.
        total[first + 1] -= enter
        total[last + 1] -= leave
        # The best stretch over t: of a running sum of (gain + stay) the largest value from t on, less the least one before.
        np.cumsum(total, out=total)
        best = np.maximum.accumulate(total[:0:-1])[::-1]
        best -= np.minimum.accumulate(total[:-1])
        return best > stay - enter - leave - slack


def window_counts(lengths: np.ndarray) -> np.ndarray:
    """Windows that cover a text of each length (1 at least): STRIDE apart, neighbours share SHARED characters."""
    return np.maximum(1, -(-(lengths - SHARED) // STRIDE))


def evenly(windows: np.ndarray) -> list[np.ndarray]:
    """Windows in lots of about one size, at most HELD: a small lot costs nearly as much as a full one."""
    return np.array_split(windows, -(-len(windows) // HELD)) if len(windows) else []


class Windows:
    """The overlapping windows of some texts, and the slots of their characters: STRIDE a window and one more STRIDE a text."""

    def __init__(self, texts: list[str]):
        lengths = np.array([len(t) for t in texts])
        counts = window_counts(lengths)
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.n = len(self.text)
        # The slot of each text's first character, and the stride of slots in which each window begins.
        self.base = (np.cumsum(counts) - counts + np.arange(len(texts))) * STRIDE
        self.place = np.arange(self.n) + self.text
        self.slots = (self.n + len(texts)) * STRIDE
        self.codes = np.zeros(self.slots, np.int8)
        self.inside = np.zeros(self.slots, bool)
        for t, at in zip(texts, self.base.tolist()):
            self.codes[at : at + len(t)] = classes(t)
            self.inside[at : at + len(t)] = True
        self.lengths = lengths
        # Weights of a window's first and last SHARED characters: halves of a ramp, but whole at a text's ends.
        ramp = ((np.arange(SHARED) + 0.5) / SHARED).astype(np.float32)
        new = np.concatenate([[True], self.text[1:] != self.text[:-1]]) if self.n else np.zeros(0, bool)
        old = np.concatenate([new[1:], [True]]) if self.n else new
        self.left = np.where(new[:, None], np.float32(1), ramp)
        self.right = np.where(old[:, None], np.float32(1), 1 - ramp)

    def rows(self, windows: np.ndarray) -> np.ndarray:
        """Classes (windows, WINDOW)."""
        strides, place = self.codes.reshape(-1, STRIDE), self.place[windows]
        return np.concatenate([strides[place], strides[place + 1, :SHARED]], 1)

    def gains(self, tagger: Tagger) -> np.ndarray:
        """For each slot an upper bound of what any tag's merged emission is above O's: a mean of maxima is no less than the maximum of means."""
        out = np.zeros((self.slots // STRIDE, STRIDE), np.float32)
        for w in evenly(np.arange(self.n)):
            e = tagger.scores(self.rows(w))
            g = np.ascontiguousarray((e[:, 1:].max(1) - e[:, 0]).T)
            g[:, :SHARED] *= self.left[w]
            g[:, STRIDE:] *= self.right[w]
            out[self.place[w]] += g[:, :STRIDE]
            out[self.place[w] + 1, :SHARED] += g[:, STRIDE:]
        out = out.ravel()
        out[~self.inside] = OUTSIDE
        return out

    def merged(self, tagger: Tagger, slots: np.ndarray) -> np.ndarray:
        """Merged emissions (slots, tags) of the given slots."""
        place, at = np.divmod(slots, STRIDE)
        window = np.full(self.slots // STRIDE, -1)
        window[self.place] = np.arange(self.n)
        own, before = window[place], np.where(place > 0, window[place - 1], -1)
        shared = (at < SHARED) & (before >= 0)
        needed = np.unique(np.concatenate([own[own >= 0], before[shared]]))
        out = np.zeros((len(slots), len(tagger.p["bo"])), np.float32)
        for w in evenly(needed):
            e = tagger.scores(self.rows(w))
            for at_window, there, add, weights in ((own, own >= 0, 0, self.left), (before, shared, STRIDE, self.right)):
                k = np.searchsorted(w, at_window)
                k = np.minimum(k, len(w) - 1)
                s = np.flatnonzero(there & (w[k] == at_window))
                value = e[at[s] + add, :, k[s]]
                weight = weights[at_window[s], np.minimum(at[s], SHARED - 1)]
                out[s] += value * np.where(at[s] < SHARED, weight, np.float32(1))[:, None]
        return out


def decoded(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The spans on the best path over the merged emissions of each text (none empty)."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    windows = Windows(texts)
    ends = windows.base + windows.lengths - 1
    may = tagger.undecided(windows.gains(tagger), windows.base, ends) & windows.inside
    slots = np.flatnonzero(may)
    if not len(slots):
        return out
    e = windows.merged(tagger, slots)
    edge = np.flatnonzero(np.concatenate([[True], np.diff(slots) > 1]))
    low, size = slots[edge], np.diff(np.append(edge, len(slots)))
    text = np.searchsorted(windows.base, low, "right") - 1
    starts, stops = low == windows.base[text], low + size - 1 == ends[text]
    # Stretches are decoded between characters that are surely O, in batches of about one size.
    order = np.argsort(size, kind="stable")
    pieces, i = [], 0
    while i < len(order):
        j = i + 1
        while j < len(order) and size[order[j]] <= 2 * size[order[i]] + 16 and (j - i + 1) * size[order[j]] <= 200_000:
            j += 1
        own = order[i:j]
        lead = (~starts[own]).astype(int)
        steps = int((size[own] + lead + ~stops[own]).max())
        x = np.full((steps, len(own), e.shape[1]), OUTSIDE, np.float32)
        x[:, :, 0] = 0
        for b, k in enumerate(own.tolist()):
            x[lead[b] : lead[b] + size[k], b] = e[edge[k] : edge[k] + size[k]]
        tags = tagger.viterbi(x, size[own] + lead + ~stops[own])
        for b, k in enumerate(own.tolist()):
            pieces.append((int(low[k]), int(text[k]), tags[b, lead[b] : lead[b] + size[k]]))
        i = j
    for at, k, tags in sorted(pieces, key=lambda p: p[0]):
        if tags.any():
            shift = at - int(windows.base[k])
            out[k] += [(a + shift, b + shift, kind) for a, b, kind in tagged(tags)]
    return out


def shaped(text: str, kind: str) -> bool:
    """Whether a model span has its kind's shape; the patterns' stricter rules need not hold."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return ("@" in text or " at " in text or "(at)" in text) and "." in text and not text[-1:].isspace()
    if kind == "ip":
        return text.count(".") == 3 and digits >= 4 and all(p.isascii() and p.isdigit() and int(p[:9]) <= 255 and len(p) <= 3 for p in text.split("."))
    if kind == "card":
        return 14 <= digits <= 19 and luhn("".join(c for c in text if "0" <= c <= "9"))
    return 10 <= digits <= 15 and text[-1:].isdigit() and not any(c.isalpha() for c in text)


def model_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """What the model adds to each text's base spans."""
    some = [k for k, t in enumerate(texts) if t]
    added: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, spans in zip(some, decoded(tagger, [texts[k] for k in some]) if some else []):
        added[k] = [(a, b, kind) for a, b, kind in spans if free(a, b, base[k]) and shaped(texts[k][a:b], kind)]
    return added


def free(a: int, b: int, base: list[tuple[int, int, str]]) -> bool:
    return all(b <= s or a >= e for s, e, _ in base)


def tagged(tags: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of each run of one kind; a B begins a new one."""
    start, kind = 0, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        now = (t + 1) // 2
        if kind and (now != kind or t % 2):
            yield start, i, KINDS[kind - 1]
            kind = 0
        if now and not kind:
            start, kind = i, now


# --- training --------------------------------------------------------------------------------------------------------

#: Windows of each sort that a tagger is trained on, at most: with spans, with digits or at-signs but no span, and any.
TRAINING_WINDOWS = (1500, 700, 1500)
#: One window of the third sort is drawn for so many characters of a row.
PLAIN_EVERY = 2000


def training_window(text: str, low: int, spans: list[tuple[int, int, str]], rng: np.random.RandomState) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of a window from ``low`` on; spans that lie in it whole may be rewritten."""
    high = min(len(text), low + TRAINED)
    piece, tag = [], []
    at = low
    for a, b, kind in spans:
        if b <= at or a >= high or low < a < at:
            continue
        first, last = max(a, low), min(b, high)
        piece.append(text[at:first])
        tag += [0] * (first - at)
        span, roll = text[first:last], rng.rand()
        if (first, last) == (a, b):
            if kind == "phone" and roll < 0.3:
                span = span[1:]
            elif kind == "email" and roll < 0.3:
                span = span.replace("@", " at " if roll < 0.1 else "(at)" if roll < 0.2 else " (at) ", 1)
        piece.append(span)
        k = 2 * KINDS.index(kind) + 1
        tag += [k if first == a else k + 1] + [k + 1] * (len(span) - 1)
        at = last
    piece.append(text[at:high])
    tag += [0] * (high - at)
    codes = classes("".join(piece))[:TRAINED]
    x, y = np.zeros(TRAINED, np.int8), np.zeros(TRAINED, np.int8)
    x[: len(codes)] = codes
    y[: len(codes)] = tag[:TRAINED]
    return x, y


def training_windows(text: str, seed: int) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    """(sort, order, classes, tags) of windows of a text: three at each base span, one at each digit or at-sign that is in none and
    90 characters from the last such, one at each " at ", and one anywhere for each PLAIN_EVERY characters. The order is random."""
    rng = np.random.RandomState(seed)
    spans = base_spans(text)
    for a, b, _ in spans:
        # Spans are few, so each is seen in more than one form and place.
        for _ in range(3):
            yield 0, rng.rand(), *training_window(text, max(0, int(rng.randint(min(a, max(0, b - TRAINED)), a + 1))), spans, rng)
    last, k = -TRAINED, 0
    for m in TRIGGER.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if m.start() - last >= 90 and not (k < len(spans) and spans[k][0] <= m.start()):
            last = m.start()
            yield 1, rng.rand(), *training_window(text, max(0, last - int(rng.randint(0, TRAINED))), spans, rng)
    lows = [int(rng.randint(0, max(1, len(text) - TRAINED))) for _ in range(-(-len(text) // PLAIN_EVERY))]
    lows += [max(0, m.start() - int(rng.randint(0, TRAINED))) for m in re.finditer(" at ", text)]
    for low in lows:
        yield 2, rng.rand(), *training_window(text, low, spans, rng)


def fit(docs: DataFrame, sample: int = 4000, windows: tuple[int, int, int] = TRAINING_WINDOWS, epochs: int = 24) -> dict[str, np.ndarray]:
    """Parameters of a tagger trained on the base spans of at most ``sample`` rows, chosen by the hash of doc_id.

    The rows are cut into labelled windows where they lie; of each sort at most ``windows`` reach the driver, drawn by a random
    number, 2 * TRAINED bytes each. Null ids and texts are no training rows; without any the network stays as it began.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("all")).where("doc_id is not null")
    few = docs.sparkSession.createDataFrame(common.drawn(ids, sample, "all").select("doc_id").toArrow())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.by_bytes(batches, most=1 << 19):
            for text in part.column(1).to_pylist():
                found = list(training_windows(text, zlib.crc32(text.encode())))
                for i in range(0, len(found), 2000):
                    sort, order, x, y = zip(*found[i : i + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array(sort, pa.int32()), pa.array(order, pa.float64()), pa.array([a.tobytes() for a in x], pa.binary()), pa.array([a.tobytes() for a in y], pa.binary())], ["sort", "order", "x", "y"])

    cut = materialize(rows.mapInArrow(run, "sort int, order double, x binary, y binary"), "training")
    parts = [cut.where(F.col("sort") == k).orderBy("order", "x", "y").limit(n) for k, n in enumerate(windows)]
    got = parts[0].unionAll(parts[1]).unionAll(parts[2]).toArrow().sort_by([("sort", "ascending"), ("order", "ascending"), ("x", "ascending"), ("y", "ascending")])
    tagger = Tagger.fresh()
    x, y = (np.frombuffer(b"".join(got[c].to_pylist()), np.int8).reshape(-1, TRAINED).astype(np.int64) for c in ("x", "y"))
    if len(x):
        tagger.fit(x, y, epochs)
    return tagger.p


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
_OUT_SQL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _found(params: dict, texts: list[str]):
    base = [base_spans(t) for t in texts]
    return base, model_spans(Tagger(params), texts, base)


def personal_data(docs: DataFrame, params: dict) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): base counts by kind, digest of the base spans, all spans, number added.

    Offsets count code points. Null and empty texts have no spans; texts of any length are read whole; repeated rows and null ids
    give rows like others; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.by_bytes(batches, most=1 << 19):
            if part.num_rows:
                texts = [t or "" for t in part.column(1).to_pylist()]
                base, added = _found(shared.value, texts)
                rows = []
                for doc, b, more in zip(part.column(0).to_pylist(), base, added):
                    every = sorted([*b, *more], key=lambda s: (s[0], KINDS.index(s[2])))
                    rows.append((doc, *(sum(s[2] == k for s in b) for k in KINDS), hashlib.sha256(joined(b).encode()).hexdigest(), joined(every), len(more)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT_SQL)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or merged overlapping spans, replaced by its kind in brackets (the kind of the first)."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, params: dict) -> DataFrame:
    """docs with personal data in ``text`` replaced; null texts stay null, all other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(params)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.by_bytes(batches, most=1 << 19):
            k = part.schema.get_field_index("text")
            if part.num_rows:
                raw = part.column(k).to_pylist()
                texts = [t or "" for t in raw]
                base, added = _found(shared.value, texts)
                new = [None if r is None else redact(t, [*b, *m]) for r, t, b, m in zip(raw, texts, base, added)]
                columns = list(part.columns)
                columns[k] = pa.array(new, part.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, schema)
