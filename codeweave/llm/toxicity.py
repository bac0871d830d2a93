"""Toxicity by a weighted finite-state pattern grammar.

Four sequential transducers are composed into one: a lexer names each token (insult, threat, target, negation, report, quotation
mark, clause border, other), a reported-speech machine marks what follows a verb of saying or stands in quotation marks, a negation
machine marks a short scope after a negator, and a pattern machine turns the marked stream into clause patterns (insult, insult at
a target, threat at a target, each plain, negated or reported). Reported speech and negation reach over the clause borders of a
sentence, and quotations over the sentences of a line; patterns are matched within a clause. A document's score is a logistic
function of the summed weights of its matched clauses, by pattern; a word outside such a clause counts nothing.

Learned are the insults and all weights; the other word classes (threats, targets, negations, verbs of saying) are small closed
classes of the grammar and stand as fixed values.

Learned: the insult lexicon (words and word beginnings, kept as a trie of weighted arcs) by log odds of document frequencies,
and the patterns' coefficients, both from at most ``sample`` labelled rows of either class. Everything else is grammar.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import TRAINING_BYTES, by_bytes, drawn, mix64, shingle_sets

# Closed word classes of the grammar, in English, German, French and Spanish.
THREATS = ("kill", "hurt", "destroy", "shoot", "burn", "attack", "smash", "töten", "umbringen", "schlagen", "vernichten", "tuer", "frapper", "détruire", "brûler", "matar", "golpear", "destruir", "quemar")
TARGETS = ("you", "your", "yours", "he", "she", "they", "them", "him", "her", "dich", "dir", "euch", "ihn", "ihr", "sie", "toi", "te", "vous", "lui", "eux", "tú", "ti", "usted", "ustedes", "ellos", "ellas")
NEGATIONS = ("not", "never", "no", "without", "isn't", "aren't", "nicht", "nie", "kein", "keine", "ohne", "ne", "pas", "jamais", "sans", "nunca", "jamás", "sin")
REPORTS = ("said", "says", "wrote", "claimed", "reported", "quoted", "sagte", "schrieb", "behauptete", "disait", "écrivait", "affirmait", "dijo", "escribió", "afirmó")
QUOTES = "\"“”„«»"

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»,;:]")
WORD = re.compile(r"[^\W\d_]+")
BORDERS, SENTENCE_ENDS = ",;:", ".!?\n"
SENTENCE_END = re.compile(r"[.!?\n]")
QUOTE = re.compile(f"[{QUOTES}]")
SYMBOLS = "ITGNRQCO"
PATTERNS = ("insult", "insult_target", "threat_target", "negated", "reported")
#: Words after a negator that it reaches, clause borders not counted.
NEGATION_SCOPE = 4


@dataclass
class Transducer:
    """A sequential transducer: arcs[state][symbol] = (next state, output symbol); symbols without an arc pass unchanged."""

    start: object
    arcs: dict = field(default_factory=dict)
    passes: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get(state, {}).get(symbol) or (self.passes.get(state, state), symbol)


def compose(machines: list[Transducer], symbols: list[str]) -> dict:
    """The table (states, symbol) -> (states, output) of machines that read each other's output, over all reachable states."""
    start = tuple(m.start for m in machines)
    table, todo = {}, [start]
    while todo:
        state = todo.pop()
        if (state, symbols[0]) in table:
            continue
        for symbol in symbols:
            out, after = symbol, []
            for m, s in zip(machines, state):
                s, out = m.step(s, out)
                after.append(s)
            table[state, symbol] = (tuple(after), out)
            todo.append(tuple(after))
    return {"start": start, "table": table}


def grammar() -> dict:
    """Report, negation and pattern machines composed. Symbols: I insult, T threat, G target, N negation, R report, Q quote, C border, O other."""
    return compose(machines(), list(SYMBOLS))


def machines() -> list[Transducer]:
    report = Transducer("plain", {
        "plain": {"R": ("said", "O"), "Q": ("quoted", "O")},
        "said": {"I": ("said", "Ir"), "T": ("said", "Tr"), "R": ("said", "O"), "Q": ("quoted", "O")},
        "quoted": {"I": ("quoted", "Ir"), "T": ("quoted", "Tr"), "Q": ("plain", "O"), "R": ("quoted", "O")},
    })
    negation = Transducer(0, {0: {"N": (NEGATION_SCOPE, "O")}})
    for k in range(1, NEGATION_SCOPE + 1):
        negation.arcs[k] = {"N": (NEGATION_SCOPE, "O"), "C": (k, "C"), "I": (0, "In"), "T": (0, "Tn"), "Ir": (0, "Ir"), "Tr": (0, "Tr")}
        negation.passes[k] = k - 1
    insults = {"I": "insult", "In": "negated", "Ir": "reported"}
    pattern = Transducer("start", {
        "start": {"G": ("target", "O"), "T": ("threat", "O"), **{s: ("insulted", p) for s, p in insults.items()}, "Tn": ("start", "O"), "Tr": ("start", "O")},
        "target": {"I": ("insulted", "insult_target"), "In": ("target", "negated"), "Ir": ("target", "reported"), "T": ("target", "threat_target"), "Tn": ("target", "negated"), "Tr": ("target", "reported")},
        "threat": {"G": ("target", "threat_target"), **{s: ("insulted", p) for s, p in insults.items()}, "Tn": ("threat", "O"), "Tr": ("threat", "O")},
        "insulted": {"G": ("target", "insult_target"), "T": ("threat", "O"), **{s: ("insulted", p) for s, p in insults.items()}, "Tn": ("insulted", "O"), "Tr": ("insulted", "O")},
    })
    for state in pattern.arcs:
        pattern.arcs[state]["C"] = ("start", "O")
    return [report, negation, pattern]


def one_of_each(texts: list[str]) -> list[int]:
    """Indices of texts without copies: a text whose smallest shingle under any of three permutations was seen before is left out."""
    seen, kept = set(), []
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        grams = next(shingle_sets(raw, np.array([0, len(raw)])))
        keys = {(k, int(mix64(grams ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min())) for k in (1, 2, 3)} if len(grams) else set()
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def learn_lexicon(texts: list[str], labels: list[int], least_docs: int = 3, least_share: float = 0.008, least_odds: float = 3.0) -> dict[str, float]:
    """Weights of words (ending in a space) and word beginnings of 4 to 6 letters that toxic documents have far more often.

    A word or beginning counts when at least ``least_docs`` and a ``least_share`` of the toxic documents have it and its smoothed
    log odds are at least ``least_odds``; copies of a document count once. A beginning goes if a longer entry is clearly better
    (by 0.5); of the rest, a longer entry goes if a shorter one covers it.
    """
    kept = one_of_each(texts)
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    seen = {0: Counter(), 1: Counter()}
    sizes = Counter(labels)
    for text, y in zip(texts, labels):
        words = set(WORD.findall(text.lower()))
        keys = {w + " " for w in words} | {w[:k] for w in words for k in (4, 5, 6) if len(w) > k}
        seen[y].update(keys)
    odds = {}
    for key, t in seen[1].items():
        if t >= max(least_docs, least_share * sizes[1]):
            value = math.log((t + 0.5) / (sizes[1] + 1)) - math.log((seen[0][key] + 0.5) / (sizes[0] + 1))
            if value >= least_odds:
                odds[key] = value
    shorter = {k: [k.strip()[:n] for n in (4, 5, 6) if n < len(k.strip()) and k.strip()[:n] in odds] for k in odds}
    blunt = {p for k, above in shorter.items() for p in above if odds[k] > odds[p] + 0.5}
    return {k: v for k, v in sorted(odds.items()) if k not in blunt and not any(p not in blunt for p in shorter[k])}


class Grammar:
    """The composed machine with its lexicon; ``features`` sums clause weights by pattern."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.lexicon = lexicon
        machine = grammar()
        self.start, self.table = machine["start"], machine["table"]
        self.quoted = ("quoted", *self.start[1:])
        self.classes = dict.fromkeys(BORDERS, "C") | dict.fromkeys(TARGETS, "G") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTS, "R") | dict.fromkeys(THREATS, "T") | dict.fromkeys(QUOTES, "Q")
        self.anchors = ahocorasick.Automaton()
        for word in {*(k.strip() for k in lexicon), *THREATS}:
            self.anchors.add_word(word, len(word))
        self.anchors.make_automaton()

    def lex(self, token: str) -> tuple[str, float]:
        weight = self.lexicon.get(token + " ")
        for k in (4, 5, 6):
            if weight is None and len(token) > k:
                weight = self.lexicon.get(token[:k])
        if weight is not None:
            return "I", weight
        symbol = self.classes.get(token, "O")
        return symbol, 2.0 if symbol == "T" else 0.0

    def clauses(self, text: str) -> Iterator[tuple[int, int, dict[str, float]]]:
        """Start, end and pattern weights of each clause with a match; only sentences with a lexicon entry are read at all."""
        low = text.lower()
        done = -1
        for end, length in self.anchors.iter(low):
            begin = end - length + 1
            if begin < done or (begin and low[begin - 1].isalpha()):
                continue
            left = max(low.rfind(c, 0, begin) for c in SENTENCE_ENDS) + 1
            found = SENTENCE_END.search(low, end + 1)
            done = right = found.start() if found else len(low)
            yield from self.matches(low, left, right)

    def inside_quotes(self, low: str, left: int) -> bool:
        """Whether a quotation of the same line is open at ``left``: an odd number of marks before it and one at least after it."""
        line = low.rfind("\n", 0, left) + 1
        if len(QUOTE.findall(low, line, left)) % 2 == 0:
            return False
        end = low.find("\n", left)
        return QUOTE.search(low, left, end if end >= 0 else len(low)) is not None

    def matches(self, low: str, left: int, right: int) -> Iterator[tuple[int, int, dict[str, float]]]:
        """The clauses of one sentence."""
        state, sums, carried, at = self.quoted if self.inside_quotes(low, left) else self.start, {}, 0.0, left
        for m in TOKEN.finditer(low, left, right):
            symbol, weight = self.lex(m.group())
            state, out = self.table[state, symbol]
            carried = weight or carried
            if symbol == "C":
                if sums:
                    yield at, m.start(), sums
                sums, carried, at = {}, 0.0, m.end()
            elif out in PATTERNS:
                sums[out] = sums.get(out, 0.0) + (carried if out != "insult_target" or symbol == "I" else 0.5 * carried)
        if sums:
            yield at, right, sums

    def features(self, text: str) -> tuple[np.ndarray, int]:
        total, n = np.zeros(len(PATTERNS)), 0
        for _, _, sums in self.clauses(text):
            n += 1
            for k, p in enumerate(PATTERNS):
                total[k] += sums.get(p, 0.0)
        return np.log1p(total), n


#: Coefficients before any data: a plain match decides, a negated or reported one counts less.
PRIOR = np.array([1.5, 2.0, 1.5, 0.5, 0.7])


def fit(texts: list[str], labels: list[int], pull: float = 2.0, steps: int = 400) -> dict:
    """Lexicon and coefficients, by penalized logistic regression that pulls to PRIOR; without toxic rows, the bare grammar."""
    lexicon = learn_lexicon(texts, labels) if 1 in labels and 0 in labels else {}
    machine = Grammar(lexicon)
    coef, bias = PRIOR.copy(), -3.0
    if texts:
        x, y = np.array([machine.features(t)[0] for t in texts]), np.array(labels, float)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ coef + bias, -30, 30)))
            g = weight * (p - y)
            coef -= 0.05 * ((x * g[:, None]).sum(0) + pull * (coef - PRIOR)) / len(y) * 4
            bias -= 0.05 * (g.sum() + pull * (bias + 3.0)) / len(y) * 4
            coef = np.maximum(coef, 0)
    return {"lexicon": lexicon, "coef": coef.tolist(), "bias": float(bias)}


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: str, sample: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``sample`` rows of either class, chosen by the hash of doc_id among the training rows.

    ``train`` is a SQL condition over doc_id. Null labels, ids and texts are no training rows, nor are texts of more than
    TRAINING_BYTES bytes: what reaches the driver has a bound.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(train)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = drawn(rows, sample, "y").toPandas()
    if not len(ids):
        return [], []
    few = docs.sparkSession.createDataFrame(ids)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= TRAINING_BYTES).join(F.broadcast(few), "doc_id").toPandas()
    got = got.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    return got["text"].tolist(), got["y"].astype(int).tolist()


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, clauses) for every row of docs(doc_id, text, ...).

    Null and empty texts match nothing and get the base score; texts of any length are read whole; repeated rows are scored
    each; null ids are carried; other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", pa.int64())])
    coef, bias = np.array(model["coef"]), model["bias"]
    shared = docs.sparkSession.sparkContext.broadcast(model["lexicon"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Grammar(shared.value)
        for batch in by_bytes(batches):
            scores, counts = [], []
            for text in batch.column(1):
                x, n = machine.features(text.as_py() or "")
                scores.append(float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ coef) + bias))))))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, clauses long")
