"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, a clause into words, and a word becomes a symbol: insult, threat, target (whom
it is aimed at), negation, reported speech, or another word. Small transducers read the symbols of a clause and are
composed into one table (``GRAMMAR``):
- ``INSULTING`` strengthens an insult that follows another one within three words of a clause,
- ``NEGATION`` weakens what follows a negation within three words,
- ``REPORTED`` weakens the rest of a clause after a verb of speech,
- ``TARGET`` strengthens an insult near a target,
- ``THREAT`` lets a threat count only if a target stands near it.
The weight of a match is the weight of its word times the factor that the grammar gives it. A text is scored by
its matched clauses (largest weight, sum, number, share), not by isolated words.

What is learned from labelled rows: the insult lexicon beyond the given words (words and beginnings of words that occur
nearly only in toxic texts, with their log-odds as weight; as many as have the support and purity), from one half of a
bounded sample (``SAMPLE`` distinct rows of each label at most), and from the other half the logistic scale that turns matches into a score.

Null and empty texts have no clauses and get the score of a text without matches. Without labels of both kinds
the given words alone are used with a fixed scale. Rows repeat as given; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import LABELLED, bounded_sample, labelled_keys, rows_of_keys, whole_text
from cloakframe.session import materialize

SAMPLE = 4000
LEAST_SHARE = 0.01  # of the toxic sample that must hold a learned term
LEAST_PURITY = 0.9  # share of toxic texts among those that hold it, labels weighed equally
BEGINNINGS = range(4, 9)
_CACHE = 200_000

OTHER, INSULT, THREATENS, AIMED, NOT, SAYS = range(6)
WEAK_INSULT, WEAK_THREAT, HARD_INSULT, HARD_THREAT = range(6, 10)

# Words of each kind in English, German, French and Spanish, and the weight of given insults.
INSULTS = [
    "idiot", "moron", "stupid", "trash", "pathetic", "worthless", "disgusting", "scum", "loser", "clown",
    "imbecile", "dumbass", "bastard", "asshole", "vermin", "filth", "garbage", "retard",
    "trottel", "abschaum", "arschloch", "versager", "dummkopf",
    "crétin", "ordure", "salaud", "connard", "abruti",
    "imbécil", "basura", "idiota", "escoria", "estúpido",
]
THREATS = ["kill", "hurt", "destroy", "murder", "beat", "burn", "töten", "umbringen", "tuer", "détruire", "matar", "destruir"]
TARGETS = [
    "you", "your", "yourself", "he", "she", "they", "them", "him", "her",
    "du", "dich", "ihr", "euch", "toi", "vous", "tu", "usted", "ustedes", "ellos",
]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "nicht", "kein", "keine", "pas", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "called", "wrote", "quoted", "reported", "claims", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]
GIVEN_WEIGHT = 3.0
THREAT_WEIGHT = 2.0

_TOKENS = re.compile(r"[^\W\d_]+(?:'t)?|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")


@dataclass(frozen=True)
class Transducer:
    """rule(state, symbol) gives (next state, symbol to hand on, factor)."""

    states: int
    rule: object

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes the other one reads; factors multiply."""

        def rule(state: int, symbol: int) -> tuple[int, int, float]:
            a, b = divmod(state, other.states)
            a, middle, x = self.rule(a, symbol)
            b, out, y = other.rule(b, middle)
            return a * other.states + b, out, x * y

        return Transducer(self.states * other.states, rule)


def _insulting(state: int, symbol: int) -> tuple[int, int, float]:
    """State: words left in which another insult counts as one of a run."""
    if symbol == INSULT:
        return 4, symbol, 1.25 if state else 1.0
    return max(0, state - 1), symbol, 1.0


def _negation(state: int, symbol: int) -> tuple[int, int, float]:
    if symbol == NOT:
        return 3, symbol, 1.0
    left = max(0, state - 1)
    if state and symbol in (INSULT, THREATENS):
        return left, WEAK_INSULT if symbol == INSULT else WEAK_THREAT, 0.3
    return left, symbol, 1.0


def _reported(state: int, symbol: int) -> tuple[int, int, float]:
    if symbol == SAYS:
        return 1, symbol, 1.0
    if state and symbol == THREATENS:
        return state, WEAK_THREAT, 1.0
    return state, symbol, 0.6 if state and symbol in (INSULT, WEAK_INSULT) else 1.0


def _near_target(state: int, symbol: int) -> tuple[int, int, float]:
    """State: words left in which a target still counts as near."""
    if symbol == AIMED:
        return 4, symbol, 1.0
    left = max(0, state - 1)
    if state and symbol == INSULT:
        return left, HARD_INSULT, 1.5
    if state and symbol == THREATENS:
        return left, HARD_THREAT, 1.0
    return left, symbol, 1.0


def _threat(state: int, symbol: int) -> tuple[int, int, float]:
    """State: words left in which a target behind a threat completes it, 4 more if the threat is weak.

    Only a completed threat has weight.
    """
    if symbol in (THREATENS, WEAK_THREAT):
        return 3 if symbol == THREATENS else 7, symbol, 0.0
    if symbol == AIMED and state % 4:
        return 0, HARD_THREAT, 1.0 if state < 4 else 0.3
    return state - 1 if state % 4 else 0, symbol, 1.0


INSULTING, NEGATION, REPORTED = Transducer(5, _insulting), Transducer(4, _negation), Transducer(2, _reported)
TARGET, THREAT = Transducer(5, _near_target), Transducer(8, _threat)
_COMPOSED = INSULTING.then(NEGATION).then(REPORTED).then(TARGET).then(THREAT)
#: The composed table: for each state and symbol the next state, the symbol written and its factor.
GRAMMAR = [[_COMPOSED.rule(state, symbol) for symbol in range(6)] for state in range(_COMPOSED.states)]
_COUNTS = frozenset((INSULT, WEAK_INSULT, HARD_INSULT))
_THREATENING = frozenset((HARD_THREAT,))


def clause_weight(symbols: list[tuple[int, float]]) -> float:
    """Sum of the weights of the matches of one clause."""
    state, total = 0, 0.0
    for symbol, weight in symbols:
        state, written, factor = GRAMMAR[state][symbol]
        if written in _COUNTS:
            total += weight * factor
        elif written in _THREATENING:
            total += THREAT_WEIGHT * factor
    return total


class Lexicon:
    """Word to (symbol, weight): given words, learned words, then the longest learned beginning."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]) -> None:
        self.beginnings = beginnings
        self.fixed: dict[str, tuple[int, float]] = {w: (INSULT, x) for w, x in words.items()}
        self.fixed |= dict.fromkeys(INSULTS, (INSULT, GIVEN_WEIGHT))
        for symbol, given in ((THREATENS, THREATS), (AIMED, TARGETS), (NOT, NEGATIONS), (SAYS, REPORTS)):
            self.fixed |= dict.fromkeys(given, (symbol, 0.0))
        self.met: dict[str, tuple[int, float] | None] = {}

    def of(self, word: str) -> tuple[int, float] | None:
        """None for other words."""
        try:
            return self.met[word]
        except KeyError:
            pass
        found = self.fixed.get(word)
        if found is None:
            for size in reversed(BEGINNINGS):
                weight = self.beginnings.get(word[:size]) if len(word) >= size else None
                if weight is not None:
                    found = (INSULT, weight)
                    break
        if len(self.met) > _CACHE:
            self.met.clear()
        self.met[word] = found
        return found


def matches(text: str, lexicon: Lexicon) -> list[float]:
    """Largest clause weight, log of the sum, log of the number of matched clauses, their share."""
    tokens = _TOKENS.findall(text.lower())
    clauses = 1 + sum(1 for t in tokens if t in _ENDS)
    weights = []
    look = lexicon.of
    symbols = [look(t) for t in tokens]
    at = [i for i, s in enumerate(symbols) if s is not None and s[0] in (INSULT, THREATENS)]
    done = -1
    for i in at:
        if i < done:
            continue
        start, end = i, i
        while start and tokens[start - 1] not in _ENDS:
            start -= 1
        while end < len(tokens) and tokens[end] not in _ENDS:
            end += 1
        done = end
        weight = clause_weight([s or (OTHER, 0.0) for s in symbols[start:end]])
        if weight > 0:
            weights.append(weight)
    return [max(weights, default=0.0), float(np.log1p(sum(weights))), float(np.log1p(len(weights))), len(weights) / clauses]


@dataclass
class Grammar:
    """A fitted grammar: learned terms and the scale of the score."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    scale: list[float] = field(default_factory=lambda: [-4.0, 1.0, 1.0, 0.0, 0.0])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + rows @ np.array(self.scale[1:]), -30, 30)))


def _terms(texts: DataFrame) -> DataFrame:
    """(term, n, n_toxic): texts that hold a word ("w…") or a beginning ("b…"), counted per batch first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(frame["text"], frame["label"]):
                words = set(_TOKENS.findall(text.lower()))
                held = {"w" + w for w in words} | {"b" + w[:k] for w in words for k in BEGINNINGS if len(w) >= k}
                counts[label].update(held)
            terms = list(counts[0].keys() | counts[1].keys())
            toxic = [counts[1][t] for t in terms]
            yield pd.DataFrame({"term": terms, "n": [counts[0][t] + x for t, x in zip(terms, toxic)], "n_toxic": toxic})

    return texts.mapInPandas(run, "term string, n long, n_toxic long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")
    )


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton's method."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-3, *[0.05] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge @ w
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> Grammar:
    """Fit on a bounded sample of the distinct rows of ``docs`` that have a label in ``labels`` (doc_id, label)."""
    keys = labelled_keys(docs, labels, label)
    kinds = {r[LABELLED]: r["count"] for r in keys.groupBy(LABELLED).count().collect()}
    if not kinds.get(0) or not kinds.get(1):
        return Grammar()
    of_kind = [bounded_sample(keys.where(F.col(LABELLED) == k), sample) for k in (1, 0)]
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    rows = rows_of_keys(docs, of_kind[0].unionByName(of_kind[1]), text=whole_text(), half=half).distinct()
    rows = materialize(rows.select(F.col(LABELLED).alias("label"), "text", "half"), "labelled")
    sizes = {(r["half"], r["label"]): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    n = [max(1, sizes.get((0, k), 0)) for k in (0, 1)]
    odds = (F.col("n_toxic") + 0.5) / (n[1] + 1) / ((F.col("n") - F.col("n_toxic") + 0.5) / (n[0] + 1))
    purity = F.col("n_toxic") / n[1] / (F.col("n_toxic") / n[1] + (F.col("n") - F.col("n_toxic")) / n[0])
    terms = (
        _terms(rows.where("half = 0").select("text", "label"))
        .where((F.col("n_toxic") >= F.lit(max(3, LEAST_SHARE * n[1]))) & (purity >= LEAST_PURITY))
        .select("term", F.log(odds).alias("weight"))
        .collect()
    )
    words = {r["term"][1:]: r["weight"] for r in terms if r["term"][0] == "w"}
    beginnings = {r["term"][1:]: r["weight"] for r in terms if r["term"][0] == "b"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(words, beginnings)
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "x": [matches(t, lexicon) for t in frame["text"]]})

    held = rows.where("half = 1").select("label", "text").mapInPandas(run, "label int, x array<double>").toPandas()
    y = held["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Grammar(words, beginnings)
    x = np.array(held["x"].tolist())
    order = np.lexsort([*x.T, y])
    # Both labels were drawn up to the same bound: weigh them back to their shares.
    weight = np.where(y == 1, kinds[1] / max(1, (y == 1).sum()), kinds[0] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    return Grammar(words, beginnings, _logistic(x[order], y[order], weight[order]))


def scorer(grammar: Grammar):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(grammar.words, grammar.beginnings)
        for texts in batches:
            rows = np.array([matches(t, lexicon) for t in texts], float).reshape(-1, 4)
            yield pd.Series(grammar.score(rows))

    return score


def with_score(docs: DataFrame, grammar: Grammar, name: str) -> DataFrame:
    return docs.withColumn(name, scorer(grammar)(whole_text()))
