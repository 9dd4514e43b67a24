"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and each word becomes a symbol: insult, threat, target, negation,
report or other, with a weight from the lexicon of the insult and the threat transducer. Five weighted
transducers are composed into one machine, whose arcs carry the product of theirs: the insult and
threat transducers accept their words and raise what follows another one in the clause; the target
transducer raises what stands in a clause that addresses someone (and a threat needs a target to
count); the negation transducer lowers what follows a negation closely; the reported-speech transducer
lowers what is quoted or told of others. A document's features are sums over its matched clauses, not
over words. The fixed words are of English, German, French and Spanish.

The weights of insult arcs (words, or stems that match a word's beginning) are learned from
labelled rows as smoothed log odds; a logistic curve over the features gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import small_batches
from panelwise.llm.quality import held_out, labelled_sample, logistic_fit

#: Labelled rows that the model is fitted on, of each class, at most: one half for the arcs, one
#: for the curve. A fixed bound; all rows are scored.
FIT_ROWS = 6000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

#: Fixed word lists of the grammar: English, German, French, Spanish.
INSULTS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
           "dumm", "abschaum", "versager", "trottel", "imbécile", "ordure", "débile", "minable", "idiota", "estúpido", "basura", "imbécil")
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "punish", "smash",
           "töten", "verletzen", "vernichten", "verbrennen", "tuer", "frapper", "détruire", "brûler", "matar", "golpear", "destruir", "quemar")
TARGETS = ("you", "your", "yours", "yourself", "he", "him", "she", "her", "they", "them", "their", "people", "everyone",
           "du", "dich", "dir", "euch", "ihr", "tu", "toi", "vous", "eux", "tú", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "never", "no", "none", "nobody", "neither", "nor", "isn", "aren", "wasn", "don", "doesn", "didn", "won", "without",
             "nicht", "kein", "keine", "niemals", "pas", "jamais", "aucun", "sans", "nunca", "jamás", "ningún", "sin")
REPORTS = ("said", "says", "wrote", "writes", "claimed", "claims", "called", "reported", "quoted", "quote", "according", "alleged", "allegedly",
           "sagte", "schrieb", "behauptete", "laut", "disait", "écrit", "selon", "dijo", "escribió", "según")

#: Arcs are learned if they occur in so many toxic texts and their log odds stay above LEAST_ODDS
#: after DEVIATIONS standard errors are taken off.
LEAST_TEXTS, LEAST_ODDS, DEVIATIONS = 5, 1.0, 3.0
STEM_LENGTHS = range(4, 9)

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”«»]")
_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")


@dataclass(frozen=True)
class Transducer:
    """``arcs[state, symbol] = (next state, factor)``; a missing arc keeps the state, with factor 1."""

    arcs: dict[tuple[int, str], tuple[int, float]]

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


#: After a negation the next three words are in its reach: states 3, 2, 1.
NEGATION = Transducer({(s, "n"): (3, 1.0) for s in range(4)} | {(s, x): (s - 1, 0.3 if x in "it" else 1.0) for s in (1, 2, 3) for x in "ityro"})
#: State 1: reported or quoted.
REPORT = Transducer({(0, "r"): (1, 1.0), (1, "i"): (1, 0.4), (1, "t"): (1, 0.4)})
#: State 1: the clause has a target (set before the clause is read, since it may come last).
TARGET = Transducer({(0, "t"): (0, 0.0), (1, "i"): (1, 1.5), (1, "t"): (1, 1.0)})
#: State 1: the clause has an insult (a threat) already, and another weighs more.
INSULT = Transducer({(0, "i"): (1, 1.0), (1, "i"): (1, 1.1)})
THREAT = Transducer({(0, "t"): (1, 1.0), (1, "t"): (1, 1.1)})
SYMBOLS = "ityrno"


def compose(machines: tuple[Transducer, ...], starts: list[tuple[int, ...]]) -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float]]:
    """The machine that reads as all of ``machines`` do at once: its states are theirs side by side, as far as
    they can be reached from ``starts``, and an arc's factor is the product of theirs."""
    arcs, todo = {}, list(starts)
    while todo:
        states = todo.pop()
        for x in SYMBOLS:
            if (states, x) in arcs:
                continue
            steps = [m.step(s, x) for m, s in zip(machines, states, strict=True)]
            to = tuple(s for s, _ in steps)
            arcs[states, x] = to, math.prod(f for _, f in steps)
            todo.append(to)
    return arcs


CLAUSE = compose((NEGATION, REPORT, TARGET, INSULT, THREAT), [(0, r, t, 0, 0) for r in (0, 1) for t in (0, 1)])


def clause_factors(symbols: str, reported: bool) -> list[float]:
    """The factors that the composed machine gives the symbols of a clause."""
    state, out = (0, int(reported), int("y" in symbols), 0, 0), []
    for x in symbols:
        state, factor = CLAUSE[state, x]
        out.append(factor)
    return out


@dataclass
class Grammar:
    insults: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...] = ()
    memo: dict[str, tuple[str, float]] = field(default_factory=dict, compare=False, repr=False)

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= 200_000:
                self.memo.clear()
            found = self.memo[word] = self._symbol(word)
        return found

    def _symbol(self, word: str) -> tuple[str, float]:
        if word in self.insults:
            return "i", self.insults[word]
        for n in reversed(STEM_LENGTHS):
            if len(word) > n and word[:n] in self.stems:
                return "i", self.stems[word[:n]]
        for symbol, words, weight in (("t", THREATS, 2.0), ("y", TARGETS, 0.0), ("n", NEGATIONS, 0.0), ("r", REPORTS, 0.0)):
            if word in words:
                return symbol, weight
        return "o", 0.0

    def features(self, text: str) -> tuple[float, ...]:
        """1, and of the matched clauses: log of the sum of their scores, that sum for each word, the
        best score, and their share of all clauses."""
        tokens = _TOKEN.findall(text.lower())
        if not any(self.symbol(w)[0] in "it" for w in set(tokens)):
            return (1.0, 0.0, 0.0, 0.0, 0.0)
        scores, clauses, words, quoted = [], 0, 0, False
        symbols: list[str] = []
        weights: list[float] = []

        def close() -> None:
            nonlocal clauses
            if symbols:
                clauses += 1
                if any(weights):
                    score = sum(w * f for w, f in zip(weights, clause_factors("".join(symbols), quoted), strict=True))
                    if score > 0:
                        scores.append(score)
                symbols.clear()
                weights.clear()

        for token in tokens:
            if token in _ENDS:
                close()
                quoted = quoted and token != "\n"  # a mark without its partner reaches to the end of its line
            elif token in _QUOTES:
                close()
                quoted = not quoted
            else:
                s, w = self.symbol(token)
                symbols.append(s)
                weights.append(w)
                words += 1
        close()
        total = sum(scores)
        return (1.0, math.log1p(total), 10 * total / (words + 10), max(scores, default=0.0), len(scores) / (clauses + 1))


def _keys(text: str) -> set[tuple[str, bool]]:
    words = {w for w in _TOKEN.findall(text.lower()) if w[0].isalpha()}
    return {(w, True) for w in words} | {(w[:n], False) for w in words for n in STEM_LENGTHS if len(w) > n}


def learn_arcs(texts: list[str], y: np.ndarray) -> Grammar:
    """Insult arcs by log odds of the texts that hold a word or stem."""
    counts = (Counter(), Counter())
    for text, label in zip(texts, y, strict=True):
        counts[int(label)].update(_keys(text))
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    insults, stems = dict.fromkeys(INSULTS, 2.0), {}
    for (key, whole), c1 in counts[1].items():
        if c1 >= LEAST_TEXTS:
            c0 = counts[0][key, whole]
            odds = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))
            if odds - DEVIATIONS * math.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5)) >= LEAST_ODDS:
                (insults if whole else stems)[key] = min(odds, 6.0)
    return Grammar(insults, stems)


def train(sample: pd.DataFrame) -> Grammar:
    """Arcs from one half of the sample, the curve from the other. With one class only, or no rows,
    the curve falls back on the fixed words."""
    y, weight = sample["y"].to_numpy(float), sample["weight"].to_numpy(float)
    half = np.arange(len(sample)) % 2 == 0
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        return Grammar(dict.fromkeys(INSULTS, 2.0), {}, (-3.0, 2.0, 1.0, 0.0, 0.0))
    grammar = learn_arcs(list(sample["text"][half]), y[half])
    x = np.array([grammar.features(t) for t in sample["text"][~half]])
    grammar.weights = tuple(logistic_fit(x, y[~half], weight[~half]))
    grammar.memo.clear()
    return grammar


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    return train(labelled_sample(docs, labels, "toxic", ~held_out(F.col("doc_id"), FOLDS, HELD_OUT), FIT_ROWS))


def with_scores(docs: DataFrame, grammar: Grammar, column: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the probability that their whole text is toxic.

    Null text is the empty text, which has a score like any other. Rows that repeat are scored one by
    one, whatever their doc_id; a column that has the result's name is replaced. Empty tables stay empty.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.array(grammar.weights)
        for texts in batches:
            x = np.array([grammar.features(t) for t in texts]).reshape(-1, len(w))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return docs.withColumn(column, score(F.coalesce(F.col("text"), F.lit(""))))
