"""Operator 5: toxicity by a misspelling-tolerant lexicon and the context of each hit.

A trie of terms is intersected with the Levenshtein automata of words: one deterministic automaton over letters
whose states are sets of (trie node, edits so far), made as words need them. A word that is no term's misspelling
dies after a few letters. Terms are seeds and words that rated documents tie to toxicity; misspellings that are
ordinary words of clean rated documents do not count.

Each hit is scored by its window: inside quotation marks, paired over its line, or after a reporting word it is likely
quoted, beside a second-person word it is likely abuse. A logistic regression over the counts of both kinds, with prior
weights that hold where the ratings say nothing, gives the score. Fits use at most `max_labelled` rated documents
(documented bound, so their words are bounded too; every term that they show is taken); one half picks the terms while
the other half fits the weights. Scoring covers all texts in one pass.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import saved

#: Seed terms, reporting words and second-person words, quotation marks.
SEEDS = ["idiot", "moron", "scum", "trash", "stupid", "clown", "loser", "pathetic", "worthless", "disgusting"]
REPORTING = ["said", "says", "called", "wrote", "quote", "quoted", "term", "word", "slur", "insult", "quoting", "sagte", "nannte", "schrieb", "wort", "dit", "écrit", "mot", "dijo", "llamó", "escribió", "palabra"]
SECOND_PERSON = ["you", "your", "youre", "u", "du", "dein", "tu", "vous", "ton", "usted"]

MAX_LABELLED = 12_000
MEMORY = 200_000
WINDOW = 80  #: characters on each side of a hit
SEED_WEIGHT = 4.0
#: prior weights of: bias; unquoted exact hits: any, log count, greatest term weight; quoted: any; misspelled unquoted: any, log count; misspelled quoted: any; second person near an unquoted hit; log hits per 100 words
PRIOR = np.array([-3.0, 2.0, 0.7, 0.5, -0.5, 2.5, 0.7, -0.5, 0.7, 0.2])
_WORD = re.compile(r"\w+")
_REPORT = re.compile(r"\b(?:" + "|".join(REPORTING) + r")\b[^.!?\n]{0,40}$")
_PERSON = re.compile(r"\b(?:" + "|".join(SECOND_PERSON) + r")\b")
#: A quotation within a line, marks by pair; an apostrophe inside a word neither opens nor closes one.
QUOTATIONS = [
    r'"[^"\n]*"', "„[^„“”\n]*[“”]", "“[^“”\n]*”", "«[^«»\n]*»", "»[^«»\n]*«", "‹[^‹›\n]*›", "›[^‹›\n]*‹", "‚[^‚‘’\n]*[‘’]",
    r"‘(?:[^‘’\n]|(?<=\w)’(?=\w))*’", r"(?<!\w)'(?:[^'\n]|(?<=\w)'(?=\w))*'(?!\w)",
]
_QUOTED = re.compile("|".join(QUOTATIONS))


def edits_for(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class TermAutomaton:
    """Words within edits_for(term) edits of a term, read letter by letter."""

    def __init__(self, terms: dict[str, float]):
        self.terms = list(terms)
        self.child: list[dict[str, int]] = [{}]
        self.most = [0]  # edits that some term below allows
        self.term_at: dict[int, int] = {}
        for k, t in enumerate(self.terms):
            node, e = 0, edits_for(t)
            self.most[0] = max(self.most[0], e)
            for ch in t:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                node = self.child[node][ch]
                self.most[node] = max(self.most[node], e)
            self.term_at[node] = k
        self.reset()

    def reset(self) -> None:
        self.sets: list[tuple[tuple[int, int], ...]] = [()]
        self.number: dict[tuple, int] = {(): 0}
        self.step: dict[tuple[int, str], int] = {}
        self.final: dict[int, tuple[int, int] | None] = {}
        self.begin = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The state of nodes with their least edits, after leaving out letters of the term."""
        queue = sorted(least, key=least.get)
        for node in queue:
            for c in self.child[node].values():
                e = least[node] + 1
                if e <= self.most[c] and e < least.get(c, 9):
                    least[c] = e
                    queue.append(c)
        key = tuple(sorted(least.items()))
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
        return self.number[key]

    def _next(self, state: int, ch: str) -> int:
        least: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, c in self.child[node].items():
                to = e + (letter != ch)
                if to <= self.most[c] and to < least.get(c, 9):
                    least[c] = to
            if e + 1 <= self.most[node] and e + 1 < least.get(node, 9):
                least[node] = e + 1
        return self._state(least)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term number, edits) of the nearest term, the first of equals; None if there is none."""
        if len(self.step) > MEMORY:
            self.reset()
        state, step = self.begin, self.step
        for ch in word:
            to = step.get((state, ch))
            if to is None:
                to = step[state, ch] = self._next(state, ch)
            if not to:
                return None
            state = to
        if state not in self.final:
            ends = [(e, self.term_at[n]) for n, e in self.sets[state] if n in self.term_at and e <= edits_for(self.terms[self.term_at[n]])]
            self.final[state] = (min(ends)[1], min(ends)[0]) if ends else None
        return self.final[state]


@dataclass
class Model:
    terms: dict[str, float]
    innocent: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())


class Reader:
    """Finds hits in whole texts; remembers tokens up to a bound."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, TermAutomaton(model.terms)
        self.weight = list(model.terms.values())
        self.clean: set[str] = set()
        self.hit: dict[str, tuple[float, int]] = {}

    def of_token(self, token: str) -> bool:
        found = False
        for w in _WORD.findall(token):
            m = None if w in self.model.innocent else self.automaton.match(w)
            if m is not None:
                self.hit[w] = self.weight[m[0]], m[1]
                found = True
        return found

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(len(PRIOR))
        x[0] = 1
        low = text.lower()
        tokens = low.split()
        new = set(tokens) - self.clean
        if not new:
            return x
        bad = {t for t in new if self.of_token(t)}
        if len(self.clean) > MEMORY:
            self.clean.clear()
            self.hit = {}
            for t in bad:
                self.of_token(t)
        self.clean |= {t for t in new if t not in bad and len(t) < 40}
        if not bad:
            return x
        spans = [m.span() for m in _QUOTED.finditer(low)]
        opened = [a for a, _ in spans]
        exact = quoted = wrong = wrong_quoted = 0
        best, person = 0.0, False
        for m in _WORD.finditer(low):
            h = self.hit.get(m[0])
            if h is None:
                continue
            line = low.rfind("\n", 0, m.start()) + 1
            before, after = low[max(line, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
            k = bisect_right(opened, m.start()) - 1
            q = k >= 0 and m.end() < spans[k][1] or _REPORT.search(before) is not None
            if h[1]:
                wrong, wrong_quoted = wrong + (not q), wrong_quoted + q
            else:
                exact, quoted = exact + (not q), quoted + q
                best = best if q else max(best, h[0])
            person |= not q and (_PERSON.search(before) is not None or _PERSON.search(after) is not None)
        x[1:] = [exact > 0, math.log1p(exact), best, quoted > 0, wrong > 0, math.log1p(wrong), wrong_quoted > 0, person, math.log1p(100 * (exact + wrong) / max(1, len(tokens)))]
        return x


def _rated_words(train: DataFrame) -> DataFrame:
    """(word, pos, neg): in how many toxic and clean rated texts a word is."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return train.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))


def learn_terms(train: DataFrame, seeds: list[str], support: int = 4, odds: float = 25.0) -> tuple[dict[str, float], frozenset[str]]:
    """Terms with their log odds, and ordinary words that a term's misspellings must not be, from train(text, toxic)."""
    n = train.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    terms = dict.fromkeys(seeds, SEED_WEIGHT)
    if not n["p"] or not n["n"]:
        return terms, frozenset()
    words = saved(_rated_words(train).where(f"pos >= {support} or neg >= 2"))
    ratio = (F.col("pos") + 0.5) / (n["p"] + 1) / ((F.col("neg") + 0.5) / (n["n"] + 1))
    learned = words.where(F.col("pos") >= support).where(ratio >= odds).where(F.length("word") >= 3).select("word", ratio.alias("r"))
    for r in sorted(learned.collect(), key=lambda r: (-r["r"], r["word"])):  # some of the words of max_labelled texts
        terms[r["word"]] = max(terms.get(r["word"], 0), min(6.0, math.log(r["r"])))
    automaton = TermAutomaton(terms)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[(m := automaton.match(w)) is not None and m[1] > 0 for w in pdf["word"]]]

    common = words.where(F.col("neg") >= 2).where(ratio < 5).select("word").mapInPandas(near, "word string")
    return terms, frozenset(r["word"] for r in common.collect())


def _feature_rows(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [reader.features(t or "").tolist() for t in pdf["text"]]})

    rows = sorted(train.mapInPandas(run, "toxic int, x array<double>").collect())  # bounded by max_labelled
    return np.array([r["x"] for r in rows]).reshape(len(rows), len(PRIOR)), np.array([r["toxic"] for r in rows], float)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, held to the prior weights by a ridge."""
    w = PRIOR.copy()
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - PRIOR)
        move = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w)), grad)
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seeds: list[str] = SEEDS, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from labels(id, 0/1). Null ids and labels are left out; an id rated twice counts as toxic if one rating
    says so; equal texts count once. With no usable label the seeds and prior weights stand."""
    rated = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    few = F.broadcast(rated.orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(few, "id")
    train = saved(texts.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")))
    terms, innocent = learn_terms(train.where("half = 0"), seeds)
    x, y = _feature_rows(train.where("half = 1").select("toxic", "text"), Model(terms, innocent))
    weights = fit_weights(x, y)
    terms, innocent = learn_terms(train, seeds)
    return Model(terms, innocent, weights)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: score in 0..1 by the whole text; a null or empty text scores as one without hits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for pdf in batches:
            x = np.array([reader.features(t or "") for t in pdf["text"]]).reshape(len(pdf), len(PRIOR))
            yield pd.DataFrame({"id": pdf["id"], "score": 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
