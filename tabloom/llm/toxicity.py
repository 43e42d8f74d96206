"""Abusive, hateful and sexual content: maximum-scoring passages of token log-odds.

A token's score for a category is the log-odds of the category's passages
against all other text, under a Dirichlet prior that has the shape of the whole
corpus. The scores of a document are scanned once (all maximal scoring segments,
linear time), so every significant passage comes out with its place, however
long the text around it. Significance is calibrated as an extreme value: with
lambda the positive root of ``sum p(token) exp(lambda score) = 1`` over the
corpus, a passage of score S in n tokens has the expectation K n exp(-lambda S).

Passages aren't marked in the labels, documents are: fitting starts from whole
labelled documents, finds their passages, counts tokens inside and outside of
them, and repeats. It uses at most ``MOST_LABELLED`` labelled documents (by the
hash of their id); token counts and calibration cover all documents.

Defined results: null, blank and wordless texts score 0 in every category; a
document may have several categories; disguised letters, stars, stretched and
spaced words are read as the words they stand for; without labels nothing is found.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import map_batches

CATEGORIES = ("abusive", "hateful", "sexual")
#: Bound of the sample of labelled documents that the scores are fitted on.
MOST_LABELLED = 50_000
#: Bound of that sample in characters.
MOST_CHARS = 100_000_000
#: Weight of the prior, in tokens; rounds of passage finding; expected false passages in a document.
#: Pairs overlap their words, so that an expectation is some orders too small; the bound allows for it.
PRIOR, ROUNDS, EXPECTED = 40.0, 4, 1e-4
#: A word is scored from so many labelled documents on; what every token costs; score that a passage needs in fitting.
LEAST_DOCUMENTS, DRIFT, SURE = 2, 0.7, 5.0
#: Expectation up to which a passage is significant by itself.
PASSAGE = 0.01
#: A token without evidence costs a passage so much.
UNSEEN = -1.0
#: Scores stay within these.
LEAST, MOST = -4.0, 4.0

_LEET = str.maketrans("@4031$!5", "aaoeisis")
_LEET_UK = str.maketrans("@403615!", "ааозбіѕі")
_TOKEN = re.compile(r"[^\W_][\w@$!*]*[\w@$*]|[^\W_]|[@$*][\w@$*]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_·]){3,}[^\W\d_](?![^\W_])")
_MARKS = re.compile(r"[​-‏⁠﻿­�]")
_LONG = re.compile(r"([^\W\d_])\1{2,}")


@functools.lru_cache(maxsize=200_000)
def _plain(word: str) -> str:
    """A word without stretched letters and with letters for the digits and signs that stand for some."""
    if word.isalpha():
        return _LONG.sub(r"\1", word)
    if word.isdigit():
        return "#"
    if "*" in word:
        return word
    letters = sum(map(str.isalpha, word))
    others = len(word) - letters
    if letters >= 2 and letters >= others or any(ch in "@$" for ch in word) and letters:
        cyrillic = any("Ѐ" <= ch <= "ӿ" for ch in word)
        got = word.translate(_LEET_UK if cyrillic else _LEET).strip("!")
        if got.isalpha():
            return _LONG.sub(r"\1", got)
    return "#" if any(map(str.isdigit, word)) else word.strip("!@$")


def tokens_of(text: str | None) -> list[str]:
    """The words of a text in one spelling; numbers are one token."""
    text = _MARKS.sub("", unicodedata.normalize("NFKC", text or "")).lower()
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m[0]), text)
    return [w for w in map(_plain, _TOKEN.findall(text)) if w]


#: Numbers of what a lexis doesn't know: a word, a pair.
NO_WORD, NO_PAIR = 0, 1


class Lexis:
    """Numbers of words and of pairs of neighbours."""

    def __init__(self, names: Iterable[str]):
        self.names = ["", " ", *names]
        self.words: dict[str, int] = {}
        self.pairs: dict[str, dict[str, int]] = {}
        for k, name in enumerate(self.names[2:], 2):
            first, _, second = name.partition(" ")
            if second:
                self.pairs.setdefault(first, {})[second] = k
            else:
                self.words[name] = k
        self.is_pair = np.array([" " in name for name in self.names])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers with every pair's between its two words."""
        out = np.full(max(0, 2 * len(words) - 1), NO_PAIR, dtype=np.int64)
        get, last = self.words.get, None
        out[::2] = [get(w, NO_WORD) for w in words]
        for k, w in enumerate(words):
            if last is not None:
                second = last.get(w)
                if second is not None:
                    out[2 * k - 1] = second
            last = self.pairs.get(w)
        return out


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of positive score, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.flatnonzero(scores > 0)
    for i, before, total in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        now = (i, i + 1, before, total)
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                break
            now = (found[j][0], now[1], found[j][2], now[3])
            del found[j:]
        found.append(now)
    return [(a, b, r - l) for a, b, l, r in found]


def significance(passing: Iterable[float]) -> tuple[float, int]:
    """(-log10 of the chance of the passages together, how many they are) from the normalised scores of different passages.

    Passages that are significant by themselves (an expectation of at most ``PASSAGE``) are added up: the sum of the r best
    is as large as s with a chance of about exp(-s) s^(r-1) / (r! (r-1)!), the sum statistic of maximal segments; every
    further passage pays a factor of two for being looked at, so that r = 1 is the single passage's own expectation.
    """
    ranked = sorted(passing, reverse=True)
    best, number, total = (max(0.0, ranked[0]), 1, 0.0) if ranked else (0.0, 0, 0.0)
    for r, x in enumerate(ranked, 1):
        if x < -math.log(PASSAGE):
            break
        total += x
        value = total - (r - 1) * (math.log(total) + math.log(2.0)) + math.lgamma(r + 1) + math.lgamma(r)
        if value > best:
            best, number = value, r
    return best / math.log(10.0), number if best > 0 else 0


@dataclass
class Model:
    """A lexis; scores by category as arrays over it; the calibration of each."""

    lexis: Lexis
    scores: dict[str, np.ndarray] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    factor: dict[str, float] = field(default_factory=dict)
    starred: dict[int, list[str]] = field(default_factory=dict)

    def resolve(self, words: list[str]) -> list[str]:
        """Starred words as the known word of a category that they can be."""
        if not any("*" in w for w in words):
            return words
        out = []
        for w in words:
            if "*" in w and any(map(str.isalpha, w)):
                fits = [x for x in self.starred.get(len(w), ()) if all(a in ("*", b) for a, b in zip(w, x, strict=True))]
                w = fits[0] if fits else w
            out.append(w)
        return out

    def normal(self, score: float, n: int, category: str) -> float:
        """A passage's score in units of lambda above what the best one of n tokens is expected to have."""
        return self.scale[category] * score - math.log(self.factor[category] * max(n, 1))

    def judge(self, text: str | None) -> dict[str, tuple[float, int, int, int]]:
        """Per category: -log10 of the chance of its passages, the best one (in words), how many make the score."""
        numbers = self.lexis.numbers(self.resolve(tokens_of(text)))
        out = {}
        for c, known in self.scores.items():
            found = passages(known[numbers]) if len(numbers) else []
            different = {numbers[a:b].tobytes(): s for a, b, s in found}  # a passage that is repeated counts once
            best, many = significance([self.normal(s, len(numbers), c) for s in different.values()])
            a, b, _ = max(found, key=lambda x: x[2], default=(0, 0, 0.0)) if many else (0, 0, 0.0)
            out[c] = (best, a // 2, (b + 1) // 2, many)
        return out


def _default(lexis: Lexis) -> np.ndarray:
    return np.where(lexis.is_pair, 0.0, UNSEEN)


def log_odds(inside: np.ndarray, others: list[np.ndarray], corpus: np.ndarray, seen_in: np.ndarray, lexis: Lexis, prior: float = PRIOR) -> np.ndarray:
    """Scores of the tokens of a category's passages against whichever other text makes them likeliest.

    Rates are smoothed with the corpus as Dirichlet prior. A word of fewer than
    ``LEAST_DOCUMENTS`` labelled documents has no score of its own.
    """
    a = prior * (corpus + 0.5) / max(corpus.sum(), 1)
    rates = [(c + a) / (c.sum() + prior) for c in (inside, *others)]
    got = np.clip(np.log(rates[0] / np.max(rates[1:], axis=0)) - DRIFT, LEAST, MOST)
    seen = (sum((inside, *others)) > 0) & (seen_in >= LEAST_DOCUMENTS)
    seen[:2] = False
    return np.where(seen, got, _default(lexis))


def _root(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1 over scores and their weights."""
    if not weights.sum() or scores.max(initial=0.0) <= 0:
        return 1.0
    p = weights / weights.sum()
    excess = lambda x: float((p * np.exp(np.minimum(x * scores, 600))).sum()) - 1
    lo, hi = 1e-6, 0.1
    while excess(hi) < 0 and hi < 20:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def lexis_of(labelled: Iterable[list[str]]) -> Lexis:
    """Words and pairs of at least ``LEAST_DOCUMENTS`` labelled documents; no others can have a score."""
    seen: Counter = Counter()
    for words in labelled:
        seen.update({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})
    return Lexis(sorted(w for w, n in seen.items() if n >= LEAST_DOCUMENTS))


def fit(labelled: list[tuple[list[str], frozenset[str]]], lexis: Lexis, corpus: np.ndarray, categories: tuple[str, ...] = CATEGORIES, rounds: int = ROUNDS) -> Model:
    """A model of labelled documents (their words and categories) and the corpus's token counts."""
    model, size = Model(lexis), len(lexis.names)
    count = lambda docs: np.bincount(np.concatenate(docs), minlength=size) if docs else np.zeros(size, dtype=np.int64)
    docs = [(lexis.numbers(w), k) for w, k in labelled]
    clean = [d for d, k in docs if not k & set(categories)]
    own = {c: [d for d, k in docs if k & set(categories) == {c}] for c in categories}
    seen_in, rest = count([np.unique(d) for d, _ in docs]), count([np.unique(d) for d in clean])
    for c in categories:
        # To begin with: in which share of the category's documents, and of clean ones, a word occurs.
        inside = count([np.unique(d) for d in own[c]])
        p, q = (inside - 1) / (len(own[c]) + 1), (rest + 1) / (len(clean) + 2)
        enough = inside >= LEAST_DOCUMENTS
        enough[:2] = False
        start = np.clip(np.log(np.maximum(p, 1e-12) / q), LEAST, MOST) - DRIFT
        model.scale[c], model.factor[c], model.scores[c] = 1.0, 0.1, np.where(enough, start, _default(lexis))
    ceiling = dict(model.scores)
    for _ in range(rounds):
        within, outside = {}, [*clean]
        for c in categories:
            parts = []
            for d in own[c]:
                best = max(passages(model.scores[c][d]), key=lambda x: x[2], default=(0, 0, 0.0))
                a, b = (best[0], best[1]) if best[2] > SURE else (0, 0)
                parts.append(d[a:b])
                outside += [d[:a], d[b:]]
            within[c] = count(parts)
        others = count(outside)
        for c in categories:
            against = [others] + [within[x] for x in categories if x != c and within[x].any()]
            # What whole documents don't bear out, a passage can't: ordinary sentences beside a passage stay out.
            model.scores[c] = np.minimum(log_odds(within[c], against, corpus, seen_in, lexis), ceiling[c]) if within[c].any() else _default(lexis)
    strongest = np.max([model.scores[c] for c in categories], axis=0)
    for k in sorted(np.flatnonzero(strongest > 1).tolist(), key=lambda k: (-strongest[k], lexis.names[k])):
        if lexis.names[k].isalpha() and len(lexis.names[k]) >= 3:
            model.starred.setdefault(len(lexis.names[k]), []).append(lexis.names[k])
    for c in categories:
        if (model.scores[c] > 0).any():
            _calibrate(model, c, corpus, clean)
    return model


def _calibrate(model: Model, c: str, corpus: np.ndarray, clean: list[np.ndarray]) -> None:
    """lambda from the corpus's token distribution, K from the best passages of documents without the category."""
    scale = _root(model.scores[c], corpus)
    best = [max((x[2] for x in passages(model.scores[c][d])), default=0.0) - math.log(len(d)) / scale for d in clean if len(d)]
    # The median of a Gumbel variable is its location + 0.3665 / lambda; unlike the mean, labels that are mistakes don't move it.
    location = (float(np.median(best)) if best else 0.0) - 0.3665 / scale
    model.scale[c], model.factor[c] = scale, math.exp(scale * location)


def corpus_counts(documents: DataFrame, text: str, lexis: Lexis) -> np.ndarray:
    """How often each number of the lexis occurs in all documents. One shuffle of partial sums; as many rows as the lexis has."""
    shared = documents.sparkSession.sparkContext.broadcast(lexis)  # of the bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value, None
        for pdf in batches:
            counts = np.zeros(len(known.names), dtype=np.int64) if counts is None else counts
            for t in pdf["text"]:
                counts += np.bincount(known.numbers(tokens_of(t)), minlength=len(counts)) if t else 0
        if counts is not None:
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"number": at, "n": counts[at]})

    parts = map_batches(documents.select(F.col(text).alias("text")), run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    out = np.zeros(len(lexis.names), dtype=np.int64)
    for r in parts.collect():
        out[r["number"]] = r["n"]
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, row_id: str, text: str, most: int = MOST_LABELLED, most_chars: int = MOST_CHARS) -> list[tuple[list[str], frozenset[str]]]:
    """Words and categories of the labelled documents first in the order of their ids' hashes, within both bounds.

    Texts are read into words by the workers; only ids and lengths decide which reach the driver.
    """
    by_doc = labels.groupBy(row_id).agg(F.collect_set("category").alias("categories"))
    joined = documents.select(row_id, text).join(by_doc, row_id).where(F.col(text).isNotNull()).withColumn("__hash", F.xxhash64(row_id))
    sizes = joined.select("__hash", F.length(text).alias("n")).orderBy("__hash").limit(most).collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > most_chars:
            break
        last = r["__hash"]
    if last is None:
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"words": [" ".join(tokens_of(t)) for t in pdf["text"]], "categories": pdf["categories"]})

    chosen = joined.where(F.col("__hash") <= last).select(F.col(text).alias("text"), "categories")
    return [(r["words"].split(), frozenset(r["categories"])) for r in map_batches(chosen, run, "words string, categories array<string>").collect()]


def fit_corpus(documents: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> Model:
    """A model of a corpus and its labelled documents."""
    labelled = labelled_sample(documents, labels, row_id, text, most)
    lexis = lexis_of(w for w, _ in labelled)
    return fit(labelled, lexis, corpus_counts(documents, text, lexis))


def score_documents(documents: DataFrame, model: Model, keep: list[str], text: str = "text", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``keep`` and for each category its score, best passage and flag; a narrow map over whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    columns = ", ".join(f"{c} boolean, {c}_score double, {c}_start int, {c}_end int" for c in categories)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema) + ", " + columns
    least = -math.log10(EXPECTED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            got = [m.judge(t) for t in pdf["__text"]]
            out = pdf[keep].copy()
            for c in categories:
                out[c] = [g[c][0] >= least for g in got]
                out[f"{c}_score"] = [g[c][0] for g in got]
                out[f"{c}_start"] = pd.Series([g[c][1] for g in got], dtype="int32", index=out.index)
                out[f"{c}_end"] = pd.Series([g[c][2] for g in got], dtype="int32", index=out.index)
            yield out

    return map_batches(documents.select(*keep, F.col(text).alias("__text")), run, schema)


def rates(scored: DataFrame, source: str = "source", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Per source: documents, and the share of each category."""
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in categories])
