"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_sample, cut, fold

FOLDS = 5
#: Labelled rows of each class that the lexicon is learned from, at most about.
PER_CLASS = 4000
STEMS = (4, 5, 6, 7, 8)

# Words that start with a weight of their own, and phrases in which a term is harmless.
SEED_TERMS = ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "scum", "scumbag", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "clown", "retard", "bastard", "bitch", "asshole", "fuck", "fucking", "shit", "whore", "slut", "cunt", "dickhead", "kys")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash collection", "pond scum", "clown fish", "clown car", "circus clown", "stupid mistake")
SEED_WEIGHT = 3.0

# Letters of other scripts that look like Latin ones, in the same order.
CYRILLIC, CYRILLIC_AS = "аеорсухіјѕһԁԛԝкмтнв", "aeopcyxijshdqwkmthb"
GREEK, GREEK_AS = "αεικνορτυχ", "aeikvoptux"
LATIN, LATIN_AS = "ıɑɡſɩ", "iagsi"
# Digits and signs that stand for letters. What looks like i or l becomes i, in the lexicon too.
DIGITS, DIGITS_AS = "01345789", "oieastbg"
SIGNS, SIGNS_AS = "@$!|+", "asiit"

HOMOGLYPHS = str.maketrans(CYRILLIC + GREEK + LATIN, CYRILLIC_AS + GREEK_AS + LATIN_AS)
HIDDEN = re.compile("[­​-‏⁠﻿]")
LEET = str.maketrans(DIGITS + SIGNS, DIGITS_AS + SIGNS_AS)
#: Digits beside a letter, and signs before a letter or digit.
LEET_RUN = re.compile(r"[0-9]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9]+|[@$!|+]+(?=[^\W_])")
WORD = re.compile(r"[^\W\d_]+")


def skeleton(text: str) -> str:
    """Lower case, compatibility forms and look-alikes folded, digits and signs inside words read
    as letters, and l as i. Accented Latin letters stay what they are."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text)).lower().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    text = LEET_RUN.sub(lambda m: m[0].translate(LEET), text)
    return text.replace("l", "i")


@dataclass
class Lexicon:
    """Terms (skeletons; a trailing * marks a stem) with weights, phrases that excuse, and the
    three coefficients that turn a text's hits into a score."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    coefficients: tuple[float, float, float] = (-4.0, 2.0, 2.0)

    def automaton(self):  # noqa: ANN201
        import ahocorasick

        found = ahocorasick.Automaton()
        entries: dict[str, list[tuple[str, bool, bool, float]]] = {}
        for term, weight in self.weights.items():
            plain = term.rstrip("*")
            entries.setdefault(plain, []).append((term, term[-1] != "*", False, weight))
        for phrase in self.exceptions:
            entries.setdefault(phrase, []).append((phrase, True, True, 0.0))
        for plain, kinds in entries.items():
            found.add_word(plain, (len(plain), kinds))
        found.make_automaton()
        return found


def matches(folded: str, automaton) -> list[tuple[int, int, str, float]]:  # noqa: ANN001
    """(start, end, term, weight) in a skeleton, without hits that lie in an exception phrase. A term
    starts at a word's start; all but stems end at a word's end."""
    hits, excused = [], []
    if not len(automaton):
        return []
    for last, (length, kinds) in automaton.iter(folded):
        start, end = last - length + 1, last + 1
        if start and folded[start - 1].isalpha():
            continue
        closed = end == len(folded) or not folded[end].isalpha()
        for term, whole, excuse, weight in kinds:
            if closed or not whole:
                (excused if excuse else hits).append((start, end, term, weight))
    if excused:
        hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _, _ in excused)]
    by_start: dict[int, tuple[int, int, str, float]] = {}
    for h in hits:  # of several terms at one place the heaviest counts
        if h[0] not in by_start or by_start[h[0]][3] < h[3]:
            by_start[h[0]] = h
    return list(by_start.values())


def hit_features(folded: str, automaton) -> tuple[int, float, float]:  # noqa: ANN001
    """How many hits, the logarithm of their weight, and of their weight per 100 words."""
    found = matches(folded, automaton)
    total = sum(h[3] for h in found)
    words = folded.count(" ") + folded.count("\n") + 1
    return len(found), math.log1p(total), math.log1p(100 * total / (words + 20))


def _word_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                words = set(WORD.findall(skeleton(text or "")))
                stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                (toxic if label else clean).update(words | stems)
        if names := list(toxic):  # what no toxic text has cannot become a term
            yield pd.DataFrame({"term": names, "t": [toxic[w] for w in names], "c": [clean[w] for w in names]})
        if names := [w for w in clean if w not in toxic]:
            yield pd.DataFrame({"term": names, "t": 0, "c": [clean[w] for w in names]})

    return sample.mapInPandas(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _contexts(sample: DataFrame, terms: set[str]) -> DataFrame:
    """term, phrase (with the next word), previous word, and in how many texts of either kind."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                words = WORD.findall(skeleton(text or ""))
                seen = set()
                for k, w in enumerate(words):
                    for term in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
                        if term in terms:
                            seen.add((term, words[k - 1] if k else "", " ".join(words[k : k + 2])))
                (toxic if label else clean).update(seen)
        if names := list({**toxic, **clean}):
            yield pd.DataFrame([(*x, toxic[x], clean[x]) for x in names], columns=["term", "previous", "phrase", "t", "c"])

    schema = "term string, previous string, phrase string, t long, c long"
    return sample.mapInPandas(count, schema).groupBy("term", "previous", "phrase").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum())))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        beta += (step := np.linalg.solve(hessian, gradient))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def learn_lexicon(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 42, least_weight: float = 2.5, least_evidence: float = 30.0, most_terms: int = 5000) -> Lexicon:
    """From labels(doc_id, toxic) whose fold is not held out, and their texts. At most about per_class
    rows of each class are used, and at most most_terms terms are kept, so that what reaches the driver
    is bounded. A term must be more frequent in toxic texts than chance allows and must stand in
    several different contexts there, lest one copied text make its words terms."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = bounded_sample(cut(known), "toxic", per_class, seed)
    texts = cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"))  # bounded by per_class
    sizes = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    weights = {skeleton(w): SEED_WEIGHT for w in SEED_TERMS}
    exceptions = {skeleton(p) for p in EXCEPTIONS}
    if not nt or not nc:
        return Lexicon(weights, exceptions)
    least = max(3, round(0.004 * nt))
    odds = F.log((F.col("t") + 0.5) / (nt + 1.0)) - F.log((F.col("c") + 0.5) / (nc + 1.0))
    part = F.col("t") + F.col("c")
    expected_t, expected_c = part * nt / (nt + nc), part * nc / (nt + nc)
    # twice the log-likelihood ratio of label and term being related: by chance one word in 20 million passes 30
    evidence = 2 * (F.col("t") * F.log(F.col("t") / expected_t) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / expected_c)).otherwise(0.0))
    rows = _word_counts(texts).where(F.col("t") >= least).withColumn("weight", odds).where((F.col("weight") >= least_weight) & (evidence >= least_evidence))
    rows = rows.orderBy(F.desc("t"), "term").limit(most_terms).collect()
    candidates = {r["term"]: (r["weight"], r["t"]) for r in rows}
    seen = cut(_contexts(texts, set(candidates)))
    varied = seen.where("t > 0").groupBy("term").agg(F.countDistinct("previous").alias("p"), F.countDistinct("phrase").alias("n"))
    varied = {r["term"] for r in varied.collect() if min(r["p"], r["n"]) >= max(least, candidates[r["term"]][1] / 2)}
    harmless = seen.groupBy("phrase").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t = 0 AND c >= 5 AND phrase LIKE '% %'")
    exceptions |= {r["phrase"] for r in harmless.orderBy(F.desc("c"), "phrase").limit(most_terms).collect()}
    count_of = {term: candidates[term][1] for term in varied}
    # a stem gives way to the word or longer stem that makes up nearly all of it; else it stands for all of those
    stems = {s for s in varied if s[-1] == "*" and not any(x != s and x.startswith(s[:-1]) and count_of[x] >= 0.9 * count_of[s] for x in varied)}
    words = {w for w in varied - stems if w[-1] != "*" and not any(w[:n] + "*" in stems for n in STEMS)}
    stems = {s for s in stems if not any(s[:n] + "*" in stems for n in STEMS if n < len(s) - 1)}
    kept = {term: min(candidates[term][0], 6.0) for term in stems | words}
    lexicon = Lexicon(weights | kept, exceptions)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [hit_features(skeleton(t or ""), automaton)[1:] for t in batch["text"]]
            yield pd.DataFrame(found, columns=["x1", "x2"]).assign(y=batch["toxic"].to_numpy())

    table = texts.mapInPandas(features, "x1 double, x2 double, y int").toPandas()  # three numbers for each sampled row
    beta = _logistic(table[["x1", "x2"]].to_numpy(), table["y"].to_numpy(float))
    lexicon.coefficients = tuple(float(b) for b in beta)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, spans: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score, predicted, hits [, terms, starts]: one row per row.

    Whole texts are folded and scanned once. A null or empty text has no hits and the score of a text
    without any. Ties and repeated rows are scored alike. Other columns are ignored; an
    empty table gives no rows. With spans, terms and starts (offsets in the folded text) follow.
    """

    @F.pandas_udf("score double, predicted int, hits int" + ", terms array<string>, starts array<bigint>" * spans)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        b0, b1, b2 = lexicon.coefficients
        for texts in batches:
            folded = [skeleton(t or "") for t in texts]
            found = np.array([hit_features(t, automaton) for t in folded], float).reshape(-1, 3)
            value = 1 / (1 + np.exp(-np.clip(b0 + found[:, 1] * b1 + found[:, 2] * b2, -30, 30)))
            out = pd.DataFrame({"score": value, "predicted": (value >= 0.5).astype(np.int32), "hits": found[:, 0].astype(np.int32)})
            if spans:
                where = [sorted(matches(t, automaton)) for t in folded]
                out["terms"], out["starts"] = [[h[2] for h in w] for w in where], [[h[0] for h in w] for w in where]
            yield out

    return docs.select("doc_id", score("text").alias("found")).select("doc_id", "found.*")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, hits for every row of docs, by a lexicon learned from the
    labels that are not held out. Without such labels the seed lexicon and its fixed
    coefficients serve. See score_toxicity for odd rows."""
    scored = score_toxicity(docs, learn_lexicon(docs, labels, per_class))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted", "hits")
