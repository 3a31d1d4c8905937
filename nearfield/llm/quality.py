"""Quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_sample, cut, fold

FOLDS, HELD_OUT = 3, 1
#: Labelled rows of each class that the model is fitted on, at most about.
PER_CLASS = 6000
BINS, PAIR_BINS, PAIRS = 32, 8, 10

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "repeats", "distinct_pairs", "upper", "digits", "signs",
    "sign_ends", "bars", "exclaims", "log_lines", "line_words", "repeated_lines", "short_words", "sentence_ends", "spaces",
)
SIGNS = re.compile(r"[^\w\s.,;:'\"()-]")
SIGN_END = re.compile(r"[^\w\s.,;:'\"()-]{2,}(?=\s|$)")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")


def windows(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about size characters, cut behind white space where there is some."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = space + 1 if space > at else end
        yield text[at:end]
        at = end


def features(text: str) -> list[float]:
    """What the model sees of a whole text; shares but for three logarithms. Counts run over parts,
    so that beside the text only its different words, pairs of words and lines take memory."""
    words, pairs, lines = Counter(), Counter(), Counter()
    n_words = letters = longest = repeats = short = ends = upper = digits = signs = sign_ends = spaces = 0
    last = None
    for part in windows(text):
        tokens = part.split()
        words.update(tokens)
        before = [last, *tokens][: len(tokens)]
        pairs.update(map(hash, zip(before, tokens, strict=True)))
        repeats += sum(a == b for a, b in zip(before, tokens, strict=True))
        last = tokens[-1] if tokens else last
        n_words += len(tokens)
        sizes = list(map(len, tokens))
        letters += sum(sizes)
        longest = max(longest, max(sizes, default=0))
        short += sum(s <= 3 for s in sizes)
        ends += part.count(". ") + part.count(".\n")
        upper += len(UPPER.findall(part))
        digits += len(DIGIT.findall(part))
        signs += len(SIGNS.findall(part))
        sign_ends += len(SIGN_END.findall(part))
        spaces += len(part) - sum(sizes)
    lines.update(map(hash, filter(None, text.split("\n"))))
    n_lines, w, c = sum(lines.values()), max(n_words, 1), max(len(text), 1)
    return [
        math.log1p(len(text)), math.log1p(n_words), letters / w, math.log1p(longest), len(words) / w, max(words.values(), default=0) / w, repeats / w, len(pairs) / w,
        upper / c, digits / c, signs / c, sign_ends / w, text.count("|") / w, text.count("!") / w, math.log1p(n_lines), math.log1p(n_words / max(n_lines, 1)),
        1 - len(lines) / max(n_lines, 1), short / w, ends / w, spaces / c,
    ]


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="inverted_cdf"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins, from their sums of gradients and of curvatures: values by
    bin. The best cut of any leaf is made until there are enough leaves."""
    parts = [(0, len(g))]
    score = lambda a, b: a * a / (b + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The gain and values of the best tree that cuts both axes of a table of bins once."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gain, values = 0.0, []
    for q in range(4):
        def corner(t: np.ndarray) -> np.ndarray:
            low, row, col, every = t[:-1, :-1], t[:-1, -1:], t[-1:, :-1], t[-1, -1]
            return (low, row - low, col - low, every - row - col + low)[q]

        a, b = corner(G), corner(H) + ridge
        gain = gain + a * a / b
        values.append(a / b)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = (v[i, j] for v in values)
    return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + ridge)), out


@dataclass
class AdditiveModel:
    """An intercept, a lookup table for each feature, and one for each pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k])]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k]) for p in self.pairs for k in p[:2]}
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.1, leaves: int = 3, ridge: float = 2.0) -> AdditiveModel:
        """Cyclic boosting: in each round every feature in turn gets one shallow tree, slowed down by
        rate. Then the pairs whose best tree gains most on what is left are boosted alike."""
        edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
        bins = [np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)]
        tables = [np.zeros(len(e) + 1) for e in edges]
        base = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
        model = cls(math.log(base / (1 - base)), edges, tables, [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])], [])
        total = np.full(len(y), model.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            return weight * (y - p), weight * p * (1 - p)

        for _ in range(rounds):
            for k, at in enumerate(bins):
                g, h = slopes()
                size = len(tables[k])
                step = rate * _tree(np.bincount(at, g, size), np.bincount(at, h, size), leaves, ridge)
                tables[k] += step
                total += step[at]
        coarse = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.pair_edges)]
        g, h = slopes()

        def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
            shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
            return np.bincount(coarse[i] * shape[1] + coarse[j], v, shape[0] * shape[1]).reshape(shape)

        gains = sorted(((_cross(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
        model.pairs = [(i, j, np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1))) for gain, i, j in gains[:PAIRS] if gain > 0]
        for _ in range(pair_rounds):
            for i, j, table in model.pairs:
                g, h = slopes()
                step = rate * _cross(grid(i, j, g), grid(i, j, h), ridge)[1]
                table += step
                total += step[coarse[i], coarse[j]]
        return model


def _feature_rows(texts: pd.Series) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


def learn_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 42) -> AdditiveModel | None:
    """A model from labels(doc_id, quality) whose fold is not held out. At most about per_class rows
    of each class, a documented bound, are drawn; their features are what reaches the driver.
    Rows count by their class's true share. None without rows of both classes."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = cut(known)
    shares = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    sample = docs.select("doc_id", "text").join(F.broadcast(bounded_sample(known, "quality", per_class, seed)), "doc_id").select("text", "quality")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(_feature_rows(batch["text"]), columns=list(FEATURES)).assign(y=batch["quality"].to_numpy())

    table = sample.mapInPandas(rows, ", ".join(f"{n} double" for n in FEATURES) + ", y int").toPandas()
    y = table["y"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    table = table.sort_values([*FEATURES, "y"])  # sums then don't depend on the order of arrival
    y = table["y"].to_numpy(float)
    weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (len(y) - y.sum())) * len(y) / (shares[0] + shares[1])
    return AdditiveModel.fit(table[list(FEATURES)].to_numpy(), y, weight)


def score_quality(docs: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score, predicted: one row per row, by bin additions over a
    batch at a time.

    A null text counts as empty and is scored as such. Without a model (no labels) every score is
    0.5. Ties and repeated rows are scored alike. Other columns are ignored; an empty
    table gives no rows.
    """

    @F.pandas_udf("score double, predicted int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            value = model.score(_feature_rows(texts)) if model else np.full(len(texts), 0.5)
            yield pd.DataFrame({"score": value, "predicted": (value >= 0.5).astype(np.int32)})

    return docs.select("doc_id", score("text").alias("found")).select("doc_id", "found.*")


def keep_good(docs: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject. Texts stay in place: the
    decision is a column beside them."""

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(_feature_rows(texts)) >= 0.5) if model else pd.Series(np.ones(len(texts), bool))

    return docs.where(good("text"))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, by a model fitted to the labels that
    are not held out. See score_quality for odd rows."""
    scored = score_quality(docs, learn_quality(docs, labels, per_class))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
