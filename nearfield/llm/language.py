"""Language identification by n-gram filters with one bit for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_sample, cut, fold

FOLDS, HELD_OUT = 3, 1
ORDERS = (3, 4)
#: Texts of each language to learn from, at most about; n-grams kept of each language, at most.
PER_LANGUAGE, PROFILE = 2000, 20_000
SLOTS, HASHES = 1 << 20, 3
UNKNOWN = "und"
SPACE, WALL = 32, 0

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; its constants are fixed values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed letter n-grams of some texts, lower case, with runs of anything else as one space,
    and the number of the text that each comes from."""
    flat = np.frombuffer("\0".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    walls = np.cumsum(flat == WALL) if len(texts) > 1 else np.zeros(len(flat), np.int64)
    codes = np.where(_is_letter()[np.minimum(flat, 0x10FFFF)], flat, np.where(flat == WALL, WALL, SPACE)).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    codes, walls = codes[keep], walls[keep]
    hashes, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        whole = np.ones(len(h), bool)
        for k in range(n):
            part = codes[k : len(codes) - n + 1 + k]
            h = h * np.uint64(0x100000001B3) + part
            whole &= part != WALL
        hashes.append(_mix(h[whole]))
        owners.append(walls[: len(h)][whole])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def blocks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about size characters, with their numbers; a longer text falls into parts
    that share the last characters, so that no n-gram is lost."""
    numbers, held, total = [], [], 0
    for k, text in enumerate(texts):
        text = text.replace("\0", " ")
        for at in range(0, max(1, len(text)), size):
            part = text[max(0, at - max(ORDERS) + 1) : at + size]
            numbers.append(k)
            held.append(part)
            total += len(part)
            if total >= size:
                yield numbers, held
                numbers, held, total = [], [], 0
    if held:
        yield numbers, held


@dataclass
class Filters:
    """A Bloom filter for each language, bit-sliced: slot i holds bit i of every filter, a language
    a bit. One probe thus answers for all languages."""

    languages: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)

    @staticmethod
    def positions(hashes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((hashes + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray], slots: int = SLOTS) -> Filters:
        languages = sorted(profiles)
        table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        for k, lang in enumerate(languages):
            for at in cls.positions(profiles[lang], slots):
                table[at, k // 64] |= np.uint64(1 << (k % 64))
        return cls(languages, table)

    def false_rate(self) -> np.ndarray:
        """The chance, by language, that an n-gram not in its filter passes: its share of set bits to
        the number of probes."""
        return np.array([((self.slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() ** HASHES for k in range(len(self.languages))])

    def counts(self, hashes: np.ndarray, owners: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text in all, and by language those that its filter holds."""
        total, out = np.bincount(owners, minlength=texts), np.zeros((texts, len(self.languages)))
        for word in range(self.slots.shape[1]):
            mask = np.full(len(hashes), ~np.uint64(0))
            for at in self.positions(hashes, len(self.slots)):
                mask &= self.slots[at, word]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                out[:, 64 * word + bit] = np.bincount(owners[(mask >> np.uint64(bit)) & np.uint64(1) == 1], minlength=texts)
        return total, out


def learn_filters(docs: DataFrame, per_language: int = PER_LANGUAGE, profile: int = PROFILE, slots: int = SLOTS, most_languages: int = 1024, seed: int = 42) -> Filters:
    """Profiles from texts with a lang that are not held out: about per_language texts of each
    language at most (a documented bound), and of those the n-grams that stand in most texts: in
    three at least, unless no n-gram of the language does."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    if known.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    texts = bounded_sample(known, "lang", per_language, seed).where(F.col("text").isNotNull()).select("lang", "text")  # counting needs no texts

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, some in batch.groupby("lang")["text"]:
                for _, parts in blocks(list(some)):
                    hashes, owners = ngrams(parts)
                    grams, n = np.unique(_once(hashes, owners), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    grams = texts.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # where no n-gram stands in three texts, as with one or two texts of a language, all may enter
    grams = cut(grams)
    scarce = [r.lang for r in grams.groupBy("lang").agg(F.max("n").alias("most")).where("most < 3").select("lang").collect()]
    kept = grams.where((F.col("n") >= 3) | F.col("lang").isin(scarce)).withColumn("k", F.row_number().over(best)).where(F.col("k") <= profile).select("lang", "gram").toPandas()
    return Filters.build({lang: some.to_numpy().astype(np.int64).view(np.uint64) for lang, some in kept.groupby("lang")["gram"]}, slots)


def _once(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    order = np.lexsort((hashes, owners))
    h, o = hashes[order], owners[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[first]


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score: one row per row of docs.

    For each language the share of a text's n-grams that its filter holds, less what it would hold by
    chance: (found - rate * all) / (1 - rate) / all. The largest share wins, of equal ones the
    first language by name; score is its part of all shares. A null text, one without a
    letter, and any text when nothing was learned, is `und` with score 0. Repeated rows are
    scored alike; other columns are ignored; an empty table gives no rows.
    """
    names = np.array([*filters.languages, UNKNOWN], object)
    rate = filters.false_rate()

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            total, found = np.zeros(len(texts)), np.zeros((len(texts), len(rate)))
            for numbers, parts in blocks(texts):
                t, f = filters.counts(*ngrams(parts), len(parts))
                np.add.at(total, numbers, t)
                np.add.at(found, numbers, f)
            letters = np.array([any(c.isalpha() for c in t) for t in texts], bool)
            best, score = np.full(len(texts), len(rate)), np.zeros(len(texts))
            if len(rate):
                share = np.clip((found - rate * total[:, None]) / (1 - rate) / np.maximum(total, 1)[:, None], 0, 1)
                some = letters & (share.sum(1) > 0)
                best = np.where(letters, share.argmax(1), len(rate))
                score[some] = share.max(1)[some] / share.sum(1)[some]
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    return docs.select("doc_id", predict("text").alias("found")).select("doc_id", "found.*")


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang, ...), by filters
    learned from the rows that are not held out. See identify for odd rows."""
    found = identify(docs, learn_filters(docs.select("doc_id", "text", "lang"), per_language))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
