"""Packing token sequences: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import bisect
import heapq
import json
import math
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import cut

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 2048
#: Entries that a worker keeps of each kind; beyond it the memory starts anew.
KNOWN = 500_000
#: The tokenizer's own rule for words, and the same for lower-case ASCII.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
#: Characters that str.split() takes for white space and the tokenizer doesn't, and blocks in which
#: later versions of Unicode have added letters: such texts are encoded whole.
UNSURE = r"[\x1c-\x1f\u0530-\u1fff\u2070-\u209f\ua7cb-\uabff\U00010000-\U0010ffff]"


class _Kept(dict):
    """A dict that makes what it lacks."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) > KNOWN:
            self.clear()
        self[key] = value = self.make(key)
        return value


class WordEncoder:
    """Ids of whole texts by the tokenizer's own model: a text falls into words by its rules,
    each is encoded once and its ids are kept, as little-endian unsigned 32-bit numbers.
    A tokenizer with other rules encodes whole texts instead, and so texts that quote
    one of its added tokens, which it takes for one id."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.ascii_words = regex.compile(WORDS).findall, re.compile(WORDS_ASCII).findall
        self.unsure = re.compile(UNSURE).search
        self.of_word, self.of_run = _Kept(self._word), _Kept(self._run)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(hidden)}  # the byte-level alphabet of byte-pair vocabularies
        rules = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.added_folded = [t["content"].lower() for t in rules["added_tokens"] if t["normalized"]]  # met in lower-case text
        self.by_word = all(x in json.dumps(rules.get(part)) for part, x in (("normalizer", '"Lowercase"'), ("pre_tokenizer", json.dumps(WORDS)[1:-1])))

    def quotes_added(self, text: str) -> bool:
        if self.added_folded:
            low = unicodedata.normalize("NFC", text).lower()
            return any(t in text for t in self.added) or any(t in low for t in self.added_folded)
        return any(t in text for t in self.added)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        """Ids of what stands between white space."""
        if run.isascii():
            words = [run] if run.isalpha() else self.ascii_words(run)
        else:
            words = self.words(run)
        return b"".join(map(self.of_word.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if not self.by_word or self.unsure(text) or self.quotes_added(text):
            return self.whole(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return b"".join(map(self.of_run.__getitem__, text.lower().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, start, length, ids_crc32, doc_tokens [, ids]: each
    document's ids with end_id behind, cut at every multiple of capacity."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["start", "length", "ids_crc32", *["ids"] * with_ids]

    @F.pandas_udf("start array<bigint>, length array<bigint>, ids_crc32 array<bigint>" + ", ids array<binary>" * with_ids + ", doc_tokens bigint")
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for texts in batches:
            rows = []
            for text in texts:
                ids = encode(text or "") + end
                starts = range(0, len(ids), 4 * capacity)
                parts = [ids[at : at + 4 * capacity] for at in starts]
                rows.append(([at // 4 for at in starts], [len(p) // 4 for p in parts], [zlib.crc32(p) for p in parts], *[parts] * with_ids, len(ids) // 4))
            yield pd.DataFrame(rows, columns=[*names, "doc_tokens"])

    found = docs.select("doc_id", cut_up("text").alias("found"))
    found = found.select("doc_id", "found.doc_tokens", F.explode(F.arrays_zip(*[F.col(f"found.{n}") for n in names])).alias("piece"))
    return found.select("doc_id", "piece.start", "piece.length", "piece.ids_crc32", "doc_tokens", *["piece.ids"] * with_ids)


Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """Length -> count, to (how often, pattern) with a pattern as ((length, how many), ...).

    Lengths are placed longest first, each into the packs that are shortest so far, as long as it
    fits there, else into new ones. How many new ones depends on the tokens that are trusted to fill them:
    all shorter pieces, those less the room in packs so far, none, or any number (a pack for each
    piece). The plan with the fewest packs is taken. All packs of one content are one entry with a
    count, so the work depends on the number of different lengths, never on the number of pieces.
    """
    tokens = sum(length * n for length, n in histogram.items())
    best: list[tuple[int, Pattern]] | None = None
    for trust in (lambda shorter, room: math.inf, lambda shorter, room: shorter, lambda shorter, room: max(0, shorter - room), lambda shorter, room: 0):
        packs = _pack_trusting(histogram, capacity, trust)
        if best is None or sum(n for n, _ in packs) < sum(n for n, _ in best):
            best = packs
        if sum(n for n, _ in best) <= -(-tokens // capacity):
            break
    return best


def _pack_trusting(histogram: dict[int, int], capacity: int, trust: Callable[[int, int], float]) -> list[tuple[int, Pattern]]:
    """shortest_pack_first with new packs for what trust(tokens of shorter pieces, room in packs so
    far) can fill, each holding as many pieces as must share one, or one more."""
    heap: list[tuple[int, int]] = []  # (tokens so far, entry)
    entries: dict[int, tuple[int, dict[int, int]]] = {}
    made = 0
    shorter, room = sum(length * n for length, n in histogram.items()), 0

    def add(count: int, content: dict[int, int]) -> None:
        nonlocal made
        entries[made] = (count, content)
        heapq.heappush(heap, (sum(k * v for k, v in content.items()), made))
        made += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        shorter -= length * left
        while left:
            if heap and heap[0][0] + length <= capacity:
                _, at = heapq.heappop(heap)
                count, content = entries.pop(at)
                used = min(count, left)
                if used < count:
                    add(count - used, content)
                add(used, content | {length: content.get(length, 0) + 1})
                left -= used
                room -= length * used
            else:
                filled = (left * length + trust(shorter, room)) / capacity
                packs = max(-(-left // (capacity // length)), left if filled >= left else int(filled))
                each, more = divmod(left, packs)
                for count, many in ((more, each + 1), (packs - more, each)):
                    if count:
                        add(count, {length: many})
                room += packs * capacity - left * length
                left = 0
    return [(count, tuple(sorted(content.items(), reverse=True))) for count, content in entries.values()]


class Places:
    """Which sequence and offset the piece of a given rank among those of its length has."""

    def __init__(self, packs: list[tuple[int, Pattern]]) -> None:
        self.by_length: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = defaultdict(lambda: ([], []))
        first, ranks = 0, defaultdict(int)
        for count, pattern in packs:
            offset = 0
            for length, many in pattern:
                begins, slots = self.by_length[length]
                begins.append(ranks[length])
                slots.append((first, many, offset))
                ranks[length] += count * many
                offset += length * many
            first += count
        self.by_length = dict(self.by_length)

    def find(self, length: int, rank: int) -> tuple[int, int]:
        begins, slots = self.by_length[length]
        k = bisect.bisect_right(begins, rank) - 1
        first, many, offset = slots[k]
        pack, within = divmod(rank - begins[k], many)
        return first + pack, offset + within * length


def ranked(pieces: DataFrame, groups: int) -> DataFrame:
    """pieces with rank, from 0 without gaps among those of a length. A length may hold any share
    of the rows, so its rows are numbered by salt first and the salts' counts summed."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = salted.withColumn("k", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "salt"]).withColumn("rank", F.col("from") + F.col("k")).drop("salt", "from", "k")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, rows_per_group: int = 100_000) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset:
    one row per piece; pieces of a sequence follow one another from offset 0 without gaps.

    A null or empty text still has the end id, so each row of docs has a piece. Documents
    longer than capacity are cut at multiples of it. Rows that repeat an id are packed
    each for itself. Null ids are kept. Other columns are ignored; an empty table gives no rows.

    The driver gets the histogram (capacity numbers at most) and the patterns made from it. Pieces
    meet their pattern by their rank among those of the same length, which is counted in groups of at most
    about rows_per_group rows, at least 64 of them.
    """
    pieces = cut(token_pieces(docs, path, capacity, end_id))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = Places(shortest_pack_first(histogram, capacity))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in batches:
            yield pd.DataFrame([places.find(n, r) for n, r in zip(lengths.tolist(), ranks.tolist(), strict=True)], columns=["sequence_id", "offset"])

    placed = ranked(pieces, max(64, sum(histogram.values()) // rows_per_group)).withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
