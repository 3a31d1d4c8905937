"""Segmented adaptive scalar quantization: rotated segments, codes of a few bits, and factors that
correct their inner products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.knn import PANEL, SLICE_QUERIES, checked, keep_best, over_blocks, top


@dataclass(frozen=True)
class Segments:
    """How a vector falls into segments: (start, dimensions, padded dimensions, bits) and, for each, a rotation
    or None. Only the last segment may be padded."""

    parts: tuple[tuple[int, int, int, int], ...]
    rotations: tuple[np.ndarray | None, ...]

    @classmethod
    def even(cls, dim: int, count: int = 1, bits: int = 4, rotate: bool = True, seed: int = 42, pad: int = 1) -> Segments:
        if not 1 <= bits <= 8:
            raise ValueError("1 to 8 bits")
        width = -(-dim // count)
        rng, parts, turns = np.random.default_rng(seed), [], []
        for start in range(0, dim, width):
            size = min(width, dim - start)
            padded = -(-size // pad) * pad if start + size == dim else size
            parts.append((start, size, padded, bits))
            turns.append(np.linalg.qr(rng.standard_normal((padded, padded)))[0] if rotate else None)
        return cls(tuple(parts), tuple(turns))

    def cut(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(bits, the rotated segment of every row)."""
        for (start, size, padded, bits), turn in zip(self.parts, self.rotations, strict=True):
            part = np.zeros((len(x), padded))
            part[:, :size] = x[:, start : start + size]
            yield bits, part @ turn if turn is not None else part


def encode_block(x: np.ndarray, segments: Segments, rounds: int = 6) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each segment: codes, rescale factors and lengths. A segment is scaled by its largest component to [-1, 1]
    and cut into 2^bits steps; then single codes move by one step as long as that turns the coded
    vector nearer to the true direction, in at most `rounds` rounds. rescale is |o|^2 / <o, coded o>, so that a
    vector's product with itself comes out right."""
    out = []
    for bits, o in segments.cut(x):
        step, most = 2 / 2**bits, 2**bits - 1
        top_ = np.abs(o).max(1, keepdims=True)
        unit = np.divide(o, top_, out=np.zeros_like(o), where=top_ > 0)
        code = np.clip(np.floor((unit + 1) / step), 0, most)
        for _ in range(rounds):
            moved = 0
            for d in range(o.shape[1]):
                a = -1 + step * (code + 0.5)
                ip, sq = (unit * a).sum(1), (a * a).sum(1)
                best, gain = code[:, d].copy(), ip / np.sqrt(np.maximum(sq, 1e-30))
                for change in (-1, 1):
                    c = code[:, d] + change
                    v = -1 + step * (c + 0.5)
                    new_ip, new_sq = ip + unit[:, d] * (v - a[:, d]), sq - a[:, d] ** 2 + v**2
                    value = new_ip / np.sqrt(np.maximum(new_sq, 1e-30))
                    better = (c >= 0) & (c <= most) & (value > gain + 1e-12)
                    best, gain = np.where(better, c, best), np.where(better, value, gain)
                moved += int((best != code[:, d]).sum())
                code[:, d] = best
            if not moved:
                break
        coded = -1 + step * (code + 0.5)
        ip, sq = (o * coded).sum(1), (o * o).sum(1)
        rescale = np.divide(sq, ip, out=np.zeros(len(o)), where=np.abs(ip) > 1e-30)
        out.append((code.astype(np.uint8), rescale, np.sqrt(sq)))
    return out


def pack(codes: np.ndarray) -> np.ndarray:
    """4-bit codes two to a byte, the even dimension in the lower half."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, ::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def unpack(data: np.ndarray, dim: int) -> np.ndarray:
    out = np.empty((len(data), data.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = data & 15, data >> 4
    return out[:, :dim]


def encode(vectors: DataFrame, segments: Segments, packed: bool = False) -> DataFrame:
    """vectors(vec_id, embedding), bad ones an error -> vec_id, codes (a byte or half a byte each), rescale, length by segment."""
    if packed and any(bits != 4 for *_, bits in segments.parts):
        raise ValueError("only 4-bit codes are packed")

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = encode_block(np.stack(batch["embedding"]).astype(np.float64), segments)
            data = [pack(c) if packed else c for c, _, _ in found]
            rows = [b"".join(c[i].tobytes() for c in data) for i in range(len(batch))]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "codes": rows, "rescale": list(np.stack([r for _, r, _ in found], 1)), "length": list(np.stack([n for *_, n in found], 1))})

    dim = sum(size for _, size, *_ in segments.parts)
    return checked(vectors.select("vec_id", "embedding"), dim).mapInPandas(codes, "vec_id long, codes binary, rescale array<double>, length array<double>")


def decode_block(rows: pd.Series, segments: Segments, packed: bool) -> list[np.ndarray]:
    data = np.stack([np.frombuffer(r, np.uint8) for r in rows])
    out, at = [], 0
    for *_, padded, _ in segments.parts:
        width = -(-padded // 2) if packed else padded
        part = data[:, at : at + width]
        out.append(unpack(part, padded) if packed else part)
        at += width
    return out


def estimate_block(queries: np.ndarray, codes: list[np.ndarray], rescale: np.ndarray, length: np.ndarray, segments: Segments) -> np.ndarray:
    """Squared distances of all queries to all coded vectors: the lengths are known, and each segment's inner
    product is step * <code, q> + (-1 + step / 2) * sum(q), rescaled. Never below zero."""
    total = (queries * queries).sum(1)[:, None] + (length**2).sum(1)[None]
    for s, (bits, q) in enumerate(segments.cut(queries)):
        step = 2 / 2**bits
        ip = step * (q @ codes[s].astype(np.float64).T) + ((-1 + step / 2) * q.sum(1))[:, None]
        total = total - 2 * rescale[:, s][None] * ip
    return np.maximum(total, 0)


def saq_knn(coded: DataFrame, queries: DataFrame, segments: Segments, k: int, packed: bool = False) -> DataFrame:
    """The k nearest by estimated squared distance: coded as encode() gives it, queries(qid, qvec). A partition
    sends its best k per query; a worker holds those and about PANEL estimates."""

    def near(qids: np.ndarray, qs: np.ndarray) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros((len(qids), k), np.int64), np.full((len(qids), k), np.inf)
            for batch in batches:
                codes, rescale, length = decode_block(batch["codes"], segments, packed), np.stack(batch["rescale"]), np.stack(batch["length"])
                ids = batch["vec_id"].to_numpy(np.int64)
                step = max(1, min(SLICE_QUERIES, PANEL // len(ids)))
                for a in range(0, len(qids), step):
                    keep_best(held, a, ids, estimate_block(qs[a : a + step], codes, rescale, length, segments), k)
            for a in range(0, len(qids), SLICE_QUERIES):
                ids, d = held[0][a : a + SLICE_QUERIES], held[1][a : a + SLICE_QUERIES]
                keep = np.isfinite(d)
                yield pd.DataFrame({"qid": np.broadcast_to(qids[a : a + SLICE_QUERIES, None], keep.shape)[keep], "vec_id": ids[keep], "distance": d[keep]})

        return coded.mapInPandas(scan, "qid long, vec_id long, distance double")

    return top(over_blocks(queries, near), k)


def saq_pairs(pairs: DataFrame, coded: DataFrame, queries: DataFrame, segments: Segments, packed: bool = False) -> DataFrame:
    """pairs(qid, vec_id, ...) with `estimate`, the estimated squared distance of each: what saq_knn ranks, for given pairs alone. A pair without
    its code or query is an error."""

    names = pairs.columns

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.empty(len(batch))
            for at in batch.groupby("qid").indices.values():
                some = batch.iloc[at]
                out[at] = estimate_block(np.stack(some["qvec"][:1]).astype(np.float64), decode_block(some["codes"], segments, packed), np.stack(some["rescale"]), np.stack(some["length"]), segments)[0]
            yield batch[names].assign(estimate=out)

    found = pairs.join(coded, "vec_id", "left").join(queries, "qid", "left")
    broken = F.raise_error(F.concat(F.lit("a pair has no code or query: "), F.col("vec_id").cast("string")))
    found = found.withColumn("codes", F.when(F.col("codes").isNotNull() & F.col("qvec").isNotNull(), F.col("codes")).otherwise(broken))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return found.select(*names, "qvec", "codes", "rescale", "length").mapInPandas(score, f"{kinds}, estimate double")


def memory_bytes(n: int, segments: Segments, packed: bool = False) -> int:
    """Codes, and three four-byte factors for each segment."""
    return n * sum((-(-padded // 2) if packed else padded) + 12 for *_, padded, _ in segments.parts)
