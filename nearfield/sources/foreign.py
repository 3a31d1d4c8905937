"""Foreign index files as tables, and tables as the bytes of such files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.layout import PAGE
from nearfield.sources import formats


def _file_rows(spark: SparkSession, path: str, schema: str, rows: Callable[[bytes], Iterator[pd.DataFrame]]) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from rows(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def read_adjacency(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """A file of 4096-byte blocks -> vec_id, nbrs, nbr_codes (null without codes). Neighbours from n on are passed over if n is
    given; a file that ends inside a block is an error."""

    def rows(content: bytes) -> Iterator[pd.DataFrame]:
        if len(content) % formats.BLOCK:
            raise ValueError("the last block is not whole")
        for a in range(0, len(content) // formats.BLOCK, 4096):
            found = [formats.read_adjacency_block(content[k : k + formats.BLOCK]) for k in range(a * formats.BLOCK, min(len(content), (a + 4096) * formats.BLOCK), formats.BLOCK)]
            keep = [[k for k, v in enumerate(ids) if n is None or v < n] for ids, _ in found]
            lists = [[ids[k] for k in some] for (ids, _), some in zip(found, keep, strict=True)]
            codes = [None if c is None else [c[k].tobytes() for k in some] for (_, c), some in zip(found, keep, strict=True)]
            yield pd.DataFrame({"vec_id": np.arange(a, a + len(found)), "nbrs": lists, "nbr_codes": codes})

    return _file_rows(spark, path, "vec_id long, nbrs array<long>, nbr_codes array<binary>", rows)


def adjacency_blocks(graph: DataFrame) -> DataFrame:
    """graph(vec_id, nbrs [, nbr_codes of bytes]) -> vec_id, block: what a file holds at vec_id * 4096."""
    coded = "nbr_codes" in graph.columns

    @F.pandas_udf("binary")
    def block(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, codes in batches:
            yield pd.Series([formats.adjacency_block(list(ids), np.stack([np.frombuffer(x, np.uint8) for x in c]) if c is not None and len(c) else None) for ids, c in zip(lists, codes, strict=True)])

    return graph.select("vec_id", block("nbrs", F.col("nbr_codes") if coded else F.lit(None).cast("array<binary>")).alias("block"))


def page_bytes(pages: DataFrame, graph: DataFrame) -> DataFrame:
    """pages(shard, vec_id, page_id, offset), graph(shard, vec_id, nbrs) -> shard, page_id, page: each page's 4096 bytes."""

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        page = bytearray(PAGE)
        for offset, nbrs in zip(group["offset"].tolist(), group["nbrs"], strict=True):
            record = formats.page_record(list(nbrs))
            page[offset : offset + len(record)] = record
        return pd.DataFrame({"shard": group["shard"][:1], "page_id": group["page_id"][:1], "page": [bytes(page)]})

    placed = pages.select("shard", "vec_id", "page_id", "offset").join(graph.select("shard", "vec_id", "nbrs"), ["shard", "vec_id"])
    return placed.groupBy("shard", "page_id").applyInPandas(fill, "shard int, page_id int, page binary")


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, page_id, offset, degree."""

    def rows(content: bytes) -> Iterator[pd.DataFrame]:
        found = formats.read_index(content, len(content) // 8)
        yield pd.DataFrame(found, columns=["page_id", "offset", "degree"]).assign(vec_id=range(len(found)))[["vec_id", "page_id", "offset", "degree"]]

    return _file_rows(spark, path, "vec_id long, page_id long, offset int, degree int", rows)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """m, c, centroid."""

    def rows(content: bytes) -> Iterator[pd.DataFrame]:
        book = formats.read_codebook(content)
        yield pd.DataFrame([(m, c, book[m, c]) for m in range(book.shape[0]) for c in range(book.shape[1])], columns=["m", "c", "centroid"])

    return _file_rows(spark, path, "m int, c int, centroid array<float>", rows)


def read_saq(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """vec_id, codes (all segments' bytes), rescale, length, as the search over segmented codes takes them."""

    def rows(content: bytes) -> Iterator[pd.DataFrame]:
        found = formats.read_packed_saq(content) if packed else formats.read_saq(content)
        factors = found["factors"][:, None] if packed else found["factors"]
        codes = [found["packed"]] if packed else found["codes"]
        for a in range(0, found["n"], 10_000):
            part = slice(a, a + 10_000)
            joined = [b"".join(c[k].tobytes() for c in codes) for k in range(a, min(found["n"], a + 10_000))]
            yield pd.DataFrame({"vec_id": np.arange(a, a + len(joined)), "codes": joined, "rescale": list(factors[part, :, 0].astype(float)), "length": list(factors[part, :, 2].astype(float))})

    return _file_rows(spark, path, "vec_id long, codes binary, rescale array<double>, length array<double>", rows)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """A matrix file of queries by vectors -> qid, vec_id, distance."""

    def rows(content: bytes) -> Iterator[pd.DataFrame]:
        d = formats.read_matrix(content)
        for q in range(len(d)):
            yield pd.DataFrame({"qid": q, "vec_id": np.arange(d.shape[1]), "distance": d[q].astype(float)})

    return _file_rows(spark, path, "qid long, vec_id long, distance double", rows)


def payload_digest(spark: SparkSession, path: str, header: int = 8) -> str:
    """SHA-256 of what follows a file's header, to hold against what the writer returned."""
    content = spark.read.format("binaryFile").load(path)
    return content.select(F.sha2(F.substring("content", header + 1, 1 << 30), 256)).first()[0]
