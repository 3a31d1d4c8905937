"""Index folders: Parquet tables with a JSON document beside them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from nearfield.functions.distance import metric_name


@dataclass
class IndexMeta:
    """What an index is. Fields that older documents lack have defaults."""

    dimension: int
    metric: str
    num_vectors: int
    max_degree: int
    ef_construction: int
    adj_block_size: int = 4096
    entry_set: list[int] = field(default_factory=list)
    adj_layout_version: int = 1
    num_pages: int | None = None
    adj_reorder: str | None = None

    def __post_init__(self) -> None:
        metric_name(self.metric)


def save_index(folder: str, meta: IndexMeta, **tables: DataFrame) -> None:
    """Writes each table (graph, int8, half, codes, codebook, saq, pages ...) and then the document: without it a folder is
    not an index, so a broken save is never read. An index is built once; a folder that exists is an error."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    columns = {k: v for k, v in asdict(meta).items() if v is not None}
    spark.createDataFrame([(json.dumps(columns),)], "value string").coalesce(1).write.mode("error").text(f"{folder}/meta")


def load_meta(spark: SparkSession, folder: str) -> IndexMeta:
    found = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    return IndexMeta(**{k: v for k, v in found.items() if k in IndexMeta.__dataclass_fields__})


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
