"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that setting is missing a
    temporary one stands in on a local master; on a cluster it is an error, as executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="nearfield-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder by Spark's own file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept, by checkpoint(), in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of a batch of rows between Spark and a Python worker. The worker holds a batch several times over (Arrow, strings, results), the
#: executor once or twice for each task.
BATCH, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on in this session no batch for Python holds more than BATCH bytes and a row, however long the texts are. By
    default a batch ends at 10,000 rows or 64 MB. A smaller setting stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > BATCH:
        spark.conf.set(BATCH_SETTING, f"{BATCH}b")


#: A group is hot from this part of all rows on, so there are no more hot groups than that; each is dealt out to so many tasks.
#: Groups of fewer than WORTH rows are not worth it.
HOT, SALTS, WORTH = 1000, 64, 256


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows joined with the one row that groups has for each key, whose column `size` says how many rows the
    group has. Rows of a hot group go to many tasks, each with a copy of the group's row; all others
    are dealt by key. The driver gets a hash for each hot group, HOT of them at most."""
    key, total = F.xxhash64(*on), groups.agg(F.sum(size)).first()[0] or 0
    hot = [r[0] for r in groups.where((F.col(size) * HOT >= total) & (F.col(size) >= WORTH)).select(key).distinct().collect()]
    if not hot:
        return rows.join(groups.drop(size), on)
    salt = F.when(key.isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
    copies = F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    salted = groups.drop(size).withColumn("_salt", F.explode(copies))
    return rows.withColumn("_salt", salt).join(salted, [*on, "_salt"]).drop("_salt")


def lower_ascii(text: str | Column) -> Column:
    """A-Z to a-z and nothing else. Texts without other than ASCII take the faster lower()."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(ids: DataFrame, by: str, per_class: int, seed: int) -> DataFrame:
    """About per_class rows of ids (columns doc_id and by) for each value of by: those whose
    seeded hash is lowest. The counts by class decide the share, so that the sample's size
    does not follow the table's; the number of classes is the caller's to bound."""
    counts = {r[0]: r[1] for r in ids.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    unit = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53))
    return ids.where(unit < share)
