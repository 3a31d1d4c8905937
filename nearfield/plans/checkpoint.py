"""Cutting a plan's lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of spark.checkpoint.dir. Where that setting is missing a temporary folder stands in on a
    local master; on a cluster it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="nearfield-"))
    return df.checkpoint()
