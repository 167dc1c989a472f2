"""Reliable lineage cuts: results that later steps read more than once go to shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names.

    The folder is shared by all executors, so losing one doesn't lose the result. Where the
    session names none (local tests), a temporary folder of this machine stands in, which is
    right only because a local session has no other machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tallyweave-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
