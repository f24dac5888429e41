"""Tables that a query uses several times, computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept in the folder of ``spark.checkpoint.dir``; its users read it instead of computing it again.

    A temporary folder is taken only where the setting is missing and one local JVM is the whole cluster.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return df.checkpoint(eager=True)
