"""Results that must not be computed twice, kept where all executors can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the folder that spark.checkpoint.dir names; its lineage ends there.

    On a local master without that setting, in a temporary folder of this machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="arrayloom"))
    return df.checkpoint()
