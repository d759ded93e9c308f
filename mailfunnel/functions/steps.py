"""Steps of a long projection that the optimizer must not merge again."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with the new columns, worked out once: they pass a one-row generator, which filters are not pushed through.

    A filter on a plain projection is pushed below it with the whole expression copied in; over several such
    projections of many patterns the plan grows beyond bounds.
    """
    kept = [c for c in df.columns if c not in new]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` worked out once, in the shared folder named by ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="spark-checkpoints-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()
