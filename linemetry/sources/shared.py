"""Tables that a job goes on from, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """`df`, written once to the checkpoint folder: what follows reads it from there, whoever asks and however
    often, and no plan holds what led to it. The folder is the one of spark.checkpoint.dir; on a
    cluster it must be set, since executors share no local folder, and a local session without one
    (tests) gets its own. Spark deletes it with spark.cleaner.referenceTracking.cleanCheckpoints."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linemetry-"))
    return df.checkpoint()
