"""Reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    ``local`` session without that setting (tests) falls back to a temporary
    folder; a cluster session without it is an error, since a folder on one
    machine would not survive the loss of that machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="trialweave-checkpoints-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
