"""Cuts of lineage: rows written once where all executors read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder, without the plan that led to them: a lost executor costs no recomputation.

    The folder is the one the cluster names in spark.checkpoint.dir or the session has set. Where
    there is none, a local session takes a temporary folder, and any other one below the warehouse if
    its path names a store that executors share; a folder of the driver alone is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context._jsc.sc().getCheckpointDir().isEmpty():
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if context.master.split("[")[0] == "local":
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        elif "://" in warehouse and not warehouse.startswith("file:"):
            context.setCheckpointDir(f"{warehouse}/checkpoints")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Settled rows that grow with the input, which the next join sorts and merges.

    What Spark takes for their size stems from the few bytes of the tables that they were made from,
    so it would send whole relations through the driver to all executors.
    """
    return settled(df).hint("merge")
