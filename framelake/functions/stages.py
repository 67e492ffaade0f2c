"""Tables that are computed once: checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written to a reliable checkpoint under ``spark.checkpoint.dir``.

    Everything made from it sees the same rows in the same partitions, whatever is lost. Where
    the setting is unset a temporary folder is used if Spark is one local process.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            path = "file://" + tempfile.mkdtemp(prefix="framelake-")
        sc.setCheckpointDir(path)
    return df.checkpoint()
