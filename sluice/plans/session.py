"""What a session decides: where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder and cut its lineage.

    The folder is the one that spark.checkpoint.dir names. Only a local session
    without one, as in tests, gets a folder of its own; a cluster without one is
    an error, since its executors share no temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sluice-"))
    return df.checkpoint()
