"""Where intermediate tables go: the folder the cluster shares, never a machine-local one."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tablescope-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, else under the context's checkpoint folder.

    Where neither is set, a session whose tasks run in the driver's own process (``local[...]``) gets a folder of its
    own; any other session is refused, because its executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = _own_folder()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
