"""Settings by name, from the session's configuration or the environment."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def setting(spark: SparkSession, name: str, default: str | None = None, required: bool = False) -> str | None:
    """spark.citeloom.<name>, else the environment's CITELOOM_<NAME> (dots become underscores), else default; blank counts as unset.

    A required setting that is nowhere raises KeyError with both places it was looked for.
    """
    key, variable = f"spark.citeloom.{name}", "CITELOOM_" + name.upper().replace(".", "_")
    for value in (spark.conf.get(key, None), os.environ.get(variable)):
        if value is not None and value.strip():
            return value.strip()
    if required and default is None:
        raise KeyError(f"set {key} in the session or {variable} in the environment")
    return default
