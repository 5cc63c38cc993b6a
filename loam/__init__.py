"""loam: analytics over source repositories, and the operators of a text corpus pipeline, on PySpark."""

from __future__ import annotations

from pathlib import Path

__version__ = "0.1.0"


def ready(spark) -> None:
    """Let Python workers import this package from where the driver did, unless it was shipped otherwise."""
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [here, env.get("PYTHONPATH", "")]))
