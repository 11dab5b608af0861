"""Session set-up shared by tests, bench and scripts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "marlstone", **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on; ``conf`` (dots as ``__``) overrides them. A cluster names its own checkpoint folder."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("MARLSTONE_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    if master.startswith("local["):
        settings.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="marlstone-checkpoint-"))
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
