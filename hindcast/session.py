"""Spark sessions with the settings this library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "hindcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def resolve_workers(configured: int | None = None) -> int:
    """Threads of a local session: what the scheduler grants, capped downward by the configuration."""
    granted = next((int(os.environ[k]) for k in ("SLURM_CPUS_PER_TASK", "SLURM_CPUS_ON_NODE") if os.environ.get(k, "").isdigit()), os.cpu_count() or 1)
    if configured is None:
        return max(granted, 1)
    if configured < 1:
        raise ValueError(f"workers must be positive, got {configured}")
    return min(configured, granted)
