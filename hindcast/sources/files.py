"""File-system calls through Hadoop's API: listing, small texts, atomic replacement, path rules."""

from __future__ import annotations

import json
import os.path
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


TEMP, REPLACED = ".tmp", ".replaced"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def entries(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is directory) of a directory's entries; none if it doesn't exist."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(target)]


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Replace target by source. What was there moves aside first and goes last, so that a failure loses neither."""
    fs, a = _fs(spark, source)
    b = _fs(spark, target)[1]
    fs.mkdirs(b.getParent())
    aside = _fs(spark, f"{target}.{uuid.uuid4().hex}{REPLACED}")[1] if fs.exists(b) else None
    if aside is not None and not fs.rename(b, aside):
        raise OSError(f"can't move {target} aside")
    if not fs.rename(a, b):
        if aside is not None:
            fs.rename(aside, b)
        raise OSError(f"can't rename {source} to {target}")
    if aside is not None:
        fs.delete(aside, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename."""
    temp = f"{path}.{uuid.uuid4().hex}{TEMP}"
    fs, target = _fs(spark, temp)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, temp, path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=2))


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object of a JSON file, or None where it is missing or broken."""
    try:
        value = json.loads(read_text(spark, path)) if exists(spark, path) else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def write_parquet(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A whole table or nothing: written beside the target, then renamed."""
    spark = df.sparkSession
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)
    temp = f"{path}.{uuid.uuid4().hex}{TEMP}"
    try:
        df.write.parquet(temp)
        rename(spark, temp, path)
    finally:
        delete(spark, temp)


def write_by_shard(df: DataFrame, path: str) -> None:
    """One directory for each shard, one file each; shards that df lacks are removed."""
    write_parquet_partitioned(df, path, ["shard"])


def write_parquet_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    spark = df.sparkSession
    temp = f"{path}.{uuid.uuid4().hex}{TEMP}"
    try:
        df.repartition(*by).write.partitionBy(*by).parquet(temp)
        rename(spark, temp, path)
    finally:
        delete(spark, temp)


def write_all(tables: dict[str, DataFrame], check: Callable[[dict[str, str]], None] | None = None) -> None:
    """Several tables or none: all are written beside their targets, checked (by their temporary paths), then renamed.

    The last of them is renamed last, so that a reader who finds it finds the others.
    """
    temps = {path: f"{path}.{uuid.uuid4().hex}{TEMP}" for path in tables}
    spark = next(iter(tables.values())).sparkSession
    try:
        for path, df in tables.items():
            df.write.parquet(temps[path])
        if check:
            check(temps)
        for path, temp in temps.items():
            rename(spark, temp, path)
    finally:
        for temp in temps.values():
            delete(spark, temp)


def stamped(path: str, at: datetime | None = None) -> str:
    """A path with the time before its suffix, so that runs don't overwrite each other."""
    return sibling(path, (at or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S"))


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A CSV directory with a header, written beside the target and renamed; an existing one is refused unless asked for."""
    spark = df.sparkSession
    if not overwrite:
        refuse_existing(spark, path)
    temp = f"{path}.{uuid.uuid4().hex}{TEMP}"
    try:
        df.write.csv(temp, header=True)
        rename(spark, temp, path)
    finally:
        delete(spark, temp)


def clean_temps(spark: SparkSession, path: str) -> int:
    """Remove what broken runs left in a directory; an old output whose replacement never came is put back."""
    names = [n for n, _ in entries(spark, path)]
    for name in (n for n in names if n.endswith(REPLACED)):
        target = name[: -len(REPLACED) - 33]
        if target in names:
            delete(spark, f"{path}/{name}")
        else:
            fs, a = _fs(spark, f"{path}/{name}")
            fs.rename(a, _fs(spark, f"{path}/{target}")[1])
    stale = [n for n in names if n.endswith(TEMP)]
    for name in stale:
        delete(spark, f"{path}/{name}")
    return len(stale)


def sibling(path: str, tag: str) -> str:
    """A sidecar's path: the tag goes before the suffix."""
    stem, suffix = os.path.splitext(path)
    return f"{stem}.{tag}{suffix}"


def artifacts_root(path: str) -> str:
    """Where the intermediate tables of an output directory go: a sibling of it."""
    if not path or not path.strip("/"):
        raise ValueError("an output directory must be named")
    return f"{path.rstrip('/')}_artifacts"


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    if found := [p for p in paths if exists(spark, p)]:
        raise FileExistsError(f"outputs exist already: {found}")
