"""Column functions shared by operators; all are built-in expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG_PREFIX, SLUG_HASH = 24, 10


def code_slug(code: Column) -> Column:
    """A file-safe name of a code: cleaned prefix, two underscores, start of the SHA-1."""
    digest = F.substring(F.sha1(code.cast("binary")), 1, SLUG_HASH)
    prefix = F.substring(F.regexp_replace(F.regexp_replace(code, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, SLUG_PREFIX)
    return F.when(prefix == "", digest).otherwise(F.concat(prefix, F.lit("__"), digest))


def slug(code: str) -> str:
    """The same for one value on the driver."""
    digest = hashlib.sha1(code.encode()).hexdigest()[:SLUG_HASH]
    prefix = re.sub("[^A-Za-z0-9._-]+", "_", code).strip("_")[:SLUG_PREFIX]
    return f"{prefix}__{digest}" if prefix else digest


def window_end(start: Column, days: Column) -> Column:
    """The end of a window of so many days (fractions count), to the microsecond."""
    micros = F.rint(days.cast("double") * 86_400_000_000.0).cast("bigint")
    return start + F.make_dt_interval(secs=(micros.cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def micros_to_time(micros: Column) -> Column:
    """Epoch microseconds as a time without zone."""
    return F.timestamp_micros(micros.cast("bigint")).cast("timestamp_ntz")


def sample_key(*parts: Column) -> Column:
    """A 60-bit key of the parts joined by a vertical bar: the first 15 hex digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("bigint")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
