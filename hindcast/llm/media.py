"""Media columns: texts stored as FLAC, read back, and features of the decoded samples.

Each payload (UTF-8 bytes, padded with 255 to a positive multiple of 576) becomes one FLAC stream, is
decoded with every checksum verified, and digests and features are taken from the decoded samples.
Null counts as empty; equal texts give equal values; length is not limited; columns besides doc_id and
text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_slices, sha256, table, texts
from .flac import BLOCK, decode_many, encode_many

_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded size and the padded payload."""
    raw = (text or "").encode()
    padded = max(-(-len(raw) // BLOCK), 1) * BLOCK
    return len(raw), raw + b"\xff" * (padded - len(raw))


def encode_column(part: pa.RecordBatch) -> dict:
    sizes, payloads = zip(*map(payload, part.column("text").to_pylist()), strict=True)
    return {"doc_id": part.column("doc_id").to_pylist(), "n_bytes": list(sizes), "media": encode_many(list(payloads))}


def features(data: bytes) -> str:
    """Level, root mean square, zero crossings and loudest block of the samples, in integers so that they repeat exactly."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64) - 128
    energy = (x * x).reshape(-1, BLOCK).sum(axis=1)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    steps = int(np.abs(np.diff(x)).sum())
    return f"mean={int(x.sum()) * 1000 // len(x)};rms={int((int(energy.sum()) * 1_000_000 // len(x)) ** 0.5)};crossings={crossings};steps={steps};loudest={int(energy.argmax())}"


def read_column(doc_ids: list, sizes: list, media: list[bytes]) -> dict:
    out: dict[str, list] = {f.name: [] for f in _ARROW}
    for doc_id, n, stream, data in zip(doc_ids, sizes, media, decode_many(media), strict=True):
        out["doc_id"].append(doc_id)
        out["n_bytes"].append(n)
        out["payload_bytes"].append(len(data))
        out["payload_sha256"].append(sha256(data))
        out["tail_crc32"].append(zlib.crc32(data[-32:]))
        out["media_bytes"].append(len(stream))
        out["media_sha256"].append(sha256(stream))
        out["feature"].append(features(data))
    return out


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream of each text."""
    return map_slices(texts(docs), encode_column, "doc_id long, n_bytes long, media binary", _STORED)


def read_media(stored: DataFrame) -> DataFrame:
    """Decode a media column: digests and features of the payloads."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = read_column(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in _ARROW], schema=_ARROW)

    return stored.mapInArrow(run, _SCHEMA)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store and read back in one pass over the texts, slice by slice."""

    def both(part: pa.RecordBatch) -> dict:
        stored = encode_column(part)
        return read_column(stored["doc_id"], stored["n_bytes"], stored["media"])

    return map_slices(texts(docs), both, _SCHEMA, _ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
