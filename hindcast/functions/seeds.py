"""Seeds derived from parts, the same in every process."""

from __future__ import annotations

import hashlib


def derive_seed(*parts: int | str) -> int:
    """A 31-bit seed: BLAKE2b of 8 bytes over the parts, each followed by a unit separator."""
    data = b"".join(str(p).encode() + b"\x1f" for p in parts)
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big") & 0x7FFFFFFF
