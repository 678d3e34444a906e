"""The exploration hash (32-bit FNV-1a over ``user|item|utc-day``) and perceptual-hash helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a offset basis and prime.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
FNV_SPACE = 4294967296.0


def utc_day(now: Column) -> Column:
    return F.date_format(now, "yyyy-MM-dd")


def ascii_codes(text: Column) -> Column:
    """Character codes of an ASCII string. Non-ASCII ids are not supported."""
    return F.transform(F.split(text, ""), lambda ch: F.ascii(ch))


def fnv_fold(state: Column, codes: Column) -> Column:
    """Continue a hash state (bigint) over character codes."""
    return F.aggregate(
        codes,
        state,
        lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")),
    )


def user_state(user_id: Column) -> Column:
    """Hash state after ``user|``: computed once per user, not once per candidate."""
    return fnv_fold(F.lit(FNV_OFFSET).cast("long"), ascii_codes(F.concat(user_id.cast("string"), F.lit("|"))))


def item_codes(item_id: Column, day: str) -> Column:
    """Codes of ``item|day``: computed once per item."""
    return ascii_codes(F.concat(item_id.cast("string"), F.lit(f"|{day}")))


def unit_hash(state: Column, codes: Column) -> Column:
    return fnv_fold(state, codes) / F.lit(FNV_SPACE)


def exploration_hash(user_id: Column, item_id: Column, day: str) -> Column:
    return unit_hash(user_state(user_id), item_codes(item_id, day))


def _bytes_by_length(texts: list[str]):
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        raw = "".join(texts[r] for r in rows).encode("ascii")
        yield rows, np.frombuffer(raw, dtype=np.uint8).reshape(len(rows), n).astype(np.uint32)


def fnv_states(prefixes: list[str]) -> np.ndarray:
    """Hash state after each prefix."""
    out = np.empty(len(prefixes), dtype=np.uint32)
    for rows, codes in _bytes_by_length(prefixes):
        h = np.full(len(rows), FNV_OFFSET, dtype=np.uint32)
        for j in range(codes.shape[1]):
            h = (h ^ codes[:, j]) * np.uint32(FNV_PRIME)
        out[rows] = h
    return out


def fnv_grid(states: np.ndarray, suffixes: list[str]) -> np.ndarray:
    """Hash of every (prefix state, suffix) pair in one block, as uint32."""
    out = np.empty((len(states), len(suffixes)), dtype=np.uint32)
    for cols, codes in _bytes_by_length(suffixes):
        h = np.repeat(states[:, None], len(cols), axis=1)
        for j in range(codes.shape[1]):
            h ^= codes[:, j]
            h *= np.uint32(FNV_PRIME)
        out[:, cols] = h
    return out


def hex_to_long(h: Column) -> Column:
    return F.conv(h, 16, -10).cast("long")


def long_to_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def gradient_hash(gray: Column) -> Column:
    """64-bit difference hash of a 9x8 grayscale plane: bit set where a pixel is brighter than its right neighbour."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.when(
            F.get(gray, F.floor(i / 8).cast("int") * 9 + i % 8) > F.get(gray, F.floor(i / 8).cast("int") * 9 + i % 8 + 1),
            F.lit(1),
        )
        .otherwise(F.lit(0))
        .cast("long"),
    )
    folded = F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))
    return F.when(F.size(gray) == 72, folded).otherwise(
        F.raise_error(F.lit("a grayscale plane needs 72 samples")).cast("long")
    )
