"""CRC-32 of a concatenation from the parts' CRCs and lengths (the usual GF(2) method)."""

from __future__ import annotations

from functools import lru_cache

_POLY = 0xEDB88320  # fixed value: the reflected CRC-32 polynomial


def _times(mat: tuple[int, ...], vec: int) -> int:
    out = 0
    for row in mat:
        if not vec:
            break
        if vec & 1:
            out ^= row
        vec >>= 1
    return out


@lru_cache(maxsize=64)
def _zeros(log2_bytes: int) -> tuple[int, ...]:
    """The matrix that appends 2^log2_bytes zero bytes."""
    if log2_bytes == 0:
        one = (_POLY, *(1 << n for n in range(31)))
        for _ in range(3):
            one = tuple(_times(one, r) for r in one)
        return one
    half = _zeros(log2_bytes - 1)
    return tuple(_times(half, r) for r in half)


@lru_cache(maxsize=1024)
def _matrix(length: int) -> tuple[int, ...]:
    """The matrix that appends ``length`` zero bytes."""
    out = None
    for n in range(length.bit_length()):
        if length >> n & 1:
            out = _zeros(n) if out is None else tuple(_times(_zeros(n), r) for r in out)
    return out


def _shifted(crc: int, length: int) -> int:
    """By six bits of the length at a time, so that few matrices serve all lengths."""
    at = 0
    while length >> at:
        if digit := length >> at & 63:
            crc = _times(_matrix(digit << at), crc)
        at += 6
    return crc


def combined(crc_a: int, crc_b: int, length_b: int) -> int:
    """crc32(a + b)."""
    return _shifted(crc_a, length_b) ^ crc_b
