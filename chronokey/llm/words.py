"""Words of many texts at once: spans and 64-bit hashes, vectorised over their bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_r = np.random.default_rng(20240601)
#: A random number for each byte, A-Z as a-z; white space (space, tab to CR) parts words.
_BYTE = _r.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            f = np.full(n, b, U)
            f[0] = 1
            _powers[i] = np.multiply.accumulate(f)
    return _powers[0], _powers[1]


def batches(texts: list[str | None], most: int = 1 << 19) -> list[tuple[int, int]]:
    """Slices of ``texts`` of about ``most`` characters; a longer text is a slice of its own."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            out.append((start, i))
            start, size = i, 0
        size += n
    return [*out, (start, len(texts))] if len(texts) > start else out


def spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): word i is bytes[starts[i]:ends[i]]; the words of text j are
    first[j] to first[j + 1]. Null counts as empty."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]) if raw else b"", np.uint8)
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
    return data, starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z: a polynomial of random byte values, mixed."""
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * up[: len(data)], dtype=U)])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
