"""MD5 of many short texts at once, for draws that follow from the hash of a key: a numpy step per operation, not a call per text."""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

CHUNK = 32768  # texts whose words stay in cache together
SHORT = 55  # longest text that fills a single block
_K = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_LEFT, _RIGHT = [np.uint32(r) for r in _TURN], [np.uint32(32 - r) for r in _TURN]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Padded blocks as 16 little-endian words per text (rows of bytes), words first."""
    n = len(raw)
    block = np.zeros((n, 64), "u1")
    block[:, :raw.shape[1]] = raw
    block[np.arange(n), lengths] = 0x80
    block[:, 56:58] = (lengths * 8).astype("<u2").view("u1").reshape(n, 2)
    return np.ascontiguousarray(block.view("<u4").T)


def _digest(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of each block's hash."""
    n = m.shape[1]
    a, b, c, d = (np.full(n, v, "u4") for v in _START)
    f, t = np.empty(n, "u4"), np.empty(n, "u4")
    used = [w < 15 and bool(m[w].any()) for w in range(16)]
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _K[i]
        if used[_WORD[i]]:
            f += m[_WORD[i]]
        np.right_shift(f, _RIGHT[i], out=t)
        f <<= _LEFT[i]
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def md5_grid(prefixes: Sequence[str], texts: np.ndarray) -> np.ndarray:
    """(prefixes x texts): the first 16 hex digits of the MD5 of prefix + text (numpy bytes), as unsigned 64-bit numbers."""
    heads = [p.encode() for p in prefixes]
    out = np.empty((len(heads), len(texts)), "u8")
    for size in {len(h) for h in heads}:
        same = [k for k, h in enumerate(heads) if len(h) == size]
        for lo in range(0, len(texts), CHUNK):
            part = np.ascontiguousarray(texts[lo:lo + CHUNK])
            if size + part.dtype.itemsize > SHORT:
                for k in same:
                    out[k, lo:lo + CHUNK] = [int.from_bytes(hashlib.md5(heads[k] + t).digest()[:8], "big") for t in part.tolist()]
                continue
            raw = np.zeros((len(part), size + part.dtype.itemsize), "u1")
            raw[:, size:] = part.view("u1").reshape(len(part), -1)
            words = _words(raw, size + np.char.str_len(part))
            for k in same:
                mine = np.frombuffer(heads[k].ljust(-(-size // 4) * 4, b"\0"), "<u4")
                m = words if not size else np.concatenate([words[:len(mine)] | mine[:, None], words[len(mine):]])
                x, y = _digest(m)
                out[k, lo:lo + CHUNK] = x.byteswap().astype("u8") << np.uint64(32) | y.byteswap()
    return out


def as_bytes(values: Sequence) -> np.ndarray:
    """Texts of values as SQL casts integers and strings to text."""
    v = np.asarray(values)
    return np.char.encode(v.astype(str), "utf-8") if v.dtype.kind != "S" else v


def uniforms(heads: np.ndarray) -> np.ndarray:
    """Draws in [0, 1) from the first eight hex digits, as `rand.uniform` makes them."""
    return (heads >> np.uint64(32)).astype("f8") / 2.0**32
