"""Normal forms, rolling hashes and n-gram sets, as numpy over code points."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_OTHER = re.compile(r"[\W_]+")


def letters_digits(s: str) -> str:
    """NFKC, lower case, letters and digits only."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", s).lower())


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WindowHash:
    """64-bit polynomial hashes of all windows of one width. Long texts go in pieces, so the tables of powers stay small."""

    BASE = 0x9E3779B97F4A7C15
    PIECE = 1 << 16

    def __init__(self, width: int, base: int = BASE) -> None:
        self.width, n = width, self.PIECE + width + 1
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)])

    def __call__(self, c: np.ndarray) -> np.ndarray:
        w, n = self.width, len(c)
        if n < w:
            return np.empty(0, np.uint64)
        out = []
        with np.errstate(over="ignore"):
            for at in range(0, n - w + 1, self.PIECE):
                part = mix64(c[at : at + self.PIECE + w - 1].astype(np.uint64) + np.uint64(1))
                total = np.r_[np.uint64(0), np.cumsum(part * self.up[: len(part)])]
                out.append(mix64((total[w:] - total[:-w]) * self.down[: len(part) - w + 1]))
        return np.concatenate(out) if len(out) > 1 else out[0]


def gram_ids(norm: str, n: int = 3) -> np.ndarray:
    """The distinct runs of n characters, packed for n = 3 (exactly), hashed for longer ones."""
    c = codes(norm).astype(np.uint64)
    if len(c) < n:
        return np.empty(0, np.uint64)
    if n == 3:
        return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])
    return np.unique(WindowHash(n)(c))


def gram_set(norm: str) -> frozenset[str]:
    return frozenset(norm[i : i + 3] for i in range(len(norm) - 2))


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def local_combine(key: np.ndarray, owner: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (key with more, owner): which rows' key has another owner here as well, and which rows still have to be sent on.

    A key with several owners among these rows is settled for all of them; one row is sent on to tell the others.
    So a key that a third of all rows share leaves a task as one row a batch.
    """
    more = np.zeros(len(key), np.uint64) if more is None else more
    order = np.lexsort((owner, more, key))
    k, m = key[order], more[order]
    first = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])] if len(k) else np.empty(0, bool)
    start = np.flatnonzero(first)
    last = np.r_[start[1:], len(k)] - 1
    group = np.cumsum(first) - 1
    many = (owner[order][start] != owner[order][last])[group] if len(k) else first
    known, send = np.zeros(len(key), bool), np.zeros(len(key), bool)
    known[order], send[order] = many, ~many | first
    return known, send
