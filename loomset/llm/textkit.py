"""Vectorised hashing of lines, words and n-grams over UTF-8 bytes.

A text chunk is one byte buffer. With ``C[i] = sum((b[j] + 1) * P**j for j < i)`` modulo 2**64 the hash of
any span is ``(C[end] - C[start]) * P**-start``, so all spans of a chunk cost a few numpy passes and no
Python loop. Equal byte strings have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that one chunk aims at.
CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            a = np.empty(size, np.uint64)
            a[0], done, step = 1, 1, base
            while done < size:  # doubling: a[done:2*done] = a[:done] * base**done
                take = min(done, size - done)
                a[done : done + take] = a[:take] * np.uint64(step)
                done += take
                step = step * step & _MASK
            _POWERS[name] = a
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``buf[start:end]``."""
    p, inv = _powers(len(buf) + 1)
    c = np.empty(len(buf) + 1, np.uint64)
    c[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts])


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``limit`` bytes each; a longer text has a range of its own."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if len(t) >= limit and at < k:
            yield at, k
            at, size = k, 0
        size += len(t) + 1
        if size >= limit:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a newline after each text, and the n+1 offsets of the texts in it."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return buf, offsets


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space (space, tab, line feed, return)."""
    edge = np.flatnonzero(np.diff(SPACE[buf].astype(np.int8), prepend=1, append=1))
    return edge[0::2], edge[1::2]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a chunk, the text index of each, and the n+1 word offsets of the texts."""
    buf, offsets = joined(texts)
    starts, ends = word_spans(buf)
    at = np.searchsorted(starts, offsets)
    return span_hashes(buf, starts, ends), np.repeat(np.arange(len(texts)), np.diff(at)), at


_FOLD = np.arange(256, dtype=np.uint8)
_DROP = np.zeros(256, bool)
_DROP[33:48] = _DROP[58:65] = _DROP[91:97] = _DROP[123:128] = True


def folded(text: str) -> bytes:
    """Lower case, ASCII punctuation removed: what near copies are compared by."""
    return text.lower().encode().translate(None, _PUNCT)


_PUNCT = bytes(np.flatnonzero(_DROP).astype(np.uint8))


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words of one text, and the text index of each.

    A text of fewer than n words has its last n-gram cut short: it gives one hash of all its words.
    """
    if n == 1 or len(h) == 0:
        return h, doc
    last = len(h) - 1
    out = h.copy()
    idx = np.arange(len(h))
    for k in range(1, n):
        j = np.minimum(idx + k, last)
        same = (idx + k <= last) & (doc[j] == doc)
        out = np.where(same, out * np.uint64(0x9DDFEA08EB382D69) + h[j], out)
    full = (idx + n - 1 <= last) & (doc[np.minimum(idx + n - 1, last)] == doc)
    first = np.empty(len(h), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    keep = full | first
    return mix(out[keep] + np.uint64(n)), doc[keep]


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null becomes the empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
