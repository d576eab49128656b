"""Frame and image arrays in numpy: layouts, scaling, area resize, crops, compositing, and a PNG codec of the standard library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

LAYOUTS = ("THWC", "TCHW", "CTHW")


def to_layout(frames: np.ndarray, layout: str, scale: bool = False) -> np.ndarray:
    """THWC frames in another layout; ``scale`` gives float32 in [0, 1]."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    out = frames.astype(np.float32) / 255 if scale else frames
    return np.ascontiguousarray(out.transpose({"THWC": (0, 1, 2, 3), "TCHW": (0, 3, 1, 2), "CTHW": (3, 0, 1, 2)}[layout]))


def channels_first(image: np.ndarray) -> np.ndarray:
    """An HWC or grey image of bytes as float32 CHW in [0, 1]."""
    a = image if image.ndim == 3 else image[..., None]
    return np.ascontiguousarray(a.astype(np.float32).transpose(2, 0, 1) / 255)


def _weights(n: int, m: int) -> np.ndarray:
    edges = np.arange(m + 1) * n / m
    at = np.arange(n)
    w = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """HWC image resized by area averages."""
    out = np.einsum("ah,hwc,bw->abc", _weights(image.shape[0], height), image.astype(np.float64), _weights(image.shape[1], width))
    return np.rint(out).clip(0, 255).astype(np.uint8) if image.dtype == np.uint8 else out.astype(image.dtype)


def crop(image: np.ndarray, height: int, width: int, mode: str = "center", seed: int = 0) -> np.ndarray:
    h, w = image.shape[:2]
    if height > h or width > w:
        raise ValueError(f"crop {height}x{width} is larger than {h}x{w}")
    if mode == "center":
        y, x = (h - height) // 2, (w - width) // 2
    elif mode == "random":
        r = np.random.default_rng(seed)
        y, x = int(r.integers(h - height + 1)), int(r.integers(w - width + 1))
    else:
        raise ValueError(f"unknown crop {mode}")
    return image[y : y + height, x : x + width]


def normalise(x: np.ndarray, mean, std) -> np.ndarray:
    """(x - mean) / max(std, 1e-6) by the last axis."""
    return (x - np.asarray(mean)) / np.maximum(np.asarray(std), 1e-6)


def patches(image: np.ndarray, size: int) -> np.ndarray:
    """Non-overlapping square patches, row by row."""
    h, w, c = image.shape
    if h % size or w % size:
        raise ValueError("the image doesn't divide into patches")
    return image.reshape(h // size, size, w // size, size, c).transpose(0, 2, 1, 3, 4).reshape(-1, size, size, c)


def tinted(mask: np.ndarray, row: int, seed: int = 0) -> np.ndarray:
    """A 0/1 mask in a colour that the seed and row decide."""
    colour = np.random.default_rng([seed, row]).uniform(0.5, 1.0, 3)
    return np.rint(mask[..., None] * colour * 255).astype(np.uint8)


def over_noise(mask: np.ndarray, row: int, seed: int = 0) -> np.ndarray:
    """A 0/1 mask in white over noise that the seed and row decide."""
    noise = np.random.default_rng([seed, row]).uniform(0, 1, (*mask.shape, 3))
    return np.rint(np.minimum(mask[..., None] + noise, 1) * 255).astype(np.uint8)


def inverted_patch(image: np.ndarray, row: int, size: int, seed: int = 0) -> np.ndarray:
    """The image with one square patch of inverted bytes at a place that the seed and row decide."""
    h, w = image.shape[:2]
    if size > min(h, w):
        raise ValueError(f"a patch of {size} is larger than {h}x{w}")
    r = np.random.default_rng([seed, row])
    y, x = int(r.integers(h - size + 1)), int(r.integers(w - size + 1))
    out = image.copy()
    out[y : y + size, x : x + size] = 255 - out[y : y + size, x : x + size]
    return out


def png(image: np.ndarray) -> bytes:
    """Grey, RGB or RGBA bytes as PNG."""
    a = np.ascontiguousarray(image if image.ndim == 3 else image[..., None], np.uint8)
    h, w, c = a.shape
    kind = {1: 0, 3: 2, 4: 6}[c]
    raw = np.hstack([np.zeros((h, 1), np.uint8), a.reshape(h, w * c)]).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """HWC bytes of an 8-bit grey, RGB or RGBA PNG that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body += part
        at += 12 + n
    w, h, depth, kind, _, _, interlaced = head
    c = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or interlaced or c is None:
        raise ValueError("this kind of PNG isn't read")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    up = np.zeros(w * c, np.int64)
    for y in range(h):
        f, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if f == 0:
            now = line
        elif f == 2:
            now = (line + up) & 255
        else:
            now = np.zeros(w * c, np.int64)
            for x in range(w * c):
                left, above, corner = (now[x - c] if x >= c else 0), up[x], (up[x - c] if x >= c else 0)
                if f == 1:
                    guess = left
                elif f == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                now[x] = (line[x] + guess) & 255
        out[y] = now
        up = now
    return out.reshape(h, w, c)
