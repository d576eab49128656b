"""Files fetched from addresses: resumed, checked, with fallbacks, once each, several at a time; and a lock on a path."""

from __future__ import annotations

import fcntl
import hashlib
import os
import urllib.error
import urllib.parse
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

WORKERS, BLOCK = 8, 1 << 20


@dataclass(frozen=True)
class Asset:
    """An address with its fallbacks; ``checksum`` is 'algorithm:hex'; ``name`` overrides the file's name."""

    url: str
    fallbacks: tuple[str, ...] = ()
    checksum: str | None = None
    size: int | None = None
    name: str | None = None

    def file(self) -> str:
        """stem.<ten digits of the address's digest>.ext, so that equal names of different addresses don't meet."""
        if self.name:
            return self.name
        base = os.path.basename(urllib.parse.urlparse(self.url).path) or "file"
        stem, dot, ext = base.partition(".")
        return f"{stem}.{hashlib.sha256(self.url.encode()).hexdigest()[:10]}{dot}{ext}"


@contextmanager
def locked(path: str):
    """Only one process at a time holds ``path``.lock; others wait. For folders on one host or a mount that locks."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def verified(path: str, asset: Asset) -> bool:
    if asset.size is not None and os.path.getsize(path) != asset.size:
        return False
    if asset.checksum is None:
        return True
    kind, _, want = asset.checksum.partition(":")
    digest = hashlib.new(kind)
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            digest.update(block)
    return digest.hexdigest() == want.lower()


def _receive(url: str, part: str) -> None:
    have = os.path.getsize(part) if os.path.exists(part) else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    try:
        answer = urllib.request.urlopen(request, timeout=60)
    except urllib.error.HTTPError as e:
        if e.code == 416 and have:  # nothing is missing
            return
        raise
    with answer, open(part, "ab" if getattr(answer, "status", 200) == 206 else "wb") as f:
        while block := answer.read(BLOCK):
            f.write(block)


def fetch(asset: Asset, folder: str) -> str:
    """The asset's path in ``folder``: there already, or fetched from the first address that gives what it should be."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, asset.file())
    with locked(path):
        if os.path.exists(path):
            if verified(path, asset):
                return path
            os.remove(path)
        said = []
        for url in (asset.url, *asset.fallbacks):
            part = f"{path}.part"
            try:
                _receive(url, part)
            except (OSError, urllib.error.URLError) as e:
                said.append(f"{url}: {e}")
                continue
            if verified(part, asset):
                os.replace(part, path)
                return path
            os.remove(part)
            said.append(f"{url}: wrong size or checksum")
    raise OSError("; ".join(said))


def fetch_all(assets: list[Asset], folder: str) -> list[str]:
    """Paths in the order of ``assets``; equal assets are fetched once."""
    once = dict.fromkeys(assets)
    with ThreadPoolExecutor(min(WORKERS, max(1, len(once)))) as pool:
        found = dict(zip(once, pool.map(lambda a: fetch(a, folder), once), strict=True))
    return [found[a] for a in assets]
