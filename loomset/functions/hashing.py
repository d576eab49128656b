"""Digests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verify(content: Column, checksum: Column) -> Column:
    """Whether ``content`` has the checksum ``algorithm:hex`` (md5, sha1 or sha256); an unknown algorithm gives null."""
    algorithm, want = F.lower(F.split_part(checksum, F.lit(":"), F.lit(1))), F.lower(F.split_part(checksum, F.lit(":"), F.lit(2)))
    got = F.when(algorithm == "md5", F.md5(content)).when(algorithm == "sha1", F.sha1(content)).when(algorithm == "sha256", F.sha2(content, 256))
    return got == want


def short_digest(*parts: Column | str, length: int = 16) -> Column:
    """The first characters of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)
