"""Members of archives and compressed files, from bytes to bytes."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable

#: Decompressors by file type: bytes and name to (member name, bytes) pairs. Others may be added, as for 7z or rar.
DECOMPRESSORS: dict[str, Callable[[bytes, str], list[tuple[str, bytes]]]] = {}


def _zip(raw: bytes, name: str) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]


def _tar(raw: bytes, name: str) -> list[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        return [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]


#: Bytes that a compressed file gives at a time.
BUFFER = 10_000_000


def _single(opened: Callable[[io.BytesIO], io.IOBase]) -> Callable[[bytes, str], list[tuple[str, bytes]]]:
    def run(raw: bytes, name: str) -> list[tuple[str, bytes]]:
        with opened(io.BytesIO(raw)) as f:
            return [(name.rsplit("/", 1)[-1].rsplit(".", 1)[0], b"".join(iter(lambda: f.read(BUFFER), b"")))]

    return run


DECOMPRESSORS |= {"zip": _zip, "tar": _tar, "gz": _single(gzip.open), "bz2": _single(bz2.open), "xz": _single(lzma.open)}
