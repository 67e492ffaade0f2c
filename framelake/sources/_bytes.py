"""Files by byte range, .npy headers, and chunks of compressed arrays.

Paths are opened on executors where the data is: local ones and those of the
stores that pyarrow knows. `seekable` tells whether a root is one of them; of
other stores Spark reads whole files.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import zstandard
from pyarrow import fs

from framelake.schema import FormatError

_HEADER = 1 << 14
# Chunks of the Blosc format, fixed values: flags and the code of its zstd streams.
_SHUFFLED, _COPIED, _BIT_SHUFFLED, _WHOLE, _ZSTD = 0x1, 0x2, 0x4, 0x10, 4


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*(?=/)", "", uri) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


def seekable(uri: str) -> bool:
    try:
        place(uri)
    except Exception:  # a store that only Spark knows
        return False
    return True


def open_at(uri: str, content: bytes | None = None):
    """A seekable file."""
    if content is not None:
        return io.BytesIO(content)
    where, path = place(uri)
    return where.open_input_file(path)


def read_exactly(file, n: int) -> bytes:
    parts = []
    while n > 0 and (part := file.read(n)):
        parts.append(part)
        n -= len(part)
    if n > 0:
        raise FormatError("bad array: the file ends early")
    return b"".join(parts)


def npy_header(file) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, whether columns come first, and where the numbers start."""
    head = io.BytesIO(file.read(_HEADER))
    try:
        version = np.lib.format.read_magic(head)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(head)
    except (ValueError, EOFError) as e:
        raise FormatError(f"bad array: {e}") from e
    if dtype.hasobject:
        raise FormatError("bad array: it holds objects")
    return shape, dtype, fortran, head.tell()


def npy_head(shape: tuple[int, ...], dtype: np.dtype) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    return out.getvalue()


def unblosc(raw: bytes) -> bytes:
    """The bytes of one Blosc chunk of zstd streams."""
    if len(raw) < 16:
        raise FormatError("a chunk without a header")
    _, _, flags, size, n, block, stored = struct.unpack("<BBBBIII", raw[:16])
    if flags & _COPIED:
        return raw[16 : 16 + n]
    if flags >> 5 != _ZSTD or flags & _BIT_SHUFFLED or stored > len(raw):
        raise FormatError("a chunk that isn't of whole zstd streams")
    out, blocks = [], -(-n // block) if n else 0
    decoder = zstandard.ZstdDecompressor()
    for k, at in enumerate(struct.unpack(f"<{blocks}I", raw[16 : 16 + 4 * blocks])):
        length = min(block, n - k * block)
        whole = bool(flags & _WHOLE) or length < block or length % size or size > 16
        streams = 1 if whole else size
        parts = []
        for _ in range(streams):
            (packed,) = struct.unpack("<i", raw[at : at + 4])
            body, at = raw[at + 4 : at + 4 + packed], at + 4 + packed
            parts.append(body if packed == length // streams else decoder.decompress(body, max_output_size=length))
        one = b"".join(parts)
        if flags & _SHUFFLED and size > 1:
            turned = len(one) // size * size
            one = np.frombuffer(one[:turned], np.uint8).reshape(size, -1).T.tobytes() + one[turned:]
        out.append(one)
    return b"".join(out)


def blosc(data: bytes, size: int, level: int = 3) -> bytes:
    """One chunk of one block: shuffled by bytes and packed as a zstd stream."""
    turned = len(data) // size * size
    one = np.frombuffer(data[:turned], np.uint8).reshape(-1, size).T.tobytes() + data[turned:]
    packed = zstandard.ZstdCompressor(level=level).compress(one)
    if not data or len(packed) >= len(data):
        return struct.pack("<BBBBIII", 2, 1, _COPIED | _ZSTD << 5, size, len(data), max(1, len(data)), 16 + len(data)) + data
    flags = _SHUFFLED | _WHOLE | _ZSTD << 5
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), len(data), 24 + len(packed)) + struct.pack("<Ii", 20, len(packed)) + packed


def unpacked(raw: bytes, compressor: dict | None) -> bytes:
    """A chunk's bytes by the compressor that the array's description names."""
    if compressor is None:
        return raw
    if compressor.get("id") == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if compressor.get("id") == "blosc":
        return unblosc(raw)
    raise FormatError(f"no decoder for chunks of {compressor.get('id')}")


def pieces(data: bytes | memoryview, size: int) -> Iterator[memoryview]:
    view = memoryview(data)
    for at in range(0, len(view), size):
        yield view[at : at + size]
