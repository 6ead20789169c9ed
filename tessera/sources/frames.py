"""Files kept compressed that can still be read from any place: Zstandard's seekable format.

The data are compressed in frames of a bounded size, and a last frame that decoders skip lists their
sizes; so ``zstd -d`` gives the data back whole, and a task reads a byte range of the data without
what lies before it.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa

SUFFIX = ".zst"
FRAME = 4 << 20
_LEVEL = 1
_SKIPPED, _TABLE = 0x184D2A5E, 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")


class FrameWriter:
    """Writes data to an open file in frames, and their list on ``finish``."""

    def __init__(self, out, frame: int = FRAME):
        self._out, self._frame, self._held, self._sizes = out, frame, bytearray(), []
        self._codec = pa.Codec("zstd", compression_level=_LEVEL)

    def _put(self, data: bytes) -> None:
        packed = self._codec.compress(data, asbytes=True)
        self._out.write(packed)
        self._sizes.append((len(packed), len(data)))

    def write(self, data: bytes) -> None:
        self._held += data
        while len(self._held) >= self._frame:
            self._put(bytes(self._held[:self._frame]))
            del self._held[:self._frame]

    def finish(self) -> None:
        if self._held:
            self._put(bytes(self._held))
        table = np.array(self._sizes, dtype="<u4").tobytes() + _FOOTER.pack(len(self._sizes), 0, _TABLE)
        self._out.write(struct.pack("<II", _SKIPPED, len(table)) + table)


def _frames(f, size: int, path: str) -> np.ndarray:
    """Edges of an open file's frames: in the file and in the data."""
    if size >= _FOOTER.size:
        f.seek(size - _FOOTER.size)
        n, flags, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic == _TABLE and not flags & 0x7F:
            width = 12 if flags & 0x80 else 8  # with a checksum each, or without
            f.seek(size - _FOOTER.size - n * width)
            sizes = np.frombuffer(f.read(n * width), dtype="<u4").reshape(n, width // 4)[:, :2]
            return np.concatenate([np.zeros((1, 2), dtype=np.int64), np.cumsum(sizes, axis=0, dtype=np.int64)])
    raise ValueError(f"compressed without a list of its frames: {path}")


class FramedFile(io.RawIOBase):
    """The data of an open compressed file as a file; it holds the last frame that was read."""

    def __init__(self, f, size: int, path: str):
        self._f, self._edges, self._at, self._held = f, _frames(f, size, path), 0, (-1, b"")
        self._codec = pa.Codec("zstd")

    @property
    def size(self) -> int:
        return int(self._edges[-1, 1])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, to: int, whence: int = 0) -> int:
        self._at = max(0, to + (0, self._at, self.size)[whence])
        return self._at

    def _data(self, k: int) -> bytes:
        if self._held[0] != k:
            (start, begin), (stop, end) = self._edges[k].tolist(), self._edges[k + 1].tolist()
            self._f.seek(start)
            self._held = k, self._codec.decompress(self._f.read(stop - start), decompressed_size=end - begin, asbytes=True)
        return self._held[1]

    def readinto(self, buffer) -> int:
        if self._at >= self.size:
            return 0
        k = int(np.searchsorted(self._edges[:, 1], self._at, side="right")) - 1
        at = self._at - int(self._edges[k, 1])
        data = self._data(k)[at:at + len(buffer)]
        buffer[:len(data)] = data
        self._at += len(data)
        return len(data)

    def read(self, size: int = -1) -> bytes:
        """``size`` bytes, fewer at the end only."""
        if size is None or size < 0:
            size = max(0, self.size - self._at)
        out = []
        while size > 0 and (part := super().read(min(size, FRAME))):
            out.append(part)
            size -= len(part)
        return b"".join(out)
