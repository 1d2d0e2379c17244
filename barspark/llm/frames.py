"""Files of independent Zstandard frames with a record index and a trailing seek table.

Layout: frames, one skippable frame that holds the caller's record index, and one skippable frame that holds the seek
table: for each frame its compressed size, plain size and the low 32 bits of the XXH64 of its plain bytes. Sizes and
magic numbers follow the public seekable format, so other readers of that format can use the table too.
"""

from __future__ import annotations

import struct
import uuid

import xxhash
import zstandard
from pyarrow import fs as pafs

# Fixed values of the public format.
SKIPPABLE, SEEK_FRAME, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes under a temporary name; close() gives the file its own name, so a lost task leaves no half file behind."""

    def __init__(self, folder: str, name: str, level: int = 3):
        # Every attempt has a name of its own: what a lost or repeated attempt wrote is never mistaken for the result.
        self.uri = f"{folder}/{name}-{uuid.uuid4().hex}.zst"
        self.fs, self.path = place(self.uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []

    def add(self, data: bytes) -> int:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), checksum(data)))
        return len(self.table) - 1

    def close(self, index: bytes) -> str:
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = b"".join(ENTRY.pack(*x) for x in self.table)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(entries) + FOOTER.size) + entries)
        self.out.write(FOOTER.pack(len(self.table), 0x80, SEEK_FOOTER))
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri


class FrameReader:
    """Reads the footer, then only the frames that are asked for; a frame whose checksum differs raises ValueError."""

    def __init__(self, uri: str):
        fs, path = place(uri)
        self.uri, self.file = uri, fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_FOOTER:
            raise ValueError(f"{uri} has no seek table")
        table_at = size - FOOTER.size - n * ENTRY.size
        raw = self._at(table_at, n * ENTRY.size)
        self.table = [ENTRY.unpack_from(raw, i * ENTRY.size) for i in range(n)]
        self.offsets = [0]
        for packed, _, _ in self.table:
            self.offsets.append(self.offsets[-1] + packed)
        self.index_at, self.table_at = self.offsets[-1], table_at - 8
        self.zstd = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def index(self) -> bytes:
        _, size = struct.unpack("<II", self._at(self.index_at, 8))
        return self._at(self.index_at + 8, size)

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            packed, size, check = self.table[i]
            data = self.zstd.decompress(self._at(self.offsets[i], packed), max_output_size=size)
            if checksum(data) != check or len(data) != size:
                raise ValueError(f"frame {i} of {self.uri} is damaged")
            self.last = (i, data)
        return self.last[1]

    def close(self) -> None:
        self.file.close()
