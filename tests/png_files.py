"""A minimal PNG writer for test files."""

import struct
import zlib


def png_bytes(raster: bytes, width: int, height: int) -> bytes:
    """RGBA rows without a row filter."""
    rows = b"".join(b"\x00" + raster[y * width * 4:(y + 1) * width * 4] for y in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
