"""Block compression and prediction of TIFF rasters: LZW both ways, horizontal and floating-point differences undone."""

from __future__ import annotations

import zlib

import numpy as np

from aerolith.schema import FormatError

#: Fixed values of the TIFF specification: LZW codes that clear the table and end a block, and the size of a full table.
CLEAR, END, FULL = 256, 257, 4094
#: Numbers of the compressions that can be read.
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def unlzw(data: bytes) -> bytes:
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = start.copy(), 9, b""
    out, held, have = [], 0, 0
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, held = held >> have, held & (1 << have) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = start.copy(), 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise FormatError("damaged LZW block")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
            if len(table) in (511, 1023, 2047):  # widths grow one code early
                width += 1
        out.append(entry)
        last = entry
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    start = {bytes((i,)): i for i in range(256)}
    table, width, size = start.copy(), 9, 258
    out, held, have = bytearray(), CLEAR, 9

    def flush() -> None:
        nonlocal held, have
        while have >= 8:
            have -= 8
            out.append(held >> have)
            held &= (1 << have) - 1

    flush()
    seen = b""
    for i in range(len(data)):
        longer = seen + data[i : i + 1]
        if longer in table:
            seen = longer
            continue
        held, have = held << width | table[seen], have + width
        flush()
        table[longer], size = size, size + 1
        if size in (512, 1024, 2048):
            width += 1
        elif size == FULL:
            held, have = held << width | CLEAR, have + width
            flush()
            table, width, size = start.copy(), 9, 258
        seen = data[i : i + 1]
    if seen:
        held, have = held << width | table[seen], have + width
        flush()
        if size + 1 in (512, 1024, 2048):
            width += 1
    held, have = held << width | END, have + width
    flush()
    if have:
        out.append(held << 8 - have & 255)
    return bytes(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return unlzw(data)
    return zlib.decompress(data) if compression in (DEFLATE, OLD_DEFLATE) else data


def packed(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw(data)
    return zlib.compress(data) if compression == DEFLATE else data


def samples(data: bytes, dtype: str, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """Rows, columns and bands of a block, its prediction undone (2: differences along a row, 3: of the bytes of floats)."""
    rows, cols, bands = shape
    kind = np.dtype(dtype)
    need = rows * cols * bands * kind.itemsize
    if len(data) < need:
        raise FormatError(f"a block of {len(data)} bytes where {need} are needed")
    if predictor == 3:
        planes = np.frombuffer(data, np.uint8, need).reshape(rows, cols * kind.itemsize, bands)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * bands)
        whole = np.ascontiguousarray(planes.transpose(0, 2, 1))  # the highest byte comes first in the file
        return whole.view(kind.newbyteorder(">")).reshape(shape)
    a = np.frombuffer(data, kind, rows * cols * bands).reshape(shape)
    if predictor == 2:
        whole = kind if kind.kind in "iu" else np.dtype(f"{kind.byteorder}u{kind.itemsize}")
        a = np.cumsum(a.view(whole), axis=1, dtype=whole.newbyteorder("=")).astype(whole, copy=False).view(kind)
    return a
