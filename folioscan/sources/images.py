"""Image decoding to height x width x 3 bytes in BGR order: PNG, BMP and PNM here, other formats by an image library if there is one."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

PNG_MARK = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_image(data: bytes | None) -> np.ndarray | None:
    """BGR pixels, or None for what can't be read."""
    data = bytes(data or b"")
    try:
        if data.startswith(PNG_MARK):
            return _png(data)
        if data.startswith(b"BM"):
            return _bmp(data)
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data)
        return _by_library(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None


def _grey_or_rgb(pixels: np.ndarray) -> np.ndarray:
    rgb = np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]
    return np.ascontiguousarray(rgb[:, :, ::-1])


def _png(data: bytes) -> np.ndarray | None:
    at, packed, palette, head = len(PNG_MARK), [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if not head:
        return None
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        return _by_library(data)
    step = CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width + 1, step), np.int64)  # a row and a column of zeros come before
    for y in range(height):
        _unfilter(int(rows[y, 0]), rows[y, 1:].reshape(width, step).astype(np.int64), out[y], out[y + 1])
    pixels = out[1:, 1:].astype(np.uint8)
    return _grey_or_rgb(palette[pixels[:, :, 0]] if colour == 3 else pixels)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, out: np.ndarray) -> None:
    """Undo one row's filter; above and out begin with a pixel of zeros."""
    if kind == 0:
        out[1:] = row
    elif kind == 1:
        out[1:] = np.cumsum(row, axis=0) & 255
    elif kind == 2:
        out[1:] = (row + above[1:]) & 255
    elif kind in (3, 4):
        for x in range(len(row)):
            left, up, corner = out[x], above[x + 1], above[x]
            if kind == 3:
                guess = (left + up) // 2
            else:
                near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
            out[x + 1] = (row[x] + guess) & 255
    else:
        raise ValueError("unknown filter")


def _bmp(data: bytes) -> np.ndarray | None:
    start, _, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packing not in (0, 3):
        return _by_library(data)
    step = bits // 8
    stride = (width * step + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    pixels = rows[:, : width * step].reshape(abs(height), width, step)[:, :, :3]
    return np.ascontiguousarray(pixels[::-1] if height > 0 else pixels)


def _pnm(data: bytes) -> np.ndarray | None:
    head = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not head or int(head[4]) != 255:
        return None
    step, width, height = 3 if head[1] == b"6" else 1, int(head[2]), int(head[3])
    pixels = np.frombuffer(data, np.uint8, width * height * step, head.end()).reshape(height, width, step)
    return _grey_or_rgb(pixels)


def _by_library(data: bytes) -> np.ndarray | None:
    try:
        import io

        from PIL import Image, UnidentifiedImageError
    except ImportError:
        return None
    try:
        return np.ascontiguousarray(np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))[:, :, ::-1])
    except (UnidentifiedImageError, OSError):
        return None
