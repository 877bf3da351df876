"""Decoding pictures into pixels: PNG and portable any-maps by zlib and numpy, other formats by a picture library where one is installed."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

#: Fixed values of the formats: PNG's signature, samples a pixel by colour type, the passes of interlacing (x, y, step x, step y), luma weights of 65,536.
PNG = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
LUMA = (19595, 38470, 7471)
ORIENTATION = 0x0112
#: Pixels of the largest picture that is decoded; a few bytes can claim any size.
MOST_PIXELS = 1 << 28


class BrokenPicture(ValueError):
    """What can't be decoded."""


def pixels_of(content: bytes) -> np.ndarray:
    """The upright picture as an array (height, width, 3) of bytes; fails with BrokenPicture."""
    try:
        if content.startswith(PNG):
            return _png(content)
        if content[:1] == b"P" and content[1:2] in b"2356":
            return _anymap(content)
    except (struct.error, zlib.error, ValueError, IndexError, KeyError, TypeError) as problem:
        raise BrokenPicture(str(problem)) from problem
    return _library(content)


def _library(content: bytes) -> np.ndarray:
    try:
        from PIL import Image, ImageOps
    except ImportError as problem:
        raise BrokenPicture("this format needs a picture library") from problem
    try:
        return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB"))
    except (OSError, ValueError, SyntaxError) as problem:
        raise BrokenPicture(str(problem)) from problem


def _sized(width: int, height: int) -> None:
    if not (0 < width and 0 < height and width * height <= MOST_PIXELS):
        raise BrokenPicture(f"a picture of {width} x {height}")


def _rgb(samples: np.ndarray) -> np.ndarray:
    """Grey or coloured samples (height, width, n) as three channels; alpha is left out."""
    n = samples.shape[2]
    return np.ascontiguousarray(np.repeat(samples[:, :, :1], 3, axis=2) if n < 3 else samples[:, :, :3])


def _anymap(content: bytes) -> np.ndarray:
    """P2, P3 (numbers in words) and P5, P6 (bytes, or pairs of them)."""
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while content[end : end + 1].isdigit():
            end += 1
        fields.append(int(content[at:end]))
        at = end
    width, height, most = fields
    _sized(width, height)
    if not 0 < most < 1 << 16:
        raise BrokenPicture(f"a largest value of {most}")
    channels = 3 if content[1:2] in b"36" else 1
    n = width * height * channels
    if content[1:2] in b"23":
        values = np.array([int(x) for x in content[at:].split()[:n]])
    else:
        raw = content[at + 1 :]
        values = np.frombuffer(raw[: n * (1 + (most > 255))], dtype=">u2" if most > 255 else np.uint8).astype(np.int64)
    if len(values) < n:
        raise BrokenPicture("the pixels end early")
    return _rgb(((np.minimum(values, most) * 255 + most // 2) // most).astype(np.uint8).reshape(height, width, channels))


def _png(content: bytes) -> np.ndarray:
    at, data, palette, turn, head = 8, [], None, 1, None
    while True:
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise BrokenPicture("the file ends early")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"eXIf":
            turn = exif_orientation(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    width, height, bits, colour, _, _, interlaced = head
    _sized(width, height)
    samples = SAMPLES[colour]
    raw = zlib.decompress(b"".join(data))
    whole = np.zeros((height, width, samples), dtype=np.uint16)
    start = 0
    for x, y, step_x, step_y in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // step_x), -(-(height - y) // step_y)
        if w > 0 and h > 0:
            line = (w * samples * bits + 7) // 8
            part = np.frombuffer(raw[start : start + h * (line + 1)], np.uint8).reshape(h, line + 1)
            start += h * (line + 1)
            whole[y::step_y, x::step_x] = _unpacked(_unfiltered(part, max(1, samples * bits // 8)), bits)[:, : w * samples].reshape(h, w, samples)
    if colour == 3:
        if palette is None:
            raise BrokenPicture("a palette is missing")
        return upright(palette[whole[:, :, 0]], turn)
    if bits != 8:
        whole = whole >> 8 if bits == 16 else whole * (255 // ((1 << bits) - 1))
    return upright(_rgb(whole.astype(np.uint8)), turn)


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Each row's bytes from its differences to the left, the row above, their mean or the nearest of three neighbours."""
    above = np.zeros(rows.shape[1] - 1, dtype=np.uint8)
    out = np.empty((len(rows), len(above)), dtype=np.uint8)
    for k, row in enumerate(rows):
        kind, line = row[0], row[1:]
        if kind == 1:
            padded = np.zeros(-(-len(line) // step) * step, dtype=np.uint8)
            padded[: len(line)] = line
            line = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = _sequential(line.tolist(), above.tolist(), step, kind)
        elif kind != 0:
            raise BrokenPicture(f"a filter of type {kind}")
        out[k] = above = line
    return out


def _sequential(line: list[int], above: list[int], step: int, kind: int) -> np.ndarray:
    """The two filters in which a byte depends on the one decoded just before."""
    for k, value in enumerate(line):
        left, up = (line[k - step] if k >= step else 0), above[k]
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = above[k - step] if k >= step else 0
            guess = min((left, up, corner), key=lambda x, p=left + up - corner: abs(p - x))
        line[k] = (value + guess) & 255
    return np.array(line, dtype=np.uint8)


def _unpacked(rows: np.ndarray, bits: int) -> np.ndarray:
    """Samples of a row of bytes."""
    if bits == 8:
        return rows.astype(np.uint16)
    if bits == 16:
        return rows.reshape(len(rows), -1, 2).astype(np.uint16) @ np.array([256, 1], dtype=np.uint16)
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(len(rows), -1).astype(np.uint16)


def exif_orientation(body: bytes) -> int:
    """The orientation, 1 to 8, that a block of EXIF data names in its first directory; 1 if none."""
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    if order is None:
        return 1
    (at,) = struct.unpack(order + "I", body[4:8])
    (n,) = struct.unpack(order + "H", body[at : at + 2])
    for k in range(n):
        tag, _, _, value = struct.unpack(order + "HHIH", body[at + 2 + 12 * k : at + 12 + 12 * k])
        if tag == ORIENTATION and 1 <= value <= 8:
            return value
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """The picture as it is meant to be seen, from how it is stored: mirrored for 2, 4, 5 and 7, with sides exchanged from 5 on."""
    if turn >= 5:
        pixels = pixels.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


def resampled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture at another size: bicubic (a = -0.5), its kernel widened where the picture shrinks; first along rows, then along columns."""
    made = pixels.astype(np.float64)
    for axis, size in ((1, width), (0, height)):
        if made.shape[axis] != size:
            made = np.moveaxis(np.tensordot(_kernel(made.shape[axis], size), made, axes=(1, axis)), 0, axis)
            made = np.clip(np.floor(made + 0.5), 0, 255)
    return made.astype(np.uint8)


def _kernel(old: int, new: int) -> np.ndarray:
    """Weights (new, old) of the old places in each new one."""
    scale = max(1.0, old / new)
    centres = (np.arange(new) + 0.5) * old / new
    x = np.abs((np.arange(old)[None, :] + 0.5 - centres[:, None]) / scale)
    near, far = 1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2
    weights = np.where(x < 1, near, np.where(x < 2, far, 0.0))
    return weights / weights.sum(axis=1, keepdims=True)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of the three channels."""
    return ((pixels.astype(np.int64) @ np.array(LUMA) + (1 << 15)) >> 16).astype(np.uint8)
