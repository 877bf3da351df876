"""Pictures written to disk and read back: decoding, turning, resizing, signatures, audit and cards."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import images as Im
from curatrix.sources import pictures as P


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, step, kinds):
    """Rows of bytes as their differences, each row by one of the five filters."""
    out, above = b"", np.zeros(rows.shape[1], dtype=int)
    for k, row in enumerate(rows.astype(int)):
        left = np.concatenate([np.zeros(step, int), row[:-step]])[: len(row)]
        corner = np.concatenate([np.zeros(step, int), above[:-step]])[: len(row)]
        kind = kinds[k % len(kinds)]
        nearest = [min((a, b, c), key=lambda x, p=a + b - c: abs(p - x)) for a, b, c in zip(left, above, corner)]
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: np.array(nearest)}[kind]
        out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    return out


def png(samples, colour, bits=8, kinds=(0, 1, 2, 3, 4), turn=None, palette=None, interlaced=False):
    height, width, n = samples.shape
    data = b""
    for x, y, dx, dy in P.PASSES if interlaced else ((0, 0, 1, 1),):
        part = samples[y::dy, x::dx].reshape(len(samples[y::dy]), -1)
        if part.size:
            if bits < 8:
                spread = (part[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
                rows = np.packbits(spread.reshape(len(part), -1).astype(np.uint8), axis=1)
            else:
                rows = part.astype(">u2").view(np.uint8).reshape(len(part), -1) if bits == 16 else part.astype(np.uint8)
            data += filtered(rows, max(1, n * bits // 8), kinds)
    made = P.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, int(interlaced)))
    if palette is not None:
        made += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    if turn:
        made += chunk(b"eXIf", b"MM\0*\0\0\0\x08" + struct.pack(">HHHIHH", 1, P.ORIENTATION, 3, 1, turn, 0) + b"\0\0\0\0")
    packed = zlib.compress(data)
    return made + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


def anymap(pixels, kind):
    head = f"P{kind}\n# made for a test\n{pixels.shape[1]} {pixels.shape[0]}\n255\n".encode()
    own = pixels if kind in (3, 6) else pixels[:, :, :1]
    return head + (own.tobytes() if kind > 3 else " ".join(map(str, own.ravel())).encode())


RNG = np.random.default_rng(4)


def colours(height, width):
    return RNG.integers(0, 256, (height, width, 3)).astype(np.uint8)


@pytest.mark.parametrize("interlaced", [False, True])
def test_png_of_every_kind(interlaced):
    rgb = colours(13, 10)
    shade = np.repeat(rgb[:, :, :1], 3, axis=2)
    alpha = RNG.integers(0, 256, (13, 10, 1)).astype(np.uint8)
    assert (P.pixels_of(png(rgb, 2, interlaced=interlaced)) == rgb).all()
    assert (P.pixels_of(png(np.concatenate([rgb, alpha], axis=2), 6, interlaced=interlaced)) == rgb).all()
    assert (P.pixels_of(png(shade[:, :, :1], 0, interlaced=interlaced)) == shade).all()
    assert (P.pixels_of(png(np.concatenate([shade[:, :, :1], alpha], axis=2), 4, interlaced=interlaced)) == shade).all()
    assert (P.pixels_of(png(rgb.astype(np.uint16) * 256 + 7, 2, bits=16, interlaced=interlaced)) == rgb).all()
    for bits in (1, 2, 4):
        few = RNG.integers(0, 1 << bits, (13, 10, 1))
        table = RNG.integers(0, 256, (1 << bits, 3))
        assert (P.pixels_of(png(few, 3, bits=bits, palette=table, interlaced=interlaced)) == table[few[:, :, 0]]).all()
        assert (P.pixels_of(png(few, 0, bits=bits, interlaced=interlaced)) == few * (255 // ((1 << bits) - 1))).all()


def test_anymaps_and_turns():
    rgb = colours(5, 7)
    shade = np.repeat(rgb[:, :, :1], 3, axis=2)
    for kind in (2, 3, 5, 6):
        assert (P.pixels_of(anymap(rgb, kind)) == (rgb if kind in (3, 6) else shade)).all()
    wide = b"P5 2 1 65535\n" + bytes([0x80, 0, 0xFF, 0xFF])
    assert P.pixels_of(wide)[0, :, 0].tolist() == [128, 255]
    turned = {2: rgb[:, ::-1], 3: np.rot90(rgb, 2), 4: rgb[::-1], 5: rgb.swapaxes(0, 1), 6: np.rot90(rgb, -1), 7: np.rot90(rgb, 2).swapaxes(0, 1), 8: np.rot90(rgb)}
    for turn, want in turned.items():
        assert (P.pixels_of(png(rgb, 2, turn=turn)) == want).all(), turn


def test_broken_pictures():
    whole = png(colours(4, 4), 2)
    for content in (b"", b"no picture", whole[:40], whole[:-30], whole.replace(b"IHDR", b"JHDR"), b"P6 4 4 255\n123", b"P5 0 3 255\n", b"P5 99999999 99999999 255\n1", png(colours(2, 2)[:, :, :1] % 4, 3, bits=2), b"P5 x"):
        with pytest.raises(P.BrokenPicture):
            P.pixels_of(content)


def test_resampling_keeps_what_it_should():
    rgb = colours(9, 12)
    assert (P.resampled(rgb, 12, 9) == rgb).all()
    flat = np.full((40, 30, 3), 77, dtype=np.uint8)
    assert (P.resampled(flat, 7, 100) == 77).all()
    ramp = np.repeat(np.repeat(np.arange(0, 240, 2, dtype=np.uint8)[None, :, None], 10, axis=0), 3, axis=2)
    small = P.resampled(ramp, 12, 10)[0, :, 0].astype(int)
    assert (abs(small[2:-2] - ramp[0].reshape(12, 10, 3).mean(axis=1)[2:-2, 0]) <= 1).all()  # where the kernel lies inside, a ramp stays one
    # One row by hand: halving 4 pixels with the widened kernel.
    x = np.array([10.0, 20, 200, 240])
    near = lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
    weights = np.array([[near(abs(k + 0.5 - c) / 2) for k in range(4)] for c in (1, 3)])
    want = np.floor((weights / weights.sum(axis=1, keepdims=True)) @ x + 0.5).clip(0, 255)
    assert P.resampled(x.astype(np.uint8).reshape(1, 4, 1), 2, 1).ravel().tolist() == want.tolist()
    assert P.grey(np.array([[[255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255]]], dtype=np.uint8)).tolist() == [[255, 76, 150, 29]]


def test_facts_of_known_pixels():
    grid = np.array([[3, 1, 1, 2, 9, 8, 7, 7, 8]] * 8, dtype=np.uint8)
    facts = Im.picture_facts([np.repeat(grid[:, :, None], 3, axis=2)])
    bits = bytes([0, 0, 1, 1, 0, 0, 0, 1] * 8)
    assert facts["dhash"] == [hashlib.sha256(bits).hexdigest()] and (facts["width"], facts["height"]) == ([9], [8])
    flat = np.zeros((16, 16, 3), dtype=np.uint8)
    flat[:, :, 0], flat[:8, :, 1], flat[:, :, 2] = 51, 255, 102
    facts = Im.picture_facts([flat, flat])
    values = np.sort(np.array([0.2] * 256 + [1.0] * 128 + [0.0] * 128 + [0.4] * 256))
    assert facts["features"][1] == pytest.approx([0.2, 0.5, 0.4, 0.0, 0.5, 0.0, *np.quantile(values, [0.1, 0.5, 0.9])])
    assert facts["signature"][0] == hashlib.sha256(bytes(64) + bytes([3, 8, 6])).hexdigest()
    assert Im.brighter_to_the_right(np.array([[[0, 255], [255, 0]]], dtype=np.uint8)).tolist() == [[True, False]]


def test_capped_pictures_and_tiles(spark):
    big = colours(100, 200)
    width, height = spark.range(1).select(Im.capped_size(F.lit(200), F.lit(100), 5000).alias("s")).first()["s"]
    assert Im.capped(big, 5000).shape == (height, width, 3) and Im.capped(big, 20_000) is big
    made = Im.tiles(big, 20)
    assert made.shape == (3, 20, 20, 3)  # two by one, and the thumbnail
    want = (P.resampled(big, 40, 20) / 255.0 - Im.CHANNEL_MEANS) / Im.CHANNEL_DEVIATIONS
    assert np.allclose(made[0], want[:, :20]) and np.allclose(made[1], want[:, 20:]) and Im.tiles(colours(30, 30), 8).shape == (1, 8, 8, 3)


def test_pictures_from_disk_to_cards(spark, tmp_path):
    """Files of three formats and a broken one, through the reader, the decoder, the audit and the cards."""
    small, large = colours(30, 40), colours(230, 300)
    files = {"a.png": png(small, 2, turn=6), "b.ppm": anymap(large, 6), "c.png": png(large, 2, kinds=(2,)), "broken.png": png(small, 2)[:50], "d.pgm": anymap(small, 5)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    read = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    decoded = Im.decode(read)
    rows = {r["path"]: r["picture"] for r in decoded.collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["height"]) == (30, 40) and rows["broken.png"]["broken"] and rows["broken.png"]["dhash"] is None
    assert rows["b.ppm"]["dhash"] == rows["c.png"]["dhash"] and rows["b.ppm"]["features"] == rows["c.png"]["features"] != rows["a.png"]["features"]
    plain = P.resampled(np.rot90(small, -1), 16, 16) / 255.0
    assert rows["a.png"]["features"][:6] == pytest.approx([*plain.mean(axis=(0, 1)), *plain.std(axis=(0, 1))])
    audit = Im.picture_audit(decoded).first()
    assert tuple(audit) == (5, 1, 2, 1, 170.0, 135.0)
    reduced = {r["path"]: r["picture"] for r in Im.decode(read, most_pixels=10_000).collect()}
    assert (reduced["b.ppm"]["width"], reduced["b.ppm"]["height"]) == (112, 84) and reduced["a.png"]["width"] == 30
    cards = spark.createDataFrame([("1", ["b.ppm", "broken.png", "c.png"]), ("2", ["broken.png", "none.png"]), ("3", []), ("4", None)], "id string, images array<string>")
    got = {r["id"]: r for r in Im.card_pictures(cards, decoded).collect()}
    assert got["1"]["features"] == pytest.approx(rows["b.ppm"]["features"]) and got["1"]["broken"] == 1 and got["1"]["present"]
    assert got["1"]["stats"] == pytest.approx([np.log1p(300), np.log1p(230), 300 / 230, 0.0])
    assert [got[k]["present"] for k in "234"] == [False] * 3 and got["2"]["broken"] == 2
    tiled = Im.tiled(read, side=16).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in tiled}.keys() == {"a.png", "b.ppm", "c.png", "d.pgm"}
    assert Im.decode(spark.createDataFrame([(None,)], "content binary")).first()["picture"]["broken"]
