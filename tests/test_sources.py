import numpy as np
import pytest

from lumenframe.sources import codecs, exr, files, jpeg, piz, textures
from lumenframe.sources.picture import Picture, Unreadable


def picture(h=13, w=17, names=("r", "g", "b")):
    rng = np.random.default_rng(1)
    smooth = np.linspace(0, 1, h)[:, None] * np.linspace(0, 1, w)[None]
    return Picture({c: (smooth * 0.7 + rng.random((h, w)) * 0.3).astype(np.float32) for c in names}, {"note": "x"})


@pytest.mark.parametrize(
    ("name", "bits", "error"),
    [("png", 8, 1 / 254), ("png", 16, 1 / 60000), ("ppm", 8, 1 / 254), ("ppm", 16, 1 / 60000), ("pfm", None, 0), ("hdr", None, 1 / 100), ("dpx", 8, 1 / 254),
     ("dpx", 10, 1 / 1000), ("dpx", 12, 1 / 4000), ("dpx", 16, 1 / 60000), ("tiff", 8, 1 / 254), ("tiff", 16, 1 / 60000), ("tiff", 32, 0), ("exr", None, 0)],
)
def test_round_trips(name, bits, error):
    p = picture()
    b = codecs.encode(p, name, bits)
    got = codecs.decode(b)
    assert list(got.channels) == list(p.channels) and codecs.size_of(b) == (17, 13)
    for c, v in p.channels.items():
        assert np.abs(got.channels[c] - v).max() <= error


def test_png_filters_and_depths():
    import struct
    import zlib

    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (5, 12), dtype=np.uint8)
    rows = bytearray()
    for i, line in enumerate(data):
        up = data[i - 1] if i else np.zeros(12, np.uint8)
        left = np.concatenate([[0, 0, 0], line[:-3]]).astype(np.uint8)
        corner = np.concatenate([[0, 0, 0], up[:-3]]).astype(np.uint8)
        p = left.astype(int) + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros(12, int), left, up, (left.astype(int) + up) // 2, paeth][i]
        rows += bytes([i]) + ((line.astype(int) - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    b = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(rows))) + chunk(b"IEND", b"")
    got = codecs.stacked(codecs.read_png(b))
    assert np.array_equal((got * 255).round().astype(np.uint8).reshape(5, 12), data)


@pytest.mark.parametrize("compression", [exr.NONE, exr.RLE, exr.ZIPS, exr.ZIP, exr.PIZ])
@pytest.mark.parametrize("half", [False, True])
@pytest.mark.parametrize("tile", [0, 8, 64])
def test_exr_compressions(compression, half, tile):
    p = picture(37, 21, ("r", "g", "b", "a", "z"))
    b = exr.write(p, compression, half, tile)
    got = exr.read(b)
    assert codecs.size_of(b) == (21, 37)
    for c, v in p.channels.items():
        assert np.array_equal(got.channels[c], v.astype(np.float16).astype(np.float32) if half else v)


@pytest.mark.parametrize("tile", [0, 8])
def test_exr_pxr24(tile):
    p = picture(37, 21)
    got = exr.read(exr.write(p, exr.PXR24, False, tile))
    for c, v in p.channels.items():
        assert np.array_equal(got.channels[c].view(np.uint32), v.view(np.uint32) & np.uint32(0xFFFFFF00))
    half = exr.read(exr.write(p, exr.PXR24, True, tile))
    assert np.array_equal(half.channels["g"], p.channels["g"].astype(np.float16).astype(np.float32))


def test_piz_of_smooth_and_rare_values():
    for h, w in ((1, 1), (1, 40), (33, 1), (37, 53)):
        v = np.add.outer(np.arange(h), np.arange(w)).astype(np.float32) / 64
        v[h // 2 :, w // 3 :] = 0
        b = exr.write(Picture({"y": v, "z": v * 0}), exr.PIZ, True)
        assert np.array_equal(exr.read(b).channels["y"], v) and not exr.read(b).channels["z"].any()
    flat = Picture({"y": np.zeros((64, 64), np.float32)})
    assert len(exr.write(flat, exr.PIZ)) < 700
    rng = np.random.default_rng(4)
    for small in (True, False):
        words = rng.integers(0, 1 << (14 if small else 16), (29, 46))
        assert np.array_equal(piz.wavelet(piz.wavelet(words, small), small, True), words)
    # Codes longer than the look-up's 14 bits: frequencies that double.
    words = np.concatenate([np.full(1 << max(0, i - 4), i) for i in range(20)])
    words = words[rng.permutation(len(words))]
    assert np.array_equal(piz._decode(piz._encode(words), len(words)), words)


@pytest.mark.parametrize("flat", [exr.B44, exr.B44A])
def test_b44(flat):
    p = picture(37, 21)
    p.channels["r"][8:20, 4:16] = 0.5
    got = exr.read(exr.write(p, flat, True))
    for c, v in p.channels.items():
        assert np.abs(got.channels[c] - v).max() < 0.05
    assert (got.channels["r"][8:20, 4:16] == 0.5).all()
    assert np.array_equal(exr.read(exr.write(p, flat)).channels["g"], p.channels["g"])  # floats stay as they are


def test_exr_parts_levels_and_boxes():
    p, q = picture(37, 21), picture(16, 9, ("z", "crypto.id"))
    b = exr.write_parts({"beauty": p, "depth": q}, exr.PIZ)
    assert codecs.subimages(b) == 2 and codecs.describe(b, 1)[:3] == (9, 16, ["z", "crypto.id"])
    assert np.array_equal(codecs.decode(b, 1).channels["crypto.id"], q.channels["crypto.id"])
    assert np.array_equal(codecs.decode(b).channels["b"], p.channels["b"])
    assert np.array_equal(exr.read(b, box=(3, 30, 50, 36)).channels["g"], p.channels["g"][30:36, 3:])
    with pytest.raises(Unreadable):
        codecs.decode(b, 2)
    half = [Picture({c: v[: 37 >> i, : 21 >> i] for c, v in p.channels.items()}) for i in range(1, 6)]
    half[-1] = Picture({c: v[:1, :1] for c, v in p.channels.items()})
    b = exr.write(p, exr.ZIP, False, 8, half)
    assert exr.levels(exr.header(b)) == [(21, 37), (10, 18), (5, 9), (2, 4), (1, 2), (1, 1)]
    assert np.array_equal(exr.read(b, level=2).channels["r"], half[1].channels["r"])
    assert np.array_equal(exr.read(b, level=1, box=(2, 3, 9, 12)).channels["r"], half[0].channels["r"][3:12, 2:9])
    assert np.array_equal(exr.read(b).channels["r"], p.channels["r"])


@pytest.mark.parametrize("compression", [exr.NONE, exr.RLE, exr.ZIPS, exr.ZIP])
def test_exr_subsampled(compression):
    p = picture(19, 22, ("y", "BY", "RY"))
    got = exr.read(exr.write_sampled(p, {"BY": (2, 2), "RY": (2, 2)}, compression))
    assert np.array_equal(got.channels["y"], p.channels["y"])
    for c in ("BY", "RY"):
        assert np.array_equal(got.channels[c], p.channels[c][::2, ::2].repeat(2, 0).repeat(2, 1)[:19, :22])


def broken_copies(b, rng, n=60):
    for _ in range(n):
        yield b[: rng.integers(1, len(b))]
        bad = bytearray(b)
        for at in rng.integers(0, len(b), 3):
            bad[at] = rng.integers(0, 256)
        yield bytes(bad)


def test_broken_files_raise_what_tables_catch():
    rng, p = np.random.default_rng(8), picture(9, 11)
    made = [codecs.encode(p, k) for k in ("png", "exr", "tiff", "dpx", "hdr", "pfm", "ppm", "jpg")] + [exr.write(p, exr.PIZ, True), textures.write_psd(p, True), textures.write_dds(p)]
    for b in made:
        for bad in broken_copies(b, rng):
            for f in (codecs.decode, codecs.describe, codecs.subimages):
                try:
                    f(bad)
                except files.BROKEN:
                    pass


@pytest.mark.parametrize(("names", "quality", "error"), [(("y",), 100, 0.012), (("y",), 60, 0.2), (("r", "g", "b"), 100, 0.02), (("r", "g", "b"), 75, 0.3)])
def test_jpeg_round_trips(names, quality, error):
    p = picture(21, 35, names)
    b = jpeg.write(p, quality)
    got = codecs.decode(b)
    assert list(got.channels) == list(names) and codecs.size_of(b) == (35, 21)
    assert max(np.abs(got.channels[c] - v).max() for c, v in p.channels.items()) < error


def test_jpeg_against_spark(spark, tmp_path):
    """Files that Java wrote, sequential and progressive, give what Spark's own image source reads; and it reads ours."""
    jvm, p = spark._jvm, picture(45, 70)
    (tmp_path / "own.jpg").write_bytes(jpeg.write(p, 85))
    buffered = jvm.java.awt.image.BufferedImage(70, 45, 5)
    for y in range(45):
        for x in range(70):
            r, g, b = (int(p.channels[c][y, x] * 255) for c in "rgb")
            buffered.setRGB(x, y, r << 16 | g << 8 | b)
    for progressive in (False, True):
        writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
        how = writer.getDefaultWriteParam()
        how.setProgressiveMode(1 if progressive else 0)
        out = jvm.java.io.ByteArrayOutputStream()
        stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, jvm.javax.imageio.IIOImage(buffered, None, None), how)
        stream.flush()
        (tmp_path / f"java{int(progressive)}.jpg").write_bytes(bytes(out.toByteArray()))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == 3
    for r in rows:
        data = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[..., ::-1]
        with open(r.origin.removeprefix("file://"), "rb") as f:
            b = f.read()
        ours = np.round(codecs.stacked(codecs.decode(b)) * 255)
        # Colour planes that were halved are spread by repetition here and smoothly there.
        limit = 3 if r.origin.endswith("own.jpg") else 30
        assert np.abs(ours - data).max() <= limit and np.abs(ours - data).mean() < limit / 4


def test_png_interlaced():
    import struct
    import zlib

    rng = np.random.default_rng(0)
    for color, depth, per in ((2, 8, 3), (6, 16, 4), (0, 2, 1)):
        h, w = 11, 13
        data = rng.integers(0, 1 << depth, (h, w, per), dtype=np.uint16 if depth == 16 else np.uint8)
        body = b""
        for x0, y0, dx, dy in codecs.PASSES:
            part = data[y0::dy, x0::dx]
            for line in part if part.shape[1] else ():
                if depth == 2:
                    bits = np.unpackbits(line.ravel()[:, None], axis=1)[:, 6:].ravel()
                    body += b"\0" + np.packbits(bits).tobytes()
                else:
                    body += b"\0" + (line.astype(">u2") if depth == 16 else line).tobytes()
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        head = struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 1)
        b = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
        got = codecs.stacked(codecs.decode(b)) * (2**depth - 1)
        assert np.array_equal(got.round().astype(int), data)


def lzw(data):
    """Codes of 9 to 12 bits, the table cleared when it is full."""
    bits, size, width, table, now = 1 << 8, 9, 9, {bytes([i]): i for i in range(256)}, b""
    put = lambda code: (bits << width | code, size + width)
    count = 258
    for x in data:
        if now + bytes([x]) in table:
            now += bytes([x])
            continue
        bits, size = put(table[now])
        table[now + bytes([x])] = count
        count += 1
        width = min(12, max(9, count.bit_length()))
        now = bytes([x])
        if count == 4094:
            bits, size = put(table[now])
            bits, size = put(256)
            table, now, width, count = {bytes([i]): i for i in range(256)}, b"", 9, 258
    if now:
        bits, size = put(table[now])
        count += 1
        width = min(12, max(9, count.bit_length()))
    bits, size = put(257)
    return (bits << -size % 8).to_bytes((size + 7) // 8, "big")


def test_tiff_tiles_planes_pages_and_lzw():
    import struct

    rng = np.random.default_rng(5)
    data = rng.integers(0, 4, (19, 21, 3), dtype=np.uint8) * 60
    assert codecs._lzw(lzw(data.tobytes() * 20)) == data.tobytes() * 20

    def page(planar, tiled, press, at, last):
        planes = [data[..., i : i + 1] for i in range(3)] if planar else [data]
        blocks = []
        for plane in planes:
            if tiled:
                padded = np.pad(plane, ((0, 13), (0, 11), (0, 0)))
                blocks += [padded[y : y + 16, x : x + 16].tobytes() for y in (0, 16) for x in (0, 16)]
            else:
                blocks += [plane[y : y + 8].tobytes() for y in range(0, 19, 8)]
        blocks = [lzw(x) if press else x for x in blocks]
        places, body = [], b""
        for x in blocks:
            places.append(at + len(body))
            body += x
        lists = at + len(body)
        body += struct.pack(f"<{len(blocks)}I", *places) + struct.pack(f"<{len(blocks)}I", *map(len, blocks)) + struct.pack("<3H", 8, 8, 8)
        tags = [(256, 3, 1, 21), (257, 3, 1, 19), (258, 3, 3, lists + 8 * len(blocks)), (259, 3, 1, 5 if press else 1), (262, 3, 1, 2), (277, 3, 1, 3), (284, 3, 1, 2 if planar else 1)]
        tags += [(322, 3, 1, 16), (323, 3, 1, 16), (324, 4, len(blocks), lists), (325, 4, len(blocks), lists + 4 * len(blocks))] if tiled else [
            (273, 4, len(blocks), lists), (278, 3, 1, 8), (279, 4, len(blocks), lists + 4 * len(blocks))]
        begin = at + len(body)
        entries = b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 and n == 1 else struct.pack("<I", v)) for t, k, n, v in sorted(tags))
        end = begin + 2 + len(entries) + 4
        return body + struct.pack("<H", len(tags)) + entries, begin, end

    out, starts, kinds = struct.pack("<2sHI", b"II", 42, 0), [], [(p, t, z) for p in (False, True) for t in (False, True) for z in (False, True)]
    for kind in kinds:
        body, begin, _ = page(*kind, len(out), False)
        starts.append(begin)
        out += body + struct.pack("<I", 0)
    out = bytearray(out)
    struct.pack_into("<I", out, 4, starts[0])
    for a, b in zip(starts, starts[1:], strict=False):
        (n,) = struct.unpack_from("<H", out, a)
        struct.pack_into("<I", out, a + 2 + 12 * n, b)
    assert codecs.subimages(bytes(out)) == 8
    for i in range(8):
        got = codecs.stacked(codecs.decode(bytes(out), i)) * 255
        assert np.array_equal(got.round().astype(np.uint8), data), kinds[i]


def test_psd_and_dds():
    p = picture(13, 17, ("r", "g", "b", "a"))
    for b in (textures.write_psd(p), textures.write_psd(p, True), textures.write_dds(p)):
        got = codecs.decode(b)
        assert codecs.describe(b)[:3] == (17, 13, ["r", "g", "b", "a"])
        assert max(np.abs(got.channels[c] - v).max() for c, v in p.channels.items()) < 1 / 254


def test_headers_of_formats_that_are_not_decoded():
    import struct

    made = {
        "webp": b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"),
        "webp2": b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + (639 | 479 << 14).to_bytes(4, "little"),
        "webp3": b"RIFF\0\0\0\0WEBPVP8 " + bytes(4) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640, 480),
        "jp2": b"\0\0\0\x0cjP  \r\n\x87\n" + b"\0\0\0\x16ihdr" + struct.pack(">II", 480, 640),
        "heif": b"\0\0\0\x18ftypheic" + bytes(20) + b"\0\0\0\x14ispe" + bytes(4) + struct.pack(">II", 640, 480),
        "arriraw": b"ARRI" + bytes(28) + struct.pack("<II", 640, 480) + bytes(88) + b"Camera A".ljust(32, b"\0"),
        "redcode": b"RED2" + bytes(4) + struct.pack(">II", 640, 480) + bytes(48) + b"Camera B".ljust(32, b"\0"),
    }
    for name, b in made.items():
        assert codecs.probe(b) == ("webp" if name.startswith("webp") else name), name
        assert codecs.describe(b)[:2] == (640, 480), name
        with pytest.raises(Unreadable):
            codecs.decode(b)
        with pytest.raises(Unreadable):
            codecs.describe(b[:12])
    assert codecs.describe(made["arriraw"])[3] == {"camera": "Camera A"}


def test_dds_blocks():
    """A block of each kind against its definition, pixel by pixel."""
    import struct

    rng = np.random.default_rng(3)
    for code, size in ((b"DXT1", 8), (b"DXT3", 16), (b"DXT5", 16)):
        blocks = rng.integers(0, 256, (6, size), dtype=np.uint8)
        head = bytearray(128)
        struct.pack_into("<4sIIII", head, 0, b"DDS ", 124, 0, 8, 12)
        struct.pack_into("<II4s", head, 76, 32, 4, code)
        got = np.round(codecs.stacked(codecs.decode(bytes(head) + blocks.tobytes())) * 255).astype(int)
        for i, block in enumerate(blocks.astype(int).tolist()):
            colour, other = block[size - 8 :], block[:8]
            c = [colour[0] | colour[1] << 8, colour[2] | colour[3] << 8]
            wide = [[(v >> 11) * 255 // 31, (v >> 5 & 63) * 255 // 63, (v & 31) * 255 // 31] for v in c]
            for k in range(16):
                y, x = i // 3 * 4 + k // 4, i % 3 * 4 + k % 4
                pick = colour[4 + k // 4] >> 2 * (k % 4) & 3
                four = c[0] > c[1] or code != b"DXT1"
                w = {0: (1, 0), 1: (0, 1), 2: (2 / 3, 1 / 3) if four else (0.5, 0.5), 3: (1 / 3, 2 / 3) if four else (0, 0)}[pick]
                want = [w[0] * a + w[1] * b for a, b in zip(*wide, strict=True)]
                assert np.abs(got[y, x, :3] - want).max() <= 2
                if code == b"DXT1":
                    assert got[y, x, 3] == (255 if four or pick < 3 else 0)
                elif code == b"DXT3":
                    assert got[y, x, 3] == 17 * (other[k // 2] >> 4 * (k % 2) & 15)
                else:
                    place = int.from_bytes(bytes(other[2:8]), "little") >> 3 * k & 7
                    a, b = other[:2]
                    n = 7 if a > b else 5
                    line = [a, b, *(((n - j) * a + j * b) // n for j in range(1, n)), *([] if a > b else [0, 255])]
                    assert got[y, x, 3] == line[place]


@pytest.mark.parametrize("compression", [exr.NONE, exr.RLE, exr.ZIPS])
@pytest.mark.parametrize("tile", [0, 4])
def test_deep_round_trip(compression, tile):
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (6, 5))
    y, x = (np.repeat(a.ravel(), counts.ravel()) for a in np.mgrid[:6, :5])
    s = np.concatenate([np.arange(n) for n in counts.ravel()])
    samples = {"y": y, "x": x, "s": s, **{c: rng.random(len(y)).astype(np.float32) for c in ("r", "g", "b", "a", "z")}}
    got = exr.read_deep(exr.write_deep(samples, 5, 6, compression, tile))
    order = np.lexsort((got["s"], got["x"], got["y"]))
    for k, v in samples.items():
        assert np.array_equal(got[k][order], v)


def test_files_as_tables(spark, tmp_path):
    p = picture()
    (tmp_path / "a.0001.png").write_bytes(codecs.encode(p, "png"))
    (tmp_path / "b.exr").write_bytes(codecs.encode(p, "exr"))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (tmp_path / "d.txt").write_bytes(b"hello")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.images(spark, str(tmp_path)).collect()}
    assert (rows["b.exr"].width, rows["b.exr"].height, rows["b.exr"].error) == (17, 13, None)
    assert rows["c.png"].error and rows["d.txt"].error and rows["d.txt"].format == ""
    every = files.pixels(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in every.where("error IS NOT NULL").collect()} == {"c.png", "d.txt"}
    px = every.where("path LIKE '%b.exr'")
    assert px.count() == 17 * 13
    row = px.where("py = 5 AND px = 7").first()
    assert row.g == pytest.approx(float(p.channels["g"][5, 7])) and row.a is None and row.others is None
    out = files.encoded(px, "exr")
    again = codecs.decode(bytes(out.first().content))
    assert np.array_equal(again.channels["b"], p.channels["b"])
    files.save(out.selectExpr("'copy' AS path", "content"), str(tmp_path / "out"), extension=".exr")
    assert np.array_equal(codecs.decode((tmp_path / "out" / "copy.exr").read_bytes()).channels["r"], p.channels["r"])
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["copy.exr"]


def test_channels_levels_boxes_and_tiles(spark, tmp_path):
    p = picture(13, 17, ("r", "g", "b", "a", "diffuse.R", "id"))
    half = [Picture({c: v[: max(1, 13 >> i), : max(1, 17 >> i)] for c, v in p.channels.items()}) for i in range(1, 5)]
    (tmp_path / "aov.exr").write_bytes(exr.write(p, exr.ZIP, False, 8, half))
    path = str(tmp_path / "aov.exr")
    row = files.pixels(spark, path).where("py = 5 AND px = 7").first()
    assert row.others == {c: pytest.approx(float(p.channels[c][5, 7])) for c in ("diffuse.R", "id")}
    row = files.pixels(spark, path, ("id", "diffuse.R", "nothing")).where("py = 5 AND px = 7").first()
    assert row["id"] == pytest.approx(float(p.channels["id"][5, 7])) and row["diffuse.R"] is not None and row["nothing"] is None
    boxed = files.pixels(spark, path, ("r",), box=(4, 2, 9, 100)).collect()
    assert {(r.py, r.px) for r in boxed} == {(y, x) for y in range(2, 13) for x in range(4, 9)}
    assert all(r.r == pytest.approx(float(p.channels["r"][r.py, r.px])) for r in boxed)
    assert files.pixels(spark, path, ("r",), level=1).count() == 6 * 8
    assert files.pixels(spark, path, ("r",), level=9).first().error
    cut = files.tiles(spark, path, 8, "g").collect()
    assert {(t.tile_y, t.tile_x, t.height, t.width) for t in cut} == {(y, x, 8 if y == 0 else 5, 8 if x < 2 else 1) for y in range(2) for x in range(3)}
    assert np.allclose(next(t.data for t in cut if (t.tile_y, t.tile_x) == (1, 0)), p.channels["g"][8:, :8].ravel())


def test_batch_writes_its_results(spark, tmp_path):
    p = picture(8, 10, ("r", "g", "b", "a"))
    (tmp_path / "a.png").write_bytes(codecs.encode(p, "png", 16))
    (tmp_path / "b.exr").write_bytes(codecs.encode(p, "exr"))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    out = tmp_path / "out"
    run = lambda op, **how: {r.path.rsplit("/", 1)[1]: r for r in files.batch(spark, str(tmp_path / "*.*"), op, str(out), **how).collect()}
    done = run("flip_h")
    assert (done["c.png"].status, done["a.png"].target, done["b.exr"].target) == ("failed", "a.png", "b.exr") and done["c.png"].error
    assert np.array_equal(codecs.decode((out / "b.exr").read_bytes()).channels["a"], p.channels["a"][:, ::-1])
    assert sorted(f.name for f in out.iterdir()) == ["a.png", "b.exr"]
    done = run("resize", scale=0.5, format="tiff")
    assert (done["b.exr"].width, done["b.exr"].height, done["b.exr"].target) == (5, 4, "b.tiff")
    run("blur", radius=1, format="exr")
    q = np.pad(p.channels["g"].astype(float), 1, "edge")
    want = sum(q[y : y + 8, x : x + 10] for y in range(3) for x in range(3)) / 9
    assert np.allclose(codecs.decode((out / "b.exr").read_bytes()).channels["g"], want, atol=1e-6)
    assert {r.status for r in run("no such").values()} == {"failed"}


def test_deep_table(spark, tmp_path):
    samples = {"y": np.array([0, 0, 1]), "x": np.array([1, 1, 0]), "s": np.array([0, 1, 0]), "z": np.array([1, 2, 3], np.float32), "a": np.array([0.5, 0.25, 1], np.float32), "id": np.array([7, 8, 9], np.float32)}
    (tmp_path / "deep.exr").write_bytes(exr.write_deep(samples, 2, 2))
    (tmp_path / "flat.exr").write_bytes(codecs.encode(picture(), "exr"))
    (tmp_path / "bad.exr").write_bytes(exr.write_deep(samples, 2, 2)[:-9])
    every = files.deep(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in every.where("error IS NOT NULL").collect()} == {"flat.exr", "bad.exr"}
    got = every.where("error IS NULL").orderBy("y", "x", "s").collect()
    assert [(r.y, r.x, r.s, r.z, r.zback, r.a, r.r, r.others["id"]) for r in got] == [(0, 1, 0, 1, 1, 0.5, 0, 7), (0, 1, 1, 2, 2, 0.25, 0, 8), (1, 0, 0, 3, 3, 1, 0, 9)]


def test_sparse_images_keep_all_places(spark):
    """An image without its corner pixel is resized, warped and padded like any other."""
    from lumenframe.operators import geometry, sampling
    from lumenframe.operators.image import Img, Roi

    df = spark.createDataFrame([(i, y, x, 1.0) for i in range(2) for y in range(4) for x in range(4) if (i, y, x) != (1, 0, 0)], "image_id bigint, y int, x int, v double")
    img = Img(df, Roi(0, 4, 0, 4), ("v",))
    count = lambda i: {r.image_id: r["count"] for r in i.df.groupBy("image_id").count().collect()}
    assert count(geometry.pad(img, 1, 1, 1, 1, 0.0)) == {0: 36, 1: 35}
    assert count(sampling.resize(img, 8, 8, "nearest")) == {0: 64, 1: 64}
    assert count(sampling.warp(img, [[1, 0, 1], [0, 1, 0], [0, 0, 1]])) == {0: 16, 1: 16}


def test_pattern_source(spark):
    files.register(spark)
    df = spark.read.format("ramp").option("width", 8).option("height", 6).load()
    assert df.count() == 48 and df.where("y = 5 AND x = 7").first().v == 1.0
