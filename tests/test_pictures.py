"""Decoders against files that the platform's image library writes, and files put together by hand."""

import struct
import zipfile
import zlib

import numpy as np
import pytest

from tessera import api
from tessera.operators import pictures, png, raster
from tessera.options import options
from tessera.plans import atlases
from tessera.sources import images


def picture(h=13, w=21, seed=0, colours=256):
    rng = np.random.default_rng(seed)
    rgb = rng.integers(0, colours, (h, w, 3)).astype(np.uint8)
    rgb[3:9, 2:15] = (200, 10, 30)  # something that runs
    return np.dstack((rgb, np.full((h, w), 255, np.uint8)))


def written(spark, pixels, kind, java_type):
    """The file that ImageIO makes of the pixels."""
    jvm = spark.sparkContext._jvm
    h, w = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, java_type)
    for y in range(h):
        for x in range(w):
            r, g, b, a = (int(v) for v in pixels[y, x])
            image.setRGB(x, y, (a << 24 | r << 16 | g << 8 | b) - ((a >> 7) << 32))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize(("kind", "java_type"), [("png", 2), ("png", 5), ("bmp", 5), ("bmp", 1)])
def test_files_of_the_platforms_library(spark, kind, java_type):
    p = picture()
    if java_type == 2:
        p[..., 3] = np.random.default_rng(1).integers(1, 256, p.shape[:2])
    data = written(spark, p, kind, java_type)
    assert (pictures.read_image(data) == p).all() and pictures.image_size(data) == (21, 13)


def test_gif(spark):
    few = picture(40, 50, 2)
    few[..., :3] = few[..., :3] // 128 * 255  # eight colours, which a palette holds
    few[3:9, 2:15, :3] = (255, 0, 255)
    data = written(spark, few, "gif", 5)
    assert (pictures.read_image(data) == few).all() and pictures.image_size(data) == (50, 40)
    with pytest.raises(ValueError, match="GIF"):
        pictures.read_image(b"GIF89a" + bytes(7) + b"?")


def chunked(w, h, depth, colour, laced, raw, *more):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced)) + b"".join(chunk(k, b) for k, b in more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("laced", [0, 1])
def test_png_of_all_depths(depth, laced):
    rng = np.random.default_rng(depth)
    h, w = 11, 9
    grey = rng.integers(0, 1 << depth, (h, w))

    def packed(part):
        if depth == 16:
            return b"".join(b"\0" + row.astype(">u2").tobytes() for row in part)
        bits = (part[..., None] >> np.arange(depth - 1, -1, -1)) & 1
        return b"".join(b"\0" + np.packbits(row.reshape(-1).astype(np.uint8)).tobytes() for row in bits)

    raw = b"".join(packed(grey[y::dy, x::dx]) for x, y, dx, dy in png.PASSES if grey[y::dy, x::dx].size) if laced else packed(grey)
    eight = grey >> 8 if depth == 16 else grey * 255 // ((1 << depth) - 1)
    got = pictures.read_image(chunked(w, h, depth, 0, laced, raw))
    assert (got[..., :3] == eight[..., None]).all() and (got[..., 3] == 255).all()
    keyed = pictures.read_image(chunked(w, h, depth, 0, laced, raw, (b"tRNS", struct.pack(">H", int(grey[2, 3])))))
    assert ((keyed[..., 3] == 0) == (grey == grey[2, 3])).all()
    if depth <= 8:
        palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
        clear = bytes(range(min(3, 1 << depth)))
        got = pictures.read_image(chunked(w, h, depth, 3, laced, raw, (b"PLTE", palette.tobytes()), (b"tRNS", clear)))
        assert (got[..., :3] == palette[grey]).all() and (got[..., 3] == np.where(grey < len(clear), grey, 255)).all()


def test_tga_and_maps():
    p = picture(5, 7)
    p[..., 3] = 9
    head = lambda kind, bits, flags, palette=b"", n=0: struct.pack("<BBBHHBHHHHBB", 3, 1 if n else 0, kind, 0, n, 24 if n else 0, 0, 0, 7, 5, bits, flags) + b"abc" + palette
    bgra = p[..., [2, 1, 0, 3]]
    assert (pictures.read_image(head(2, 32, 0x28) + bgra.tobytes()) == p).all()
    assert (pictures.read_image(head(2, 24, 0) + bgra[::-1, :, :3].tobytes())[..., :3] == p[..., :3]).all()
    runs = b"".join(b"\x84" + bgra[y, 0].tobytes() + b"\x01" + bgra[y, 1].tobytes() + bgra[y, 2].tobytes() for y in range(5))
    got = pictures.read_image(head(10, 32, 0x28) + runs)
    assert (got[:, :5] == p[:, :1]).all() and (got[:, 5:] == p[:, 1:3]).all()
    assert (pictures.read_image(head(3, 8, 0x20) + p[..., 0].tobytes())[..., :3] == p[..., :1]).all()
    palette, index = p[:, :, :3].reshape(-1, 3), np.arange(35, dtype=np.uint8)
    assert (pictures.read_image(head(1, 8, 0x20, palette[:, ::-1].tobytes(), 35) + index.tobytes())[..., :3] == p[..., :3]).all()
    assert pictures.image_size(head(2, 32, 0x28)) == (7, 5)
    maps = b"P6 # of colours\n7 5\n# and depth\n255\n" + p[..., :3].tobytes()
    assert (pictures.read_image(maps)[..., :3] == p[..., :3]).all() and pictures.image_size(maps) == (7, 5)
    deep = b"P5\n7 5\n65535\n" + (p[..., 0].astype(">u2") * 257).tobytes()
    assert (pictures.read_image(deep)[..., :3] == p[..., :1]).all()
    for broken in (b"", b"what is this", b"P6 7"):
        with pytest.raises(ValueError, match="unknown|portable"):
            pictures.read_image(broken)


def photo(h, w, seed):
    """Something smooth with edges, as JPEG is made for."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    rgb = np.stack([127 + 120 * np.sin(x / (5 + c) + y / (9 - c) + rng.random()) for c in range(3)], axis=2)
    rgb[h // 4 : h // 2, w // 3 : w // 2] = rng.integers(0, 256, 3)
    return np.dstack((rgb.astype(np.uint8), np.full((h, w), 255, np.uint8)))


def jpeg(spark, pixels, java_type, quality, progressive):
    """The JPEG file that ImageIO makes of the pixels."""
    jvm = spark.sparkContext._jvm
    h, w = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, java_type)
    for y in range(h):
        for x in range(w):
            r, g, b, _ = (int(v) for v in pixels[y, x])
            image.setRGB(x, y, (255 << 24 | r << 16 | g << 8 | b) - (1 << 32))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    how.setProgressiveMode(1 if progressive else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    writer.getOutput().flush()
    writer.dispose()
    return bytes(out.toByteArray())


def test_jpegs_are_as_sparks_image_source_reads_them(spark, tmp_path):
    folder, kinds = tmp_path / "sheets", {}
    (folder / "in").mkdir(parents=True)
    for k, (h, w, java_type, quality, progressive) in enumerate([(16, 24, 5, 0.9, False), (33, 47, 5, 0.75, False), (40, 17, 5, 0.5, True), (9, 70, 10, 0.8, False), (31, 31, 10, 0.95, True), (64, 3, 5, 0.8, True), (1, 1, 5, 0.8, False)]):
        data = jpeg(spark, photo(h, w, k), java_type, quality, progressive)
        (folder / "in" / f"p{k}.jpg").write_bytes(data)
        kinds[f"p{k}.jpg"] = (w, h)
        assert pictures.image_size(data) == (w, h)
    seen = {r["origin"].rsplit("/", 1)[1]: r for r in spark.read.format("image").option("recursiveFileLookup", True).load(str(folder)).select("image.*").collect()}
    for name in kinds:
        theirs = np.frombuffer(bytes(seen[name]["data"]), np.uint8).reshape(seen[name]["height"], seen[name]["width"], -1)
        theirs = theirs[..., ::-1] if theirs.shape[2] == 3 else theirs
        ours = pictures.read_image((folder / "in" / name).read_bytes())
        off = np.abs(ours[..., :3].astype(int) - theirs)
        assert off.max() <= 3 and off.mean() < 0.1, name  # theirs transforms in integers
    # Beside other files, some of which are broken or only look like pictures.
    (folder / "in" / "z.png").write_bytes(png.write_png(photo(5, 6, 1)))
    (folder / "in" / "bad.jpg").write_bytes(b"broken")
    (folder / "in" / "cut.jpeg").write_bytes((folder / "in" / "p1.jpg").read_bytes()[:-200])
    for o in (options(), options(deduplicate="exact")):
        found, left_out = api.read_folder(spark, str(folder), o)
        assert {r["path"].rsplit("/", 1)[1]: (r["w"], r["h"]) for r in found.collect() if not r["path"].endswith("jpeg")} == kinds | {"z.png": (6, 5)}
        assert {r["path"].rsplit("/", 1)[1] for r in left_out.collect()} == ({"bad.jpg", "cut.jpeg"} if o.deduplicate == "exact" else {"bad.jpg"})
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.write(folder / "in" / "p2.jpg", "p2.jpg")
    members = images.archived(spark.read.format("binaryFile").load(str(tmp_path / "a.zip")))
    assert [(r["w"], r["h"]) for r in images.metadata(members, trim=True).collect()] == [(17, 40)]


def test_jpegs_with_restarts_and_inks():
    """A file put together by hand: grey blocks of one level each, a restart after each, and one that says four colours."""
    head = b"\xff\xd8" + b"\xff\xdb\x00\x43\x00" + bytes([8] * 64) + b"\xff\xdd\x00\x04\x00\x01"
    tables = b"".join(b"\xff\xc4" + (19 + len(symbols)).to_bytes(2, "big") + bytes([kind]) + bytes([0, len(symbols)] + [0] * 14) + bytes(symbols) for kind, symbols in ((0, [0, 3]), (16, [0])))
    def made(components, units, extra=b""):
        frame = b"\xff\xc0" + (8 + 3 * components).to_bytes(2, "big") + bytes([8, 0, 8]) + (8 * units).to_bytes(2, "big") + bytes([components]) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(components))
        scan = b"\xff\xda" + (6 + 2 * components).to_bytes(2, "big") + bytes([components]) + b"".join(bytes([c + 1, 0]) for c in range(components)) + b"\0\x3f\0"
        return head + extra + frame + tables + scan
    # Codes: 00 for no difference, 01 for one of three bits; 00 ends a block.
    block = lambda bits: int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    grey = made(1, 3) + block("0111100") + b"\xff\xd0" + block("0100000") + b"\xff\xd1" + block("0000") + b"\xff\xd9"
    got = pictures.read_image(grey)
    assert got.shape == (8, 24, 4) and [int(got[0, x, 0]) for x in (0, 8, 16)] == [135, 121, 128]
    inks = made(4, 1, b"\xff\xee\x00\x0eAdobe\x00\x64\x00\x00\x00\x00\x00") + block("0111100" + "0000" * 3) + b"\xff\xd9"
    assert pictures.read_image(inks)[0, 0].tolist() == [round(135 * 128 / 255), round(128 * 128 / 255), round(128 * 128 / 255), 255]
    for broken in (grey[:40], grey.replace(b"\xff\xd1", b"\xff\xd9"), made(2, 1) + b"\0\xff\xd9"):
        with pytest.raises(ValueError, match="JPEG|buffer"):
            pictures.read_image(broken)


def bits_packed(row):
    """PackBits with runs where bytes repeat."""
    out, k = b"", 0
    while k < len(row):
        n = 1
        while k + n < len(row) and row[k + n] == row[k] and n < 128:
            n += 1
        out += bytes([257 - n, row[k]]) if n > 1 else bytes([0, row[k]])
        k += n
    return out


def psd(planes, depth=8, packed=True, mode=3):
    n, h, w = planes.shape
    rows = [planes[c, y].astype(">u2" if depth == 16 else "u1").tobytes() for c in range(n) for y in range(h)]
    body = b"".join(rows)
    if packed:
        short = [bits_packed(r) for r in rows]
        body = b"".join(len(r).to_bytes(2, "big") for r in short) + b"".join(short)
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, n, h, w, depth, mode)
    return head + struct.pack(">I", 0) + struct.pack(">I4s", 4, b"rsrc") + struct.pack(">I", 0) + struct.pack(">H", int(packed)) + body


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("depth", [8, 16])
def test_photoshop_documents(packed, depth):
    p = picture(9, 14, 5)
    planes = p[..., :3].transpose(2, 0, 1).astype(int)
    data = psd(planes * 257 if depth == 16 else planes, depth, packed)
    assert pictures.image_size(data) == (14, 9) and (pictures.read_image(data) == p).all()
    grey = pictures.read_image(psd(planes[:1], 8, packed, 1))
    assert (grey[..., :3] == p[..., :1]).all()
    alpha = np.full((9, 14), 255)
    alpha[0], alpha[1] = 0, 128
    on_white = np.rint(planes * alpha / 255 + 255 - alpha).astype(int)
    clear = pictures.read_image(psd(np.concatenate((on_white, alpha[None])), 8, packed))
    assert (clear[..., 3] == alpha).all() and (clear[2:] == p[2:]).all() and np.abs(clear[1, :, :3].astype(int) - p[1, :, :3]).max() <= 1
    for broken in (data[:30], data[:-3], data[:22] + b"\0\x08\0\x09" + data[26:]):
        with pytest.raises(ValueError, match="PSD|buffer"):
            pictures.read_image(broken)


@pytest.mark.parametrize("w", [5, 21])
def test_radiance_maps(w):
    rng = np.random.default_rng(w)
    light = rng.random((6, w, 3)) ** 3 * 1.2
    light[2, 3:5] = 0
    top = light.max(axis=2)
    e = np.where(top > 0, np.ceil(np.log2(np.where(top > 0, top, 1))).astype(int) + 1, 0)
    mantissa = np.floor(light * np.where(top > 0, np.ldexp(1.0, 8 - e), 0)[..., None]).clip(0, 255).astype(np.uint8)
    rgbe = np.dstack((mantissa, np.where(top > 0, e + 128, 0).astype(np.uint8)))
    head = b"#?RADIANCE\n# made\nFORMAT=32-bit_rle_rgbe\n\n-Y 6 +X %d\n" % w
    if w < 8:
        body = rgbe.tobytes()
    else:
        body = b""
        for y in range(6):
            body += b"\2\2" + w.to_bytes(2, "big")
            for c in range(4):
                row = rgbe[y, :, c].tobytes()
                body += bytes([128 + w, row[0]]) if len(set(row)) == 1 else bytes([4]) + row[:4] + bytes([w - 4]) + row[4:]
    got = pictures.read_image(head + body)
    known = rgbe[..., :3] * np.where(rgbe[..., 3:] > 0, np.ldexp(1.0, rgbe[..., 3:].astype(int) - 136), 0)
    assert pictures.image_size(head + body) == (w, 6) and (got[..., :3] == np.clip(known ** (1 / 2.2) * 255 + 0.5, 0, 255).astype(np.uint8)).all()
    with pytest.raises(ValueError, match="HDR"):
        pictures.read_image((head + body)[:-2])


def test_softimage_pictures():
    p = picture(4, 140, 6)
    p[1, :, 0] = 7
    p[..., 3] = 9
    head = bytearray(104)
    head[:4], head[88:92], head[92:96] = b"\x53\x80\xf6\x34", b"PICT", struct.pack(">HH", 140, 4)
    body = b""
    for y in range(4):
        for x in range(0, 140, 70):  # three channels in mixed runs
            body += bytes([69]) + p[y, x : x + 70, :3].tobytes()
        body += bytes([128]) + struct.pack(">H", 140) + b"\x09"  # alpha in one long run
    data = bytes(head) + bytes([1, 8, 2, 0xE0, 0, 8, 2, 0x10]) + body
    assert pictures.image_size(data) == (140, 4) and (pictures.read_image(data) == p).all()
    plain = bytes(head) + bytes([0, 8, 0, 0xE0]) + p[..., :3].tobytes()
    assert (pictures.read_image(plain)[..., :3] == p[..., :3]).all() and (pictures.read_image(plain)[..., 3] == 255).all()
    runs = bytes(head) + bytes([0, 8, 1, 0xE0]) + b"".join(bytes([1]) + p[y, x, :3].tobytes() for y in range(4) for x in range(140))
    assert (pictures.read_image(runs)[..., :3] == p[..., :3]).all()
    for broken in (data[:-1], data[:90], plain[:200]):
        with pytest.raises(ValueError, match="PIC|unknown"):
            pictures.read_image(broken)


def test_broken_files_give_errors_and_the_rest_goes_on(spark):
    sheet = np.zeros((12, 12, 4), np.uint8)
    sheet[2:6, 3:9] = (1, 2, 3, 255)
    good = png.write_png(sheet)
    sheets = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(b"no image"))], "path string, content binary")
    found = atlases.found_frames(sheets).collect()
    assert sorted((r["file"], r["x"], r["y"], r["w"], r["h"], r["error"] is None) for r in found if r["file"] == "good") == [("good", 3, 2, 6, 4, True)]
    assert [(r["index"], r["error"]) for r in found if r["file"] == "bad"] == [(None, "ValueError: unknown format")]
    frames = spark.createDataFrame([(f, 0, "a", 3, 2, 6, 4, False) for f in ("good", "bad")] + [("good", 1, "b", 9, 9, 9, 9, False)], "file string, index int, name string, x int, y int, w int, h int, rotated boolean")
    cut = atlases.cut_frames(sheets, frames)
    assert sorted((r["file"], r["name"], r["error"]) for r in cut.collect()) == [("bad", "a", "ValueError: unknown format"), ("good", "a.png", None), ("good", "b", "outside the sheet")]
    tars = {r["file"]: r for r in atlases.tarred(cut.where("name <> 'b'")).collect()}
    assert tars["bad"]["error"] and bytes(tars["good"]["content"])[257:262] == b"ustar"
    archives = spark.createDataFrame([("x.zip", None, bytearray(b"no archive"))], "path string, modificationTime timestamp, content binary")
    assert [(r["path"], r["content"], r["error"] is None) for r in images.archived(archives).collect()] == [("x.zip", None, False)]
    placed = [(1, 0, p, 0, 0, 0, 6, 4, 3, t, 3, 6, False) for p, t in (("good", 2),)] + [(2, 0, "bad", 0, 0, 0, 6, 4, 3, 2, 3, 6, False), (3, 0, "good", 0, 9, 9, 6, 4, 3, 2, 3, 6, False), (4, 0, "good", 0, 0, 0, 6, 4, 9, 2, 3, 6, False)]
    sprites = spark.createDataFrame(placed, "job long, seq long, path string, atlas_index int, x int, y int, w int, h int, trim_left int, trim_top int, trim_right int, trim_bottom int, rotated boolean")
    rooms = spark.createDataFrame([(j, 0, 8, 8) for j in range(1, 5)], "job long, atlas_index int, width int, height int")
    out = {r["job"]: r for r in atlases.composed(sprites, rooms, sheets).collect()}
    assert (png.read_png(bytes(out[1]["content"]))[:4, :6] == sheet[2:6, 3:9]).all() and out[1]["error"] is None
    assert [out[j]["error"].split(":")[0] for j in (2, 3, 4)] == ["ValueError"] * 3 and "outside" in out[3]["error"] and "trims" in out[4]["error"]
    assert atlases.at_index(rooms, 1).count() == 0


def flooded(pixels, tolerance, least):
    """The components one pixel at a time."""
    h, w = pixels.shape[:2]
    solid, colour, seen, found = pixels[..., 3] != 0, pixels[..., :3].astype(int), np.zeros(pixels.shape[:2], bool), []
    for y, x in np.argwhere(solid):
        if seen[y, x]:
            continue
        stack, own = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            own.append((a, b))
            for c in range(max(0, a - 1), min(h, a + 2)):
                for d in range(max(0, b - 1), min(w, b + 2)):
                    if not seen[c, d] and (solid[c, d] or np.abs(colour[a, b] - colour[c, d]).sum() < tolerance):
                        seen[c, d] = True
                        stack.append((c, d))
        ys, xs = zip(*own, strict=True)
        if len(own) >= least:
            box = (int(min(xs)), int(min(ys)), int(max(xs) - min(xs) + 1), int(max(ys) - min(ys) + 1))
            found.append((-box[2] * box[3], len(found), box))
    return [b for _, _, b in sorted(found)]


@pytest.mark.parametrize("tolerance", [1, 121])
def test_components_are_those_of_a_flood(tolerance):
    rng = np.random.default_rng(tolerance)
    for _ in range(60):
        p = rng.integers(0, 3, (*rng.integers(1, 14, 2), 4)).astype(np.uint8) * 120
        p[..., 3] = (rng.random(p.shape[:2]) < 0.4) * 255
        assert raster.components(p, tolerance, 2) == flooded(p, tolerance, 2)
