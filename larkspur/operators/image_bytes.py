"""Bytes of uploaded images: what they are, their size before decoding, and the same image without metadata."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.tiles import GREY

# Magic bytes, the segments and chunks that hold metadata, the limits.
JPEG, PNG = b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n"
JPEG_METADATA = (0xE1, 0xED, 0xFE)  # APP1 (EXIF, XMP), APP13 (IPTC), COM
#: Chunks that change what is shown, and no others: what isn't known may be personal.
PNG_KEPT = (b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"iCCP", b"sBIT", b"pHYs", b"bKGD")
#: Samples of a pixel by colour type.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MAX_BYTES, MAX_PIXELS = 15 * 1024 * 1024, 50_000_000

_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, whole segment) up to the start of scan, which stands for all that follows it."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0xDA:
            yield marker, data[at:]
            return
        alone = marker == 0x01 or 0xD0 <= marker <= 0xD9
        end = at + 2 if alone else at + 2 + struct.unpack_from(">H", data, at + 2)[0]
        if end > len(data) or (not alone and end < at + 4):
            raise ValueError("a segment runs past the end")
        yield marker, data[at:end]
        at = end
    raise ValueError("no scan")


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, whole chunk) up to the last one."""
    at = len(PNG)
    while at + 12 <= len(data):
        end = at + 12 + struct.unpack_from(">I", data, at)[0]
        kind, chunk = data[at + 4 : at + 8], data[at:end]
        if end > len(data) or zlib.crc32(chunk[4:-4]) != struct.unpack(">I", chunk[-4:])[0]:
            raise ValueError("a damaged chunk")
        yield kind, chunk
        if kind == b"IEND":
            return
        at = end
    raise ValueError("no end")


def check_png_pixels(parts: list[tuple[bytes, bytes]]) -> None:
    """Inflates the pixels, some at a time, and counts them: an error if they aren't all there or can't be read."""
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1][8:21])
    if colour not in PNG_SAMPLES or depth not in (1, 2, 4, 8, 16) or interlace > 1:
        raise ValueError("an unknown kind of pixels")
    bits = PNG_SAMPLES[colour] * depth
    if interlace:
        starts, steps = ((0, 0), (0, 4), (4, 0), (0, 2), (2, 0), (0, 1), (1, 0)), ((8, 8), (8, 8), (8, 4), (4, 4), (4, 2), (2, 2), (2, 1))
        sizes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for (y, x), (dy, dx) in zip(starts, steps, strict=True)]
    else:
        sizes = [(height, width)]
    want = sum(h * (1 + -(-w * bits // 8)) for h, w in sizes if h > 0 and w > 0)
    reader, found = zlib.decompressobj(), 0
    try:
        for kind, chunk in parts:
            rest = chunk[8:-4] if kind == b"IDAT" else b""
            while rest and not reader.eof:
                found += len(reader.decompress(rest, 1 << 20))
                rest = reader.unconsumed_tail
                if found > want:
                    break
    except zlib.error as error:
        raise ValueError("pixels can't be read") from error
    if found < want:
        raise ValueError("pixels are missing")


def inspect(data: bytes | None) -> tuple[str | None, int | None, int | None, str | None, bytes | None]:
    """(format, width, height, problem, clean bytes): the pixels' data is copied as it is, the size read from the header."""
    if not data:
        return None, None, None, "empty", None
    if len(data) > MAX_BYTES:
        return None, None, None, "too large", None
    kind = "jpeg" if data.startswith(JPEG) else "png" if data.startswith(PNG) else None
    if kind is None:
        return None, None, None, "not an image", None
    try:
        if kind == "jpeg":
            parts = list(jpeg_segments(data))
            frame = next(s for m, s in parts if m in _FRAMES)
            height, width = struct.unpack_from(">HH", frame, 5)
            clean = data[:2] + b"".join(s for m, s in parts if m not in JPEG_METADATA)
        else:
            parts = list(png_chunks(data))
            if parts[0][0] != b"IHDR":
                raise ValueError("no header")
            width, height = struct.unpack_from(">II", parts[0][1], 8)
            clean = PNG + b"".join(c for k, c in parts if k in PNG_KEPT)
            if 0 < width * height <= MAX_PIXELS:
                check_png_pixels(parts)
    except (ValueError, StopIteration, struct.error, IndexError):
        return kind, None, None, "undecodable", None
    if not width or not height:
        return kind, width, height, "undecodable", None
    if width * height > MAX_PIXELS:
        return kind, width, height, "too many pixels", None
    return kind, width, height, None, clean


def png(width: int, height: int, grey: bytes) -> bytes:
    """A grey 8-bit PNG of rows of pixels; equal pixels give equal bytes."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + grey[y * width : (y + 1) * width] for y in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = list(zip(*map(inspect, part.column(1).to_pylist()), strict=True))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "format", "width", "height", "problem", "clean"])


def check_images(images: DataFrame) -> DataFrame:
    """(id, format, width, height, problem, clean) of images (id, body); a problem leaves no clean bytes."""
    kind = images.schema["id"].dataType.simpleString()
    schema = f"id {kind}, format string, width int, height int, problem string, clean binary"
    return images.select("id", "body").mapInArrow(_checked, schema)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(id, body, length) of all files below a path: what is longer than MAX_BYTES isn't read, and has no body.

    Lengths come from the file system's listing, so a file that is too large costs nothing but its name. Files of
    no bytes aren't among them: Spark's sources pass over those.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = found.where(F.col("length") <= MAX_BYTES).select(F.col("path").alias("id"), F.col("content").alias("body"), "length")
    large = found.where(F.col("length") > MAX_BYTES).select(F.col("path").alias("id"), F.lit(None).cast("binary").alias("body"), "length")
    return read.unionByName(large)


def checked_uploads(spark: SparkSession, path: str) -> DataFrame:
    """check_images of all files below a path, with the digest of the clean bytes, which are what is stored."""
    files = uploads(spark, path)
    small = check_images(files.where(F.col("length") <= MAX_BYTES)).withColumn("sha256", F.sha2("clean", 256))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema if f.name not in ("id", "problem")]
    large = files.where(F.col("length") > MAX_BYTES).select("id", F.lit("too large").alias("problem"), *none)
    return small.unionByName(large)


def _encoded(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [png(width, len(p) // width, bytes(p)) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["id", "body"])


def encode_png(rasters: DataFrame, width: int = 8) -> DataFrame:
    """(id, body): rasters (vec_id, px) as PNG files."""
    return rasters.select("vec_id", "px").mapInArrow(lambda b: _encoded(b, width), "id long, body binary")


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> Iterator[bytes]:
    """Rows of a PNG's bytes: each was told by its difference from what is left of it, above it, or both."""
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        at = y * (stride + 1)
        kind, row = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1)
        if kind == 1:
            row = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            own, up = row.tolist(), above.tolist()
            for i in range(stride):
                left, corner = (own[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
                own[i] = (own[i] + guess) & 255
            row = np.array(own, np.uint8)
        elif kind:
            raise ValueError("an unknown filter")
        above = row
        yield row.tobytes()


def _png_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, sizes, ys, px = [], [], [], []
        for i, body in enumerate(batch.column(1).to_pylist()):
            if inspect(body)[3] is not None or not body.startswith(PNG):
                continue
            parts = list(png_chunks(body))
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1][8:21])
            if depth != 8 or colour not in (0, 2, 4, 6) or interlace:
                continue
            samples = PNG_SAMPLES[colour]
            raw = zlib.decompress(b"".join(c[8:-4] for k, c in parts if k == b"IDAT"))
            for y, row in enumerate(_unfiltered(raw, height, width * samples, samples)):
                p = np.frombuffer(row, np.uint8).reshape(width, samples)
                grey = p[:, 0] if samples < 3 else ((p[:, :3].astype(np.int32) @ GREY + (1 << 13)) >> 14).astype(np.uint8)
                at.append(i)
                sizes.append((width, height))
                ys.append(y)
                px.append(np.ascontiguousarray(grey).tobytes())
        w, h = zip(*sizes, strict=True) if sizes else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int32())), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(ys, pa.int32()), pa.array(px, pa.binary())],
            names=["image", "width", "height", "y", "px"],
        )


def png_rows(images: DataFrame) -> DataFrame:
    """(image, width, height, y, px): grey rows of pixels of PNG files (id, body) with eight bits a sample.

    Transparency is passed over. Files that aren't such, or can't be read, have no rows: check_images tells which.
    """
    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "body").mapInArrow(_png_rows, f"image {kind}, width int, height int, y int, px binary")
