"""Media columns: Netpbm and BMP images as bytes, numpy arrays, tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import map_batches

ROW_BYTES = 192
#: A token of a Netpbm header, after any white space and comments.
TOKEN = re.compile(rb"(?:[ \t\r\n\x0b\x0c]|#[^\r\n]*[\r\n])*([^ \t\r\n\x0b\x0c#]+)")


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Raw Netpbm (P6) of a (height, width, 3) array, or P5 of a (height, width) one."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, bottom-up, of a (height, width, 3) RGB array."""
    height, width = pixels.shape[:2]
    pad = -width * 3 % 4
    rows = np.zeros((height, width * 3 + pad), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with samples up to 255: (height, width) or (height, width, 3), uint8. Bitmaps give 0 and 255."""
    kind, at, head = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        if not (found := TOKEN.match(data, at)):
            raise ValueError("the Netpbm header ends early")
        head.append(int(found[1]))
        at = found.end()
    width, height, top = [*head, 1][:3]
    if width < 1 or height < 1:
        raise ValueError("an image without pixels")
    if not 0 < top < 256:
        raise ValueError("only samples of one byte are read")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        bits = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        flat = 1 - np.unpackbits(bits, axis=1)[:, :width]
    elif kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, width * height * depth, at + 1)
    else:
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        values = [x for x in re.findall(rb"[01]", body)] if kind == b"P1" else body.split()
        flat = np.array(values[: width * height * depth], dtype="S3").astype(np.int64)
        flat = 1 - flat if kind == b"P1" else flat
    if flat.size != width * height * depth:
        raise ValueError("the Netpbm body ends early")
    if top != 255:
        flat = (np.asarray(flat, np.int64) * 255 + top // 2) // top
    return np.asarray(flat, np.uint8).reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24-bit, 32-bit and 8-bit palette BMP as a (height, width, 3) RGB array."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if width < 1 or height == 0:
        raise ValueError("an image without pixels")
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed 8, 24 and 32 bit images are read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        return colours[rows][:, :, 2::-1].copy()
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area; cells may cut pixels. By one integral image, interpolated at the cell edges."""
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def at_edges(table: np.ndarray, cells: int) -> np.ndarray:
        edges = np.arange(cells + 1) * ((table.shape[0] - 1) / cells)
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    cells = at_edges(at_edges(sums, height).T, width).T
    area = (grey.shape[0] / height) * (grey.shape[1] / width)
    return np.diff(np.diff(cells, axis=0), axis=1) / area


def luma(pixels: np.ndarray) -> np.ndarray:
    """Rec. 601 grey in thousandths of a level: integers, so sums are exact."""
    if pixels.ndim == 2:
        return pixels.astype(np.int64) * 1000
    return pixels @ np.array([299, 587, 114], np.int64)


def difference_hash(tile: np.ndarray) -> str:
    """64 bits from an 8 x 9 tile: is each cell darker than its right neighbour?"""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), tile, allow_pickle=False)
    return out.getvalue()


def text_image(payload: bytes) -> np.ndarray:
    """A padded payload as an image of 64 pixels, 192 bytes, a row."""
    return np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW_BYTES or (0 if data else ROW_BYTES))


def encode_texts(docs: DataFrame, form: str = "both") -> DataFrame:
    """doc_id, n_bytes and media: each text's padded UTF-8 as a lossless image. form: ppm, bmp, or both, as a checksum of the text is even or odd."""

    def encode(data: bytes) -> bytes:
        as_bmp = form == "bmp" or form == "both" and zlib.crc32(data) % 2 == 1
        return (encode_bmp if as_bmp else encode_ppm)(text_image(padded(data)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("data").to_pylist()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(map(encode, texts), pa.binary())], ["doc_id", "n_bytes", "media"])

    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return map_batches(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def described(data: bytes | None) -> tuple:
    """What ``media_features`` tells of one image; of none, or of bytes that aren't one, only the fault and the bytes themselves."""
    if data is None:
        return (None,) * 7 + ("null",)
    stored = (len(data), hashlib.sha256(data).hexdigest())
    try:
        pixels = decode_image(data)
    except (ValueError, IndexError, OverflowError, struct.error) as error:
        return (None, None, None, *stored, None, None, str(error))
    payload = pixels.tobytes()
    # whole thousandths: cells that are equal but for rounding compare as equal
    tile = np.rint(area_resize(luma(pixels), 8, 9))
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, difference_hash(tile), npy(np.rint(tile / 1000).astype(np.uint8)), None)


def media_features(media: DataFrame) -> DataFrame:
    """Read each stored image back: the payload's and the media's digests, an 8 x 9 NPY tile and its difference hash, and the fault if there is one.

    Edge cases: a null image has nulls and the fault ``null``; bytes that are no whole image of a known form have
    their own length and digest, nulls, and the fault; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [described(data) for data in batch.column("media").to_pylist()]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "fault"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_batches(media, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, fault string")


def describe_texts(docs: DataFrame, form: str = "both") -> DataFrame:
    """Store every text as an image, read the images back, and describe them.

    Edge cases: null and empty texts become one row of 192 spaces; equal texts
    give equal values; a text of any length is one image, as high as it needs;
    an empty table gives no rows; other columns are ignored.
    """
    return media_features(encode_texts(docs, form))
