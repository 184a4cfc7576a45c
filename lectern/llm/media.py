"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .workers import tidy


BAND = 1 << 14  # rows summed at once


def write_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def write_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey, rows from the bottom up; rows are padded to 4 bytes."""
    h, w = pixels.shape
    pad = -w % 4
    body = np.pad(pixels[::-1], ((0, 0), (0, pad))).tobytes()
    at = 14 + 40 + 1024
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    grey[:, 3] = 0
    return struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, len(body), 2835, 2835, 256, 0) + grey.tobytes() + body


def _netpbm_fields(raw: bytes, n: int) -> tuple[list[int], int]:
    """The next ``n`` numbers of a header from byte 2 on, comments left out, and where the byte after them stands."""
    out, at = [], 2
    while len(out) < n:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        out.append(int(raw[at:end]))
        at = end
    return out, at


def read_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6: height x width x channels, 8 or 16 bits; bitmaps as 0 (black) and 255."""
    kind = raw[1] - 48
    if raw[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not Netpbm")
    bitmap, deep = kind in (1, 4), 3 if kind in (3, 6) else 1
    head, at = _netpbm_fields(raw, 2 if bitmap else 3)
    w, h = head[:2]
    top = 1 if bitmap else head[2]
    if not 0 < top < 65536 or w < 1 or h < 1:
        raise ValueError("bad Netpbm header")
    if kind == 4:
        rows = np.frombuffer(raw, np.uint8, h * -(-w // 8), at + 1).reshape(h, -1)
        return ((1 - np.unpackbits(rows, axis=1)[:, :w]) * 255).astype(np.uint8)[:, :, None]
    if kind == 1:
        bits = np.frombuffer(bytes(c for c in raw[at:] if c in b"01"), np.uint8)[: h * w] - 48
        return ((1 - bits.reshape(h, w)) * 255).astype(np.uint8)[:, :, None]
    if kind < 4:
        return np.array(raw[at:].split()[: h * w * deep], np.uint16 if top > 255 else np.uint8).reshape(h, w, deep)
    return np.frombuffer(raw, ">u2" if top > 255 else np.uint8, h * w * deep, at + 1).reshape(h, w, deep)


def read_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; one channel where every used colour is grey."""
    if raw[:2] != b"BM":
        raise ValueError("not BMP")
    (at,), (size, w, h, _, bits, packed) = struct.unpack_from("<I", raw, 10), struct.unpack_from("<IiiHHI", raw, 14)
    used = struct.unpack_from("<I", raw, 46)[0] if size >= 40 else 0
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w < 1 or h == 0:
        raise ValueError("BMP of a kind that isn't read")
    line = -(-w * bits // 32) * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(h), at).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    colours = np.frombuffer(raw, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits < 8:
        each = 8 // bits
        shifts = np.arange(each)[::-1] * bits
        rows = ((rows[:, :, None] >> shifts.astype(np.uint8)) & ((1 << bits) - 1)).reshape(abs(h), -1)
    index = rows[:, :w]
    if (colours == colours[:, :1]).all():
        return np.ascontiguousarray(colours[:, 0][index])[:, :, None]
    return colours[index]


def read_image(raw: bytes) -> np.ndarray:
    return read_bmp(raw) if raw[:2] == b"BM" else read_netpbm(raw)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell (cells may cut pixels), from the integral image; float64. Beside the picture it holds
    some target height x width numbers, however high the picture."""
    h, w = image.shape[:2]

    def cuts(n: int, m: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(m + 1) * (n / m)
        lo = np.minimum(x.astype(np.int64), n - 1)
        return lo, (x - lo).reshape((-1,) + (1,) * (rank - 1))

    # Rows of the integral image are only needed at the cells' edges: it is summed up in bands, never held whole.
    lo, part = cuts(h, height, 3)
    at = np.unique(np.concatenate([lo, lo + 1]))
    rows, above, first = np.zeros((len(at), w + 1, image.shape[2])), np.zeros((w, image.shape[2])), 0
    for k, end in enumerate(at):
        while first < end:
            last = min(first + BAND, end)
            above = above + image[first:last].sum(0, dtype=np.float64)
            first = last
        rows[k, 1:] = above.cumsum(0)
    low, high = rows[np.searchsorted(at, lo)], rows[np.searchsorted(at, lo + 1)]
    edges = (low * (1 - part) + high * part).swapaxes(0, 1)
    lo, part = cuts(w, width, 3)
    corner = (edges[lo] * (1 - part) + edges[lo + 1] * part).swapaxes(0, 1)
    cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return cells / (h / height * (w / width))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """size x size bits: is a cell of the grey, area-resized picture darker than its right neighbour?"""
    small = resize_area(image.mean(2, keepdims=True) if image.shape[2] > 1 else image, size, size + 1)[:, :, 0]
    return np.packbits(small[:, :-1] < small[:, 1:] - 1e-9).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """Texts as pictures: (id, n_bytes, media). The UTF-8 bytes, zero-padded to a positive multiple of ``width``, are the
    grey samples of a picture ``width`` wide: PGM where the number of rows is even, BMP where it is odd. Null: empty.
    A null id stays; repeated rows are pictures of their own; an empty table gives no row; other columns aren't read,
    whatever their names. A picture is held whole in memory, as its text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media, sizes = [], []
            for raw in pc.fill_null(b.column(text_col), "").cast(pa.binary()).to_pylist():
                pixels = np.frombuffer(raw + bytes(-len(raw) % width if raw else width), np.uint8).reshape(-1, width)
                media.append((write_bmp if len(pixels) % 2 else write_pgm)(pixels))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(df: DataFrame, media_col: str = "media", tile: int = 32) -> DataFrame:
    """``df`` with height, width, channels, pixels (row by row, channels last), tile (the picture area-resized to tile x
    tile, 8 bits, as NPY bytes), dhash and error. Bytes that are null or aren't read leave all but error null. Columns of these
    names are replaced, others pass through; repeated rows stay; an empty table gives no row."""
    made = {"height": pa.int32(), "width": pa.int32(), "channels": pa.int32(), "pixels": pa.binary(), "tile": pa.binary(), "dhash": pa.string(), "error": pa.string()}
    df = df.drop(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(media_col).to_pylist():
                try:
                    image = read_image(raw or b"")
                    small = np.clip(np.rint(resize_area(image, tile, tile)), 0, 65535 if image.itemsize > 1 else 255).astype(image.dtype)
                    rows.append((*image.shape, image.tobytes(), npy(small), difference_hash(image), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((*[None] * 6, str(e)[:200]))
            cols = list(zip(*rows, strict=True)) or [[] for _ in made]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(cols, made.values(), strict=True))], names=[*b.schema.names, *made])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "height int, width int, channels int, pixels binary, tile binary, dhash string, error string"])
    return df.mapInArrow(tidy(run), fields)
