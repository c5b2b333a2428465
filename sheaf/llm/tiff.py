"""TIFF images in a column: one row per page with its decoded samples and features.

``read_pages`` walks the chain of image directories of each file (both byte orders, sub-directories
apart), decodes strips or tiles packed with no compression, PackBits, LZW or deflate, undoes
horizontal prediction, joins planes, and gives samples in row order. ``write_tiff`` is the
counterpart: a grey image of 8-bit samples in strips or tiles.

The query stores each text as an image 576 samples wide, deflated after horizontal prediction, and
reads it back. A page that cannot be decoded is a row with an ``error`` and no samples; so is a file
whose header is none. Defined results: a null file gives no rows; a null or empty text is one row of
padding; equal texts give equal files; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import query, slices, table

WIDTH = 576
ROWS_PER_STRIP = 256
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Larger pages are refused rather than decoded.
MAX_PAGE_BYTES = 1 << 30
MAX_PAGES = 65_535

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at:at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at:at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and data[at:at + 1] == data[at + run:at + run + 1]:
            run += 1
        if run > 2:
            out += bytes([257 - run]) + data[at:at + 1]
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and data[end:end + 1] * 3 != data[end:end + 3]:
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


_CLEAR, _STOP = 256, 257


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that grow one code early."""
    out: list[bytes] = []
    codes = [bytes([i]) for i in range(256)] + [b"", b""]
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == _STOP:
            break
        if code == _CLEAR:
            del codes[258:]
            width, last = 9, b""
            continue
        if code > len(codes) or code == len(codes) and not last:
            raise ValueError("bad LZW code")
        piece = codes[code] if code < len(codes) else last + last[:1]
        out.append(piece)
        if last:
            codes.append(last + piece[:1])
        last = piece
        width = min(12, max(9, (len(codes) + 1).bit_length()))
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    codes: dict[bytes, int] = {}
    next_code, width = 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def clear() -> None:
        nonlocal next_code, width
        put(_CLEAR)
        codes.clear()
        codes.update((bytes([i]), i) for i in range(256))
        next_code, width = 258, 9

    clear()
    piece = b""
    for i in range(len(data)):
        longer = piece + data[i:i + 1]
        if longer in codes:
            piece = longer
            continue
        put(codes[piece])
        codes[longer] = next_code
        next_code += 1
        piece = data[i:i + 1]
        width = min(12, next_code.bit_length())
        if next_code == 4094:
            clear()
    if piece:
        put(codes[piece])
        width = min(12, (next_code + 1).bit_length())
    put(_STOP)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _decode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression}")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """The integer fields of a directory by tag, and where the next one is."""
    n, = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * count
        where = at + 10 + 12 * i
        if size > 4:
            where, = struct.unpack_from(order + "I", data, where)
        if kind in _FORMATS and where + size <= len(data):
            fields[tag] = struct.unpack_from(f"{order}{count}{_FORMATS[kind]}", data, where)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, f: dict[int, tuple], order: str) -> tuple[np.ndarray, int]:
    """The samples (rows, columns, samples of a pixel) of a directory, and its compression."""
    one = lambda tag, default=None: f.get(tag, (default,))[0]
    width, height = one(256), one(257)
    if not width or not height:
        raise ValueError("no size")
    depth, samples = f.get(258, (1,)), one(277, 1)
    if len(set(depth)) != 1 or depth[0] not in (8, 16, 32):
        raise ValueError(f"bits {depth}")
    kind = np.dtype(f"{order}u{depth[0] // 8}")
    if width * height * samples * kind.itemsize > MAX_PAGE_BYTES:
        raise ValueError("page too large")
    compression, predictor, planar = one(259, NONE), one(317, 1), one(284, 1) == 2 and samples > 1
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    inside = 1 if planar else samples
    tiled = 322 in f
    across, down = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    starts, counts = f.get(324 if tiled else 273, ()), f.get(325 if tiled else 279, ())
    columns, rows = -(-width // across), -(-height // down)
    if len(starts) < columns * rows * (samples if planar else 1) or len(counts) < len(starts):
        raise ValueError("missing strips")
    out = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    for k in range(columns * rows * (samples if planar else 1)):
        plane, at = divmod(k, columns * rows)
        top, left = at // columns * down, at % columns * across
        high = down if tiled else min(down, height - top)
        if starts[k] + counts[k] > len(data):
            raise ValueError("strip beyond the end")
        raw = _decode(data[starts[k]:starts[k] + counts[k]], compression)
        need = high * across * inside * kind.itemsize
        if len(raw) < need:
            raise ValueError("short strip")
        part = np.frombuffer(raw[:need], dtype=kind).astype(out.dtype).reshape(high, across, inside)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        keep = part[:height - top, :width - left]
        if planar:
            out[top:top + high, left:left + across, plane] = keep[:, :, 0]
        else:
            out[top:top + high, left:left + across] = keep
    return out, compression


def pages_of(data: bytes) -> Iterator[tuple[int, np.ndarray | None, int | None, str | None]]:
    """(page, samples, compression, error) for every directory of a file."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        yield 0, None, None, "not a TIFF"
        return
    at, page, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at and at not in seen and page < MAX_PAGES:
        seen.add(at)
        try:
            fields, at = _directory(data, at, order)
        except struct.error:
            yield page, None, None, "directory beyond the end"
            return
        try:
            yield page, *_page(data, fields, order), None
        except (ValueError, zlib.error, struct.error) as e:
            yield page, None, fields.get(259, (NONE,))[0], str(e)
        page += 1


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, order: str = "<",
               tile: int | None = None) -> bytes:
    """A file of grey images of 8-bit samples, one directory each."""
    pack = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[compression]
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for image in pages:
        height, width = image.shape
        down, across = (tile, tile) if tile else (ROWS_PER_STRIP, width)
        starts, counts = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                part = image[top:top + down, left:left + across]
                if tile:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1])))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), dtype=np.uint8))
                packed = pack(np.ascontiguousarray(part).tobytes())
                starts.append(len(out))
                counts.append(len(packed))
                out += packed
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]),
                  (277, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, starts), (325, 4, counts)] if tile else \
            [(273, 4, starts), (278, 4, [ROWS_PER_STRIP]), (279, 4, counts)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            value = struct.pack(f"{order}{len(values)}{_FORMATS[kind]}", *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                value, where = struct.pack(order + "I", len(out)), value
                out += where
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        out[link:link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def page_feature(samples: np.ndarray) -> str:
    """Size, mean, spread, and a difference hash over a grid of 9 by 8 means."""
    height, width = samples.shape[:2]
    grey = samples.reshape(height, -1)
    rows = [grey[i * height // 8:max(i * height // 8 + 1, (i + 1) * height // 8)].mean(axis=0, dtype=np.float64) for i in range(8)]
    cells = np.stack([[r[k * len(r) // 9:max(k * len(r) // 9 + 1, (k + 1) * len(r) // 9)].mean() for k in range(9)] for r in rows])
    bits = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"{width}x{height} mean={grey.mean(dtype=np.float64):.4f} std={grey.std(dtype=np.float64):.4f} dhash={bits}"


PAGES = (
    "key string, page int, width int, height int, samples int, bits int, compression int, "
    "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"
)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), 64):
            rows = []
            for key, data in zip(frame["key"][at:at + 64], frame["media"][at:at + 64]):
                if data is None:
                    continue
                for page, samples, compression, error in pages_of(data):
                    if error:
                        rows.append((key, page, None, None, None, None, compression, None, None, None, None, error))
                        continue
                    payload = samples.tobytes()
                    height, width, inside = samples.shape
                    rows.append((key, page, width, height, inside, samples.itemsize * 8, compression, len(payload),
                                 hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), page_feature(samples), None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")]).astype(
                {c: "Int64" for c in ("page", "width", "height", "samples", "bits", "compression", "payload_bytes", "tail_crc32")})


def read_pages(files: DataFrame) -> DataFrame:
    """One row per page of the files (key, media): sizes, digests and features of its samples."""
    return files.select(F.col("key").cast("string"), "media").mapInPandas(_read, PAGES)


def _store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            payload = (text or "").encode("utf-8", "surrogatepass")
            n = len(payload)
            payload += b"\xff" * (WIDTH - n % WIDTH if n % WIDTH or not n else 0)
            image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
            media = write_tiff([image])
            rows.append((f"{'' if doc_id is None else doc_id}:{n}:{len(media)}:{hashlib.sha256(media).hexdigest()}", media))
        yield pd.DataFrame(rows, columns=["key", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """(key, media): every text as a file; the key holds doc_id, bytes, file size and digest."""
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_store, "key string, media binary")


@query("op2_tiff_pages")
def op2(spark, sf_dir):
    key = F.split("key", ":")
    return read_pages(store_texts(table(spark, sf_dir, "documents"))).select(
        F.expr("try_cast(split(key, ':')[0] AS bigint)").alias("doc_id"), key[1].cast("long").alias("n_bytes"), "payload_bytes",
        "payload_sha256", "tail_crc32", key[2].cast("long").alias("media_bytes"), key[3].alias("media_sha256"),
        F.col("feature"), F.col("page"), F.col("error"))
