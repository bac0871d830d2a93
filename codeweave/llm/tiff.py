"""TIFF: a reader that walks image directories and a writer for 8-bit images; one row a page.

The reader takes either byte order, strips or tiles, no compression, PackBits, LZW or deflate, horizontal and floating-point
predictors, and samples of 1, 2, 4, 8, 16 or 32 bits or 32-bit floats in chunky or planar order. Truncated, looping, malformed or
unknown files give an error text, never a crash, and no block is unpacked beyond the size that its image gives it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm import common

# Fixed values of the format: tag numbers, field sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FILL_ORDER, SAMPLE_FORMAT = 322, 323, 324, 325, 266, 339
#: Tags that the reader goes by: they must hold unsigned 16- or 32-bit numbers.
STRUCTURE = (WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FILL_ORDER, SAMPLE_FORMAT)
LENGTH_TAG = 65000
FIELDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}


class TiffError(ValueError):
    """A file that can't be read."""


def unpack_bits(data: bytes, need: int | None = None) -> bytes:
    """Whole runs until ``need`` bytes are there."""
    out, i = bytearray(), 0
    while i < len(data) and (need is None or len(out) < need):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, need: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant first; the width grows one code early. Whole codes until ``need`` bytes are there."""
    out, table, width, bits, held, before = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, None
            continue
        if before is None:
            if code > 255:
                raise TiffError("lzw: bad first code")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise TiffError("lzw: bad code")
            table.append(before + entry[:1])
        out += entry
        if need is not None and len(out) >= need:
            break
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    word, code, size = b"", -1, 258
    for i in range(len(data)):
        one = data[i : i + 1]
        longer = word + one
        if len(longer) == 1:
            word, code = one, one[0]
        elif longer in table:
            word, code = longer, table[longer]
        else:
            put(code)
            table[longer] = size
            size += 1
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
            if size == 4095:
                put(256)
                table, size, width = {}, 258, 9
            word, code = one, one[0]
    if word:
        put(code)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def decompress(data: bytes, scheme: int, need: int) -> bytes:
    """At least ``need`` bytes, if the data hold them, and little more."""
    if scheme == NONE:
        return data
    if scheme == PACKBITS:
        return unpack_bits(data, need)
    if scheme == LZW:
        return unpack_lzw(data, need)
    if scheme in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, need)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    raise TiffError(f"compression {scheme} is not supported")


def compress(data: bytes, scheme: int) -> bytes:
    return {NONE: lambda: data, PACKBITS: lambda: pack_bits(data), LZW: lambda: pack_lzw(data), DEFLATE: lambda: zlib.compress(data, 3)}[scheme]()


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray
    tags: dict[int, tuple]


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory, in file order."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise TiffError("no TIFF header")
    seen = set()
    while at:
        if at in seen:
            raise TiffError("directories loop")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                code = FIELDS.get(kind)
                if code is None or (tag in STRUCTURE and code not in "HI"):
                    if tag in STRUCTURE:
                        raise TiffError(f"tag {tag} has field type {kind}")
                    continue
                if count * struct.calcsize(code) > len(data):
                    raise TiffError(f"tag {tag} is longer than the file")
                where = at + 10 + 12 * k
                if count * struct.calcsize(code) > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        except struct.error as e:
            raise TiffError(f"truncated directory: {e}") from e
        yield order, tags


def undo_predictor(block: np.ndarray) -> np.ndarray:
    """Running sums along rows, modulo the sample size; block (rows, columns, samples)."""
    return np.cumsum(block, axis=1, dtype=block.dtype)


def undo_float_predictor(raw: bytes, rows: int, columns: int, samples: int) -> np.ndarray:
    """Rows of byte differences, most significant bytes of all samples first, to 32-bit floats (rows, columns, samples)."""
    planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
    planes = planes.reshape(rows, 4, columns * samples).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(">f4").astype(np.float32).reshape(rows, columns, samples)


def unpack_samples(raw: bytes, rows: int, columns: int, samples: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, rows padded to whole bytes, as 8-bit numbers (rows, columns, samples)."""
    line = -(-columns * samples * bits // 8)
    each = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)
    each = each[:, : columns * samples * bits].reshape(rows, columns, samples, bits)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(3, dtype=np.uint8)


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def read_page(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, scheme, predictor, planar, form = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1), one(SAMPLE_FORMAT, 1)
    if not width or not height or not samples:
        raise TiffError("no image size")
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise TiffError(f"{bits} bits a sample are not supported")
    if form not in (1, 3, 4) or (form == 3 and bits != 32) or len(set(tags.get(SAMPLE_FORMAT, (form,)))) > 1:
        raise TiffError(f"sample format {form} is not supported")
    if predictor not in (1, 2, 3) or (predictor == 2 and (bits < 8 or form == 3)) or (predictor == 3 and form != 3):
        raise TiffError(f"predictor {predictor} is not supported")
    if planar not in (1, 2):
        raise TiffError(f"planar configuration {planar} is not supported")
    kind = np.dtype(np.uint8 if bits <= 8 else f"{order}f4" if form == 3 else f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ())
    if not bw or not bh:
        raise TiffError("no block size")
    across, down = -(-width // bw), -(-height // bh)
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("missing strips or tiles")
    most = max(1 << 30, 2000 * len(data))
    if width * height * samples * kind.itemsize > most or bw * bh * deep * kind.itemsize > most:
        raise TiffError("image size doesn't fit the file")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        top, left = cell // across * bh, cell % across * bw
        rows = bh if tiled else min(bh, height - top)
        if offsets[k] + counts[k] > len(data):
            raise TiffError("strip or tile lies beyond the file")
        raw = data[offsets[k] : offsets[k] + counts[k]]
        if one(FILL_ORDER, 1) == 2:
            raw = raw.translate(_REVERSED)
        need = rows * -(-bw * deep * bits // 8)
        raw = decompress(raw, scheme, need)
        if len(raw) < need:
            raise TiffError("strip or tile is too short")
        if bits < 8:
            block = unpack_samples(raw, rows, bw, deep, bits)
        elif predictor == 3:
            block = undo_float_predictor(raw[:need], rows, bw, deep)
        else:
            block = np.frombuffer(raw, kind, rows * bw * deep).reshape(rows, bw, deep).astype(out.dtype)
        if predictor == 2:
            block = undo_predictor(block)
        h, w = min(rows, height - top), min(bw, width - left)
        out[top : top + h, left : left + w, plane : plane + deep] = block[:h, :w]
    return Page(width, height, samples, bits, scheme, predictor, out, tags)


def read(data: bytes) -> list[Page]:
    return [read_page(data, order, tags) for order, tags in directories(data)]


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 1024, tile: int | None = None, order: str = "<", private: list[int] | None = None) -> bytes:
    """8-bit images (height, width, samples) as one file: a directory an image, strips of ``rows`` rows or square tiles.

    ``private``: a number kept with each image under LENGTH_TAG.
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for n, image in enumerate(images):
        height, width, samples = image.shape
        blocks = []
        for top in range(0, height, tile or rows):
            for left in range(0, width, tile or width):
                block = image[top : top + (tile or rows), left : left + (tile or width)]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), np.uint8))
                blocks.append(compress(np.ascontiguousarray(block, np.uint8).tobytes(), compression))
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b + b"\0" * (len(b) % 2)
        sizes = [len(b) for b in blocks]
        tags = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [8] * samples), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1 if samples < 3 else 2]), SAMPLES: ("H", [samples]), PREDICTOR: ("H", [predictor])}
        if tile:
            tags |= {TILE_WIDTH: ("I", [tile]), TILE_HEIGHT: ("I", [tile]), TILE_OFFSETS: ("I", offsets), TILE_COUNTS: ("I", sizes)}
        else:
            tags |= {STRIP_OFFSETS: ("I", offsets), ROWS_PER_STRIP: ("I", [rows]), STRIP_COUNTS: ("I", sizes)}
        if private:
            tags[LENGTH_TAG] = ("I", [private[n]])
        entries = bytearray()
        for tag, (code, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                value = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                value = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(values)) + value
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


_PAGE = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("pixels", pa.binary()), ("length_tag", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())])
PAGE_SQL = "id long, page int, width long, height long, samples int, bits int, compression string, pixels binary, length_tag long, media_bytes long, media_sha256 string, error string"


def _whole(values: tuple | None) -> int | None:
    return values[0] if values and isinstance(values[0], int) else None


def _rows(doc: int | None, data: bytes | None) -> Iterator[tuple]:
    data = data or b""
    tail = (len(data), hashlib.sha256(data).hexdigest())
    n = 0
    try:
        for order, tags in directories(data):
            p = read_page(data, order, tags)
            yield doc, n, p.width, p.height, p.samples, p.bits, NAMES[p.compression], p.pixels.tobytes(), _whole(tags.get(LENGTH_TAG)), *tail, None
            n += 1
    except Exception as e:  # noqa: BLE001 - no file may stop the others, whatever is wrong with it
        said = str(e) if isinstance(e, TiffError) else f"{type(e).__name__}: {e}"
        yield doc, n, None, None, None, None, None, None, None, *tail, said


def pages(media: DataFrame) -> DataFrame:
    """One row a page of media(id, media): size, samples and pixels (rows of chunky samples, native order).

    A file that can't be read gives the pages before the fault and one row with ``error`` set; null and empty files give such a row;
    repeated rows and null ids give rows like others; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, data in zip(batch.column(0), batch.column(1)):
                for row in _rows(doc.as_py(), data.as_py()):
                    rows.append(row)
                    held += len(row[7] or b"")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PAGE)], schema=_PAGE)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PAGE)], schema=_PAGE)

    return media.select(F.col("id").cast("long").alias("id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, PAGE_SQL)


#: Bytes in a row of the image that holds a text.
LINE = 64


def stored_texts(docs: DataFrame) -> DataFrame:
    """(id, media): each whole text of docs(doc_id, text, ...) in UTF-8, padded with zeros, as an 8-bit image of LINE columns.

    A null text is stored as an empty one, which is one row of zeros; texts of any length are stored whole; repeated rows and null ids
    give rows like others; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, held = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                size = len(raw)
                raw = raw.ljust(max(LINE, -(-size // LINE) * LINE), b"\0")
                ids.append(doc.as_py())
                out.append(write([np.frombuffer(raw, np.uint8).reshape(-1, LINE, 1)], private=[size]))
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "media"])
                    ids, out, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, media binary")


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(pixels: bytes) -> str:
    """Mean, entropy in bits, share of zero samples and mean difference of neighbouring samples, with four decimals."""
    x = np.frombuffer(pixels, np.uint8)
    share = np.bincount(x, minlength=256) / max(1, len(x))
    seen = share[share > 0]
    steps = np.abs(np.diff(x.astype(np.int16)))
    return f"{x.mean() if len(x) else 0:.4f},{-(seen * np.log2(seen)).sum() + 0.0:.4f},{share[0]:.4f},{steps.mean() if len(steps) else 0:.4f}"


def text_features(read_back: DataFrame) -> DataFrame:
    """Digests and features of the texts that ``stored_texts`` stored, from the pages read back; an unreadable one fails the query.

    One row a page, null ids and repeated rows included; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, pixels, length, size, digest, error in zip(*(batch.column(k) for k in range(6))):
                if error.is_valid:
                    raise TiffError(f"stored text {doc}: {error}")
                raw = pixels.as_buffer().to_pybytes()
                rows.append((doc.as_py(), length.as_py(), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-LINE:]), size.as_py(), digest.as_py(), feature(raw)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _FEATURES)], schema=_FEATURES)

    return read_back.select("id", "pixels", "length_tag", "media_bytes", "media_sha256", "error").mapInArrow(run, FEATURES_SQL)
