"""TIFF media: write payloads as grey images, walk image directories, decode strips and tiles, one row for each page.

The reader follows the chain of image directories in either byte order, decodes uncompressed, PackBits, LZW and deflate
strips or tiles of 1 to 32 bits a sample, undoes horizontal differencing (predictor 2, from 8 bits on) and that of
floating-point samples (predictor 3), and gives the pixels of each page. The writer stores a payload losslessly as grey
pages of 64 bytes a row; `stored_form` picks compression, predictor and layout by the payload's crc32.

Defined results: a null text is empty; an empty text is one page of 64 zero bytes. A null or broken medium gives one row
with an error and no pixels, after the pages before the break. A directory that points back to one already seen is a
break. Equal texts give equal bytes. Rows that repeat are each treated alike; extra columns are ignored; an empty table
gives an empty result. A document is handled whole in one task, a page at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import crc32, text_blocks, utf8

WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 4096, 1024
#: Fixed values of the format: tags, compressions and field types (bytes of one, struct letter).
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "offsets", 277: "samples", 278: "strip_rows", 279: "counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "counts"}
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}


class BrokenTiff(ValueError):
    pass


def pack_packbits(data: bytes) -> bytes:
    """Runs of three bytes or more as runs, all else as it is, 128 bytes at most in each part."""
    row = np.frombuffer(data, dtype=np.uint8)
    borders = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]]) if len(row) else np.zeros(1, dtype=np.int64)
    long = np.flatnonzero(np.diff(borders) > 2)
    out, at = bytearray(), 0

    def plain(end: int) -> None:
        for start in range(at, end, 128):
            part = data[start : min(start + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for begin, end in zip(borders[long].tolist(), borders[long + 1].tolist(), strict=True):
        plain(begin)
        for start in range(begin, end, 128):
            n = min(128, end - start)
            out += bytes([257 - n if n > 1 else 0, data[begin]])
        at = end
    plain(len(data))
    return bytes(out)


def unpack_packbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out[:size])


#: Fixed values of the format: the codes that clear the table and end the data, the first free code, the widest code.
CLEAR, FINISH, FREE, WIDEST = 256, 257, 258, 12


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: the reader's table grows with each but the first, and codes widen one
    entry early."""
    following = FREE + np.maximum(np.arange(n) - 1, 0)  # the reader's next free code as each code is read
    return np.clip(np.floor(np.log2(following + 1)).astype(np.int64) + 1, 9, WIDEST)


#: A table is full, and cleared, after so many codes.
SEGMENT = 4094 - FREE + 1
_SCHEDULE = _widths(SEGMENT + 8)


def _bits_of(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """The codes in so many bits each, most significant first."""
    shifts = WIDEST - 1 - np.arange(WIDEST)
    return np.packbits((codes[:, None] >> shifts & 1).astype(np.uint8)[shifts < widths[:, None]]).tobytes()


def pack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: most significant bit first, a clear code before all else and whenever the table is full."""
    codes, widths = [CLEAR], [9]
    table: dict[int, int] = {}
    following, begun, word = FREE, len(codes), -1
    for b in data:
        if word < 0:
            word = b
            continue
        longer = table.get(word << 8 | b)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        if following < 4094:
            table[word << 8 | b] = following
            following += 1
        else:
            widths += _SCHEDULE[: len(codes) - begun + 1].tolist()
            codes.append(CLEAR)
            table, following, begun = {}, FREE, len(codes)
        word = b
    if word >= 0:
        codes.append(word)
    codes.append(FINISH)
    widths += _SCHEDULE[: len(codes) - begun].tolist()
    return _bits_of(np.array(codes), np.array(widths))


def _codes(data: np.ndarray, at: int) -> np.ndarray:
    """The codes from bit `at` on, as if no clear code came; as many as there are, up to a full table's."""
    places = at + np.concatenate([[0], np.cumsum(_SCHEDULE[:-1])])
    places, widths = places[places + _SCHEDULE <= 8 * (len(data) - 4)], _SCHEDULE[: np.count_nonzero(places + _SCHEDULE <= 8 * (len(data) - 4))]
    first = places >> 3
    window = data[first].astype(np.int64) << 16 | data[first + 1].astype(np.int64) << 8 | data[first + 2]
    return window >> (24 - (places & 7) - widths) & ((1 << widths) - 1)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Each stretch between clear codes has its widths by position, so its codes are cut out at once and then looked up."""
    padded_data = np.frombuffer(data + bytes(4), dtype=np.uint8)
    out, made, at = [], 0, 0
    letters = [bytes([i]) for i in range(256)] + [b"", b""]
    first = _codes(padded_data, 0)[:1]
    if len(first) and first[0] != CLEAR:
        raise BrokenTiff("LZW data without a clear code")
    at = 9
    while len(first) and made < size:
        codes = _codes(padded_data, at)
        stops = np.flatnonzero((codes == CLEAR) | (codes == FINISH))
        n = int(stops[0]) if len(stops) else len(codes)
        table, last = list(letters), b""
        for code in codes[:n].tolist():
            if code < len(table):
                word = table[code]
                if last:
                    table.append(last + word[:1])
            elif code == len(table) and last:
                word = last + last[:1]
                table.append(word)
            else:
                raise BrokenTiff("LZW code out of range")
            out.append(word)
            last = word
        made = sum(map(len, out[-n:])) + made if n else made
        if not len(stops) or codes[n] == FINISH:
            break
        at += int(_SCHEDULE[: n + 1].sum())
    return b"".join(out)[:size]


def _unpacked(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how == PACKBITS:
        return unpack_packbits(data, size)
    if how == LZW:
        return unpack_lzw(data, size)
    if how in (ADOBE_DEFLATE, DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BrokenTiff(f"deflate: {e}") from e
    raise BrokenTiff(f"compression {how} isn't supported")


def encode(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, compression: int = ADOBE_DEFLATE, predictor: int = 1, tile: int = 0, bits: int = 8) -> bytes:
    """payload (whole rows of `width` bytes) as a little-endian TIFF of grey pages, of 8 or 1 bits a sample; in strips, or in
    square tiles of `tile` samples (a multiple of 16 that divides the row)."""
    pack = {NONE: bytes, LZW: pack_lzw, PACKBITS: pack_packbits, ADOBE_DEFLATE: lambda x: zlib.compress(x, 1), DEFLATE: lambda x: zlib.compress(x, 1)}[compression]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    rows = len(payload) // width
    for top in range(0, rows, page_rows):
        height = min(page_rows, rows - top)
        grid = np.frombuffer(payload, dtype=np.uint8, count=height * width, offset=top * width).reshape(height, width)
        if tile:
            side = tile * bits // 8
            filled = np.pad(grid, ((0, -height % tile), (0, 0)))
            blocks = [filled[y : y + tile, x : x + side] for y in range(0, len(filled), tile) for x in range(0, width, side)]
        else:
            blocks = [grid[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            packed = pack(block.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        layout = [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [strip_rows]), (279, 4, counts)]
        fields = sorted([(256, 4, [width * 8 // bits]), (257, 4, [height]), (258, 3, [bits]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor]), *layout])
        entries = b""
        for tag, kind, values in fields:
            packed = struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
            if len(packed) > 4:
                entries += struct.pack("<HHII", tag, kind, len(values), len(out))
                out += packed
            else:
                entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        out += b"\0" * (len(out) & 1)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: The ways in which texts are stored in turn, chosen by the payload's crc32, so that reading back takes every decoder.
WAYS = (
    {"compression": ADOBE_DEFLATE}, {"compression": ADOBE_DEFLATE, "predictor": 2}, {"compression": DEFLATE, "tile": 64}, {"compression": LZW},
    {"compression": LZW, "predictor": 2, "tile": 32}, {"compression": PACKBITS}, {"compression": PACKBITS, "bits": 1}, {"compression": NONE, "tile": 16},
)


def stored_form(payload: bytes) -> bytes:
    return encode(payload, **WAYS[crc32(payload) % len(WAYS)])


def directories(data: bytes) -> Iterator[tuple[str, dict]]:
    """Byte order and fields of each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise BrokenTiff("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise BrokenTiff("a directory offset is out of range or repeats")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise BrokenTiff("a directory is cut off")
        fields: dict = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if tag in TAGS and kind in TYPES:
                size, letter = TYPES[kind]
                place = at + 10 + 12 * i
                if size * count > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                if place + size * count > len(data):
                    raise BrokenTiff("a field is out of range")
                fields[TAGS[tag]] = struct.unpack_from(f"{order}{count}{letter}", data, place)
                if tag in (322, 324):
                    fields["tiled"] = True
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _unfolded(raw: bytes, bits: int, tall: int, values: int, order: str) -> np.ndarray:
    """Samples of `tall` rows of `values` each, rows beginning at whole bytes."""
    if bits < 8:
        one = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(tall, -1), axis=1)[:, : values * bits].reshape(tall, values, bits)
        return (one * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return np.frombuffer(raw, dtype=np.dtype(f"{order}u{bits // 8}")).reshape(tall, values)


def _undifferenced(block: np.ndarray, raw: bytes, predictor: int, depth: int, order: str) -> np.ndarray:
    """Rows of samples without the predictor: 2 adds up samples along a row, 3 adds up bytes of rows that hold each byte of
    all samples in turn, the most significant first."""
    tall, values = block.shape
    if predictor == 2:
        return np.cumsum(block.reshape(tall, -1, depth), axis=1, dtype=block.dtype.newbyteorder("=")).reshape(tall, values)
    size = block.dtype.itemsize
    planes = np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(tall, -1, depth), axis=1, dtype=np.uint8).reshape(tall, size, values)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.dtype(f">u{size}")).reshape(tall, values)


def _sizes(f: dict, limit: int) -> tuple:
    """What a page's fields say, checked before anything is allocated: a page holds at most `limit` bytes of samples."""
    one = lambda name, default=None: f[name][0] if f.get(name) else default
    width, height, samples = one("width"), one("height"), one("samples", 1)
    bits, how, predictor, planar = one("bits", 1), one("compression", 1), one("predictor", 1), one("planar", 1)
    if not width or not height or width < 0 or height < 0 or "offsets" not in f or len(f["offsets"]) != len(f.get("counts", ())):
        raise BrokenTiff("a page lacks its size or its strips")
    if samples < 1 or min(*f["offsets"], *f["counts"], 0) < 0:
        raise BrokenTiff("a page has no samples, or a strip no place")
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(f.get("bits", (1,)))) > 1:
        raise BrokenTiff(f"{bits} bits a sample aren't supported")
    if predictor not in (1, 2, 3) or predictor == 2 and bits < 8 or predictor == 3 and bits < 16:
        raise BrokenTiff(f"predictor {predictor} isn't supported for {bits} bits")
    tiled = bool(f.get("tiled"))
    across, down = (one("tile_width"), one("tile_height")) if tiled else (width, min(one("strip_rows", height), height))
    if not across or not down or across < 0 or down < 0:
        raise BrokenTiff("a tile or strip has no size")
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    columns, lines = -(-width // across), -(-height // down)
    if len(f["offsets"]) < planes * columns * lines:
        raise BrokenTiff("strips or tiles are missing")
    if max(height * width * samples, down * across * depth) * max(bits // 8, 1) > limit:
        raise BrokenTiff("a page is larger than its data can be")
    return width, height, samples, bits, how, predictor, tiled, across, down, planes, depth, columns, lines


#: No compression that is read makes more than so many bytes of one (deflate: 1032; samples of one bit become bytes).
EXPANSION = 1032 * 8
#: Bytes of samples that a page may have: one row holds no more. Larger pages are an error of their medium.
PAGE_BYTES = 1 << 30


def pages(data: bytes) -> Iterator[dict]:
    """The pages of a TIFF: width, height, samples, bits, compression, predictor, tiled, pixels (rows of samples, of one byte
    each up to 8 bits)."""
    for order, f in directories(data):
        width, height, samples, bits, how, predictor, tiled, across, down, planes, depth, columns, lines = _sizes(f, min(len(data) * EXPANSION, PAGE_BYTES))

        def block(k: int) -> np.ndarray:
            start, size = f["offsets"][k], f["counts"][k]
            tall = down if tiled else min(down, height - k % lines * down)
            if start + size > len(data):
                raise BrokenTiff("a strip or tile is out of range")
            need = tall * (-(-across * depth * bits // 8))
            raw = _unpacked(data[start : start + size], how, need)
            if len(raw) < need:
                raise BrokenTiff("a strip or tile is too short")
            samples_of = _unfolded(raw, bits, tall, across * depth, order)
            return _undifferenced(samples_of, raw, predictor, depth, order) if predictor > 1 else samples_of

        # A page grows by what its strips or tiles hold: nothing is made room for that a file only claims.
        parts = []
        for row in range(planes * lines):
            wide = [block(row * columns + column) for column in range(columns)]
            parts.append((np.hstack(wide) if columns > 1 else wide[0])[: min(down, height - row % lines * down), : width * depth])
        kind = np.dtype(np.uint8 if bits <= 8 else f"{order}u{bits // 8}")
        whole = np.concatenate(parts).astype(kind, copy=False).reshape(planes, height, width, depth)
        pixels = np.moveaxis(whole, 0, 2).reshape(height, width, samples)
        yield {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor, "tiled": tiled, "pixels": pixels.tobytes()}


def padded(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of WIDTH."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def stored_texts(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, media (the text's payload as a TIFF)."""

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                texts = utf8(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([stored_form(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def media_pages(media: DataFrame) -> DataFrame:
    """One row for each page of each row of media (doc_id, media)."""

    def rows(key, data):
        k = 0
        try:
            for k, page in enumerate(pages(data or b""), 1):
                yield {"doc_id": key, "page": k - 1, **page, "error": None}
        except BrokenTiff as e:
            yield {"doc_id": key, "page": k, "error": str(e)}

    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names = ["doc_id", *(x.split()[0] for x in PAGE.split(", "))]
        types = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "tiled": pa.bool_(), "pixels": pa.binary(), "error": pa.string()}
        for batch in batches:
            for i in range(batch.num_rows):
                for row in rows(batch.column("doc_id")[i].as_py(), batch.column("media")[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], types.get(n, batch.column("doc_id").type)) for n in names], names)

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, {PAGE}")


def feature(counts: np.ndarray, n_pages: int) -> str:
    """Pages, mean, standard deviation and entropy (bits) of the samples, from their histogram."""
    total = counts.sum()
    share = counts[counts > 0] / total
    levels = np.arange(256)
    mean = float((counts * levels).sum() / total)
    deviation = float(np.sqrt((counts * (levels - mean) ** 2).sum() / total))
    return f"pages={n_pages};mean={mean:.4f};std={deviation:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def digests(media: DataFrame) -> DataFrame:
    """What reading the media back gives, one row for each row of media (doc_id, n_bytes, media): payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error. Null media, and media that break, have an error and
    no payload; samples of one bit are put together to bytes again."""

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, None, "no medium"
        whole, tail, size, counts, n = hashlib.sha256(), b"", 0, np.zeros(256, dtype=np.int64), 0
        told = len(data), hashlib.sha256(data).hexdigest()
        try:
            for page in pages(data):
                pixels = page["pixels"]
                if page["bits"] == 1:
                    pixels = np.packbits(np.frombuffer(pixels, dtype=np.uint8).reshape(page["height"], -1), axis=1).tobytes()
                whole.update(pixels)
                size, tail, n = size + len(pixels), (tail + pixels)[-64:], n + 1
                counts += np.bincount(np.frombuffer(pixels, dtype=np.uint8), minlength=256)
        except BrokenTiff as e:
            return None, None, None, *told, None, str(e)
        return size, whole.hexdigest(), crc32(tail), *told, feature(counts, n), None

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            found = [one(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column("media")]
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
