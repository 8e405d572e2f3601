"""Progressive JPEG: scans are accumulated into coefficient arrays, which numpy turns into full-resolution RGB tensors.

``decode`` reads any Huffman-coded 8-bit progressive file: spectral selection, successive approximation, end-of-band
runs, restart intervals and subsampled chroma. Two cases are decoded in whole arrays instead of symbol by symbol:
tables in which code and value together always have the same width and no symbol skips coefficients, and the
correction bits of blocks inside an end-of-band run. Both follow from the file alone.

``encode_payload`` stores bytes losslessly. The unit of the format is the quantised coefficient, so each 64 bytes
become the 64 coefficients of a luma block: byte b becomes -(b + 2) below 128 and b - 126 from there on, which
leaves no coefficient that the first approximation scan would round to zero. The two chroma planes, at half
resolution, hold a tint derived from the payload.

Defined results of ``store`` and ``read``: a null or empty text gives 64 zero bytes; equal texts give equal media;
memory follows the longest single text, as its coefficients are held at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_bytes

BLOCK = 64
LONGEST_RUN = 32767
SIDE = 8191  # blocks on a side, at most


def _zigzag() -> np.ndarray:
    """Position in the block, row by row, of each coefficient in its order in the file."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Coefficients in file order times this give the samples of the block, row by row."""
    u = np.arange(8)
    cosines = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.kron(cosines, cosines)[ZIGZAG].astype(np.float32)


BASIS = _basis()


class Table:
    """A Huffman table: symbol and code length for each next 16 bits, and the fixed width of code and value if there is one."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        lengths = [n + 1 for n, c in enumerate(counts) for _ in range(c)]
        self.codes: dict[int, tuple[int, int]] = {}
        code, previous = 0, lengths[0] if lengths else 0
        parts, self.fixed = [], None
        for n, s in zip(lengths, symbols):
            code <<= n - previous
            previous = n
            self.codes[s] = (code, n)
            parts.append(np.full(1 << (16 - n), s << 8 | n, np.int32))
            code += 1
        found = np.concatenate([*parts, np.zeros(1, np.int32)])[: 1 << 16]
        self.array = np.concatenate([found, np.zeros((1 << 16) - len(found), np.int32)])
        self._look: list[int] | None = None
        widths = {n + s for n, s in zip(lengths, symbols)}
        if lengths and max(symbols) < 16 and len(widths) == 1:
            self.fixed = widths.pop()
            field = np.arange(1 << self.fixed)
            entry = self.array[field << (16 - self.fixed)] if self.fixed <= 16 else self.array[field >> (self.fixed - 16)]
            size = entry >> 8
            bits = field & ((1 << size) - 1)
            value = np.where(bits >= (1 << size >> 1), bits, bits - (1 << size) + 1)
            self.values = np.where(size == 0, 0, value).astype(np.int32)
            self.valid = entry > 0
            self.skips = 0 in symbols

    @property
    def look(self) -> list[int]:
        self._look = self._look or self.array.tolist()
        return self._look


@lru_cache(maxsize=256)
def _table(counts: bytes, symbols: bytes) -> Table:
    return Table(counts, symbols)


def _fields(data: np.ndarray, count: int, width: int) -> np.ndarray:
    """The first ``count`` bit fields of this width."""
    if width == 8:
        return data[:count]
    at = np.arange(count, dtype=np.int64) * width
    byte, shift = at >> 3, at & 7
    wide = np.concatenate([data, np.full(4, 255, np.uint8)]).astype(np.uint32)
    window = wide[byte] << 24 | wide[byte + 1] << 16 | wide[byte + 2] << 8 | wide[byte + 3]
    return (window >> (32 - width - shift).astype(np.uint32)) & np.uint32((1 << width) - 1)


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + b"\xff" * 8, 0

    def peek16(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, look: list[int]) -> int:
        entry = look[self.peek16()]
        if not entry:
            raise ValueError("no such code in the Huffman table")
        self.at += entry & 255
        return entry >> 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek16() >> (16 - n)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    def many(self, n: int) -> np.ndarray:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, last - first, first))[self.at & 7 :][:n]
        self.at += n
        return bits


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks that hold the picture
    high: int = 0
    stride: int = 0  # blocks in memory, for whole units of interleaved scans
    coefficients: np.ndarray | None = None


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, upsampled to the picture's size, as float32."""
        across, down = max(c.h for c in self.components), max(c.v for c in self.components)
        found = []
        for c in self.components:
            blocks = c.coefficients.reshape(-1, c.stride, 64)[: c.high, : c.wide].reshape(-1, 64)
            samples = (blocks * self.quants[c.quant]).astype(np.float32) @ BASIS + 128
            plane = samples.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
            if (c.h, c.v) != (across, down):
                rows = np.arange(self.height) * c.v // down
                columns = np.arange(self.width) * c.h // across
                plane = plane[rows][:, columns]
            found.append(plane[: self.height, : self.width])
        return found

    def rgb(self) -> np.ndarray:
        """Full-resolution tensor, height x width x 3."""
        y, *chroma = self.planes()
        out = np.empty((self.height, self.width, 3), np.uint8)
        if len(chroma) < 2:
            out[:] = np.clip(np.rint(y), 0, 255)[:, :, None]
            return out
        blue, red = chroma[0] - 128, chroma[1] - 128
        for k, channel in enumerate((y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue)):
            out[:, :, k] = np.clip(np.rint(channel), 0, 255)
        return out


def _entropy(data: bytes, stops: np.ndarray, start: int) -> tuple[list[bytes], int]:
    """The restart intervals of a scan, without stuffing, and where the next marker stands."""
    end = int(stops[np.searchsorted(stops, start)]) if len(stops) and stops[-1] >= start else len(data)
    body = data[start:end]
    parts = [body]
    if any(bytes((0xFF, 0xD0 + k)) in body for k in range(8)):
        raw = np.frombuffer(body, np.uint8)
        cuts = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist()
        parts = [body[a:b] for a, b in zip([0, *(c + 2 for c in cuts)], [*cuts, len(body)])]
    return [p.replace(b"\xff\x00", b"\xff") for p in parts], end


def decode(data: bytes) -> Picture:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(raw[:-1] == 255)
    after = raw[marks + 1]
    stops = marks[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
    picture, tables, quants, restart, comment, at = None, {}, {}, 0, b"", 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xFE:
            comment = body
        elif kind == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            across, down = max(c.h for c in parts), max(c.v for c in parts)
            units = -(-width // (8 * across)), -(-height // (8 * down))
            for c in parts:
                c.wide, c.high = -(-(-(-width * c.h // across)) // 8), -(-(-(-height * c.v // down)) // 8)
                c.stride = units[0] * c.h
                c.coefficients = np.zeros((units[1] * c.v * c.stride, 64), np.int32)
            picture = Picture(width, height, parts, quants, comment)
        elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded file")
        elif kind == 0xDA:
            if picture is None:
                raise ValueError("a scan comes before its frame")
            n = body[0]
            chosen = [(next(c for c in picture.components if c.id == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            intervals, at = _entropy(data, stops, at)
            _scan(picture, chosen, tables, first, last, approx >> 4, approx & 15, intervals, restart)
    if picture is None:
        raise ValueError("the file holds no picture")
    picture.comment = comment
    return picture


def _order(c: Component) -> np.ndarray:
    """Rows of the coefficient array in the order of a scan of this component alone."""
    if c.stride == c.wide and len(c.coefficients) == c.wide * c.high:
        return np.arange(len(c.coefficients))
    return (np.arange(c.high)[:, None] * c.stride + np.arange(c.wide)).ravel()


def _scan(picture: Picture, chosen, tables, first: int, last: int, high: int, low: int, intervals: list[bytes], restart: int) -> None:
    if len(chosen) > 1:  # only of DC coefficients
        across, down = max(c.h for c in picture.components), max(c.v for c in picture.components)
        wide, tall = -(-picture.width // (8 * across)), -(-picture.height // (8 * down))
        units = [[(k, (y * c.v + j) * c.stride + x * c.h + i) for k, (c, _) in enumerate(chosen) for j in range(c.v) for i in range(c.h)] for y in range(tall) for x in range(wide)]
        for part, bits in enumerate(map(_Bits, intervals)):
            dc = [0] * len(chosen)
            for unit in units[part * restart : (part + 1) * restart] if restart else units:
                for k, row in unit:
                    c, pick = chosen[k]
                    if high:
                        c.coefficients[row, 0] |= bits.take(1) << low
                    else:
                        dc[k] += bits.signed(bits.symbol(tables[pick >> 4].look))
                        c.coefficients[row, 0] = dc[k] << low
        return
    c, pick = chosen[0]
    order = _order(c)
    for part, data in enumerate(intervals):
        rows = order[part * restart : (part + 1) * restart] if restart else order
        if not len(rows):
            continue
        if first == 0 and high:
            c.coefficients[rows, 0] |= _Bits(data).many(len(rows)).astype(np.int32) << low
        elif first == 0:
            _dc_first(c.coefficients, rows, tables[pick >> 4], low, data)
        elif high:
            _ac_refine(c.coefficients, rows, tables[16 | pick & 15], first, last, low, data)
        else:
            _ac_first(c.coefficients, rows, tables[16 | pick & 15], first, last, low, data)


def _fixed(table: Table, count: int, data: bytes) -> np.ndarray | None:
    """All values of a scan if each takes the same number of bits."""
    if not table.fixed or len(data) * 8 < count * table.fixed:
        return None
    fields = _fields(np.frombuffer(data, np.uint8), count, table.fixed)
    return table.values[fields] if table.valid[fields].all() else None


def _dc_first(blocks: np.ndarray, rows: np.ndarray, table: Table, low: int, data: bytes) -> None:
    steps = _fixed(table, len(rows), data)
    if steps is None:
        bits = _Bits(data)
        steps = np.array([bits.signed(bits.symbol(table.look)) for _ in range(len(rows))])
    blocks[rows, 0] = np.cumsum(steps) << low


def _ac_first(blocks: np.ndarray, rows: np.ndarray, table: Table, first: int, last: int, low: int, data: bytes) -> None:
    band = last - first + 1
    values = None if table.fixed is None or table.skips else _fixed(table, len(rows) * band, data)
    if values is not None:
        blocks[rows, first : last + 1] = values.reshape(-1, band) << low
        return
    bits, look, left = _Bits(data), table.look, 0
    for row in rows.tolist():
        if left:
            left -= 1
            continue
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(look), 16)
            if size:
                k += run
                blocks[row, k] = bits.signed(size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                left = (1 << run) - 1 + bits.take(run)
                break


def _ac_refine(blocks: np.ndarray, rows: np.ndarray, table: Table, first: int, last: int, low: int, data: bytes) -> None:
    bits, look, step, at = _Bits(data), table.look, 1 << low, 0

    def correct(rows: np.ndarray, start: int) -> None:
        """One bit for each coefficient from ``start`` on that is not zero yet."""
        part = blocks[rows, start : last + 1]
        known = part != 0
        grow = np.zeros(part.shape, np.int32)
        grow[known] = bits.many(int(known.sum()))
        grow &= (np.abs(part) & step) == 0
        blocks[rows, start : last + 1] = part + np.sign(part) * grow * step

    while at < len(rows):
        row, k, left = rows[at], first, 0
        while k <= last:
            run, size = divmod(bits.symbol(look), 16)
            value = 0
            if size:
                value = step if bits.take(1) else -step
            elif run < 15:
                left = (1 << run) + bits.take(run)
                break
            while k <= last:
                if blocks[row, k]:
                    if bits.take(1) and not abs(blocks[row, k]) & step:
                        blocks[row, k] += step if blocks[row, k] > 0 else -step
                elif run == 0:
                    break
                else:
                    run -= 1
                k += 1
            if value:
                blocks[row, k] = value
            k += 1
        if left:
            correct(rows[at : at + 1], k)
            correct(rows[at + 1 : at + left], first)
            at += left
        else:
            at += 1


# --- storing payloads ---------------------------------------------------------------------------------------------


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body


#: Fixed widths of code and value: 9 bits for DC steps of 0 to 8 bits, 8 bits for AC values of 1 to 7 bits; 15 run lengths of 4 bits.
DC = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
AC = bytes([1] * 7 + [0] * 9), bytes(range(7, 0, -1))
RUNS = bytes([0, 0, 0, 15] + [0] * 12), bytes(16 * n for n in range(15))


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and value of DC steps -255..255 (9 bits) and of AC values -127..127 (8 bits)."""

    def lookup(counts: bytes, symbols: bytes, most: int) -> np.ndarray:
        codes = _table(counts, symbols).codes
        sizes = [abs(v).bit_length() for v in range(-most, most + 1)]
        return np.array([codes[n][0] << n | (v if v > 0 else v + (1 << n) - 1) if n in codes else 0 for v, n in zip(range(-most, most + 1), sizes)], np.uint32)

    return lookup(*DC, 255), lookup(*AC, 127)


def _pack9(fields: np.ndarray) -> bytes:
    bits = (fields[:, None] >> np.arange(8, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(np.concatenate([bits.ravel().astype(np.uint8), np.ones(-bits.size % 8, np.uint8)])).tobytes()


def _correction(band: np.ndarray) -> bytes:
    """A refinement scan without new coefficients: runs of blocks, each followed by its correction bits."""
    parts = []
    for a in range(0, len(band), LONGEST_RUN):
        part = band[a : a + LONGEST_RUN]
        n = len(part).bit_length() - 1
        code, length = _table(*RUNS).codes[16 * n]
        prefix = code << n | len(part) - (1 << n)
        parts += [np.array([prefix >> i & 1 for i in range(length + n - 1, -1, -1)], np.uint8), (np.abs(part) & 1).astype(np.uint8).ravel()]
    bits = np.concatenate(parts)
    return np.packbits(np.concatenate([bits, np.ones(-bits.size % 8, np.uint8)])).tobytes()


@lru_cache(maxsize=1)
def _tables_segment() -> bytes:
    quant = _segment(0xDB, b"\x00" + b"\x01" * 64)
    return quant, _segment(0xC4, b"".join(bytes([kind]) + counts + symbols for kind, (counts, symbols) in ((0x00, DC), (0x10, AC), (0x11, RUNS))))


def encode_payload(payload: bytes, length: int) -> bytes:
    """A progressive file whose luma coefficients are the payload, of a positive multiple of 64 bytes; length: of the unpadded data."""
    count = len(payload) // BLOCK
    wide = min(SIDE, max(1, int(np.ceil(np.sqrt(count)))))
    high = -(-count // wide)
    values = np.frombuffer(payload, np.uint8).astype(np.int32)
    luma = np.full((wide * high, BLOCK), -2, np.int32)
    luma[:count] = np.where(values < 128, -(values + 2), values - 126).reshape(-1, BLOCK)
    tint = zlib.crc32(payload)
    half = -(-wide // 2) * -(-high // 2)
    blue, red = (tint & 255) - 128, (tint >> 8 & 255) - 128
    step, first = _codes()

    def scan(component: int, tables: int, band: tuple[int, int], approx: int, body: bytes) -> bytes:
        return _segment(0xDA, bytes((1, component, tables, *band, approx))) + body.replace(b"\xff", b"\xff\x00")

    def dc(plane: np.ndarray) -> bytes:
        return _pack9(step[np.diff(plane >> 1, prepend=0) + 255])

    def dc_bits(plane: np.ndarray) -> bytes:
        bits = (plane & 1).astype(np.uint8)
        return np.packbits(np.concatenate([bits, np.ones(-bits.size % 8, np.uint8)])).tobytes()

    def ac(band: np.ndarray) -> bytes:
        return first[(np.sign(band) * (np.abs(band) >> 1)).ravel() + 127].astype(np.uint8).tobytes()

    planes = [luma[:, 0], np.full(half, blue, np.int32), np.full(half, red, np.int32)]
    quant, huffman = _tables_segment()
    frame = struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    parts = [b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", length, len(payload))), quant, _segment(0xC2, frame), huffman]
    parts += [scan(k + 1, 0x00, (0, 0), 0x01, dc(p)) for k, p in enumerate(planes)]
    parts += [scan(1, 0x00, band, 0x01, ac(luma[:, band[0] : band[1] + 1])) for band in ((1, 5), (6, 63))]
    parts += [scan(k + 1, 0x00, (0, 0), 0x10, dc_bits(p)) for k, p in enumerate(planes)]
    parts += [scan(1, 0x01, band, 0x10, _correction(luma[:, band[0] : band[1] + 1])) for band in ((1, 5), (6, 63))]
    return b"".join(parts) + b"\xff\xd9"


def payload_of(picture: Picture) -> tuple[bytes, int]:
    """The payload stored by ``encode_payload`` and the length of its unpadded data."""
    length, size = struct.unpack(">QQ", picture.comment)
    c = picture.components[0]
    values = c.coefficients.reshape(-1, c.stride, 64)[: c.high, : c.wide].reshape(-1)[:size]
    return np.where(values < 0, -values - 2, values + 126).astype(np.uint8).tobytes(), length


def store(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): each whole text as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            media = []
            for raw in text_bytes(batch.column("text")):
                media.append(encode_payload(raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read(media: DataFrame, tensors: bool = True) -> DataFrame:
    """Decodes (doc_id, media): digests of the payload and of the file, a feature of the RGB tensor, and with ``tensors`` height, width and rgb."""
    schema = READ + (", height int, width int, rgb binary" if tensors else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                picture = decode(data)
                payload, length = payload_of(picture)
                rgb = picture.rgb()
                pixels = rgb.shape[0] * rgb.shape[1]
                sums = rgb.reshape(pixels, 3).sum(axis=0, dtype=np.int64)
                feature = f"{picture.width}x{picture.height}:" + ",".join(f"{s / pixels:.3f}" for s in sums.tolist()) + f":{zlib.crc32(rgb):08x}"
                row = [doc, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature]
                rows.append(row + [picture.height, picture.width, rgb.tobytes()] if tensors else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return media.mapInArrow(run, schema)
