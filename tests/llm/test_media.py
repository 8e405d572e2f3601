import hashlib
import struct
import zlib

import numpy as np
import pytest

from textmill.llm import progressive_jpeg as J


@pytest.mark.parametrize("n", [64, 640, 64 * 999])
def test_payload_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    picture = J.decode(J.encode_payload(payload, n - 1))
    assert J.payload_of(picture) == (payload, n - 1)
    assert picture.rgb().shape == (picture.height, picture.width, 3)


def test_payload_of_more_blocks_than_a_run():
    payload = bytes(range(256)) * (64 * 33_000 // 256)
    assert J.payload_of(J.decode(J.encode_payload(payload, 5)))[0] == payload


class Writer:
    """A plain bit writer and a plain encoder for scans with zeros, runs and new coefficients."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def all_symbols():
    """A table with 8-bit codes for the symbols in use (at most 255)."""
    symbols = [r << 4 | s for r in range(16) for s in range(0, 11)]
    return bytes([0] * 7 + [len(symbols)] + [0] * 8), bytes(symbols)


def magnitude(v):
    n = abs(v).bit_length()
    return n, v if v > 0 else v + (1 << n) - 1


def put(w, codes, symbol):
    w.put(*codes[symbol])


def ac_first(w, codes, blocks, lo, hi, al):
    run_blocks = 0

    def flush():
        nonlocal run_blocks
        while run_blocks:
            n = min(14, run_blocks.bit_length() - 1)
            put(w, codes, n << 4)
            w.put(min(run_blocks, (2 << n) - 1) - (1 << n), n)
            run_blocks -= min(run_blocks, (2 << n) - 1)

    for b in blocks:
        v = [int(np.sign(x)) * (abs(int(x)) >> al) for x in b[lo : hi + 1]]
        while v and v[-1] == 0:
            v.pop()
        if v:
            flush()
        zeros = 0
        for x in v:
            if x == 0:
                zeros += 1
                continue
            while zeros > 15:
                put(w, codes, 0xF0)
                zeros -= 16
            n, bits = magnitude(x)
            put(w, codes, zeros << 4 | n)
            w.put(bits, n)
            zeros = 0
        if len(v) < hi - lo + 1:
            run_blocks += 1
    flush()


def ac_refine(w, codes, blocks, lo, hi, al):
    for b in blocks:
        v = [int(x) for x in b[lo : hi + 1]]
        last_new = max((i for i, x in enumerate(v) if abs(x) >> al == 1), default=-1)
        zeros, pending = 0, []
        for i, x in enumerate(v):
            a = abs(x) >> al
            if i > last_new:
                pending += [a & 1] if a > 1 else []
                continue
            if a == 0:
                zeros += 1
            elif a > 1:
                pending.append(a & 1)
            else:
                while zeros > 15:
                    raise AssertionError("the test keeps runs short")
                put(w, codes, zeros << 4 | 1)
                w.put(int(x > 0), 1)
                for bit in pending:
                    w.put(bit, 1)
                zeros, pending = 0, []
        if last_new < len(v) - 1:
            put(w, codes, 0)
            for bit in pending:
                w.put(bit, 1)


def test_general_file_with_interleaved_dc_runs_and_new_coefficients():
    rng = np.random.default_rng(3)
    counts, symbols = all_symbols()
    codes = J.Table(counts, symbols).codes
    width, height = 40, 24  # 5 x 3 luma blocks, 6 x 4 in whole units
    luma, chroma = np.zeros((24, 64), int), [np.zeros((6, 64), int) for _ in range(2)]
    shown = [y * 6 + x for y in range(3) for x in range(5)]
    for r in shown:
        luma[r, rng.choice(np.arange(1, 64), 45, replace=False)] = rng.choice([-3, -2, -1, 1, 2, 3], 45)
    luma[shown[4], 1:] = luma[shown[7], 1:] = 0
    luma[:, 0] = rng.integers(-200, 200, 24)
    for c in chroma:
        c[:, 0] = rng.integers(-90, 90, 6)

    def seg(kind, body):
        return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body

    quant = bytes(range(1, 65))
    parts = [b"\xff\xd8", seg(0xDB, b"\x00" + quant), seg(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))), seg(0xC4, b"\x00" + counts + symbols + b"\x10" + counts + symbols)]

    def dc(refine):
        w, previous = Writer(), [0, 0, 0]
        for uy in range(2):
            for ux in range(3):
                unit = [(0, luma[(uy * 2 + j) * 6 + ux * 2 + i]) for j in range(2) for i in range(2)] + [(1, chroma[0][uy * 3 + ux]), (2, chroma[1][uy * 3 + ux])]
                for k, block in unit:
                    if refine:
                        w.put(int(block[0]) & 1, 1)
                        continue
                    value = int(block[0]) >> 1
                    n, bits = magnitude(value - previous[k]) if value != previous[k] else (0, 0)
                    put(w, codes, n)
                    w.put(bits, n)
                    previous[k] = value
        return w.data()

    three = bytes((3, 1, 0, 2, 0, 3, 0))
    rows = [luma[r] for r in shown]
    first, again = Writer(), Writer()
    ac_first(first, codes, rows, 1, 63, 1)
    ac_refine(again, codes, rows, 1, 63, 0)
    parts += [seg(0xDA, three + bytes((0, 0, 0x01))) + dc(False), seg(0xDA, bytes((1, 1, 0, 1, 63, 0x01))) + first.data(), seg(0xDA, three + bytes((0, 0, 0x10))) + dc(True), seg(0xDA, bytes((1, 1, 0, 1, 63, 0x10))) + again.data(), b"\xff\xd9"]
    picture = J.decode(b"".join(parts))
    assert (picture.components[0].coefficients == luma).all()
    assert all((picture.components[k + 1].coefficients == chroma[k]).all() for k in range(2))
    y = picture.planes()[0]
    zigzag = np.zeros(64)
    zigzag[J.ZIGZAG] = luma[shown[0]] * np.arange(1, 65)
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, 1 / np.sqrt(2), 1)[:, None] / 2
    assert np.allclose(y[:8, :8], basis.T @ zigzag.reshape(8, 8) @ basis + 128, atol=0.05)
    assert picture.rgb().shape == (24, 40, 3)


def test_broken_files_are_refused():
    for data in (b"", b"GIF89a", b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            J.decode(data)


def test_query_columns(docs, empty, rows):
    found = J.read(J.store(docs), tensors=False).collect()
    assert len(found) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in found:
        raw = texts[r["doc_id"]] if r["doc_id"] is not None else None
        if raw is None:
            continue
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert J.read(J.store(empty)).count() == 0
    tensor = J.read(J.store(docs.limit(1))).first()
    assert len(tensor["rgb"]) == tensor["height"] * tensor["width"] * 3
