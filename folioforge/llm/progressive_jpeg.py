"""Progressive JPEG media columns: payload bytes as coefficients, scans accumulated, full-resolution RGB tensors.

A payload of 64-byte blocks is kept without loss in the format's own unit, the quantized coefficient: byte b is the
coefficient b from 128 on and b - 255 below, so each has nine bits with a sign and none is zero. The image has a
luminance and two half-size chrominance components, which take the blocks in turn; each is sent in a DC scan, two
spectral bands without their last bit, and refinement scans for that bit. decode() reads any progressive Huffman file
scan by scan into coefficient arrays; scans with the tables written here, whose codes and values have one common
length, are read as arrays. rgb() transforms back, upsamples chroma and converts.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import sliced

BANDS = ((1, 5), (6, 63))
#: A DC difference of category s has a code of DC_BITS - s bits and s more; AC values one code and 7 bits; runs 4-bit codes.
DC_BITS = 11
RUN_MOST = 32767


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in the order of the scan."""
    order = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * row + col for row, col in order])


ZIGZAG = zigzag()


def inverse_matrix() -> np.ndarray:
    """Coefficients in scan order -> 64 samples."""
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * np.arange(8)[None, :] + 1) * k[:, None] * np.pi / 16)
    whole = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return whole[ZIGZAG].astype(np.float32)


INVERSE = inverse_matrix()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def table_segment(kind: int, number: int, symbols: list[tuple[int, int]]) -> bytes:
    """symbols: (code length, symbol), by length."""
    counts = bytes(sum(1 for n, _ in symbols if n == k) for k in range(1, 17))
    return bytes([kind << 4 | number]) + counts + bytes(s for _, s in symbols)


DC_SYMBOLS = [(DC_BITS - s, s) for s in range(8, -1, -1)]
RUN_SYMBOLS = [(4, n << 4) for n in range(15)]
TABLES = segment(0xC4, table_segment(0, 0, DC_SYMBOLS) + table_segment(1, 0, [(1, 7)]) + table_segment(1, 1, RUN_SYMBOLS))


def codes(symbols: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), as the format assigns them."""
    out, code, last = {}, 0, 0
    for n, s in symbols:
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def dc_words() -> np.ndarray:
    """The DC_BITS bits of each difference from -255 to 255."""
    own, out = codes(DC_SYMBOLS), np.zeros(511, dtype=np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        out[d + 255] = own[s][0] << s | (d if d > 0 else d + (1 << s) - 1)
    return out


DC_WORDS = dc_words()
DC_VALUES = np.full(1 << DC_BITS, 1 << 14, dtype=np.int16)
DC_VALUES[DC_WORDS] = np.arange(-255, 256)


def stuffed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled with ones, a zero behind each 0xFF."""
    fill = -len(bits) % 8
    raw = np.packbits(np.concatenate([bits, np.ones(fill, dtype=np.uint8)]) if fill else bits).tobytes()
    return raw.replace(b"\xff", b"\xff\0")


def word_bits(values: np.ndarray, n: int) -> np.ndarray:
    return (values[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8).ravel()


def refinement(bits: np.ndarray, blocks: int) -> bytes:
    """Every coefficient is known to be other than zero: a run of ended blocks, then a bit for each coefficient."""
    own, out, per = codes(RUN_SYMBOLS), [], bits.size // max(blocks, 1)
    for lo in range(0, blocks, RUN_MOST):
        run = min(RUN_MOST, blocks - lo)
        n = run.bit_length() - 1
        out += [word_bits(np.array([own[n << 4][0] << n | run - (1 << n)]), 4 + n), bits[lo * per : (lo + run) * per]]
    return stuffed(np.concatenate(out))


def shape_of(blocks: int) -> tuple[int, int]:
    """Columns and rows of units of 16 x 16 samples for so many blocks, six in a unit."""
    units = max(1, -(-blocks // 6))
    cols = -(-units // 4095)
    return cols, -(-units // cols)


def encode(payload: bytes) -> bytes:
    """The payload, of a positive multiple of 64 bytes, as a progressive JPEG."""
    data = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64)
    cols, rows = shape_of(len(data))
    units = cols * rows
    every = np.zeros((6 * units, 64), dtype=np.uint8)
    every[: len(data)] = data
    out = [b"\xff\xd8", segment(0xFE, struct.pack(">Q", len(payload))), segment(0xDB, b"\0" + b"\1" * 64), segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), TABLES]
    bounds = (0, 4 * units, 5 * units, 6 * units)
    for c in range(3):
        own = every[bounds[c] : bounds[c + 1]]
        dc = (own[:, 0].astype(np.int16) - np.where(own[:, 0] < 128, 255, 0).astype(np.int16))
        low = (own & 1) ^ (own < 128)
        parts = [(0, 0, 0, 1, stuffed(word_bits(DC_WORDS[np.diff(dc >> 1, prepend=np.int16(0)) + 255], DC_BITS)))]
        parts += [(a, b, 0, 1, (own[:, a : b + 1] >> 1).tobytes()) for a, b in BANDS]  # a zero code and seven bits
        parts += [(0, 0, 1, 0, stuffed((dc & 1).astype(np.uint8)))]
        parts += [(a, b, 1, 0, refinement(low[:, a : b + 1].ravel(), len(own))) for a, b in BANDS]
        for a, b, high, to, body in parts:
            out += [segment(0xDA, bytes([1, c + 1, 1 if a and high else 0, a, b, high << 4 | to])), body]
    return b"".join(out) + b"\xff\xd9"


class Bits:
    """Bit by bit, for scans that aren't read as arrays."""

    def __init__(self, raw: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).tolist(), 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def number(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def value(self, n: int) -> int:
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (found := table.get((n, code))) is not None:
                return found
        raise ValueError("no such code")


def scan_bits(bits: Bits, coef: np.ndarray, order: list, a: int, b: int, high: int, low: int, dc: list, ac: dict) -> None:
    """Add a scan to the coefficient arrays. order: (component, block) in the order of the scan; coef by component."""
    last, run = {}, 0
    for c, k in order:
        block = coef[c][k]
        if not a:
            if high:
                block[0] |= bits.one() << low
            else:
                last[c] = last.get(c, 0) + bits.value(bits.symbol(dc[c]))
                block[0] = last[c] << low
            continue
        z = a
        if not run:
            while z <= b:
                r, s = divmod(bits.symbol(ac), 16)
                if not s and r < 15:
                    run = (1 << r) + bits.number(r)
                    break
                new = bits.value(s) << low if s and not high else ((1 << low) * (1 if bits.one() else -1) if s else 0)
                while z <= b:
                    if high and block[z]:
                        if bits.one():
                            block[z] += (1 << low) * (1 if block[z] > 0 else -1)
                    elif not r:
                        break
                    else:
                        r -= 1
                    z += 1
                if z <= b:
                    if new:
                        block[z] = new
                    z += 1
        if run:
            if high:
                for z in range(z, b + 1):
                    if block[z] and bits.one():
                        block[z] += (1 << low) * (1 if block[z] > 0 else -1)
            run -= 1


def scan_array(raw: bytes, block: np.ndarray, a: int, b: int, high: int, low: int, symbols: list) -> bool:
    """The same for one component whose codes and values have one common length; False if the scan isn't so."""
    n, width = len(block), b - a + 1
    if not a and not high and symbols == DC_SYMBOLS:
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8))[: DC_BITS * n].reshape(n, DC_BITS)
        diff = DC_VALUES[bits @ (1 << np.arange(DC_BITS - 1, -1, -1))]
        block[:, 0] = np.cumsum(diff, dtype=np.int64) << low
        return True
    if not a and high:
        block[:, 0] |= np.unpackbits(np.frombuffer(raw, dtype=np.uint8))[:n].astype(block.dtype) << low
        return True
    if a and not high and symbols == [(1, 7)] and len(raw) == n * width:
        v = np.frombuffer(raw, dtype=np.uint8).reshape(n, width).astype(block.dtype)
        block[:, a : b + 1] = np.where(v < 64, v - 127, v) << low
        return True
    if a and high and symbols == RUN_SYMBOLS and (block[:, a : b + 1] != 0).all():
        bits, at, parts = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)), 0, []
        for lo in range(0, n, RUN_MOST):
            run = min(RUN_MOST, n - lo)
            k = run.bit_length() - 1
            if bits[at : at + 4] @ (8, 4, 2, 1) != k or bits[at + 4 : at + 4 + k] @ (1 << np.arange(k - 1, -1, -1)) != run - (1 << k):
                return False
            at += 4 + k + run * width
            parts.append(bits[at - run * width : at])
        own, more = block[:, a : b + 1], np.concatenate(parts).reshape(n, width).astype(block.dtype) << low
        own += np.where(own < 0, -more, more)
        return True
    return False


def decode(media: bytes) -> dict:
    """Accumulated coefficients of a progressive JPEG: width, height, and for each component its sampling, grid and blocks.

    Blocks hold quantized coefficients in scan order; comment has the file's first comment.
    """
    out: dict = {"components": {}, "comment": None}
    quant, tables, restart, at = {}, {}, 0, 2
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE and out["comment"] is None:
            out["comment"] = body
        elif marker == 0xDB:
            while body:
                wide, number = divmod(body[0], 16)
                quant[number] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=1).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                lengths = [k + 1 for k in range(16) for _ in range(body[1 + k])]
                tables[divmod(body[0], 16)] = list(zip(lengths, body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            spec = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            hm, vm = max(s[1] >> 4 for s in spec), max(s[1] & 15 for s in spec)
            out |= {"width": width, "height": height, "units": (-(-width // (8 * hm)), -(-height // (8 * vm)))}
            for name, hv, q in spec:
                h, v = divmod(hv, 16)
                grid = (out["units"][0] * h, out["units"][1] * v)
                own = (-(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8))
                out["components"][name] = {"h": h, "v": v, "hm": hm, "vm": vm, "grid": grid, "own": own, "q": q, "blocks": np.zeros((grid[0] * grid[1], 64), dtype=np.int32)}
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman file")
        elif marker == 0xDA:
            names = [(body[1 + 2 * k], *divmod(body[2 + 2 * k], 16)) for k in range(body[0])]
            a, b, high, low = body[-3], body[-2], *divmod(body[-1], 16)
            end = at
            while not (media[end] == 0xFF and media[end + 1] and not 0xD0 <= media[end + 1] <= 0xD7):
                end = media.index(b"\xff", end + 1)
            raw, at = media[at:end], end
            comps = out["components"]
            one = comps[names[0][0]]
            if len(names) == 1 and not restart and one["own"] == one["grid"] and scan_array(raw.replace(b"\xff\0", b"\xff"), one["blocks"], a, b, high, low, tables.get((1, names[0][2]) if a else (0, names[0][1]), [])):
                continue
            if len(names) == 1:
                order = [(names[0][0], y * one["grid"][0] + x) for y in range(one["own"][1]) for x in range(one["own"][0])]
                every = restart or len(order)
            else:
                per = [(n, x, y) for n, _, _ in names for y in range(comps[n]["v"]) for x in range(comps[n]["h"])]
                order = [(n, (uy * comps[n]["v"] + y) * comps[n]["grid"][0] + ux * comps[n]["h"] + x) for uy in range(out["units"][1]) for ux in range(out["units"][0]) for n, x, y in per]
                every = (restart or len(order)) * (len(per) if restart else 1)
            coded = {k: {(n, c): s for s, (c, n) in codes(t).items()} for k, t in tables.items()}
            parts, lo = [], 0
            for k in range(len(raw) - 1):
                if raw[k] == 0xFF and 0xD0 <= raw[k + 1] <= 0xD7:
                    parts.append(raw[lo:k])
                    lo = k + 2
            parts.append(raw[lo:])
            for k, part in enumerate(parts):
                scan_bits(Bits(part.replace(b"\xff\0", b"\xff")), {n: comps[n]["blocks"] for n, _, _ in names}, order[k * every : (k + 1) * every], a, b, high, low, {n: coded.get((0, d)) for n, d, _ in names}, coded.get((1, names[0][2])))
    out["quant"] = quant
    return out


def payload_of(image: dict) -> bytes:
    """The bytes that encode() was given."""
    size = struct.unpack(">Q", image["comment"])[0]
    every = np.concatenate([c["blocks"] for c in image["components"].values()])[: size // 64]
    return np.where(every < 0, every + 255, every).astype(np.uint8).tobytes()


def rgb(image: dict) -> np.ndarray:
    """height x width x 3 samples: dequantized, inverse-transformed, chroma repeated to full resolution, converted."""
    planes = []
    for c in image["components"].values():
        flat = (c["blocks"] * image["quant"][c["q"]]).astype(np.float32) @ INVERSE + np.float32(128)
        w, h = c["grid"]
        plane = flat.reshape(h, w, 8, 8).swapaxes(1, 2).reshape(8 * h, 8 * w)
        up = (c["vm"] // c["v"], c["hm"] // c["h"])
        if up != (1, 1):
            plane = plane.repeat(up[0], axis=0).repeat(up[1], axis=1)
        planes.append(plane[: image["height"], : image["width"]])
    if len(planes) == 1:
        planes *= 3
        mixed = np.stack(planes, axis=-1)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        mixed = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) with zero bytes up to a positive multiple of 64, as a JPEG.

    Rows are independent; repeated rows give equal media, an empty table none; other columns are ignored. A long text is one
    image of up to 65,535 x 65,535 samples, about 2.8 GB of payload; memory follows its length.
    """

    def run(batches):
        for some in sliced(batches, size=4 << 20):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()]
            media = [encode(t + bytes(-len(t) % 64 if t else 64)) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def tensor_column(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media with payload, height, width and rgb (height x width x 3 bytes), all from the media's bytes; a null media has none."""

    def run(batches):
        names = ["doc_id", "n_bytes", "media", "payload", "height", "width", "rgb"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                images = [decode(m) if m is not None else None for m in some.column("media").to_pylist()]
                cols = [[f(i) if i else None for i in images] for f in (payload_of, lambda i: i["height"], lambda i: i["width"], lambda i: rgb(i).tobytes())]
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.binary())))], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, height int, width int, rgb binary")
