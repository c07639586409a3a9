"""Media columns: bytes stored as progressive JPEG, and decoded to full-resolution RGB tensors.

A payload byte is one quantised AC coefficient, 256 + byte, in zigzag order of the blocks of Y, Cb
and Cr (4:2:0, quantisation 1), so the coefficients, the unit of the format, hold it without loss.
The file has two DC scans and four kinds of AC scans: two spectral bands without their last bit,
and a refinement of all bands.

The decoder accumulates spectral-selection and successive-approximation scans of any such JPEG into
coefficient arrays, restart intervals included. Where all symbols of an AC scan have one length, or a refinement finds every
coefficient already set, it takes the bits in bulk, after checking that this is so; everything else
is decoded symbol by symbol. Blocks are inverse-transformed as one matrix product, chroma is
upsampled by repetition, and the result is an 8-bit RGB tensor of full resolution.

Defined cases: null and empty texts are one unit of padding; equal payloads give equal files and
features; files that can't be read give an error, not a failed job; texts may be as long as an image of 65,520 x 65,520 allows; no rows give no rows; columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redquill.llm.runtime import bounded_batches

UNIT = 576
AC = 63


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural index of each zigzag place, from the rule: diagonals, up and down in turn."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8)))
    return np.array([8 * r + c for _, _, r, c in cells])


@lru_cache(maxsize=1)
def inverse_transform() -> np.ndarray:
    """(64, 64): zigzag coefficients to pixels."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * math.pi / 16) * np.where(k == 0, math.sqrt(1 / 8), 0.5)
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return both[zigzag()].astype(np.float32)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8, filled up with bytes 255 to a positive multiple of 576; and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman(kind: int, number: int, lengths: dict[int, int]) -> bytes:
    """DHT of symbols with code lengths; codes go by length, then in the order given."""
    count = [0] * 17
    for n in lengths.values():
        count[n] += 1
    return _segment(0xC4, bytes([kind << 4 | number, *count[1:], *sorted(lengths, key=lambda s: lengths[s])]))


def _scan(components: list[int], first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    header = bytes([len(components), *(x for c in components for x in (c, 0)), first, last, high << 4 | low])
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return _segment(0xDA, header) + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _number_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each number, high first."""
    return np.unpackbits(np.ascontiguousarray(values.astype(">u2")).view(np.uint8).reshape(*values.shape, 2), axis=-1)[..., 16 - width :].reshape(-1)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``."""
    mcus = -(-len(payload) // (6 * AC))
    wide = math.ceil(math.sqrt(mcus))
    high = -(-mcus // wide)
    mcus = wide * high
    if wide > 4095:
        raise ValueError("the payload is too long for one image")
    data = np.zeros(6 * AC * mcus, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, AC).astype(np.uint16) + 256
    parts = [blocks[: 4 * mcus], blocks[4 * mcus : 5 * mcus], blocks[5 * mcus :]]
    out = [b"\xff\xd8", _segment(0xFE, len(payload).to_bytes(8, "big")), _segment(0xDB, bytes([0]) + b"\x01" * 64)]
    out.append(_segment(0xC2, bytes([8]) + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # DC: difference 0 is "0". AC, first scans: (run 0, 8 bits) is "0", end of block "10".
    out += [_huffman(0, 0, {0: 1}), _huffman(1, 0, {0x08: 1, 0x00: 2})]
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, np.zeros(6 * mcus, np.uint8)))
    for c, p in enumerate(parts, 1):
        for first, last in ((1, 5), (6, 63)):
            out.append(_scan([c], first, last, 0, 1, _number_bits(p[:, first - 1 : last] >> 1, 9)))
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, np.zeros(6 * mcus, np.uint8)))
    # Refinement: runs of blocks without new coefficients, 4 bits a symbol, then one bit a coefficient.
    out.append(_huffman(1, 0, {n << 4: 4 for n in range(15)}))
    for c, p in enumerate(parts, 1):
        bits = []
        for at in range(0, len(p), 32767):
            some = p[at : at + 32767]
            n = len(some).bit_length() - 1
            bits += [_number_bits(np.array([n]), 4), _number_bits(np.array([len(some) - (1 << n)]), n), (some & 1).astype(np.uint8).reshape(-1)]
        out.append(_scan([c], 1, 63, 1, 0, np.concatenate(bits)))
    return b"".join([*out, b"\xff\xd9"])


RESTART = re.compile(b"\xff[\xd0-\xd7]")


class _Bits:
    """A reader over the bits of a scan; ones follow its end."""

    def __init__(self, data: bytes):
        self.array = np.unpackbits(np.frombuffer(data, np.uint8))
        self.size, self.at = 8 * len(data), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.array[self.at : self.at + n].tolist():
            out = out << 1 | b
        missing = max(0, self.at + n - self.size)
        self.at += n
        if missing:
            out = (out if missing < n else 0) << min(missing, n) | ((1 << min(missing, n)) - 1)
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Decoder:
    """Accumulates the scans of a progressive JPEG."""

    def __init__(self, data: bytes):
        self.tables: dict[int, dict[tuple[int, int], int]] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.comment, self.interval, at = b"", 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at < len(data):
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    self.quant[body[0] & 15], body = np.frombuffer(body[1 : 1 + 64 * wide], np.uint8 if wide == 1 else ">u2").astype(np.int32), body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    count, key = body[1:17], body[0]
                    code, codes, k = 0, {}, 17
                    for n in range(1, 17):
                        for _ in range(count[n - 1]):
                            codes[n, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.tables[key], body = codes, body[k:]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                end = at
                while True:
                    end = data.index(b"\xff", end)
                    if data[end + 1] not in (0, *range(0xD0, 0xD8)):
                        break
                    end += 2
                self._read(body, [x.replace(b"\xff\x00", b"\xff") for x in (RESTART.split(data[at:end]) if self.interval else [data[at:end]])])
                at = end
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("only progressive Huffman JPEGs are read")

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.parts = {body[i]: {"h": body[i + 1] >> 4, "v": body[i + 1] & 15, "q": body[i + 2]} for i in range(6, len(body), 3)}
        top_h, top_v = max(p["h"] for p in self.parts.values()), max(p["v"] for p in self.parts.values())
        self.mcus = (-(-self.height // (8 * top_v)), -(-self.width // (8 * top_h)))
        for p in self.parts.values():
            p["rows"], p["cols"] = self.mcus[0] * p["v"], self.mcus[1] * p["h"]
            p["own"] = (-(-self.height * p["v"] // (8 * top_v)), -(-self.width * p["h"] // (8 * top_h)))
            p["coef"] = np.zeros((p["rows"] * p["cols"], 64), np.int32)
            p["up"] = (top_v // p["v"], top_h // p["h"])

    def _order(self, part: dict) -> np.ndarray:
        """Blocks of a scan of one component, row by row without the padding of whole MCUs."""
        rows, cols = part["own"]
        return (np.arange(rows)[:, None] * part["cols"] + np.arange(cols)).reshape(-1)

    def _read(self, header: bytes, stretches: list[bytes]) -> None:
        """A scan, in stretches between restart markers (one, where there are none); each starts anew."""
        n = header[0]
        ids, tables = [header[1 + 2 * i] for i in range(n)], [header[2 + 2 * i] for i in range(n)]
        first, last, high, low = header[1 + 2 * n], header[2 + 2 * n], header[3 + 2 * n] >> 4, header[3 + 2 * n] & 15
        if first == 0:
            order = self._mcu_order(ids)
            step = self.interval or len(order[0])
            for k, data in enumerate(stretches):
                self._dc(_Bits(data), ids, tables, [o[k * step : (k + 1) * step] for o in order], high, low)
            return
        part = self.parts[ids[0]]
        blocks, codes = self._order(part), self.tables[0x10 | tables[0] & 15]
        step = self.interval or len(blocks)
        fast = self._ac_refined_in_bulk if high else self._ac_in_bulk
        for k, data in enumerate(stretches):
            some = blocks[k * step : (k + 1) * step]
            if not fast(_Bits(data), part["coef"], some, codes, first, last, low):
                (self._ac_refined if high else self._ac)(_Bits(data), part["coef"], some, codes, first, last, low)

    def _mcu_order(self, ids: list[int]) -> list[np.ndarray]:
        """For each component of a DC scan, the blocks of each unit in turn: (units, blocks)."""
        if len(ids) == 1:
            return [self._order(self.parts[ids[0]])[:, None]]
        out = []
        for i in ids:
            p = self.parts[i]
            grid = np.arange(p["rows"] * p["cols"]).reshape(self.mcus[0], p["v"], self.mcus[1], p["h"]).transpose(0, 2, 1, 3)
            out.append(grid.reshape(self.mcus[0] * self.mcus[1], -1))
        return out

    def _dc(self, bits: _Bits, ids: list[int], tables: list[int], order: list[np.ndarray], high: int, low: int) -> None:
        total = sum(o.size for o in order)
        if high:
            if bits.size < total:
                raise ValueError("a scan ends early")
            got, col = bits.array[:total].reshape(len(order[0]), -1).astype(np.int32), 0
            for i, o in zip(ids, order):
                self.parts[i]["coef"][o.reshape(-1), 0] |= got[:, col : col + o.shape[1]].reshape(-1) << low
                col += o.shape[1]
            return
        if all(self.tables[t >> 4].get((1, 0)) == 0 for t in tables) and bits.size >= total and not bits.array[:total].any():
            return  # every difference is the one-bit code of zero
        before = dict.fromkeys(ids, 0)
        for m in range(len(order[0])):
            for i, t, o in zip(ids, tables, order):
                for b in o[m].tolist():
                    size = bits.symbol(self.tables[t >> 4])
                    before[i] += _extend(bits.take(size), size)
                    self.parts[i]["coef"][b, 0] = before[i] << low

    @staticmethod
    def _ac_in_bulk(bits: _Bits, coef: np.ndarray, blocks: np.ndarray, codes: dict, first: int, last: int, low: int) -> bool:
        """If the scan is one and the same (run 0, size) symbol for every coefficient."""
        for (n, code), symbol in codes.items():
            size = symbol & 15
            count = len(blocks) * (last - first + 1)
            if symbol >> 4 or not size or not 0 <= bits.size - count * (n + size) < 8:
                continue
            units = bits.array[: count * (n + size)].reshape(count, n + size)
            if (units[:, :n] != np.array([code >> (n - 1 - i) & 1 for i in range(n)], np.uint8)).any():
                continue
            if size == 8:
                value = np.packbits(units[:, n:], axis=1)[:, 0].astype(np.int32)
            else:
                value = units[:, n:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
            coef[blocks, first : last + 1] = (value << low).reshape(len(blocks), -1)
            return True
        return False

    @staticmethod
    def _ac(bits: _Bits, coef: np.ndarray, blocks: np.ndarray, codes: dict, first: int, last: int, low: int) -> None:
        ended = 0
        for b in blocks.tolist():
            if ended:
                ended -= 1
                continue
            k = first
            while k <= last:
                symbol = bits.symbol(codes)
                run, size = symbol >> 4, symbol & 15
                if size:
                    k += run
                    coef[b, k] = _extend(bits.take(size), size) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    ended = (1 << run) + bits.take(run) - 1
                    break

    @staticmethod
    def _ac_refined_in_bulk(bits: _Bits, coef: np.ndarray, blocks: np.ndarray, codes: dict, first: int, last: int, low: int) -> bool:
        """If every coefficient of the band is set already: runs of blocks, one bit a coefficient."""
        band = coef[blocks, first : last + 1]
        if not band.all():
            return False
        done, width = 0, last - first + 1
        found = np.zeros((len(blocks), width), np.int32)
        while done < len(blocks):
            symbol = bits.symbol(codes)
            if symbol & 15 or symbol >> 4 == 15:
                return False
            run = (1 << (symbol >> 4)) + bits.take(symbol >> 4)
            got = bits.array[bits.at : bits.at + run * width]
            if len(got) < run * width or run > len(blocks) - done:
                return False
            found[done : done + run] = got.reshape(run, width)
            bits.at += run * width
            done += run
        coef[blocks, first : last + 1] = band + np.sign(band) * (found << low)
        return True

    @staticmethod
    def _ac_refined(bits: _Bits, coef: np.ndarray, blocks: np.ndarray, codes: dict, first: int, last: int, low: int) -> None:
        ended, one = 0, 1 << low

        def correct(b: int, k: int) -> None:
            if bits.take(1):
                coef[b, k] += one if coef[b, k] > 0 else -one

        for b in blocks.tolist():
            k = first
            while k <= last and not ended:
                symbol = bits.symbol(codes)
                run, size, new = symbol >> 4, symbol & 15, 0
                if size:
                    new = one if bits.take(1) else -one
                elif run < 15:
                    ended = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    if coef[b, k]:
                        correct(b, k)
                    elif run == 0:
                        if size:
                            coef[b, k] = new
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
            if ended:
                for j in range(k, last + 1):
                    if coef[b, j]:
                        correct(b, j)
                ended -= 1

    def rgb(self) -> np.ndarray:
        """(height, width, 3), 8 bits."""
        planes = []
        for p in self.parts.values():
            pixels = (p["coef"] * self.quant[p["q"]]).astype(np.float32) @ inverse_transform()
            plane = pixels.reshape(p["rows"], p["cols"], 8, 8).transpose(0, 2, 1, 3).reshape(8 * p["rows"], 8 * p["cols"]) + 128
            plane = np.clip(plane, 0, 255)
            planes.append(plane.repeat(p["up"][0], axis=0).repeat(p["up"][1], axis=1)[: self.height, : self.width])
        if len(planes) == 1:
            planes = [planes[0]] * 3
            return np.stack([np.rint(p) for p in planes], axis=-1).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((*y.shape, 3), np.uint8)
        for c, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[..., c] = np.rint(np.clip(plane, 0, 255))
        return out

    def payload(self) -> bytes:
        """What ``encode`` stored."""
        n = int.from_bytes(self.comment, "big")
        return (np.concatenate([p["coef"][:, 1:].reshape(-1) for p in self.parts.values()])[:n] - 256).astype(np.uint8).tobytes()


def feature_of(rgb: np.ndarray) -> str:
    """Size, means and deviations of the channels, and the share of bright samples."""
    flat = rgb.reshape(-1, 3)
    sums, squares = flat.sum(axis=0, dtype=np.int64), np.einsum("nc,nc->c", flat, flat, dtype=np.int64)
    means = sums / len(flat)
    deviations = np.sqrt(np.maximum(squares / len(flat) - means * means, 0))
    return f"{rgb.shape[0]}x{rgb.shape[1]};" + ",".join(f"{m:.4f}" for m in means) + ";" + ",".join(f"{d:.4f}" for d in deviations) + f";{int((flat[:, 0] > 127).sum())}"


def decoded(media: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None]:
    """(height, width, rgb, error) of a file; one that can't be read has an error and nothing else."""
    if media is None:
        return None, None, None, "no file"
    try:
        rgb = Decoder(media).rgb()
    except (ValueError, KeyError, IndexError, AttributeError, OverflowError) as e:  # whatever a broken file leads to
        return None, None, None, f"{type(e).__name__}: {e}"
    return rgb.shape[0], rgb.shape[1], rgb.tobytes(), None


def decode_media(files: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``files`` with height, width, rgb (8 bits, row by row) and error of each file; these names must be free."""
    clash = {"height", "width", "rgb", "error"} & set(files.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    bounded_batches(files.sparkSession, 64)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", height int, width int, rgb binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                values = decoded(one.column(one.schema.names.index(media_col))[0].as_py())
                new = [pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*one.columns, *new], names=[*one.schema.names, "height", "width", "rgb", "error"])

    return files.mapInArrow(run, schema)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload, media (the JPEG), height, width, rgb, feature: stored and read back.

    Without ``tensors`` the three large columns, the RGB tensor among them, are given as their digests: payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, height, width, rgb_sha256.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    large = "payload binary, media binary, height int, width int, rgb binary"
    digests = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, rgb_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                rows = []
                for text in b.column(1).to_pylist():
                    raw, n = padded(text)
                    media = encode(raw)
                    read = Decoder(media)
                    back, rgb = read.payload(), read.rgb()
                    if tensors:
                        rows.append((n, back, media, rgb.shape[0], rgb.shape[1], rgb.tobytes(), feature_of(rgb)))
                    else:
                        rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), rgb.shape[0], rgb.shape[1], hashlib.sha256(rgb).hexdigest(), feature_of(rgb)))
                kinds = [pa.int64(), *((pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()) if tensors else (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = ["n_bytes", *(x.split()[0] for x in (large if tensors else digests).split(", ")), "feature"]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, {large if tensors else digests}, feature string")
