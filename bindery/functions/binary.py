"""Sequential byte codecs as plain functions and as Arrow-batched columns: variable-width integers, PalmDOC, HUFF/CDIC."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def decode_vwi(data: bytes, forward: bool = True) -> tuple[int, int]:
    """(value, bytes read): groups of 7 bits up to the byte with bit 7, read from the start or from the end."""
    value = used = 0
    for b in data if forward else reversed(data):
        value = value << 7 | b & 0x7F if forward else value | (b & 0x7F) << 7 * used
        used += 1
        if b & 0x80:
            break
        if used == 8:
            break
    return value, used


def encode_vwi(value: int, forward: bool = True) -> bytes:
    """Bit 7 marks the last byte going forward, the first going backward."""
    groups = [value & 0x7F]
    while value := value >> 7:
        groups.append(value & 0x7F)
    groups.reverse()
    groups[-1 if forward else 0] |= 0x80
    return bytes(groups)


def trim_trailing(data: bytes, trailers: int, multibyte: bool) -> bytes:
    """A text record without its trailing entries, whose sizes stand at their ends, and without the overlap bytes."""
    for _ in range(trailers):
        size, _used = decode_vwi(data[-4:], forward=False)
        data = data[: len(data) - size] if size <= len(data) else b""
    if multibyte and data:
        data = data[: len(data) - (data[-1] & 3) - 1]
    return data


def palmdoc_decompress(data: bytes) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n:
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        elif i < n:
            pair = c << 8 | data[i]
            i += 1
            distance, length = pair >> 3 & 0x7FF, (pair & 7) + 3
            if not 0 < distance <= len(out):
                raise ValueError("a back reference leaves the record")
            unit = bytes(out[-distance:][:length])
            out += (unit * (length // len(unit) + 1))[:length]
    return bytes(out)


#: Bytes of short parts that are taken in one step, and the most of one part.
STEP, LONG = 1 << 16, 1 << 20


def _in_steps(parts: Iterable[bytes], f: Callable[[bytes, np.ndarray], list[bytes]]) -> Iterable[bytes]:
    """``f`` of parts joined, up to ``STEP`` bytes at a time (a longer one stands alone), and of where each of them starts and the last one ends."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part) > STEP:
            yield from f(b"".join(held), np.cumsum([0, *map(len, held)]))
            held, size = [], 0
        held.append(part)
        size += len(part)
    if held:
        yield from f(b"".join(held), np.cumsum([0, *map(len, held)]))


def _walk(jumps: np.ndarray, block: int = 64) -> np.ndarray:
    """The places reached from 0, going from each to the later one it names, before the end.

    All blocks at once find where one leaves them from each of their places; then only one place a block is walked in turn.
    """
    n = len(jumps)
    whole = -(-n // block) * block
    to = np.full(whole, whole, dtype=np.int32)
    to[:n] = jumps
    leaves, base = to.copy(), np.arange(0, whole, block, dtype=np.int32)
    for k in range(block - 2, -1, -1):
        then = to[k::block]
        inner = np.flatnonzero(then < base + block)
        leaves[base[inner] + k] = leaves[then[inner]]
    view, i, entries = memoryview(leaves), 0, []
    while i < n:
        entries.append(i)
        i = view[i]
    reached, now = np.zeros(whole + 1, dtype=bool), np.array(entries, dtype=np.int32)
    stop = (now // block + 1) * block
    while len(now):
        reached[now] = True
        now = to[now]
        inner = now < stop
        now, stop = now[inner], stop[inner]
    return np.flatnonzero(reached[:n])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _compress(data: bytes, bounds: np.ndarray) -> list[bytes]:
    padded, n = data + b"\0" * 16, len(data)
    raw, eight = np.frombuffer(padded, dtype=np.uint8), np.ndarray(n + 8, dtype="<u8", buffer=padded, strides=(1,))  # eight: the bytes from each place on
    a, at = raw[:n], np.arange(n, dtype=np.int32)
    start, end = (np.repeat(x.astype(np.int32), np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
    two, third = a | raw[1 : n + 1].astype(np.uint16) << 8, raw[2 : n + 2]
    order = np.argsort(two, kind="stable")
    order = order[np.argsort(third[order], kind="stable")]
    same = (two[order[1:]] == two[order[:-1]]) & (third[order[1:]] == third[order[:-1]])
    before = np.full(n, -1, dtype=np.int32)  # where the same three bytes stood last
    before[order[1:][same]] = order[:-1][same]
    found = (before >= start) & (at - before <= 2047) & (at + 3 <= end)
    here = np.flatnonzero(found)
    differs = eight[here + 3] ^ eight[before[here] + 3]
    length = np.full(len(here), 3, dtype=np.int32)
    for k in range(1, 8):
        length += differs & ((1 << 8 * k) - 1) == 0
    pair = ~found & (a == 32) & (at + 1 < end) & (raw[1 : n + 1] >= 0x40) & (raw[1 : n + 1] < 0x80)
    step = 1 + pair.astype(np.int32)
    step[here] = np.minimum(length, end[here] - here)
    t = _walk(at + step)
    c, copied, paired = a[t], found[t], pair[t]
    pending = ~copied & ~paired & (c != 0) & ((c < 9) | (c >= 0x80))
    k = np.arange(len(t))
    first = pending & ~(np.concatenate(([False], pending[:-1])) & (t != start[t]))
    head = pending & ((k - np.maximum.accumulate(np.where(first, k, 0))) % 8 == 0)
    size = 1 + copied + head
    place = np.cumsum(size) - size
    out = np.zeros(size.sum(), dtype=np.uint8)
    reference = 0x8000 | (t - before[t])[copied] << 3 | step[t][copied] - 3
    out[place[copied]], out[place[copied] + 1] = reference >> 8, reference & 255
    out[place[paired]] = raw[t[paired] + 1] ^ 0x80
    out[(place + head)[~copied & ~paired]] = c[~copied & ~paired]
    heads, stops = np.flatnonzero(head), np.append(np.flatnonzero(head | ~pending), len(t))
    out[place[head]] = stops[np.searchsorted(stops, heads, "right")] - heads
    cuts = np.append(place, len(out))[np.searchsorted(t, bounds)].tolist()
    whole = out.tobytes()
    return [whole[i:j] for i, j in zip(cuts, cuts[1:])]


def palmdoc_compress_all(parts: Iterable[bytes]) -> list[bytes]:
    """Each part by itself: back references of 3 to 10 bytes from the last 2047, space pairs, literals. Of a part of over ``LONG`` bytes, each ``LONG`` by themselves."""
    parts = list(parts)
    if all(len(x) <= LONG for x in parts):
        return list(_in_steps(parts, _compress))
    return [b"".join(_in_steps((x[i : i + LONG] for i in range(0, len(x), LONG)), _compress)) for x in parts]


def palmdoc_compress(data: bytes) -> bytes:
    return palmdoc_compress_all([data])[0]


def _decompress(data: bytes, bounds: np.ndarray) -> list[bytes]:
    raw, n = np.frombuffer(data + b"\0", dtype=np.uint8), len(data)
    a, at = raw[:n], np.arange(n, dtype=np.int32)
    end = np.repeat(bounds[1:].astype(np.int32), np.diff(bounds))
    run, long = (a >= 1) & (a <= 8), (a >= 0x80) & (a < 0xC0)
    step = np.minimum(1 + np.where(run, a, 0).astype(np.int32) + long, end - at)
    t = _walk(at + step)
    c, run, long, step = a[t], run[t], long[t], step[t]
    copied, paired = long & (step == 2), c >= 0xC0
    code = c.astype(np.int64) << 8 | raw[t + 1]
    size = np.where(run, step - 1, np.where(copied, (code & 7) + 3, np.where(long, 0, 1 + paired)))
    place = np.cumsum(size) - size
    out, source = np.zeros(size.sum(), dtype=np.uint8), np.arange(size.sum(), dtype=np.int32)
    ends = np.append(place, len(out))[np.searchsorted(t, bounds)]
    out[place[~run & ~long]] = np.where(paired, 32, c)[~run & ~long]
    out[place[paired] + 1] = c[paired] ^ 0x80
    inner = _within(size[run])
    out[np.repeat(place[run], size[run]) + inner] = a[np.repeat(t[run] + 1, size[run]) + inner]
    distance = (code >> 3 & 0x7FF)[copied]
    begin = ends[np.searchsorted(bounds, t[copied], "right") - 1]
    if ((distance == 0) | (distance > place[copied] - begin)).any():
        raise ValueError("a back reference leaves the record")
    target = np.repeat(place[copied], size[copied]) + _within(size[copied])
    source[target] -= np.repeat(distance, size[copied]).astype(np.int32)
    todo = target
    while len(todo):  # each turn doubles how far a byte has been followed to where it comes from
        now = source[todo]
        further = source[now]
        moved = further != now
        todo = todo[moved]
        source[todo] = further[moved]
    out[target] = out[source[target]]
    whole, cuts = out.tobytes(), ends.tolist()
    return [whole[i:j] for i, j in zip(cuts, cuts[1:])]


def palmdoc_decompress_all(parts: Iterable[bytes]) -> list[bytes]:
    """Each part by itself; one of over ``LONG`` bytes is read byte by byte."""
    parts = list(parts)
    done = iter(list(_in_steps((x for x in parts if len(x) <= LONG), _decompress)))
    return [next(done) if len(x) <= LONG else palmdoc_decompress(x) for x in parts]


class HuffCdic:
    """A dictionary of HUFF and CDIC records; phrases may themselves be compressed."""

    def __init__(self, huff: bytes, cdics: list[bytes], depth: int = 32):
        if huff[:8] != b"HUFF\0\0\0\x18":
            raise ValueError("not a HUFF record")
        at1, at2 = struct.unpack_from(">LL", huff, 8)
        self.fast = [(v & 0x1F, bool(v & 0x80), v >> 8) for v in struct.unpack_from(">256L", huff, at1)]
        bounds = struct.unpack_from(">64L", huff, at2)
        self.least = [0, *bounds[0::2]]
        self.most = [0, *bounds[1::2]]
        self.phrases: list[tuple[bytes, bool]] = []
        self.depth = depth
        for cdic in cdics:
            if cdic[:8] != b"CDIC\0\0\0\x10":
                raise ValueError("not a CDIC record")
            total, bits = struct.unpack_from(">LL", cdic, 8)
            for (offset,) in struct.iter_unpack(">H", cdic[16 : 16 + 2 * min(1 << bits, total - len(self.phrases))]):
                (head,) = struct.unpack_from(">H", cdic, 16 + offset)
                self.phrases.append((cdic[18 + offset : 18 + offset + (head & 0x7FFF)], bool(head & 0x8000)))

    def decompress(self, data: bytes, depth: int = 0) -> bytes:
        if depth > self.depth:
            raise ValueError("phrases nest too deeply")
        out, bit, total = bytearray(), 0, 8 * len(data)
        padded = int.from_bytes(data + b"\0" * 8, "big")
        width = total + 64
        while bit < total:
            window = padded >> width - bit - 32 & 0xFFFFFFFF
            size, terminal, top = self.fast[window >> 24]
            if size == 0:
                raise ValueError("a code of no length")
            if not terminal:
                while size < 32 and window >> 32 - size < self.least[size]:
                    size += 1
                top = self.most[size]
            else:
                top = (top + 1 << 32 - size) - 1 >> 32 - size
            bit += size
            if bit > total:
                break
            k = top - (window >> 32 - size)
            phrase, plain = self.phrases[k]
            if not plain:
                phrase = self.decompress(phrase, depth + 1)
                self.phrases[k] = (phrase, True)
            out += phrase
        return bytes(out)


def decompress(data: bytes, compression: int, dictionary: HuffCdic | None = None) -> bytes:
    """Compression 1: none, 2: PalmDOC, 17480: HUFF/CDIC."""
    if compression not in DECOMPRESSORS or compression == 17480 and not dictionary:
        raise ValueError(f"unknown compression {compression}")
    return DECOMPRESSORS[compression](data, dictionary)


def decompress_all(records: list[bytes], compression: int, dictionary: HuffCdic | None = None) -> list[bytes]:
    if DECOMPRESSORS.get(compression) is _palmdoc:
        return palmdoc_decompress_all(records)
    return [decompress(x, compression, dictionary) for x in records]


def _palmdoc(data: bytes, _: HuffCdic | None) -> bytes:
    return palmdoc_decompress(data)


#: Decompressors by their number in the header. Add to it to read another kind.
DECOMPRESSORS = {1: lambda data, _: data, 2: _palmdoc, 17480: lambda data, dictionary: dictionary.decompress(data)}


def _column(f, kind):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


def _batch_column(f, kind):
    """``f`` of the values of a batch that are not null."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        done = iter(f(bytes(v) for v in x if v is not None))
        return pd.Series([None if v is None else next(done) for v in x], dtype=object)

    return run


def palmdoc_decompressed(c):
    return _batch_column(palmdoc_decompress_all, "binary")(c)


def palmdoc_compressed(c):
    return _batch_column(palmdoc_compress_all, "binary")(c)


def vwi_encoded(c, forward: bool = True):
    return _column(lambda v: encode_vwi(int(v), forward), "binary")(c)


def vwi_decoded(c, forward: bool = True):
    return _column(lambda v: decode_vwi(bytes(v), forward)[0], "long")(c)


def cp1252_decoded(c):
    """Windows-1252, whose five undefined bytes become the control characters of the same number."""
    return _column(lambda v: "".join(bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in v), "string")(c)
