"""Media columns: baseline JPEG files whose DC coefficients carry a payload, and a reader for thumbnails of DC luminance.

``encode`` writes grey baseline JPEG: one 8x8 block a payload byte, the byte minus 128 as the quantised DC coefficient, no AC
coefficients, one row of 192 blocks a restart interval. With a DC quantiser of 8 a block's mean luminance is the byte itself, so
the thumbnail of DC luminance is the payload. ``decode`` is a reader of baseline files, grey or colour with any sampling, whose components
share one scan: it parses the markers, builds the Huffman tables that the file declares, decodes all restart intervals of a batch in step (numpy over intervals)
and keeps the DC values of the luminance; AC symbols are read and skipped. A payload that needs more than 65,535 pixel rows goes on in a further
file right behind (concatenated JPEG files). A long payload is written and read back file by file, ``ROWS_PER_FILE`` rows at once, so that memory is bounded by a few times the text.

Defined cases: a null text is the empty text; an empty text is 192 spaces; equal texts give equal values; further columns are kept
only in ``media_columns``; an empty table gives an empty result; progressive, lossless and damaged files and those of several scans raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffer_of, chunks, fresh

UNIT = 192
#: At most 65535 // 8; fewer keep the kernels' arrays small.
ROWS_PER_FILE = 4096
CHUNK = 700_000

#: DC table: category 0..9 with these code lengths; AC table: end of block alone, and one more code so that no code is all ones.
_DC_LENGTHS = {5: 3, 6: 2, 4: 3, 7: 3, 3: 4, 0: 4, 2: 5, 8: 5, 1: 5, 9: 6}
_AC_LENGTHS = {0x00: 1, 0x01: 2}


def _codes(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length, symbols in order, and symbol to (code, length): canonical Huffman codes as the format assigns them."""
    counts, symbols, table, code = [0] * 16, [], {}, 0
    for n in range(1, 17):
        for s in [s for s, m in lengths.items() if m == n]:
            table[s] = (code, n)
            symbols.append(s)
            counts[n - 1] += 1
            code += 1
        code <<= 1
    return counts, symbols, table


_DC, _AC = _codes(_DC_LENGTHS), _codes(_AC_LENGTHS)
_CODE = np.array([_DC[2][c][0] for c in range(10)], dtype=np.int64)
_LENGTH = np.array([_DC[2][c][1] for c in range(10)], dtype=np.int64)
_CATEGORY = np.array([abs(d).bit_length() for d in range(-512, 513)], dtype=np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    quant = bytes([0]) + bytes([8] + [1] * 63)
    frame = struct.pack(">BHHBBBB", 8, rows * 8, UNIT * 8, 1, 1, 0x11, 0)
    tables = bytes([0x00, *_DC[0], *_DC[1]]) + bytes([0x10, *_AC[0], *_AC[1]])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", UNIT)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _scan_rows(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (stuffed) of all rows one behind the other, and the length of each row."""
    rows = payload.reshape(-1, UNIT).astype(np.int64) - 128
    diff = np.diff(rows, axis=1, prepend=0)
    cat = _CATEGORY[diff + 512]
    extra = np.where(diff < 0, diff + (1 << cat) - 1, diff)
    ac_code, ac_len = _AC[2][0]
    value = ((((_CODE[cat] << cat) | extra) << ac_len) | ac_code).ravel()
    bits = (_LENGTH[cat] + cat + ac_len).ravel()
    per_row = bits.reshape(-1, UNIT).sum(axis=1)
    row_bytes = (per_row + 7) // 8
    row_start = np.concatenate([[0], np.cumsum(row_bytes)])
    ends = np.cumsum(bits.reshape(-1, UNIT), axis=1)
    at = ((row_start[:-1] * 8)[:, None] + ends).ravel() - bits
    total = int(row_start[-1])
    word, shift = at >> 5, 64 - (at & 31) - bits
    placed = value.astype(np.uint64) << shift.astype(np.uint64)
    n = total // 4 + 2
    high = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=n)
    low = np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    out = (high + low[: len(high)] if len(low) == len(high) else np.add(np.pad(high, (0, len(low) - len(high))), low)).astype(np.uint32)
    data = out.astype(">u4").view(np.uint8)[:total].copy()
    pad = row_bytes * 8 - per_row
    last = row_start[1:] - 1
    data[last] |= ((1 << pad) - 1).astype(np.uint8)
    ff = data == 0xFF
    lengths = row_bytes + np.add.reduceat(ff, row_start[:-1])
    shift_by = np.cumsum(ff) - ff
    stuffed = np.zeros(total + int(ff.sum()), dtype=np.uint8)
    stuffed[np.arange(total) + shift_by] = data
    return stuffed, lengths


def encode(payloads: list[bytes]) -> list[bytes]:
    """JPEG files, one after the other for a long payload; every payload's length is a positive multiple of 192."""
    scan, lengths = _scan_rows(np.frombuffer(b"".join(payloads), dtype=np.uint8))
    raw, ends = scan.tobytes(), np.concatenate([[0], np.cumsum(lengths)])
    out, row = [], 0
    for p in payloads:
        parts, left = [], len(p) // UNIT
        while left:
            n = min(left, ROWS_PER_FILE)
            parts.append(_header(n))
            for k in range(n):
                parts.append(raw[ends[row + k] : ends[row + k + 1]])
                if k < n - 1:
                    parts.append(bytes([0xFF, 0xD0 + k % 8]))
            parts.append(b"\xff\xd9")
            row, left = row + n, left - n
        out.append(b"".join(parts))
    return out


class _Frame:
    """What the markers of one file declare, and where its scan lies."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.quant: dict[int, int] = {}
        self.interval, parts = 0, None
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("marker expected")
            if data[at + 1] == 0xFF:
                at += 1
                continue
            marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
                if bits != 8 or not self.height or not self.width:
                    raise ValueError("samples of 8 bits and a known size are expected")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                break
            elif marker == 0xD9 or 0xC1 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a baseline file")
        if parts is None or body[0] != len(parts):
            raise ValueError("one scan with all components is expected")
        self.start = at
        self.stop = data.find(b"\xff\xd9", at)
        if self.stop < 0:
            raise ValueError("no end of image")
        # The first component is the luminance. A single component is stored block by block, several in units of their sampling.
        most = [max(p[k] for p in parts.values()) for k in (0, 1)]
        scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)) for k in range(len(parts))]
        self.grain = parts[scan[0][0]][:2] if len(parts) > 1 else (1, 1)
        self.quant_id = parts[scan[0][0]][2]
        self.units = [-(-size // (8 * m)) for size, m in zip((self.width, self.height), most, strict=True)] if len(parts) > 1 else [-(-self.width // 8), -(-self.height // 8)]
        self.size = [-(-size * g // (8 * m)) for size, g, m in zip((self.width, self.height), self.grain, most, strict=True)] if len(parts) > 1 else self.units
        #: Blocks of one unit: (component's place, DC table, AC table).
        self.pattern = tuple((k, self.tables[dc], self.tables[ac]) for k, (name, dc, ac) in enumerate(scan) for _ in range(parts[name][0] * parts[name][1] if len(parts) > 1 else 1))

    def thumbnail(self, light: np.ndarray) -> np.ndarray:
        """Luminance values in the order of the scan, as rows and columns."""
        (h, v), (across, down) = self.grain, self.units
        grid = light.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        return grid[: self.size[1], : self.size[0]]


_LOOKUPS: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """Of each 16 bits: symbol times 32 plus the code's length; 0 where no code fits."""
    if table not in _LOOKUPS:
        out, code, at = np.zeros(1 << 16, dtype=np.int32), 0, 0
        for n in range(1, 17):
            for _ in range(table[0][n - 1]):
                out[code << (16 - n) : (code + 1) << (16 - n)] = table[1][at] * 32 + n
                code, at = code + 1, at + 1
            code <<= 1
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and restart markers, and the offset of each interval."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    follow = scan[ff + 1]
    marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    keep = np.ones(len(scan), dtype=bool)
    keep[ff[follow == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    kept = np.cumsum(keep)
    return scan[keep], np.concatenate([[0], kept[marks]])


def _decode_in_step(data: np.ndarray, starts: np.ndarray, units: np.ndarray, pattern: tuple) -> np.ndarray:
    """Quantised DC values of the first component by interval (rows) and block; all intervals advance together, one symbol a step."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    window = padded[:-4] << np.uint64(32) | padded[1:-3] << np.uint64(24) | padded[2:-2] << np.uint64(16) | padded[3:-1] << np.uint64(8) | padded[4:]
    del padded
    at = starts.astype(np.int64) * 8
    steps = [(k, _lookup(dc), _lookup(ac)) for k, dc, ac in pattern]
    own, most = sum(k == 0 for k, *_ in pattern), int(units.max(initial=0))
    out = np.zeros((len(starts), most * own), dtype=np.int32)
    values = np.zeros((max(k for k, *_ in pattern) + 1, len(starts)), dtype=np.int64)
    limit, place = len(window) - 1, 0

    def peek(pos: np.ndarray, bits: int) -> np.ndarray:
        return ((window[np.minimum(pos >> 3, limit)] >> (40 - bits - (pos & 7)).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    for unit in range(most):
        live = units > unit
        who = slice(None) if bool(live.all()) else np.flatnonzero(live)
        for component, dc, ac in steps:
            pos = at[who]
            hit = dc[peek(pos, 16)]
            if not hit.all():
                raise ValueError("a code that the file does not declare")
            pos = pos + (hit & 31)
            size = hit >> 5
            raw = peek(pos, 16) >> (16 - size)
            diff = np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw)
            pos = pos + size
            values[component, who] += diff
            if component == 0:
                out[who, place] = values[0, who]
                place += 1
            # AC symbols: up to 63 coefficients or the end of the block.
            todo, k = np.arange(len(pos)), np.ones(len(pos), dtype=np.int64)
            while len(todo):
                p = pos[todo]
                hit = ac[peek(p, 16)]
                if not hit.all():
                    raise ValueError("a code that the file does not declare")
                symbol = hit >> 5
                pos[todo] = p + (hit & 31) + (symbol & 15)
                k[todo] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
                todo = todo[k[todo] < 64]
            at[who] = pos
    return out


def decode(files: list[bytes]) -> list[list[np.ndarray]]:
    """Of each stored value its thumbnails: DC luminance (rows x columns, 8 bits), one array for each JPEG file in it."""
    frames: list[tuple[int, _Frame]] = []
    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            f = _Frame(data, at)
            frames.append((i, f))
            at = f.stop + 2
    out: list[list[np.ndarray]] = [[] for _ in files]
    groups: dict[tuple, list[tuple[int, int, _Frame]]] = {}
    for nth, (i, f) in enumerate(frames):
        groups.setdefault((f.pattern, f.interval), []).append((nth, i, f))
    thumbs: list[np.ndarray | None] = [None] * len(frames)
    for (pattern, interval), members in groups.items():
        data, starts, units, base = [], [], [], 0
        for _, i, f in members:
            body, at = _intervals(np.frombuffer(files[i], dtype=np.uint8, count=f.stop - f.start, offset=f.start))
            n = f.units[0] * f.units[1]
            each = interval or n
            if len(at) != -(-n // each):
                raise ValueError("restart intervals are missing")
            data.append(body)
            starts.append(at + base)
            units.append(np.minimum(each, n - each * np.arange(len(at))))
            base += len(body)
        values = _decode_in_step(np.concatenate(data), np.concatenate(starts), np.concatenate(units), pattern)
        own, row = sum(k == 0 for k, *_ in pattern), 0
        for (nth, _, f), u in zip(members, units, strict=True):
            part = values[row : row + len(u)]
            flat = part.ravel() if u.min() * own == part.shape[1] else np.concatenate([part[k, : n * own] for k, n in enumerate(u)])
            row += len(u)
            light = flat * f.quant[f.quant_id] // 8 + 128
            thumbs[nth] = f.thumbnail(np.clip(light, 0, 255).astype(np.uint8))
    for (i, _), t in zip(frames, thumbs, strict=True):
        out[i].append(t)
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash: 8x8 cell means against their mean, 16 hexadecimal digits."""
    at = [np.minimum(np.arange(8) * n // 8, n - 1) for n in thumb.shape]
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), at[0], axis=0), at[1], axis=1)
    count = np.outer(np.maximum(np.diff([*at[0], thumb.shape[0]]), 1), np.maximum(np.diff([*at[1], thumb.shape[1]]), 1))
    means = cells / count
    return f"{int(''.join('1' if x else '0' for x in (means >= means.mean()).ravel()), 2):016x}"


def features(thumbs: list[np.ndarray]) -> str:
    """Pixel width and height of all files together, one below the other, and the hash of their thumbnails as one picture."""
    width = max(t.shape[1] for t in thumbs)
    whole = thumbs[0] if len(thumbs) == 1 else np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in thumbs])
    return f"{width * 8}x{len(whole) * 8}:{thumbnail_hash(whole)}"


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


_FIELDS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = False) -> DataFrame:
    """Store each text as media, read the stored bytes back and describe them; ``with_media`` also returns the files."""
    kept = [c for c in keep if c not in dict(_FIELDS)]
    (hidden,) = fresh(kept, "_text")
    source = docs.select(*kept, docs[text].alias(hidden))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = ", ".join(x for x in (types, _SCHEMA, "media binary" if with_media else "") if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, hidden, CHUNK):
            data, offsets = buffer_of(batch.column(len(kept)))
            sizes = np.diff(offsets).tolist()
            if len(sizes) == 1 and sizes[0] > CHUNK:
                described, stored = _long(data, with_media)
                rows, stored = [described], [stored]
            else:
                raw = data.tobytes()
                stored = encode([payload_of(raw[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)])
                rows = []
                for size, media, thumbs in zip(sizes, stored, decode(stored), strict=True):
                    back = thumbs[0].tobytes() if len(thumbs) == 1 else b"".join(t.tobytes() for t in thumbs)
                    rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(thumbs)))
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
            names = kept + [n for n, _ in _FIELDS]
            if with_media:
                columns.append(pa.array(stored, pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def _long(data: np.ndarray, with_media: bool) -> tuple[tuple, bytes]:
    """The columns of one long text, whose files are written and read back one at a time; the files themselves only where they are asked for."""
    payload, stored = hashlib.sha256(), hashlib.sha256()
    thumbs, parts, length = [], [], 0
    for a in range(0, len(data), UNIT * ROWS_PER_FILE):
        part = data[a : a + UNIT * ROWS_PER_FILE].tobytes()
        (media,) = encode([part if len(part) % UNIT == 0 else payload_of(part)])
        ((thumb,),) = decode([media])
        payload.update(thumb.tobytes())
        stored.update(media)
        length += len(media)
        thumbs.append(thumb)
        if with_media:
            parts.append(media)
    size, tail = sum(t.size for t in thumbs), thumbs[-1].tobytes()[-16:]
    return (len(data), size, payload.hexdigest(), zlib.crc32(tail), length, stored.hexdigest(), features(thumbs)), b"".join(parts)
