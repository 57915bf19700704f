"""Baseline JPEG in numpy: an encoder for lossless byte payloads and a decoder for DC thumbnails.

The payload is stored with one byte in each 8x8 block: a block of a constant grey level, whose DC
coefficient at quantiser step 8 is the level itself (less 128) and whose AC coefficients are zero. Any
JPEG viewer shows the bytes as grey squares, and the DC-only luminance thumbnail, a pixel for each
block, gives the payload back. ``TONES`` says which level a byte has: a fixed permutation that puts
the characters of written text next to mid-grey, as DC coefficients are stored as differences and
small ones take fewer bits.

The decoder takes any baseline sequential JPEG of 8-bit samples: it parses the markers, splits the
scan at its restart markers, and Huffman-decodes all segments of equal structure in step, a block at a
time, so that numpy works on a column of segments. AC coefficients are decoded and dropped.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

#: The encoder's blocks a row, blocks between restart markers, and most rows (65535 samples at most).
ROW, RESTART, MOST_ROWS = 24, 288, 8184
#: Frequent characters of texts in Latin letters, the most frequent first; 255 fills payloads.
FREQUENT = b" etaoinsrhldcumfpgwybvkxjqz,.\n\xff-'0123456789"
#: The encoder's Huffman tables: code lengths of the DC size categories, and a single AC symbol (end of block).
DC_LENGTHS = {3: 2, 0: 3, 1: 3, 2: 3, 4: 3, 6: 4, 7: 4, 5: 5, 8: 5, 9: 6, 10: 7, 11: 8}
AC_LENGTHS = {0: 1}


def _tones() -> np.ndarray:
    """The level of each byte: 128, 129, 127, 130, ... in order of frequency, then in order of bytes."""
    levels = sorted(range(256), key=lambda v: (abs(v - 128), -v))
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    found = np.zeros(256, np.uint8)
    found[order] = levels
    return found


#: Byte -> level, and back.
TONES = _tones()
BYTES = np.argsort(TONES).astype(np.uint8)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical Huffman table."""
    code, last, codes = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        codes[symbol], last = (code, n), n
        code += 1
    return codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    ordered = sorted(lengths.items(), key=lambda x: x[1])
    counts = bytes(sum(n == i for _, n in ordered) for i in range(1, 17))
    return bytes([kind]) + counts + bytes(s for s, _ in ordered)


def header(rows: int, row: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8]) * 64),
        _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, row * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, _table(0x00, DC_LENGTHS) + _table(0x10, AC_LENGTHS)),
        _segment(0xDD, struct.pack(">H", RESTART)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference + 255: the bits of a whole block and their number."""
    dc, (end, end_n) = canonical(DC_LENGTHS), canonical(AC_LENGTHS)[0]
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = ((code << size | extra) << end_n) | end
        sizes[d + 255] = n + size + end_n
    return bits, sizes


_BITS, _SIZES = _block_codes()


def shapes(blocks: int) -> list[tuple[int, int]]:
    """(rows, blocks a row) of the images that hold so many blocks, a multiple of 576."""
    row = ROW if blocks <= ROW * MOST_ROWS else 576
    full, rest = divmod(blocks, row * MOST_ROWS)
    return [(MOST_ROWS, row)] * full + ([(rest // row, row)] if rest else [])


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 576 bytes) as one baseline JPEG, or several one after another."""
    images = [shape for p in payloads for shape in shapes(len(p))]
    data = TONES[np.frombuffer(b"".join(payloads), np.uint8)].astype(np.int64).reshape(-1, RESTART)
    diff = data - 128
    diff[:, 1:] = data[:, 1:] - data[:, :-1]
    bits, sizes = _BITS[diff + 255], _SIZES[diff + 255]
    ends = np.cumsum(sizes, axis=1)
    seg_bytes = (ends[:, -1] + 7) >> 3
    seg_at = np.concatenate([[0], np.cumsum(seg_bytes)])
    at = (seg_at[:-1, None] * 8 + ends - sizes).ravel()
    window = bits.ravel() << (40 - (at & 7) - sizes.ravel())
    raw = np.zeros(int(seg_at[-1]) + 5, np.int64)
    first = at >> 3
    for k in range(4):  # a block takes at most 20 bits, so 27 from the start of its first byte
        raw += np.bincount(first + k, weights=((window >> (32 - 8 * k)) & 255), minlength=len(raw)).astype(np.int64)
    raw = raw[: seg_at[-1]]
    raw[seg_at[1:] - 1] |= (1 << (seg_bytes * 8 - ends[:, -1])) - 1  # ones fill the last byte of a segment
    # Byte stuffing, and room for a restart marker before each segment but an image's first.
    n_seg = np.array([rows * row // RESTART for rows, row in images])
    image_seg = np.concatenate([[0], np.cumsum(n_seg)])
    ordinal = np.arange(len(data)) - np.repeat(image_seg[:-1], n_seg)
    stuffed = raw == 255
    shift = np.cumsum(stuffed) - stuffed
    marks = np.cumsum(ordinal > 0) * 2
    seg_of = np.repeat(np.arange(len(data)), seg_bytes)
    to = np.arange(len(raw)) + shift + marks[seg_of]
    total = len(raw) + int(stuffed.sum()) + int(marks[-1])
    out = np.zeros(total, np.uint8)
    out[to] = raw
    with_mark = np.flatnonzero(ordinal > 0)
    start = to[seg_at[:-1][with_mark]]
    out[start - 2], out[start - 1] = 255, 0xD0 + (ordinal[with_mark] - 1) % 8
    edges = np.concatenate([to[seg_at[image_seg[:-1]]], [total]])
    scans = [header(*shape) + out[edges[i] : edges[i + 1]].tobytes() + b"\xff\xd9" for i, shape in enumerate(images)]
    found, i = [], 0
    for p in payloads:
        n = len(shapes(len(p)))
        found.append(b"".join(scans[i : i + n]))
        i += n
    return found


@dataclass
class Image:
    """A parsed baseline JPEG."""

    width: int = 0
    height: int = 0
    #: component id, horizontal and vertical sampling, quantiser table, DC table, AC table
    components: list[list[int]] = field(default_factory=list)
    scan: list[int] = field(default_factory=list)
    quantisers: dict[int, int] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    segments: list[bytes] = field(default_factory=list)

    @property
    def mcus(self) -> tuple[int, int]:
        """Columns and rows of the scan's coding units."""
        if len(self.scan) == 1:  # not interleaved: a unit is a block of the component
            _, h, v, *_ = self.components[self.scan[0]]
            hm, vm = self.most
            return -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)
        hm, vm = self.most
        return -(-self.width // (8 * hm)), -(-self.height // (8 * vm))

    @property
    def most(self) -> tuple[int, int]:
        return max(c[1] for c in self.components), max(c[2] for c in self.components)

    def blocks(self) -> list[int]:
        """The component of each block of a coding unit."""
        if len(self.scan) == 1:
            return [self.scan[0]]
        return [c for c in self.scan for _ in range(self.components[c][1] * self.components[c][2])]


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that starts at ``at``, and where it ends."""
    image = Image()
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return image, at + 2
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4, body[i] & 15
                image.quantisers[name] = struct.unpack_from(">H" if wide else ">B", body, i + 1)[0]
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                image.tables[body[i]] = body[i + 1 : i + 17 + n]
                i += 17 + n
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("samples of 8 bits only")
            image.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("baseline only")
        elif marker == 0xDA:
            names = {c[0]: i for i, c in enumerate(image.components)}
            scan = []
            for i in range(body[0]):
                c = names[body[1 + 2 * i]]
                image.components[c][4:] = [body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15]
                scan.append(c)
            end = _scan_end(data, at)
            if 0 in scan:  # luminance; other scans are skipped
                image.scan, image.segments = scan, _segments(data[at:end])
            at = end


def _scan_end(data: bytes, at: int) -> int:
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _segments(scan: bytes) -> list[bytes]:
    raw = np.frombuffer(scan, np.uint8)
    marks = np.flatnonzero(raw[:-1] == 255)
    marks = marks[(raw[marks + 1] >= 0xD0) & (raw[marks + 1] <= 0xD7)]
    edges = [0, *(marks + 2).tolist(), len(scan) + 2]
    return [scan[a : b - 2].replace(b"\xff\x00", b"\xff") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _lookup(table: bytes) -> np.ndarray:
    """16 bits ahead -> symbol << 8 | code length; 0 where no code fits."""
    found, code, at = np.zeros(65536, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            found[code << (16 - n) : (code + 1) << (16 - n)] = table[at] << 8 | n
            code, at = code + 1, at + 1
        code <<= 1
    return found


def dc_values(images: list[Image]) -> list[np.ndarray]:
    """The DC coefficients (before dequantising) of each image's luminance blocks, in scan order."""
    alike: dict[tuple, list[int]] = defaultdict(list)
    for i, image in enumerate(images):
        kinds = tuple((c, image.tables[image.components[c][4]], image.tables[image.components[c][5]]) for c in image.blocks())
        alike[kinds].append(i)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(images)
    for kinds, members in alike.items():
        segments, units, owner = [], [], []
        for i in members:
            total = images[i].mcus[0] * images[i].mcus[1]
            step = images[i].restart or total
            if len(images[i].segments) != -(-total // step):
                raise ValueError("restart markers are missing")
            segments += images[i].segments
            units += [min(step, total - s) for s in range(0, total, step)]
            owner.append(len(segments))
        values = _decode(kinds, segments, np.array(units))
        start = 0
        for i, end in zip(members, owner, strict=True):
            found[i] = np.concatenate(values[start:end])
            start = end
    return found


def _decode(kinds: tuple, segments: list[bytes], units: np.ndarray) -> list[np.ndarray]:
    """The luminance DC values of each segment. All segments go in step, the longest first."""
    order = np.argsort(-units, kind="stable")
    sizes = np.array([len(s) for s in segments])
    joined = b"".join(s + b"\xff" * 8 for s in segments)
    data = np.frombuffer(joined, np.uint8).astype(np.int64)
    n = len(data) - 4
    ahead = (data[:n] << 32) | (data[1 : n + 1] << 24) | (data[2 : n + 2] << 16) | (data[3 : n + 3] << 8) | data[4 : n + 4]
    start = np.concatenate([[0], np.cumsum(sizes + 8)[:-1]])
    at, limit = (start * 8)[order], ((start + sizes + 1) * 8)[order]
    dc = [_lookup(d) for _, d, _ in kinds]
    ac = [_lookup(a) for _, _, a in kinds]
    luma = [c == 0 for c, _, _ in kinds]
    per, most = sum(luma), int(units.max())
    values = np.zeros((len(segments), most * per), np.int64)
    before = np.zeros((max(c for c, _, _ in kinds) + 1, len(segments)), np.int64)
    sorted_units, filled = units[order], 0

    def symbol(table: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, code length, bits ahead and bit offset there."""
        bits, off = ahead[pos >> 3], pos & 7
        entry = table[(bits >> (24 - off)) & 0xFFFF]
        if not entry.all():
            raise ValueError("no such Huffman code")
        return entry >> 8, entry & 255, bits, off

    for u in range(most):
        live = int(np.searchsorted(-sorted_units, -u, side="left"))
        for b, (c, _, _) in enumerate(kinds):
            pos = at[:live]
            size, n_bits, bits, off = symbol(dc[b], pos)
            extra = (bits >> (40 - off - n_bits - size)) & ((1 << size) - 1)
            value = np.where((extra >> np.maximum(size - 1, 0)) | (size == 0), extra, extra - (1 << size) + 1)
            before[c, :live] += value
            if luma[b]:
                values[:live, filled] = before[c, :live]
                filled += 1
            pos = pos + n_bits + size
            lanes, k = np.arange(live), np.ones(live, np.int64)
            at[:live] = pos
            while len(lanes):
                sym, n_bits, _, _ = symbol(ac[b], at[lanes])
                at[lanes] += n_bits + (sym & 15)
                k = np.where(sym == 0, 64, k + (sym >> 4) + 1)
                left = k < 64
                lanes, k = lanes[left], k[left]
            if (at[:live] > limit[:live]).any():
                raise ValueError("a segment ends early")
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segments)
    for lane, i in enumerate(order):
        found[i] = values[lane, : units[i] * per]
    return found


def thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Of each stream of one or more JPEGs: (width, height, DC-only luminance, a pixel for each block)."""
    images, owner = [], []
    for data in streams:
        at, n = 0, 0
        while at < len(data):
            image, at = parse(data, at)
            images.append(image)
            n += 1
        owner.append(n)
    found, i = [], 0
    every = dc_values(images)
    for n in owner:
        found.append([(im.width, im.height, _pixels(im, v)) for im, v in zip(images[i : i + n], every[i : i + n], strict=True)])
        i += n
    return found


def _pixels(image: Image, values: np.ndarray) -> np.ndarray:
    """Blocks in scan order as rows of pixels, cut to the image's size."""
    _, h, v, q, *_ = image.components[0]
    columns, rows = image.mcus
    grey = np.clip((values * image.quantisers[q] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    if len(image.scan) > 1:
        grey = grey.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    hm, vm = image.most
    return grey.reshape(-1, columns * (h if len(image.scan) > 1 else 1))[: -(-(-(-image.height * v // vm)) // 8), : -(-(-(-image.width * h // hm)) // 8)]


def average_hash(pixels: np.ndarray) -> str:
    """64 bits, as hex digits: is a cell of an 8x8 grid over the thumbnail brighter than the mean cell?"""
    h, w = pixels.shape
    rows, columns = np.arange(8) * h // 8, np.arange(8) * w // 8
    cells = np.add.reduceat(np.add.reduceat(pixels, rows, axis=0, dtype=np.int64), columns, axis=1)
    areas = np.outer(np.maximum(np.diff(np.append(rows, h)), 1), np.maximum(np.diff(np.append(columns, w)), 1))
    means = cells / areas
    return np.packbits(means > means.mean()).tobytes().hex()
