"""Media columns: signature sniffing of binary values, type correction and carving.

One Aho-Corasick pass finds every place of a known magic string; a validator of the format then confirms
structure and lengths. What passes gives the true type of the value and the spans of media inside it.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import map_column

#: Bytes searched at a time; windows overlap by the longest magic string.
WINDOW = 1 << 20
UNKNOWN = "application/octet-stream"
#: (end, media type, start of the body, length of the body)
Found = tuple[int, str, int, int]


class Marks:
    """Where the strings that end or order a format stand in a value: found once, so that no validator searches the rest
    of a value from each of its candidates."""

    def __init__(self, data: bytes, places: dict[bytes, list[int]], starts: dict[bytes, list[int]] | None = None):
        self.data, self.places, self.starts, self.zips, self.last = data, places, starts or {}, None, {}
        self.known: dict[str, dict] = {}
        self.chunks: Chunks | None = None
        self.sums = Checksums(data)

    def next(self, mark: bytes, start: int) -> int:
        """The first place of a mark at or after start, or -1. Of marks that the automaton doesn't know, the last answer
        is remembered, which holds for all starts up to it."""
        if mark in self.places:
            found = self.places[mark]
            k = bisect_left(found, start)
            return found[k] if k < len(found) else -1
        asked, found = self.last.get(mark, (0, -2))
        if found == -2 or not (asked <= start and (found == -1 or start <= found)):
            found = self.data.find(mark, start)
            self.last[mark] = start, found
        return found

    def zip_ends(self) -> dict[int, int]:
        """Of the archives that begin at a place the last one: place of its first local header to that of its end record."""
        if self.zips is None:
            d, self.zips = self.data, {}
            for end in self.places[b"PK\x05\x06"]:
                if end + 22 > len(d):
                    break
                size, offset, comment = struct.unpack_from("<IIH", d, end + 12)
                start = end - size - offset
                whole = start >= 0 and end + 22 + comment <= len(d)
                if whole and (not size or d[start + offset : start + offset + 4] == b"PK\x01\x02"):
                    self.zips[start] = end
        return self.zips

    def follow(self, name: str, start: int, step: Callable[[int], tuple[int | None, object]], join: Callable[[object, object], object]):
        """What a chain of places that begins at start comes to, each place of a value looked at once, however many chains
        run into it. step(place) gives the next place and a fact of this one, or None and the chain's end; join puts a
        fact before what comes after it."""
        known, path, at, here = self.known.setdefault(name, {}), [], start, None
        while at not in known:
            following, fact = step(at)
            if following is None:
                known[at] = fact
                break
            path.append((at, fact))
            at = following
        here = known[at]
        for at, fact in reversed(path):
            here = known[at] = join(fact, here)
        return here


class Checksums:
    """CRC-32 of any stretch of a value. Long stretches that overlap come from sums of what lies before their ends, so
    that all together take time that grows with the value."""

    STRIDE = 4096

    def __init__(self, data: bytes):
        self.data, self.spent, self.before = data, 0, None

    def of(self, start: int, end: int) -> int:
        self.spent += end - start
        if end - start <= 2 * self.STRIDE or self.spent <= 4 * len(self.data):
            return zlib.crc32(memoryview(self.data)[start:end])
        return self.upto(end) ^ shifted(self.upto(start), end - start)

    def upto(self, end: int) -> int:
        if self.before is None:
            self.before = [0]
            for at in range(0, len(self.data), self.STRIDE):
                self.before.append(zlib.crc32(memoryview(self.data)[at : at + self.STRIDE], self.before[-1]))
        k = end // self.STRIDE
        return zlib.crc32(memoryview(self.data)[k * self.STRIDE : end], self.before[k])


def times_modulo(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, coefficients from the highest bit down."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


#: x^(8 * 2^k)
POWERS = [1 << 23]
for _ in range(40):
    POWERS.append(times_modulo(POWERS[-1], POWERS[-1]))


def shifted(crc: int, n: int) -> int:
    """What a checksum adds to that of n bytes more."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            crc = times_modulo(POWERS[k], crc)
    return crc


class Chunks:
    """All chains of RIFF chunks of a value, as trees: a chunk's parent is its end, and that one's the next chunk, a filling
    byte on where the chunk is odd. Each place is visited once; whether a chain passes an end, and where it first meets a
    kind of chunk, are then looked up."""

    KINDS = (b"fmt ", b"data", b"VP8 ", b"VP8L", b"VP8X")

    def __init__(self, d: bytes, starts: list[int]):
        after: dict[int, int | None] = {}
        for at in starts:
            while at not in after:
                after[at] = None
                if at + 8 > len(d):
                    break
                n = struct.unpack_from("<I", d, at + 4)[0]
                if at + 8 + n > len(d):
                    break
                end = after[at] = self.end(at + 8 + n, n % 2)
                at = after[end] = at + 8 + n + n % 2
        below: dict[int, list[int]] = {}
        for at, parent in after.items():
            below.setdefault(parent, []).append(at)
        self.first: dict[int, dict[bytes, int]] = {}
        self.enter, self.leave, clock = {}, {}, 0
        stack = [(at, False) for at in below.get(None, [])]
        while stack:
            at, done = stack.pop()
            if done:
                self.leave[at] = clock
                continue
            self.enter[at], clock = clock, clock + 1
            above = self.first.get(after[at], {}) if after[at] is not None else {}
            kind = d[at : at + 4] if at >= 0 and after[at] is not None else b""
            self.first[at] = above | {kind: at} if kind in self.KINDS else above
            stack.append((at, True))
            stack += [(c, False) for c in below.get(at, [])]

    @staticmethod
    def end(place: int, odd: int) -> int:
        return -2 * place - odd - 1

    def ends(self, start: int, place: int) -> bool:
        """Whether a chunk of the chain from start ends at a place, with or without a filling byte."""
        keys = [k for k in (place, self.end(place, 0), self.end(place, 1)) if k in self.enter]
        return any(self.enter[k] <= self.enter[start] < self.leave[k] for k in keys)


def png(d: bytes, at: int, marks: Marks) -> Found | None:
    """Chunks with right checksums from IHDR to IEND, each checked once however many headers lead to it."""
    if d[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None

    def step(pos: int) -> tuple[int | None, object]:
        if pos + 12 > len(d):
            return None, None
        size, kind = struct.unpack_from(">I4s", d, pos)
        end = pos + 12 + size
        if end > len(d) or marks.sums.of(pos + 4, end - 4) != struct.unpack_from(">I", d, end - 4)[0]:
            return None, None
        return (None, (end, 0) if size == 0 else None) if kind == b"IEND" else (end, kind == b"IHDR")

    # (end, headers): the chain from a place on
    found = marks.follow("png", at + 8, step, lambda header, rest: rest and (rest[0], rest[1] + header))
    return (found[0], "image/png", at + 8, found[0] - at - 8) if found and found[1] == 1 else None


FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def jpeg(d: bytes, at: int, marks: Marks) -> Found | None:
    """Marker segments with lengths up to a scan, with a frame header before it, then the end marker."""

    def step(pos: int) -> tuple[int | None, object]:
        if pos + 4 > len(d) or d[pos] != 0xFF:
            return None, None
        marker, size = d[pos + 1], struct.unpack_from(">H", d, pos + 2)[0]
        if size < 2 or marker < 0xC0 or pos + 2 + size > len(d):
            return None, None
        return (None, (pos + 2 + size, False)) if marker == 0xDA else (pos + 2 + size, marker in FRAMES)

    scan = marks.follow("jpeg", at + 2, step, lambda frame, rest: rest and (rest[0], rest[1] or frame))
    if not scan or not scan[1]:
        return None
    pos, end = scan[0], marks.next(b"\xff\xd9", scan[0]) + 2
    return (end, "image/jpeg", pos, end - pos) if end > 1 else None


def gif(d: bytes, at: int, marks: Marks) -> Found | None:
    """Screen descriptor, colour tables and blocks up to the trailer."""
    if at + 13 > len(d):
        return None
    flags = d[at + 10]
    body = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def parts(pos: int) -> tuple[int | None, object]:
        """Pieces of data with their lengths: to what follows the empty one."""
        return (pos + d[pos] + 1, None) if pos < len(d) and d[pos] else (None, pos + 1)

    def step(pos: int) -> tuple[int | None, object]:
        kind = d[pos] if pos < len(d) else 0
        if kind == 0x3B:
            return None, (pos, False)
        if kind == 0x2C and pos + 10 <= len(d):
            data = pos + 11 + (3 << (d[pos + 9] & 7) + 1 if d[pos + 9] & 0x80 else 0)
        elif kind == 0x21:
            data = pos + 2
        else:
            return None, None
        return marks.follow("gif data", data, parts, lambda _, rest: rest), kind == 0x2C

    end = marks.follow("gif", body, step, lambda image, rest: rest and (rest[0], rest[1] or image))
    return (end[0] + 1, "image/gif", body, end[0] - body) if end and end[1] else None


def bmp(d: bytes, at: int, marks: Marks) -> Found | None:
    """File size, offset of the pixels, header size, planes and depth agree."""
    if at + 30 > len(d):
        return None
    size, _, offset, header = struct.unpack_from("<IIII", d, at + 2)
    planes, depth = struct.unpack_from("<HH", d, at + 26)
    if header not in (40, 52, 56, 64, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32):
        return None
    if not 14 + header <= offset <= size or at + size > len(d):
        return None
    return at + size, "image/bmp", at + offset, size - offset


def riff(d: bytes, at: int, marks: Marks) -> Found | None:
    """RIFF chunks that fill the stated size: wave audio with format and data, or a WebP picture."""
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    end, pos = at + 8 + size, at + 12
    if end > len(d) or form not in (b"WAVE", b"WEBP"):
        return None
    if marks.chunks is None:
        marks.chunks = Chunks(d, [p + 12 for p in marks.starts[b"RIFF"]])
    if not marks.chunks.ends(pos, end):
        return None
    chunks = {k: (p + 8, struct.unpack_from("<I", d, p + 4)[0]) for k, p in marks.chunks.first[pos].items() if p < end}
    if form == b"WEBP":
        body = next((chunks[k] for k in (b"VP8 ", b"VP8L", b"VP8X") if k in chunks), None)
        return (end, "image/webp", *body) if body else None
    if b"fmt " not in chunks or b"data" not in chunks or chunks[b"fmt "][1] < 16:
        return None
    _, channels, rate, per_second, block, bits = struct.unpack_from("<HHIIHH", d, chunks[b"fmt "][0])
    if not channels or not rate or block != channels * ((bits + 7) // 8) or per_second != rate * block:
        return None
    return (end, "audio/wav", *chunks[b"data"]) if chunks[b"data"][1] % block == 0 else None


def au(d: bytes, at: int, marks: Marks) -> Found | None:
    if at + 24 > len(d):
        return None
    offset, size, encoding, rate, channels = struct.unpack_from(">IIIII", d, at + 4)
    if offset < 24 or not 1 <= encoding <= 27 or not rate or not 1 <= channels <= 64 or at + offset + size > len(d):
        return None
    return at + offset + size, "audio/basic", at + offset, size


def pdf(d: bytes, at: int, marks: Marks) -> Found | None:
    """A version, and the last end marker before the next header (or the first one after it, if there is none) that
    follows a cross-reference offset within the file: linearised files and updated ones have several."""
    if not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"." and d[at + 7 : at + 8].isdigit()):
        return None
    ends, refs = marks.places[b"%%EOF"], marks.places[b"startxref"]
    following = marks.next(b"%PDF-", at + 1)
    low, high = bisect_left(ends, at), bisect_left(ends, following) if following >= 0 else len(ends)
    for k in [*range(high - 1, low - 1, -1), *range(high, min(high + 1, len(ends)))]:
        r = bisect_left(refs, ends[k]) - 1
        if r < 0 or refs[r] <= at or ends[k] - refs[r] > 64:
            continue
        stated = d[refs[r] + 9 : ends[k]].strip()
        if stated.isdigit() and int(stated) <= refs[r] - at:
            return ends[k] + 5, "application/pdf", at, ends[k] + 5 - at
    return None


def zip_archive(d: bytes, at: int, marks: Marks) -> Found | None:
    """An end record whose central directory lies where it says, seen from this local header."""
    end = marks.zip_ends().get(at)
    if end is None:
        return None
    return end + 22 + struct.unpack_from("<H", d, end + 20)[0], "application/zip", at, end - at


def gzip(d: bytes, at: int, marks: Marks) -> Found | None:
    """A header, a body that inflates, in pieces of bounded size, and the right checksum and length."""
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    flags, body = d[at + 3], at + 10
    if flags & 4:
        body += 2 + int.from_bytes(d[body : body + 2], "little")
    for bit in (8, 16):  # name and comment
        if flags & bit:
            end = marks.next(b"\0", body)
            if end < 0:
                return None
            body = end + 1
    if flags & 2:
        body += 2
    if body < len(d) and not d[body] & 6:
        found = stored(d, body, marks)
        if found is not MIXED:
            end, crc, size = found or (len(d), 0, 0)
            if not found or d[end : end + 8] != struct.pack("<II", crc, size & 0xFFFFFFFF):
                return None
            return end + 8, "application/gzip", body, end - body
    inflate, pos, crc, size, left = zlib.decompressobj(-15), body, 0, 0, b""
    try:
        while not inflate.eof:
            left = inflate.unconsumed_tail
            if not left:
                left, pos = d[pos : pos + 65536], pos + 65536
                if not left:
                    return None
            out = inflate.decompress(left, 1 << 20)
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return None
    end = min(pos, len(d)) - len(inflate.unused_data)
    if d[end : end + 8] != struct.pack("<II", crc, size & 0xFFFFFFFF):
        return None
    return end + 8, "application/gzip", body, end - body


MIXED = object()


def stored(d: bytes, body: int, marks: Marks):
    """Of a deflate stream of stored blocks alone: (end, checksum, length) of what it holds, None if it breaks off, MIXED if
    a block of another kind comes. Blocks that many streams run into are read once."""

    def step(pos: int) -> tuple[int | None, object]:
        if pos + 5 > len(d):
            return None, None
        head, n, check = struct.unpack_from("<BHH", d, pos)
        if head & 6:
            return None, MIXED
        if n ^ check != 0xFFFF or pos + 5 + n > len(d):
            return None, None
        fact = marks.sums.of(pos + 5, pos + 5 + n), n
        return (None, (pos + 5 + n, *fact)) if head & 1 else (pos + 5 + n, fact)

    def join(fact, rest):
        return rest if rest is None or rest is MIXED else (rest[0], shifted(fact[0], rest[2]) ^ rest[1], fact[1] + rest[2])

    return marks.follow("stored", body, step, join)


def ogg(d: bytes, at: int, marks: Marks) -> Found | None:
    """Pages in a chain, the first one marked as a beginning."""
    pos, pages = at, 0
    while d[pos : pos + 4] == b"OggS" and pos + 27 <= len(d) and d[pos + 4] == 0:
        table = d[pos + 27 : pos + 27 + d[pos + 26]]
        end = pos + 27 + len(table) + sum(table)
        if end > len(d) or (not pages and not d[pos + 5] & 2) or (pages and d[pos + 5] & 2):
            break
        pos, pages = end, pages + 1
    return (pos, "application/ogg", at, pos - at) if pages else None


def mp4(d: bytes, at: int, marks: Marks) -> Found | None:
    """Boxes in a chain from ftyp up to the next ftyp, among them moov or moof. A box states its size in 32 or 64 bits;
    size 0 runs to the end of the value."""

    def size_of(pos: int, first: bool) -> int:
        if pos + 8 > len(d) or not d[pos + 4 : pos + 8].isalnum():
            return -1
        size = int.from_bytes(d[pos : pos + 4], "big")
        if size == 1 and pos + 16 <= len(d):
            size = int.from_bytes(d[pos + 8 : pos + 16], "big")
            size = size if size >= 16 else -1
        elif size == 0 and not first:
            size = len(d) - pos
        return size if size >= 8 and pos + size <= len(d) else -1

    def step(pos: int) -> tuple[int | None, object]:
        size = size_of(pos, False)
        kind = d[pos + 4 : pos + 8]
        return (None, (pos, False)) if size < 0 or kind == b"ftyp" else (pos + size, kind in (b"moov", b"moof"))

    size = size_of(at, True)
    if size < 0:
        return None
    end, movie = marks.follow("mp4", at + size, step, lambda own, rest: (rest[0], own or rest[1]))
    return (end, "video/mp4", at, end - at) if movie else None


#: Magic string, its offset in the file, validator. Fixed values of the formats.
SIGNATURES: list[tuple[bytes, int, Callable[[bytes, int, Marks], Found | None]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, png),
    (b"\xff\xd8\xff", 0, jpeg),
    (b"GIF87a", 0, gif),
    (b"GIF89a", 0, gif),
    (b"BM", 0, bmp),
    (b"RIFF", 0, riff),
    (b".snd", 0, au),
    (b"%PDF-", 0, pdf),
    (b"PK\x03\x04", 0, zip_archive),
    (b"\x1f\x8b\x08", 0, gzip),
    (b"OggS", 0, ogg),
    (b"ftyp", 4, mp4),
]
#: Strings inside files whose places the same pass collects.
INNER = (b"%%EOF", b"startxref", b"PK\x05\x06", b"%PDF-", b"\xff\xd9")
LONGEST = max(len(m) for m in [*INNER, *(m for m, _, _ in SIGNATURES)])


class Sniffer:
    def __init__(self):
        self.search = ahocorasick.Automaton()
        words = {m: [] for m in [*INNER, *(m for m, _, _ in SIGNATURES)]}
        for k, (magic, _, _) in enumerate(SIGNATURES):
            words[magic].append(k)
        for magic, which in words.items():
            self.search.add_word(magic.decode("latin-1"), (magic, which))
        self.search.make_automaton()

    def candidates(self, data: bytes) -> tuple[list[tuple[int, int]], Marks]:
        """(start of the file, signature) for every place of a magic string, and the places of the inner strings, found
        in windows of bounded size."""
        found, places = [], {m: [] for m in INNER}
        for start in range(0, len(data), WINDOW):
            back = min(start, LONGEST - 1)
            window = data[start - back : start + WINDOW].decode("latin-1")
            for end, (magic, which) in self.search.iter(window):
                at = start - back + end + 1 - len(magic)
                if end < back:
                    continue
                if magic in places:
                    places[magic].append(at)
                found += [(at - SIGNATURES[k][1], k) for k in which if at >= SIGNATURES[k][1]]
        return found, Marks(data, places, {b"RIFF": [at for at, k in found if SIGNATURES[k][2] is riff]})

    def spans(self, data: bytes | None) -> tuple[int, list[dict]]:
        """The number of candidates, and the confirmed media in order of place, outer before inner."""
        found, pages = [], 0
        tried, marks = self.candidates(data or b"")
        for at, k in tried:
            if SIGNATURES[k][2] is ogg and at < pages:
                continue  # a later page of a stream that is known already
            if hit := SIGNATURES[k][2](data, at, marks):
                end, kind, body, size = hit
                pages = end if kind == "application/ogg" else pages
                found.append({"type": kind, "start": at, "length": end - at, "body_start": body, "body_length": size})
        return len(tried), sorted(found, key=lambda x: (x["start"], -x["length"], x["type"]))


SPAN = T.StructType(
    [T.StructField("type", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "body_start", "body_length"))]
)


def sniff(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """Add media_type (what the value is), type_corrected, n_candidates and spans (all media inside).

    The type is that of the media at byte 0, or else the declared one unless that names a format whose
    signature is missing, or else application/octet-stream. Null and empty values have no spans and keep
    their declared type. Equal values get equal results.
    """
    schema = pa.struct([("type", pa.string()), *((n, pa.int64()) for n in SPAN.names[1:])])

    def make():
        sniffer = Sniffer()

        def kernel(values):
            each = [sniffer.spans(v.as_py()) for v in values]
            return [pa.array([n for n, _ in each], pa.int64()), pa.array([s for _, s in each], pa.list_(schema))]

        return kernel

    out = map_column(df, media, make, [T.StructField("n_candidates", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])
    first = F.get("spans", F.lit(0))
    sniffed = F.when(first["start"] == 0, first["type"])
    said = F.col(declared) if declared else F.lit(None).cast("string")
    known = [F.lit(x) for x in ("image/png", "image/jpeg", "image/gif", "image/bmp", "image/webp", "audio/wav", "audio/basic", "application/pdf", "application/zip", "application/gzip", "application/ogg", "video/mp4")]
    empty = F.coalesce(F.octet_length(media), F.lit(0)) == 0
    kept = F.when(empty | ~F.coalesce(said, F.lit("")).isin(*known), said)
    kind = F.coalesce(sniffed, kept, F.lit(UNKNOWN))
    return out.withColumns({"media_type": kind, "type_corrected": ~kind.eqNullSafe(said)})


def carve(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each confirmed span of a sniffed table, with its bytes in `carved`."""
    part = F.col(media).substr(F.col("span.start").cast("int") + 1, F.col("span.length").cast("int"))
    return df.withColumn("span", F.explode("spans")).withColumn("carved", part)


def little_endian(n: Column) -> Column:
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def padded_payload(text: Column, unit: int = 64) -> Column:
    """UTF-8 bytes of a text (null: none), zero-filled to a positive multiple of `unit`."""
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    size = F.greatest(F.lit(unit), (F.ceil(F.octet_length(raw) / unit) * unit).cast("int"))
    return F.rpad(raw, size, F.lit(b"\x00"))


def wave(payload: Column, rate: int = 8000) -> Column:
    """A wave file that holds the payload as unsigned 8-bit samples of one channel."""
    n = F.octet_length(payload).cast("long")
    head = struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    parts = [F.lit(b"RIFF"), little_endian(n + 36 + n % 2), F.lit(b"WAVEfmt " + head + b"data"), little_endian(n), payload]
    return F.concat(*parts, F.when(n % 2 == 1, F.lit(b"\x00")).otherwise(F.lit(b"")))


#: What text_media adds.
TEXT_MEDIA = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media_type", "type_corrected", "n_candidates", "feature"]


def text_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Store each text as a wave file, sniff that, and read the payload back from where the sniffer found it.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256, media_type,
    type_corrected, n_candidates and feature: the corrected type, place and length of the samples, and the media embedded
    in them. The text goes; other columns stay, but for those named like a new one. A null or empty text is 64 zero
    bytes; equal texts get equal values; a text is held in one task as a whole, in time that grows with its length (but for
    compressed streams within compressed streams, each of which is inflated); an empty table gives an empty one.
    """
    stay = [c for c in df.columns if c != text and c.lower() not in TEXT_MEDIA]
    others = F.struct(*[F.col(f"`{c}`") for c in stay] or [F.lit(None).alias("none")]).alias("others")
    stored = df.select(others, F.col(f"`{text}`").alias("t"))
    stored = stored.select("others", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n_bytes"), wave(padded_payload(F.col("t"))).alias("media"))
    stored = stored.withColumns({"declared": F.lit("text/plain"), "media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    seen = sniff(stored, "media", "declared")
    own = F.get("spans", F.lit(0))
    back = F.col("media").substr(own["body_start"].cast("int") + 1, own["body_length"].cast("int"))
    seen = seen.withColumn("payload", F.when(F.col("media_type") == "audio/wav", back))
    inner = F.transform(F.slice("spans", 2, 1 << 30), lambda s: F.format_string("%s@%d+%d", s["type"], s["start"] - own["body_start"], s["length"]))
    feature = F.concat_ws(";", F.format_string("%s>%s@%d+%d", "declared", "media_type", own["body_start"], own["body_length"]), F.array_join(inner, ";"))
    seen = seen.withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_sha256": F.sha2("payload", 256),
            "tail_crc32": F.crc32(F.substring("payload", -64, 64)),
            "feature": feature,
        }
    )
    return seen.select(*[F.col("others").getField(c).alias(c) for c in stay], *TEXT_MEDIA)
