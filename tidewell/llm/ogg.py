"""Ogg columns: from physical bitstreams to the packets of each logical stream, with timestamps.

A page counts if its checksum (CRC-32, polynomial 0x04c11db7, over the page with the checksum as zeros) is right; others
are counted and skipped, and the search for the next page goes on right behind their capture pattern. Packets are put together
from the lacing values, across pages where the next page continues them; a packet that lost a page is dropped, and what of
it follows is skipped. Pages go to their streams by serial number. A page's granule position is the end of the last packet that ends on it;
where the packets' durations are known (Opus, from their first byte; Vorbis, from the block sizes of their modes, which stand at the
end of the setup header), the ends of the others are counted back from it, else only a page's last packet has a time. A stream's last page may say an end before that of its last packet, whose rest isn't to be
played: on a page with the end flag, ends are counted forward from the page before (from 0 if none has a time; without one where
pages were lost) and none lies beyond the page's. The clock is 48 kHz less the pre-skip for Opus, the sample rate of the identification
header for Vorbis, and `rate` (none by default) for others.

Defined cases: null and empty columns have no packet; an id is a whole number or null; bytes before, between and after pages are passed over; a page cut short
counts as damaged; a granule of -1 gives no time; repeated rows are each read; an empty table gives an empty result; extra columns
are not read, whatever their names; streams of any length are read whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import at, read

TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
HEADER = struct.Struct("<4sBBqIIIB")
SCHEMA = "id long, serial long, packet long, n_bytes long, digest long, granule long, end_ms long, bad_pages long"
OPUS_MS = (10, 20, 40, 60) * 3 + (10, 20) * 2 + (2.5, 5, 10, 20) * 4


def crc(data: bytes) -> int:
    """Ogg's checksum: that of zlib with the bits of all bytes turned round, without its inversions."""
    return int(f"{zlib.crc32(data.translate(TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


@dataclass
class Page:
    serial: int
    sequence: int
    flags: int
    granule: int
    parts: list[bytes]
    open: bool  # the last part goes on in the next page


def pages(data: bytes) -> Iterator[Page | None]:
    """The pages of a bitstream in order; None for each damaged one."""
    at_ = data.find(b"OggS")
    while at_ >= 0:
        page = None
        if at_ + 27 <= len(data):
            _, version, flags, granule, serial, sequence, check, n = HEADER.unpack_from(data, at_)
            lacing = data[at_ + 27 : at_ + 27 + n]
            end = at_ + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data) and crc(b"".join((data[at_ : at_ + 22], b"\0\0\0\0", data[at_ + 26 : end]))) == check:
                parts, start, size = [], at_ + 27 + n, 0
                for x in lacing:
                    size += x
                    if x < 255:
                        parts.append(data[start : start + size])
                        start, size = start + size, 0
                unfinished = bool(n) and lacing[-1] == 255
                if unfinished:
                    parts.append(data[start:end])
                page = Page(serial, sequence, flags, granule, parts, unfinished)
        yield page
        at_ = data.find(b"OggS", end if page else at_ + 4)


def opus_samples(packet: bytes) -> int:
    """How many samples at 48 kHz an Opus packet lasts."""
    if not packet:
        return 0
    frames = (1, 2, 2, packet[1] & 63 if len(packet) > 1 else 0)[packet[0] & 3]
    return int(OPUS_MS[packet[0] >> 3] * 48) * frames


def vorbis_modes(setup: bytes) -> list[int]:
    """The block flag of each mode in a Vorbis setup header, which ends with the number of modes less 1 (6 bits), the modes (a
    flag, 16 + 16 bits of 0, 8 bits of mapping below 64) and a bit of 1. Read from the end: the most modes that their number agrees with."""
    bits = "".join(f"{b:08b}" for b in reversed(setup[-512:]))  # bits go up from each byte's lowest, so this runs from the last to the first
    at_ = bits.find("1") + 1
    flags, found = [], []
    while at_ and len(bits) - at_ >= 47 and len(flags) < 64 and int(bits[at_ : at_ + 8], 2) < 64 and "1" not in bits[at_ + 8 : at_ + 40]:
        flags.append(int(bits[at_ + 40]))
        at_ += 41
        if int(bits[at_ : at_ + 6], 2) + 1 == len(flags):
            found = flags[::-1]
    return found


@dataclass
class Stream:
    """One logical stream; packets come out as [number, bytes, granule of its end or None]."""

    rate: float | None = None
    skip: int = 0
    opus: bool = False
    blocks: tuple[int, int] | None = None  # Vorbis: samples of a short and a long block
    modes: list[int] | None = None
    block: int | None = 0  # of the packet before: 0 before the first, None if that was lost
    next_: int | None = None
    held: list[bytes] | None = None
    count: int = 0
    headers: int = 1
    ended: int | None = 0  # granule at the end of the page before; None if that page was lost

    def feed(self, p: Page) -> list[list]:
        lost = self.next_ is not None and p.sequence != self.next_
        self.next_ = (p.sequence + 1) & 0xFFFFFFFF
        whole, parts = [], p.parts
        if lost:
            self.held = self.ended = self.block = None
        if p.flags & 1:  # goes on with the last packet of the page before
            if self.held is not None and parts:
                self.held.append(parts[0])
                if len(parts) > 1 or not p.open:
                    whole.append(b"".join(self.held))
                    self.held = None
            parts = parts[1:]
        else:
            self.held = None
        if p.open and parts:
            whole += parts[:-1]
            self.held = [parts[-1]]
        else:
            whole += parts
        found = []
        for data in whole:
            if self.count == 0:
                self._identify(data)
            elif self.count == 2 and self.blocks:
                self.modes = vorbis_modes(data)
            found.append([self.count, data, None])
            self.count += 1
        body = [x for x in found if x[0] >= self.headers]
        lasts = [self._lasts(x[1]) for x in body]
        if body and p.granule >= 0:
            body[-1][2] = p.granule
            if not p.flags & 4:
                for k in range(len(body) - 1, 0, -1):
                    if lasts[k] is None:
                        break
                    body[k - 1][2] = body[k][2] - lasts[k]
            elif self.ended is not None:
                end = self.ended
                for x, n in zip(body[:-1], lasts, strict=False):
                    if n is None:
                        break
                    end += n
                    x[2] = min(end, p.granule)
            self.ended = p.granule
        return found

    def _lasts(self, packet: bytes) -> int | None:
        """How many samples a packet adds; None where that isn't known."""
        if self.opus:
            return opus_samples(packet)
        if not self.modes or not self.blocks:
            return None
        mode = packet[0] >> 1 & (1 << (len(self.modes) - 1).bit_length()) - 1 if packet and not packet[0] & 1 else len(self.modes)
        if mode >= len(self.modes):
            return 0  # no sound in it
        before, self.block = self.block, self.blocks[self.modes[mode]]
        return None if before is None else (before + self.block) // 4 if before else 0

    def _identify(self, data: bytes) -> None:
        if data[:8] == b"OpusHead" and len(data) >= 12:
            self.rate, self.opus, self.headers, self.skip = 48_000.0, True, 2, struct.unpack_from("<H", data, 10)[0]
        elif data[:7] == b"\x01vorbis" and len(data) >= 16:
            self.rate, self.headers = float(struct.unpack_from("<I", data, 12)[0]) or None, 3
            self.blocks = (1 << (data[28] & 15), 1 << (data[28] >> 4)) if len(data) > 28 else None


def demultiplex(data: bytes | None, rate: float | None = None) -> tuple[list[tuple[int, int, bytes, int | None, float | None]], int]:
    """((serial, packet, bytes, granule, seconds), ...) in the order in which packets end, and the number of damaged pages."""
    streams: dict[int, Stream] = {}
    out, bad = [], 0
    for p in pages(data or b""):
        if p is None:
            bad += 1
            continue
        if p.flags & 2 or p.serial not in streams:
            streams[p.serial] = Stream(rate)
        s = streams[p.serial]
        for no, packet, granule in s.feed(p):
            out.append((p.serial, no, packet, granule, (granule - s.skip) / s.rate if granule is not None and s.rate else None))
    return out, bad


def page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return b"".join((head[:22], crc(head + body).to_bytes(4, "little"), head[26:], body))


def multiplex(streams: dict[int, list[tuple[bytes, int]]], segments: int = 255) -> bytes:
    """An Ogg bitstream of (packet, granule of its end) lists by serial; first packets alone on the first pages, then the streams'
    pages in turn."""
    made: list[list[bytes]] = []
    for serial, packets in streams.items():
        mine: list[bytes] = []
        lacing, body, granule, cont = bytearray(), [], -1, 0

        def flush(last: bool = False) -> None:
            nonlocal lacing, body, granule, cont
            mine.append(page(serial, len(mine), cont | (2 if not mine else 0) | (4 if last else 0), granule, bytes(lacing), b"".join(body)))
            cont = 1 if lacing and lacing[-1] == 255 else 0
            lacing, body, granule = bytearray(), [], -1

        for k, (packet, end) in enumerate(packets):
            values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            start = 0
            while values:
                room = segments - len(lacing)
                now, values = values[:room], values[room:]
                size = sum(now)
                lacing += now
                body.append(packet[start : start + size])
                start += size
                if not values:
                    granule = end
                if len(lacing) == segments:
                    flush(last=k == len(packets) - 1 and not values)
            if k == 0 and lacing:
                flush(last=len(packets) == 1)
        if lacing:
            flush(last=True)
        made.append(mine)
    out = [m[0] for m in made if m]
    for k in range(1, max((len(m) for m in made), default=0)):
        out += [m[k] for m in made if k < len(m)]
    return b"".join(out)


def _encode(text: str) -> bytes:
    """A text's lines as packets of two Opus-like streams of 20 ms frames: odd lines to serial 1, even ones to 2."""
    head = b"OpusHead\x01\x01" + struct.pack("<HIhB", 312, 48_000, 0, 0)
    streams: dict[int, list[tuple[bytes, int]]] = {1: [(head, 0), (b"OpusTags", 0)], 2: [(head, 0), (b"OpusTags", 0)]}
    for k, line in enumerate(text.split("\n")):
        mine = streams[1 + k % 2]
        mine.append((b"\x08" + line.encode("utf-8", "replace"), 960 * (len(mine) - 1)))
    return multiplex(streams)


def documents_as_ogg(docs: DataFrame) -> DataFrame:
    """(id, media): each text as an Ogg file; a null text as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else _encode(t) for t in part.column(1).to_pylist()], pa.binary())], ["id", "media"])

    return docs.select(at("doc_id").cast("long").alias("id"), at("text").alias("text")).mapInArrow(run, "id long, media binary")


def packets(media: DataFrame, id_col: str = "id", media_col: str = "media", rate: float | None = None) -> DataFrame:
    """One row a packet: its stream's serial, number, size, 60-bit digest, granule and time of its end in ms (null where
    unknown), and the damaged pages of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found, bad = demultiplex(data.as_py(), rate)
                rows += [(i, s, n, len(p), int(hashlib.md5(p).hexdigest()[:15], 16), g, None if t is None else round(t * 1000), bad) for s, n, p, g, t in found]
                if len(rows) > 50_000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)

    return media.select(at(id_col).cast("long").alias("id"), at(media_col).alias("media")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def op3_ogg_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media: all documents are written as Ogg files first, then read back."""
    return packets(documents_as_ogg(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


SQL = {
    "op3_ogg_packets": """
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM d),
        b AS (SELECT doc_id, 1 + k % 2 AS serial, 2 + k // 2 AS packet, encode(chr(8) || line) AS p FROM l
              UNION ALL SELECT doc_id, s, 0, 'OpusHead\\x01\\x01\\x38\\x01\\x80\\xBB\\x00\\x00\\x00\\x00\\x00'::BLOB FROM documents, (VALUES (1), (2)) v(s) WHERE text IS NOT NULL
              UNION ALL SELECT doc_id, s, 1, 'OpusTags'::BLOB FROM documents, (VALUES (1), (2)) v(s) WHERE text IS NOT NULL)
        SELECT doc_id, serial::BIGINT AS serial, packet::BIGINT AS packet, octet_length(p)::BIGINT AS n_bytes, ('0x' || substr(md5(p), 1, 15))::BIGINT AS digest,
            CASE WHEN packet >= 2 THEN 960 * (packet - 1) END AS granule, CASE WHEN packet >= 2 THEN round((960 * (packet - 1) - 312) / 48.0)::BIGINT END AS end_ms, 0::BIGINT AS bad_pages FROM b"""
}
QUERIES = {"op3_ogg_packets": op3_ogg_packets}
