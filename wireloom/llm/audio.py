"""Media columns: MPEG audio. Frames are found and checked, tags and variable-bitrate tables parsed, durations and seek offsets stored exactly."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from copy import copy
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import common

#: Fixed values of the format: bit rates in kbit/s by (MPEG version 1 or 2, layer), sample rates and channel counts by header bits.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SEEK_EVERY = 16
#: Bytes in which the second frame of a free-format stream is looked for.
MOST_FREE = 1 << 14


class Frame:
    """What a frame header says."""

    __slots__ = ("length", "samples", "rate", "bitrate", "channels", "crc", "side", "kind")


@lru_cache(maxsize=4096)
def header(b: bytes) -> Frame | None:
    """The frame that these four bytes start, or None for reserved values. A frame of free format has no bit rate, and 0 or 1 slots of padding as its length."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = (b[1] >> 3) & 3, 4 - ((b[1] >> 1) & 3)
    rate_index, bit_index = (b[2] >> 2) & 3, b[2] >> 4
    if version == 1 or layer == 4 or rate_index == 3 or bit_index == 15:
        return None
    f = Frame()
    f.rate = SAMPLE_RATES[version][rate_index]
    f.bitrate = BITRATES[1 if version == 3 else 2, layer][bit_index - 1] if bit_index else 0
    padding = (b[2] >> 1) & 1
    f.samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    f.length = (12000 * f.bitrate // f.rate + padding) * 4 if layer == 1 else f.samples * 125 * f.bitrate // f.rate + padding
    f.channels = 1 if b[3] >> 6 == 3 else 2
    f.crc = not b[1] & 1
    f.side = 0 if layer != 3 else (17 if f.channels == 1 else 32) if version == 3 else (9 if f.channels == 1 else 17)
    f.kind = (version, layer, f.rate)
    return f


def free_frame(data: bytes, pos: int, end: int, f: Frame, size: int) -> tuple[Frame, int]:
    """(frame with its length, length without padding) of a free-format frame: all of a stream are of one length, besides padding.

    It is size where that is known, else the distance to the next header of the kind that
    still another one, or the end, follows at the same distance. Length 0: no such place.
    """
    out = copy(f)
    padding = f.length
    if not size:
        at = pos + 4
        while (at := data.find(b"\xff", at, min(end, pos + MOST_FREE))) >= 0:
            g = header(data[at : at + 4])
            if g is not None and g.kind == f.kind and not g.bitrate:
                size = at - pos - padding
                after = at + size + g.length
                h = header(data[after : after + 4])
                if after == end or (h is not None and h.kind == f.kind and not h.bitrate):
                    break
                size = 0
            at += 1
    out.length = size + padding if size else 0
    out.bitrate = round(out.length * 8 * f.rate / f.samples / 1000) if size else 0
    return out, size


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The format's checksum (polynomial 0x8005, start 0xFFFF), over the header's last two bytes and the side information."""
    c = 0xFFFF
    for x in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ x]
    return c


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _frame_body(body: bytes, version: int, flags: int) -> bytes | None:
    """A tag frame's content without its grouping byte, length, unsynchronisation and compression; None where it is encrypted or broken."""
    packed, hidden, grouped, sized, stuffed = (flags & 0x80, flags & 0x40, flags & 0x20, flags & 0x80, 0) if version == 3 else (flags & 0x08, flags & 0x04, flags & 0x40, flags & 0x01, flags & 0x02)
    if hidden:
        return None
    if version == 3 and sized:
        body = body[4:]
    body = body[1:] if grouped else body
    if version == 4 and sized:
        body = body[4:]
    if stuffed:
        body = body.replace(b"\xff\x00", b"\xff")
    if not packed:
        return body
    try:
        return zlib.decompress(body)
    except zlib.error:
        return None


def tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(text tags, where audio starts, where it ends): ID3v2 tags in front, an ID3v1 tag of 128 bytes behind.

    Unsynchronised tags and frames, extended headers, footers, grouped and compressed frames
    are read; encrypted ones are passed over. A broken tag ends the list.
    """
    out: dict[str, str] = {}
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        version, flags = data[at + 3], data[at + 5]
        end = min(len(data), at + 10 + _synchsafe(data[at + 6 : at + 10]))
        tag, pos = data[at + 10 : end], 0
        if flags & 0x80 and version < 4:
            tag = tag.replace(b"\xff\x00", b"\xff")
        if flags & 0x40 and version > 2:  # the extended header's size counts itself only in version 4
            pos = _synchsafe(tag[:4]) if version == 4 and len(tag) >= 4 else 4 + int.from_bytes(tag[:4], "big")
        wide = 6 if version == 2 else 10
        while pos + wide <= len(tag) and tag[pos] != 0:
            name = tag[pos : pos + (3 if version == 2 else 4)].decode("latin-1")
            size = int.from_bytes(tag[pos + 3 : pos + 6], "big") if version == 2 else _synchsafe(tag[pos + 4 : pos + 8]) if version == 4 else int.from_bytes(tag[pos + 4 : pos + 8], "big")
            if size <= 0 or pos + wide + size > len(tag):
                break
            body = tag[pos + wide : pos + wide + size]
            body = body if version == 2 else _frame_body(body, version, tag[pos + 9])
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), errors="replace").rstrip("\0")
                if name.startswith("TXX"):
                    name, _, text = text.partition("\0")
                out[name] = text
            pos += wide + size
        at = min(len(data), end + 10) if flags & 0x10 and version == 4 else end
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                out.setdefault(name, value)
    return out, at, end


def table(frame: bytes, f: Frame) -> dict | None:
    """The variable-bitrate table in a first frame: Xing or Info (frames, bytes, 100 seek points), or VBRI.

    After a Xing or Info table encoders write their name, and how many samples they put
    before and after the sound (delay, padding). A VBRI table has the byte offset of every
    so many frames (seek, every).
    """
    at = 4 + f.side
    for start in (at, at + 2):  # with a checksum, some encoders shift the table
        if frame[start : start + 4] in (b"Xing", b"Info"):
            flags, pos, out = int.from_bytes(frame[start + 4 : start + 8], "big"), start + 8, {"type": frame[start : start + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[pos : pos + 4], "big")
                    pos += 4
            if flags & 4:
                out["toc"] = list(frame[pos : pos + 100])
                pos += 100
            pos += 4 if flags & 8 else 0
            name = frame[pos : pos + 9]
            if len(frame) >= pos + 24 and name[:4] in (b"LAME", b"Lavf", b"Lavc", b"GOGO"):
                both = int.from_bytes(frame[pos + 21 : pos + 24], "big")
                out |= {"encoder": name.decode("latin-1").rstrip("\0 "), "delay": both >> 12, "padding": both & 0xFFF}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n_bytes, frames, entries, scale, wide, every = struct.unpack(">IIHHHH", frame[46:62])
        seek, at = [], 0
        for k in range(entries if 1 <= wide <= 4 else 0):
            entry = frame[62 + k * wide : 62 + (k + 1) * wide]
            if len(entry) < wide:
                break
            at += int.from_bytes(entry, "big") * scale
            seek.append(at)
        return {"type": "VBRI", "bytes": n_bytes, "frames": frames, "delay": 0, "padding": 0, "seek": seek, "every": every}
    return None


def parse(data: bytes, seek_every: int = SEEK_EVERY) -> dict:
    """Everything known about an MPEG audio stream, and where its frames are.

    A header counts only if the frame it tells of is followed by another header of the
    same kind or by the end; between frames the parser searches byte by byte, counts what
    it skips, and goes on. A frame cut off by the end is not counted. Empty or foreign
    bytes give a result without frames.
    """
    found, start, end = tags(data)
    out = {"tags": found, "vbr": None, "frames": 0, "samples": 0, "rate": 0, "channels": 0, "bitrates": set(), "crc_checked": 0, "crc_failed": 0, "resyncs": 0, "skipped": 0, "offsets": [], "seek": []}
    pos, lost, first, free = start, False, True, 0
    while pos + 4 <= end:
        f = header(data[pos : pos + 4])
        if f is not None and not f.bitrate:
            f, size = free_frame(data, pos, end, f, 0 if lost else free)
            free = size or free
        good = f is not None and f.length > 3 and pos + f.length <= end
        if good and (lost or first):
            after = header(data[pos + f.length : pos + f.length + 4]) if pos + f.length + 4 <= end else None
            good = pos + f.length == end or (after is not None and after.kind == f.kind)
        if not good:
            nxt = data.find(b"\xff", pos + 1, end)
            nxt = end if nxt < 0 else nxt
            out["resyncs"] += not lost
            out["skipped"] += nxt - pos
            pos, lost = nxt, True
            continue
        lost = False
        if f.crc:
            out["crc_checked"] += 1
            stored = int.from_bytes(data[pos + 4 : pos + 6], "big")
            out["crc_failed"] += stored != crc16(data[pos + 2 : pos + 4] + data[pos + 6 : pos + 6 + f.side])
        if first:
            first = False
            out["rate"], out["channels"] = f.rate, f.channels
            if (vbr := table(data[pos : pos + f.length], f)) is not None:
                out["vbr"] = vbr
                pos += f.length
                continue
        if out["frames"] % seek_every == 0:
            out["seek"].append(pos)
        out["offsets"].append((pos, f))
        out["frames"] += 1
        out["samples"] += f.samples
        out["bitrates"].add(f.bitrate)
        pos += f.length
    out["skipped"] += max(0, end - pos) if lost or pos < end else 0
    return out


# Storing bytes: silent MPEG-1 Layer III frames, mono at 44.1 kHz with a checksum, whose ancillary space after the (empty) side information carries them.
_LEAD = 4 + 2 + 17


@lru_cache(maxsize=32)
def _lead(index: int) -> tuple[bytes, int]:
    """(header, checksum and side information, bytes of room) of a silent frame with this bit rate index."""
    head = bytes((0xFF, 0xFA, (index + 1) << 4, 0xC0))
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, header(head).length - _LEAD


def store(payload: bytes) -> bytes:
    """The payload as an MPEG file: a tag with its length, a Xing frame with seek points, and frames at 320 kbit/s, the last at the lowest rate that fits."""
    frames = []
    room = _lead(13)[1]
    for i in range(0, len(payload), room):
        piece = payload[i : i + room]
        lead, size = next(x for x in map(_lead, range(14)) if x[1] >= len(piece))
        frames.append(lead + piece + bytes(size - len(piece)))
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    length = b"\0" + str(round(1000 * 1152 * len(frames) / 44100)).encode()
    body = b"".join(name + struct.pack(">IH", len(x), 0) + x for name, x in ((b"TXXX", text), (b"TLEN", length)))
    n = len(body)
    tag = b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body
    head = bytes((0xFF, 0xFB, 5 << 4, 0xC0))  # 64 kbit/s, without checksum
    total, upto, starts = header(head).length + sum(map(len, frames)), header(head).length, []
    for f in frames:
        starts.append(upto)
        upto += len(f)
    toc = bytes(min(255, starts[k * len(starts) // 100] * 256 // total) for k in range(100)) if starts else bytes(100)
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    first = (head + bytes(17) + xing).ljust(header(head).length, b"\0")
    return b"".join((tag, first, *frames))


def load(media: bytes, parsed: dict | None = None) -> bytes:
    """The payload that store() put into media, from the frames found by parse()."""
    parsed = parsed or parse(media)
    pieces = [media[pos + _LEAD : pos + f.length] for pos, f in parsed["offsets"]]
    out, left = [], int(parsed["tags"].get("payload_bytes", 0))
    for (_, f), piece in zip(parsed["offsets"], pieces):
        out.append(piece[: max(0, left)])
        left -= f.length - _LEAD
    return b"".join(out)


FIELDS = (
    ("n_frames", "long", pa.int64()), ("n_samples", "long", pa.int64()), ("sample_rate", "int", pa.int32()), ("channels", "int", pa.int32()), ("seconds", "double", pa.float64()),
    ("bitrate_mode", "string", pa.string()), ("vbr_frames", "long", pa.int64()), ("vbr_bytes", "long", pa.int64()), ("encoder", "string", pa.string()), ("delay", "long", pa.int64()), ("padding", "long", pa.int64()), ("vbr_seek", "array<long>", pa.list_(pa.int64())), ("crc_checked", "long", pa.int64()), ("crc_failed", "long", pa.int64()),
    ("resyncs", "long", pa.int64()), ("skipped_bytes", "long", pa.int64()), ("tags", "map<string,string>", pa.map_(pa.string(), pa.string())), ("seek_offsets", "array<long>", pa.list_(pa.int64())),
)


def values(p: dict) -> tuple:
    mode = None if not p["frames"] else "vbr" if len(p["bitrates"]) > 1 or (p["vbr"] or {}).get("type") in ("Xing", "VBRI") else "cbr"
    vbr = p["vbr"] or {}
    sound = max(0, p["samples"] - vbr.get("delay", 0) - vbr.get("padding", 0))
    seconds = sound / p["rate"] if p["rate"] else 0.0
    return p["frames"], p["samples"], p["rate"], p["channels"], seconds, mode, vbr.get("frames"), vbr.get("bytes"), vbr.get("encoder"), vbr.get("delay"), vbr.get("padding"), vbr.get("seek"), p["crc_checked"], p["crc_failed"], p["resyncs"], p["skipped"], list(p["tags"].items()), p["seek"]


def parse_audio(media: DataFrame, column: str = "media") -> DataFrame:
    """media with a struct column audio (replacing one of that name): frames, exact duration, checksums, tags, VBR table, offsets of every 16th frame.

    seconds is that of the sound: what the encoder says it put before and after it doesn't
    count, n_samples has it. Null and empty files, and foreign bytes, have no frames and
    0 seconds; repeated rows get a row each; other columns pass through, whatever their
    names; an empty table gives an empty one.
    """
    kept = [f for f in media.schema.fields if f.name != "audio"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, column):
                rows = [dict(zip((n for n, _, _ in FIELDS), values(parse(b)))) for b in common.texts_of(part, column)]
                names = [n for n in part.schema.names if n != "audio"]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(rows, pa.struct([(n, k) for n, _, k in FIELDS]))], names=[*names, "audio"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", audio struct<" + ",".join(f"{n}:{t}" for n, t, _ in FIELDS) + ">"
    return media.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def store_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded with zero bytes to a positive multiple of 64, in an MPEG file. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = common.texts_of(part, "text")
                files = [store(t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes()).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_audio(stored: DataFrame) -> DataFrame:
    """Contract 5's columns from (doc_id, n_bytes, media): the payload is read back from the frames."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "media"):
                rows = []
                for doc, n, media in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), common.texts_of(part, "media")):
                    p = parse(media)
                    payload = load(media, p)
                    rate = f"{min(p['bitrates'])}-{max(p['bitrates'])}"
                    seek = zlib.crc32(",".join(map(str, p["seek"])).encode())
                    feature = f"frames={p['frames']};samples={p['samples']};rate={p['rate']};kbit={rate};crc={p['crc_checked'] - p['crc_failed']}/{p['crc_checked']};vbr={p['vbr']['frames']};seek={len(p['seek'])}:{seek}"
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_audio(docs: DataFrame) -> DataFrame:
    """Contract 5: texts stored as MPEG audio and read back.

    A null text counts as an empty one: 0 bytes, and 64 zero bytes of payload. Texts of any
    length are stored whole. Repeated rows get a row each and equal texts equal values; a
    null doc_id stays null; other columns are ignored; an empty table gives an empty result.
    """
    return read_audio(store_audio(docs))
