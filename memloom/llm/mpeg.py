"""MPEG audio streams in a binary column: frames, tags, bitrate tables, checksums, durations and seek offsets.

``scan`` walks a stream from frame header to frame header. Where no header stands
at the expected place it resynchronises: it looks for the next header that is
followed by an agreeing one (or by the end of the audio). Layers I to III of MPEG 1,
2 and 2.5 are walked; free-format frames count as junk. Frame checksums are
verified for all three layers: those of Layer III cover bytes at a fixed place, those of
Layers I and II the bit allocation and, in Layer II, what selects the scale factors.
The bitrate table's own checksum is verified too.

``carry`` is the inverse used to store any bytes losslessly: constant-bitrate
MPEG-2 Layer III frames with checksums, silent side information and 576 bytes of
ancillary data each, behind an ID3v2 tag and a table frame.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_columns

# Fixed values of the MPEG audio standards: kbit/s by (LSF, layer), samples a second by version.
KBPS = {
    (0, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (0, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (0, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (1, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (1, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (1, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(0, 1): 384, (0, 2): 1152, (0, 3): 1152, (1, 1): 384, (1, 2): 1152, (1, 3): 576}

UNIT = 576
FRAME = 648
HEAD = b"\xff\xf2\xd8\xc4"  # MPEG 2, Layer III, with checksum, 144 kbit/s, 16 kHz, mono
SIDE = bytes(9)


def _crc_table(poly: int) -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ poly if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_T = _crc_table(0x8005)
#: The same polynomial bit by bit from the low end, as the table frame's checksum has it.
_R = [int(f"{_T[int(f'{i:08b}'[::-1], 2)]:016b}"[::-1], 2) for i in range(256)]


@lru_cache(4096)
def frame_crc(covered: bytes) -> int:
    c = 0xFFFF
    for b in covered:
        c = ((c << 8) & 0xFFFF) ^ _T[(c >> 8) ^ b]
    return c


def _allocation(h: bytes) -> tuple[list[int], int, int]:
    """For Layers I and II, from four header bytes: the width of each subband's allocation, the channels, and the subbands that have one for each."""
    version, layer, mode = {0: 2.5, 2: 2, 3: 1}[h[1] >> 3 & 3], 4 - (h[1] >> 1 & 3), h[3] >> 6
    channels = 1 if mode == 3 else 2
    if layer == 1:
        widths = [4] * 32
    else:
        rate, each = RATES[version][h[2] >> 2 & 3], KBPS[int(version != 1), 2][(h[2] >> 4) - 1] // channels
        # fixed values of the standards: subbands by the width of their allocation
        if version != 1:
            widths = [4] * 4 + [3] * 7 + [2] * 19
        elif each <= 48:
            widths = [4] * 2 + [3] * (10 if rate == 32000 else 6)
        else:
            widths = [4] * 11 + [3] * 12 + [2] * (4 if each <= 80 or rate == 48000 else 7)
    bound = min(4 * ((h[3] >> 4 & 3) + 1), len(widths)) if mode == 1 else len(widths)
    return widths, channels, bound


def allocation_crc(frame: bytes) -> int | None:
    """The checksum that a protected frame of Layer I or II should have; None if it is cut short."""
    widths, channels, bound = _allocation(frame[:4])
    bits = int.from_bytes(frame[6:134])
    have, at, used = 8 * len(frame[6:134]), 0, 0
    for i, w in enumerate(widths):
        for _ in range(channels if i < bound else 1):
            if at + w > have:
                return None
            # above the bound one allocation stands for both channels
            used += (bits >> have - at - w & (1 << w) - 1 > 0) * (1 if i < bound else channels)
            at += w
    if 4 - (frame[1] >> 1 & 3) == 2:
        at += 2 * used
    if at > have:
        return None
    c = frame_crc(frame[2:4] + frame[6 : 6 + at // 8])
    for k in range(at // 8 * 8, at):
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15 ^ bits >> have - k - 1) & 1 else 0)
    return c


def tag_crc(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c >> 8) ^ _R[(c ^ b) & 255]
    return c


@lru_cache(4096)
def header(h: bytes) -> tuple | None:
    """(length, samples, rate, version, layer, has checksum, side bytes, kbps) of four header bytes, or None."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(h[1] >> 3 & 3)
    layer = 4 - (h[1] >> 1 & 3)
    kb, sr = h[2] >> 4, h[2] >> 2 & 3
    if version is None or layer == 4 or kb in (0, 15) or sr == 3:
        return None
    lsf = int(version != 1)
    kbps, rate, samples = KBPS[lsf, layer][kb - 1], RATES[version][sr], SAMPLES[lsf, layer]
    pad = h[2] >> 1 & 1
    n = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    mono = h[3] >> 6 == 3
    side = ((9 if mono else 17) if lsf else (17 if mono else 32)) if layer == 3 else 0
    return n, samples, rate, version, layer, not h[1] & 1, side, kbps


def syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_id3(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of the leading ID3v2 tags and their text frames."""
    at, tags = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
        major, size = data[at + 3], syncsafe(data[at + 6 : at + 10])
        body, p = data[at + 10 : at + 10 + size], 0
        while major in (3, 4) and p + 10 <= len(body) and re.match(rb"[A-Z0-9]{4}", body[p : p + 4]):
            n = syncsafe(body[p + 4 : p + 8]) if major == 4 else int.from_bytes(body[p + 4 : p + 8])
            name, value = body[p : p + 4].decode(), body[p + 10 : p + 10 + n]
            if name[0] == "T" and value:
                text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace").rstrip("\0")
                key, _, rest = text.partition("\0")
                tags[f"TXXX:{key}" if name == "TXXX" else name] = rest if name == "TXXX" else text
            p += 10 + n
        at += 10 + size + 10 * (data[at + 5] >> 4 & 1)
    return min(at, len(data)), tags


def read_table(frame: bytes, h: tuple) -> dict | None:
    """The bitrate table in a frame: frames, bytes, seek points, and whether its checksum holds (None: it has none)."""
    at = 4 + h[6]
    for p in (at, at + 2):
        if frame[p : p + 4] in (b"Xing", b"Info"):
            out = {"kind": frame[p : p + 4].decode(), "frames": None, "bytes": None, "toc": None, "crc_ok": None}
            flags, q = int.from_bytes(frame[p + 4 : p + 8]), p + 8
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, None, 4)):
                if flags & bit:
                    if name:
                        out[name] = list(frame[q : q + n]) if name == "toc" else int.from_bytes(frame[q : q + n])
                    q += n
            if len(frame) >= q + 36 and frame[q : q + 4].strip(b"\0"):
                out["crc_ok"] = tag_crc(frame[: q + 34]) == int.from_bytes(frame[q + 34 : q + 36])
            return out
    if frame[36:40] == b"VBRI":
        n, scale, each = (int.from_bytes(frame[i : i + 2]) for i in (54, 56, 58))
        toc = [int.from_bytes(frame[62 + i * each : 62 + (i + 1) * each]) * scale for i in range(n)] if each in (1, 2, 3, 4) else None
        return {"kind": "VBRI", "frames": int.from_bytes(frame[50:54]), "bytes": int.from_bytes(frame[46:50]), "toc": toc, "crc_ok": None}
    return None


def tiled(data: bytes, at: int, like: tuple) -> bool:
    """Whether agreeing frames fill the bytes from ``at`` exactly."""
    while (h := header(data[at : at + 4])) is not None and h[2:5] == like[2:5]:
        at += h[0]
    return at == len(data)


def scan(data: bytes) -> dict:
    """What a stream holds; offsets are from its first byte and leave the table frame out.

    ``TAG`` 128 bytes before the end begins an ID3v1 tag unless frames reach past it and fill the stream to its end.
    """
    at, tags = read_id3(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    out = {"tags": tags, "offsets": [], "samples": 0, "seconds": Fraction(0), "junk": 0, "crc_ok": 0, "crc_bad": 0, "table": None, "version": None, "layer": None, "rate": None, "kbps_min": None, "kbps_max": None, "resyncs": 0}
    like, first, kb = None, True, set()
    seconds: dict[int, int] = {}
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and end < at + h[0] <= len(data) and tiled(data, at, h):
            end = len(data)
        ok = h is not None and at + h[0] <= end
        if ok and (like is None or h[2:5] != like):
            after = at + h[0]
            nxt = header(data[after : after + 4])
            ok = after == end or (nxt is not None and nxt[2:5] == h[2:5])
        if not ok:
            out["resyncs"] += like is not None
            p = data.find(b"\xff", at + 1, end)
            p = end if p < 0 else p
            out["junk"] += p - at
            at, like = p, None
            continue
        n, samples, rate, version, layer, crc, side, kbps = h
        like = h[2:5]
        if crc:
            should = frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) if layer == 3 else allocation_crc(data[at : at + n])
            good = should == int.from_bytes(data[at + 4 : at + 6])
            out["crc_ok" if good else "crc_bad"] += 1
        table = read_table(data[at : at + n], h) if first and layer == 3 else None
        if first:
            out |= {"version": version, "layer": layer, "rate": rate, "table": table}
        first = False
        if table is None:
            out["offsets"].append(at)
            out["samples"] += samples
            seconds[rate] = seconds.get(rate, 0) + samples
            kb.add(kbps)
        at += n
    out["junk"] += max(0, end - at)
    if end < len(data):
        for name, a, n in (("TIT2", 3, 30), ("TPE1", 33, 30), ("TALB", 63, 30)):
            if v := data[end + a : end + a + n].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, v)
    out["seconds"] = sum((Fraction(n, r) for r, n in seconds.items()), Fraction(0))
    out["kbps_min"], out["kbps_max"] = (min(kb), max(kb)) if kb else (None, None)
    return out


def pad(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (UNIT - len(text) if len(text) < UNIT else -len(text) % UNIT)


def carry(payload: bytes, title: str) -> bytes:
    """A stream that holds ``payload`` (a multiple of 576 bytes) as ancillary data, one unit a frame."""
    n = len(payload) // UNIT
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :15] = np.frombuffer(HEAD + frame_crc(HEAD[2:] + SIDE).to_bytes(2) + SIDE, np.uint8)
    frames[:, 15 : 15 + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    size = (n + 1) * FRAME
    toc = bytes(256 * (FRAME * (1 + i * n // 100)) // size for i in range(100))
    info = b"\xff\xf3\xd8\xc4" + SIDE + b"Info" + (15).to_bytes(4) + n.to_bytes(4) + size.to_bytes(4) + toc + (0).to_bytes(4) + b"memloom01" + bytes(19) + size.to_bytes(4) + bytes(2)
    info = (info + tag_crc(info).to_bytes(2)).ljust(FRAME, b"\0")
    text = b"\x03n_bytes\0" + title.encode()
    tag = b"TXXX" + len(text).to_bytes(4) + b"\0\0" + text
    head = b"ID3\x03\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0))
    return head + tag + info + frames.tobytes()


def carried(data: bytes, offsets: list[int]) -> bytes:
    return b"".join([data[o + 15 : o + 15 + UNIT] for o in offsets])


#: What scan_mpeg adds.
SCAN = [
    ("n_frames", T.LongType()), ("n_samples", T.LongType()), ("duration_num", T.LongType()), ("duration_den", T.LongType()),
    ("mpeg_version", T.DoubleType()), ("layer", T.IntegerType()), ("sample_rate", T.IntegerType()), ("kbps_min", T.IntegerType()), ("kbps_max", T.IntegerType()),
    ("frame_offsets", T.ArrayType(T.LongType())), ("junk_bytes", T.LongType()), ("resyncs", T.LongType()), ("crc_ok", T.LongType()), ("crc_bad", T.LongType()),
    ("vbr_kind", T.StringType()), ("vbr_frames", T.LongType()), ("vbr_bytes", T.LongType()), ("vbr_toc", T.ArrayType(T.IntegerType())), ("vbr_crc_ok", T.BooleanType()),
    ("tags", T.MapType(T.StringType(), T.StringType())),
]


def _row(s: dict) -> tuple:
    t = s["table"] or {}
    return (len(s["offsets"]), s["samples"], s["seconds"].numerator, s["seconds"].denominator, s["version"], s["layer"], s["rate"], s["kbps_min"], s["kbps_max"], s["offsets"], s["junk"], s["resyncs"], s["crc_ok"], s["crc_bad"], t.get("kind"), t.get("frames"), t.get("bytes"), t.get("toc"), t.get("crc_ok"), list(s["tags"].items()))


def scan_mpeg(df: DataFrame, col: str = "media") -> DataFrame:
    """``df`` plus the columns of SCAN, read from the binary column ``col``.

    The exact duration is duration_num / duration_den seconds; frame_offsets has the
    byte offset of each audio frame. Null, empty and non-audio values have no frames,
    duration 0 / 1, all bytes as junk and null formats. Columns with the same names
    are replaced; everything else passes through.
    """
    return with_columns(df, col, SCAN, lambda: lambda rows: [_row(scan(x)) for x in rows], null=b"")


def store_text(df: DataFrame, col: str = "text", media: str = "media") -> DataFrame:
    """``df`` without ``col``, plus ``media``: each text's padded UTF-8 bytes as an MPEG stream (null: as empty)."""

    def store(texts: list[str]) -> list[tuple]:
        return [(carry(pad(raw), str(len(raw))),) for raw in (t.encode() for t in texts)]

    return with_columns(df, col, [(media, T.BinaryType())], lambda: store, drop=True)


def media_digest(df: DataFrame, media: str = "media") -> DataFrame:
    """Digests of stored streams made by store_text, all from the stored bytes; ``media`` itself is left out.

    Null counts as empty. A stream without audio frames carries nothing: no payload, and the feature "none"; one
    that does not say how long its text is has a null n_bytes. Columns named like the new ones are replaced.
    """

    def read(rows: list[bytes]) -> list[tuple]:
        out = []
        for data in rows:
            s = scan(data)
            back = carried(data, s["offsets"])
            t = s["table"] or {}
            whole = t.get("frames") == len(s["offsets"]) and t.get("crc_ok")
            feature = "none" if not s["offsets"] else f"mpeg{s['version']:g}-layer{s['layer']};rate={s['rate']};kbps={s['kbps_min']}-{s['kbps_max']};frames={len(s['offsets'])};samples={s['samples']};seconds={s['seconds']};crc={s['crc_ok']}/{s['crc_ok'] + s['crc_bad']};table={t.get('kind')}:{'ok' if whole else 'bad'};junk={s['junk']};first={s['offsets'][0]};last={s['offsets'][-1]};offsets={hashlib.sha256(np.array(s['offsets'], '<i8').tobytes()).hexdigest()[:16]}"
            said = s["tags"].get("TXXX:n_bytes", "")
            out.append((int(said) if said.isascii() and said.isdigit() and len(said) < 19 else None, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, s["offsets"]))
        return out

    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("frame_offsets", T.ArrayType(T.LongType()))]
    return with_columns(df, media, fields, lambda: read, null=b"", drop=True)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store each text of (doc_id, text) as MPEG audio, read the stored bytes back and describe them."""
    return media_digest(store_text(docs.select(F.col("doc_id"), F.col("text").cast("string"))))
