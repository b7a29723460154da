"""ISO media containers: boxes and sample tables around text payloads.

A payload is stored as the samples of one track of 8-bit raw audio. Reading walks the nested boxes, decodes the
sample tables and gives codec, duration and the byte ranges of sync samples without decoding any sample.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

UNIT = 64  # payloads are padded to a multiple of this; one sample of the track holds so many bytes
RATE = 8000  # samples of audio a second: one byte each
CHUNK = 1024  # samples in a chunk of the file
SYNC = 125  # each so many samples a sync sample: one a second
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of UNIT."""
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def store(payload: bytes) -> bytes:
    """A file of one raw 8-bit track with ``payload`` as samples of UNIT bytes. Equal payloads, equal files."""
    n = len(payload) // UNIT
    if n * UNIT != len(payload) or not n:
        raise ValueError("the payload is no positive multiple of the unit")
    duration = len(payload)
    wide = duration >= 1 << 32
    times = struct.pack(">QQIQ", 0, 0, RATE, duration) if wide else struct.pack(">IIII", 0, 0, RATE, duration)
    track = struct.pack(">QQIIQ", 0, 0, 1, 0, duration) if wide else struct.pack(">IIIII", 0, 0, 1, 0, duration)
    version = int(wide)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    chunks = -(-n // CHUNK)
    runs = [(1, min(n, CHUNK))] + ([(chunks, n - (chunks - 1) * CHUNK)] if chunks > 1 and n % CHUNK else [])
    sync = np.arange(1, n + 1, SYNC, dtype=">u4")

    def moov(first: int) -> bytes:
        where = first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * UNIT)
        far = bool(where[-1] >= 1 << 32)
        places = _full(b"co64", struct.pack(">I", chunks), where.astype(">u8").tobytes()) if far else _full(b"stco", struct.pack(">I", chunks), where.astype(">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", at, count, 1) for at, count in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            places,
        )
        minf = _box(b"minf", _full(b"smhd", struct.pack(">hH", 0, 0)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=version), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), minf)
        tkhd = _full(b"tkhd", track, struct.pack(">8xhhhH", 0, 0, 0x100, 0), _MATRIX, struct.pack(">II", 0, 0), version=version, flags=7)
        mvhd = _full(b"mvhd", times, struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, b"\0" * 24, struct.pack(">I", 2), version=version)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov(0))
    body = moov(len(ftyp) + size + head)
    if len(body) != size:  # the places needed wider numbers
        body = moov(len(ftyp) + len(body) + head)
    return ftyp + body + _box(b"mdat", payload)


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, start of the body, end) of every box, depth first. Raises ValueError on a broken box."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError("a box leaves the box around it")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def _numbers(data, at: int, count: int, kind: str, end: int) -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def tracks(data) -> list[dict]:
    """Codec, time scale, duration, and place, length and sync flag of each sample, of every track."""
    found: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"kind": "", "codec": "", "scale": 0, "duration": 0, "sync": None})
            continue
        if b"trak" not in path or not found:
            continue
        t = found[-1]
        if kind == b"mdhd":
            t["scale"], t["duration"] = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        elif kind == b"hdlr":
            t["kind"] = bytes(data[at + 8 : at + 12]).decode("latin1")
        elif kind == b"stsd":
            t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin1").strip()
        elif kind == b"stts":
            t["stts"] = _numbers(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0], ">u4", end).reshape(-1, 2)
        elif kind == b"stss":
            t["sync"] = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u4", end) - 1
        elif kind == b"stsc":
            t["stsc"] = _numbers(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4", end).reshape(-1, 3)
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", data, at + 4)
            t["sizes"] = np.full(n, each, np.int64) if each else _numbers(data, at + 12, n, ">u4", end)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u4" if kind == b"stco" else ">u8", end)
    for t in found:
        if not {"stsc", "sizes", "chunks", "stts"} <= t.keys():
            raise ValueError("a track has no sample table")
        first, count = t["stsc"][:, 0] - 1, t["stsc"][:, 1]
        each = np.repeat(count, np.diff(np.append(first, len(t["chunks"]))))
        n = len(t["sizes"])
        if each.sum() != n or t["stts"][:, 0].sum() != n:
            raise ValueError("the sample tables disagree")
        before = np.cumsum(t["sizes"]) - t["sizes"]
        start = np.cumsum(each) - each
        t["at"] = np.repeat(t["chunks"], each) + before - np.repeat(before[start] if n else before, each)
        if n and int((t["at"] + t["sizes"]).max()) > len(data):
            raise ValueError("a sample leaves the file")
        if t["sync"] is None:
            t["sync"] = np.arange(n)
    return found


def read(data) -> bytes:
    """The samples of the first track in order."""
    t = tracks(data)[0]
    end = t["at"] + t["sizes"]
    new = np.flatnonzero(np.append(True, t["at"][1:] != end[:-1]))
    return b"".join(bytes(data[a:b]) for a, b in zip(t["at"][new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))


def feature(data) -> str:
    """One line: track kind, codec, time scale, duration, samples, sync samples with the crc32 of their byte ranges."""
    out = []
    for t in tracks(data):
        s = t["sync"]
        ranges = np.stack([t["at"][s], t["at"][s] + t["sizes"][s]], 1) if len(s) else np.zeros((0, 2), np.int64)
        edge = f"{ranges[0, 0]}-{ranges[0, 1]},{ranges[-1, 0]}-{ranges[-1, 1]}" if len(s) else ""
        out.append(f"{t['kind']}/{t['codec']} {t['duration']}/{t['scale']}s samples={len(t['sizes'])} sync={len(s)} ranges={edge} crc={zlib.crc32(ranges.astype('<i8').tobytes()):08x}")
    return "; ".join(out)


def media_columns(documents: DataFrame, text: str = "text", keep: tuple = ("doc_id",), with_file: bool = False) -> DataFrame:
    """Each text as a container file, with what reading it back gives: codec, time scale, duration in its units, and the byte
    ranges of the sync samples in the file, all without decoding a sample. Null counts as empty; repeated rows give
    equal files; one pass, no shuffle.

    ``with_file`` adds the file itself. Columns in ``keep`` with the name of an added one are refused.
    """
    n = len(keep)
    common.fresh(list(keep), ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "time_scale", "duration", "sync_ranges", *(("media",) if with_file else ())])
    source = documents.select(*keep, F.col(text).alias("_stored"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    schema += ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", codec string, time_scale long, duration long, sync_ranges array<struct<start:long,stop:long>>"
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "time_scale", "duration", "sync_ranges"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    if with_file:
        schema += ", media binary"
        names.append("media")
        kinds.append(pa.binary())

    def one(value) -> tuple:
        raw = b"" if value is None else value.encode("utf-8", "surrogatepass")
        media = store(pad(raw))
        back = read(media)
        t = tracks(media)[0]
        ranges = [{"start": a, "stop": b} for a, b in zip(t["at"][t["sync"]].tolist(), (t["at"] + t["sizes"])[t["sync"]].tolist(), strict=True)]
        row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(media))
        row += (t["codec"], t["scale"], t["duration"], ranges)
        return row + ((media,) if with_file else ())

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                rows = [one(x) for x in part.column(n).to_pylist()]
                added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *added], names=[*keep, *names])

    return source.mapInArrow(common.lean(run), schema)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in a container file and read back."""
    return media_columns(common.table(spark, sf_dir, "documents"))
