"""MIDI files: parser, writer, a file scan and a Spark data source.

Parsing follows the Standard MIDI File format with these rules: the header chunk is six bytes; running status holds
over system and meta events too; a note-on of velocity 0 is a note-off; notes of one channel and pitch close first in,
first out, and those never closed are dropped; a track splits by channel and the program at note-on; channel 10 is
drums; a data byte over 127 is an error. A file that breaks a rule gives one row with the reason, never a failed job.
"""

from __future__ import annotations

import struct
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from partita.sources.files import at, listed

SCORE = """path string, tpq int, tempos array<struct<time:bigint,qpm:double>>, meters array<struct<time:bigint,num:int,den:int>>, keys array<struct<time:bigint,key:int,tonality:int>>, markers array<struct<time:bigint,text:string>>,
notes array<struct<track:int,track_name:string,program:int,is_drum:boolean,note_idx:int,start:bigint,duration:bigint,pitch:int,velocity:int>>, n_tracks int, end_tick bigint, parse_error string"""

_BYTES = {0x80: 2, 0x90: 2, 0xA0: 2, 0xB0: 2, 0xC0: 1, 0xD0: 1, 0xE0: 2}
_SYSTEM = {0xF1: 1, 0xF2: 2, 0xF3: 1, 0xF6: 0, 0xF7: 0, 0xF8: 0, 0xFA: 0, 0xFB: 0, 0xFC: 0, 0xFE: 0}


#: Notes on and off, controls and programs, whose data bytes must be right; a bad byte of another channel message does no harm.
NEEDED = (0x80, 0x90, 0xB0, 0xC0)


class MidiError(ValueError):
    pass


class _Chunk:
    """A cursor over one chunk's bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise MidiError("the file ends within a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        n = 0
        while True:
            b = self.take(1)[0]
            n = n << 7 | b & 0x7F
            if b < 0x80:
                return n

    def events(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(tick, status, meta type, data) up to the end of the track."""
        tick, status, size = 0, 0, None
        while self.at < len(self.data):
            tick += self.number()
            b = self.take(1)[0]
            if b == 0xF0:
                status = b
                mark = self.at - 1
                self.take(self.number())
                size = self.at - mark - 1
            elif b == 0xFF:
                kind = self.take(1)[0]
                data = self.take(self.number())
                if kind == 0x2F:
                    return
                yield tick, b, kind, data
            elif b < 0x80:
                if size is None:
                    raise MidiError("running status without a status")
                self.at -= 1
                yield tick, status, 0, self.take(size)
            else:
                size = _BYTES.get(b & 0xF0) if b < 0xF0 else _SYSTEM.get(b)
                if size is None:
                    raise MidiError(f"no event begins with {b:#x}")
                status = b
                yield tick, b, 0, self.take(size)


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def parse(data: bytes) -> dict:
    """The score of a file's bytes, as the fields of SCORE without path."""
    if len(data) < 14 or data[:4] != b"MThd":
        raise MidiError("no MThd header")
    if struct.unpack(">I", data[4:8])[0] != 6:
        raise MidiError("MThd has a length other than 6")
    n_tracks, division = struct.unpack(">HH", data[10:14])
    out = {"tpq": division & 0x7FFF, "tempos": [], "meters": [], "keys": [], "markers": [], "notes": []}
    tracks, end, at, seen = 0, 0, 14, 0
    while seen < n_tracks and at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        if kind == b"MTrk":
            seen += 1
            tracks, end = _read_track(_Chunk(data[at + 8 : at + 8 + size]), out, tracks, end)
        at += 8 + size
    for k in ("tempos", "meters", "keys", "markers"):
        out[k].sort(key=lambda x: x["time"])
    out["n_tracks"], out["end_tick"] = tracks, max([end, *(x["time"] for k in ("tempos", "meters", "keys", "markers") for x in out[k])])
    return out


def _read_track(chunk: _Chunk, out: dict, tracks: int, end: int) -> tuple[int, int]:
    program, name = [0] * 16, ""
    lines: dict[tuple[int, int], list] = defaultdict(list)
    sounding: dict[tuple[int, int], deque] = defaultdict(deque)
    for tick, status, kind, d in chunk.events():
        if status == 0xFF:
            if kind == 0x03:
                name = _text(d)
            elif kind == 0x51 and len(d) >= 3:
                us = int.from_bytes(d[:3], "big")
                out["tempos"].append({"time": tick, "qpm": 60e6 / us if us else 0.0})
            elif kind == 0x58 and len(d) >= 2:
                out["meters"].append({"time": tick, "num": d[0], "den": 1 << min(d[1], 30)})
            elif kind == 0x59 and len(d) >= 2:
                out["keys"].append({"time": tick, "key": struct.unpack("b", d[:1])[0], "tonality": d[1]})
            elif kind == 0x06 and d:
                out["markers"].append({"time": tick, "text": _text(d)})
            continue
        if status >= 0xF0:
            continue
        what, channel = status & 0xF0, status & 0x0F
        if what in NEEDED and max(d, default=0) > 0x7F:
            raise MidiError(f"data byte {max(d)} over 127")
        if what == 0x90 and d[1]:
            note = [tick, None, d[0], d[1]]
            lines[channel, program[channel]].append(note)
            sounding[channel, d[0]].append(note)
        elif what in (0x80, 0x90):
            if q := sounding[channel, d[0]]:
                note = q.popleft()
                note[1] = tick - note[0]
        elif what == 0xC0:
            program[channel] = d[0]
        else:
            end = max(end, tick)
    for (channel, prog), notes in sorted(lines.items()):
        for i, (start, duration, pitch, velocity) in enumerate(n for n in notes if n[1] is not None):
            end = max(end, start + duration)
            out["notes"].append({"track": tracks, "track_name": name, "program": prog, "is_drum": channel == 9, "note_idx": i, "start": start, "duration": duration, "pitch": pitch, "velocity": velocity})
        tracks += 1
    return tracks, end


def parse_row(path: str, data: bytes | None) -> dict:
    """parse() as a row; a broken file keeps its path and the reason."""
    try:
        return {"path": path, **parse(bytes(data or b"")), "parse_error": None}
    except (MidiError, struct.error, IndexError) as e:
        return {"path": path, "tpq": None, "tempos": [], "meters": [], "keys": [], "markers": [], "notes": [], "n_tracks": 0, "end_tick": 0, "parse_error": str(e)}


def _varlen(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(0x80 | n & 0x7F)
    return bytes(reversed(out))


def dump(tpq: int, notes: list[dict], tempos: list[dict] = (), meters: list[dict] = ()) -> bytes:
    """Format-1 bytes: meta events first, then one track for each (track, program, drums) with its own channel. At one tick, note-offs of sounding notes go before note-ons; a note of length 0 is closed after it began."""
    meta = [(t["time"], 0, b"\xff\x51\x03" + round(60e6 / t["qpm"]).to_bytes(3, "big")) for t in tempos if t["qpm"] > 0]
    meta += [(m["time"], 0, b"\xff\x58\x04" + bytes([m["num"], m["den"].bit_length() - 1, 24, 8])) for m in meters]
    parts: dict[tuple, list] = defaultdict(list)
    for n in notes:
        parts[n["track"], n["program"], n["is_drum"], n.get("track_name") or ""].append(n)
    chunks, free = [meta] if meta or not parts else [], [c for c in range(16) if c != 9]
    for k, ((_, program, drum, name), ns) in enumerate(parts.items()):
        c = 9 if drum else free[k % 15]
        ev = [(0, 0, b"\xff\x03" + _varlen(len(name.encode())) + name.encode())] if name else []
        ev.append((0, 0, bytes([0xC0 | c, program & 0x7F])))
        for n in sorted(ns, key=lambda x: x["start"]):
            on, off = bytes([0x90 | c, n["pitch"], n["velocity"]]), bytes([0x80 | c, n["pitch"], n["velocity"]])
            ev += [(n["start"], 2, on), (n["start"] + n["duration"], 1 if n["duration"] else 3, off)]
        chunks.append(ev)
    out = [b"MThd" + struct.pack(">IHHH", 6, 1, len(chunks), tpq)]
    for ev in chunks:
        body, at = bytearray(), 0
        for t, _, data in sorted(ev, key=lambda e: e[:2]):
            body += _varlen(t - at) + data
            at = t
        body += b"\x00\xff\x2f\x00"
        out.append(b"MTrk" + struct.pack(">I", len(body)) + bytes(body))
    return b"".join(out)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """SCORE rows of all .mid and .midi files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("path").rlike(r"(?i)\.midi?$")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse_row(p, c) for p, c in zip(b["path"], b["content"])], columns=["path", "tpq", "tempos", "meters", "keys", "markers", "notes", "n_tracks", "end_tick", "parse_error"]).astype({"tpq": "Int32"})

    return files.mapInPandas(run, SCORE)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class MidiDataSource(DataSource):
    """spark.read.format("midi").load(folder): one partition a file, for folders the executors can list; scan() splits large trees better."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return SCORE

    def reader(self, schema) -> DataSourceReader:
        return _MidiReader(self.options["path"])


class _MidiReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        return [_File(f.path) for f in listed(self.root, (".mid", ".midi"))] or [_File("")]

    def read(self, part):
        if part.value:
            with at(self.root)[0].open_input_file(part.value) as f:
                row = parse_row(part.value, f.read())
            fields = ("track", "track_name", "program", "is_drum", "note_idx", "start", "duration", "pitch", "velocity")
            pairs = {"tempos": ("time", "qpm"), "meters": ("time", "num", "den"), "keys": ("time", "key", "tonality"), "markers": ("time", "text"), "notes": fields}
            from pyspark.sql import Row

            yield tuple([Row(**{c: x[c] for c in pairs[k]}) for x in v] if k in pairs else v for k, v in row.items())


def explode_notes(scores: DataFrame) -> DataFrame:
    """One row for each note of parsed scores, keyed by path."""
    return scores.filter("parse_error is null").select(F.col("path").alias("file_id"), "tpq", F.explode("notes").alias("n")).select("file_id", "tpq", "n.*")
