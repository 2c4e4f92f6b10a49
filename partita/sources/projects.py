"""Notes of gzipped XML project files: arrangements with loops unrolled, and single clips.

Python only turns a file into a flat table of the notes of its clips (`note_table`), by one pass over the XML's
events. What sounds, how loops repeat and what is percussion or to be left out are expressions over that table.
"""

from __future__ import annotations

import gzip
import io
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TPQ = 480
# Track names that suggest percussion: fixed values.
PERCUSSION = ("kick", "snare", "clap", "hat", "hihat", "tom", "perc", "crash", "ride", "rim", "shaker", "cymbal", "808", "909", "kit", "drum")
#: Names of model-written material, which is to be left out; products are added by parameter.
EXCLUDE = r"pilot|_gen|mcp|\bmodel\b|test_midi|midi_test"
MOST_KEYS, FEW_PITCHES, NAME_LENGTH = 2, 3, 60
RAW = "path string, track int, clip int, arranged boolean, speaker boolean, track_name string, user_name string, clip_name string, devices int, drum_devices int, disabled boolean, begin double, end double, loop_from double, loop_to double, looped boolean, pitch double, time double, length double, velocity double, enabled boolean, tempo double, error string"
NOTE = ["path", "unit", "track", "name", "is_drum", "start", "duration", "pitch", "velocity", "tempo", "excluded", "error"]


def _float(text: str | None, default: float | None = None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return default


class _Reader:
    """Collects the notes of one file from the start and end events of its elements."""

    #: Where a setting stands, seen from the element it belongs to, and its name here.
    TRACK = {("Name", "EffectiveName"): "track_name", ("Name", "UserName"): "user_name", ("Mixer", "Speaker", "Manual"): "speaker"}
    CLIP = {("Name",): "clip_name", ("Disabled",): "disabled", ("CurrentStart",): "begin", ("CurrentEnd",): "end", ("Loop", "LoopStart"): "loop_from", ("Loop", "LoopEnd"): "loop_to", ("Loop", "LoopOn"): "looped"}

    def __init__(self) -> None:
        self.at: list[str] = []
        self.tracks, self.rows, self.tempos = 0, [], {}
        self.track: dict | None = None
        self.clip: dict | None = None
        self.line: list | None = None  # notes of a key, of which the pitch may come later

    def _set(self, into: dict, names: dict, value: str | None) -> None:
        for where, name in names.items():
            if tuple(self.at[-len(where):]) == where and value is not None:
                into.setdefault(name, value)

    def start(self, tag: str, attrs: dict) -> None:
        self.at.append(tag)
        value = attrs.get("Value")
        if self.clip is not None:
            if self.at[self.clip["depth"]:] in ([*w] for w in self.CLIP):
                self._set(self.clip, self.CLIP, value)
            if tag == "KeyTrack":
                self.line = [None, []]
            elif self.line is not None and tag == "MidiKey":
                self.line[0] = _float(value)
            elif self.line is not None and tag == "MidiNoteEvent":
                self.line[1].append((_float(attrs.get("Time"), 0.0), _float(attrs.get("Duration"), 0.0), _float(attrs.get("Velocity"), 80.0), attrs.get("IsEnabled", "true").lower() == "true"))
        elif self.track is not None:
            self._set(self.track, self.TRACK, value)
            if self.at[-2:-1] == ["Devices"] and "DeviceChain" in self.at:
                self.track["devices"] += 1
                self.track["drum_devices"] += "DrumGroupDevice" in tag
        if tag == "MidiTrack" and self.track is None:
            self.track = {"track": self.tracks, "devices": 0, "drum_devices": 0, "clips": 0, "rows": []}
            self.tracks += 1
        elif tag == "MidiClip" and self.track is not None and self.clip is None:
            self.clip = {"clip": self.track["clips"], "arranged": "ArrangerAutomation" in self.at, "depth": len(self.at)}
            self.track["clips"] += 1
        if "Tempo" in self.at and tag in ("Manual", "FloatEvent"):
            main = "MasterTrack" in self.at
            rank = 0 if main and tag == "Manual" else 1 if tag == "Manual" else 2 if main else None
            if rank is not None and (t := _float(value)) is not None:
                self.tempos.setdefault(rank, t)

    def end(self, tag: str) -> None:
        if tag == "KeyTrack" and self.line is not None:
            pitch, notes = self.line
            self.track["rows"] += [(self.clip, pitch, *n) for n in notes if pitch is not None]
            self.line = None
        elif tag == "MidiClip" and self.clip is not None and len(self.at) == self.clip["depth"]:
            self.clip = None
        elif tag == "MidiTrack" and self.clip is None:
            self.rows += [(self.track, *r) for r in self.track["rows"]]
            self.track = None
        self.at.pop()

    def table(self, path: str) -> list[dict]:
        yes = lambda x, default: default if not x else x.lower() == "true"
        tempo = self.tempos[min(self.tempos)] if self.tempos else 120.0
        return [
            {"path": path, "track": t["track"], "clip": c["clip"], "arranged": c["arranged"], "speaker": yes(t.get("speaker"), True), "track_name": t.get("track_name", ""), "user_name": t.get("user_name", ""), "clip_name": c.get("clip_name", ""),
             "devices": t["devices"], "drum_devices": t["drum_devices"], "disabled": yes(c.get("disabled"), False), **{k: _float(c.get(k), 0.0) for k in ("begin", "end", "loop_from", "loop_to")}, "looped": yes(c.get("looped"), False),
             "pitch": pitch, "time": time, "length": length, "velocity": velocity, "enabled": enabled, "tempo": tempo}
            for t, c, pitch, time, length, velocity, enabled in self.rows
        ]


def notes_of(path: str, data: bytes) -> list[dict]:
    """RAW rows of one file; one row with the error if it can't be read."""
    try:
        text = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        reader = _Reader()
        for event, e in ET.iterparse(io.BytesIO(text), events=("start", "end")):
            if event == "start":
                reader.start(e.tag, e.attrib)
            else:
                reader.end(e.tag)
                e.clear()
        return reader.table(path)
    except (ET.ParseError, OSError, EOFError, zlib.error) as e:
        return [{"path": path, "error": f"{type(e).__name__}: {e}"[:200]}]


def note_table(spark: SparkSession, root: str) -> DataFrame:
    """RAW rows of all .als files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("path").rlike(r"(?i)\.als$")).select("path", "content")
    kinds = [c.strip().split(" ") for c in RAW.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = {"int": "Int64", "double": "Float64", "boolean": "boolean", "string": "object"}
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows = notes_of(p, bytes(c))
                yield pd.DataFrame(rows, columns=[k for k, _ in kinds]).astype({k: to[t] for k, t in kinds})

    return files.mapInPandas(run, RAW)


def _out(df: DataFrame, unit: Column, name: Column, drum: Column, start: Column, length: Column, excluded: Column) -> DataFrame:
    ticks = lambda x: F.bround(x * TPQ).cast("bigint")
    cut = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x.cast("int")))
    return df.select("path", unit.alias("unit"), "track", name.alias("name"), drum.alias("is_drum"), ticks(start).alias("start"), F.greatest(F.lit(1).cast("bigint"), ticks(length)).alias("duration"), cut(F.col("pitch"), 0, 127).alias("pitch"), cut(F.col("velocity"), 1, 127).alias("velocity"), "tempo", excluded.alias("excluded"), "error")


def _failed(raw: DataFrame) -> DataFrame:
    return raw.filter("error is not null").select(*(F.col(c) if c in ("path", "error") else F.lit(None).alias(c) for c in NOTE))


def arrangement(raw: DataFrame) -> DataFrame:
    """Notes as the arrangement plays them: muted tracks and disabled clips are silent, a looped clip repeats its region until its end, only notes that begin in the region sound, and a clip cuts what rings past it.

    Drums are tracks with a drum rack, and those named after percussion whose arranged clips use few keys.
    """
    x = raw.filter("error is null and arranged")
    keys = F.size(F.collect_set("pitch").over(Window.partitionBy("path", "track")))
    x = x.withColumn("drum", (F.col("drum_devices") > 0) | (F.lower("track_name").rlike("|".join(PERCUSSION)) & (keys <= MOST_KEYS)))
    region, span = F.col("loop_to") - F.col("loop_from"), F.col("end") - F.col("begin")
    x = x.filter(F.col("speaker") & ~F.col("disabled") & F.col("enabled") & (F.col("length") > 0) & (region > 0) & (span > 0) & (F.col("time") >= F.col("loop_from")) & (F.col("time") < F.col("loop_to")))
    passes = F.when(F.col("looped"), F.floor(span / region)).otherwise(0).cast("int")
    x = x.withColumn("pass", F.explode(F.sequence(F.lit(0), passes))).withColumn("start", F.col("begin") + F.col("time") - F.col("loop_from") + F.col("pass") * region).filter(F.col("start") < F.col("end"))
    return _out(x, F.lit("arrangement"), F.substring("track_name", 1, NAME_LENGTH), F.col("drum"), F.col("start"), F.least("length", F.col("end") - F.col("start")), F.lit(None).cast("string"))


def clips(raw: DataFrame, few: int = FEW_PITCHES, exclude: str = EXCLUDE) -> DataFrame:
    """Notes of every clip by itself, with the reason why model-written material is to be left out. Without devices a clip of under `few` pitches counts as drums."""
    x = raw.filter("error is null and enabled and length > 0")
    pitches = F.size(F.collect_set("pitch").over(Window.partitionBy("path", "track", "clip")))
    name = F.when(F.col("track_name") != "", F.col("track_name")).otherwise(F.col("user_name"))
    bad = lambda c: c.rlike(f"(?i){exclude}")
    why = F.when(bad(F.col("path")), "project").when(bad(name), "track").when(bad(F.col("clip_name")), "clip")
    drum = F.when(F.col("devices") > 0, F.col("drum_devices") > 0).otherwise(pitches < few)
    x = x.withColumn("drum", drum)
    return _out(x, F.concat_ws("-", F.lit("clip"), "track", "clip"), F.when(F.col("clip_name") != "", F.col("clip_name")).otherwise(name), F.col("drum"), F.col("time"), F.col("length"), why)


def scan(spark: SparkSession, root: str, by_clip: bool = False, exclude: str = EXCLUDE) -> DataFrame:
    """NOTE rows of all .als files under root; a broken file gives one row with the error."""
    raw = note_table(spark, root)
    return (clips(raw, exclude=exclude) if by_clip else arrangement(raw)).unionByName(_failed(raw))
