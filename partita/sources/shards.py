"""Token shards as one-dimensional uint16 .npy files: reader and writer as a Spark data source, "npy"."""

from __future__ import annotations

import gzip
import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from partita.sources.files import at, listed


class _Stretch(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        super().__init__((path, lo, hi))


class NpyDataSource(DataSource):
    """Reads (shard, first, ids) in stretches of `rows` tokens of every .npy or .npy.gz under path; writes rows (shard, ids) to one file for each shard."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "shard string, first bigint, ids array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", 1_000_000)))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options["path"])


SCHEMA = pa.schema([("shard", pa.string()), ("first", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _row(path: str, first: int, ids: np.ndarray) -> pa.RecordBatch:
    name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".npy")
    tokens = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), tokens], schema=SCHEMA)


class _Reader(DataSourceReader):
    """Stretches are cut by the sizes in the listing; only tasks open files, seek to their stretch and read no more."""

    def __init__(self, root: str, rows: int):
        self.root, self.rows = root, rows

    def partitions(self):
        out = []
        for f in listed(self.root, (".npy", ".npy.gz")):
            n = 1 if f.path.endswith(".gz") else max(1, -(-f.size // (2 * self.rows)))
            out += [_Stretch(f.path, i * self.rows, (i + 1) * self.rows) for i in range(n)] if n > 1 or not f.path.endswith(".gz") else [_Stretch(f.path, 0, -1)]
        return out or [_Stretch("", 0, 0)]

    def read(self, part):
        path, lo, hi = part.value
        if not path:
            return
        system, _ = at(self.root)
        with system.open_input_file(path) as f:
            if hi < 0:
                yield _row(path, 0, np.load(io.BytesIO(gzip.decompress(f.read()))))
                return
            version = np.lib.format.read_magic(f)
            shape, _, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            hi = min(hi, shape[0])
            if lo < hi or lo == 0:
                f.seek(f.tell() + lo * kind.itemsize)
                yield _row(path, lo, np.frombuffer(f.read(max(0, hi - lo) * kind.itemsize), dtype=kind))


class _Done(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class _Writer(DataSourceWriter):
    """Every task writes under a name of its own; the names become final when all tasks are done, so retried tasks leave nothing behind."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows):
        system, root = at(self.root)
        system.create_dir(root, recursive=True)
        files = []
        for r in rows:
            a = np.asarray(r["ids"], dtype=np.int64)
            if len(a) and (a.min() < 0 or a.max() > 65535):
                raise ValueError(f"shard {r['shard']}: ids beyond 16 bits")
            tmp, whole = f"{root}/.{r['shard']}-{uuid.uuid4().hex}.tmp", io.BytesIO()
            np.save(whole, a.astype(np.uint16))
            with system.open_output_stream(tmp) as f:
                f.write(whole.getvalue())
            files.append((tmp, f"{root}/{r['shard']}.npy"))
        return _Done(files)

    def commit(self, messages):
        system, _ = at(self.root)
        for m in messages:
            for tmp, final in m.files if m else []:
                if system.get_file_info(final).type != fs.FileType.NotFound:
                    system.delete_file(final)
                system.move(tmp, final)

    def abort(self, messages):
        system, _ = at(self.root)
        for m in messages:
            for tmp, _ in m.files if m else []:
                if system.get_file_info(tmp).type != fs.FileType.NotFound:
                    system.delete_file(tmp)


def shard_rows(parts: DataFrame, name) -> DataFrame:
    """(shard, ids) of packed parts: rows with shard columns, offset and ids (the part's tokens). A shard has a fixed number of tokens, so its group is bounded."""
    g = parts.groupBy(name.alias("shard")).agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return g.select("shard", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
