"""Samples of large archives: members of a tar.gz, and rows of a Parquet file, without reading all of them."""

from __future__ import annotations

import random
import tarfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from partita.sources.files import at, listed


class TarDataSource(DataSource):
    """spark.read.format("tarsample").load(file or folder): (archive, member, content) of at most n members a file ending in suffix, after skipping a random number below skip, until max_mb were read. One task an archive; reading stops early."""

    @classmethod
    def name(cls) -> str:
        return "tarsample"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(dict(self.options))


class _TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.n, self.skip, self.max = int(options.get("n", 20)), int(options.get("skip", 1)), float(options.get("max_mb", 80)) * 1e6
        self.suffix, self.seed = tuple(options.get("suffix", ".mid,.midi").split(",")), options.get("seed", "0")

    def partitions(self):
        return [InputPartition(f.path) for f in listed(self.root, (".tar.gz", ".tgz"))] or [InputPartition("")]

    def read(self, part):
        if not part.value:
            return
        left, skip, size = self.n, random.Random(f"{self.seed}:{part.value}").randrange(self.skip), 0
        with at(self.root)[0].open_input_stream(part.value, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as tar:
            for m in tar:
                if left <= 0 or size > self.max:
                    return
                size += m.size
                if m.isfile() and m.name.lower().endswith(self.suffix):
                    if skip:
                        skip -= 1
                        continue
                    left -= 1
                    yield part.value, m.name, tar.extractfile(m).read()


def parquet_sample(spark: SparkSession, path: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (content: the first binary column) of row groups drawn at random until they hold n rows or all are drawn.

    The driver reads the files' footers; tasks read the one column of the drawn groups, and of these rows n are
    taken by hash.
    """
    rnd, groups, column = random.Random(seed), [], None
    system, _ = at(path)
    for f in listed(path, (".parquet",)):
        with system.open_input_file(f.path) as src:
            meta = pq.ParquetFile(src).metadata
        flat = [meta.schema.column(i) for i in range(len(meta.schema))]
        column = column or next((c.name for c in flat if c.physical_type == "BYTE_ARRAY" and str(c.logical_type.type) == "NONE"), flat[0].name)
        groups += [(f.path, i, meta.row_group(i).num_rows) for i in range(meta.num_row_groups)]
    rnd.shuffle(groups)
    drawn, rows = [], 0
    for g in groups:
        if rows >= n:
            break
        drawn.append(g[:2])
        rows += g[2]

    def run(batches):
        for b in batches:
            for p, i in zip(b.column("path").to_pylist(), b.column("part").to_pylist()):
                with at(path)[0].open_input_file(p) as src:
                    got = pq.ParquetFile(src).read_row_group(i, columns=[column]).column(column).combine_chunks().cast(pa.binary())
                place = pa.array([f"{p}:{i}:{k}" for k in range(len(got))])
                yield pa.RecordBatch.from_arrays([got, place], names=["content", "place"])

    if not drawn:
        return spark.createDataFrame([], "content binary")
    todo = spark.createDataFrame(drawn, "path string, part int").repartition(len(drawn))
    return todo.mapInArrow(run, "content binary, place string").orderBy(F.xxhash64("place", F.lit(seed)), "place").limit(n).drop("place")
