"""A written log as a stream with a cap per micro-batch, in rows or bytes.

Spark's file source paces by files only. This source's offset is a seq: a micro-batch takes the rows
of (start, end], where end is chosen from the bounds, rows and bytes of row groups that the files'
footers hold. A footer is read once per file; rows are read in tasks, a row group each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from seqlake.schema import LOG

FORMAT = "paced_log"


@dataclass
class RowGroup(InputPartition):
    """A row group, and of it the rows of (after, before]."""

    path: str
    number: int
    low: int
    high: int
    rows: int
    size: int
    after: int = 0
    before: int = 0


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


class PacedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"].rstrip("/"), schema.fieldNames()
        self.most_rows, self.most_bytes = (int(options.get(k, 0)) for k in ("rowspertrigger", "bytespertrigger"))
        self.groups: dict[str, list[RowGroup]] = {}
        self.position = 0

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def _listed(self) -> list[RowGroup]:
        """Row groups in order of seq. While a job still writes here its files aren't looked at, so none is passed over."""
        fs, root = _opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        if not any(f.base_name == "_temporary" for f in found):
            for f in found:
                if f.type == pafs.FileType.File and f.base_name.endswith(".parquet") and f.base_name[0] not in "._" and f.base_name not in self.groups:
                    meta = pq.read_metadata(f.path, filesystem=fs)
                    column = meta.schema.names.index("seq")
                    each = [(k, meta.row_group(k)) for k in range(meta.num_row_groups)]
                    bounds = [(k, g, g.column(column).statistics) for k, g in each if g.num_rows]
                    self.groups[f.base_name] = [RowGroup(f"{self.path}/{f.base_name}", k, s.min, s.max, g.num_rows, g.total_byte_size) for k, g, s in bounds]
        return sorted((g for groups in self.groups.values() for g in groups), key=lambda g: (g.low, g.high))

    def latestOffset(self) -> dict:
        """The furthest seq within the caps. A seq is one row; bytes count by the share of a row group's span, and a trigger takes one seq at least."""
        end, size = self.position, 0.0
        last = end + self.most_rows if self.most_rows else None
        for g in self._listed():
            if g.high <= end:
                continue
            start = max(end + 1, g.low)
            stop = g.high if last is None else min(g.high, last)
            if stop < start:  # within the cap there are only seqs that don't exist
                end = max(end, min(g.low, last) if end == self.position else end)
                break
            per_seq = g.size / (g.high - g.low + 1)
            if self.most_bytes and size + per_seq * (stop - start + 1) > self.most_bytes:
                fit = int((self.most_bytes - size) / per_seq)
                end = start + fit - 1 if fit else (start if end == self.position else end)
                break
            end, size = stop, size + per_seq * (stop - start + 1)
        return {"seq": end}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        """Also called with (end, end) when a stream resumes, which tells the position."""
        self.position = end["seq"]
        wanted = [g for g in self._listed() if g.high > start["seq"] and g.low <= end["seq"]] if start != end else []
        return [RowGroup(g.path, g.number, g.low, g.high, g.rows, g.size, start["seq"], end["seq"]) for g in wanted]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(partition.path)
        with fs.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(4096, row_groups=[partition.number], columns=self.names):
                seq = batch.column("seq")
                yield batch.filter(pc.and_(pc.greater(seq, partition.after), pc.less_equal(seq, partition.before))).select(self.names)


class PacedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return LOG

    def streamReader(self, schema: StructType) -> PacedReader:
        return PacedReader(self.options, schema)


def paced_log(spark: SparkSession, path: str, rows: int = 0, size: int = 0) -> DataFrame:
    """A log folder as a stream of at most ``rows`` rows and about ``size`` bytes (of columns, before compression) per micro-batch.

    0 means no cap. With a trigger of a second, these are caps per second. A stream resumes after the
    last seq of its checkpoint. Seqs must grow from append to append and be unique: a file that comes later with seqs
    below the position isn't read. An availableNow trigger takes a single micro-batch.
    """
    spark.dataSource.register(PacedLog)
    return spark.readStream.format(FORMAT).schema(LOG).option("rowsPerTrigger", rows).option("bytesPerTrigger", size).load(path)
