"""The version log as a Spark data source: ``spark.read.format("lodestrata_log").load(root)``.

Batch and stream alike take the options ``after`` (exclusive sequence) and ``table``. Files are
read with Arrow on the executors, one partition per file; sequences in part names keep parts out
that hold nothing wanted. The stream's offset is a sequence, so a stream resumes at the entry
after the last one it saw. The root is a path or URI that Arrow can open (file, HDFS, S3, GCS).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestrata.session import ship

SCHEMA = "seq bigint, operation string, table_name string, row_key string, row_value string, is_deleted boolean, committed_at timestamp"


@dataclass
class LogFile(InputPartition):
    path: str
    after: int
    upto: int


def opened(root: str):
    """(Arrow file system, path) of a root."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def listed(system, folder: str) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found)


def parts_of(root: str) -> list[tuple[int, int, str]]:
    """(first, last, folder) of every committed part."""
    system, path = opened(root)
    names = [(p, p.rsplit("/", 1)[1].split("-")) for p in listed(system, f"{path}/log")]
    return [(int(n[1]), int(n[2]), p) for p, n in names if n[0] == "part"]


def files_between(root: str, after: int, upto: int) -> list[LogFile]:
    system, _ = opened(root)
    wanted = [folder for first, last, folder in parts_of(root) if last > after and first <= upto]
    return [LogFile(n, after, upto) for f in wanted for n in listed(system, f) if n.endswith(".parquet")]


def batches_of(root: str, part: LogFile, table: str | None):
    """Arrow batches of the wanted entries, filtered while reading."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    wanted = (ds.field("seq") > part.after) & (ds.field("seq") <= part.upto)
    if table:
        wanted &= ds.field("table_name") == table.lower()
    form = ds.ParquetFileFormat(read_options=ds.ParquetReadOptions(coerce_int96_timestamp_unit="us"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in ds.dataset(part.path, format=form, filesystem=opened(root)[0]).to_batches(filter=wanted, columns=names):
        last = batch.column(len(names) - 1).cast(pa.timestamp("us", "UTC"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=names)


class LogReader(DataSourceReader):
    def __init__(self, root: str, after: int, table: str | None):
        self.root, self.after, self.table = root, after, table

    def partitions(self):
        return files_between(self.root, self.after, 2**63 - 1) or [LogFile("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from batches_of(self.root, partition, self.table)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, after: int, table: str | None):
        self.root, self.after, self.table = root, after, table

    def initialOffset(self):
        return {"seq": self.after}

    def latestOffset(self):
        return {"seq": max([self.after, *(last for _, last, _ in parts_of(self.root))])}

    def partitions(self, start, end):
        return files_between(self.root, start["seq"], end["seq"]) or [LogFile("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from batches_of(self.root, partition, self.table)


class LogSource(DataSource):
    @classmethod
    def name(cls):
        return "lodestrata_log"

    def schema(self):
        return SCHEMA

    def _arguments(self):
        return self.options["path"], int(self.options.get("after", 0)), self.options.get("table")

    def reader(self, schema):
        return LogReader(*self._arguments())

    def streamReader(self, schema):
        return LogStreamReader(*self._arguments())


ship(__name__)
