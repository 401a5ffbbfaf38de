"""Files of a Parquet table and what their footers say, as a Python data source.

``spark.read.format("parquet_footers").load(folder)`` gives one row per file: path, folder, bytes,
rows, row_groups, data_bytes (uncompressed). The listing is made once, where the query is planned, and
dealt out by files; a task reads the footers of its files and no data.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, folder string, bytes long, rows long, row_groups int, data_bytes long"
FILES_PER_TASK = 256

#: The reader travels with the query, so workers need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class FooterReader(DataSourceReader):
    def __init__(self, path: str, files_per_task: int):
        self.path, self.files_per_task = path.rstrip("/"), files_per_task

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, folder = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        # As Spark's readers do, without files and folders whose name starts with _ or a dot.
        files = sorted(
            (x.path, x.size)
            for x in found
            if x.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in x.path[len(folder) :].split("/"))
        )
        return [_Files(files[i : i + self.files_per_task]) for i in range(0, len(files), self.files_per_task)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        system, _ = _opened(self.path)
        for path, size in partition.files:
            with system.open_input_file(path) as file:
                footer = pq.ParquetFile(file).metadata
            data = sum(footer.row_group(i).total_byte_size for i in range(footer.num_row_groups))
            yield path, path.rpartition("/")[0], size, footer.num_rows, footer.num_row_groups, data


class FooterSource(DataSource):
    """Options: path; files_per_task."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FooterReader(self.options["path"], int(self.options.get("files_per_task", FILES_PER_TASK)))


def file_footers(spark: SparkSession, path: str, parts: Sequence[str] = ()) -> DataFrame:
    """One row per file below a folder, with the partition values of its path as strings."""
    spark.dataSource.register(FooterSource)
    found = spark.read.format("parquet_footers").load(path)
    value = {p: F.regexp_extract("folder", rf"(?:^|/){p}=([^/]*)", 1) for p in parts}
    missing = "__HIVE_DEFAULT_PARTITION__"
    return found.withColumns({p: F.url_decode(F.when(~v.isin("", missing), v)) for p, v in value.items()})
