"""A table of changes read by cursor, as a streaming source of Spark's Python data source interface.

The table is Parquet with a growing integer id. Offsets are ids: a micro-batch takes the ids after the cursor, `step` of
them at most, split by row groups, whose footers tell which hold some. Ids are read once each, in order of batches; within
one, rows keep their row groups' order. The end of the last planned batch is kept beside the reader's name in the shared
folder, so that a restarted query goes on from there: Spark itself asks for a batch again that it had planned and not
finished. A batch may hold several reads (option `reads`), so that a long table doesn't cost a batch for each: each takes
`step` ids at most and is told by the id it begins after, in the column that option `read` names.
A writer may publish up to which id its table is complete (`publish`, option `head`): reading ends there, whether
that id is a row or a gap; without it at the largest id that is stored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _kept_id(path: str) -> int:
    store, name = _at(path)
    try:
        with store.open_input_file(name) as f:
            return json.loads(f.read())["id"]
    except FileNotFoundError:
        return 0


def publish(path: str, head: int) -> None:
    """Keep an id in a file: a table's writer tells so, behind its rows, that the table is complete up to it."""
    store, name = _at(path)
    with store.open_output_stream(name) as f:
        f.write(json.dumps({"id": head}).encode())


@dataclass
class RowGroup(InputPartition):
    """Ids after `low` up to `high` of one row group."""

    path: str
    number: int
    low: int
    high: int

    def __init__(self, path: str, number: int, low: int, high: int):
        self.path, self.number, self.low, self.high = path, number, low, high


class ChangeReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict[str, str]):
        self.schema, self.path, self.id, self.cursor = schema, options["path"], options.get("id", "change_id"), options["cursor"]
        self.step, self.head, self.reads, self.mark = int(options.get("step", 10_000)), options.get("head"), int(options.get("reads", 1)), options.get("read")
        self.files: dict[str, list[tuple[int, int]]] = {}
        self.last: int | None = None

    def _groups(self) -> dict[str, list[tuple[int, int]]]:
        """The least and largest id of each row group by file; footers are read once."""
        store, root = _at(self.path)
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(".parquet") and not info.base_name.startswith(("_", ".")) and info.path not in self.files:
                with store.open_input_file(info.path) as f:
                    meta = pq.ParquetFile(f).metadata
                at = meta.schema.names.index(self.id)
                stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                if any(s is None or not s.has_min_max for s in stats):
                    raise ValueError(f"{info.path} has a row group without statistics of {self.id}")
                self.files[info.path] = [(s.min, s.max) for s in stats]
        return self.files

    def _planned(self) -> int:
        return _kept_id(self.cursor)

    def _complete(self) -> int:
        """Up to which id the table is complete."""
        return _kept_id(self.head) if self.head else max((high for groups in self._groups().values() for _, high in groups), default=0)

    def initialOffset(self) -> dict:
        return {"id": 0}

    def latestOffset(self) -> dict:
        self.last = min((self._planned() if self.last is None else self.last) + self.step * self.reads, max(self._complete(), self.last or 0, 0))
        return {"id": self.last}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        publish(self.cursor, end["id"])
        self.last = max(self.last or 0, end["id"])
        out = [(low, RowGroup(name, g, start["id"], end["id"])) for name, groups in self._groups().items() for g, (low, high) in enumerate(groups) if low <= end["id"] and high > start["id"]]
        return [p for _, p in sorted(out, key=lambda x: (x[0], x[1].path))]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        store, _ = _at(self.path)
        with store.open_input_file(partition.path) as f:
            rows = pq.ParquetFile(f).read_row_group(partition.number, columns=[c.name for c in self.schema.fields if c.name != self.mark])
        ids = rows.column(self.id)
        rows = rows.filter(pc.and_(pc.greater(ids, partition.low), pc.less_equal(ids, partition.high)))
        if self.mark:
            before = pc.divide(pc.subtract(rows.column(self.id), partition.low + 1), self.step)
            rows = rows.append_column(self.mark, pc.add(pc.multiply(before, self.step), partition.low)).select([c.name for c in self.schema.fields])
        yield from rows.to_batches()


class Changes(DataSource):
    """spark.readStream.format("changes_by_cursor").schema(...).option("path", ...).option("cursor", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "changes_by_cursor"

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Changes)
