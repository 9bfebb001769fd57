"""What providers delivered, as Spark data sources: search replies and page fetches, recorded as JSON lines.

    spark.dataSource.register(ProviderReplies)
    hits = shape_hits(spark.read.format("provider_replies").load(folder))

Another provider is a subclass with a name, columns and a key; one that keeps no JSON lines overrides ``records`` too. Files are
read in pieces of ``pieceBytes`` (option, 64 MB), a task each, and a line belongs to the piece in which it begins. With the option
``pushdown`` and ``spark.sql.python.filterPushdown.enabled`` set, ``=`` and ``IN`` on the key are decided here: of a folder that
``write_recorded`` wrote only the files that can hold the keys are opened, and other rows are dropped before they reach Spark.

A line that is no JSON object is a row of nulls, so that it doesn't end the job; empty lines are none. A value of another type than
its column's is JSON text in a string column, else null. Further members are ignored.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

PIECE_BYTES = 64 << 20
BATCH = 1000
_TYPES = {"string": pa.string(), "int": pa.int32()}


def write_recorded(rows: DataFrame, folder: str, key: str, buckets: int) -> None:
    """``rows`` as JSON lines under ``folder``, in folders by a hash of ``key``; ``buckets``: so many that one holds what is worth opening for a key.

    A bucket of more than a partition's size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) is written by several tasks, a file each.
    """
    bucket = F.pmod(F.crc32(F.coalesce(F.col(key), F.lit("")).cast("binary")), F.lit(buckets))
    rows.withColumns({"of": F.lit(buckets), "bucket": bucket}).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("of", "bucket").json(folder)


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin at ``start`` or later, and before ``stop``."""

    path: str
    start: int
    stop: int


def _storage(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def _may_hold(path: str, keys: frozenset[str] | None) -> bool:
    found = re.search(r"/of=(\d+)/bucket=(\d+)/", path)
    return keys is None or not found or any(zlib.crc32(k.encode()) % int(found[1]) == int(found[2]) for k in keys)


class RecordedReader(DataSourceReader):
    def __init__(self, source: RecordedSource) -> None:
        self.source, self.keys = source, None

    def partitions(self) -> list[Piece]:
        folder, size = self.source.options["path"], int(self.source.options.get("pieceBytes", PIECE_BYTES))
        storage, path = _storage(folder)
        files = storage.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        files = [f for f in files if f.is_file and f.base_name[0] not in "._" and _may_hold(f.path, self.keys)]
        pieces = [Piece(f.path, at, min(at + size, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, size)]
        return pieces or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        columns, key, rows = self.source.columns, self.source.key, []
        schema = pa.schema([(name, _TYPES[kind]) for name, kind in columns.items()])
        for record in self.source.records(piece) if piece.path else ():
            row = {name: _value(record.get(name), kind) for name, kind in columns.items()}
            if self.keys is None or row[key] in self.keys:
                rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class PushingReader(RecordedReader):
    """A reader that decides filters on the key; Spark wants one without where the setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.source.key,):
                values = frozenset(v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None)
                self.keys = values if self.keys is None else self.keys & values
            else:
                yield f


def _value(value: object, kind: str) -> object:
    if kind == "string":
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**31) <= value < 2**31 else None


class RecordedSource(DataSource):
    """A data source of JSON lines. A subclass says what they hold: ``columns`` (name: string or int) and the ``key``, a string."""

    columns: dict[str, str]
    key: str

    def schema(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in self.columns.items())

    def reader(self, schema: object) -> DataSourceReader:
        return PushingReader(self) if self.options.get("pushdown", "false").lower() == "true" else RecordedReader(self)

    def records(self, piece: Piece) -> Iterator[dict]:
        """The records of a piece, one at a time."""
        storage, _ = _storage(self.options["path"])
        with storage.open_input_file(piece.path) as raw, io.BufferedReader(raw) as file:
            at = piece.start
            if at:
                file.seek(at - 1)
                at += len(file.readline()) - 1
            while at < piece.stop and (line := file.readline()):
                at += len(line)
                if line.strip():
                    try:
                        record = json.loads(line)
                    except ValueError:
                        record = None
                    yield record if isinstance(record, dict) else {}


class ProviderReplies(RecordedSource):
    """What a search service answered: the input of ``readers.shape_hits``."""

    columns = {"inn": "string", "query_no": "int", "query": "string", "reply": "string"}
    key = "inn"

    @classmethod
    def name(cls) -> str:
        return "provider_replies"


class ProviderFetches(RecordedSource):
    """What a crawler fetched: the input of ``readers.good_pages``."""

    columns = {"url": "string", "final_url": "string", "status": "int", "content_type": "string", "html": "string", "error": "string", "fetch_no": "int"}
    key = "url"

    @classmethod
    def name(cls) -> str:
        return "provider_fetches"
