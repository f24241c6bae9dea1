"""Data sources in Python: ordered batches of a stored table, and line protocol out and in.

``archive_batches`` reads a ``Store``: a task per file, only the partitions, columns and
row groups that pushed filters leave. ``line_protocol`` writes a file per task and names
the files of tasks that succeeded in one manifest, so that a task that runs twice adds no
row twice, and reads what a manifest names.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a batch.
BATCH_ROWS = 200_000
_OPS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


def opened(uri: str):
    """(file system, path) of ``uri``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _clauses(filters) -> list[tuple]:
    return [(f.attribute[0], _OPS[type(f)], list(f.value) if isinstance(f, In) else f.value) for f in filters if type(f) in _OPS and len(f.attribute) == 1]


def _may_hold(part: str, op: str, value) -> bool:
    """Whether a partition of number or text ``part`` can have rows that the clause lets through."""
    here = type(value[0] if op == "in" else value)(part)
    return {"==": lambda: here == value, "in": lambda: here in value, ">": lambda: here > value, ">=": lambda: here >= value, "<": lambda: here < value, "<=": lambda: here <= value}[op]()


class _File(InputPartition):
    def __init__(self, file: str):
        self.file = file


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names, self.clauses = options, schema.fieldNames(), []

    def pushFilters(self, filters):
        """Keeps what a Parquet reader can use; Spark applies the rest, and these again."""
        self.clauses = _clauses(filters)
        return filters

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.options["path"])
        from pyarrow import fs

        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{path}/manifest")) if f.base_name[0] != "_" and f.base_name.endswith(".json"))
        with system.open_input_stream(names[-1]) as f:
            held = json.loads(f.read())
        column, out = self.options.get("part"), []
        for part, entry in sorted(held["parts"].items()):
            if column and part and not all(_may_hold(part[1:], op, v) for c, op, v in self.clauses if c == column):
                continue
            out += [_File(f"{entry['folder']}/{f.base_name}") for f in system.get_file_info(fs.FileSelector(f"{path}/{entry['folder']}")) if f.base_name.endswith(".parquet")]
        return out

    def read(self, partition):
        system, path = opened(self.options["path"])
        with system.open_input_file(f"{path}/{partition.file}") as f:
            parquet = pq.ParquetFile(f)
            for group in range(parquet.num_row_groups):
                if not self._may(parquet, group):
                    continue
                for batch in parquet.iter_batches(BATCH_ROWS, row_groups=[group], columns=self.names):
                    keep = None
                    for c, op, v in self.clauses:
                        test = pc.is_in(batch.column(c), pa.array(v)) if op == "in" else {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[op](batch.column(c), v)
                        keep = test if keep is None else pc.and_(keep, test)
                    batch = batch.select(self.names)
                    yield batch if keep is None else batch.filter(keep)

    def _may(self, parquet: pq.ParquetFile, group: int) -> bool:
        """Whether the least and greatest values of a row group leave room for a row."""
        meta = parquet.metadata.row_group(group)
        for i in range(meta.num_columns):
            column = meta.column(i)
            stats = column.statistics
            if stats is None or not stats.has_min_max:
                continue
            for c, op, v in self.clauses:
                if c == column.path_in_schema and not (
                        any(stats.min <= x <= stats.max for x in v) if op == "in" else stats.min <= v <= stats.max if op == "==" else stats.max > v if op == ">" else stats.max >= v if op == ">=" else stats.min < v if op == "<" else stats.min <= v):
                    return False
        return True


class ArchiveBatches(DataSource):
    """``spark.read.format("archive_batches").schema(...).load(path)``; option ``part`` names the store's partition column."""

    @classmethod
    def name(cls) -> str:
        return "archive_batches"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options), schema)


class _Written(WriterCommitMessage):
    def __init__(self, file: str | None, rows: int):
        self.file, self.rows = file, rows


#: Characters that a name or tag escapes, by the format's rules.
_TAG = re.compile(r"([,= \\])")


def lines_of(batch: pa.RecordBatch, measurement: str, tags: list[str], at: str) -> list[str]:
    """Line protocol of ``batch``: tags, whole numbers with an i, floats as they are, text in quotes; ``at`` in seconds. Null fields are left out, and so are rows without any."""
    out = []
    for r in batch.to_pylist():
        key = ",".join([_TAG.sub(r"\\\1", measurement), *[f"{t}={_TAG.sub(r'\\\1', str(r[t]))}" for t in tags if r[t] is not None and r[t] != ""]])
        fields = []
        for c, v in r.items():
            if c in tags or c == at or v is None:
                continue
            text = str(v).lower() if isinstance(v, bool) else f"{v}i" if isinstance(v, int) else repr(v) if isinstance(v, float) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
            fields.append(f"{c}={text}")
        if fields:
            out.append(f"{key} {','.join(fields)} {r[at] * 1_000_000_000}")
    return out


class LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator) -> WriterCommitMessage:
        o = self.options
        system, path = opened(o["path"])
        name, rows, out = f"{uuid.uuid4().hex}.line", 0, None
        for batch in iterator:
            lines = lines_of(batch, o["measurement"], o["tags"].split(","), o["at"])
            if not lines:
                continue
            if out is None:
                system.create_dir(f"{path}/lines", recursive=True)
                out = system.open_output_stream(f"{path}/lines/{name}")
            out.write(("\n".join(lines) + "\n").encode("utf-8"))
            rows += len(lines)
        if out is not None:
            out.close()
        return _Written(f"lines/{name}" if out is not None else None, rows)

    def commit(self, messages) -> None:
        """One manifest names the files of the tasks that Spark counted."""
        system, path = opened(self.options["path"])
        system.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{path}/_{name}") as f:
            f.write(json.dumps([{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.file]).encode("utf-8"))
        system.move(f"{path}/_{name}", f"{path}/{name}.commit")

    def abort(self, messages) -> None:
        """Files that no manifest names are never read; those known here go."""
        system, path = opened(self.options["path"])
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{path}/{m.file}")


_LINE = re.compile(r"((?:[^ \\]|\\.)+) (.+) (-?[0-9]+)$")


def parsed(line: str, tags: list[str], at: str) -> dict:
    """The columns of one line."""
    key, fields, nanos = _LINE.match(line).groups()
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)
    out = {at: int(nanos) // 1_000_000_000}
    for pair in re.findall(r",((?:[^,=\\]|\\.)+)=((?:[^,=\\]|\\.)*)", key):
        if plain(pair[0]) in tags:
            out[plain(pair[0])] = plain(pair[1])
    for name, quoted, bare in re.findall(r'([^=,"]+)=(?:"((?:[^"\\]|\\.)*)"|([^,"]+))', fields):
        out[name] = plain(quoted) if not bare else bare == "true" if bare in ("true", "false") else int(bare[:-1]) if bare.endswith("i") else float(bare)
    return out


class LineReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = opened(self.options["path"])
        out = []
        for f in system.get_file_info(fs.FileSelector(path)):
            if f.base_name.endswith(".commit"):
                with system.open_input_stream(f.path) as s:
                    out += [_File(m["file"]) for m in json.loads(s.read())]
        return out

    def read(self, partition):
        system, path = opened(self.options["path"])
        tags = self.options["tags"].split(",")
        with system.open_input_stream(f"{path}/{partition.file}") as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    r = parsed(line.decode("utf-8"), tags, self.options["at"])
                    yield tuple(r.get(n) for n in self.names)


class LineProtocol(DataSource):
    """Options: path, measurement, tags (names with commas between), at (the column of seconds)."""

    @classmethod
    def name(cls) -> str:
        return "line_protocol"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LineWriter(dict(self.options))


@contextlib.contextmanager
def pushing(spark: SparkSession):
    """Filters go to sources in Python; the session's own setting comes back, after the plan is made."""
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveBatches)
    spark.dataSource.register(LineProtocol)
