"""Edge lists in text files, and in binary files as a data source: `spark.read.format("edges")`.

A binary record is a pair of little-endian uint32, src and dst, followed by a float32 weight if the option `weighted` is
true; there is no header. Files lie in a folder that driver and executors reach by pyarrow.fs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The list of the files that a finished write has made; where there is none, all files of the folder are read.
COMMITTED = "_files.json"
#: Bytes that a reading task takes, and records of a batch.
SPLIT, BATCH = 64 << 20, 1 << 16


def _records(weighted: bool) -> np.dtype:
    return np.dtype([("src", "<u4"), ("dst", "<u4")] + ([("weight", "<f4")] if weighted else []))


def _weighted(options: dict) -> bool:
    return str(options.get("weighted", "false")).lower() == "true"


def _files(path: str):
    """The file system and the folder in it that a path or URI names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Edges(DataSource):
    """Options: path; weighted; split, the bytes that a reading task takes."""

    @classmethod
    def name(cls) -> str:
        return "edges"

    def schema(self) -> str:
        return "src long, dst long" + (", weight double" if _weighted(self.options) else "")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], _weighted(self.options), int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], _weighted(self.options), overwrite, schema.fieldNames())


@dataclass
class Span(InputPartition):
    """Whole records of a file: `count` from number `start` on."""

    file: str
    start: int
    count: int


@dataclass
class Reader(DataSourceReader):
    path: str
    weighted: bool
    split: int

    def partitions(self) -> list[Span]:
        """Spans of whole records; a file with a part of a record is an error."""
        from pyarrow import fs

        files, folder = _files(self.path)
        kind, step = _records(self.weighted), max(1, self.split // _records(self.weighted).itemsize)
        known = {f.path: f.size for f in files.get_file_info(fs.FileSelector(folder)) if f.is_file}
        listed = f"{folder}/{COMMITTED}"
        if listed in known:
            with files.open_input_stream(listed) as f:
                names = [f"{folder}/{n}" for n in json.loads(f.read())]
        else:
            names = sorted(p for p in known if not p.rsplit("/", 1)[1].startswith(("_", ".")))
        out = []
        for name in names:
            if known[name] % kind.itemsize:
                raise ValueError(f"{name}: {known[name]} bytes are no whole number of records")
            n = known[name] // kind.itemsize
            out += [Span(name, at, min(step, n - at)) for at in range(0, n, step)]
        return out

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # no partitions
            return
        files, _ = _files(self.path)
        kind = _records(self.weighted)
        with files.open_input_file(span.file) as f:
            f.seek(span.start * kind.itemsize)
            for at in range(0, span.count, BATCH):
                records = np.frombuffer(f.read(min(BATCH, span.count - at) * kind.itemsize), kind)
                yield pa.RecordBatch.from_arrays([pa.array(records[n].astype(np.float64 if n == "weight" else np.int64)) for n in kind.names], names=list(kind.names))


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    count: int


@dataclass
class Writer(DataSourceArrowWriter):
    """A task writes one file under a name of its own. The list of files is written when all tasks are done, so what a
    lost or repeated task has left is never read; of a write that fails nothing stays."""

    path: str
    weighted: bool
    overwrite: bool
    columns: list[str]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        name, count = f"part-{uuid.uuid4().hex}.bin", 0
        kind = _records(self.weighted)
        at = [self.columns.index(n) for n in kind.names]
        with files.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                records = np.empty(batch.num_rows, kind)
                for k, n in zip(at, kind.names, strict=True):
                    column = batch.column(k)
                    if n != "weight" and column.null_count:
                        raise ValueError(f"an edge has no {n}")
                    x = column.to_numpy(zero_copy_only=False)
                    if n != "weight" and len(x) and (x.min() < 0 or x.max() >= 1 << 32):
                        raise ValueError("an id does not fit in 32 bits")
                    records[n] = x
                out.write(records.tobytes())
                count += len(records)
        return Written(name, count)

    def _list(self, files, folder: str) -> list[str]:
        from pyarrow import fs

        if not any(f.path == f"{folder}/{COMMITTED}" for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True))):
            return []
        with files.open_input_stream(f"{folder}/{COMMITTED}") as f:
            return json.loads(f.read())

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        before = self._list(files, folder)
        new = [m.file for m in messages if m is not None and m.count]
        with files.open_output_stream(f"{folder}/{COMMITTED}") as out:
            out.write(json.dumps(sorted(new if self.overwrite else before + new)).encode())
        self._delete(files, folder, [m.file for m in messages if m is not None and not m.count] + (before if self.overwrite else []))

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _files(self.path)
        self._delete(files, folder, [m.file for m in messages if m is not None])

    @staticmethod
    def _delete(files, folder: str, names: list[str]) -> None:
        for name in names:
            files.delete_file(f"{folder}/{name}")


def read_edges_binary(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(src, dst), and weight if `weighted`, of binary files; large files are split across tasks."""
    spark.dataSource.register(Edges)
    return spark.read.format("edges").option("weighted", weighted).load(path)


def write_edges_binary(edges: DataFrame, path: str, weighted: bool = False, mode: str = "append") -> None:
    """Binary edge files below path, one for each task; ids outside uint32 and null ends are errors."""
    edges.sparkSession.dataSource.register(Edges)
    kind = [F.col("src").cast("long"), F.col("dst").cast("long"), *([F.col("weight").cast("double")] if weighted else [])]
    edges.select(*kind).write.format("edges").option("weighted", weighted).mode(mode).save(path)


#: What read_edges_text does with lines whose ends are no numbers.
BAD_LINES = ("skip", "fail")


def parse_edges(lines: DataFrame, bad_lines: str = "skip") -> DataFrame:
    """(src, dst, weight) of text lines; blank or tab between, a third token is a weight.

    Lines that are empty or start with # or % are left out. So are lines whose ends are no numbers, or they raise an
    error where bad_lines is `fail`; bad_edge_lines counts them."""
    if bad_lines not in BAD_LINES:
        raise ValueError(f"bad_lines is one of {BAD_LINES}")
    parsed = _parsed(lines)
    if bad_lines == "skip":
        return parsed.filter(~_bad()).select("src", "dst", "weight")
    message = F.concat(F.lit("no edge: "), F.col("value"))
    return parsed.select(F.when(~_bad(), F.col("src")).otherwise(F.raise_error(message).cast("long")).alias("src"), "dst", "weight")


def bad_edge_lines(lines: DataFrame) -> DataFrame:
    """(value): the lines whose ends are no numbers."""
    return _parsed(lines).filter(_bad()).select("value")


def _bad() -> Column:
    return F.col("src").isNull() | F.col("dst").isNull()


def _parsed(lines: DataFrame) -> DataFrame:
    kept = lines.filter(F.trim("value").rlike(r"^[^#%\s]")).select("value", F.split(F.trim("value"), r"\s+").alias("t"))
    return kept.select("value", F.expr("try_cast(get(t, 0) AS bigint)").alias("src"), F.expr("try_cast(get(t, 1) AS bigint)").alias("dst"), F.expr("try_cast(get(t, 2) AS double)").alias("weight"))


def read_edges_text(spark: SparkSession, path: str, bad_lines: str = "skip") -> DataFrame:
    return parse_edges(spark.read.text(path), bad_lines)
