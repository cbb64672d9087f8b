"""Position arrays, packed: one number for each position of a contig, in chunks of variable-length integers.

In memory an array is rows (contig, chunk, size, numbers): `numbers` are the packed values of positions
chunk * CHUNK on, `size` of them. Rows (contig, pos, value) are packed and unpacked over Arrow, a chunk at
a time, so that no row and no task holds a contig.

In files an array is a message of the public wire format of `MESSAGE`: one file for each contig, whose
chunks are packed segments of its own message, so that files of several contigs can be joined end to end.
`spark.read.format("position_numbers")` reads such files as (sample, contig, pos, value); a contig's segments
are read in parallel where option `segment` names the number of positions that each of them has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bam import storage

# Fixed values of the format: fields of the outer message, and of a contig's.
MESSAGE = {"sample": 1, "version": 2, "arguments": 3, "contig": 4}
CONTIG = {"name": 1, "numbers": 2}

CHUNK = 65536
#: Bytes that are unpacked at a time, and the segments of a partition in bytes, about.
STEP, PIECE = 1 << 20, 64 << 20
VERSION = "strandlake"


# ---- variable-length integers


def pack(values: np.ndarray) -> bytes:
    """Base-128 integers, low part first; negative ones have ten bytes."""
    v = np.asarray(values, np.int64).view(np.uint64)
    if not len(v):
        return b""
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]), np.uint8)
    for k in range(int(size.max())):
        has = np.flatnonzero(size > k)
        low = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[end[has] - size[has] + k] = low | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    """The whole integers at the front, and the bytes of one that isn't whole."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.int64), data
    whole = b[: ends[-1] + 1]
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(whole)) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((whole & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)
    return values.view(np.int64), data[ends[-1] + 1 :]


def one(value: int) -> bytes:
    return pack(np.array([value]))


# ---- rows


def packed(values: DataFrame, contigs: DataFrame | None = None, value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """(contig, chunk, size, numbers) of rows (contig, pos, value).

    Positions without a row are 0; several rows of a position add up. Contigs are as long as
    `contigs` (contig, length) says, else up to their last position; a position beyond is an error.
    """
    rows = values.select("contig", F.col("pos").cast("long").alias("pos"), F.col(value).cast("long").alias("value"))
    lengths = contigs.select("contig", F.col("length").cast("long").alias("length")) if contigs is not None else rows.groupBy("contig").agg((F.max("pos") + 1).alias("length"))
    numbered = rows.select("contig", F.expr(f"pos div {chunk}").alias("chunk"), "pos", "value", F.lit(None).cast("long").alias("length"))
    grid = lengths.where("length > 0").select("contig", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {chunk}"))).alias("chunk"))
    every = numbered.unionByName(grid.withColumns({"pos": F.col("chunk") * chunk, "value": F.lit(0).cast("long")}))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        known = pa.compute.max(table.column("length")).as_py()
        first = key[1].as_py() * chunk
        size = min(chunk, known - first) if known is not None else 0
        at = table.column("pos").to_numpy() - first
        if size <= 0 or at.min() < 0 or at.max() >= size:
            raise ValueError(f"contig {key[0].as_py()} has positions beyond its length")
        dense = np.zeros(size, np.int64)
        np.add.at(dense, at, table.column("value").to_numpy())
        return pa.table({"contig": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int64()), "size": pa.array([size], pa.int64()), "numbers": pa.array([pack(dense)], pa.binary())})

    return every.groupBy("contig", "chunk").applyInArrow(make, "contig string, chunk long, size long, numbers binary")


def unpacked(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(contig, pos, value) for every position of packed rows; no shuffle."""
    schema = pa.schema([("contig", pa.string()), ("pos", pa.int64()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, rest = unpack(row["numbers"])
                if rest or len(values) != row["size"]:
                    raise ValueError(f"chunk {row['chunk']} of {row['contig']} does not hold {row['size']} numbers")
                yield positions(schema, [row["contig"]], row["chunk"] * chunk, values)

    return chunks.select("contig", "chunk", "size", "numbers").mapInArrow(run, "contig string, pos long, value long")


def positions(schema: pa.Schema, names: list[str], first: int, values: np.ndarray) -> pa.RecordBatch:
    same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(values), np.int32)), [n]).cast(pa.string()) for n in names]
    return pa.RecordBatch.from_arrays([*same, pa.array(first + np.arange(len(values))), pa.array(values)], schema=schema)


# ---- files


@dataclass
class Segments(InputPartition):
    """Packed segments (offset, bytes) of a contig, the first of which begins with position `first`."""

    path: str
    sample: str
    contig: str
    first: int
    parts: list[tuple[int, int]]
    #: Positions of each segment, and whether the contig's last one, which may be shorter, is among these.
    segment: int | None
    last: bool


class Cursor:
    """Fields of messages in a file, one after another; their contents are read only if asked for."""

    def __init__(self, file) -> None:
        self.file, self.at = file, 0

    def integer(self) -> int:
        value = shift = 0
        while True:
            self.file.seek(self.at)
            b = self.file.read(1)
            if not b:
                raise EOFError("the file ends inside a message")
            self.at += 1
            value |= (b[0] & 127) << shift
            shift += 7
            if b[0] < 128:
                return value

    def field(self) -> tuple[int, int]:
        """Number and size of a field of bytes, whose contents begin at `at`."""
        key = self.integer()
        if key & 7 != 2:
            raise ValueError("not a file of position numbers")
        return key >> 3, self.integer()

    def text(self, size: int) -> str:
        self.file.seek(self.at)
        return self.file.read(size).decode()


class NumbersReader(DataSourceReader):
    def __init__(self, path: str, segment: int | None, split: int = PIECE):
        self.segment, self.split = segment, split
        self.store, root = storage(path)
        self.files = sorted(f.path for f in self.store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".numbers")) if self.store.get_file_info(root).type == fs.FileType.Directory else [root]

    def contigs(self, path: str) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
        """(sample, contig, its segments) of a file; sizes are read, numbers are passed over."""
        with self.store.open_input_file(path) as file:
            cursor, sample, end = Cursor(file), "", file.size()
            while cursor.at < end:
                number, size = cursor.field()
                stop = cursor.at + size
                if number == MESSAGE["sample"]:
                    sample = cursor.text(size)
                elif number == MESSAGE["contig"]:
                    name, parts = "", []
                    while cursor.at < stop:
                        inner, length = cursor.field()
                        if inner == CONTIG["name"]:
                            name = cursor.text(length)
                        elif inner == CONTIG["numbers"]:
                            parts.append((cursor.at, length))
                        cursor.at += length
                    yield sample, name, parts
                cursor.at = stop

    def partitions(self) -> list[Segments]:
        pieces, seen = [], set()
        for path in self.files:
            for sample, contig, parts in self.contigs(path):
                if (sample, contig) in seen:
                    raise ValueError(f"contig {contig} of sample {sample} is there twice")
                seen.add((sample, contig))
                own: list[tuple[int, int]] = []
                first = 0
                for k, part in enumerate(parts):
                    own.append(part)
                    if k + 1 == len(parts) or self.segment and sum(n for _, n in own) >= self.split:
                        pieces.append(Segments(path, sample, contig, first, own, self.segment, k + 1 == len(parts)))
                        own, first = [], (k + 1) * (self.segment or 0)
        return pieces

    def read(self, partition: Segments | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        schema = pa.schema([("sample", pa.string()), ("contig", pa.string()), ("pos", pa.int64()), ("value", pa.int64())])
        first = partition.first
        with self.store.open_input_file(partition.path) as file:
            for k, (offset, size) in enumerate(partition.parts, 1):
                file.seek(offset)
                rest, begin = b"", first
                for at in range(0, size, STEP):
                    values, rest = unpack(rest + file.read(min(STEP, size - at)))
                    if len(values):
                        yield positions(schema, [partition.sample, partition.contig], first, values)
                    first += len(values)
                whole = partition.segment and not (partition.last and k == len(partition.parts))
                if rest or whole and first - begin != partition.segment:
                    raise ValueError(f"a segment of {partition.contig} is broken, or not of {partition.segment} numbers")


@dataclass
class Finished(WriterCommitMessage):
    files: list[tuple[str, str]]


class NumbersWriter(DataSourceArrowWriter):
    """Rows (contig, chunk, numbers, bytes of all the contig's segments), each contig whole and in order of its chunks."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.sample, self.arguments = options.get("sample", ""), options.get("arguments", "")

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        store, root = storage(self.path)
        return store, root, f"{root.rstrip('/')}/_temporary-{self.job}"

    def head(self, contig: str, size: int) -> bytes:
        """All that stands before a contig's first segment."""
        text = lambda number, value: one(number << 3 | 2) + one(len(value.encode())) + value.encode()
        name = text(CONTIG["name"], contig)
        outer = text(MESSAGE["sample"], self.sample) + text(MESSAGE["version"], VERSION) + text(MESSAGE["arguments"], self.arguments)
        return outer + one(MESSAGE["contig"] << 3 | 2) + one(len(name) + size) + name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Finished:
        store, _, folder = self._places()
        task = TaskContext.get()
        attempt = task.taskAttemptId() if task else 0
        store.create_dir(folder, recursive=True)
        files, current, out = [], None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["contig"] != current:
                        if out:
                            out.close()
                        current = row["contig"]
                        files.append((f"{folder}/{attempt}-{len(files)}", f"{uuid.uuid5(uuid.NAMESPACE_URL, current).hex}-{self.job}.numbers"))
                        out = store.open_output_stream(files[-1][0])
                        out.write(self.head(current, row["total"]))
                    out.write(one(CONTIG["numbers"] << 3 | 2) + one(len(row["numbers"])) + row["numbers"])
        finally:
            if out:
                out.close()
        return Finished(files)

    def commit(self, messages: list[Finished | None]) -> None:
        store, root, folder = self._places()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.path.endswith(".numbers"):
                    store.delete_file(f.path)
        for m in filter(None, messages):
            for path, name in m.files:
                store.move(path, f"{root.rstrip('/')}/{name}")
        self.abort([])

    def abort(self, messages: list[Finished | None]) -> None:
        store, _, folder = self._places()
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class NumbersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "position_numbers"

    def schema(self) -> str:
        return "sample string, contig string, pos long, value long"

    def reader(self, schema: T.StructType) -> NumbersReader:
        return NumbersReader(self.options["path"], int(self.options["segment"]) if "segment" in self.options else None, int(self.options.get("splitBytes", PIECE)))

    def writer(self, schema: T.StructType, overwrite: bool) -> NumbersWriter:
        return NumbersWriter(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, segment: int | None = CHUNK, split: int = PIECE) -> DataFrame:
    """(sample, contig, pos, value) of files; `segment` None for files of others, whose contigs are read one by one."""
    spark.dataSource.register(NumbersSource)
    options = {"splitBytes": str(split)} | ({} if segment is None else {"segment": str(segment)})
    return spark.read.format("position_numbers").options(**options).load(path)


def write(chunks: DataFrame, path: str, sample: str = "", arguments: str = "", mode: str = "overwrite") -> None:
    """Write packed rows, a file for each contig; its chunks pass through one task as a stream, in their order."""
    chunks.sparkSession.dataSource.register(NumbersSource)
    size = F.octet_length("numbers").cast("long")
    # the segment's own field: one byte of number, and its size in base 128
    framed = size + 2 + sum(((size >= 1 << 7 * k).cast("long") for k in range(1, 5)), F.lit(0).cast("long"))
    totals = chunks.groupBy("contig").agg(F.sum(framed).alias("total"))
    ordered = chunks.join(totals, "contig").select("contig", "chunk", "numbers", "total").repartition("contig").sortWithinPartitions("contig", "chunk")
    ordered.write.format("position_numbers").mode(mode).options(sample=sample, arguments=arguments).save(path)
