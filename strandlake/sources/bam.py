"""Binary alignments as a Spark data source: `spark.read.format("bam")` and `reads.write.format("bam")`.

Reading: a path is a file or a folder of `.bam` files. A file with an index beside it (path + ".bai")
is read in parallel: the index names places where records begin, and a partition goes from one of
them to another, about `splitBytes` apart. Filters on contig, start and ref_end are pushed into the
scan: only the blocks that the index names for that range are read; rows are still tested by Spark.
A file without an index is one partition. Option `places` adds the columns of `PLACES`.

Writing: every task writes a file of its own below a temporary folder of the job; the commit moves
them to the target, and an abort removes them. `write_sorted` deals records by range, so that every
file holds one stretch in coordinate order; `write_indexes` then makes the files' indexes.

Records are coded a batch at a time (`bam_records`). An index is made in one scan, which reads what it
needs of each record and gives a few rows a file (`write_indexes`).

Paths are opened through Arrow's file systems, so that they may lie in any store these know.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .bam_records import (  # noqa: F401
    _STEP,
    FIRST_BINS,
    LETTERS,
    OPERATORS,
    WINDOW_BITS,
    Heads,
    IndexParts,
    decoded_batch,
    encoded_batch,
)
from .readers import READS

# Fixed values of the format.
SUMMARY_BIN = 37450
SPLIT_BYTES = 64 << 20

#: Uncompressed bytes of a block, and the block that ends every file.
BLOCK_BYTES = 65280
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Uncompressed bytes that are decoded at once, or one record if that is longer.
BATCH_BYTES = 1 << 20

#: Further columns of the reader: the last position covered, and where the record begins and the next one does.
PLACES = T.StructType([T.StructField("ref_end", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("place", T.LongType()), T.StructField("next_place", T.LongType())])


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    if re.match(r"file:/(?!/)", path):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Records of a file from one virtual place (block << 16 | byte in it) up to another."""

    path: str
    begin: int
    end: int | None


class Blocks:
    """Decompressed bytes of a blocked gzip file from a virtual place on."""

    def __init__(self, file, place: int):
        self.file, self.block, self.at = file, place >> 16, place & 0xFFFF
        self.data, self.next = b"", self.block
        self._load()

    def _load(self) -> bool:
        self.block = self.next
        self.file.seek(self.block)
        head = self.file.read(12)
        if len(head) < 12:
            self.data = b""
            return False
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        size, k = None, 0
        while k + 4 <= len(extra):
            name, n = extra[k : k + 2], struct.unpack_from("<H", extra, k + 2)[0]
            if name == b"BC":
                size = struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        if size is None:
            raise ValueError("not a blocked gzip file")
        body = self.file.read(size - 12 - len(extra))
        self.data, self.next = zlib.decompress(body[:-8], -15), self.block + size
        return True

    def place(self) -> int | None:
        """Virtual place of the next byte; None at the end of the file."""
        while self.at >= len(self.data):
            self.at -= len(self.data)
            if not self._load():
                return None
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.place() is None:
                raise EOFError("the file ends inside a record")
            part = self.data[self.at : self.at + n]
            parts.append(part)
            self.at += len(part)
            n -= len(part)
        return b"".join(parts)


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """(contig, length) in file order; leaves `blocks` at the first record."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    contigs = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return contigs


@dataclass
class ContigIndex:
    """Chunks (begin, end) of virtual places by bin, least places by window, and counts, of one contig."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    windows: list[int] = field(default_factory=list)
    #: (begin, end, mapped, unmapped), where the file has them.
    summary: tuple[int, int, int, int] | None = None

    def chunks(self, first: int, last: int) -> list[tuple[int, int]]:
        """Chunks that may hold records over [first, last], merged where they touch or share a block."""
        window = first >> WINDOW_BITS
        if window >= len(self.windows):
            return []
        low = next((p for p in reversed(self.windows[: window + 1]) if p), 0)
        found = sorted((max(b, low), e) for k in bins_over(first, last) for b, e in self.bins.get(k, ()) if e > low)
        merged: list[tuple[int, int]] = []
        for b, e in found:
            if merged and b >> 16 <= merged[-1][1] >> 16:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((b, e))
        return merged


def bins_over(first: int, last: int) -> list[int]:
    """Bins that may hold records over [first, last]."""
    return [0] + [start + k for bits, start in FIRST_BINS for k in range(first >> bits, (last >> bits) + 1)]


def read_index(data: bytes, name: str = "") -> tuple[list[ContigIndex], int]:
    """The contigs' indexes, and the number of records without a place."""
    if data[:4] != b"BAI\1":
        raise ValueError(f"{name} is not an index")
    at, contigs = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        own, bins = ContigIndex(), struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            values = struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)
            at += 8 + 16 * chunks
            if number == SUMMARY_BIN:
                own.summary = values
            else:
                own.bins[number] = list(zip(values[::2], values[1::2], strict=True))
        windows = struct.unpack_from("<i", data, at)[0]
        own.windows = list(struct.unpack_from(f"<{windows}Q", data, at + 4))
        at += 4 + 8 * windows
        contigs.append(own)
    return contigs, struct.unpack_from("<Q", data, at)[0] if at + 8 <= len(data) else 0


def index_bytes(contigs: list[ContigIndex], without_place: int) -> bytes:
    parts = [b"BAI\1", struct.pack("<i", len(contigs))]
    for own in contigs:
        parts.append(struct.pack("<i", len(own.bins) + (own.summary is not None)))
        for number, chunks in sorted(own.bins.items()):
            parts.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *(p for c in chunks for p in c)))
        if own.summary is not None:
            parts.append(struct.pack("<Ii4Q", SUMMARY_BIN, 2, *own.summary))
        parts.append(struct.pack(f"<i{len(own.windows)}Q", len(own.windows), *own.windows))
    return b"".join([*parts, struct.pack("<Q", without_place)])


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int, places: bool = False, parts: bool = False):
        self.split, self.places, self.parts = split, places, parts
        self.contigs: set[str] | None = None
        self.first, self.last = 0, (1 << 29) - 1
        self.store, root = storage(path)
        self.files = sorted(f.path for f in self.store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".bam")) if self.store.get_file_info(root).type == fs.FileType.Directory else [root]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Narrow the range by filters on contig, start and ref_end; all are given back, since blocks hold other rows too."""
        for f in filters:
            name, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            if name == "contig" and isinstance(f, (EqualTo, In)):
                own = {value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = own if self.contigs is None else self.contigs & own
            elif name in ("start", "ref_end") and value is not None:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    # a record that ends by then begins by then
                    self.last = min(self.last, value)
            yield f

    def _narrowed(self) -> bool:
        return self.contigs is not None or self.first > 0 or self.last < (1 << 29) - 1

    def _fitting(self, r: Heads, contigs: list[str]) -> np.ndarray:
        """Records that the pushed filters may keep; the others' texts and tags need not be decoded."""
        fits = np.ones(len(r.begin), bool)
        if self.contigs is not None:
            wanted = [k for k, name in enumerate(contigs) if name in self.contigs]
            fits &= np.isin(r.contig, wanted) | ((r.contig < 0) & ("*" in self.contigs))
        if self.first > 0:
            fits &= r.last >= self.first
        return fits & (r.start <= self.last) if self.last < (1 << 29) - 1 else fits

    def _indexed(self, path: str) -> tuple[list[ContigIndex], int] | None:
        if self.store.get_file_info(path + ".bai").type != fs.FileType.File:
            return None
        with self.store.open_input_file(path + ".bai") as file:
            return read_index(file.read(), path)

    def partitions(self) -> list[Piece]:
        pieces = []
        narrowed = self._narrowed()
        for path in self.files:
            with self.store.open_input_file(path) as file:
                blocks = Blocks(file, 0)
                names = [name for name, _ in header(blocks)]
                begin = blocks.place()
            if begin is None:
                continue
            found = self._indexed(path)
            if found is None:
                pieces.append(Piece(path, begin, None))
                continue
            known = sorted({p for c in found[0] for chunks in c.bins.values() for b, _ in chunks for p in (b,)} | {w for c in found[0] for w in c.windows if w})
            stretches: list[tuple[int, int | None]] = [(begin, None)]
            if narrowed:
                chosen = [c for name, c in zip(names, found[0], strict=False) if self.contigs is None or name in self.contigs]
                stretches = [s for c in chosen for s in c.chunks(max(self.first, 0), self.last)] if self.last >= 0 else []
                if self.contigs is None or "*" in self.contigs:  # records without a contig are behind all others
                    stretches.append((max([begin, *(e for c in found[0] for chunks in c.bins.values() for _, e in chunks)]), None))
            for low, high in stretches:
                begins = [low]
                for place in known:
                    if low < place and (high is None or place < high) and (place >> 16) - (begins[-1] >> 16) >= self.split:
                        begins.append(place)
                pieces += [Piece(path, a, z) for a, z in zip(begins, [*begins[1:], high], strict=True)]
        return pieces

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's call where there are no partitions
            return
        schema = arrow_schema(self.places)
        with self.store.open_input_file(partition.path) as file:
            contigs = [name for name, _ in header(Blocks(file, 0))]
            found = IndexParts()
            for data, begins, place, after in batches(Blocks(file, partition.begin), partition.end):
                if self.parts:
                    found.add(Heads(data, begins), place, after)
                    continue
                fits = self._fitting(Heads(data, begins), contigs) if self._narrowed() else np.ones(len(begins), bool)
                if not fits.any():
                    continue
                place, after = place[fits], after[fits]
                columns, last = decoded_batch(data, begins[fits], contigs)
                if self.places:
                    columns += [pa.array(last.astype(np.int32)), pa.array([partition.path]).take(pa.array(np.zeros(len(place), np.int8))), pa.array(place), pa.array(after)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            if self.parts and (rows := found.rows(partition.path, contigs)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), INDEX_SCHEMA, strict=True)], schema=INDEX_SCHEMA)


def batches(blocks: Blocks, stop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Records that begin before `stop`: bytes, where records begin in them, their virtual places, and those behind them."""
    held, at = bytearray(blocks.data), blocks.at
    marks, over = [(0, blocks.block)], not blocks.data
    while True:
        loaded = False
        while not over and (not loaded or (len(held) - at < BATCH_BYTES and (stop is None or blocks.next << 16 < stop))):
            loaded, over = True, not blocks._load()
            if blocks.data:
                marks.append((len(held), blocks.block))
                held += blocks.data
        begins, size = [], len(held)
        while at + 4 <= size:
            following = at + 4 + struct.unpack_from("<i", held, at)[0]
            if following < at + 36:
                raise ValueError("a record is shorter than its fixed part")
            # the place behind a record is known once the block that follows is
            if following > size or (following == size and not over):
                break
            begins.append(at)
            at = following
        at_mark, address = (np.array(c, np.int64) for c in zip(*marks, strict=True))

        def places(where: np.ndarray) -> np.ndarray:
            k = np.searchsorted(at_mark, where, side="right") - 1
            return np.where(where < size, address[k] << 16 | (where - at_mark[k]), blocks.block << 16)  # noqa: B023

        done = over
        if begins:
            begin = np.array(begins, np.int64)
            place, after = places(begin), places(np.append(begin[1:], at))
            n = len(begin) if stop is None else int(np.searchsorted(place, stop))
            done = over or (stop is not None and int(after[-1]) >= stop)
            if n:
                yield np.frombuffer(bytes(held), np.uint8), begin[:n], place[:n], after[:n]
        elif stop is not None and at < size and int(places(np.array([at]))[0]) >= stop:
            return
        if done:
            if over and at < size and (stop is None or int(places(np.array([at]))[0]) < stop):
                raise EOFError("the file ends inside a record")
            return
        kept = int(np.searchsorted(at_mark, at, side="right")) - 1
        marks = [(o - int(at_mark[kept]), a) for o, a in marks[kept:]]
        held, at = held[int(at_mark[kept]) :], at - int(at_mark[kept])


def arrow_schema(places: bool) -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in READS.fields + (PLACES.fields if places else [])])


# ---- writing

def block(data: bytes, level: int = 6) -> bytes:
    """One block of a blocked gzip file."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_bytes(contigs: list[tuple[str, int]], order: str, lines: str = "") -> bytes:
    text = f"@HD\tVN:1.6\tSO:{order}\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs) + lines
    names = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    return b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(contigs)) + names


@dataclass
class Written(WriterCommitMessage):
    """A finished file of one task, and the name that the commit gives it."""

    path: str
    name: str
    records: int


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.contigs = [(n, int(size)) for n, size in json.loads(options["contigs"])]
        self.kinds = json.loads(options.get("tagTypes", "{}"))
        self.order, self.level = options.get("sortOrder", "unsorted"), int(options.get("level", 6))
        self.lines = options.get("headerLines", "")

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        store, root = storage(self.path)
        return store, root, f"{root.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, folder = self._places()
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        store.create_dir(folder, recursive=True)
        path, records = f"{folder}/{part:05d}-{attempt}", 0
        numbers = {name: k for k, (name, _) in enumerate(self.contigs)} | {"*": -1, None: -1}
        with store.open_output_stream(path) as file:
            pending = bytearray()

            def put(data: bytes) -> None:
                # a record goes to a block of its own rather than cross a block's end, unless it is longer than one
                if len(pending) + len(data) > BLOCK_BYTES:
                    flush()
                pending.extend(data)
                while len(pending) > BLOCK_BYTES:
                    file.write(block(bytes(pending[:BLOCK_BYTES]), self.level))
                    del pending[:BLOCK_BYTES]

            def flush() -> None:
                if pending:
                    file.write(block(bytes(pending), self.level))
                    pending.clear()

            put(header_bytes(self.contigs, self.order, self.lines))
            flush()
            for rows in iterator:
                data, sizes = encoded_batch(rows, numbers, self.kinds)
                ends, k, begin = np.cumsum(sizes), 0, 0
                while k < len(sizes):  # as many records at once as the block has room for, one at least
                    last = max(int(np.searchsorted(ends, begin + BLOCK_BYTES - len(pending), side="right")), k + 1)
                    put(data[begin : int(ends[last - 1])])
                    k, begin = last, int(ends[last - 1])
                records += len(sizes)
            flush()
            file.write(END_OF_FILE)
        return Written(path, f"part-{part:05d}-{self.job}.bam", records)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, folder = self._places()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File and f.path.endswith((".bam", ".bai")):
                    store.delete_file(f.path)
        for m in filter(None, messages):
            if m.records or len(messages) == 1:  # a task without records leaves no file, unless it is the only one
                store.move(m.path, f"{root.rstrip('/')}/{m.name}")
        self._clear(store, folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, folder = self._places()
        self._clear(store, folder)

    @staticmethod
    def _clear(store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def _places(self) -> bool:
        return self.options.get("places", "false").lower() == "true"

    def _parts(self) -> bool:
        return self.options.get("indexParts", "false").lower() == "true"

    def schema(self) -> T.StructType | str:
        return INDEX if self._parts() else T.StructType(READS.fields + (PLACES.fields if self._places() else []))

    def reader(self, schema: T.StructType) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), self._places(), self._parts())

    def writer(self, schema: T.StructType, overwrite: bool) -> BamWriter:
        missing = {f.name for f in READS.fields} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"reads lack the columns {sorted(missing)}")
        return BamWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    spark.dataSource.register(BaiSource)


def read(spark: SparkSession, path: str, places: bool = False, split: int = SPLIT_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("bam").option("places", str(places).lower()).option("splitBytes", split).load(path)


def write_sorted(reads: DataFrame, path: str, contigs: list[tuple[str, int]], tag_types: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Write reads in coordinate order, a range of it to each file; reads without a contig come last."""
    register(reads.sparkSession)
    number = F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _ in contigs]), F.col("contig")), F.lit(0))
    keyed = reads.select(*[f.name for f in READS.fields], F.when(number == 0, F.lit(len(contigs) + 1)).otherwise(number).alias("__number"))
    ranged = keyed.repartitionByRange("__number", "start", "qname", "flag").sortWithinPartitions("__number", "start", "qname", "flag").drop("__number")
    options = {"contigs": json.dumps(contigs), "sortOrder": "coordinate", "tagTypes": json.dumps(tag_types or {})}
    ranged.write.format("bam").mode(mode).options(**options).save(path)


# ---- indexes as rows

INDEX = "file string, contig string, kind string, bin int, begin long, end long"
INDEX_SCHEMA = pa.schema([("file", pa.string()), ("contig", pa.string()), ("kind", pa.string()), ("bin", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])


def index_parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of `INDEX` of the stretches of the files that one task reads each, from one scan.

    kind `chunk`: a bin and the places from `begin` to `end` that hold its records; chunks of one
    compressed block, or of blocks that follow each other, are one. `window`: number of a window and
    the least place of a record over it. `span`: least and last place of a contig; `count`: its
    mapped and unmapped records; records without a contig have a `count` of their own (begin 0).
    A file that is read in several stretches has rows of each; `contigs_from` puts them together.
    """
    register(spark)
    return spark.read.format("bam").option("indexParts", "true").load(path)


def contigs_from(rows: list[dict], names: list[str]) -> tuple[list[ContigIndex], int]:
    """Contigs' indexes of one file's rows of `INDEX`; windows without records have the place of the one before."""
    made, without = {n: ContigIndex() for n in names}, 0
    counts: dict[str, list[int]] = {}
    spans: dict[str, tuple[int, int]] = {}
    least: dict[tuple[str, int], int] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["bin"] or 0, r["begin"] or 0)):
        if r["contig"] == "*":
            without += r["end"]
        elif r["kind"] == "chunk":
            runs = made[r["contig"]].bins.setdefault(r["bin"], [])
            if runs and r["begin"] >> 16 <= runs[-1][1] >> 16:  # stretches that meet
                runs[-1] = (runs[-1][0], max(runs[-1][1], r["end"]))
            else:
                runs.append((r["begin"], r["end"]))
        elif r["kind"] == "window":
            least.setdefault((r["contig"], r["bin"]), r["begin"])
        elif r["kind"] == "count":
            own = counts.setdefault(r["contig"], [0, 0])
            own[0], own[1] = own[0] + r["begin"], own[1] + r["end"]
        else:
            a, z = spans.get(r["contig"], (r["begin"], r["end"]))
            spans[r["contig"]] = min(a, r["begin"]), max(z, r["end"])
    for (contig, number), begin in sorted(least.items()):
        windows = made[contig].windows
        windows.extend([windows[-1] if windows else 0] * (number - len(windows)) + [begin])
    for n, span in spans.items():
        made[n].summary = (*span, *counts[n])
    return [made[n] for n in names], without


def write_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Make the index of every file of `path` beside it; (file, bytes) of those written."""
    rows = index_parts(spark, path)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        store, _ = storage(path)
        with store.open_input_file(name) as file:
            names = [n for n, _ in header(Blocks(file, 0))]
        data = index_bytes(*contigs_from(table.to_pylist(), names))
        partial = f"{name}.bai-{uuid.uuid4().hex}"
        with store.open_output_stream(partial) as out:
            out.write(data)
        store.move(partial, f"{name}.bai")
        return pa.table({"file": [name], "bytes": pa.array([len(data)], pa.int64())})

    return rows.groupBy("file").applyInArrow(write, "file string, bytes long")


@dataclass
class IndexFile(InputPartition):
    path: str


class BaiReader(DataSourceReader):
    """Rows of `INDEX` of the indexes beside a path's files."""

    def __init__(self, path: str):
        self.files = BamReader(path, SPLIT_BYTES)

    def partitions(self) -> list[IndexFile]:
        return [IndexFile(f) for f in self.files.files]

    def read(self, partition: IndexFile | None) -> Iterator[tuple]:
        found = partition and self.files._indexed(partition.path)
        if not found:
            return
        with self.files.store.open_input_file(partition.path) as file:
            names = [n for n, _ in header(Blocks(file, 0))]
        for name, own in zip(names, found[0], strict=True):
            for number, chunks in own.bins.items():
                yield from ((partition.path, name, "chunk", number, b, e) for b, e in chunks)
            yield from ((partition.path, name, "window", k, p, None) for k, p in enumerate(own.windows))
            if own.summary is not None:
                yield partition.path, name, "span", None, own.summary[0], own.summary[1]
                yield partition.path, name, "count", None, own.summary[2], own.summary[3]
        if found[1]:
            yield partition.path, "*", "count", None, 0, found[1]


class BaiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bai"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: T.StructType) -> BaiReader:
        return BaiReader(self.options["path"])


def index_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(contig, aligned, unaligned) from the indexes alone."""
    register(spark)
    counts = spark.read.format("bai").load(path).where("kind = 'count'")
    return counts.groupBy("contig").agg(F.sum("begin").alias("aligned"), F.sum("end").alias("unaligned"))


def at_place(spark: SparkSession, path: str, contig: str, start: int, window: int = 0) -> DataFrame:
    """Reads that begin within `window` of a place; the index leads to their blocks."""
    return read(spark, path, places=True).where((F.col("contig") == contig) & F.col("start").between(start - window, start + window))


def over_range(spark: SparkSession, path: str, contig: str, first: int, last: int) -> DataFrame:
    """Reads of one contig over [first, last]; the index leads to their blocks."""
    return read(spark, path, places=True).where((F.col("contig") == contig) & (F.col("start") <= last) & (F.col("ref_end") >= first))
