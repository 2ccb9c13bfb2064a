"""A Spark data source for text files that keep their own names: read in splits, written one file a name.

spark.read.format("named_texts") gives name, record_ix, value. With the option recordStart records begin at lines that
begin with it, and files are read in splits; without it a file is one record. Many small files are read by one task.
df.write.format("named_texts") takes name and value, the lines of each name together in one partition and in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "named_texts"
SPLIT_BYTES = 64 << 20
#: Bytes that one task reads of small files, what opening a file counts as, and files that a commit places at once.
PACK_BYTES, OPEN_BYTES, MOVES = 16 << 20, 16 << 10, 16
STAGING = "_staging"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or a URI that Arrow knows, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _files(path: str) -> list[fs.FileInfo]:
    store, root = _store(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [found]
    return sorted((f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File), key=lambda f: f.path)


@dataclass
class Split(InputPartition):
    """Pieces (name, start, end) of files in a folder, numbered from nth; several only where they are small."""

    nth: int
    folder: str
    pieces: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.mark = options["path"], options.get("recordstart", "")
        self.size = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        out: list[Split] = []
        room = 0
        for n, (folder, piece) in enumerate(self._pieces()):
            cost = piece[2] - piece[1] + OPEN_BYTES
            if not out or cost > room:
                out.append(Split(n, folder, []))
                room = min(self.size, PACK_BYTES)
            out[-1].pieces.append(piece)
            room -= cost
        return out

    def _pieces(self) -> Iterator[tuple[str, tuple[str, int, int]]]:
        for f in _files(self.path):
            folder, _, name = f.path.rpartition("/")
            for start in range(0, max(f.size, 1), self.size) if self.mark else (0,):
                yield folder, (name, start, min(start + self.size, f.size) if self.mark else f.size)

    def read(self, split: Split) -> Iterator[tuple[str, int, str]]:
        store, _ = _store(self.path)
        for n, piece in enumerate(split.pieces, split.nth):
            yield from self._records(store, split.folder, *piece, n << 33)

    def _records(self, store: fs.FileSystem, folder: str, name: str, begin: int, end: int, first: int) -> Iterator[tuple[str, int, str]]:
        """The records that begin in the piece; the last one is read to its end, wherever that is."""
        mark = self.mark.encode()
        with store.open_input_file(f"{folder}/{name}") as file:
            if not mark:
                yield name, first, file.read().decode()
                return
            at = max(begin - 1, 0)
            file.seek(at)
            lines = _lines(file)
            if begin:
                at += len(next(lines, b""))  # what is left of a line that began in the split before
            held: list[bytes] = []
            for line in lines:
                if line.startswith(mark):
                    if held:
                        yield name, first, b"".join(held).decode()
                        first += 1
                    held = []
                    if at >= end:
                        return
                    held = [line]
                elif held or begin == 0:  # before the first mark only the file's own beginning counts
                    held.append(line)
                elif at >= end:
                    return
                at += len(line)
            if held:
                yield name, first, b"".join(held).decode()


def _lines(file, block: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while data := file.read(block):
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for line in parts:
            yield line + b"\n"
    if rest:
        yield rest


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Tasks write below a staging folder of the job; only its commit gives files their names, so a task that fails or
    runs twice leaves none."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        folder, names, sink, now = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", [], None, None
        seen: set[str] = set()
        try:
            for batch in iterator:
                lines = zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True)
                for name, own in groupby(lines, lambda line: line[0]):
                    if sink is None or name != now:
                        if sink is not None:
                            sink.close()
                        now = name
                        if not now or now in (".", "..", STAGING) or "/" in now or "\\" in now:
                            raise ValueError(f"{now!r} can't be a file's name")
                        if now in seen:
                            raise ValueError(f"the lines of {now!r} don't stand together")
                        if not names:
                            store.create_dir(folder)
                        seen.add(now)
                        names.append(now)
                        sink = store.open_output_stream(f"{folder}/{now}")
                    sink.write("".join(f"{value or ''}\n" for _, value in own).encode())
        finally:
            if sink is not None:
                sink.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        placed = [(m.folder, name) for m in messages if m for name in m.names]
        names = {name for _, name in placed}
        if len(names) < len(placed):
            self.abort(messages)
            raise ValueError("lines of one name are in several partitions")
        store.create_dir(root)
        if not self.overwrite:
            there = {f.path.rpartition("/")[2] for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
            if there & names:
                self.abort(messages)
                raise ValueError(f"{len(there & names)} of the names are taken; write with mode overwrite")
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda p: store.move(f"{p[0]}/{p[1]}", f"{root}/{p[1]}"), placed):
                pass
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        job = f"{root}/{STAGING}/{self.job}"
        if store.get_file_info(job).type == fs.FileType.Directory:
            store.delete_dir(job)
        if store.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            store.delete_dir(f"{root}/{STAGING}")


class NamedTexts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, record_ix long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def read(spark: SparkSession, path: str, record_start: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """name, record_ix (rising along files in order of their names), value of the files in path."""
    spark.dataSource.register(NamedTexts)
    return spark.read.format(FORMAT).option("recordStart", record_start).option("splitBytes", split_bytes).load(path)


def write(lines: DataFrame, path: str, order: str, overwrite: bool = False) -> None:
    """Write the lines (name, value) of each name, in the order of a column, as one file of that name in path.

    Without overwrite a name that is taken refuses the whole write; with it such files are replaced, others stay.
    """
    lines.sparkSession.dataSource.register(NamedTexts)
    dealt = lines.repartition(F.col("name")).sortWithinPartitions("name", order).select("name", "value")
    dealt.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)
