"""A streaming source that follows growing log files and gives their complete entries.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("path", folder).load()   # file, start (byte), header, text

A line that fits ``header`` opens an entry, which goes on to the next such line; the last entry of a file is given once
another follows it.  With a folder ``memory``, it is also given once the file has not changed for ``idle`` seconds, with
its unfinished last line; how far such files were given is kept in that folder, since an offset is asked for without the
one before.  Lines before the first header, or after an entry given that way, are an entry without one.  Bytes that are
no UTF-8 are replaced.

The offset of a file is how far it has been given, with the length and checksum of its first bytes as its identity: a
file that is shorter than that, or begins otherwise, has been started anew and is read from its beginning.  What was
cut off before it was given is lost, as it is for any reader.  Files are reached through pyarrow's file systems, so any
folder that driver and executors share will do.  A range of over ``split`` bytes is several tasks: each gives the
entries that begin in its part.  Short ranges share a task, up to ``split`` bytes and ``FILES`` of them, and the driver
looks at several files at a time.
"""

from __future__ import annotations

import io
import json
import re
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgerline.workers import carried

carried(__name__)

HEADER = r"\[(?:UnityCrossThreadLogger|Client GRE)\]"
#: Bytes at the start of a file that tell it from others, of a block that is searched for headers, and of a task.
HEAD, BLOCK, SPLIT = 256, 1 << 16, 1 << 26
#: Ranges that share a task at most, and files that the driver looks at at a time.
FILES, THREADS = 256, 16


class Range:
    """Entries of a file that begin from ``low`` (there one begins, if ``first``) to ``high``; nothing is read from ``end`` on."""

    def __init__(self, file: str, low: int, high: int, end: int, first: bool, head: list[int]):
        self.file, self.low, self.high, self.end, self.first, self.head = file, low, high, end, first, head


class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def write_logs(rows: DataFrame, path: str, log: str, order: str, value: str, name: str) -> None:
    """A file ``name`` in a folder log=.. for each log, of its rows' values as lines in their order; a file is there once it is whole.

    A writer that moves each file from a task's folder to a job's and on to its place would take most of the time of short logs.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        own, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                system.move(f"{folder}/{own}/{name}.part", f"{folder}/{own}/{name}")

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = f"log={'__HIVE_DEFAULT_PARTITION__' if key is None else key}"
                if now != own:
                    close()
                    own, n = now, n + 1
                    system.create_dir(f"{folder}/{own}", recursive=True)
                    out = system.open_output_stream(f"{folder}/{own}/{name}.part")
                out.write((line or "").encode() + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt = rows.repartition(log).sortWithinPartitions(log, order).select(log, value)
    dealt.mapInArrow(run, "n long").write.format("noop").mode("append").save()


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, start long, header string, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return TailReader(self.options)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".log")
        self.header = re.compile(options.get("header", HEADER).encode())
        self.memory, self.split = options.get("memory"), int(options.get("split", SPLIT))
        self.idle = float(options.get("idle", 60)) if self.memory else float("inf")

    # ---- files

    def files(self):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return system, [f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)]

    @staticmethod
    def each(look, items: list) -> list:
        """look(item) of all items, several at a time."""
        if len(items) < 2:
            return [look(x) for x in items]
        with ThreadPoolExecutor(THREADS) as pool:
            return list(pool.map(look, items))

    @staticmethod
    def bytes_of(f, low: int, high: int) -> bytes:
        f.seek(low)
        return f.read(max(0, high - low))

    def complete(self, f, size: int) -> int:
        """Where the last entry of an open file begins."""
        last = re.compile(rb"(?:^|(?<=\n))" + self.header.pattern)
        high, rest = size, b""
        while high > 0:
            low = max(0, high - BLOCK)
            # One byte more tells whether a line begins at the block; what was read before lets headers lie across blocks.
            block = self.bytes_of(f, max(0, low - 1), high) + rest[: 1 << 12]
            shift = max(0, low - 1)
            places = [shift + m.start() for m in last.finditer(block) if shift + m.start() >= low and (shift + m.start() == 0 or m.start() > 0)]
            if places:
                return places[-1]
            high, rest = low, block[low - shift :]
        return 0

    def head(self, f, size: int) -> list[int]:
        n = min(HEAD, size)
        return [n, zlib.crc32(self.bytes_of(f, 0, n))]

    # ---- offsets

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, infos = self.files()

        def look(info) -> dict:
            quiet = info.mtime_ns is not None and time.time() - info.mtime_ns / 1e9 >= self.idle
            with system.open_input_file(info.path) as f:
                return {"at": info.size if quiet else self.complete(f, info.size), "quiet": quiet, "size": info.size, "head": self.head(f, info.size)}

        return dict(zip((f.path for f in infos), self.each(look, infos), strict=True))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        marks = self.marks()

        def given(item: tuple[str, dict]) -> int:
            file, now = item
            low = 0
            for was in filter(None, (start.get(file), marks.get(file))):
                # The same file, if it begins with the bytes that it began with and is no shorter than what was given.
                if was["at"] > low and now["size"] >= max(was["at"], was["head"][0]) and self.begins_with(system, file, was["head"]):
                    low = was["at"]
            return low

        items = sorted(end.items())
        tasks, held, total = [], [], 0
        for (file, now), low in zip(items, self.each(given, items), strict=True):
            for at in range(low, now["at"], self.split):
                one = Range(file, at, min(at + self.split, now["at"]), now["at"], at == low, now["head"])
                if held and (total + one.high - one.low > self.split or len(held) == FILES):
                    tasks.append(Ranges(held))
                    held, total = [], 0
                held.append(one)
                total += one.high - one.low
        return [*tasks, Ranges(held)] if held else tasks

    def commit(self, end: dict) -> None:
        """Remember how far quiet files were given: called with every batch's end before the next batch is planned."""
        quiet = {file: {"at": now["at"], "head": now["head"]} for file, now in end.items() if now["quiet"]}
        if self.memory and quiet:
            from pyarrow import fs

            system, folder = fs.FileSystem.from_uri(self.memory)
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/marks.new") as f:
                f.write(json.dumps(self.marks() | quiet).encode())
            system.move(f"{folder}/marks.new", f"{folder}/marks")

    def marks(self) -> dict:
        from pyarrow import fs

        if not self.memory:
            return {}
        system, folder = fs.FileSystem.from_uri(self.memory)
        if system.get_file_info(f"{folder}/marks").type == fs.FileType.NotFound:
            return {}
        with system.open_input_file(f"{folder}/marks") as f:
            return json.loads(f.read())

    def begins_with(self, system, file: str, head: list[int]) -> bool:
        try:
            with system.open_input_file(file) as f:
                return zlib.crc32(self.bytes_of(f, 0, head[0])) == head[1]
        except OSError:
            return False

    # ---- rows

    def read(self, partition: Ranges) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for one in partition.ranges:
            yield from self.entries(system, one)

    def entries(self, system, partition: Range) -> Iterator[tuple]:
        if not self.begins_with(system, partition.file, partition.head):
            return  # started anew since the offset was taken
        with system.open_input_file(partition.file) as raw:
            at = partition.low
            raw.seek(max(0, at - 1))
            lines = io.BufferedReader(raw, 1 << 20)
            if at and lines.read(1) != b"\n" and not partition.first:
                at += len(lines.readline())
            start, held, opened = at, [], partition.first
            while at < partition.end:
                line = lines.readline(partition.end - at)
                if not line:
                    break
                if self.header.match(line):
                    if opened and held:
                        yield self.entry(partition.file, start, held)
                    if at >= partition.high:
                        return
                    start, held, opened = at, [], True
                if opened:
                    held.append(line)
                at += len(line)
            if opened and held:
                yield self.entry(partition.file, start, held)

    def entry(self, file: str, start: int, lines: list[bytes]) -> tuple:
        texts = [x.decode("utf-8", errors="replace").rstrip("\n").removesuffix("\r") for x in lines]
        header = texts[0] if self.header.match(lines[0]) else None
        return file, start, header, "\n".join(texts[header is not None :])

    def stop(self) -> None:
        pass
