"""Writing byte streams whose order is known by offset, from many tasks at once."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tokenloom.sources.files import resolve

# written at once at most, and the size from which a part ends
BUFFER_BYTES = 8 << 20
PART_BYTES = 256 << 20
OPEN_FILES = 64
COMMIT_THREADS = 32


class PositionedWriter(DataSourceArrowWriter):
    """Rows ``(file, offset, data)`` -> files in which ``data`` stands at ``offset``.

    ``layout=parts`` a folder per name holding ``part-<first offset>`` files,
                     whose concatenation in name order is the stream; a name
                     without bytes holds one empty part. Any store. Rows must be
                     range-partitioned and sorted by offset.
    ``layout=file``  one file per name: tasks write at their offsets into one
                     hidden file, renamed at commit if its size is the sum of
                     what the tasks wrote. A repeated attempt writes the same
                     bytes to the same place. Needs a POSIX file system that
                     all executors share.
    """

    def __init__(self, options, overwrite):
        self.root = options["path"]
        self.layout = options.get("layout", "parts")
        self.append = options.get("append", "false") == "true"
        if self.layout not in ("file", "parts"):
            raise ValueError("layout is 'file' or 'parts'")
        if self.append and self.layout == "file":
            raise ValueError("only layout 'parts' can be appended to")
        self.temp = f"{self.root}/_temporary-{uuid.uuid4().hex}"
        filesystem, temp = resolve(self.temp)
        if self.layout == "file" and not isinstance(filesystem, pafs.LocalFileSystem):
            raise ValueError("layout 'file' needs a mounted file system; use layout 'parts'")
        filesystem.create_dir(temp, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        _, temp = resolve(self.temp)
        emit = self._write_at if self.layout == "file" else self._write_part
        self.open_files: OrderedDict[str, int] = OrderedDict()
        self.part = None
        attempt = str(TaskContext.get().taskAttemptId())
        # per name: first offset -> bytes of every part (of every run, in one file)
        made: dict[str, dict[int, int]] = {}
        run_file, run_at, run = None, 0, bytearray()

        for rows in iterator:
            names = rows.column("file").to_pylist()
            offsets = rows.column("offset").to_pylist()
            for name, at, data in zip(names, offsets, rows.column("data")):
                data = data.as_buffer()
                if name != run_file or at != run_at + len(run) or len(run) >= BUFFER_BYTES:
                    if run_file is not None:
                        emit(temp, attempt, run_file, run_at, run, made)
                    run_file, run_at, run = name, at, bytearray()
                run += data
        if run_file is not None:
            emit(temp, attempt, run_file, run_at, run, made)
        self._close_part()
        while self.open_files:
            self._close_oldest()
        message = WriterCommitMessage()
        message.made = made
        message.attempt = attempt
        return message

    def _write_at(self, temp, attempt, name, at, run, made):
        runs = made.setdefault(name, {})
        if run:
            runs[at] = len(run)
        fd = self.open_files.pop(name, None)
        if fd is None:
            if len(self.open_files) >= OPEN_FILES:
                self._close_oldest()
            fd = os.open(os.path.join(temp, name), os.O_CREAT | os.O_WRONLY, 0o644)
        self.open_files[name] = fd
        view = memoryview(run)
        while view:
            n = os.pwrite(fd, view, at)
            at, view = at + n, view[n:]

    def _close_oldest(self):
        _, fd = self.open_files.popitem(last=False)
        os.fsync(fd)
        os.close(fd)

    def _write_part(self, temp, attempt, name, at, run, made):
        parts = made.setdefault(name, {})
        if not run:
            return
        # a part goes on while rows follow each other, up to its size
        if self.part is None or self.part[0] != name or self.part[1] + parts[self.part[1]] != at or parts[self.part[1]] >= PART_BYTES:
            self._close_part()
            filesystem, _ = resolve(self.temp)
            filesystem.create_dir(f"{temp}/{attempt}/{name}", recursive=True)
            self.part = (name, at, filesystem.open_output_stream(f"{temp}/{attempt}/{name}/part-{at:020d}"))
            parts[at] = 0
        self.part[2].write(run)
        parts[self.part[1]] += len(run)

    def _close_part(self):
        if self.part is not None:
            self.part[2].close()
            self.part = None

    def commit(self, messages):
        filesystem, root = resolve(self.root)
        _, temp = resolve(self.temp)
        messages = [m for m in messages if m]
        total: dict[str, int] = {}
        for m in messages:
            for name, parts in m.made.items():
                total[name] = total.get(name, 0) + sum(parts.values())
        if self.layout == "file":
            for name, size in total.items():
                found = filesystem.get_file_info(f"{temp}/{name}").size
                if found != size:
                    raise OSError(f"{name}: the tasks wrote {size} bytes, the file has {found}; is the folder shared?")

        def place(name):
            info = filesystem.get_file_info(f"{root}/{name}")
            if self.append and info.type == pafs.FileType.Directory:
                # what an earlier attempt of the same rows, or of later ones, left from here on
                first = min((at for m in messages for at in m.made.get(name, ())), default=None)
                for part in filesystem.get_file_info(pafs.FileSelector(info.path)) if first is not None else ():
                    if int(part.base_name.removeprefix("part-")) >= first:
                        filesystem.delete_file(part.path)
                return
            if info.type == pafs.FileType.Directory:
                filesystem.delete_dir(info.path)
            if self.layout == "file":
                filesystem.move(f"{temp}/{name}", f"{root}/{name}")
                return
            if info.type == pafs.FileType.File:
                filesystem.delete_file(info.path)
            filesystem.create_dir(f"{root}/{name}")
            if not total[name]:
                filesystem.open_output_stream(f"{root}/{name}/part-{0:020d}").close()

        def move(item):
            attempt, name, at = item
            filesystem.move(f"{temp}/{attempt}/{name}/part-{at:020d}", f"{root}/{name}/part-{at:020d}")

        with ThreadPoolExecutor(COMMIT_THREADS) as pool:
            list(pool.map(place, total))
            if self.layout == "parts":
                list(pool.map(move, [(m.attempt, n, at) for m in messages for n, parts in m.made.items() for at in parts]))
        filesystem.delete_dir(temp)

    def abort(self, messages):
        filesystem, temp = resolve(self.temp)
        if filesystem.get_file_info(temp).type == pafs.FileType.Directory:
            filesystem.delete_dir(temp)


class PositionedSink(DataSource):
    @classmethod
    def name(cls):
        return "positioned_bytes"

    def writer(self, schema, overwrite):
        return PositionedWriter(self.options, overwrite)


def write_positioned(df: DataFrame, path: str, layout: str = "parts", append: bool = False) -> None:
    """Write ``(file string, offset bigint, data binary)``; names already there are replaced.

    With ``append`` (layout ``parts``) a name keeps what stands before the first offset written now;
    parts from there on are replaced, so a repeated write adds nothing.
    """
    df = df.select(
        F.col("file").cast("string").alias("file"), F.col("offset").cast("long").alias("offset"), "data"
    )
    if layout == "parts":
        df = df.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    df.write.format("positioned_bytes").mode("append").option("layout", layout).option("append", str(append).lower()).save(path)
