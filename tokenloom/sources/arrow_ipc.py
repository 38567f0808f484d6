"""Arrow IPC corpus shards as a Spark source, and a shard writer.

Reading projects one text column. Large shards are read by several tasks, each
taking its share of the record batches, in either container format.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from tokenloom.sources.arrow_stream import Range, find_range, load_ranges, range_batches
from tokenloom.sources.files import SPLIT_BYTES, list_files, resolve

TEXT_TYPES = (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)


def _open(path: str):
    """(reader, is_file_format, source) for either container format."""
    filesystem, local = resolve(path)
    is_local = isinstance(filesystem, pafs.LocalFileSystem)
    source = pa.memory_map(local) if is_local else filesystem.open_input_file(local)
    head = source.read(6)
    source.seek(0)
    if head == b"ARROW1":
        return pa.ipc.open_file(source), True, source
    return pa.ipc.open_stream(source), False, source


def _column_type(schema: pa.Schema, column: str) -> pa.DataType:
    if column not in schema.names:
        raise ValueError(f"no column {column!r}; the shard has {schema.names}")
    kind = schema.field(column).type
    if not any(test(kind) for test in TEXT_TYPES):
        raise ValueError(f"column {column!r} is {kind}, not string or binary")
    return kind


@dataclass
class ShardSplit(InputPartition):
    shard: int
    path: str
    size: int
    part: int
    parts: int
    range: Range | None = None
    first: int = 0


class ArrowIpcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.column = options.get("column", "text")
        self.shards = int(options["shards"]) if "shards" in options else None
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.ranges = options.get("ranges")

    def files(self):
        # numbers decide the order, so 99999 comes before 100000
        found = sorted(list_files(self.path, ".arrow"), key=lambda f: (self.shard_number(f[0]) or 0, f[0]))
        if not found:
            raise FileNotFoundError(f"no .arrow shards in {self.path}")
        if self.shards is not None:
            if not 1 <= self.shards <= len(found):
                raise ValueError(f"shards must be 1..{len(found)}, got {self.shards}")
            found = found[: self.shards]
        return found

    @staticmethod
    def shard_number(path: str) -> int | None:
        """The number in ``…-<number>[-of-<total>].arrow``, a file or a folder of parts; None for other names."""
        m = re.search(r"-(\d+)(?:-of-\d+)?\.arrow(?:/part-\d+\.arrow)?$", path)
        return int(m[1]) if m else None

    @staticmethod
    def first_batch(path: str) -> int:
        """The batch that a part of a shard begins with; 0 for a whole shard."""
        m = re.search(r"\.arrow/part-(\d+)\.arrow$", path)
        return int(m[1]) if m else 0

    def partitions(self):
        splits = []
        known = load_ranges(self.ranges) if self.ranges else {}
        for place, (path, size) in enumerate(self.files()):
            number = self.shard_number(path)
            shard = place if number is None else number
            if path in known:
                indexed, ranges = known[path]
                if indexed != size:
                    raise ValueError(f"{path} has {size} bytes, its ranges were made at {indexed}")
                splits += [ShardSplit(shard, path, size, i, len(ranges), r, self.first_batch(path)) for i, r in enumerate(ranges)]
                continue
            parts = max(1, -(-size // self.split_bytes))
            splits += [ShardSplit(shard, path, size, part, parts, None, self.first_batch(path)) for part in range(parts)]
        return splits

    def read(self, split):
        reader, is_file, source = _open(split.path)
        kind = _column_type(reader.schema, self.column)
        target = pa.string() if pa.types.is_string(kind) or pa.types.is_large_string(kind) else pa.binary()
        for index, batch in self._batches(reader, is_file, source, split):
            n = batch.num_rows
            if n == 0:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([split.shard], pa.int64()).take(pa.array([0] * n, pa.int32())),
                    pa.array([split.first + index], pa.int64()).take(pa.array([0] * n, pa.int32())),
                    pa.array(range(n), pa.int64()),
                    batch.column(self.column).cast(target),
                ],
                ["shard", "batch_index", "row_in_batch", self.column],
            )

    def _batches(self, reader, is_file, source, split):
        if is_file:
            n = reader.num_record_batches
            for i in range(n * split.part // split.parts, n * (split.part + 1) // split.parts):
                yield i, reader.get_batch(i)
        elif split.parts == 1:
            yield from enumerate(reader)
        else:
            lo, hi = (split.size * p // split.parts for p in (split.part, split.part + 1))
            own = split.range or find_range(source, split.size, lo, hi)
            if own is not None:
                yield from range_batches(source, own, reader.schema.names.index(self.column))


class ArrowIpcWriter(DataSourceArrowWriter):
    """One shard file per ``shard`` value met by a task, one record batch per ``batch_index``.

    Rows must arrive sorted by shard, batch and row.

    ``layout=file``   one file per shard, whose rows must lie in one task.
    ``layout=parts``  a folder per shard with a file ``part-<first batch>.arrow`` per task that met it, so
                      that no task holds a shard; the rows of one batch must lie in one task.
    """

    def __init__(self, options, overwrite):
        self.root = options["path"]
        self.column = options.get("column", "text")
        self.container = options.get("container", "file")
        self.layout = options.get("layout", "file")
        if self.layout not in ("file", "parts"):
            raise ValueError("layout is 'file' or 'parts'")
        self.total = int(options["total"])
        self.temp = f"{self.root}/_temporary-{uuid.uuid4().hex}"
        filesystem, root = resolve(self.root)
        if overwrite and filesystem.get_file_info(root).type == pafs.FileType.Directory:
            filesystem.delete_dir_contents(root)

    def write(self, iterator):
        from pyspark import TaskContext

        filesystem, temp = resolve(self.temp)
        attempt = TaskContext.get().taskAttemptId()
        filesystem.create_dir(temp, recursive=True)
        written, sink, writer, open_shard = [], None, None, None
        pending, pending_key = [], None

        def flush():
            if pending:
                whole = pa.concat_arrays(pending)
                writer.write_batch(pa.RecordBatch.from_arrays([whole], [self.column]))
                pending.clear()

        for rows in iterator:
            shards, batches = rows.column("shard").to_numpy(), rows.column("batch_index").to_numpy()
            text = rows.column(self.column)
            cuts = [0, *[i for i in range(1, len(shards)) if (shards[i], batches[i]) != (shards[i - 1], batches[i - 1])], len(shards)]
            for lo, hi in zip(cuts, cuts[1:]):
                key = (int(shards[lo]), int(batches[lo]))
                if key != pending_key:
                    flush()
                    if key[0] != open_shard:
                        if writer is not None:
                            writer.close(), sink.close()
                        open_shard = key[0]
                        name = f"data-{open_shard:05d}-of-{self.total:05d}.arrow"
                        made = f"{attempt}-{name}"
                        if self.layout == "parts":
                            name = f"{name}/part-{key[1]:020d}.arrow"
                        sink = filesystem.open_output_stream(f"{temp}/{made}")
                        make = pa.ipc.new_file if self.container == "file" else pa.ipc.new_stream
                        writer = make(sink, pa.schema([pa.field(self.column, text.type)]))
                        written.append((made, name))
                    pending_key = key
                pending.append(text.slice(lo, hi - lo))
        flush()
        if writer is not None:
            writer.close(), sink.close()
        message = WriterCommitMessage()
        message.files = written
        return message

    def commit(self, messages):
        filesystem, root = resolve(self.root)
        _, temp = resolve(self.temp)
        for message in messages:
            for made, name in message.files if message else []:
                if self.layout == "parts":
                    filesystem.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
                filesystem.move(f"{temp}/{made}", f"{root}/{name}")
        filesystem.delete_dir(temp)

    def abort(self, messages):
        filesystem, temp = resolve(self.temp)
        if filesystem.get_file_info(temp).type == pafs.FileType.Directory:
            filesystem.delete_dir(temp)


class ArrowIpcSource(DataSource):
    """``format("arrow_ipc")`` with options ``column``, ``shards``, ``splitBytes``, ``ranges``.

    A task of a raw stream looks at the headers before its share. ``ranges``, a folder with the
    Parquet table of ``arrow_stream_ranges``, spares that: every task begins at its own place.
    """

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def schema(self):
        reader = ArrowIpcReader(self.options)
        first, _, _ = _open(reader.files()[0][0])
        kind = _column_type(first.schema, reader.column)
        name = "string" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else "binary"
        return f"shard bigint, batch_index bigint, row_in_batch bigint, `{reader.column}` {name}"

    def reader(self, schema):
        return ArrowIpcReader(self.options)

    def writer(self, schema, overwrite):
        return ArrowIpcWriter(self.options, overwrite)
