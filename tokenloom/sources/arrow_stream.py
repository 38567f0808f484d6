"""Raw Arrow streams read in ranges, and the index that names the ranges.

A raw stream has no list of its record batches. Its messages are found by their headers: each
tells how long its body is, so bodies are passed over unread. A range is a run of whole
messages; with the messages before the first batch (schema, dictionaries) put in front of it,
it is a stream of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tokenloom.sources.files import SPLIT_BYTES, list_files, resolve

# Fixed values of the IPC format.
CONTINUATION = 0xFFFFFFFF
RECORD_BATCH = 3
MAGIC = b"ARROW1"

HEADER_BYTES = 2048  # what one look at a header reads


def _field(table: bytes, at: int, slot: int) -> int | None:
    """Place of a field of the flatbuffer table at ``at``; None if it has its default."""
    vtable = at - struct.unpack_from("<i", table, at)[0]
    entry = 4 + 2 * slot
    if entry + 2 > struct.unpack_from("<H", table, vtable)[0]:
        return None
    offset = struct.unpack_from("<H", table, vtable + entry)[0]
    return at + offset if offset else None


def _kind_and_body(metadata: bytes) -> tuple[int, int]:
    """Header type and body length of a message."""
    root = struct.unpack_from("<I", metadata, 0)[0]
    kind, body = _field(metadata, root, 1), _field(metadata, root, 3)
    return metadata[kind] if kind else 0, struct.unpack_from("<q", metadata, body)[0] if body else 0


def messages(f, size: int, at: int = 0) -> Iterator[tuple[bool, int, int]]:
    """``(is_record_batch, start, end)`` of each message from ``at`` on; only headers are read.

    Takes headers with and without the continuation mark. A stream without its end mark ends
    with the file; one cut inside a message is an error.
    """
    while at + 4 <= size:
        f.seek(at)
        look = f.read(min(HEADER_BYTES, size - at))
        word, skip = struct.unpack_from("<I", look)[0], 4
        if word == CONTINUATION:
            if len(look) < 8:
                raise ValueError(f"the stream is cut at byte {at}")
            word, skip = struct.unpack_from("<I", look, 4)[0], 8
        if word == 0:
            return
        metadata = look[skip : skip + word]
        if len(metadata) < word:
            metadata += f.read(word - len(metadata))
        if len(metadata) < word:
            raise ValueError(f"the stream is cut at byte {at}")
        kind, body = _kind_and_body(metadata)
        end = at + skip + word + body
        if end > size:
            raise ValueError(f"the stream is cut at byte {at}")
        yield kind == RECORD_BATCH, at, end
        at = end


@dataclass
class Range:
    """Whole messages ``start`` to ``end``; ``head`` is where the first batch of the stream begins."""

    head: int
    first_index: int
    start: int
    end: int


def cut_ranges(f, size: int, step: int) -> Iterator[Range]:
    """The stream's batches in ranges of ``step`` bytes or one batch more."""
    head, index, current = None, 0, None
    for is_batch, start, end in messages(f, size):
        if not is_batch:
            continue
        head = start if head is None else head
        if current is not None and start - current.start >= step:
            yield current
            current = None
        if current is None:
            current = Range(head, index, start, end)
        current.end = end
        index += 1
    if current is not None:
        yield current


def find_range(f, size: int, lo: int, hi: int) -> Range | None:
    """The batches that begin in bytes ``lo`` to ``hi``; headers before them are looked at, later ones not."""
    head, index, found = None, 0, None
    for is_batch, start, end in messages(f, size):
        if start >= hi:
            break
        if not is_batch:
            continue
        head = start if head is None else head
        if start >= lo:
            found = found or Range(head, index, start, end)
            found.end = end
        index += 1
    return found


class _Spliced:
    """Byte ranges of a file, read as one file from front to back."""

    def __init__(self, f, pieces: list[tuple[int, int]]):
        self.f, self.pieces, self.closed = f, [p for p in pieces if p[0] < p[1]], False
        self.done = 0

    def read(self, n: int = -1) -> bytes:
        out = []
        while self.pieces and n != 0:
            start, end = self.pieces[0]
            take = end - start if n < 0 else min(n, end - start)
            self.f.seek(start)
            out.append(self.f.read(take))
            if len(out[-1]) < take:
                raise ValueError(f"the stream is cut at byte {start}")
            self.pieces[0] = (start + take, end)
            if start + take == end:
                self.pieces.pop(0)
            n = n if n < 0 else n - take
            self.done += take
        return out[0] if len(out) == 1 else b"".join(out)

    def tell(self) -> int:
        return self.done

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True


def range_batches(f, part: Range, field: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """``(batch_index, batch)`` of a range; batches hold the one field asked for."""
    source = pa.PythonFile(_Spliced(f, [(0, part.head), (part.start, part.end)]), mode="r")
    options = pa.ipc.IpcReadOptions(included_fields=[field])
    yield from enumerate(pa.ipc.open_stream(source, options=options), part.first_index)


def is_raw_stream(f) -> bool:
    f.seek(0)
    head = f.read(len(MAGIC))
    return head != MAGIC


RANGES_DDL = "path string, size bigint, head bigint, first_index bigint, start bigint, `end` bigint"


@dataclass
class _File(InputPartition):
    path: str
    size: int


class StreamRangesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        return [_File(path, size) for path, size in list_files(self.path, ".arrow")] or [_File("", 0)]

    def read(self, split):
        if not split.size:
            return
        filesystem, local = resolve(split.path)
        # seeks between small reads: no read-ahead into the bodies
        with filesystem.open_input_file(local) as f:
            if is_raw_stream(f):
                for r in cut_ranges(f, split.size, self.split_bytes):
                    yield split.path, split.size, r.head, r.first_index, r.start, r.end


class StreamRangesSource(DataSource):
    """``format("arrow_stream_ranges")``: the ranges of every raw stream, one task per file, headers only."""

    @classmethod
    def name(cls):
        return "arrow_stream_ranges"

    def schema(self):
        return RANGES_DDL

    def reader(self, schema):
        return StreamRangesReader(self.options)


def load_ranges(folder: str) -> dict[str, tuple[int, list[Range]]]:
    """Path to its size and ranges, from the table written of ``arrow_stream_ranges``: a row per task to come."""
    import pyarrow.dataset as ds

    filesystem, root = resolve(folder)
    files = [f.path for f in filesystem.get_file_info(pafs.FileSelector(root))
             if f.type == pafs.FileType.File and f.base_name.endswith(".parquet")]
    found: dict[str, tuple[int, list[Range]]] = {}
    for r in ds.dataset(files, filesystem=filesystem, format="parquet").to_table().to_pylist() if files else []:
        found.setdefault(r["path"], (r["size"], []))[1].append(Range(r["head"], r["first_index"], r["start"], r["end"]))
    return found
