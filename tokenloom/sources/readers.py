"""Python data sources: raw byte blocks, flat token files, log lines with positions.

All of them cut files into byte ranges, so one huge file is read by many tasks.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tokenloom.sources.files import FileSplit, byte_splits, list_files, resolve

BATCH_ROWS = 1 << 16
LOG_CHUNK = 1 << 20
STATS_BYTES = 8 << 20
NOTHING = FileSplit("", 0, 0, 0)  # an empty list would mean one default partition


class _RangeReader(DataSourceReader):
    suffix = ""

    def __init__(self, options):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", 64 << 20))

    def unit(self) -> int:
        return 1

    def partitions(self):
        return byte_splits(list_files(self.path, self.suffix), self.unit(), self.split_bytes) or [NOTHING]

    def read(self, split):
        if split.start >= split.end:
            return
        filesystem, local = resolve(split.path)
        with filesystem.open_input_file(local) as f:
            yield from self.read_range(f, split)


class ByteBlockReader(_RangeReader):
    def __init__(self, options):
        super().__init__(options)
        self.block_bytes = int(options.get("blockbytes", 131072))

    def unit(self):
        return self.block_bytes

    def read_range(self, f, split):
        f.seek(split.start)
        for at in range(split.start, split.end, self.block_bytes):
            content = f.read(min(self.block_bytes, split.size - at))
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [split.path],
                    "block_index": pa.array([at // self.block_bytes], pa.int64()),
                    "offset": pa.array([at], pa.int64()),
                    "length": pa.array([len(content)], pa.int32()),
                    "content": pa.array([content], pa.binary()),
                }
            )


class ByteBlockSource(DataSource):
    """``format("byte_blocks")``: fixed-size blocks of raw files, the last one short."""

    @classmethod
    def name(cls):
        return "byte_blocks"

    def schema(self):
        return "path string, block_index bigint, offset bigint, length int, content binary"

    def reader(self, schema):
        return ByteBlockReader(self.options)


@dataclass
class TokenSplit(FileSplit):
    """A range of a token file, or of one part of a token file kept in parts."""

    name: str = ""
    base: int = 0


def token_file_parts(path: str, suffix: str = ".bin") -> list[tuple[str, int, str, int]]:
    """(stored path, size, token file, first byte) of everything that holds tokens."""
    found = []
    for stored, size in list_files(path):
        folder, _, leaf = stored.rpartition("/")
        if leaf.endswith(suffix):
            found.append((stored, size, stored, 0))
        elif folder.endswith(suffix) and leaf.startswith("part-"):
            found.append((stored, size, folder, int(leaf[len("part-"):])))
    return found


class TokenBinReader(_RangeReader):
    def __init__(self, options):
        super().__init__(options)
        self.ends = int(options["ends"]) if "ends" in options else None
        self.suffix = options.get("suffix", ".bin")

    def partitions(self):
        stored_files = token_file_parts(self.path, self.suffix)
        wanted = self._ends_of(stored_files) if self.ends is not None else None
        splits = []
        for stored, size, name, base in stored_files:
            for s in byte_splits([(stored, size)], 4, self.split_bytes):
                ranges = [(s.start, s.end)] if wanted is None else [
                    (max(s.start, lo - base), min(s.end, hi - base)) for lo, hi in wanted[name]
                ]
                splits += [TokenSplit(s.path, lo, hi, size, name, base) for lo, hi in ranges if lo < hi]
        return splits or [NOTHING]

    def _ends_of(self, stored_files):
        """Byte ranges of the first and last ``ends`` ids of every token file."""
        sizes: dict[str, int] = {}
        for _, size, name, _ in stored_files:
            sizes[name] = sizes.get(name, 0) + size
        want = {}
        for name, size in sizes.items():
            whole, n = size // 4 * 4, 4 * max(0, self.ends)
            want[name] = [(0, whole)] if whole <= 2 * n else [(0, n), (whole - n, whole)]
        return want

    def read_range(self, f, split):
        if split.end == split.size and split.size % 4:
            warnings.warn(f"{split.path}: {split.size % 4} trailing bytes ignored")
        end = split.end // 4 * 4
        f.seek(split.start)
        for at in range(split.start, end, 4 * BATCH_ROWS):
            ids = np.frombuffer(f.read(min(4 * BATCH_ROWS, end - at)), dtype="<u4").astype(np.int64)
            pos = np.arange(len(ids), dtype=np.int64) + (split.base + at) // 4
            paths = pa.array([split.name], pa.string()).take(pa.array(np.zeros(len(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([paths, pa.array(pos), pa.array(ids)], ["path", "pos", "token_id"])


class TokenStatsReader(TokenBinReader):
    """One row per range: what it holds, summed while it is read."""

    def read_range(self, f, split):
        if split.end == split.size and split.size % 4:
            warnings.warn(f"{split.path}: {split.size % 4} trailing bytes ignored")
        end = split.end // 4 * 4
        f.seek(split.start)
        count = zeros = 0
        low = high = None
        for at in range(split.start, end, STATS_BYTES):
            ids = np.frombuffer(f.read(min(STATS_BYTES, end - at)), dtype="<u4")
            count, zeros = count + len(ids), zeros + len(ids) - int(np.count_nonzero(ids))
            low = min(int(ids.min()), low) if low is not None else int(ids.min())
            high = max(int(ids.max()), high) if high is not None else int(ids.max())
        if count:
            yield pa.RecordBatch.from_pydict({
                "path": [split.name], "tokens": pa.array([count], pa.int64()), "zeros": pa.array([zeros], pa.int64()),
                "min_id": pa.array([low], pa.int64()), "max_id": pa.array([high], pa.int64()),
            })


class TokenStatsSource(DataSource):
    """``format("token_stats")``: counts, zeros, least and greatest id of every range of flat
    token files, summed inside the scan; add the rows of a path up for the whole file."""

    @classmethod
    def name(cls):
        return "token_stats"

    def schema(self):
        return "path string, tokens bigint, zeros bigint, min_id bigint, max_id bigint"

    def reader(self, schema):
        return TokenStatsReader(self.options)


class TokenFileReader(DataSourceReader):
    """Names and sizes only; one small partition per thousand files."""

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        sizes: dict[str, int] = {}
        for _, size, name, _ in token_file_parts(self.path):
            sizes[name] = sizes.get(name, 0) + size
        files = sorted(sizes.items())
        return [FileNames(files[i : i + 1000]) for i in range(0, len(files), 1000)] or [FileNames([])]

    def read(self, split):
        if split.files:
            names, sizes = zip(*split.files)
            yield pa.RecordBatch.from_pydict(
                {"path": pa.array(names, pa.string()), "size_bytes": pa.array(sizes, pa.int64())}
            )


@dataclass
class FileNames(InputPartition):
    files: list


class TokenFileSource(DataSource):
    """``format("token_files")``: (path, size_bytes) of every token file, empty ones too."""

    @classmethod
    def name(cls):
        return "token_files"

    def schema(self):
        return "path string, size_bytes bigint"

    def reader(self, schema):
        return TokenFileReader(self.options)


class TokenBinSource(DataSource):
    """``format("token_bin")``: flat little-endian uint32 files; with option ``ends=n``
    only the first and last n ids of each file are read."""

    @classmethod
    def name(cls):
        return "token_bin"

    def schema(self):
        return "path string, pos bigint, token_id bigint"

    def reader(self, schema):
        return TokenBinReader(self.options)


class LogLineReader(_RangeReader):
    def read_range(self, f, split):
        # a line belongs to the range its first byte lies in
        at, held = split.start, b""
        if at > 0:
            f.seek(at - 1)
            at -= 1
            while (cut := held.find(b"\n")) < 0:
                at += len(held)
                held = f.read(LOG_CHUNK)
                if not held:
                    return
            at, held = at + cut + 1, held[cut + 1:]
        while at < split.end:
            more = f.read(LOG_CHUNK)
            data = held + more
            whole = len(data) if not more else data.rfind(b"\n") + 1
            if whole:
                yield from self._batches(split, at, data[:whole])
                at, data = at + whole, data[whole:]
            held = data
            if not more:
                return

    def _batches(self, split, at, data):
        """Whole lines as Arrow arrays over the bytes just read."""
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        if not len(ends) or ends[-1] < len(data):
            ends = np.append(ends, len(data))
        starts = np.concatenate([[0], ends[:-1]])
        n = int(np.searchsorted(at + starts, split.end))
        if not n:
            return
        offsets = np.append(starts[:n], ends[n - 1]).astype(np.int32)
        try:
            data.decode()
            lines = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data))
        except UnicodeDecodeError:
            lines = pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(starts[:n], ends[:n])], pa.string())
        lines = pc.utf8_rtrim(pc.utf8_rtrim(lines, "\n"), "\r")
        file = pa.array([split.path], pa.string()).take(pa.array(np.zeros(n, np.int32)))
        yield pa.RecordBatch.from_arrays([file, pa.array(at + starts[:n]), lines], ["file", "byte_offset", "value"])


class LogLineSource(DataSource):
    """``format("log_lines")``: text lines with the byte offset of each."""

    @classmethod
    def name(cls):
        return "log_lines"

    def schema(self):
        return "file string, byte_offset bigint, value string"

    def reader(self, schema):
        return LogLineReader(self.options)
