"""WAV files as a data source of sample blocks: ``spark.read.format("tidemark_wav")``.

A partition is a byte range of a file, cut between blocks. The header is read once, when
the scan is planned, and a task seeks to its range, so no whole file is ever in one cell or
one task. Samples are whole numbers of 8, 16, 24 or 32 bits, or floats of 32 or 64.

Options: ``path`` (a file, a folder, or comma-separated ones), ``suffix`` (wav), ``blockSeconds``
(1.0), ``rangeBytes`` (64 MB, about), ``retries`` (2: reads again after an error of the
file system, as of files that are still being fetched).

Files without a sample give no rows. A data size in the header beyond the file's end (or
none, as of a recorder that was cut off) is the file's end; a rest of a frame is left out.
"""

from __future__ import annotations

import struct
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.package import ship
from tidemark.sources.directories import filesystem

SCHEMA = "source_path string, sample_rate int, duration_seconds double, block_idx long, block array<float>"


@dataclass
class Header:
    rate: int
    channels: int
    width: int  # bytes of a sample
    is_float: bool
    start: int  # of the samples in the file
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.width * self.channels


def read_header(file, size: int) -> Header:
    """Walks the RIFF chunks up to the samples, by seeks."""
    top = file.read(12)
    if len(top) < 12 or top[:4] not in (b"RIFF", b"RF64") or top[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(length)
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if tag == 0xFFFE and len(body) >= 26:  # the kind is in the extension
                tag = struct.unpack("<H", body[24:26])[0]
            if (tag, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)) or not channels or not rate:
                raise ValueError(f"samples of kind {tag} with {bits} bits can't be read")
            layout = rate, channels, bits // 8, tag == 3
        elif name == b"data":
            if layout is None:
                raise ValueError("samples come before their format")
            there = size - at - 8
            return Header(*layout, at + 8, (there if length in (0, 0xFFFFFFFF) else min(length, there)) // (layout[1] * layout[2]))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def decode(raw: bytes, header: Header) -> np.ndarray:
    """Samples in [-1, 1), channels averaged."""
    if header.is_float:
        x = np.frombuffer(raw, f"<f{header.width}").astype(np.float32)
    elif header.width == 1:
        x = (np.frombuffer(raw, "u1").astype(np.float32) - 128) / 128
    elif header.width == 3:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / np.float64(1 << 23)).astype(np.float32)
    else:
        x = (np.frombuffer(raw, f"<i{header.width}") / np.float64(1 << (8 * header.width - 1))).astype(np.float32)
    return x.reshape(-1, header.channels).mean(1, dtype=np.float32)


def again(call, retries: int, wait: float = 0.5):
    """The call's result; errors of the file system are tried again."""
    for attempt in range(retries + 1):
        try:
            return call()
        except OSError:
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)


def header_of(path: str, size: int, retries: int = 2) -> Header:
    def read() -> Header:
        system, at = filesystem(path)
        with system.open_input_file(at) as f:
            return read_header(f, size)

    try:
        return again(read, retries)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e


@dataclass
class Range(InputPartition):
    path: str
    header: Header
    first: int  # block
    blocks: int
    size: int  # frames of a block


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.suffix = "." + options.get("suffix", "wav").lower()
        self.seconds = float(options.get("blockSeconds", 1.0))
        self.bytes = int(options.get("rangeBytes", 64 << 20))
        self.retries = int(options.get("retries", 2))

    def files(self) -> list[tuple[str, int]]:
        found = []
        for path in self.paths:
            system, root = filesystem(path)
            prefix = path[: len(path) - len(root)] if path.endswith(root) and not path.startswith("file:") else ""
            info = system.get_file_info(root)
            if info.type == filesystems.FileType.NotFound:
                raise FileNotFoundError(path)
            inside = [info] if info.type == filesystems.FileType.File else system.get_file_info(filesystems.FileSelector(root, recursive=True))
            found += [(prefix + i.path, i.size) for i in inside if i.type == filesystems.FileType.File and i.path.lower().endswith(self.suffix)]
        return sorted(set(found))

    def partitions(self) -> list[Range]:
        files = self.files()
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(lambda f: header_of(*f, self.retries), files))
        out = []
        for (path, _), h in zip(files, headers):
            size = max(1, int(h.rate * self.seconds))
            blocks, each = -(-h.frames // size), max(1, self.bytes // (size * h.frame_bytes))
            out += [Range(path, h, first, min(each, blocks - first), size) for first in range(0, blocks, each)]
        return out

    def read(self, part: Range):
        h, system_path = part.header, filesystem(part.path)
        schema = pa.schema([("source_path", pa.string()), ("sample_rate", pa.int32()), ("duration_seconds", pa.float64()), ("block_idx", pa.int64()), ("block", pa.list_(pa.float32()))])
        for k in range(part.first, part.first + part.blocks):
            lo = k * part.size
            n = min(part.size, h.frames - lo)

            def block() -> bytes:
                with system_path[0].open_input_file(system_path[1]) as f:
                    f.seek(h.start + lo * h.frame_bytes)
                    return f.read(n * h.frame_bytes)

            raw = again(block, self.retries)
            if len(raw) < n * h.frame_bytes:
                raise OSError(f"{part.path} has become shorter")
            yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([h.rate], pa.int32()), pa.array([h.frames / h.rate]), pa.array([k]), pa.array([decode(raw, h)], pa.list_(pa.float32()))], schema=schema)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_wav(spark: SparkSession, path: str, **options) -> DataFrame:
    """Blocks of samples: source_path, sample_rate, duration_seconds, block_idx and block."""
    ship(spark)
    spark.dataSource.register(WavSource)
    return spark.read.format("tidemark_wav").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def wav_durations(spark: SparkSession, paths: str) -> DataFrame:
    """source_path and duration_seconds of WAV files (a path or pattern), from their headers alone."""

    def read(batches):
        for batch in batches:
            found = [header_of(p, n) for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([h.frames / h.rate for h in found], pa.float64())], ["source_path", "duration_seconds"])

    ship(spark)
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")  # without what is in them
    return listed.mapInArrow(read, "source_path string, duration_seconds double")


def at_rate(samples: DataFrame, keys: list[str], to: int, block_seconds: float = 1.0) -> DataFrame:
    """Samples of any rates (sample_rate) as blocks of one rate."""
    from tidemark.operators.segments import resample

    out = None
    for r in samples.select("sample_rate").distinct().collect():  # the handful of rates that recorders have
        own = resample(samples.where(samples["sample_rate"] == r["sample_rate"]), keys, r["sample_rate"], to, max(1, int(r["sample_rate"] * block_seconds)))
        out = own if out is None else out.unionByName(own)
    return samples.select(*keys, "block_idx", "block") if out is None else out
