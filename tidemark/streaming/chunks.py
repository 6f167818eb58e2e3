"""Recordings whose chunk files are still arriving: new files to peaks, each file once.

The stream lists files as Spark's file source does, and takes their paths and lengths
alone; a task then reads a file's blocks by seeks, with the samples carried that the next
frame needs. Frames go on to ``signals.stream_peaks``, which carries what thresholds and
runs need. A file must come whole, by a rename into the folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.signal import EPS
from tidemark.package import ship
from tidemark.sources import audio
from tidemark.sources.recordings import CHUNK_NAME
from tidemark.streaming.signals import stream_peaks

#: A binary file's columns; of these only path and length are read.
FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, suffix: str = "wav", per_batch: int = 1000) -> DataFrame:
    """A stream of recording_id, sequence, path and length of chunk files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return chunk_files(files, suffix)


def chunk_files(files: DataFrame, suffix: str = "wav") -> DataFrame:
    """The chunk files among listed files (path, length); other names are passed over."""
    name = F.regexp_extract("path", rf"/{CHUNK_NAME}\.([^./]+)$", 3)
    own = files.where(F.lower(name) == suffix.lower())
    return own.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("recording_id"), F.regexp_extract("path", rf"/{CHUNK_NAME}\.[^./]+$", 2).cast("int").alias("sequence"), "path", "length")


def file_frames(chunks: DataFrame, window_seconds: float, hop_seconds: float, block: int = 1 << 16) -> DataFrame:
    """dBFS frames of each chunk file, and a last row with a null value that says how many there are.

    Windows and hops are cut to whole samples at the file's own rate; times are of a
    frame's start.
    """
    schema = "recording_id string, sequence int, frame_idx long, t double, value double"

    def frames(batches):
        for batch in batches:
            for rec, sequence, path, length in zip(*(batch.column(c).to_pylist() for c in ("recording_id", "sequence", "path", "length"))):
                h = audio.header_of(path, length)
                window, hop = max(1, int(window_seconds * h.rate)), max(1, int(hop_seconds * h.rate))
                part, held, start, done = audio.Range(path, h, 0, -(-h.frames // block), block), np.zeros(0), 0, 0
                for read in audio.WavReader({"path": path}).read(part):
                    held = np.append(held, read.column("block")[0].values.to_numpy().astype(float))
                    n = (start + len(held) - window) // hop + 1 - done
                    if n <= 0:
                        continue
                    power = np.concatenate([[0.0], np.cumsum(held**2)])
                    k = done + np.arange(n)
                    at = k * hop - start
                    rms = np.sqrt(np.maximum(power[at + window] - power[at], 0) / window + EPS)
                    yield pa.RecordBatch.from_arrays([pa.array([rec] * n), pa.array([sequence] * n, pa.int32()), pa.array(k), pa.array(k * hop / h.rate), pa.array(20 * np.log10(rms + EPS))], names)
                    done += n
                    drop = min(len(held), done * hop - start)  # what the next frame starts after
                    held, start = held[drop:], start + drop
                yield pa.RecordBatch.from_arrays([pa.array([rec]), pa.array([sequence], pa.int32()), pa.array([done]), pa.array([None], pa.float64()), pa.array([None], pa.float64())], names)

    names = ["recording_id", "sequence", "frame_idx", "t", "value"]
    ship(chunks.sparkSession)
    return chunks.mapInArrow(frames, schema)


def arriving_peaks(spark: SparkSession, folder: str, settings, suffix: str = "wav", per_batch: int = 1000) -> DataFrame:
    """Peaks over the RMS threshold of all chunks that arrive, by the settings of ``rms_energy``."""
    from tidemark.operators.signal import odd_size

    own = settings.detection.rms_energy
    frames = file_frames(arriving(spark, folder, suffix, per_batch), own.window_seconds, own.hop_seconds)
    return stream_peaks(frames, ["recording_id", "sequence"], odd_size(own.baseline_window_seconds, own.hop_seconds), own.threshold_sigma, own.min_score_dbfs, own.min_absolute_dbfs)
