"""Sources: chunks of recordings, their samples, and the files of earlier rounds.

Files are listed and read by Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark import model
from tidemark.operators.intervals import running_offsets
from tidemark.package import ship

#: Fixed value: how chunk files are named.
CHUNK_NAME = r"DJI_(\d{14})_(\d+)_D"


def chunks_of(listed: DataFrame, suffix: str = "MP4", proxy: str = "LRF") -> DataFrame:
    """Chunks among listed files (path), a row for each, with the proxy of the same name beside it where there is one.

    Of proxies of one name (listed twice, or ending in LRF and lrf) it is the first by path.
    """
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]+$", 1)
    named = listed.withColumns({"stem": stem, "kind": F.upper(F.regexp_extract("path", r"\.([^./]+)$", 1)), "parent": F.regexp_extract("path", r"^(.*)/[^/]*$", 1)})
    named = named.where(F.col("stem").rlike(f"^{CHUNK_NAME}$"))
    own = named.where(F.col("kind") == suffix)
    other = named.where(F.col("kind") == proxy).groupBy("parent", "stem").agg(F.min("path").alias("proxy_path"))
    return own.join(other, ["parent", "stem"], "left").select(
        F.col("parent").alias("recording_id"), F.regexp_extract("stem", CHUNK_NAME, 2).cast("int").alias("sequence"),
        F.to_timestamp(F.regexp_extract("stem", CHUNK_NAME, 1), "yyyyMMddHHmmss").alias("start_time"), F.col("path").alias("source_path"), "proxy_path",
    )


def discover(spark: SparkSession, directory: str, suffix: str = "MP4", proxy: str = "LRF") -> DataFrame:
    """recording_id, sequence, start_time, source_path and proxy_path of chunk files.

    Names that don't fit are passed over; a directory without any is an error, when the
    result is read. The sequence alone is the order; ``duplicate_sequence`` tells ties.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path")
    out = chunks_of(listed, suffix, proxy)
    if out.isEmpty():
        raise FileNotFoundError(f"no chunks in {directory}")
    ties = out.groupBy("recording_id", "sequence").agg((F.count(F.lit(1)) > 1).alias("duplicate_sequence"))
    return out.join(ties, ["recording_id", "sequence"])


def with_durations(chunks: DataFrame, durations: DataFrame) -> DataFrame:
    """Chunks with duration_seconds (by source_path) and their start on the common axis."""
    return running_offsets(chunks.join(durations, "source_path"), ["recording_id"], ["sequence", "source_path"], "duration_seconds").withColumnRenamed("global_start", "global_start_seconds")


def source_of(use_proxy: bool) -> Column:
    """The proxy where one is wanted and there, else the full file."""
    return F.coalesce("proxy_path", "source_path") if use_proxy else F.col("source_path")


def redirect_proxies(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """Proxies replaced by cached files (path) of the same name; others are kept."""
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    local = cached.groupBy(name("path").alias("__name")).agg(F.min("path").alias("__local"))  # of files of one name, the first by path
    out = chunks.withColumn("__name", name("proxy_path")).join(local, "__name", "left")
    return out.withColumn("proxy_path", F.coalesce("__local", "proxy_path")).drop("__name", "__local")


def plain_path(path: Column) -> Column:
    """A path as others name it too: local ones without their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def _strategy_of_path() -> Column:
    """The directory a file lies in, by its plain name: the path is given with escapes."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))  # a plus stands for itself in paths


def read_root_events(spark: SparkSession, root: str) -> DataFrame:
    """The events of all directories below a root; those without an events.json have none."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "events.json")
    return _events(read.text(root, wholetext=True))


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of events.json arrays with the strategy (directory) and idx (place in a file, from 1)."""
    return _events(spark.read.text(path, wholetext=True))


def _events(files: DataFrame) -> DataFrame:
    text = files.select("value", _strategy_of_path().alias("strategy"))
    parsed = F.from_json("value", f"array<struct<{', '.join(_typed(model.EVENTS_JSON))}>>")
    whole = F.coalesce(F.when(F.trim("value").rlike(r"(?s)^\s*\[.*\]\s*$"), parsed), F.raise_error(F.concat(F.lit("not one array of events: "), "strategy")))
    rows = text.select("strategy", F.posexplode(whole).alias("pos", "e"))
    return rows.select("strategy", (F.col("pos") + 1).cast("long").alias("idx"), "e.*")


def _typed(ddl: str) -> list[str]:
    """Fields of a schema as name: type, for a nested type."""
    return [f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl)]


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Review sheets by header, with the strategy (directory); a byte-order mark is passed over."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    rows = read.csv(path).withColumn("strategy", _strategy_of_path())
    clean = rows.withColumnsRenamed({c: c.replace("﻿", "").strip() for c in rows.columns})
    numbers = [c for c in ("start_seconds", "end_seconds", "duration_seconds", "max_peak_score") if c in clean.columns]
    return clean.withColumns({c: F.col(c).cast("double") for c in numbers} | {c: F.coalesce(c, F.lit("")) for c in ("verdict", "notes")})


SHEET_ROW = "strategy string, idx long, clip_file string, start_seconds double, end_seconds double, duration_seconds double, max_peak_score double, verdict string, notes string, guess string, guess_basis string, ai_caption string, extra map<string, string>"


def read_review_root(spark: SparkSession, root: str, file: str = "review_sheet.csv") -> DataFrame:
    """All sheets one directory below a root, each by its own header, with the place of a row in its sheet from 1.

    Directories without a sheet have no rows; a column that a sheet lacks is null, the
    verdict and notes empty; further columns are in ``extra``. A byte-order mark, quoted
    line ends and numbers that aren't are passed over (a null number).
    """
    schema = StructType.fromDDL(SHEET_ROW)
    own = [f.name for f in schema if f.name not in ("strategy", "idx", "extra")]
    numbers = {f.name for f in schema if f.dataType.simpleString() == "double"}

    def number(text: str | None):
        try:
            return float(text) if text not in (None, "") else None
        except ValueError:
            return None

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = []
                for idx, row in enumerate(csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline="")), 1):
                    row = {(k or "").strip(): v for k, v in row.items()}
                    line = {"strategy": path.split("/")[-2], "idx": idx}
                    for name in own:
                        line[name] = number(row.get(name)) if name in numbers else row.get(name)
                    line["verdict"], line["notes"] = line["verdict"] or "", line["notes"] or ""
                    line["extra"] = [(k, v) for k, v in row.items() if k and k not in own and isinstance(v, str)]
                    found.append(line)
                if found:
                    yield pa.RecordBatch.from_pylist(found, to_arrow_schema(schema))

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", file).load(root).select("path", "content")
    return files.mapInArrow(read, schema)


def paired(sheets: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of sheets with the peaks of the event of the same place in the same directory, as far as both go.

    A directory without events, and what one of the two has more, fall away; ``with_events``
    is for those who take that as an error.
    """
    return sheets.join(events.select("strategy", "idx", F.coalesce("peaks", F.array().cast(events.schema["peaks"].dataType)).alias("peaks")), ["strategy", "idx"])


def with_events(sheets: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of sheets and the events of the same place in the same directory; a sheet longer than its events is an error."""
    both = sheets.join(events.select("strategy", "idx", "peaks"), ["strategy", "idx"], "left")
    gone = F.when(F.col("peaks").isNull(), F.raise_error(F.concat(F.lit("no event for "), "strategy", F.lit("/"), "clip_file"))).otherwise(F.lit(False))
    return both.where(~gone)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.GOLDEN).option("multiLine", True).json(path).select(F.col("time_seconds").alias("at"), "sources")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed cache, empty where nothing has been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_sent(spark: SparkSession, path: str) -> DataFrame:
    """Clips already posted: a JSON object of clip_file -> {message_id, sent_at}, as rows."""
    text = spark.read.text(path, wholetext=True)
    sent = F.from_json("value", "map<string, struct<message_id: long, sent_at: string>>")
    return text.select(F.explode(sent).alias("clip_file", "s")).select("clip_file", "s.message_id", "s.sent_at")
