"""An outbox: each item is sent once, whatever is run again.

Sending can't be undone and isn't part of a transaction, so every item gets a claim before
it is sent and a receipt after. Both are small files in the outbox's folder. An item with a
receipt is passed over. One with a claim alone was being sent when its task was lost: it
may or may not have arrived, so it is reported as ``unconfirmed`` and left to a person,
who deletes the claim to have it sent again. So nothing is ever sent twice, neither by a
task that Spark runs again nor by a later call.

A call's errors: a rejection (status 400 to 499) is final at once; others are tried
``retries`` times more, after 1, 2, 4 ... seconds. An item that failed loses its claim, so
a later call tries it again. Items over the size cap and, in a dry run, all others are only
listed.

Tasks send their items one after the other, in order. Claims are exclusive on local and
mounted folders; on other stores a claim is written after looking, which is enough as long
as an item is in one task only (speculation off).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from datetime import datetime, timezone
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.package import ship
from tidemark.sources.directories import filesystem
from tidemark.written import keep

RESULT = "clip_file string, action string, message_id long, sent_at string, attempts int, error string"


class Rejected(Exception):
    """The other side's answer: a status, and what it said."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"{status}: {text}")
        self.status = status


class Claims:
    """Claims and receipts of items in a folder that all executors share."""

    def __init__(self, path: str):
        self.path = path

    def _file(self, kind: str, item: str):
        system, root = filesystem(self.path)
        folder = f"{root.rstrip('/')}/{kind}"
        system.create_dir(folder, recursive=True)
        return system, f"{folder}/{sha256(item.encode()).hexdigest()}.json"

    def _there(self, kind: str, item: str) -> bool:
        system, at = self._file(kind, item)
        return system.get_file_info(at).type != filesystems.FileType.NotFound

    def claim(self, item: str) -> str:
        """``ours``, or how far another one has come: ``sent`` or ``unconfirmed``."""
        if self._there("sent", item):
            return "sent"
        system, at = self._file("claims", item)
        if isinstance(system, filesystems.LocalFileSystem):
            try:
                os.close(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return "sent" if self._there("sent", item) else "unconfirmed"
        elif self._there("claims", item):
            return "unconfirmed"
        else:
            self._put("claims", item, {"clip_file": item})
        return "ours"

    def _put(self, kind: str, item: str, what: dict) -> None:
        system, at = self._file(kind, item)
        with system.open_output_stream(f"{at}.part") as f:
            f.write(json.dumps(what).encode())
        system.move(f"{at}.part", at)

    def receipt(self, item: str, message_id: int | None, sent_at: str) -> None:
        self._put("sent", item, {"clip_file": item, "message_id": message_id, "sent_at": sent_at})

    def release(self, item: str) -> None:
        system, at = self._file("claims", item)
        system.delete_file(at)


def attempt(send: Callable[[dict], int], item: dict, retries: int, sleep: Callable[[float], None]) -> tuple[int | None, int, str | None]:
    """The message's number, the calls made, and the error if it failed."""
    error = None
    for k in range(retries + 1):
        try:
            return send(item), k + 1, None
        except Rejected as e:
            error = str(e)
            if 400 <= e.status < 500:
                return None, k + 1, error
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        if k < retries:
            sleep(2.0**k)
    return None, retries + 1, error


def post(picks: DataFrame, send: Callable[[dict], int], path: str, cap_bytes: int, retries: int = 2, dry_run: bool = False, order: str = "clip_file", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """What became of each pick (clip_file, size and what ``send`` needs): sent, skipped, unconfirmed, too large, failed, or would send.

    Picks with one clip_file count once, the first by ``order``. A null size counts as none.
    """

    def work(batches):
        claims = Claims(path)
        for batch in batches:
            out = []
            for item in batch.to_pylist():
                name = item["clip_file"]
                row = {"clip_file": name, "action": None, "message_id": None, "sent_at": None, "attempts": 0, "error": None}
                if claims._there("sent", name):
                    row["action"] = "skipped"
                elif (item.get("size") or 0) > cap_bytes:
                    row |= {"action": "too large", "error": f"{item['size']} bytes, of {cap_bytes} allowed"}
                elif dry_run:
                    row["action"] = "unconfirmed" if claims._there("claims", name) else "would send"
                elif (state := claims.claim(name)) != "ours":
                    row["action"] = "skipped" if state == "sent" else state
                else:
                    number, calls, error = attempt(send, item, retries, sleep)
                    row["attempts"] = calls
                    if error is None:
                        at = datetime.now(timezone.utc).isoformat()
                        claims.receipt(name, number, at)
                        row |= {"action": "sent", "message_id": number, "sent_at": at}
                    else:
                        claims.release(name)
                        row |= {"action": "failed", "error": error}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("clip_file", pa.string()), ("action", pa.string()), ("message_id", pa.int64()), ("sent_at", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])
    ship(picks.sparkSession)
    first = picks.where("clip_file is not null").groupBy("clip_file").agg(F.min_by(F.struct(*picks.columns), F.struct(order, F.xxhash64(*[F.col(c) for c in picks.columns]))).alias("p")).select("p.*")
    return keep(first.mapInArrow(work, RESULT), "posts")  # the result is read, not made, each time it is looked at


def sent(spark, path: str) -> DataFrame:
    """Receipts: clip_file, message_id and sent_at."""
    system, root = filesystem(path)
    schema = "clip_file string, message_id long, sent_at string"
    if system.get_file_info(f"{root.rstrip('/')}/sent").type == filesystems.FileType.NotFound:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/sent")


def stream_posts(picks: DataFrame, send: Callable[[dict], int], path: str, cap_bytes: int, checkpoint: str, results: str, **options):
    """Posts picks of a stream as they come, all that is there now; a batch that is run again sends nothing again."""

    def batch(rows: DataFrame, number: int) -> None:
        post(rows, send, path, cap_bytes, **options).write.mode("overwrite").json(f"{results}/batch={number}")

    return picks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
