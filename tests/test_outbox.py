import os

import pytest

from tidemark.sources import outbox
from tidemark.sources.outbox import Claims, Rejected, attempt, post, sent


def picks(spark, *names, size=10):
    return spark.createDataFrame([(n, size, f"caption {n}") for n in names], "clip_file string, size long, caption string")


def sender(folder, fails=()):
    """Writes a file for every call, and fails as told."""

    def send(item):
        name = item["clip_file"]
        calls = len([f for f in os.listdir(folder) if f.startswith(f"{name}-")])
        open(f"{folder}/{name}-{calls}", "w").close()
        if name in dict(fails) and calls < 9:
            raise dict(fails)[name]
        return 100 + calls

    return send


def calls(folder, name):
    return len([f for f in os.listdir(folder) if f.startswith(f"{name}-")])


@pytest.fixture
def place(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "outbox"), str(tmp_path / "calls")


def actions(df):
    return {r["clip_file"]: r["action"] for r in df.collect()}


def test_nothing_is_sent_twice(spark, place):
    path, folder = place
    assert actions(post(picks(spark, "a", "b"), sender(folder), path, 50, dry_run=True)) == {"a": "would send", "b": "would send"} and not os.listdir(folder)
    out = post(picks(spark, "a", "b", "a"), sender(folder), path, 50)
    assert actions(out) == actions(out) == {"a": "sent", "b": "sent"}
    assert actions(post(picks(spark, "a", "b", "c"), sender(folder), path, 50)) == {"a": "skipped", "b": "skipped", "c": "sent"}
    assert [calls(folder, n) for n in "abc"] == [1, 1, 1]
    assert {r["clip_file"]: r["message_id"] for r in sent(spark, path).collect()} == {"a": 100, "b": 100, "c": 100}
    assert actions(post(picks(spark, "d", size=51), sender(folder), path, 50)) == {"d": "too large"} and calls(folder, "d") == 0


def test_rejections_end_at_once_and_other_errors_are_tried_again(spark, place):
    path, folder = place
    send = sender(folder, [("gone", Rejected(404, "no chat")), ("busy", Rejected(503)), ("cut", ConnectionError("reset"))])
    out = {r["clip_file"]: r for r in post(picks(spark, "gone", "busy", "cut"), send, path, 50, retries=2, sleep=lambda s: None).collect()}
    assert {n: (r["action"], r["attempts"]) for n, r in out.items()} == {"gone": ("failed", 1), "busy": ("failed", 3), "cut": ("failed", 3)}
    assert "404: no chat" in out["gone"]["error"] and sent(spark, path).count() == 0
    assert actions(post(picks(spark, "gone"), sender(folder), path, 50)) == {"gone": "sent"}  # a failed one may go later


def test_a_lost_task_is_not_repeated(spark, place):
    path, folder = place
    assert Claims(path).claim("a") == "ours"  # and then its task was lost
    assert actions(post(picks(spark, "a", "b"), sender(folder), path, 50)) == {"a": "unconfirmed", "b": "sent"} and calls(folder, "a") == 0
    assert actions(post(picks(spark, "a"), sender(folder), path, 50, dry_run=True)) == {"a": "unconfirmed"}
    Claims(path).release("a")
    assert actions(post(picks(spark, "a"), sender(folder), path, 50)) == {"a": "sent"}


def test_waits_double():
    waits = []

    def send(_):
        raise OSError("x")

    assert attempt(send, {}, 3, waits.append)[1] == 4 and waits == [1.0, 2.0, 4.0]
    assert attempt(lambda _: 5, {}, 3, waits.append) == (5, 1, None)


def test_a_stream_that_is_replayed(spark, place, tmp_path):
    path, folder = place
    picks(spark, "a", "b").write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second time without its checkpoint, as after a loss
        stream = spark.readStream.schema("clip_file string, size long, caption string").parquet(str(tmp_path / "in"))
        q = outbox.stream_posts(stream, sender(folder), path, 50, str(tmp_path / f"checkpoint{k}"), str(tmp_path / f"results{k}"))
        assert q.awaitTermination(60) and q.exception() is None
    assert [calls(folder, n) for n in "ab"] == [1, 1]
    assert {r["action"] for r in spark.read.json(str(tmp_path / "results1")).collect()} == {"skipped"}
