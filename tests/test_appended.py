"""Logs that grow, read in ranges and as a stream that is started again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memspan.sources import appended, schemas
from memspan.sources.store import Store
from memspan.streaming import ingest

NOW = 1_700_000_000


def told(df):
    return sorted((r.file.rsplit("/", 1)[1], r.at, r.line) for r in df.collect())


def wanted(folder, names):
    """Lines of files, read whole."""
    out = []
    for name in names:
        body, at = (folder / name).read_bytes(), 0
        for line in body.split(b"\n")[: None if body and not body.endswith(b"\n") else -1]:
            out.append((name, at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_tell_each_line_once(spark, tmp_path, size):
    rnd = random.Random(size)
    texts = ["", "a", "ä" * rnd.randint(1, 40), "x" * 30, "tail\r", "\r"]
    (tmp_path / "a.log").write_bytes("\n".join(rnd.choices(texts, k=4 if size == 1 else 40)).encode() + b"\n")
    (tmp_path / "b.log").write_bytes("\n".join(rnd.choices(texts, k=2 if size == 1 else 9)).encode() + b"\nno end \xff")
    (tmp_path / "c.log").write_bytes(b"")
    (tmp_path / "_hidden.log").write_bytes(b"hidden\n")
    (tmp_path / "other.txt").write_bytes(b"other\n")
    got = appended.lines(spark, str(tmp_path), pattern="*.log", rangeBytes=size)
    assert told(got) == wanted(tmp_path, ["a.log", "b.log"])


def test_a_folder_that_is_not_there_has_no_lines(spark, tmp_path):
    assert appended.lines(spark, f"{tmp_path}/none").isEmpty()
    with pytest.raises(Exception, match="rangeBytes must be positive"):
        appended.lines(spark, str(tmp_path), rangeBytes=0).collect()


def run(frame, checkpoint, batches):
    def take(rows, batch):
        batches.append(told(rows))

    query = frame.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_a_stream_that_is_started_again_loses_and_repeats_nothing(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    batches = []
    steps = [{"a": b"one\ntwo\nthr"}, {"a": b"ee\n"}, {}, {"a": b"four\nfi", "b": b"x\n"}, {"a": b"ve\n", "b": b"y" * 100 + b"\n"}]
    for step in steps:
        for name, more in step.items():
            with open(logs / name, "ab") as log:
                log.write(more)
        run(appended.lines(spark, str(logs), stream=True, rangeBytes=4), f"{tmp_path}/checkpoint", batches)
    assert sorted(x for b in batches for x in b) == wanted(logs, ["a", "b"])
    assert [sorted(line for _, _, line in b) for b in batches if b][:2] == [["one", "two"], ["three"]]


def test_a_file_that_got_shorter_raises(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a").write_bytes(b"one\ntwo\n")
    run(appended.lines(spark, str(logs), stream=True), f"{tmp_path}/checkpoint", [])
    (logs / "a").write_bytes(b"one\n")
    with pytest.raises(Exception, match="was read up to 8"):
        run(appended.lines(spark, str(logs), stream=True), f"{tmp_path}/checkpoint", [])


def test_a_file_that_is_gone_ends(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a").write_bytes(b"one\n")
    batches = []
    run(appended.lines(spark, str(logs), stream=True), f"{tmp_path}/checkpoint", batches)
    (logs / "a").rename(tmp_path / "away")
    run(appended.lines(spark, str(logs), stream=True), f"{tmp_path}/checkpoint", batches)
    (logs / "a").write_bytes(b"new\n")
    run(appended.lines(spark, str(logs), stream=True), f"{tmp_path}/checkpoint", batches)
    assert [line for b in batches for _, _, line in b] == ["one", "new"]


def test_numstat_lines(spark, tmp_path):
    (tmp_path / "log").write_text("s1\t3\t-\tsrc/a b.rs\nno stat\ns1\t1\t2\tx\ty\n")
    got = appended.numstat_log(appended.lines(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, got)) == [("s1", 1, 2, "x\ty"), ("s1", 3, 0, "src/a b.rs")]


def posted(hook, session, second, **data):
    return json.dumps({"hookType": hook, "sessionId": session, "cwd": "p", "timestamp": f"2023-11-14T10:00:{second:02d}Z", "data": json.dumps(data)}) + "\n"


def test_hook_logs_are_taken_in_as_they_grow(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    made = [posted("UserPromptSubmit", "s-1", 1, prompt="do it"), posted("PostToolUse", "s-1", 2, tool_name="Read", tool_input={"file_path": "a.py"}), posted("PostToolUse", "7", 3, tool_name="Write", tool_input={"file_path": "b.py"}), "\n", "no json\n", posted("Stop", "s-1", 4)]
    store = Store(spark, f"{tmp_path}/store", buckets=4)
    store.save({name: schemas.empty(spark, name) for name in ("memory",)})
    for i in range(0, len(made), 2):
        body = "".join(made[i : i + 2])
        with open(logs / "h.jsonl", "a") as log:
            log.write(body)
        stream = appended.hook_log(appended.lines(spark, str(logs), stream=True))
        query = ingest.ingest(stream, store, f"{tmp_path}/checkpoint", lambda: NOW, available_now=True)
        query.awaitTermination()
    # What the stream took in is known by its ids when all logs are read once more.
    before = store.read("observation").count()
    events = appended.hook_log(appended.lines(spark, str(logs)))
    assert events.count() == 4 and events.where("ts_us is null or project <> 'p'").isEmpty()
    assert {r.session_id for r in events.select("session_id").collect()} == {7, spark.range(1).select(F.xxhash64(F.lit("s-1"))).head()[0]}
    ingest.take_in(store, events, NOW)
    assert store.read("observation").count() == before > 0 and store.read("seen").count() == 4
    assert store.read("run").count() == 1
