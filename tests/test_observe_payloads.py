"""Ingest tells repeats by key and time; payloads are not dealt out for it."""

from memspan.operators import lifecycle, pipelines
from memspan.sources import schemas


def test_payloads_are_not_part_of_dedup(spark, monkeypatch):
    seen = []
    dedup = lifecycle.ttl_dedup

    def watched(events, *args, **more):
        seen.append(events.columns)
        return dedup(events, *args, **more)

    monkeypatch.setattr(lifecycle, "ttl_dedup", watched)
    data = '{"tool_name":"Read","tool_input":{"file_path":"/a/b.rs"},"prompt":"p"}'
    rows = [(1, 7, "p", 10, "prompt_submit", data), (2, 7, "p", 20, "post_tool_use", data), (3, 7, "p", 500, "post_tool_use", data), (4, 8, "p", None, "post_tool_use", data)]
    events = spark.createDataFrame([*rows, rows[1]], "id long, session_id long, project string, ts_us long, hook string, data string")
    tables = {name: schemas.empty(spark, name) for name in schemas.SCHEMAS}
    out = pipelines.observe(tables, events, 1000, 300)
    assert seen == [["id", "ts_us", "_dedup"]]
    assert sorted(r.id for r in out["observation"].collect()) == [1, 3, 4]
    assert [r.last_us for r in out["dedup"].collect()] == [500]
    assert sorted(r.id for r in out["seen"].collect()) == [1, 2, 3, 4]
