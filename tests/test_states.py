"""Run states from a stream: the same rows as a batch pass, with a bounded state."""

import json
from datetime import datetime, timedelta
from pathlib import Path

from quire.operators import runs
from quire.streaming import states

SCHEMA = "parse_run_id string, state string, ts timestamp, event_id long"
START = datetime(2024, 1, 1)


def _events(first, n):
    kinds = ["queued", "running", "intake_complete", "succeeded", "failed"]
    return [(f"r{(i * 7) % 23 + i // 60 * 23}", kinds[(i * i + i // 3) % 5], START + timedelta(minutes=i), i) for i in range(first, first + n)]


def _rows_in_state(checkpoint):
    """Rows that the state stores of a stream's last batches report, by commit order."""
    found = []
    for path in sorted(Path(checkpoint, "offsets").glob("[0-9]*"), key=lambda p: int(p.name)):
        found.append(json.loads(path.read_text().splitlines()[1])["batchWatermarkMs"])
    return found


def test_stream_equals_batch(spark, tmp_path):
    events, sizes = [], []
    odd = [(None, "running", START, 1), ("r1", None, START, 2), ("r2", "running", None, 3)]
    for k in range(5):
        part = _events(k * 120, 120) + (odd if k == 1 else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events += part
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = states.stream_states(stream, f"{tmp_path}/out", f"{tmp_path}/progress", after_end_ms=600_000, idle_ms=1_800_000)
        query.awaitTermination()
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
    good = [e for e in events if None not in e[:3]]
    want = {r.parse_run_id: r.state for r in runs.latest_state(spark.createDataFrame(good, SCHEMA)).collect()}
    assert {r.parse_run_id: r.state for r in states.read_states(spark, f"{tmp_path}/out").collect()} == want
    assert len(want) > 200 and max(sizes) < 4 * 120  # timers drop runs, so the state stays that of a few batches
    assert _rows_in_state(f"{tmp_path}/progress")[-1] > 0


def test_replays_and_late_rows_change_nothing(spark, tmp_path):
    each = states.merge_states(f"{tmp_path}/c")
    frame = lambda rows: spark.createDataFrame(rows, states.CHANGES)
    first = frame([("a", True, START, 5, "failed"), ("b", False, START, 1, "queued"), ("b", False, START, 2, "running")])
    each(first, 0)
    each(first, 0)
    each(frame([("a", False, START + timedelta(days=1), 9, "running"), ("b", True, START, 3, "succeeded")]), 1)
    assert {r.parse_run_id: r.state for r in states.read_states(spark, f"{tmp_path}/c").collect()} == {"a": "failed", "b": "succeeded"}
