"""The stream of envelopes, read from files until they are used up."""

import json
import os

from corvane.streaming import feeds
from corvane.streaming.feeds import decoded, notified_once


def test_envelopes(spark, tmp_path):
    one = {"kind": "event", "user_id": 1, "reference_id": "r", "created": "2024-01-01T00:00:00Z", "payload": "p"}
    lines = [json.dumps(x) for x in (one, one, one | {"kind": "match"}, one | {"kind": "odd"}, one | {"user_id": None})] + ["{broken", ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    stream = notified_once(decoded(spark.readStream.text(str(tmp_path / "in"))))
    run = stream.writeStream.format("memory").queryName("envelopes").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.kind, r.user_id or 0) for r in spark.table("envelopes").collect()) == [("event", 0), ("event", 1), ("match", 1)]


def test_cache_with_time_to_live(spark, tmp_path):
    """Over four batches with a moving watermark: entries end by the next request or by a timer, late requests are told, older ones counted."""
    batches = [[("a", 0, 1), ("a", 10, 2)], [("a", 100, 3), ("b", 100, 4), ("b", 100, 5)], [("a", 95, 6), ("a", 5, 7), ("c", 300, 8)], [("a", 6, 9)]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        path = tmp_path / "in" / f"{i}.json"
        path.write_text("\n".join(json.dumps({"k": k, "at": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", "id": n}) for k, s, n in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    requests = spark.readStream.schema("k string, at timestamp, id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = feeds.stored(feeds.cached(requests, ["k"], "at", "id", 30, "20 seconds"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert run.awaitTermination(200)
    found = spark.read.parquet(str(tmp_path / "out")).selectExpr("k", "id", "int(minute(at) * 60 + second(at))", "outcome").collect()
    want = [("a", 1, 0, "miss"), ("a", 2, 10, "hit"), ("a", None, 30, "expired"), ("a", 3, 100, "miss"), ("b", 4, 100, "miss"), ("b", 5, 100, "hit")]
    want += [("a", 6, 95, "late"), ("a", 7, 5, "late"), ("c", 8, 300, "miss"), ("a", None, 130, "expired"), ("b", None, 130, "expired")]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert feeds.dropped(run) == 1
