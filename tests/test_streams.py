"""Job events in any batches, order and number give the transitions of their fold."""

import json
import random

import pytest

from docsieve.streaming import jobs

SCHEMA = "job_id string, at long, seq int, event string, error string"
EVENTS = ["started", "done", "partial", "busy", "retryable", "fatal", "retry"]


def logs(rng):
    out = []
    for job in range(12):
        at = 0
        for seq in range(rng.randint(1, 25)):
            at += rng.choice([1, 20, 400, 20_000])
            event = "started" if seq == 0 else rng.choice([*EVENTS, "done", "done"])
            out.append((f"j{job}", at, seq, event, rng.choice([None, "E1", "E2"])))
    return [e for e in out if not (e[0] == "j3" and e[2] == 2)]  # one never comes


def plain(events):
    rows = []
    for job in {e[0] for e in events}:
        own = {e[2]: e for e in events if e[0] == job}
        state, seq = None, 0
        while seq in own:
            _, at, _, event, error = own[seq]
            state = state or jobs.new_job(at)
            new = jobs.step(state, event, at, error)
            if new != state:
                rows.append((job, at, event, state["phase"], new["phase"], new["due"], new["failures"], new["error"], new["revision"]))
            state, seq = new, seq + 1
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", [1])
def test_stream_of_any_split_equals_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = logs(rng)
    want = plain(events)
    sent = [*events, *rng.choices(events, k=60)]
    rng.shuffle(sent)
    assert sorted(map(tuple, jobs.fold(spark.createDataFrame(sent, SCHEMA)).collect()), key=str) == want and len(want) > 20
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    (tmp_path / "in").mkdir()
    cuts = sorted(rng.sample(range(len(sent)), 3))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(sent)], strict=True)):
        names = SCHEMA.replace(",", "").split()[::2]
        text = "".join(json.dumps(dict(zip(names, e, strict=True))) + "\n" for e in sent[a:b])
        (tmp_path / "in" / f"{k}.json").write_text(text)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = jobs.stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    out.trigger(availableNow=True).start().awaitTermination(200)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want
    (tmp_path / "in" / "again.json").write_text((tmp_path / "in" / "0.json").read_text())  # a batch that was there before, after a restart
    jobs.stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want
