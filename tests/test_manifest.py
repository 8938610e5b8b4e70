import random

import pytest

from tessera.streaming import manifest as M
from tessera.streaming.stateful import drained

NAMES = [c.split()[0] for c in M.EVENT.split(", ")]


def event(path, at, n, kind, **rest):
    return tuple({"path": path, "at": at, "n": n, "kind": kind, **rest}.get(c) for c in NAMES)


def changes(df):
    return sorted((r.path, r.seq, r.at, r.before, r.after, r.worker, r.content, r.error) for r in df.collect())


def test_states_leases_and_pieces(spark):
    e = [
        event("a", 0, 0, "listed", size=1, modified="m"), event("a", 10, 1, "claim", worker="w"), event("a", 11, 2, "claim", worker="v"),
        event("a", 12, 3, "piece", worker="w", number=1, text="world"), event("a", 13, 4, "piece", worker="w", number=0, text="hello "), event("a", 13, 5, "piece", worker="v", number=0, text="no"),
        event("a", 20, 6, "done", worker="w", number=2), event("a", 30, 7, "listed", size=1, modified="m"), event("a", 40, 8, "listed", size=2, modified="m"),
        event("b", 0, 0, "listed"), event("b", 5, 1, "claim", worker="w"), event("b", 6, 2, "piece", worker="w", number=0, text="x"), event("b", 105, 3, "done", worker="w", number=1),
        event("b", 200, 4, "claim", worker="v"), event("b", 210, 5, "done", worker="v", number=1), event("b", 220, 6, "done", worker="v", number=0), event("b", 230, 7, "requeue"), event("b", 240, 8, "claim", worker="v"), event("b", 250, 9, "failed", worker="v", text="503"),
        event("c", 0, 0, "claim", worker="w"), event(None, 0, 0, "listed"),
    ]
    got = changes(M.replayed(spark.createDataFrame(e + e[:3], M.EVENT), lease=100))
    assert got == [
        ("a", 0, 0, None, "QUEUED", None, None, None), ("a", 1, 10, "QUEUED", "FETCHING", "w", None, None), ("a", 2, 20, "FETCHING", "FETCHED", "w", "hello world", None), ("a", 3, 40, "FETCHED", "QUEUED", None, None, None),
        ("b", 0, 0, None, "QUEUED", None, None, None), ("b", 1, 5, "QUEUED", "FETCHING", "w", None, None), ("b", 2, 105, "FETCHING", "QUEUED", "w", None, M.EXPIRED), ("b", 3, 200, "QUEUED", "FETCHING", "v", None, None),
        ("b", 4, 210, "FETCHING", "FAILED", "v", None, "1 of 1 pieces missing"), ("b", 5, 230, "FAILED", "QUEUED", None, None, None), ("b", 6, 240, "QUEUED", "FETCHING", "v", None, None), ("b", 7, 250, "FETCHING", "FAILED", "v", None, "503"),
    ]
    assert M.replayed(spark.createDataFrame([], M.EVENT)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_over_replays_and_a_restart(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["listed", "claim", "claim", "piece", "piece", "done", "failed", "requeue"]
    events = [event(f"f{rng.randint(0, 5)}", 1_000_000 + i * 1000, i, k, worker=rng.choice("vw"), size=rng.randint(0, 1), modified="m", number=rng.randint(0, 1), text=f"t{i}") for i in range(160) for k in [rng.choice(kinds)]]
    folder, source = str(tmp_path / "state"), str(tmp_path / "in")
    want = changes(M.replayed(spark.createDataFrame(events, M.EVENT), lease=15_000))
    assert {r[4] for r in want} == {"QUEUED", "FETCHING", "FETCHED", "FAILED"} and any(r[7] == M.EXPIRED for r in want)
    M.with_state_store(spark)

    def arrive(part):
        spark.createDataFrame(part, M.EVENT).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(M.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        return drained(M.machine(stream, lease=15_000, delay="30 seconds"), "manifest", "append", folder=folder)

    for x in range(0, 160, 40):  # each restart brings a part in any order, some of it again, some from what was to come
        part = events[x : x + 40] + rng.sample(events[max(0, x - 5) : x + 50], 10)
        rng.shuffle(part)
        for y in range(0, len(part), 25):
            arrive(part[y : y + 25])
        if x < 120:
            run()
    arrive([event(None, 10**12, 0, "listed")])
    assert changes(run()) == want
