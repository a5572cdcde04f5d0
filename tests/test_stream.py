import random

from bindery.streaming.changefeed import apply_changes, combined_stream, latest, replay

FIELDS = "seq long, source string, op string, id long, title string"


def changes(n=300, resets=False):
    rng = random.Random(5)
    out = []
    for seq in range(n):
        if resets and seq == n // 2:
            out += [(seq, "remote", "X", None, None)]
            continue
        out.append((seq, rng.choice(["local", "remote"]), rng.choice("AARU"), rng.randrange(20), f"t{seq}"))
    return out


def by_hand(rows):
    state = {}
    for _, source, op, key, title in rows:
        for k in list(state) if op == "X" else [key]:
            here = state.get(k)
            if op == "A":
                here = here or [False, False, title]
                here[source == "remote"] = True
            elif op in "RX" and here:
                here[source == "remote"] = False
            elif op == "U" and here:
                here[2] = title
            state[k] = here
            if here is None or not (here[0] or here[1]):
                state.pop(k, None)
    return {k: (v[2], v[0], v[1]) for k, v in state.items()}


def test_replay(spark):
    for resets in (False, True):
        rows = changes(resets=resets)
        got = replay(spark.createDataFrame(rows, FIELDS), ["title"]).collect()
        assert {r.id: (r.title, r.is_local, r.is_remote) for r in got} == by_hand(rows)


def test_stream_equals_replay(spark, tmp_path):
    rows = changes(200)
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], FIELDS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        (tmp_path / "in" / f"{k}").rename(tmp_path / f"part{k}")
    import shutil

    (tmp_path / "feed").mkdir()
    out = []
    source = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "feed"))
    query = combined_stream(source, ["title"]).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect())).start()
    for k in range(4):
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "feed" / f"{k}-{f.name}")
        query.processAllAvailable()
    query.stop()
    view = latest(spark.createDataFrame(out, "batch long, id long, title string, is_local boolean, is_remote boolean, gone boolean"))
    assert {r.id: (r.title, r.is_local, r.is_remote) for r in view.collect()} == by_hand(rows)


def test_reset_of_one_key():
    import pandas as pd

    frame = pd.DataFrame([(1, "remote", "A", 1, "a"), (2, "remote", "X", 1, None)], columns=["seq", "source", "op", "id", "title"])
    assert apply_changes(None, frame, ["title"]) is None
