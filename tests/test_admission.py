import random

import pytest
from pyspark.sql import functions as F

from sortdesk.operators import admission as A
from sortdesk.operators import policy as P
from sortdesk.streaming import jobs


def requests(seed):
    rnd, rows, i = random.Random(seed), [], 0
    for key in ("a", "b", "dense", None, ""):
        t = 0
        for _ in range(150):
            t += rnd.choice([1, 30, 200] if key == "dense"
                            else [0, 1, 50, 700, 1800, 3600, 3601, 9000])
            rows.append((i, key, t))
            i += 1
    rnd.shuffle(rows)
    return rows


def brute_force(rows):
    anchor, out = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if not key:
            out[i] = (i, False)
        elif key in anchor and t - anchor[key][0] <= 3600:
            out[i] = (anchor[key][1], True)
        else:
            anchor[key] = (t, i)
            out[i] = (i, False)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, request_key string, s long").selectExpr(
        "event_id", "request_key", "timestamp_seconds(1700000000 + s)::timestamp_ntz as ts")


@pytest.mark.parametrize("fold_limit", [100_000, 20, 0])
def test_dedupe_equals_brute_force(spark, fold_limit):
    rows = requests(1)
    got = {r.event_id: (r.anchor_id, r.duplicate)
           for r in A.dedupe_ttl(frame(spark, rows), fold_limit=fold_limit).collect()}
    assert got == brute_force(rows)


@pytest.mark.parametrize("fold_limit", [100, 0])
def test_dedupe_keeps_requests_without_time(spark, fold_limit):
    df = spark.sql("select * from values (1L, 'k', null), (2L, 'k', timestamp_ntz'2024-01-01'), "
                   "(3L, 'k', timestamp_ntz'2024-01-01 00:10:00') as t(event_id, request_key, ts)")
    got = sorted(tuple(r) for r in A.dedupe_ttl(df, fold_limit=fold_limit).select(
        "event_id", "anchor_id", "duplicate").collect())
    assert got == [(1, 1, False), (2, 2, False), (3, 2, True)]


def test_dedupe_batches_with_null_times_and_disorder(spark, tmp_path):
    out = str(tmp_path / "out")
    at = "timestamp_ntz'2024-01-01 0{}:00:00'"
    for n, rows in enumerate([f"(1L, 'k', {at.format(5)}), (2L, 'k', null)",
                              f"(3L, 'k', {at.format(1)}), (4L, 'k', {at.format(6)})",
                              f"(5L, 'k', {at.format(2)}), (6L, 'q', null)"]):
        batch = spark.sql(f"select * from values {rows} as t(event_id, request_key, ts)")
        jobs.dedupe_batch(batch, n, out)
    got = sorted((r.event_id, r.anchor_id) for r in spark.read.parquet(f"{out}/results").collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 3), (6, 6)]


def test_unreadable_log_ends_the_job(spark, tmp_path):
    out = tmp_path / "out"
    (out / "anchors" / "day=1" / "batch_id=0").mkdir(parents=True)
    (out / "anchors" / "day=1" / "batch_id=0" / "part-0.parquet").write_text("no parquet")
    batch = frame(spark, [(1, "a", 5)])
    with pytest.raises(Exception):
        jobs.dedupe_batch(batch, 1, str(out))


def test_enqueue_over_batches(spark, tmp_path):
    out = str(tmp_path / "queue")
    schema = "received_at int, message_id string, job_id string, requires_human boolean"
    batches = [[(1, "M1", None, True), (2, "M2", None, True), (3, None, None, True)],
               [(4, "M2", None, True), (5, "M0", None, True), (6, None, "", True)],
               [(0, "M1", None, True), (7, "M9", None, False), (8, "M8", None, True)]]
    for n, rows in enumerate(batches):
        jobs.enqueue_batch(spark.createDataFrame(rows, schema), n, out, ("received_at",))
        if n == 1:  # a replay
            jobs.enqueue_batch(spark.createDataFrame(rows, schema), n, out, ("received_at",))
    got = sorted(r.received_at for r in spark.read.parquet(out).collect())
    assert got == [1, 2, 3, 5, 6, 8]


def test_dedupe_over_batches(spark, tmp_path):
    rows = sorted(requests(2), key=lambda r: (r[2], r[0]))
    source = tmp_path / "in"
    schema = frame(spark, rows[:1]).schema
    for n in range(4):
        part = rows[n * len(rows) // 4:(n + 1) * len(rows) // 4]
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(source / f"p{n}"))
    out = str(tmp_path / "out")
    for n in range(4):
        batch = spark.read.schema(schema).parquet(str(source / f"p{n}"))
        jobs.dedupe_batch(batch, n, out)
        if n == 2:  # a replay overwrites its own output
            jobs.dedupe_batch(batch, n, out)
    got = {r.event_id: (r.anchor_id, r.duplicate)
           for r in spark.read.parquet(f"{out}/results").collect()}
    assert got == brute_force(rows)


def test_admission_equals_simulation(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), i * 600, rnd.random() < 0.7, rnd.choice([5, 50, 50, 50, 90]))
            for i in range(400)]
    used_session, used_day, want = {}, {}, {}
    for i, session, t, ok, size in rows:
        day = t // 86400
        if size < 15:
            want[i] = "too_short"
        elif size > 80:
            want[i] = "too_long"
        elif used_session.get((session, day), 0) >= 3:
            want[i] = "session"
        elif used_day.get(day, 0) >= 7:
            want[i] = "day"
        else:
            want[i] = None
            used_day[day] = used_day.get(day, 0) + 1
            used_session[session, day] = used_session.get((session, day), 0) + ok
    df = spark.createDataFrame(
        [(i, s, t, ok, "x" * n) for i, s, t, ok, n in rows],
        "event_id long, session_id string, s long, succeeded boolean, body string").withColumn(
        "ts", F.expr("timestamp_seconds(1704067200 + s)::timestamp_ntz"))
    got = A.admit(df, max_chars=80, per_day=7).collect()
    assert {r.event_id: r.refusal for r in got} == want
    assert {r.refusal for r in A.admit(df, enabled=False).collect()} == {"disabled"}


@pytest.mark.parametrize("width", [None, 60, 5000])
def test_policy_as_of(spark, width):
    history = spark.createDataFrame([(0, 0.8), (5000, 0.9), (9000, 0.7)], "s long, a double")
    history = history.selectExpr("timestamp_seconds(s)::timestamp_ntz valid_from", "a")
    facts = spark.range(-2, 31).selectExpr(
        "id", "timestamp_seconds(nullif(id, 30) * 500)::timestamp_ntz ts")
    got = {r.id: r.policy and r.policy.a for r in P.as_of(
        facts, "ts", history, ["a"], width_s=width).collect()}
    assert got == {i: None if i < 0 or i == 30 else 0.8 if i < 10 else 0.9 if i < 18 else 0.7
                   for i in range(-2, 31)}


def test_policy_as_of_many_rows(spark):
    """A burst of rows, long gaps, equal times, facts on the edges; no pairs are tried out."""
    import random
    rng = random.Random(3)
    times = [rng.randrange(0, 200) for _ in range(150)] + [rng.randrange(0, 10 ** 6) for _ in range(80)]
    rows = [(t, rng.randrange(1000)) for t in times + times[:20]]
    asked = [rng.choice(times) + rng.choice((-1, 0, 1)) for _ in range(300)] + [
        rng.randrange(-100, 2 * 10 ** 6) for _ in range(300)]
    history = spark.createDataFrame(rows, "s long, a long").selectExpr(
        "timestamp_seconds(s)::timestamp_ntz valid_from", "a")
    facts = spark.createDataFrame(list(enumerate(asked)), "id long, s long").selectExpr(
        "id", "timestamp_seconds(s)::timestamp_ntz ts", "'x' as policy_id")
    found = P.as_of(facts, "ts", history, ["a"])
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {r.id: r.policy and r.policy.a for r in found.collect()}
    for i, t in enumerate(asked):
        before = [r for r in rows if r[0] <= t]
        assert got[i] == (max(before)[1] if before else None)
    assert P.as_of(facts, "ts", history.limit(0), ["a"]).where("policy is null").count() == len(asked)
    assert P.as_of(facts.limit(0), "ts", history, ["a"]).count() == 0


def test_policy_rows(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' valid_from, 'a' updated_by, "
                   "0.5d seuil_auto, 9 unknown").unionByName(
        spark.sql("select timestamp_ntz'2024-01-02' valid_from, 'b' updated_by"),
        allowMissingColumns=True)
    ok, refused = P.policy_rows(df)
    assert [r.updated_by for r in ok.collect()] == ["b"]
    assert ok.first()["hitl_force_priorities"] == ["haute"]
    assert [r.updated_by for r in refused.collect()] == ["a"]
