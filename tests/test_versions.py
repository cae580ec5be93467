"""Versions of tables, and ranks of numbers that are no whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from sortdesk.operators import audit
from sortdesk.operators import evaluation as E
from sortdesk.sources import versions


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_appends_and_merges(spark, tmp_path):
    path = str(tmp_path)
    assert versions.read(spark, path, "log") is None
    for i in range(4):
        versions.append(path, "log", spark.range(10 * i, 10 * i + 10))
    versions.append(path, "other", spark.range(3))
    assert len(versions.folders(spark, path)["log"]) == 4
    versions.compact(spark, path, "log")
    assert len(versions.folders(spark, path)["log"]) == 1
    assert ids(versions.read(spark, path, "log")) == list(range(40))
    versions.append(path, "log", spark.range(40, 41))
    assert ids(versions.read(spark, path, "log")) == list(range(41))
    assert ids(versions.read(spark, path, "other")) == [0, 1, 2]


def test_a_run_that_ends_in_between_leaves_the_log_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    versions.append(path, "log", spark.range(5))
    versions.append(path, "log", spark.range(5, 9))

    def killed(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", killed)
        for step in (lambda: versions.compact(spark, path, "log"),
                     lambda: versions.append(path, "log", spark.range(100))):
            with pytest.raises(KeyboardInterrupt):
                step()
    assert ids(versions.read(spark, path, "log")) == list(range(9))
    (tmp_path / "manifests" / "000000000009-half" / "_temporary").mkdir(parents=True)
    assert ids(versions.read(spark, path, "log")) == list(range(9))
    versions.compact(spark, path, "log")
    assert ids(versions.read(spark, path, "log")) == list(range(9))


def test_two_commits_of_one_number_are_found_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    versions.append(path, "log", spark.range(1))
    monkeypatch.setattr(versions, "_next", lambda *_: 2)
    failed = 0
    for i in range(2):
        try:
            versions.append(path, "log", spark.range(1))
        except RuntimeError:
            failed += 1
    now = versions.folders(spark, path)["log"]
    assert len(set(now)) == len(now) and failed <= 1


def test_snapshot_is_one_unit(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    cases = spark.createDataFrame([(1, "a@x.fr")], "case_id long, email_from string")
    assert audit.read_snapshot(spark, path) is None
    assert audit.export_snapshot(cases, cases.limit(0), cases, path)
    more = cases.unionByName(cases)
    stored = versions._stored

    def breaks(df, where, table):
        if table == "decisions":
            raise OSError("disk full")
        return stored(df, where, table)
    with monkeypatch.context() as m:
        m.setattr(versions, "_stored", breaks)
        with pytest.raises(OSError):
            audit.export_snapshot(more, more, cases, path)
    kept, decisions = audit.read_snapshot(spark, path)
    assert (kept.count(), decisions.count()) == (1, 0)
    assert audit.export_snapshot(more, more, cases, path)
    kept, decisions = audit.read_snapshot(spark, path)
    assert (kept.count(), decisions.count()) == (2, 2)
    assert not audit.export_snapshot(more, more, cases.limit(0), path)


@pytest.mark.parametrize("kind", ["uniform", "steep", "ties", "few"])
def test_floored_rank_of_doubles(spark, monkeypatch, kind):
    monkeypatch.setattr(E, "SORTED_ROWS", 50)
    rng = random.Random(4)
    draw = {"uniform": lambda: rng.random(), "steep": lambda: 10 ** rng.uniform(-300, 300),
            "ties": lambda: rng.choice([0.5] * 8 + [rng.random()]), "few": lambda: rng.choice([1.5, 2.5])}[kind]
    groups = {"a": [draw() for _ in range(3000)], None: [draw() for _ in range(700)], "one": [draw()],
              "two": [draw(), draw()]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.p95 for r in E.floored_rank(df, "x", ["g"]).collect()}
    want = {g: 0.0 if len(xs) < 2 else sorted(xs)[int(0.95 * len(xs)) - 1] for g, xs in groups.items()}
    assert got == want
    whole = E.floored_rank(df.where("g = 'a'"), "x", [], share=0.5, out="median").collect()
    assert [tuple(r) for r in whole] == [(sorted(groups["a"])[1499],)]
    assert E.floored_rank(df.limit(0), "x", ["g"]).count() == 0
    exact = df.select("g", F.col("x").try_cast("decimal(30,10)").alias("x")).where("g = 'two'")
    assert E.floored_rank(exact, "x", ["g"]).count() == (kind != "steep" or not exact.where(
        "x is not null").isEmpty())
