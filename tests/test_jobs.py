"""The jobs over input that grows, late and repeated runs, and their registered queries."""

import datetime as dt
import json
import logging
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, risk_snapshots, source_measures
from jobs.common import config, overwrite_partitions
from tests.compare import normal


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert normal(queries.QUERIES[name](spark, sf_dir).toPandas()).equals(normal(con.sql(queries.ORACLES[name]).df()))


CODE = "\n".join(["def f(x):"] + ["  y = 1"] * 6)
FIRST = [(1, CODE, "a", 0), (2, CODE.replace("y", "other"), "a", 0), (3, "fix: assert this\n\nexpect", "a", 0), (4, None, None, 0), (5, CODE, "b", 0)]
SECOND = [(6, CODE, "b", 0), (7, "", "", 0), (8, "x", None, 0), (8, "x", None, 0)]
DOCUMENTS = "doc_id long, text string, source string, bucket int"


def summary_of(rows):
    out = {}
    for source in {r[2] for r in rows}:
        own = [r[1] or "" for r in rows if r[2] == source]
        code = sum(t.startswith("def") for t in own)
        twice = code if code > 1 else 0
        loc = sum(bool(line.strip()) for t in own for line in t.split("\n"))
        out[source] = (len(own), loc, sum(t.count("assert") + t.count("expect") for t in own), sum("fix" in t for t in own), twice, 7 * twice, pytest.approx(min(100.0, 7 * twice / loc * 150) if twice else 0.0))
    return out


def read_summary(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_measures_take_only_new_files(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    settings = config("source_measures") | {"max_files_per_trigger": 1}
    spark.createDataFrame(FIRST, DOCUMENTS).coalesce(1).write.parquet(source)
    assert read_summary(source_measures.run(spark, source, out, settings)) == summary_of(FIRST)
    assert "read 5 new texts" in caplog.text and "rows 5" in caplog.text
    caplog.clear()
    spark.createDataFrame(SECOND, DOCUMENTS).coalesce(1).write.mode("append").parquet(source)
    assert read_summary(source_measures.run(spark, source, out, settings)) == summary_of(FIRST + SECOND)
    assert "read 4 new texts" in caplog.text
    caplog.clear()
    assert read_summary(source_measures.run(spark, source, out, settings)) == summary_of(FIRST + SECOND)
    assert "read 0 new texts" in caplog.text and "nothing is new" in caplog.text


def test_measures_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that failed after it wrote, and a summary that was never marked, are simply done again."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    settings = config("source_measures")
    spark.createDataFrame(FIRST, DOCUMENTS).write.parquet(source)

    def fails(df, path, *by):
        overwrite_partitions(df, path, *by)
        raise RuntimeError("lost")

    monkeypatch.setattr(source_measures, "overwrite_partitions", fails)
    with pytest.raises(Exception, match="lost"):
        source_measures.run(spark, source, out, settings)
    monkeypatch.setattr(source_measures, "overwrite_partitions", lambda df, path, *by: (fails if path.endswith("summary") else overwrite_partitions)(df, path, *by))
    with pytest.raises(Exception, match="lost"):
        source_measures.run(spark, source, out, settings)
    monkeypatch.undo()
    assert read_summary(source_measures.run(spark, source, out, settings)) == summary_of(FIRST)


def test_measures_of_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], DOCUMENTS).write.parquet(source)
    assert source_measures.run(spark, source, str(tmp_path / "out"), config("source_measures")).count() == 0


EVENTS = "props string, user_id long, event_type string, ts timestamp_ntz, path string, period string"


def event(day, path="a", user=1, kind="view", hour=1):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
    return (json.dumps({"k": path}) if path else None, user, kind, at, "clash", "clash")


def snapshots_of(rows, days):
    """Plain snapshots for periods of ``days`` from 2024-01-01, a Monday."""
    rows = [(json.loads(p)["k"], str(u), k == "error", t) for p, u, k, t, *_ in rows if p and t]
    begin = dt.datetime(2024, 1, 1)
    index = [(t - begin).days // days for *_, t in rows]
    out = {}
    for i in range(min(index), max(index) + 1):
        end = begin + dt.timedelta(days=days * (i + 1))
        for path in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == path and r[3] < end]
            if own:
                age = [(end - r[3]).total_seconds() for r in own]
                weight = [0.5 ** (a / (86400 * 30.44) / 6) for a in age]
                density = sum(w for w, r in zip(weight, own) if r[2]) / sum(weight)
                recent, authors = sum(a <= 90 * 86400 for a in age), len({r[1] for r in own})
                risk = min(100.0, density * 60 + min(100.0, recent / 90 * 100) * 0.2 + min(100.0, authors * 10) * 0.2)
                out[(path, (end - dt.timedelta(days=days)).date())] = (len(own), sum(r[2] for r in own), authors, recent, pytest.approx(density), pytest.approx(risk))
    return out


def read_snapshots(df):
    return {(r.path, r.period): (r.commits, r.incidents, r.authors, r.recent_commits, r.incident_density, r.change_risk) for r in df.collect()}


@pytest.mark.parametrize("unit,days", [("week", 7), ("day", 1)])
def test_snapshots_of_growing_input(spark, tmp_path, caplog, unit, days):
    caplog.set_level(logging.INFO)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    settings = config("risk_snapshots") | {"period": unit}

    def add(rows):
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(source)

    first = [event(0), event(1, kind="error", user=2), event(3, "b"), event(20, "b", user=3, hour=0), event(20, None), (json.dumps({"k": "a"}), 1, "view", None, "", "")]
    add(first)
    assert read_snapshots(risk_snapshots.run(spark, source, out, settings)) == snapshots_of(first, days)
    caplog.clear()
    second = [event(110, "c", kind="error"), event(111, "a", user=4)]
    add(second)
    assert read_snapshots(risk_snapshots.run(spark, source, out, settings)) == snapshots_of(first + second, days)
    assert "commits read: rows 2" in caplog.text
    caplog.clear()
    again = risk_snapshots.run(spark, source, out, settings)
    assert read_snapshots(again) == snapshots_of(first + second, days) and "commits read" not in caplog.text
    late = [event(19, "d", hour=23), event(1, "a", user=9, kind="error")]
    add(late)
    assert read_snapshots(risk_snapshots.run(spark, source, out, settings)) == snapshots_of(first + second + late, days)
    trends = {r.path: r.trend_coefficient for r in spark.read.parquet(f"{out}/trends").collect()}
    held = snapshots_of(first + second + late, days)
    for path in "abcd":
        risks = [v[5].expected for k, v in sorted(held.items()) if k[0] == path]
        mean = sum(risks) / len(risks)
        delta = max(-0.3, min(0.3, (mean - risks[-1]) / max(mean, 1)))
        assert trends[path] == pytest.approx(min(1.09, max(0.91, 1 - 0.3 * delta)))


def test_snapshots_after_a_failure(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [event(0), event(9, "b", kind="error")]
    spark.createDataFrame(rows, EVENTS).write.parquet(source)

    def fails(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(risk_snapshots, "snapshots_of", fails)
    with pytest.raises(RuntimeError):
        risk_snapshots.run(spark, source, out, config("risk_snapshots"))
    monkeypatch.undo()
    assert read_snapshots(risk_snapshots.run(spark, source, out, config("risk_snapshots"))) == snapshots_of(rows, 7)


def test_settings_stay_as_they_were(spark, sf_dir, tmp_path):
    before = Counter({k: v for k, v in spark.sparkContext.getConf().getAll()}), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    risk_snapshots.run(spark, f"{sf_dir}/events.parquet", str(tmp_path / "out"), config("risk_snapshots")).count()
    assert before == (Counter({k: v for k, v in spark.sparkContext.getConf().getAll()}), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))
    assert not spark.streams.active


def test_command_lines_need_paths():
    for name in ("source_measures", "risk_snapshots"):
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}"], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
        assert done.returncode == 2 and "--input" in done.stderr


def test_measures_on_odd_texts(spark):
    rows = source_measures.measured(spark.createDataFrame([(1, "a\r\n\tb\n", "s", 0), (2, "\n" * 3, "s", 0), (3, "é = 日本 + 12", "s", 0)], DOCUMENTS), 0, 4).orderBy("doc_id").collect()
    assert [(r.lines, r.loc) for r in rows] == [(3, 2), (4, 0), (1, 1)]
    assert source_measures.measured(spark.createDataFrame([(1, "x = 1", "s", 0), (1, "yy = 23", "s", 0)], DOCUMENTS), 0, 4).select(F.countDistinct("structure")).first()[0] == 1
