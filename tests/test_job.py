"""The job's steps: one parse, going on after a failure, dated output, counts."""

from datetime import datetime, timedelta

import pytest

from tests import fold
from tests.data import edge_list, random_readings
from tests.test_sources import HEADER, write_csv
from tripfold.plans import job
from tripfold.schema import HotRule
from tripfold.sources.dated import read_days


@pytest.fixture
def inputs(tmp_path):
    rows = list({(r[1], r[3]): r for r in random_readings(11, 15)}.values())
    broken = [("never", 1, "t", "gate1"), ("2015-05-01 00:00:00", "", "t", "gate1")]
    readings = write_csv(tmp_path / "r.csv", HEADER, [(r[3], r[1], r[2], r[4]) for r in rows] + broken)
    edges = write_csv(tmp_path / "e.csv", "source,target,distance\n", [*edge_list(), ("a", "b", "NaN")])
    return rows, readings, edges


def scans(spark, monkeypatch):
    """Paths of the CSV tables read, as they are asked for."""
    asked, read = [], job.read_named

    def named(spark, path, names):
        asked.append(path)
        return read(spark, path, names)

    monkeypatch.setattr(job, "read_named", named)
    monkeypatch.setattr("tripfold.sources.readings.read_named", named)
    return asked


def test_counts_and_one_parse(spark, tmp_path, inputs, monkeypatch):
    rows, readings, edges = inputs
    asked = scans(spark, monkeypatch)
    written, write = [], job.write_parquet

    def seen(rows, path, *args, **options):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        written.append((path.rsplit("/", 1)[1], plan.count(" csv")))
        return write(rows, path, *args, **options)

    monkeypatch.setattr(job, "write_parquet", seen)
    counts = job.run(spark, readings, edges, str(tmp_path / "v"), str(tmp_path / "t"))
    summary = fold.summary(rows, fold.multimap(edge_list()))
    assert counts == {
        "readings": len(rows), "rejected_readings": 2, "edges": len(edge_list()), "rejected_edges": 1,
        "repaired_trips": len(fold.repaired(summary)), "visits": len(fold.visits(fold.repaired(summary))),
    }
    # One scan of each CSV, in one write; nothing after that reads one.
    assert asked == [readings, edges]
    assert written == [("readings", 1), ("edges", 1), ("repaired_trips", 0), ("visits", 0)]
    assert spark.read.json(str(tmp_path / "t")).count() == counts["repaired_trips"]
    # Nothing is left to do.
    assert job.run(spark, readings, edges, str(tmp_path / "v"), str(tmp_path / "t")) == counts
    assert len(written) == 4 and asked == [readings, edges]


def test_a_failed_run_goes_on(spark, tmp_path, inputs, monkeypatch):
    rows, readings, edges = inputs
    fails = {"on": True}
    visits_of = job.visits_of

    def broken(*args):
        if fails["on"]:
            raise RuntimeError("lost")
        return visits_of(*args)

    monkeypatch.setattr(job, "visits_of", broken)
    with pytest.raises(RuntimeError, match="lost"):
        job.run(spark, readings, edges, str(tmp_path / "v"))
    asked = scans(spark, monkeypatch)
    fails["on"] = False
    made, step = [], job.journey_repaired
    monkeypatch.setattr(job, "journey_repaired", lambda *args: made.append(1) or step(*args))
    counts = job.run(spark, readings, edges, str(tmp_path / "v"))
    assert asked == [] and made == []
    assert spark.read.json(str(tmp_path / "v")).count() == counts["visits"] > 0
    with pytest.raises(ValueError, match="another run"):
        job.run(spark, edges, edges, str(tmp_path / "v"))


def test_rows_without_counts_are_written_again(spark, tmp_path, inputs):
    _, readings, edges = inputs
    work = job.Work(spark, str(tmp_path / "w"))
    (tmp_path / "w" / "readings").mkdir(parents=True)
    (tmp_path / "w" / "readings" / "left.parquet").write_text("half a file")
    assert work.counts("readings") is None
    counts = job.run(spark, readings, edges, str(tmp_path / "v"), work_path=str(tmp_path / "w"))
    assert work.rows("readings").count() == counts["readings"] + counts["rejected_readings"]


def test_dated_trips_prune_and_are_replaced_by_date(spark, tmp_path, inputs):
    rows, readings, edges = inputs
    table = str(tmp_path / "dated")
    first = job.run(spark, readings, edges, str(tmp_path / "v"), dated_path=table)
    back = spark.read.parquet(table)
    assert back.count() == first["repaired_trips"]
    before = back.collect()
    day = min(r.date for r in before)
    assert "PartitionFilters: [isnotnull(date" in back.where(back.date == day)._jdf.queryExecution().toString()
    # A later run of one new entity on that day alone replaces that date, and no other.
    time = datetime(day.year, day.month, day.day, 5)
    later = [(time, "new", "t", "entrance1"), (time + timedelta(hours=1), "new", "t", "entrance2")]
    more = write_csv(tmp_path / "r2.csv", HEADER, later)
    job.run(spark, more, edges, str(tmp_path / "v2"), dated_path=table)
    now = spark.read.parquet(table).collect()
    assert [r.entity_id for r in now if r.date == day] == ["new"]
    assert len([r for r in now if r.date != day]) == len([r for r in before if r.date != day])


def test_days_are_read_by_text(spark, tmp_path, inputs):
    rows, readings, edges = inputs
    table = str(tmp_path / "dated")
    job.run(spark, readings, edges, str(tmp_path / "v"), dated_path=table)
    every = sorted(r.date for r in spark.read.parquet(table).collect())
    first, last = every[2], every[-3]
    some = read_days(spark, table, str(first), str(last))
    assert sorted(r.date for r in some.collect()) == [d for d in every if first <= d <= last]
    assert "PartitionFilters: [isnotnull(date" in some._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="1 May"):
        read_days(spark, table, "1 May", str(last))


def test_hot_entities_give_the_same_files(spark, tmp_path, inputs):
    _, readings, edges = inputs
    plain = job.run(spark, readings, edges, str(tmp_path / "v"))
    hot = job.run(spark, readings, edges, str(tmp_path / "h"), heat=HotRule(buckets=64, factor=1.5, min_rows=20))
    assert plain == hot
    rows = [sorted(map(repr, spark.read.json(str(tmp_path / n)).collect())) for n in ("v", "h")]
    assert rows[0] == rows[1]
