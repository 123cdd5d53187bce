"""Closed days of reports: merged without losing or doubling a row, also where a run fails."""

import datetime as dt

import pytest

from veilwatch.sources.report_days import ReportDays
from veilwatch.sources.reports import write_reports


def _batch(spark, *rows):
    made = [(i, dt.date(2024, 5, d)) for i, d in rows]
    return spark.createDataFrame(made, "event_id long, report_date date")


def _ids(days):
    return sorted((r["event_id"], r["report_date"].day) for r in days.read().collect())


def test_two_streams_a_late_batch_and_failures(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "reports")
    days = ReportDays(spark, path)
    assert days.read() is None and days.compact("2024-06-01") == []
    want = []
    for n in range(4):
        for k, stream in enumerate("ab"):
            rows = [(100 * k + 10 * n, 1), (100 * k + 10 * n + 1, 2 if n < 3 else 3)]
            write_reports(_batch(spark, *rows), path, f"{stream}-{n}")
            want += rows
    assert _ids(days) == sorted(want)

    # a failure between the table and its manifest
    with monkeypatch.context() as broken:
        broken.setattr(ReportDays, "_announce", _lost)
        with pytest.raises(RuntimeError):
            days.compact("2024-05-03")
    assert _ids(days) == sorted(want)

    # a failure after the manifest: merged folders are still there
    with monkeypatch.context() as broken:
        broken.setattr(ReportDays, "_expire", lambda self: None)
        assert days.compact("2024-05-03") == ["2024-05-01", "2024-05-02"]
    assert len(days.batches()["2024-05-01"]) == 8 and _ids(days) == sorted(want)

    assert days.compact("2024-05-03") == []
    assert days.batches()["2024-05-01"] == ["ba-3", "bb-3"]  # the newest of each stream stays
    assert _ids(days) == sorted(want)

    # the newest batch runs again, an older one too, and a late one arrives from a new checkpoint
    write_reports(_batch(spark, (30, 1), (31, 3)), path, "a-3")
    write_reports(_batch(spark, (0, 1), (1, 2)), path, "a-0")
    write_reports(_batch(spark, (900, 1)), path, "c-0")
    write_reports(_batch(spark, (901, 1)), path, "c-1")
    want += [(900, 1), (901, 1)]
    assert _ids(days) == sorted(want)
    assert days.compact("2024-05-03") == ["2024-05-01"]
    assert _ids(days) == sorted(want)
    assert len(days._names(f"{path}/_closed", "run=")) == 2 and days._names(f"{path}/_days/2024-05-01") == ["2"]


def _lost(self, manifest):
    raise RuntimeError("lost")
