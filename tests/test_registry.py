"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, sql, SF) in ("", "both empty")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_rows_read_every_interval(spark):
    from undula.plans.bindings import iv
    from undula.plans.q_tag import KINDS, blocked_spans

    spans = blocked_spans(spark, SF)
    assert spans.count() == iv(spark, SF).count()
    assert {r.kind for r in spans.select("kind").distinct().collect()} == set(KINDS)
    rows = entry.queries()["m6_all_intervals"](spark, SF).collect()
    assert any(r.clear_pt for r in rows) and any(r.clear_sp for r in rows)


def test_training_rows_give_every_window(spark):
    from undula.plans.q_tag import ev_grid

    r = {(x.rec_id, x.start): x for x in entry.queries()["m6_training_rows"](spark, SF).collect()}
    assert set(r) == {(x.rec_id, x.start) for x in ev_grid(spark, SF).filter("y = 2").collect()}
    clear = {(x.rec_id, x.start, x.clear_pt, x.clear_sp) for x in entry.queries()["m6_all_intervals"](spark, SF).collect()}
    assert {(*k, x.clear_pt, x.clear_sp) for k, x in r.items() if x.clear_pt or x.clear_sp} == clear
    assert any(x.mean_pt for x in r.values()) and any(x.mean_sp for x in r.values())


def test_the_resample_grid_comes_from_the_resampler(spark, monkeypatch):
    from undula.plans import q_window

    real = q_window.resample.resample_windows
    monkeypatch.setattr(q_window.resample, "resample_windows", lambda df, i, o, *a: real(df, i, o // 2, *a))
    assert {r.g for r in entry.queries()["r2_resample_grid"](spark, SF).collect()} == set(range(160))
