from __future__ import annotations

import math

import pytest

from lectern.operators import screen


def gate(spark, rates, **args):
    df = spark.createDataFrame([("b", i, f"u{i}", float(w)) for i, w in enumerate(rates)], "book_id string, idx long, label string, wps double")
    own = screen.wps_gate(df, **args)
    head = screen.wps_header(own, args.get("low", 1.7), args.get("high", 3.5)).first()
    return {r.idx: (r.reason, r.cause) for r in own.collect() if r.reason}, head, own


def test_clean(spark):
    flags, head, _ = gate(spark, [2.36] * 20)
    assert not flags and head.ok and head.median == 2.36


def test_pair(spark):
    rates = [2.36] * 20
    rates[10], rates[11] = 5.5, 1.59
    flags, head, own = gate(spark, rates)
    assert flags[10][1] == "squished" and flags[11][1] == "slack" and not head.ok
    assert [(r.low_idx, r.high_idx) for r in screen.adjacent_pairs(own).collect()] == [(11, 10)]


def test_association(spark):
    rates = [2.36] * 20
    rates[10], rates[11] = 3.40, 1.85
    assert gate(spark, rates)[0][11][0] == "association"


def test_floor(spark):
    rates = [2.36] * 20
    rates[4] = 1.59
    assert not gate(spark, rates)[1].ok
    assert gate(spark, rates, low=1.5)[1].ok


def test_systematic(spark):
    assert gate(spark, [1.2] * 10)[1].systematic_reason == "band"
    assert gate(spark, [2.36] * 6 + [3.9] * 5)[1].systematic_reason == "majority"


def test_few(spark):
    flags, head, _ = gate(spark, [2.4] * 3)
    assert head.too_few and head.ok
    assert not gate(spark, [2.4, 2.4, 0.5])[1].ok


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_not_finite(spark, bad):
    flags, head, _ = gate(spark, [2.36] * 8 + [bad])
    assert flags == {8: ("non-finite", "slack")} and head.median == 2.36 and not head.ok


@pytest.mark.parametrize("args", [{"tol": math.nan}, {"tol": math.inf}, {"low": math.nan}, {"high": math.inf}, {"low": 4.0}, {"tol": -1.0}])
def test_thresholds(spark, args):
    with pytest.raises(ValueError):
        gate(spark, [2.4] * 3, **args)
