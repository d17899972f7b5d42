"""Rewrites against brute force over random rows, and their independence of layout."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest

from clinic import at, clinic, culture, order, stay, values
from staycohort import operators as op

HOT = 10


def hadm(rng):
    """A third of the rows and more belong to one admission."""
    return HOT if rng.random() < 0.4 else rng.randrange(11, 16)


def when(rng):
    """Whole hours, so that starts often meet the window bounds exactly."""
    return at(rng.randrange(-200, 200))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    cultures = [
        culture(
            microevent_id=i,
            hadm_id=hadm(rng),
            charttime=when(rng),
            org_name=rng.choice(["ESCHERICHIA COLI", "KLEBSIELLA PNEUMONIAE"]),
            interpretation=rng.choice("RSI"),
        )
        for i in range(120)
    ]
    orders = []
    for _ in range(150):
        start = when(rng)
        stop = start + timedelta(minutes=rng.randrange(-5000, 9000))
        orders.append(order(start, stop, rng.choice(["Meropenem", "Insulin"]), hadm(rng)))
    stays = []
    for i in range(40):
        first = when(rng)
        stays.append(stay(i, hadm(rng), first, first + timedelta(hours=rng.randrange(-20, 150))))
    return clinic(
        spark,
        cultures=cultures,
        prescriptions=orders,
        stays=stays,
        patients=[{"subject_id": 1, "gender": "M"}],
        admissions=[{"hadm_id": h} for h in range(10, 16)],
    )


def starts_by_admission(tables):
    starts = defaultdict(list)
    for row in tables.prescriptions.collect():
        if row.drug == "Meropenem":
            starts[row.hadm_id].append(row.starttime)
    return starts


@pytest.mark.parametrize("spread", [None, "microevent_id"])
@pytest.mark.parametrize("before, after", [(48, 48), (24, 72), (7, None), (None, 5), (0, 48), (48, 0)])
def test_exposure(tables, before, after, spread):
    starts = starts_by_admission(tables)
    expected = []
    for row in tables.cultures.collect():
        gaps = [(start - row.charttime) / timedelta(hours=1) for start in starts[row.hadm_id]]
        prior = any(-before <= gap < 0 for gap in gaps) if before is not None else None
        post = any(0 <= gap <= after for gap in gaps) if after is not None else None
        expected.append((row.microevent_id, prior, post))
    flagged = op.treatment_exposure(
        tables.cultures, tables.prescriptions, before, after, spread=spread
    )
    if before is None:
        flagged = flagged.selectExpr("*", "NULL AS has_prior_treatment")
    if after is None:
        flagged = flagged.selectExpr("*", "NULL AS has_post_treatment")
    columns = ["microevent_id", "has_prior_treatment", "has_post_treatment"]
    assert values(flagged, *columns) == sorted(expected, key=repr)


@pytest.mark.parametrize("before, after", [(48, 48), (0, 0), (24, 72)])
def test_a_column_named_like_a_flag_is_replaced(tables, before, after):
    plain = op.treatment_exposure(tables.cultures, tables.prescriptions, before, after)
    clashing = tables.cultures.selectExpr("*", "'x' AS has_prior_treatment", "'y' AS has_post_treatment")
    flagged = op.treatment_exposure(clashing, tables.prescriptions, before, after)
    assert sorted(flagged.columns) == sorted(plain.columns)
    columns = ["microevent_id", "has_prior_treatment", "has_post_treatment"]
    assert values(flagged, *columns) == values(plain, *columns)


@pytest.mark.parametrize("spread", [None, "microevent_id"])
def test_any_earlier_treatment(tables, spread):
    starts = starts_by_admission(tables)
    expected = [
        (row.microevent_id, any(start < row.charttime for start in starts[row.hadm_id]))
        for row in tables.cultures.collect()
    ]
    flagged = op.treated_ever_before(tables.cultures, tables.prescriptions, spread=spread)
    assert values(flagged, "microevent_id", "has_prior_treatment") == sorted(expected, key=repr)


@pytest.mark.parametrize("spread", [None, "stay_id"])
def test_stays_per_admission_and_first_stays(tables, spread):
    ids = defaultdict(list)
    for row in tables.stays.collect():
        ids[row.hadm_id].append(row.stay_id)
    counts = op.stays_per_admission(tables.stays)
    assert dict(tuple(row) for row in counts.collect()) == {h: len(s) for h, s in ids.items()}
    first = op.first_stays(tables.stays, 3)
    lowest = [(stay_id, h) for h, s in ids.items() for stay_id in sorted(s)[:3]]
    assert values(first, "stay_id", "hadm_id") == sorted(lowest, key=repr)
    hot = tables.cultures.where(f"hadm_id = {HOT}")
    kept = op.stays_with(tables.stays, hot, spread)
    assert values(kept, "stay_id") == sorted([(s,) for s in ids[HOT]], key=repr)


def mean_hours(tables, row):
    inside = [
        int((o.stoptime - o.starttime) / timedelta(hours=1))
        for o in tables.prescriptions.collect()
        if o.hadm_id == row.hadm_id and o.starttime >= row.intime and o.stoptime <= row.outtime
    ]
    return sum(inside) / len(inside) if inside else None


def test_treatment_hours(tables):
    cases = tables.stays.drop("subject_id").selectExpr("*", "1L AS subject_id", "'B' AS bloque")
    result = op.stay_outcomes(
        cases, tables.patients, tables.admissions, tables.prescriptions
    )
    found = {row.stay_id: row.duracion_tratamiento for row in result.collect()}
    stays = tables.stays.collect()
    assert len(found) == len(stays) == result.count()
    assert any(value is not None for value in found.values())
    for row in stays:
        expected = mean_hours(tables, row)
        if expected is None:
            assert found[row.stay_id] is None
        else:
            assert abs(found[row.stay_id] - expected) <= 0.0500001


def test_numbering_and_first_agree_with_sorting(tables):
    groups = defaultdict(list)
    for row in tables.cultures.collect():
        key = ("RSI".index(row.interpretation), row.charttime, row.microevent_id)
        groups[row.hadm_id, row.org_name].append(key)
    expected = sorted(
        (event, place)
        for rows in groups.values()
        for place, (_, _, event) in enumerate(sorted(rows), 1)
    )
    keys = ("hadm_id", "org_name")
    numbered = op.numbered_cultures(tables.cultures, keys)
    found = sorted(tuple(r) for r in numbered.select("microevent_id", "row_num").collect())
    assert found == expected
    first = op.representative_culture(tables.cultures, keys)
    assert values(first, "microevent_id") == sorted(
        [(event,) for event, place in expected if place == 1], key=repr
    )
