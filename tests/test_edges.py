"""Hand-made boundary rows with hand-computed answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clinic import T0, at, clinic, culture, only, order, stay, table, values
from staycohort import operators as op
from staycohort import report
from staycohort.functions import days_between, hours_between, starts_with_any
from staycohort.operators.outcomes import _DAY_ZERO, _tiles
from staycohort.schemas import SCHEMAS


def test_null_specimen_is_dropped_like_a_listed_one(spark):
    rows = [
        culture(microevent_id=1, spec_type_desc=None),
        culture(microevent_id=2, spec_type_desc="Swab"),
        culture(microevent_id=3, spec_type_desc="URINE"),
    ]
    kept = op.exclude_specimens(table(spark, "cultures", rows))
    assert values(kept, "microevent_id") == [(3,)]


def test_longer_organism_name_only_matches_by_part(spark):
    rows = [culture(org_name="ACINETOBACTER BAUMANNII COMPLEX")]
    cultures = table(spark, "cultures", rows)
    assert op.target_organisms(cultures, "contains").count() == 1
    assert op.target_organisms(cultures, "exact").count() == 0
    with pytest.raises(ValueError):
        op.target_organisms(cultures, "prefix")


def test_parts_of_names_are_taken_literally(spark):
    names = ["FLUID, OTHER (A.B)", "fluid, other (axb)", "it's + one", None]
    rows = [culture(microevent_id=i, org_name=name) for i, name in enumerate(names)]
    cultures = table(spark, "cultures", rows)
    kept = op.target_organisms(cultures, "contains", ["other (a.b)", "'s + o"])
    assert values(kept, "microevent_id") == [(0,), (2,)]
    exact = op.target_organisms(cultures, "exact", ["it's + one", "back\\slash"])
    assert values(exact, "microevent_id") == [(2,)]


def test_tie_goes_to_the_lower_microevent_id(spark):
    rows = [
        culture(microevent_id=7, ab_name="CEFEPIME"),
        culture(microevent_id=5, ab_name="MEROPENEM"),
        culture(microevent_id=6, ab_name="IMIPENEM"),
    ]
    first = op.representative_culture(table(spark, "cultures", rows), ("hadm_id", "org_name"))
    assert values(first, "microevent_id", "ab_name") == [(5, "MEROPENEM")]


def test_result_comes_before_time(spark):
    rows = [
        culture(microevent_id=1, interpretation="I", charttime=at(-3)),
        culture(microevent_id=2, interpretation="S", charttime=at(-2)),
        culture(microevent_id=3, interpretation="R", charttime=at(5)),
        culture(microevent_id=4, interpretation="R", charttime=at(4)),
    ]
    cultures = table(spark, "cultures", rows)
    first = op.representative_culture(cultures, ("hadm_id", "org_name"))
    assert values(first, "microevent_id") == [(4,)]
    places = op.numbered_cultures(cultures, ("hadm_id", "org_name"))
    assert values(places, "row_num", "microevent_id") == [(1, 4), (2, 3), (3, 2), (4, 1)]


@pytest.mark.parametrize(
    "start, prior, post",
    [
        (at(0), False, True),
        (at(-48), True, False),
        (at(-48, microseconds=-1), False, False),
        (at(0, microseconds=-1), True, False),
        (at(48), False, True),
        (at(48, microseconds=1), False, False),
        (at(-1000), False, False),
    ],
)
def test_exposure_bounds(spark, start, prior, post):
    cultures = table(spark, "cultures", [culture()])
    orders = table(spark, "prescriptions", [order(start)])
    flagged = op.treatment_exposure(cultures, orders)
    assert values(flagged, "has_prior_treatment", "has_post_treatment") == [(prior, post)]
    ever = op.treated_ever_before(cultures, orders)
    assert only(ever, "has_prior_treatment") is (start < T0)


def test_drug_names_match_whole(spark):
    cultures = table(spark, "cultures", [culture()])
    orders = table(spark, "prescriptions", [order(at(1), drug="Vancomycin HCl")])
    assert only(op.treatment_exposure(cultures, orders), "has_post_treatment") is False


def test_stay_with_two_organisms(spark):
    rows = [
        culture(microevent_id=1),
        culture(microevent_id=2, org_name="STAPHYLOCOCCUS AUREUS"),
    ]
    tables = clinic(spark, stays=[stay()], cultures=rows)
    joined = op.stay_cultures(tables.stays, tables.cultures)
    assert op.single_organism_stays(joined).count() == 0
    classed = op.with_antibiotic_class(op.representative_culture(joined))
    assert op.distinct_cultures(classed).count() == 2
    assert only(report("p06_single_organism", tables), MONO) == 0
    assert only(report("p10_prior_treatment_counts", tables), TOTAL) == 1


MONO = "total_estancias_uci_cultivos_monoinfeccion"
TOTAL = "total_estancias_uci_monoinfeccion"


def test_specimen_filter_can_turn_two_organisms_into_one(spark):
    rows = [
        culture(microevent_id=1),
        culture(microevent_id=2, org_name="STAPHYLOCOCCUS AUREUS", spec_type_desc="SWAB"),
    ]
    tables = clinic(spark, stays=[stay()], cultures=rows)
    assert only(report("p06_single_organism", tables), MONO) == 0
    assert only(report("p07_single_organism_specimen", tables), MONO) == 1


def test_comorbid_admission_is_excluded_without_fan_out(spark):
    codes = [(10, "N186"), (10, "N181"), (11, "J189"), (11, "XN18")]
    tables = clinic(
        spark,
        stays=[stay(100, 10), stay(110, 11)],
        diagnoses=[{"hadm_id": hadm, "icd_code": code} for hadm, code in codes],
    )
    kept = op.exclude_comorbidities(tables.stays, tables.diagnoses)
    assert values(kept, "stay_id") == [(110,)]


def test_antibiotic_class_of_missing_and_split_names(spark):
    names = [None, "TRIMETHOPRIM/SULFA", "DAPTOMYCIN", "GENTAMICIN", "x ceftazidime y"]
    rows = [culture(microevent_id=i, ab_name=name) for i, name in enumerate(names)]
    classed = op.with_antibiotic_class(table(spark, "cultures", rows))
    assert [label for _, label in values(classed, "microevent_id", "antibiotic_class")] == [
        "Otra_clase",
        "Sulfonamidas",
        "Lipopéptidos",
        "Otra_clase",
        "Cefalosporinas_3ra",
    ]


def test_resistance_block(spark):
    pairs = [
        ("Klebsiella Aerogenes", "Cefalosporinas_4ta", "Bloque 1"),
        ("ESCHERICHIA COLI", "Carbapenems", "Bloque 2"),
        ("ACINETOBACTER BAUMANNII", "Carbapenems", "Bloque 3"),
        ("STENOTROPHOMONAS MALTOPHILIA", "Sulfonamidas", "Bloque 4"),
        ("ENTEROCOCCUS FAECIUM", "Lipopéptidos", "Bloque 5"),
        ("STAPHYLOCOCCUS AUREUS", "Glicopéptidos", "Bloque 6"),
        ("PSEUDOMONAS AERUGINOSA", "Cefalosporinas_4ta", "Otros"),
        ("ACINETOBACTER BAUMANNII COMPLEX", "Carbapenems", "Otros"),
        (None, "Carbapenems", "Otros"),
    ]
    schema = "org_name STRING, antibiotic_class STRING, expected STRING"
    blocks = op.with_resistance_block(spark.createDataFrame(pairs, schema))
    assert blocks.where("bloque <> expected").count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_and_hours(spark, zone):
    """The second zone skips an hour on 10 March 2024; zone-free times must not notice."""
    day = datetime(2024, 3, 10)
    spans = [
        (day.replace(hour=0, minute=59), day.replace(hour=1, minute=1), 0),
        (day.replace(hour=2), day.replace(hour=0, minute=30), -1),
        (day.replace(hour=1), day.replace(hour=4), 3),
        (day.replace(hour=2, minute=30), day.replace(hour=3), 0),
        (day, datetime(2024, 3, 12, 1, 30), 49),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        orders = table(spark, "prescriptions", [order(a, b, hadm_id=h) for a, b, h in spans])
        hours = orders.select("hadm_id", hours_between("starttime", "stoptime").alias("h"))
        assert hours.where("h <> hadm_id OR h IS NULL").count() == 0
        window = stay(intime=datetime(2024, 1, 1, 23, 59), outtime=datetime(2024, 1, 2, 0, 1))
        stays = table(spark, "stays", [window])
        assert stays.select(days_between("intime", "outtime")).head()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def outcomes(spark, windows, orders=(), deathtime=None):
    """Outcomes of one case per window, all in admission 10 and block `Bloque 1`."""
    tables = clinic(
        spark,
        stays=[stay(i, 10, a, b) for i, (a, b) in enumerate(windows)],
        patients=[{"subject_id": 1, "gender": "M"}],
        admissions=[{"hadm_id": 10, "deathtime": deathtime}],
        prescriptions=list(orders),
    )
    cases = tables.stays.drop("subject_id").selectExpr(
        "*", "1L AS subject_id", "'Bloque 1' AS bloque"
    )
    return op.stay_outcomes(
        cases, tables.patients, tables.admissions, tables.prescriptions
    )


@pytest.mark.parametrize(
    "death, died, better",
    [(at(50), 1, 0), (at(50, microseconds=1), 0, 0), (at(0), 1, 0), (None, 0, 1)],
)
def test_death_counts_inside_the_stay_bounds(spark, death, died, better):
    result = outcomes(spark, [(at(0), at(50))], deathtime=death)
    assert values(result, "fallecio_en_uci", "mejoria") == [(died, better)]


def test_improvement_ends_after_thirty_days(spark):
    result = outcomes(spark, [(at(0), at(days=30)), (at(0), at(days=31))])
    assert values(result, "estancia_dias", "mejoria") == [(30, 1), (31, 0)]


def test_stay_without_window_keeps_its_row(spark):
    result = outcomes(spark, [(at(0), None), (None, None)], orders=[order(at(-1), at(1))])
    columns = ["stay_id", "estancia_dias", "duracion_tratamiento", "tratamiento_previo"]
    assert values(result, *columns, "mejoria") == [(0, None, None, 1, 0), (1, None, None, 0, 0)]
    assert op.block_report(result).count() == 0


def test_treatment_hours_cover_whole_and_reversed_orders(spark):
    window = (at(0), at(100))
    orders = [
        order(at(0), at(100), "Insulin"),  # on both bounds: 100
        order(at(1), at(4), "Heparin"),  # 3
        order(at(90), at(101)),  # ends outside
        order(at(-1), at(5)),  # starts outside
        order(at(120), at(-30)),  # reversed over the whole stay: -150
        order(at(150), at(101)),  # reversed, after the stay
        order(None, at(5)),
        order(at(5), None),
    ]
    result = outcomes(spark, [window, (at(500), at(501))], orders)
    assert values(result, "stay_id", "duracion_tratamiento") == [
        (0, round((100 + 3 - 150) / 3, 1)),
        (1, None),
    ]


def test_one_stay_has_no_deviation(spark):
    row = op.block_report(outcomes(spark, [(at(0), at(50))])).first()
    assert row.desviacion_estancia is None and row.estancia_media == 2.0
    assert row.duracion_tratamiento_horas is None and row.porcentaje_uci == 100.0


def test_empty_cohort(spark):
    tables = clinic(spark)
    assert [tuple(r) for r in report("p10_prior_treatment_counts", tables).collect()] == [
        (0, None, 0)
    ]
    assert report("p12_blocks", tables).count() == 0
    assert report("p13_clinical_metrics", tables).count() == 0
    assert report("p02_culture_detail", tables).count() == 0


def test_repeated_stay_rows_change_no_count(spark):
    cultures = [culture(), culture(microevent_id=2, ab_name="CEFEPIME")]
    dims = {
        "cultures": cultures,
        "prescriptions": [order(at(-100), at(-90)), order(at(2), at(5))],
        "patients": [{"subject_id": 1, "gender": "F"}],
        "admissions": [{"hadm_id": 10}],
    }
    window = stay(intime=at(-1), outtime=at(60))
    once = clinic(spark, stays=[window], **dims)
    twice = clinic(spark, stays=[window, window], **dims)
    for name in ("p06_single_organism", "p10_prior_treatment_counts", "p13_clinical_metrics"):
        assert report(name, once).collect() == report(name, twice).collect()
    row = report("p13_clinical_metrics", once).first()
    assert (row.bloque, row.num_pacientes, row.duracion_tratamiento_horas) == ("Bloque 2", 1, 3.0)


def test_schemas_name_every_column_once():
    for schema in SCHEMAS.values():
        assert len(set(schema.names)) == len(schema.names)


def test_ever_before_needs_a_start(spark):
    cultures = table(spark, "cultures", [culture()])
    none = op.treated_ever_before(cultures, table(spark, "prescriptions", [order(None)]))
    assert none.select(F.col("has_prior_treatment")).head()[0] is False


def test_widths_of_zero_and_below(spark):
    cultures = table(spark, "cultures", [culture(charttime=at(0))])
    orders = table(spark, "prescriptions", [order(at(0))])
    flags = ("has_prior_treatment", "has_post_treatment")
    assert values(op.treatment_exposure(cultures, orders, 0, 48), *flags) == [(False, True)]
    assert values(op.treatment_exposure(cultures, orders, 48, 0), *flags) == [(False, True)]
    assert values(op.treatment_exposure(cultures, orders, 0, 0), *flags) == [(False, True)]
    late = table(spark, "prescriptions", [order(at(0, microseconds=1)), order(at(-1))])
    assert values(op.treatment_exposure(cultures, late, 48, 0), *flags) == [(True, False)]
    for before, after in ((-1, 48), (48, -1)):
        with pytest.raises(ValueError):
            op.treatment_exposure(cultures, orders, before, after)


def test_no_values_match_nothing(spark):
    cultures = table(spark, "cultures", [culture(), culture(org_name=None, spec_type_desc=None)])
    assert op.target_organisms(cultures, "contains", []).count() == 0
    assert op.target_organisms(cultures, "exact", []).count() == 0
    assert op.exclude_specimens(cultures, []).count() == 1
    assert cultures.where(starts_with_any("org_name", [])).count() == 0


def test_stays_meet_no_other_stays(spark):
    """Stays of one day and no prescriptions: no row comes out of the join with orders."""
    many = outcomes(spark, [(at(0), at(5 + i / 1000)) for i in range(300)])
    assert many.count() == 300
    long = spark.createDataFrame([(datetime(2024, 3, 1), datetime(9999, 12, 31))], "i timestamp_ntz, o timestamp_ntz")
    first, last = (f"datediff({c}, {_DAY_ZERO})" for c in "io")
    assert long.selectExpr(f"size({_tiles(first, last, 0)}) AS n").first().n < 100


def test_prescriptions_of_reversed_order_and_long_stays(spark):
    windows = [(at(0), at(days=400)), (at(days=3), at(days=9)), (at(days=5), at(days=5))]
    orders = [order(at(days=4), at(days=6)), order(at(days=7), at(days=2)), order(at(days=1), at(days=900))]
    result = outcomes(spark, windows, orders)
    expected = []
    for begin, end in windows:
        inside = [int((o["stoptime"] - o["starttime"]).total_seconds() / 3600) for o in orders
                  if o["starttime"] >= begin and o["stoptime"] <= end]
        expected.append(round(sum(inside) / len(inside), 1) if inside else None)
    assert [r.duracion_tratamiento for r in result.orderBy("stay_id").collect()] == expected


def test_a_single_instant_is_numbered_in_many_parts(spark):
    rows = spark.range(60_000).selectExpr(
        "id AS microevent_id", "IF(id % 10 = 0, id, 7) AS hadm_id", "'e' AS org_name", "'R' AS interpretation",
        "timestamp_ntz'2024-03-10 00:00:00' AS charttime",
    )
    numbered = op.numbered_cultures(rows, ("hadm_id", "org_name"))
    hot = numbered.where("hadm_id = 7").agg(F.min("row_num"), F.max("row_num"), F.count_distinct("row_num"))
    n = rows.where("hadm_id = 7").count()
    assert tuple(hot.first()) == (1, n, n)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = numbered.groupBy(F.spark_partition_id()).agg(F.count("row_num").alias("n"), F.max("row_num"))
    sizes = [r.n for r in placed.collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert max(sizes) <= 4 * 60_000 / 8


def test_parts_of_a_lookup_can_be_set(spark):
    spark.conf.set("staycohort.lookup.parts", "3")
    table_ = spark.createDataFrame([(1, "a")], "k int, v string")
    joined = op.join_lookup(spark.range(10).selectExpr("id", "1 AS k"), table_, ["k"], "inner", "id")
    spark.conf.unset("staycohort.lookup.parts")
    assert joined.count() == 10 and "2" in joined._jdf.queryExecution().toString()
