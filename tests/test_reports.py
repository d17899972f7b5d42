"""Properties of the reports, their plans, and the ways to load tables."""

from dataclasses import fields, replace

import pytest

import __spark_entry__ as contract
from staycohort import REPORTS, ClinicalTables, report, tables_from_events
from staycohort import operators as op
from staycohort.schemas import SCHEMAS, TABLE_NAMES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return tables_from_events(spark, SF)


@pytest.fixture(scope="module")
def stored(tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("warehouse")
    for role, name in TABLE_NAMES.items():
        getattr(tables, role).write.parquet(f"{root}/{name}")
    return root


def rows(df):
    return [tuple(row) for row in df.collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unknown_report_is_refused(tables):
    with pytest.raises(KeyError, match="p13_clinical_metrics"):
        report("p14", tables)


def test_entry_is_the_flagship(spark, tables):
    assert rows(contract.entry(spark)) == rows(report("p13_clinical_metrics", tables))


def test_derived_tables_have_the_declared_schemas(tables):
    for role, schema in SCHEMAS.items():
        derived = {(f.name, f.dataType) for f in getattr(tables, role).schema.fields}
        assert derived == {(f.name, f.dataType) for f in schema.fields}


def test_files_and_catalog_give_the_same_reports(spark, tables, stored):
    from_files = ClinicalTables.from_files(spark, str(stored))
    for role, name in TABLE_NAMES.items():
        getattr(from_files, role).createOrReplaceTempView(name)
    from_catalog = ClinicalTables.from_catalog(spark)
    for name in ("p04_positive_detail", "p10_prior_treatment_counts", "p13_clinical_metrics"):
        expected = rows(report(name, tables))
        assert rows(report(name, from_files)) == expected
        assert rows(report(name, from_catalog)) == expected


@pytest.mark.parametrize("parts", [1, 7])
def test_row_order_and_partitions_do_not_matter(spark, stored, parts):
    tables = ClinicalTables.from_files(spark, str(stored))
    mixed = replace(
        tables,
        **{
            f.name: getattr(tables, f.name).repartition(parts).sortWithinPartitions("hadm_id")
            for f in fields(tables)
            if f.name != "patients"
        },
    )
    for name in REPORTS:
        assert rows(report(name, mixed)) == rows(report(name, tables)), name


def test_narrower_cohorts_are_smaller(tables):
    (specimen,), = rows(report("p07_single_organism_specimen", tables))
    (healthy,), = rows(report("p08_single_organism_no_comorb", tables))
    (tested,), = rows(report("p05_stays_tested", tables))
    (treated,), = rows(report("p11_untreated_then_treated_48h", tables))
    assert healthy <= specimen <= tested and treated <= tested


def test_blocks_of_both_reports_agree(tables):
    counts = dict(rows(report("p12_blocks", tables)))
    metrics = {row[0]: row[1] for row in rows(report("p13_clinical_metrics", tables))}
    assert counts == metrics and list(counts) == sorted(counts)


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", REPORTS)
def test_plans_stay_in_the_jvm_and_join_on_keys(spark, stored, no_broadcast, name):
    plan = plan_of(report(name, ClinicalTables.from_files(spark, str(stored))))
    for bad in ("Python", "CartesianProduct", "NestedLoop"):
        assert bad not in plan
    broadcasts = plan.count("BroadcastExchange")
    # at most ten or a hundred stays, by an explicit limit
    few = {"p02_culture_detail": 1, "p04_positive_detail": 1, "p09_prior_treatment_detail": 3}
    assert broadcasts == few.get(name, 0)


def test_plan_shapes(spark, stored, no_broadcast):
    tables = ClinicalTables.from_files(spark, str(stored))
    counts = plan_of(report("p10_prior_treatment_counts", tables))
    assert "LeftAnti" in counts and "WindowGroupLimit" in counts and "Expand" not in counts
    metrics = plan_of(report("p13_clinical_metrics", tables))
    # The unused earlier-treatment flag and the stays without a window are planned away.
    # The cases stand three times in the plan: their exchange is computed once and reused.
    assert metrics.count("LeftOuter") == 3
    detail = plan_of(report("p04_positive_detail", tables))
    assert "IsNotNull(charttime)" in detail


def test_spreading_reads_only_the_columns_it_needs(spark, stored, no_broadcast):
    tables = ClinicalTables.from_files(spark, str(stored))
    kept = op.exclude_comorbidities(tables.stays, tables.diagnoses, spread="stay_id")
    plan = plan_of(kept.select("stay_id"))
    assert "ReadSchema: struct<hadm_id:bigint,stay_id:bigint>" in plan
    assert "LeftAnti" in plan and "_part" in plan
