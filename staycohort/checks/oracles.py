"""The same queries as SQL over the `events` table.

The statements follow the plain definition of each result: correlated EXISTS for drug
exposure, NOT EXISTS for exclusions, cultures ranked after the join with stays, and
prescriptions joined to stays before the mean is taken. The DataFrame operators reach
the same rows by other routes, so a mistake in a rewrite shows.
"""

from staycohort import vocabulary as v
from staycohort.sources import event_views as ev


def _array(names):
    return "[" + ", ".join(f"'{name}'" for name in names) + "]"


def _rows(rows):
    return ", ".join("(" + ", ".join(repr(value) for value in row) + ")" for row in rows)


_CLASS_ROWS = [(i, p, label) for i, (p, label) in enumerate(v.ANTIBIOTIC_CLASS_PATTERNS)]
_BLOCK_ROWS = [
    (block, organism, label)
    for block, organisms, labels in v.RESISTANCE_BLOCKS
    for organism in organisms
    for label in labels
]

_TABLES = f"""
ev AS (
  SELECT event_id, ts, event_type, user_id AS subject_id,
         user_id * 100 + CAST(floor((day(ts) - 1) / 7) AS BIGINT) AS hadm_id
  FROM events
),
icustays AS (
  SELECT subject_id, hadm_id,
         hadm_id * 10 + CASE WHEN hadm_id % 4 = 0 THEN event_id % 2 ELSE 0 END AS stay_id,
         min(ts) AS intime, max(ts) AS outtime
  FROM ev GROUP BY 1, 2, 3
),
microbiologyevents AS (
  SELECT event_id * 3 + k AS microevent_id,
         subject_id,
         CASE WHEN event_id % 47 = 0 THEN NULL ELSE hadm_id END AS hadm_id,
         CASE WHEN event_id % 53 = 0 THEN NULL ELSE ts END AS charttime,
         {_array(ev.SPECIMENS)}[event_id % 8 + 1] AS spec_type_desc,
         {_array(ev.ORGANISMS)}[
             (hadm_id + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 13 + 1] AS org_name,
         {_array(ev.ANTIBIOTICS)}[(hadm_id * 7 + event_id % 5 + k) % 12 + 1] AS ab_name,
         CASE WHEN event_id % 4 = 1 THEN NULL
              ELSE {_array(ev.RESULTS)}[(event_id + k) % 5 + 1] END AS interpretation
  FROM ev CROSS JOIN (VALUES (0), (1), (2)) AS antibiotics(k)
  WHERE event_type = 'error'
),
prescriptions AS (
  SELECT subject_id, hadm_id,
         CASE WHEN event_id % 41 = 0 THEN NULL ELSE ts END AS starttime,
         CASE WHEN event_id % 43 = 0 THEN NULL
              ELSE ts + (event_id % 90 - 3) * INTERVAL '1' HOUR + INTERVAL '25' MINUTE
         END AS stoptime,
         {_array(ev.DRUGS)}[event_id % 13 + 1] AS drug
  FROM ev WHERE event_type = 'purchase'
),
diagnoses_icd AS (
  SELECT DISTINCT subject_id, hadm_id,
         {_array(ev.ICD_CODES)}[(hadm_id + event_id % 2) % 10 + 1] AS icd_code
  FROM ev WHERE event_type = 'view'
),
patients AS (
  SELECT DISTINCT subject_id, CASE WHEN subject_id % 3 = 0 THEN 'F' ELSE 'M' END AS gender FROM ev
),
admissions AS (
  SELECT subject_id, hadm_id,
         CASE WHEN hadm_id % 7 = 0 THEN max(ts)
              WHEN hadm_id % 11 = 0 THEN max(ts) + INTERVAL '48' HOUR END AS deathtime
  FROM ev GROUP BY subject_id, hadm_id
),
target(name) AS (VALUES {_rows((o,) for o in v.TARGET_ORGANISMS)}),
left_out(name) AS (VALUES {_rows((s,) for s in v.EXCLUDED_SPECIMENS)}),
listed_drug(name) AS (VALUES {_rows((d,) for d in v.TREATMENT_DRUGS)}),
class_rule(place, pattern, label) AS (VALUES {_rows(_CLASS_ROWS)}),
block_rule(block, organism, label) AS (VALUES {_rows(_BLOCK_ROWS)}),
chronic AS (
  SELECT hadm_id FROM diagnoses_icd WHERE left(icd_code, 3) IN ('N18', 'E11', 'I50')
),
listed AS (
  SELECT hadm_id, starttime, stoptime FROM prescriptions
  WHERE lower(drug) IN (SELECT name FROM listed_drug) AND starttime IS NOT NULL
)"""

_PLACE = """row_number() OVER (
    PARTITION BY {keys}
    ORDER BY position(interpretation IN 'RSI'), charttime, microevent_id)"""

_CLASS = """coalesce((SELECT arg_min(label, place) FROM class_rule
    WHERE lower(ab_name) LIKE pattern), 'Otra_clase')"""

_CONTAINS = "EXISTS (SELECT 1 FROM target WHERE contains(lower(org_name), name))"
_EXACT = "lower(org_name) IN (SELECT name FROM target)"
_SPECIMEN = "lower(spec_type_desc) NOT IN (SELECT name FROM left_out)"
_TESTED = """interpretation IN ('R', 'S', 'I') AND charttime IS NOT NULL
    AND hadm_id IS NOT NULL AND org_name IS NOT NULL"""
_POSITIVE = f"hadm_id IS NOT NULL AND charttime IS NOT NULL AND {_CONTAINS}"

_EVER = """EXISTS (SELECT 1 FROM listed d WHERE d.hadm_id = c.hadm_id
    AND d.starttime < c.charttime)"""
_PRIOR = """EXISTS (SELECT 1 FROM listed d WHERE d.hadm_id = c.hadm_id
    AND d.starttime >= c.charttime - INTERVAL '48' HOUR AND d.starttime < c.charttime)"""
_POST = """EXISTS (SELECT 1 FROM listed d WHERE d.hadm_id = c.hadm_id
    AND d.starttime BETWEEN c.charttime AND c.charttime + INTERVAL '48' HOUR)"""
_NOT_CHRONIC = "NOT EXISTS (SELECT 1 FROM chronic x WHERE x.hadm_id = c.hadm_id)"

_DETAIL = "stay_id, hadm_id, org_name, charttime, ab_name, interpretation"
_TESTED_ROWS = f"(SELECT * FROM microbiologyevents WHERE {_TESTED}) c"


def _with(body, *steps):
    return f"WITH {', '.join((_TABLES.strip(), *steps))}\n{body.strip()}"


def _linked(*conditions):
    """Stay x culture rows that meet the conditions."""
    kept = " AND ".join(conditions) or "TRUE"
    return f"""linked AS (
  SELECT s.stay_id, m.* FROM icustays s
  JOIN (SELECT * FROM microbiologyevents WHERE {kept}) m ON m.hadm_id = s.hadm_id
)"""


def _first_per(keys, source="linked", name="first_culture"):
    return f"""{name} AS (
  SELECT *, {_CLASS} AS antibiotic_class
  FROM (SELECT * FROM {source} QUALIFY {_PLACE.format(keys=keys)} = 1) ranked
)"""


def _cases(organisms, *, subject=False):
    """Steps up to the distinct representative cultures of each stay."""
    keys = "stay_id, hadm_id, charttime, org_name, antibiotic_class, interpretation"
    keys = f"{keys}, subject_id" if subject else keys
    return (
        _linked(_TESTED, organisms, _SPECIMEN),
        _first_per("stay_id, org_name"),
        f"cases AS (SELECT DISTINCT {keys} FROM first_culture)",
    )


def _stays_where(name, *conditions):
    return _with(f"SELECT count(DISTINCT stay_id) AS {name} FROM linked", _linked(*conditions))


def _detail(rows, *conditions):
    return _with(
        f"SELECT {_DETAIL} FROM linked ORDER BY stay_id, microevent_id LIMIT {rows}",
        _linked(*conditions),
    )


_MONO = "total_estancias_uci_cultivos_monoinfeccion"


def _single(keys, *conditions):
    step = f"""single AS (
  SELECT {keys} FROM first_culture GROUP BY {keys} HAVING min(org_name) = max(org_name)
)"""
    return (_linked(*conditions), _first_per("stay_id, org_name"), step)


_BLOCKED = f"""blocked AS (
  SELECT c.*, coalesce(b.block, 'Otros') AS bloque
  FROM cases c
  LEFT JOIN block_rule b ON b.organism = lower(c.org_name) AND b.label = c.antibiotic_class
)"""
_CHOSEN = f"chosen AS (SELECT * FROM blocked c WHERE NOT {_PRIOR} AND {_POST})"


def _outcomes(source):
    return f"""outcomes AS (
  SELECT c.bloque, c.stay_id, c.hadm_id, c.subject_id, p.gender,
         date_diff('day', i.intime, i.outtime) AS estancia_dias,
         round(avg(date_sub('hour', r.starttime, r.stoptime))
               FILTER (WHERE r.starttime >= i.intime AND r.stoptime <= i.outtime), 1)
           AS duracion_tratamiento,
         CAST(coalesce(bool_or(lower(r.drug) IN (SELECT name FROM listed_drug)
                               AND r.starttime < i.intime
                               AND r.starttime >= i.intime - INTERVAL '48' HOUR), FALSE) AS INTEGER)
           AS tratamiento_previo,
         CAST(coalesce(a.deathtime BETWEEN i.intime AND i.outtime, FALSE) AS INTEGER)
           AS fallecio_en_uci,
         CAST(coalesce(a.deathtime IS NULL AND date_diff('day', i.intime, i.outtime) <= 30, FALSE)
              AS INTEGER) AS mejoria
  FROM {source} c
  JOIN patients p ON p.subject_id = c.subject_id
  JOIN admissions a ON a.hadm_id = c.hadm_id
  LEFT JOIN icustays i ON i.stay_id = c.stay_id AND i.hadm_id = c.hadm_id
  LEFT JOIN (SELECT * FROM prescriptions WHERE starttime IS NOT NULL AND stoptime IS NOT NULL) r
    ON r.hadm_id = c.hadm_id
  GROUP BY c.bloque, c.stay_id, c.hadm_id, c.subject_id, p.gender, i.intime, i.outtime, a.deathtime
)"""


_REPORTS = {
    "p01_stays_with_culture": _stays_where("total_estancias_uci"),
    "p02_culture_detail": _detail(10),
    "p03_stays_positive": _stays_where("total_estancias_uci_cultivos_positivos", _POSITIVE),
    "p04_positive_detail": _detail(100, _POSITIVE),
    "p05_stays_tested": _stays_where("total_estancias_uci_cultivos", _TESTED, _CONTAINS),
    "p06_single_organism": _with(
        f"SELECT count(DISTINCT stay_id) AS {_MONO} FROM single",
        *_single("stay_id", _TESTED, _CONTAINS),
    ),
    "p07_single_organism_specimen": _with(
        f"SELECT count(DISTINCT stay_id) AS {_MONO} FROM single",
        *_single("stay_id", _TESTED, _CONTAINS, _SPECIMEN),
    ),
    "p08_single_organism_no_comorb": _with(
        f"SELECT count(DISTINCT stay_id) AS {_MONO} FROM single c WHERE {_NOT_CHRONIC}",
        *_single("stay_id, hadm_id", _TESTED, _CONTAINS, _SPECIMEN),
    ),
    "p09_prior_treatment_detail": _with(
        f"""SELECT stay_id, hadm_id, charttime, org_name, antibiotic_class, interpretation,
       CAST({_EVER} AS INTEGER) AS has_prior_treatment
FROM cases c WHERE {_NOT_CHRONIC} ORDER BY stay_id, charttime, org_name LIMIT 10""",
        *_cases(_CONTAINS),
    ),
    "p10_prior_treatment_counts": _with(
        """SELECT count(DISTINCT stay_id) AS total_estancias_uci_monoinfeccion,
       CAST(sum(CAST(prior AS INTEGER)) AS BIGINT) AS total_con_tratamiento_previo,
       count(DISTINCT stay_id) FILTER (WHERE prior) AS estancias_distintas_con_tratamiento
FROM flagged""",
        *_cases(_EXACT),
        f"flagged AS (SELECT c.*, {_EVER} AS prior FROM cases c WHERE {_NOT_CHRONIC})",
    ),
    "p11_untreated_then_treated_48h": _with(
        f"""SELECT
  count(DISTINCT stay_id) AS estancias_distintas_sin_tratamiento_previo_y_posterior_48h
FROM cases c WHERE {_NOT_CHRONIC} AND NOT {_PRIOR} AND {_POST}""",
        *_cases(_CONTAINS),
    ),
    "p12_blocks": _with(
        """SELECT bloque, count(DISTINCT stay_id) AS estancias_unicas
FROM chosen WHERE bloque <> 'Otros' GROUP BY bloque ORDER BY bloque""",
        *_cases(_EXACT),
        _BLOCKED,
        _CHOSEN,
    ),
    "p13_clinical_metrics": _with(
        """SELECT bloque, count(DISTINCT stay_id) AS num_pacientes,
       round(100.0 * count(*) FILTER (WHERE gender = 'M') / count(*), 1) AS porcentaje_hombres,
       round(100.0 * count(estancia_dias) / count(*), 1) AS porcentaje_uci,
       round(avg(estancia_dias), 1) AS estancia_media,
       round(stddev_samp(estancia_dias), 1) AS desviacion_estancia,
       round(avg(duracion_tratamiento), 1) AS duracion_tratamiento_horas,
       round(100.0 * sum(fallecio_en_uci) / count(*), 1) AS mortalidad_pct,
       round(100.0 * sum(mejoria) / count(*), 1) AS proporcion_mejora_pct
FROM outcomes WHERE estancia_dias IS NOT NULL AND bloque <> 'Otros'
GROUP BY bloque ORDER BY bloque""",
        *_cases(_EXACT, subject=True),
        _BLOCKED,
        _CHOSEN,
        _outcomes("chosen"),
    ),
}

_M = "microbiologyevents"
_ALL_LINKED = _linked()

_OPERATORS = {
    "op_scan_stays": _with("SELECT subject_id, hadm_id, stay_id, intime, outtime FROM icustays"),
    "op_scan_cultures": _with(
        f"""SELECT microevent_id, subject_id, hadm_id, charttime, spec_type_desc, org_name, ab_name,
       interpretation FROM {_M}"""
    ),
    "op_scan_diagnoses": _with("SELECT subject_id, hadm_id, icd_code FROM diagnoses_icd"),
    "op_scan_prescriptions": _with(
        "SELECT subject_id, hadm_id, starttime, stoptime, drug FROM prescriptions"
    ),
    "op_scan_patients": _with("SELECT subject_id, gender FROM patients"),
    "op_scan_admissions": _with("SELECT subject_id, hadm_id, deathtime FROM admissions"),
    "op_project": _with(
        f"SELECT microevent_id AS culture_id, org_name AS organism, charttime AS taken_at FROM {_M}"
    ),
    "op_project_star": _with("SELECT *, outtime > intime AS has_length FROM icustays"),
    "op_filter_notnull": _with(
        f"""SELECT microevent_id, charttime, org_name FROM {_M}
WHERE charttime IS NOT NULL AND org_name IS NOT NULL AND interpretation IS NULL"""
    ),
    "op_filter_in": _with(
        f"""SELECT microevent_id, interpretation, org_name FROM {_M}
WHERE interpretation IN ('R', 'S', 'I') AND {_EXACT}"""
    ),
    "op_filter_not_in": _with(f"SELECT microevent_id, spec_type_desc FROM {_M} WHERE {_SPECIMEN}"),
    "op_filter_contains_any": _with(f"SELECT microevent_id, org_name FROM {_M} WHERE {_CONTAINS}"),
    "op_filter_prefix_any": _with(
        """SELECT DISTINCT hadm_id FROM diagnoses_icd
WHERE icd_code LIKE 'N18%' OR icd_code LIKE 'E11%' OR icd_code LIKE 'I50%'"""
    ),
    "op_like_multi": _with(
        f"SELECT microevent_id, ab_name FROM {_M} WHERE lower(ab_name) LIKE '%trimeth%prim%sulfa%'"
    ),
    "op_filter_compare": _with(
        """SELECT hadm_id, starttime, stoptime, drug FROM prescriptions
WHERE starttime < stoptime AND (stoptime >= starttime + INTERVAL '24' HOUR OR drug <> 'Heparin')"""
    ),
    "op_case_searched": _with(f"SELECT microevent_id, {_CLASS} AS antibiotic_class FROM {_M}"),
    "op_case_simple": _with(
        f"""SELECT microevent_id,
       CASE interpretation WHEN 'R' THEN 1 WHEN 'S' THEN 2 WHEN 'I' THEN 3 END AS result_rank
FROM {_M}"""
    ),
    "op_case_null": _with(
        """SELECT hadm_id, starttime,
       CASE WHEN stoptime >= starttime THEN date_sub('hour', starttime, stoptime) END AS hours
FROM prescriptions"""
    ),
    "op_join_inner": _with("SELECT stay_id, microevent_id FROM linked", _ALL_LINKED),
    "op_join_anti": _with(
        f"SELECT stay_id, hadm_id FROM icustays c WHERE {_NOT_CHRONIC}"
    ),
    "op_join_range_prior": _with(
        f"SELECT microevent_id, {_EVER} AS has_prior_treatment FROM {_TESTED_ROWS}"
    ),
    "op_join_interval_before": _with(
        f"SELECT microevent_id, {_PRIOR} AS has_prior_treatment FROM {_TESTED_ROWS}"
    ),
    "op_join_interval_after": _with(
        f"SELECT microevent_id, {_POST} AS has_post_treatment FROM {_TESTED_ROWS}"
    ),
    "op_join_dims": _with(
        """SELECT s.stay_id, p.gender, a.deathtime FROM icustays s
JOIN patients p ON p.subject_id = s.subject_id JOIN admissions a ON a.hadm_id = s.hadm_id"""
    ),
    "op_join_left_multi": _with(
        f"""SELECT c.microevent_id, c.stay_id, i.intime, i.outtime
FROM (SELECT microevent_id, hadm_id, hadm_id * 10 + microevent_id % 2 AS stay_id
      FROM {_M} WHERE hadm_id IS NOT NULL) c
LEFT JOIN icustays i ON i.hadm_id = c.hadm_id AND i.stay_id = c.stay_id"""
    ),
    "op_join_left_filtered": _with(
        """SELECT s.stay_id, count(r.starttime) AS prescriptions, max(r.stoptime) AS last_stop
FROM icustays s
LEFT JOIN prescriptions r
  ON r.hadm_id = s.hadm_id AND r.starttime IS NOT NULL AND r.stoptime IS NOT NULL
GROUP BY s.stay_id"""
    ),
    "op_count_distinct": _with("SELECT count(DISTINCT stay_id) AS stays FROM linked", _ALL_LINKED),
    "op_group_count_distinct": _with(
        "SELECT org_name, count(DISTINCT stay_id) AS stays FROM linked GROUP BY org_name",
        _ALL_LINKED,
    ),
    "op_having_single": _with(
        f"""SELECT hadm_id FROM {_M} WHERE {_TESTED}
GROUP BY hadm_id HAVING count(DISTINCT org_name) = 1"""
    ),
    "op_group_distinct": _with(
        f"""SELECT hadm_id, org_name, interpretation FROM {_M} WHERE {_TESTED}
GROUP BY hadm_id, org_name, interpretation"""
    ),
    "op_distinct": _with("SELECT DISTINCT hadm_id, drug FROM prescriptions"),
    "op_flag_int": _with(
        """SELECT s.stay_id, CASE WHEN count(d.starttime) > 0 THEN 1 ELSE 0 END AS treated
FROM icustays s LEFT JOIN listed d ON d.hadm_id = s.hadm_id GROUP BY s.stay_id"""
    ),
    "op_flag_bool": _with(
        """SELECT s.stay_id, count(d.starttime) > 0 AS treated
FROM icustays s LEFT JOIN listed d ON d.hadm_id = s.hadm_id GROUP BY s.stay_id"""
    ),
    "op_percentages": _with(
        f"""SELECT spec_type_desc, count(*) AS cultures,
       round(sum(CASE WHEN interpretation = 'R' THEN 1 ELSE 0 END) / count(*) * 100, 1)
         AS resistant_pct
FROM {_M} GROUP BY spec_type_desc"""
    ),
    "op_conditional_sum": _with(
        f"""SELECT ab_name, count(*) FILTER (WHERE interpretation = 'R') AS resistant,
       count(*) FILTER (WHERE interpretation = 'S') AS susceptible
FROM {_M} GROUP BY ab_name"""
    ),
    "op_count_distinct_if": _with(
        f"""SELECT org_name,
       count(DISTINCT CASE WHEN interpretation = 'R' THEN hadm_id END) AS resistant_admissions
FROM {_M} GROUP BY org_name"""
    ),
    "op_avg_if": _with(
        """SELECT drug, round(avg(CASE WHEN hours >= 0 THEN hours END), 1) AS mean_hours
FROM (SELECT drug, date_sub('hour', starttime, stoptime) AS hours FROM prescriptions) timed
GROUP BY drug"""
    ),
    "op_max_flag": _with(
        f"""SELECT hadm_id, max(CASE WHEN interpretation = 'R' THEN 1 ELSE 0 END) AS any_resistant
FROM {_M} GROUP BY hadm_id"""
    ),
    "op_stddev": _with(
        """SELECT subject_id, count(*) AS stays,
       round(stddev_samp(date_diff('day', intime, outtime)), 3) AS days_stddev
FROM icustays GROUP BY subject_id"""
    ),
    "op_mixed_distinct": _with(
        f"""SELECT org_name, count(*) AS cultures, count(DISTINCT hadm_id) AS admissions,
       count(DISTINCT spec_type_desc) AS specimens,
       count(*) FILTER (WHERE interpretation = 'R') AS resistant
FROM {_M} GROUP BY org_name"""
    ),
    "op_row_number": _with(
        f"""SELECT hadm_id, org_name, microevent_id,
       {_PLACE.format(keys="hadm_id, org_name")} AS row_num
FROM {_TESTED_ROWS}"""
    ),
    "op_top1_per_group": _with(
        f"""SELECT stay_id, org_name, microevent_id FROM linked
QUALIFY {_PLACE.format(keys="stay_id, org_name")} = 1""",
        _linked(_TESTED),
    ),
    "op_order_by": _with(
        """SELECT icd_code, count(*) AS admissions FROM diagnoses_icd
GROUP BY icd_code ORDER BY icd_code NULLS FIRST"""
    ),
    "op_limit": _with("SELECT stay_id, hadm_id, intime FROM icustays ORDER BY stay_id LIMIT 10"),
    "op_lower": _with(
        f"""SELECT lower({_CLASS}) AS label, lower(ab_name) AS antibiotic, count(*) AS cultures
FROM {_M} GROUP BY 1, 2"""
    ),
    "op_diff_days": _with(
        "SELECT stay_id, date_diff('day', intime, outtime) AS days FROM icustays"
    ),
    "op_diff_hours": _with(
        """SELECT hadm_id, starttime, date_sub('hour', starttime, stoptime) AS hours
FROM prescriptions"""
    ),
    "op_round": _with(
        """SELECT drug, round(avg(minute(starttime)), 1) AS mean_minute
FROM prescriptions GROUP BY drug"""
    ),
    "op_stay_cultures": _with(
        "SELECT stay_id, hadm_id, microevent_id, org_name, charttime FROM linked", _ALL_LINKED
    ),
    "op_target_organisms": _with(
        f"""SELECT org_name, count(*) AS cultures, 'contains' AS mode
FROM {_M} WHERE {_CONTAINS} GROUP BY org_name
UNION ALL
SELECT org_name, count(*), 'exact' FROM {_M} WHERE {_EXACT} GROUP BY org_name"""
    ),
    "op_exclude_specimens": _with(
        f"""SELECT spec_type_desc, count(*) AS cultures
FROM {_M} WHERE {_SPECIMEN} GROUP BY spec_type_desc"""
    ),
    "op_tested_cultures": _with(
        f"SELECT microevent_id, hadm_id, interpretation FROM {_M} WHERE {_TESTED}"
    ),
    "op_antibiotic_class": _with(
        f"""SELECT ab_name, {_CLASS} AS antibiotic_class, count(*) AS cultures
FROM {_M} GROUP BY 1, 2"""
    ),
    "op_representative": _with(
        """SELECT hadm_id, org_name, microevent_id, antibiotic_class, interpretation
FROM first_culture""",
        f"kept AS (SELECT * FROM {_M} WHERE {_TESTED} AND {_CONTAINS} AND {_SPECIMEN})",
        _first_per("hadm_id, org_name", "kept"),
    ),
    "op_single_organism": _with(
        "SELECT stay_id FROM single", *_single("stay_id", _TESTED, _CONTAINS)
    ),
    "op_distinct_cultures": _with("SELECT * FROM cases", *_cases(_CONTAINS)),
    "op_exclude_comorb": _with(
        f"SELECT hadm_id, org_name, microevent_id FROM first_culture c WHERE {_NOT_CHRONIC}",
        f"kept AS (SELECT * FROM {_M} WHERE {_TESTED} AND {_CONTAINS} AND {_SPECIMEN})",
        _first_per("hadm_id, org_name", "kept"),
    ),
    "op_treatment_exposure": _with(
        f"""SELECT microevent_id, {_PRIOR} AS has_prior_treatment, {_POST} AS has_post_treatment
FROM {_TESTED_ROWS}"""
    ),
    "op_untreated_then_treated": _with(
        f"SELECT microevent_id, hadm_id FROM {_TESTED_ROWS} WHERE NOT {_PRIOR} AND {_POST}"
    ),
    "op_resistance_block": _with(
        "SELECT bloque, count(*) AS cultures FROM blocked GROUP BY bloque",
        f"cases AS (SELECT org_name, {_CLASS} AS antibiotic_class FROM {_M})",
        _BLOCKED,
    ),
    "op_stay_outcomes": _with(
        "SELECT * FROM outcomes", *_cases(_EXACT, subject=True), _BLOCKED, _outcomes("blocked")
    ),
}

ORACLE_SQL: dict[str, str] = {**_REPORTS, **_OPERATORS}
