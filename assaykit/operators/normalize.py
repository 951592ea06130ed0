"""Normalization of each provider format to the unified assessment shape.

All three providers produce the same column, ``assessments``:
``array<struct<patient_id, assessment_date, assessment_type, scores>>``.
Provider C's grouping of CSV rows into assessments runs with higher-order
functions inside the payload row, so normalization never shuffles: a payload
is one row, and its rows are grouped where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from assaykit.functions.jsonx import is_numeric_sql
from assaykit.functions.rescale import rescale
from assaykit.functions.times import utc_ntz, utc_ntz_sql
from assaykit.operators.validate import FLOAT_RE, _q as sql_str
from assaykit.schemas import (
    PROVIDER_FORMATS, SCALE_PRESETS, SCHEMA_VERSION, SCORE_PREFIX, TARGET_SCALE,
)

# One CSV field. A quote is special at the start of a field only; then "" stands for a quote, commas and line ends are
# text, and what follows the closing quote up to the next comma is kept as it is. A quote that never closes takes the rest.
CSV_FIELD_RE = '(?:"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+|\\z)|(?!")[^,\r\n]*+)'
CSV_RECORD_RE = f"{CSV_FIELD_RE}(?:,{CSV_FIELD_RE})*+"
CSV_QUOTED_RE = '(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'


def _cells(record: str) -> str:
    """Cells of one CSV record; the quote-aware way only runs on records with a quote."""
    quoted = (f"concat(replace(regexp_extract(c, {sql_str(CSV_QUOTED_RE)}, 1), '\"\"', '\"'), "
              f"regexp_extract(c, {sql_str(CSV_QUOTED_RE)}, 2))")
    return (f"CASE WHEN instr({record}, '\"') = 0 THEN split({record}, ',') "
            f"ELSE transform(regexp_extract_all({record}, {sql_str(f'(?:^|,)({CSV_FIELD_RE})')}, 1), "
            f"c -> CASE WHEN startswith(c, '\"') THEN {quoted} ELSE c END) END")


def csv_columns() -> dict[str, Column]:
    """Parse a CSV payload (header by name) into ``csv_header`` / ``csv_rows``.

    Records end at a line feed, a carriage return or both, outside of quoted
    fields; blank ones are skipped. Cells keep their spaces. Every step is
    linear in the payload.
    """
    lines = ("filter(CASE WHEN instr(raw, '\"') = 0 THEN split(raw, '[\\r\\n]') "
             f"ELSE regexp_extract_all(raw, {sql_str(CSV_RECORD_RE)}, 0) END, l -> l != '')")
    cells = _cells("l")
    header = _cells("element_at(csv_lines, 1)")

    def cell(name: str) -> str:
        pos = f"cast(array_position(csv_header, '{name}') AS int)"
        return f"CASE WHEN {pos} > 0 THEN try_element_at(r.cells, {pos}) END"

    rows = ("transform(slice(csv_lines, 2, greatest(size(csv_lines) - 1, 0)), (l, i) -> "
            f"named_struct('line_no', i, 'cells', {cells}))")
    typed = ("transform(csv_raw_rows, r -> named_struct("
             "'line_no', r.line_no, "
             f"'patient_id', {cell('patient_id')}, "
             f"'assessment_date', {cell('assessment_date')}, "
             f"'metric_name', {cell('metric_name')}, "
             f"'metric_value_text', {cell('metric_value')}, "
             f"'category', {cell('category')}, "
             "'width_ok', size(r.cells) = size(csv_header), "
             f"'value_ok', coalesce({cell('metric_value')} rlike {sql_str(FLOAT_RE)}, false)))")
    return {
        "csv_lines": F.expr(f"CASE WHEN provider = 'provider_c' THEN {lines} END"),
        "csv_header": F.expr(f"CASE WHEN size(csv_lines) > 0 THEN {header} ELSE array() END"),
        "csv_raw_rows": F.expr(rows),
        "csv_rows": F.expr(typed),
    }


def _score(dim: str, value: str) -> str:
    return f"named_struct('dimension', {dim}, 'value', {value}, 'scale', '{TARGET_SCALE}')"


A_DATE = utc_ntz_sql("try_variant_get(try_element_at(am, 'date'), '$', 'timestamp')")


def norm_a() -> str:
    """Nested JSON: scores x10 (0-10 -> 0-100, no clamp); date or ingest time."""
    scores = ("transform(map_entries(sm), e -> "
              + _score("e.key", "try_variant_get(e.value, '$', 'double') * 10.0D") + ")")
    return ("array(named_struct("
            "'patient_id', try_variant_get(try_element_at(pm, 'id'), '$', 'string'), "
            f"'assessment_date', coalesce({A_DATE}, ingested_at), "
            "'assessment_type', try_variant_get(try_element_at(am, 'type'), '$', 'string'), "
            f"'scores', {scores}))")


def b_scores(map_sql: str = "m") -> str:
    """Numeric ``score_*`` entries of a flat payload's root map (other types are dropped)."""
    return (f"transform(filter(map_entries({map_sql}), "
            f"e -> startswith(e.key, '{SCORE_PREFIX}') AND {is_numeric_sql('e.value')}), "
            "e -> " + _score(f"substr(e.key, {len(SCORE_PREFIX) + 1})", "try_variant_get(e.value, '$', 'double')") + ")")


def norm_b() -> str:
    """Flat key-value JSON: values already 0-100; date is the ingest time."""
    return ("array(named_struct("
            "'patient_id', try_variant_get(try_element_at(m, 'patient_id'), '$', 'string'), "
            "'assessment_date', ingested_at, "
            "'assessment_type', try_variant_get(try_element_at(m, 'assessment_type'), '$', 'string'), "
            "'scores', bsc))")


def c_sorted() -> str:
    """The CSV rows in the order of their group and line."""
    return ("array_sort(transform(csv_rows, r -> named_struct('patient_id', r.patient_id, 'assessment_date', "
            "r.assessment_date, 'category', r.category, 'line_no', r.line_no, 'metric_name', r.metric_name, "
            "'metric_value_text', r.metric_value_text)))")


def c_starts() -> str:
    """1-based places in the sorted rows at which a group (patient, raw date text, category) begins, and the end."""
    def differs(field: str) -> str:
        return f"NOT (element_at(csv_sorted, i).{field} <=> element_at(csv_sorted, i - 1).{field})"

    begins = "i = 1 OR " + " OR ".join(differs(f) for f in ("patient_id", "assessment_date", "category"))
    return (f"CASE WHEN size(csv_sorted) > 0 THEN concat(filter(sequence(1, size(csv_sorted)), i -> {begins}), "
            "array(size(csv_sorted) + 1)) END")


def c_group_keys() -> str:
    return ("CASE WHEN csv_starts IS NULL THEN filter(transform(csv_sorted, r -> named_struct('patient_id', "
            "r.patient_id, 'assessment_date', r.assessment_date, 'category', r.category)), x -> false) "
            "ELSE transform(slice(csv_starts, 1, size(csv_starts) - 1), i -> named_struct("
            "'patient_id', element_at(csv_sorted, i).patient_id, "
            "'assessment_date', element_at(csv_sorted, i).assessment_date, "
            "'category', element_at(csv_sorted, i).category)) END")


def norm_c() -> str:
    """CSV rows grouped by (patient, raw date text, category); x10; date at 00:00 UTC.

    The rows are sorted by group once and cut where a group begins. Scores keep
    line order; groups come out sorted by their key.
    """
    members = ("slice(csv_sorted, element_at(csv_starts, j + 1), "
               "element_at(csv_starts, j + 2) - element_at(csv_starts, j + 1))")
    scores = f"transform({members}, r -> {_score('r.metric_name', 'cast(r.metric_value_text AS double) * 10.0D')})"
    return (f"transform(csv_keys, (k, j) -> named_struct("
            "'patient_id', k.patient_id, "
            "'assessment_date', to_timestamp_ntz(k.assessment_date, 'yyyy-M-d'), "
            "'assessment_type', k.category, "
            f"'scores', {scores}))")


def norm_c_ok() -> str:
    return "forall(csv_keys, k -> try_to_timestamp(k.assessment_date, 'yyyy-M-d') IS NOT NULL)"


def norm_c_error() -> str:
    bad = "filter(csv_keys, k -> try_to_timestamp(k.assessment_date, 'yyyy-M-d') IS NULL)"
    return f"concat('parse error: invalid date ''', try_element_at({bad}, 1).assessment_date, '''')"


def metadata(provider: Column, ingested_at: Column) -> Column:
    """Metadata stamped on every unified record."""
    fmt = F.lit(None).cast("string")
    for name, f in PROVIDER_FORMATS.items():
        fmt = F.when(provider == name, F.lit(f)).otherwise(fmt)
    return F.struct(provider.alias("source_provider"), fmt.alias("source_format"),
                    ingested_at.alias("ingested_at"), F.lit(SCHEMA_VERSION).alias("version"))


def source_format(provider: Column, formats: dict[str, str] = PROVIDER_FORMATS) -> Column:
    out = F.lit(None).cast("string")
    for name, f in formats.items():
        out = F.when(provider == name, F.lit(f)).otherwise(out)
    return out


@dataclass(frozen=True)
class ScoreSpec:
    """Declarative provider: where the fields are, and the input scale.

    Paths are VARIANT paths (``$.a.b``); ``scores_path`` addresses an object
    of dimension -> number. Scores are rescaled from the named preset (or an
    explicit range) to 0-100 with clamping.
    """

    name: str
    patient_id_path: str
    assessment_type_path: str
    scores_path: str
    date_path: str | None = None
    scale: str = "0-10"
    in_range: tuple[float, float] | None = None


def norm_declarative(df: DataFrame, spec: ScoreSpec, raw_col: str = "raw",
                     ingested_col: str = "ingested_at") -> DataFrame:
    """One assessment per payload from a :class:`ScoreSpec`.

    Adds ``assessments`` (same shape as the fixed providers) and ``spec_ok``
    (false when a required path is missing or mistyped).
    """
    lo, hi = spec.in_range or SCALE_PRESETS[spec.scale]
    v = F.try_parse_json(F.col(raw_col))
    scores_map = F.try_variant_get(v, spec.scores_path, "map<string,variant>")
    entries = F.filter(F.map_entries(scores_map),
                       lambda e: F.schema_of_variant(e["value"]).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"))
    scores = F.transform(entries, lambda e: F.struct(
        e["key"].alias("dimension"),
        rescale(F.try_variant_get(e["value"], "$", "double"), lo, hi).alias("value"),
        F.lit(TARGET_SCALE).alias("scale")))
    date = (utc_ntz(F.try_variant_get(v, spec.date_path, "timestamp")) if spec.date_path
            else F.lit(None).cast("timestamp_ntz"))
    pid = F.try_variant_get(v, spec.patient_id_path, "string")
    atype = F.try_variant_get(v, spec.assessment_type_path, "string")
    a = F.struct(pid.alias("patient_id"), F.coalesce(date, F.col(ingested_col)).alias("assessment_date"),
                 atype.alias("assessment_type"), scores.alias("scores"))
    ok = pid.isNotNull() & atype.isNotNull() & scores_map.isNotNull()
    return df.withColumn("assessments", F.when(ok, F.array(a))).withColumn("spec_ok", ok)
