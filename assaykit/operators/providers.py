"""Providers that are declared instead of built in, as parts of the one gate.

A :class:`Provider` is a name, a format and three expressions over the payload row: the
violations of its structure (``pre``), whether its values have their types (``deep``) and the
unified assessments (``normalize``, the shape of :mod:`assaykit.operators.normalize`). They read
``raw``, ``ingested_at``, ``v`` (strict VARIANT parse of the text, null if it is not one JSON
value) and ``m`` (its root object as a map). Every stage, the PII scrub, the audit and the
sinks of the built-in providers then apply to it.

:func:`json_provider` makes one from paths and a scale. :func:`python_provider` makes one from
a Python function for formats that expressions cannot read: its payloads, and only those, go
through ``mapInArrow`` in batches, which turns each into JSON of one fixed schema.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assaykit.functions.jsonx import is_numeric_sql, is_object_sql, is_string_sql
from assaykit.functions.times import utc_ntz_sql
from assaykit.operators.normalize import ScoreSpec
from assaykit.operators.validate import _body_checks, _q, violation
from assaykit.schemas import PROVIDER_FORMATS, SCALE_PRESETS, TARGET_SCALE

#: What a Python reader's result becomes before the gate.
READ_SCHEMA = ("array<struct<patient_id: string, assessment_date: timestamp, assessment_type: string, "
               "scores: array<struct<dimension: string, value: double>>>>")


@dataclass(frozen=True)
class Provider:
    name: str
    format: str
    pre: str
    deep: str
    normalize: str
    #: Payload text to a list of assessments (dicts as READ_SCHEMA, dates as ISO text); raises ValueError if it can't.
    read: Callable[[str], list[dict]] | None = None

    def __post_init__(self):
        if self.name in PROVIDER_FORMATS:
            raise ValueError(f"{self.name} is a built-in provider")
        if not self.name or "'" in self.name + self.format:
            raise ValueError("a provider needs a plain name and format")


def json_provider(spec: ScoreSpec, format: str = "declared_json") -> Provider:
    """A provider of JSON payloads, one assessment each, from a spec; scores clamp into 0 to 100."""
    lo, hi = spec.in_range or SCALE_PRESETS[spec.scale]
    scores = f"try_variant_get(v, '{spec.scores_path}', 'map<string,variant>')"
    score = "try_variant_get(e.value, '$', 'double')"
    scaled = f"((least(greatest({score}, {float(lo)}D), {float(hi)}D) - {float(lo)}D) / {float(hi - lo)}D * 100.0D)"
    needed = [f"CASE WHEN NOT {test('v', path)} THEN "
              f"{violation(path[2:], kind, 'missing', f'{path[2:]} is required and must be a {kind}')} END"
              for path, kind, test in ((spec.patient_id_path, "string", is_string_sql),
                                       (spec.assessment_type_path, "string", is_string_sql),
                                       (spec.scores_path, "object", is_object_sql))]
    date = "CAST(NULL AS TIMESTAMP_NTZ)"
    deep = f"forall(map_values({scores}), x -> {is_numeric_sql('x')})"
    if spec.date_path:
        text = f"try_variant_get(v, '{spec.date_path}', 'variant')"
        date = utc_ntz_sql(f"try_variant_get(v, '{spec.date_path}', 'timestamp')")
        deep += (f" AND ({text} IS NULL OR schema_of_variant({text}) = 'VOID' OR (schema_of_variant({text}) = 'STRING' "
                 f"AND {date} IS NOT NULL))")
    normalize = (f"array(named_struct('patient_id', try_variant_get(v, '{spec.patient_id_path}', 'string'), "
                 f"'assessment_date', coalesce({date}, ingested_at), "
                 f"'assessment_type', try_variant_get(v, '{spec.assessment_type_path}', 'string'), 'scores', "
                 f"transform(map_entries({scores}), e -> named_struct('dimension', e.key, 'value', {scaled}, "
                 f"'scale', '{TARGET_SCALE}'))))")
    return Provider(spec.name, format, _body_checks(f"array_compact(array({', '.join(needed)}))"),
                    f"coalesce({deep}, false)", normalize)


def python_provider(name: str, format: str, read: Callable[[str], list[dict]]) -> Provider:
    """A provider whose payloads a Python function reads; values are taken to be on the 0 to 100 scale."""
    rows = f"from_json(to_json(v), '{READ_SCHEMA}')"
    scores = ("transform(a.scores, s -> named_struct('dimension', s.dimension, 'value', s.value, "
              f"'scale', '{TARGET_SCALE}'))")
    date = utc_ntz_sql("a.assessment_date")
    normalize = (f"transform({rows}, a -> named_struct('patient_id', a.patient_id, 'assessment_date', "
                 f"coalesce({date}, ingested_at), 'assessment_type', a.assessment_type, 'scores', {scores}))")
    empty = violation("body", "non-empty input", "empty", "input body is empty")
    # a payload that the function refuses has no JSON and so fails the typed parse
    return Provider(name, format, f"CASE WHEN octet_length(raw) = 0 THEN array({empty}) "
                                  f"ELSE filter(array({empty}), x -> false) END", "v IS NOT NULL", normalize, read)


def with_text(payloads: DataFrame, declared: tuple[Provider, ...]) -> DataFrame:
    """Payloads with ``_text``, the JSON text to parse: what a Python reader gave, or the payload as it is."""
    readers = {p.name: p.read for p in declared if p.read is not None}
    if not readers:
        return payloads.withColumn("_text", F.col("raw"))
    place, name = payloads.columns.index("raw"), payloads.columns.index("provider")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for provider, raw in zip(batch.column(name).to_pylist(), batch.column(place).to_pylist()):
                try:
                    texts.append(None if raw is None else json.dumps(readers[provider](raw), allow_nan=False))
                except (ValueError, KeyError, IndexError, TypeError):
                    texts.append(None)
            yield batch.append_column("_text", pa.array(texts, pa.string()))

    theirs = F.coalesce(F.col("provider").isin(list(readers)), F.lit(False))
    read = payloads.filter(theirs)
    schema = read.withColumn("_text", F.lit(None).cast("string")).schema
    return payloads.filter(~theirs).withColumn("_text", F.col("raw")).unionByName(read.mapInArrow(run, schema))
