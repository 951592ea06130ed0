"""Provider payloads derived from the ``events`` table.

The driver tables hold no assessments, so each payload format is built from
event rows by fixed rules (the same rules are written out in the DuckDB
oracles). Texts are assembled from integers and strings only, so every engine
produces the same bytes and therefore the same hashes.

* provider A (nested JSON): one payload per event;
* provider B (flat key-value JSON): one payload per event;
* provider C (CSV): one payload per (user, day, id-chunk), a line per event;
* batch submissions: a JSON array per (user, day, id-chunk), an item per event.

Chunks group at most ``CHUNK`` consecutive event ids, so a payload stays
bounded even when one user holds a large share of all events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from assaykit.schemas import PROVIDER_A, PROVIDER_B, PROVIDER_C

CHUNK = 4096
CSV_HEADER = "patient_id,assessment_date,metric_name,metric_value,category"
CSV_HEADER_NO_CATEGORY = "patient_id,assessment_date,metric_name,metric_value"


def _s(c: Column) -> Column:
    return c.cast("string")


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def dec2(c: Column) -> Column:
    """cents -> 'd.dd'"""
    return F.concat(_s(F.floor(c / 100)), F.lit("."), F.lpad(_s(c % 100), 2, "0"))


def dec3(c: Column) -> Column:
    """cents -> value/10 as 'd.ddd'"""
    return F.concat(_s(F.floor(c / 1000)), F.lit("."), F.lpad(_s(c % 1000), 3, "0"))


def _base(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", "user_id", "event_type",
        cents(F.col("value")).alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def provider_a_payloads(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    uid = _s(F.col("user_id"))
    pid = F.concat(F.lit("U"), uid)
    k_text = F.concat(_s(F.floor(F.col("k") / 10)), F.lit("."), _s(F.col("k") % 10))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    date_part = F.when(e % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"date": '), _q(iso), F.lit(", ")))
    k_json = F.when(e % 13 == 0, _q(k_text)).otherwise(k_text)
    assessment = F.concat(
        F.lit('"assessment": {'), date_part, F.lit('"type": '), _q(F.col("event_type")),
        F.lit(', "scores": {"value": '), dec3(F.col("cents")), F.lit(', "k": '), k_json,
        F.lit('}, "notes": "note '), _s(e), F.lit('"}'))
    patient = F.concat(F.lit('"patient": {"id": '),
                       F.when(e % 19 == 0, uid).otherwise(_q(pid)),
                       F.lit(', "name": "Patient '), uid, F.lit('", "dob": "1990-01-01"}'))
    raw = (F.when(e % 23 == 0, F.concat(F.lit('{"patient": {"id": '), _q(pid)))
           .when(e % 17 == 0, F.concat(F.lit("{"), assessment, F.lit("}")))
           .otherwise(F.concat(F.lit("{"), patient, F.lit(", "), assessment, F.lit("}"))))
    provider = F.when(e % 43 == 0, F.lit("provider_z")).otherwise(F.lit(PROVIDER_A))
    return _base(events).select(
        F.concat(F.lit("a-"), _s(e)).alias("payload_id"), provider.alias("provider"),
        raw.alias("raw"), (F.col("ts") + F.expr("INTERVAL 1 HOURS")).alias("received_at"))


def provider_b_payloads(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    uid = _s(F.col("user_id"))
    head = F.concat(F.lit('{"patient_id": "U'), uid, F.lit('"'))
    name = F.concat(F.lit(', "patient_name": "Patient '), uid, F.lit('"'))
    atype = F.concat(F.lit(', "assessment_type": '), _q(F.col("event_type")))
    value = dec2(F.col("cents"))
    k = _s(F.col("k"))
    raw = (F.when(e % 23 == 0, F.concat(head, F.lit(', "score_value": ')))
           .when(e % 17 == 0, F.concat(head, name, atype, F.lit("}")))
           .when(e % 29 == 0, F.concat(head, atype, F.lit(', "score_value": '), _q(value), F.lit("}")))
           .when(e % 31 == 0, F.concat(head, atype, F.lit(', "score_": '), k,
                                       F.lit(', "score_value": '), value, F.lit("}")))
           .otherwise(F.concat(head, name, atype, F.lit(', "score_value": '), value,
                               F.lit(', "score_k": '), k, F.lit(', "notes": "note '), _s(e), F.lit('"}'))))
    return _base(events).select(
        F.concat(F.lit("b-"), _s(e)).alias("payload_id"), F.lit(PROVIDER_B).alias("provider"),
        raw.alias("raw"), F.col("ts").alias("received_at"))


def _chunked(events: DataFrame) -> DataFrame:
    return _base(events).withColumns({
        "day": F.date_format("ts", "yyyy-MM-dd"),
        "chunk": F.floor(F.col("event_id") / CHUNK),
    })


def provider_c_payloads(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    value = F.when(e % 37 == 0, F.lit("n/a")).otherwise(dec3(F.col("cents")))
    line = F.concat_ws(",", F.concat(F.lit("U"), _s(F.col("user_id"))), F.col("day"),
                       F.concat(F.lit("metric_"), _s(e % 3)), value, F.col("event_type"))
    grouped = (_chunked(events)
               .groupBy("user_id", "day", "chunk")
               .agg(F.array_sort(F.collect_list(F.struct(e.alias("event_id"), line.alias("line")))).alias("lines"),
                    F.min("event_id").alias("first_id"), F.max("ts").alias("received_at")))
    header = F.when(F.col("first_id") % 41 == 0, F.lit(CSV_HEADER_NO_CATEGORY)).otherwise(F.lit(CSV_HEADER))
    raw = F.concat_ws("\n", header, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return grouped.select(
        F.concat_ws("-", F.lit("c"), _s(F.col("user_id")), F.col("day"), _s(F.col("chunk"))).alias("payload_id"),
        F.lit(PROVIDER_C).alias("provider"), raw.alias("raw"), "received_at")


def batch_submissions(events: DataFrame) -> DataFrame:
    """JSON arrays of ``{provider, data}`` items (data keys in sorted order)."""
    e = F.col("event_id")
    provider = F.when(e % 11 == 0, F.lit("unknown_provider")).otherwise(F.lit(PROVIDER_B))
    data = F.concat(F.lit('{"assessment_type":'), _q(F.col("event_type")),
                    F.lit(',"patient_id":"U'), _s(F.col("user_id")),
                    F.lit('","score_k":'), _s(F.col("k")),
                    F.lit(',"score_value":'), _s(F.floor(F.col("cents") / 100)), F.lit("}"))
    item = F.concat(F.lit('{"provider":'), _q(provider), F.lit(',"data":'), data, F.lit("}"))
    grouped = (_chunked(events)
               .groupBy("user_id", "day", "chunk")
               .agg(F.array_sort(F.collect_list(F.struct(e.alias("event_id"), item.alias("item")))).alias("items"),
                    F.max("ts").alias("received_at")))
    body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]"))
    return grouped.select(
        F.concat_ws("-", F.lit("s"), _s(F.col("user_id")), F.col("day"), _s(F.col("chunk"))).alias("submission_id"),
        body.alias("body"), "received_at")


def mixed_payloads(events: DataFrame, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """All three formats in one payload table.

    ``deal`` may put rows into other partitions: the events that payloads of one event are made from, and the grouped
    payloads, which otherwise come in as few partitions as their grouping leaves.
    """
    single = deal(events)
    return (provider_a_payloads(single)
            .unionByName(provider_b_payloads(single))
            .unionByName(deal(provider_c_payloads(events))))
