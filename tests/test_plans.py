"""Plan shape: the gate is map-only and Python-free; filters reach the scan."""

from assaykit.plans import pipeline as P
from assaykit.plans.catalog import QUERIES
from assaykit.operators import validate as V
from assaykit.session import scratch_dir

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gate_over_a_scan_has_no_exchange_and_no_python(spark):
    from assaykit.sources import synth, tables
    path = scratch_dir(spark, "t-plan") + "/payloads"
    synth.provider_b_payloads(tables.table(spark, SF, "events")).write.parquet(path)
    conf = P.GATE_PARTITIONS_CONF
    old = spark.conf.get(conf, None)
    spark.conf.unset(conf)          # cluster setting: no spreading
    try:
        plan = _plan(P.run_gate(spark.read.parquet(path)))
    finally:
        if old:
            spark.conf.set(conf, old)
    assert "Exchange" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_stale_outbox_is_top_k_with_pushed_filter(spark):
    plan = _plan(QUERIES["q_stale_outbox"](spark, SF))
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(o_orderstatus,O)" in plan


def test_one_provider_is_filtered_before_the_gate(spark):
    plan = _plan(QUERIES["norm_c"](spark, SF))
    assert plan.count("FileScan parquet") == 1          # the union branches of the other providers are gone


def test_scrub_is_not_repeated_by_the_explode(spark):
    plan = QUERIES["norm_b"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "(size(transform(" not in plan


def test_audit_verdict_gates_once(spark):
    df = QUERIES["audit_verdict"](spark, SF)
    df.collect()
    assert "ReusedExchange" in _plan(df)


def test_first_wins_combines_map_side(spark):
    plan = _plan(QUERIES["agg_first_wins"](spark, SF))
    assert plan.count("HashAggregate") + plan.count("ObjectHashAggregate") + plan.count("SortAggregate") >= 2


def test_output_checks_are_subset_of_post(spark, payloads):
    # any payload whose post check passes has no output errors either
    g = P.run_gate(payloads(("provider_b", '{"patient_id": "P", "assessment_type": "t", "score_x": 5}')))
    row = g.selectExpr(f"{V.output_errors()} AS oe", "stage").first()
    assert row["stage"] == "ok" and row["oe"] == []


def _optimized(name, spark):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def _json_reads(plan, source):
    """How often the plan parses a JSON text again that it has just written."""
    return plan.count(f"get_json_object({source}") + plan.count("from_json(") + plan.count("JsonToStructsEvaluator")


def test_envelope_is_read_back_by_one_parse(spark):
    plan = _optimized("build_envelope", spark)
    assert _json_reads(plan, "payload") == 1


def test_camel_json_is_read_back_by_one_parse(spark):
    plan = _optimized("camel_json", spark)
    assert _json_reads(plan, "j#") == 1


def test_events_are_dealt_instead_of_their_payloads(spark):
    conf = P.GATE_PARTITIONS_CONF
    old = spark.conf.get(conf)
    spark.conf.unset(conf)          # cluster setting
    try:
        plan = _optimized("assign_id", spark)
    finally:
        spark.conf.set(conf, old)
    dealt = [line for line in plan.splitlines() if "Repartition " in line]
    above = plan[:plan.index("Repartition ")]
    assert len(dealt) == 3 and "Union" in above      # once a format, below the union of the formats
