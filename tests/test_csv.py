"""CSV payloads against Python's own reader: quoted fields, line ends, grouping, and linear time."""

import csv
import io
import time

import pytest

from assaykit.functions import pii
from assaykit.plans import pipeline as P

PLAIN = P.GateConfig(pii.PiiPolicy(hash_salt="s" * 32, allow_internal_pii=True, store_patient_id_plaintext=True))
HEAD = "patient_id,assessment_date,metric_name,metric_value,category\n"


def expected(text):
    """Groups as (patient, type, scores) from Python's reader, sorted by group; None if a row does not fit."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    groups = {}
    for r in rows[1:]:
        if len(r) != len(rows[0]):
            return None
        row = dict(zip(rows[0], r))
        groups.setdefault((row["patient_id"], row["assessment_date"], row["category"]), []).append(
            (row["metric_name"], float(row["metric_value"]) * 10))
    return [(k[0], k[2], v) for k, v in sorted(groups.items())]


CASES = [
    HEAD + '"P\n1",2024-01-01,"m,\r\n""x""\n",6,c\nP2,2024-01-01,m2,1,c\n',
    HEAD + 'P1,2024-01-01,5" tall,6,c\nP1,2024-01-01,a"b"c,7,c\n',               # quotes inside an unquoted field are text
    HEAD + 'P1,2024-01-01,"quoted"tail,6,c\n',                                    # text after the closing quote
    HEAD + 'P1,2024-01-01,m,6,"never closed\nP2,2024-01-01,m,6,c',                # takes the rest
    HEAD.replace("\n", "\r\n") + 'P1,2024-01-01,"a\r\nb",6,c\r\n\r\nP1,2024-01-01,m,7,c\r\n',
    HEAD.replace("\n", "\r") + "P1,2024-01-01,m,6,c\rP2,2024-01-01,m,7,c\r",      # lone carriage returns end records
    '"category",metric_value,"metric_name",assessment_date,patient_id,"ex\ntra"\n c ,6,"",2024-01-01,P1,"x\n"\n',
    HEAD + '"",2024-01-01,m,6,""\n',
    HEAD + "".join(f"P{i % 3},2024-01-0{1 + i % 2},m{i},{i % 10},c{i % 2}\n" for i in range(40)),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_records_equal_pythons_reader(spark, payloads, n):
    text = CASES[n]
    g = P.run_gate(payloads(("provider_c", text)), PLAIN).first()
    want = expected(text)
    if any("" in (pid, kind) or any(d == "" for d, _ in scores) for pid, kind, scores in want):
        assert g["stage"] == "post"
    else:
        assert g["stage"] == "ok", g
    got = [(a["patient_id"], a["assessment_type"], [(s["dimension"], s["value"]) for s in a["scores"]])
           for a in g["assessments"]]
    assert got == want


def test_rows_that_do_not_fit_fail_the_payload(payloads):
    for text in (HEAD + 'P1,2024-01-01,"a,b",6\n', HEAD + 'P1,2024-01-01,m,6,c,"x\ny"\n', HEAD + 'P1,2024-01-01,m,"6\n",c\n'):
        assert P.run_gate(payloads(("provider_c", text)), PLAIN).first()["error_kind"] == "parse"
    empty = P.run_gate(payloads(("provider_c", HEAD)), PLAIN).first()
    assert (empty["stage"], list(empty["assessments"])) == ("ok", [])


def test_many_lines_and_groups_take_linear_time(payloads):
    def seconds(n):
        text = HEAD + "".join(f'P{i},2024-01-01,"m\n""{i}""",{i % 10},c\n' for i in range(n))
        began = time.perf_counter()
        r = P.run_gate(payloads(("provider_c", text)), PLAIN).selectExpr("stage", "size(assessments) AS n").first()
        assert (r["stage"], r["n"]) == ("ok", n)
        return time.perf_counter() - began

    seconds(100)
    small, large = seconds(20_000), seconds(200_000)
    assert large < 25 * small + 5
