from pyspark.sql import functions as F

from episodica.operators import audit, transfer

CANDIDATE = "question string, source string, eligible boolean, correct boolean, format_compliant boolean, termination string, reasons array<string>, searches long, executed long, repeated long, no_progress long, unique_docs long, evidence string, grounded boolean, prompt_tokens long"


def test_audit_of_nulls_and_of_nothing(spark):
    rows = spark.createDataFrame([(None,) * 15, ("q", "hop", True, True, True, "answer", ["a", "a"], 2, 2, 1, 1, 3, "A", True, 9)], CANDIDATE)
    got = {(r["section"], r["key"]): r["value"] for r in audit.audit(rows, "hop", "one").collect()}
    assert got["all", "candidate_count"] == 2 and got["all", "strict_eligible_rate"] == 0.5
    assert got["all", "correct_after_repeat_or_no_progress"] == 1
    assert got["reason", "a"] == 2 and got["source", "None"] == 1 and got["evidence", "A"] == 1
    assert got["prompt_tokens", "mean"] == 4.5 and got["prompt_tokens", "q100"] == 9
    none = {(r["section"], r["key"]): r["value"] for r in audit.audit(rows.limit(0), "hop", "one").collect()}
    assert none["all", "candidate_count"] == 0 and none["all", "exact_match"] is None


def test_taken_over(spark):
    ddl = "prediction string, exact_match int, f1 double, format_compliant boolean, invalid_reasons array<string>, search_count int, search_attempt_count int, termination_reason string, extra int"
    rows = [(None,) * 9, ("x", 1, 1.0, True, ["no_new_documents", None, "max_rounds_without_answer"], 2, 3, "answer", 5), ("x", 1, 1.0, True, None, 1, 1, "answer", 6)]
    null, recovered, strict = transfer.taken_over(spark.createDataFrame(rows, ddl)).orderBy(F.col("extra").asc_nulls_first()).collect()
    assert not null["valid_trajectory"] and null["v0_exact_match"] == 0 and null["recoverable_reasons"] == []
    assert recovered["recovered_success"] and not recovered["strict_success"] and recovered["recoverable_reasons"] == ["no_new_documents"]
    assert strict["strict_success"] and strict["origin"] == "v0_reused" and strict["f1_delta_vs_v0"] == 0.0
