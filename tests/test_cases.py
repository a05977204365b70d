"""Validation cases: their names, and how often the work on them is done."""

import hashlib
import re

from pyspark.sql import functions as F

from tracelens.operators import judge as J
from tracelens.operators import sampling as A
from tracelens.operators import validation as V
from tracelens.plans import catalog


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cases_of_odd_names(spark):
    odd = ["a b", "a_b", "a é b", None, "", "__", "a__", "x/y?z"]
    rows = [(p, q, r, rank, s, (v, None if i % 3 else not v, v)) for i, (p, q, r, rank, s, v) in enumerate((p, q, r, rank, s, rank == 1) for p in odd[:3] for q in odd for r in odd[3:] for rank in (1, None) for s in ("snippet_only", "a page"))]
    kind = "provider_id string, query_id string, retrieval_id string, rank int, judge_surface_class string, judgment struct<gold_answer_in_snippets: boolean, gold_answer_in_extracted_page: boolean, contradicts_gold_answer: boolean>"
    want, merged = [], {}
    for p, q, r, rank, s, values in rows:
        for label, value in zip(("snippet_gold", "page_gold", "contradiction"), values):
            if value is not None:
                case = re.sub(r"[^A-Za-z0-9_.:-]+", "_", "__".join([p or "", q or "", r or "", f"r{rank}", s or "", label]))
                want.append((p, q, r, rank, s, label, value, case))
                merged[case, p, s, label] = merged.get((case, p, s, label), False) or value
    records = spark.createDataFrame(rows, kind)
    cases = J.unpivot(records)
    assert cases.columns == ["provider_id", "query_id", "retrieval_id", "rank", "judge_surface_class", "label", "value", "case_id"]
    assert sorted(map(str, map(tuple, cases.collect()))) == sorted(map(str, want))
    got = {(c["case_id"], c["provider_id"], c["surface"], c["label"]): c["machine"] for c in J.merged_cases(records).collect()}
    assert got == merged


def test_names_are_cleaned_once_a_record(spark, sf_dir):
    for name in ("merged_labels", "validation_cases", "balanced_cases"):
        plan = _plan(catalog.queries()[name](spark, sf_dir))
        assert "regexp_replace" in plan and "regexp_replace" not in plan.split("Generate")[0], name
        assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]


def test_reports_count_cases_once(spark, sf_dir):
    """The reports read counts that were taken once, and not the cases again for each of their parts."""
    for name in ("agreement_report", "quota_report"):
        plan = _plan(catalog.queries()[name](spark, sf_dir))
        assert "lineitem" not in plan and "md5" not in plan, name


def test_agreement_of_few_cases(spark):
    cases = spark.createDataFrame([("a", "p", "s", "l", True), ("b", "p", "s", "m", False), ("c", "q", None, "m", True), ("d", "q", "s", "m", True)], "case_id string, provider_id string, surface string, label string, machine boolean")
    sheet = spark.createDataFrame([("a", "false", "x"), ("b", "true", ""), ("c", "unclear", "y"), ("z", "true", "x")], "case_id string, human_value string, pattern string")
    got = {(r["kind"], r["name"]): tuple(r)[2:] for r in V.agreement_report(cases, sheet).select("kind", "name", "sampled", "reviewed", "clear", "unclear", "agree", "disagree", "top_pattern", "agreement_rate").collect()}
    assert got["all", "all"] == (4, 3, 2, 1, 0, 2, "unspecified", 0.0) and got["label", "m"] == (3, 2, 1, 1, 0, 1, "unspecified", 0.0)
    assert got["surface", None] == (1, 1, 0, 1, 0, 0, "", None) and got["provider", "q"] == (2, 1, 0, 1, 0, 0, "", None) and len(got) == 7


def _balanced(rows, cap):
    """cell, key and flag of the keys to take, of (cell, key, flag) rows."""
    merged, out = {}, set()
    for cell, key, flag in rows:
        if flag is not None:
            merged[cell, key] = merged.get((cell, key), False) or flag
    draw = lambda key: ("", "") if key is None else (hashlib.md5(f"{A.SEED}:{key}".encode()).hexdigest(), key)
    for cell in {c for c, _ in merged}:
        keys = sorted((k for c, k in merged if c == cell), key=draw)
        yes, no = ([k for k in keys if merged[cell, k] is flag] for flag in (True, False))
        chosen, rest = yes[: cap // 2] + no[: cap - cap // 2], yes[cap // 2 : cap] + no[cap - cap // 2 : cap]
        out |= {(cell, k, merged[cell, k]) for k in chosen + sorted(rest, key=draw)[: cap - len(chosen)]}
    return out


def test_balanced_keys_of_several_rows(spark):
    """Flags that are common, rare, mixed within a key, null or missing; a cell's name and a key may be null."""
    rows = []
    for i in range(3000):
        rows += [("even", f"a{i}", i % 2 == 0), ("rare yes", f"b{i}", i in (7, 2900)), ("rare no", f"c{i}", i % 1000 != 3), (None, f"d{i}", i % 3 == 0)]
        # A yes of a later row turns over most of these keys.
        rows += [("mixed", f"e{i}", False), ("mixed", f"e{i}", None if i % 50 == 0 else True)]
    rows += [("few", "x", False), ("few", "x", True), ("few", "y", None), ("few", None, True), ("even", None, False), ("none", "z", None), ("all yes", "u", True), ("all yes", "v", True)]
    for cap in (8, 3, 1):
        # Rows of a key lie apart, in different tasks.
        table = spark.createDataFrame(rows, "cell string, key string, flag boolean").repartition(7)
        got = [tuple(r) for r in A.balanced_keys(table, ["cell"], "flag", "key", cap).select("cell", "key", "flag").collect()]
        assert len(got) == len(set(got)) and set(got) == _balanced(rows, cap), cap


def test_few_cases_are_merged_and_sorted(spark, sf_dir):
    """Windows and merge stand over a join with the cells' bounds, not over all cases."""
    plan = _plan(catalog.queries()["balanced_cases"](spark, sf_dir))
    near, joined, _ = plan.partition("last_no__")
    assert joined and "Window" in near and "Aggregate" in near and "Generate" not in near and "lineitem" not in near


def test_names_are_matched_by_a_table_of_characters(spark, sf_dir):
    """Ranges of characters cost a test each on every character of every name."""
    for name in ("merged_labels", "validation_cases", "balanced_cases"):
        assert "A-Z" not in _plan(catalog.queries()[name](spark, sf_dir)), name
