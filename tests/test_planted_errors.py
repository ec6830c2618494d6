"""Planted errors: exactly the intended places change, everything else is skipped with its reason."""

import json
import re

import pytest

from weighbridge.operators import planted_errors as planted

GOOD = "Tom has 3 boxes of 14 pens.\nThey hold 3*14=<<3*14=42>>42 pens.\nWith 5 more he has 42+5=<<42+5=47>>47 pens.\n#### 47"
PROBLEM = "Tom has 3 boxes of 14 pens and 5 more. How many?"


def judged(spark, answers, problem=PROBLEM):
    rows = [("train", str(i), problem, a) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "split string, row string, question string, answer string")
    return planted.planted_errors(df, "seed").collect()


def numbers(text):
    return re.findall(r"\d[\d,]*(?:\.\d+)?", text)


@pytest.fixture(scope="module")
def many(spark):
    return judged(spark, [GOOD] * 240)


def test_half_are_gold_and_all_variants_occur(many):
    by = {}
    for r in many:
        by.setdefault(r["variant"], []).append(r)
    assert set(by) == {"gold", *planted.VARIANTS}
    assert 90 < len(by["gold"]) < 150
    assert all((r["label"] == "1") == (r["variant"] == "gold") for r in many)
    assert all(r["reason"] is None for r in many)


def test_only_the_planted_places_change(many):
    gold = re.sub(r"<<[^>]*>>", "", GOOD.rsplit("\n####", 1)[0]) + "\nAnswer: 47"
    base = numbers(gold)
    for r in many:
        text = json.loads(r["state"])["response"]
        got = numbers(text)
        assert len(got) == len(base) and "<<" not in text
        changed = [i for i, (a, b) in enumerate(zip(base, got)) if a != b]
        if r["variant"] == "gold":
            assert text == gold
        elif r["variant"] == "final_wrong":
            assert [base[i] for i in changed] == ["47", "47"] and len({got[i] for i in changed}) == 1
        elif r["variant"] == "step_wrong":
            assert [base[i] for i in changed] == ["42"] and r["step"] == 0
        else:
            wrong, total = int(got[changed[0]]), int(got[-1])
            assert wrong != 42 and total == wrong + 5 and [base[i] for i in changed] == ["42", "42", "47", "47"]


def test_order_of_rows_does_not_matter(spark, many):
    again = {r["id"]: r["state"] for r in judged(spark, [GOOD] * 240)}
    assert again == {r["id"]: r["state"] for r in many}


@pytest.mark.parametrize("answer, reasons", [
    ("No final line", {"malformed final answer"}),
    ("x\n#### -5", {"negative final answer"}),
    ("x\n#### 12 apples", {"malformed final answer"}),
])
def test_unusable_answers(spark, answer, reasons):
    assert {r["reason"] for r in judged(spark, [answer] * 8)} == reasons


def test_step_variants_name_the_filter_that_failed(spark):
    no_steps = {r["variant"]: r["reason"] for r in judged(spark, ["It is 9.\n#### 9"] * 60)}
    assert no_steps["step_wrong"] == no_steps["step_wrong_propagated"] == "no calculator steps"
    assert no_steps["gold"] is None and no_steps["final_wrong"] is None
    given = {r["variant"]: r["reason"] for r in judged(spark, [GOOD] * 60, PROBLEM + " Not 42.")}
    assert given["step_wrong"] == "step value appears in the problem"


def test_separators_and_decimals_keep_their_style(spark):
    text = "Cost 2*1,250=<<2*1250=2500>>2,500 dollars.\nPlus .5 is 2500+.5=<<2500+.5=2500.5>>2,500.5.\n#### 2,500.50"
    for r in judged(spark, [text] * 80, "Two at 1,250 and a half dollar."):
        if r["variant"] == "step_wrong":
            assert re.search(r"=\d,\d{3} dollars", json.loads(r["state"])["response"])


def test_exact_arithmetic():
    assert planted.evaluate("0.1+0.2") * 10 == 3
    assert planted.evaluate("7//2") == 3 and planted.evaluate("2**5") == 32
    for bad in ("__import__('os')", "2**13.5", "1/0", "a+1", "2**99"):
        with pytest.raises(planted.Skip):
            planted.evaluate(bad)


def test_numbers_beyond_exact_decimals_are_refused(spark):
    assert {r["reason"] for r in judged(spark, ["x\n#### 1.123456789012"] * 8)} == {"malformed final answer"}


def test_an_operand_that_cannot_be_rewritten_is_refused():
    ledger = planted.Ledger("Half: 1/2=<<1/2=0.5>>0.5 then 4*.5=<<4*.5=2>>2 and 0.5+.5=<<0.5+.5=1>>1.")
    with pytest.raises(planted.Skip):
        ledger.consequences(0, planted.exact("0.75"))


def test_gold_rows_parse_no_steps(spark):
    text = "2*3=<<2*3=6>>6 and 6+1=<<6+1=7>>7.\n#### 7"
    rows = spark.createDataFrame([("t", v, "Is 2 3?", text, v) for v in ("gold", "final_wrong", "step_wrong")], "split string, row string, question string, answer string, variant string")
    got = {r["variant"]: (r["steps"], r["given"]) for r in planted.parse_solutions(rows).collect()}
    assert got["gold"] == (None, None) and got["final_wrong"][1] is None
    assert [s["visible"] for s in got["step_wrong"][0]] == [True, True] and len(got["step_wrong"][1]) == 2


def test_whole_numbers_stay_whole():
    assert [type(planted.exact(t)) for t in ("1,200", "3.0", "0.5")] == [int, int, planted.Fraction]
    assert type(planted.evaluate("6/3")) is int and planted.evaluate("2**-1") == planted.Fraction(1, 2)
    assert [planted._rounded(n, 10) for n in (5, 15, 25, 26, 0)] == [round(planted.Fraction(n, 10)) for n in (5, 15, 25, 26, 0)]


def test_lines_with_the_same_key_stay_single_rows(spark, tmp_path):
    import check

    base = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{base}/lineitem.parquet").filter("l_orderkey < 100")
    lines.unionByName(lines).coalesce(1).write.parquet(str(tmp_path / "folder"))
    next((tmp_path / "folder").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    (tmp_path / "part.parquet").write_bytes(open(f"{base}/part.parquet", "rb").read())
    status, rows, detail = check.compare(spark, check.database(str(tmp_path)), "c09_changed_numbers", str(tmp_path))
    assert (status, rows) == ("ok", 2 * lines.count()), detail


def test_all_variants_come_from_one_reading(spark):
    from weighbridge.plans.catalog import QUERIES

    plan = QUERIES["c09_changed_numbers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The order lines and the parts they are joined with, each once; nothing is written and read back between.
    assert plan.count("parquet") == 2 and plan.count("Join ") == 1 and plan.count("ArrowEvalPython") == 1


def test_kept_columns_may_be_named_like_helpers(spark):
    rows = [("train", i, PROBLEM, GOOD, f"b{i}", -i) for i in range(24)]
    df = spark.createDataFrame(rows, "split string, row int, question string, answer string, body string, target int")
    got = planted.planted_errors(df, "seed", keep=["body", "target"]).collect()
    assert sorted((r["row"], r["body"], r["target"]) for r in got) == [(i, f"b{i}", -i) for i in range(24)]
    assert all(r["reason"] is None for r in got)


def test_a_long_number_does_not_stop_the_others(spark):
    long = "It is 9.\n#### 123456789012345678901234"
    for r in judged(spark, [long] * 24):
        if r["variant"] == "final_wrong":
            assert 0 < abs(int(json.loads(r["state"])["response"].rsplit(" ", 1)[1]) - 123456789012345678901234) <= 10


def test_a_number_stands_behind_no_digit_point_or_comma():
    pattern = re.compile(planted.NUMBER)
    found = lambda text: [m[0] for m in pattern.finditer(text)]
    assert found("7 1,234 x12.5.6 .5 1,23 12,345,6 a1") == ["7", "1,234", "12.5", "1", "12", "1"]
    assert pattern.match("3=3") and not pattern.match("a3") and not pattern.match("1.5", 2)
