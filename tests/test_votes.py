"""Votes over equal answers: normal forms by hand, votes against a loop over responses in order."""

import random

import pytest

from scenery.operators.votes import majority, normal_form, same_answer

EQUAL = [
    ["0.5", ".5", "1/2", r"\frac{1}{2}", r"\dfrac12", " 2 / 4 ", "$0.50$", "+0.5", "5e-1", r"5 \times 10^{-1}", "50 x 10^-2", "0.5 m", r"0.5\text{ meters}", "0.5 m^2", "0.5."],
    ["1,500", "1500", "1.5 thousand", "1500.0", "1500 cm", "1500%", r"1500^\circ"],
    ["-3/4", "- 3/4", r"-\frac{3}{4}", "-.75", "\u22120.75"],
    ["1 1/2", "1.5", "3/2", r"1\frac{1}{2}", "1 and 1/2"],
    ["(1, 0.5)", "(1.0,1/2)", r"\left(1, \frac{1}{2}\right)"],
    ["[1, 0.5]", "[1,1/2]"],
    ["0", "-0", "0.00", "0/7"],
    ["Front-Left", "front-left", r"\text{front-left}", "front-left."],
    ["x + 1", "x+1"],
    ["1/0"], ["-front"], ["1e999"], ["12,34"], ["(1,0.5]"], ["3 apples"], ["", "."], ["1/2/3"],
]


def test_normal_forms():
    forms = [{normal_form(t) for t in ts} for ts in EQUAL]
    assert [len(f) for f in forms] == [1] * len(EQUAL)
    assert len(set().union(*forms)) == len(EQUAL)
    assert normal_form("7" * 3000 + "/1") == "=" + "7" * 3000 + "/1"


def _voted(answers):
    counts = {}
    for a in answers:
        if not a:
            continue
        for seen in counts:
            no = "no " in a.lower() and "no " in seen.lower()
            plain = "no " not in a.lower() and "no " not in seen.lower()
            if a == seen or no or (plain and normal_form(a) == normal_form(seen)):
                counts[seen] += 1
                break
        else:
            counts[a] = 1
    best = max(counts, key=counts.get) if counts else ""
    return best, counts.get(best, 0), (counts.get(best, 0) / len(answers))


def test_votes_follow_the_order_of_responses(spark):
    draw = random.Random(3)
    pool = [t for ts in EQUAL[:8] for t in ts] + ["No object", "there is no way", None, "", "no"]
    rows = [(q, i, draw.choice(draw.sample(pool, 5))) for q in range(150) for i in range(10)] + [(-1, 0, None), (-1, 1, ""), (None, 0, "2/4"), (None, 1, "0.5")]
    want = {}
    for q, _, a in rows:
        want.setdefault(q, []).append(a)
    got = {r["q"]: (r["answer"], r["votes"], r["score"]) for r in majority(spark.createDataFrame(rows, "q int, i int, a string").repartition(5), "q", "i", "a").collect()}
    assert got.keys() == want.keys()
    for q, answers in want.items():
        assert got[q][:2] == _voted(answers)[:2] and got[q][2] == pytest.approx(_voted(answers)[2]), (q, answers)
    assert majority(spark.createDataFrame([], "q int, i int, a string"), "q", "i", "a").count() == 0


def test_same_answer(spark):
    rows = [("0.5", "1/2", True), ("Front  left.", "front left", True), ("a", None, False), (None, "a", False), ("", "", False), ("2", "3", False), ("no way", "no", False), ("no way", "No way", True)]
    got = same_answer(spark.createDataFrame(rows, "p string, t string, want boolean"), "p", "t").collect()
    assert len(got) == len(rows) and all(r["same"] == r["want"] for r in got)
