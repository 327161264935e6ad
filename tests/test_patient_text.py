"""Lines of patient text: results and what they exchange."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from vitalgrid.operators.events import patient_text_lines

SCHEMA = "subject_id long, hadm_id long, itemid long, category string, param_type string, label string, starttime timestamp_ntz, value string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    items = [(1, "Routine", "Numeric", "Rate"), (1, "Routine", None, "Rate"), (2, None, None, "Flow"), (None, "Labs", "fluid", None), (3, "User imported", "x", "Mine")]
    out = []
    for _ in range(3000):
        i = r.choice(items)
        when = None if r.random() < 0.03 else datetime(2024, 1, 1) + timedelta(hours=r.randrange(24 * 90))
        out.append((r.choice([1, 2, None]), r.choice([10, None]), *i, when, None if r.random() < 0.1 else f"{r.randrange(50) / 7}"))
    return out + out[:40]


def plain(rows, size):
    least, out = {}, {}
    for subject, hadm, item, category, kind, label, when, value in rows:
        if value is not None and category != "User imported":
            key = (subject, hadm, item, " ".join(x for x in (category, kind, label, item and str(item)) if x))
            least[key, when] = min(value, least.get((key, when), value))
    for (key, when), value in sorted(least.items(), key=lambda x: (x[0][1] is not None, x[0][1] or 0)):
        out.setdefault(key, []).append(value)
    return {(*k, i // size): " ".join(v[i:i + size]) for k, v in out.items() for i in range(0, len(v), size)}


@pytest.mark.parametrize("most", [0, 260, 1 << 18])
def test_lines_of_large_and_small_admissions(spark, rows, most):
    """None, all or some admissions have more rows than one task puts in order."""
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = patient_text_lines(d, 7, most).collect()
    assert len({r["subject_id"] for r in got}) == 3
    assert {(r["subject_id"], r["hadm_id"], r["itemid"], r["title"], r["part"]): r["values"] for r in got} == plain(rows, 7) and len(got) == len(plain(rows, 7))


def test_values_of_usual_admissions_pass_one_exchange_without_titles(spark, rows):
    done = patient_text_lines(spark.createDataFrame(rows, SCHEMA), 7)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")]
    moved = [x for x in final.split("\n") if "Exchange hashpartitioning(" in x]
    assert [("name#" in x, "title#" in x) for x in moved if "REPARTITION_BY_COL" in x] == [(False, False)]
    assert not any("__span" in x or "starttime" in x for x in moved)
