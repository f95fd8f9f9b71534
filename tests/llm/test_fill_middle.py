"""Fill-in-the-middle against plain Python: code points and other units, odd rows, repeats, and the way back."""

from __future__ import annotations

import hashlib
import re

import pytest

from foretide.llm import fill_middle
from tests.llm.test_operators import ODD, SCHEMA

MORE = [(11, "a <P> in the text"), (12, "ends in <"), (13, "<S"), (14, "x"), (15, "🙂🙂é"), (16, "<M>"), (17, "\n"), (18, "word " * 20_000), (19, "< <P <M S> P> M>" * 9), (-3, "id below zero")]


def _plain(doc_id, text, seed, units):
    """form, prefix, middle, suffix."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    form = "plain" if not units or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    return form, "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])


@pytest.mark.parametrize(("unit", "python", "run", "seed"), [("(?s).", "(?s).", 64, 1), ("(?s).", "(?s).", 1, 3), (r"\S+\s*|\s+", r"\S+\s*|\s+", 5, 2), ("[^\n]*\n|[^\n]+", "[^\n]*\n|[^\n]+", 2, 1)])
def test_units(spark, unit, python, run, seed):
    rows = [*ODD, *MORE, *((100 + i, f"line {i}\nof some words " * (i % 7)) for i in range(80))]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "k", "h", 3) for i, t in rows], SCHEMA)
    made = fill_middle.fill_in_middle(docs, seed=seed, unit=unit, run=run)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(made.output, made.form).alias("back"), "text").collect()
    want = []
    for i, t in rows:
        units = re.findall(python, t or "")
        form, p, m, s = _plain(i, t or "", seed, units)
        output = {"plain": t or "", "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        of = (None, None) if form == "plain" else (len(p), len(m))
        want.append((i, len(units), form, *of, output, t or "", t or ""))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_are_shuffled_once(spark, sf):
    """All parts of the plan read one exchange of the rows."""
    made = fill_middle.op13_fill_middle(spark, sf)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("REPARTITION_BY_COL") == 1 + final.count("ReusedExchange") and final.count("ReusedExchange") >= 1
