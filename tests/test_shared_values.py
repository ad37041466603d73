import random

import pytest

from lakeweave.operators import lake as L


@pytest.mark.parametrize("most", [50, 3])
def test_shared_values(spark, most):
    """a row was made for each value and pair of tables that share it."""
    r = random.Random(2)
    rows = [(f"t{r.randint(0, 11)}", r.randint(0, 60)) for _ in range(400)] + [(None, 1), ("t1", None), ("alone", 1000)]
    out = L.shared_values(spark.createDataFrame(rows, "t string, v long").repartition(5), most)
    assert ("Join" in out._jdf.queryExecution().executedPlan().toString()) == (most == 3)
    of = {}
    for t, v in rows:
        if t and v is not None:
            of.setdefault(t, set()).add(v)
    assert {(x.q, x.c): x.x for x in out.collect()} == {(a, b): len(of[a] & of[b]) for a in of for b in of if a != b and of[a] & of[b]}
