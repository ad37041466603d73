import json

from lakeweave.sources import header_trees as H

DEGREES = (3, 3, 3, 5)


def node(r, c, *below):
    return {"RI": r, "CI": c, "Cd": list(below)}


def record(rows, cols, top=None, left=None, merged=(), formatted=False):
    text = [[f"{r}.{c}" for c in range(cols)] for r in range(rows)]
    out = {"Title": "t", "MergedRegions": [dict(zip(("FirstRow", "FirstColumn", "LastRow", "LastColumn"), m, strict=True)) for m in merged], "TopHeaderRowsNumber": 1, "LeftHeaderColumnsNumber": 1, "TopTreeRoot": top, "LeftTreeRoot": left}
    if formatted:
        cell = lambda v: {"V": v, "TB": 1, "BB": 0, "LB": 0, "RB": 1, "DT": 3, "HF": 0, "FB": 1, "BC": "#ffffffff", "FC": "#ff0000ff"}
        return out | {"Cells": [[cell(v) for v in row] for row in text]}
    return out | {"Texts": text}


def root(*below):
    return {"RI": -1, "CI": -1, "Cd": list(below)}


TABLES = {
    1: record(4, 4, root(node(0, 0), node(0, 1, node(1, 1), node(1, 2))), root(node(2, 0), node(3, 0)), [(1, 2, 1, 3)], True),
    2: record(2, 3),
    3: record(3, 6, root(*[node(0, c) for c in range(6)])),  # more children than the last level may have, and more columns
    4: record(3, 3, root(node(0, 0, node(0, 1, node(0, 2, node(1, 0, node(1, 1)))))), root()),  # five levels
    5: record(2, 4, root(node(0, 0, *[node(1, c) for c in range(4)]))),
    6: record(9, 2, root(node(0, 0, *[node(1, c) for c in range(2)])), root(*[node(r, 0) for r in range(1, 9)])),
}


def walk(t, side):
    """One tree, node by node in its order."""
    texts = t.get("Texts") or t["Cells"]
    rows, cols, top = len(texts), len(texts[0]), side == "TopTreeRoot"
    depth = lambda n: 1 + max(map(depth, n["Cd"])) if n and n["Cd"] else 0
    place, high = {}, depth(t[side])
    flat = {(r, c): [-1] * 3 + [c if top else r] for r in range(rows) for c in range(cols)} if (cols if top else rows) <= DEGREES[-1] else {}
    if not high:
        return flat
    if high > 4:
        return place

    def go(n, path):
        if n["Cd"]:
            if len(n["Cd"]) > DEGREES[4 - high + len(path)]:
                raise OverflowError
            for i, x in enumerate(n["Cd"]):
                own = [*path, i]
                place[x["RI"], x["CI"]] = [-1] * (4 - high) + own + [-1] * (high - len(own))
                go(x, own)
            return
        m = next((m for m in t["MergedRegions"] if m["FirstRow"] <= n["RI"] <= m["LastRow"] and m["FirstColumn"] <= n["CI"] <= m["LastColumn"]), None)
        a, b = ((m["FirstColumn"], m["LastColumn"]) if top else (m["FirstRow"], m["LastRow"])) if m else (n["CI"], n["CI"]) if top else (n["RI"], n["RI"])
        for x in range((n["RI"] if top else n["CI"]) + 1, rows if top else cols):
            for y in range(a, b + 1):
                place[(x, y) if top else (y, x)] = place[n["RI"], n["CI"]]

    try:
        go(t[side], [])
    except OverflowError:
        return flat
    return place


def test_cells_lie_where_a_walk_puts_them(spark):
    lines = [(k, json.dumps(t)) for k, t in TABLES.items()] + [(90, "no json {"), (91, json.dumps(record(40, 2))), (92, json.dumps({"Texts": []})), (93, None)]
    got = H.read_header_trees(spark.createDataFrame(lines, "table_id int, value string"), degrees=DEGREES, most_rows=30).collect()
    assert {x.table_id for x in got} == set(TABLES)
    for k, t in TABLES.items():
        own = {(x.row, x.col): x for x in got if x.table_id == k}
        texts = t.get("Texts") or [[c["V"] for c in row] for row in t["Cells"]]
        assert {p: x.text for p, x in own.items()} == {(r, c): v for r, row in enumerate(texts) for c, v in enumerate(row)}
        for side, name in (("TopTreeRoot", "top"), ("LeftTreeRoot", "left")):
            want = walk(t, side)
            assert {p: x[name] for p, x in own.items()} == {p: want.get(p, [-1] * 4) for p in own}, (k, side)
    looks = {(x.row, x.col): x.look for x in got if x.table_id == 1}
    assert looks[0, 0] == [1, 1, 1, 0, 0, 1, 1, 0, 1, 1, 0] and looks[1, 3][:2] == [1, 2]
    assert all(x.look is None for x in got if x.table_id != 1)


def test_records_are_parsed_once_and_not_shuffled(spark):
    lines = spark.createDataFrame([(k, json.dumps(t)) for k, t in TABLES.items()], "table_id int, value string")
    plan = H.read_header_trees(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("parseJson") == 1
