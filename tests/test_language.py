import pytest

from lakeweave.operators import program as P


def table(spark):
    return spark.createDataFrame(
        [(0, ["a"], [3.0]), (1, ["b"], [3.0]), (2, ["b", "a"], [1.0]), (3, ["c"], [])], "row_idx long, `r.k-string` array<string>, `r.n-number` array<double>"
    )


def rows(spark, text):
    return sorted(x.row_idx for x in P.Program(table(spark)).run(text).data.collect())


def vals(spark, text):
    return sorted(x.value for x in P.Program(table(spark)).run(text).data.collect())


def test_ties_missing_cells_and_several_values(spark):
    assert rows(spark, "( argmax all_rows r.n-number )") == [0, 1]
    assert rows(spark, "( filter_eq all_rows 3 r.n-number )") == [0, 1]
    assert rows(spark, "( filter_not_eq all_rows 3 r.n-number )") == [2, 3]  # a row that lacks the property is kept
    assert rows(spark, "( filter_ge all_rows 1 r.n-number )") == [0, 1, 2]
    assert vals(spark, "( hop all_rows r.k-string )") == ["a", "b", "c"]
    assert vals(spark, "( mode all_rows r.k-string )") == ["a", "b"]
    assert vals(spark, "( sum all_rows r.n-number )") == [7.0]
    assert rows(spark, "( first all_rows )\n( next v0 )\n( next v1 )") == [2]
    assert rows(spark, "( last all_rows )\n( next v0 )") == []
    assert rows(spark, "( first all_rows )\n( same v0 r.n-number )") == [1]


def test_types_are_checked(spark):
    with pytest.raises(TypeError):
        P.Program(table(spark)).run("( argmax all_rows r.k-string )")
    with pytest.raises(NameError):
        P.Program(table(spark)).run("( nothing all_rows )")
    with pytest.raises(SyntaxError):
        P.Program(table(spark)).run("( count all_rows")
    assert P.ancestors("num_list") == {"num_list", "ordered_list", "atom_list", "list"}


def test_unused_variables_and_next_functions(spark):
    p = P.Program(table(spark))
    p.run("( first all_rows )\n( count all_rows )")
    assert p.unused() == {"v0"}
    assert "argmax" not in p.next_functions("entity_list", p.names["v0"].data)
    assert "argmax" in p.next_functions("entity_list", p.table)


def test_a_registered_function(spark):
    @P.function("twice", ["entity_list"], "num")
    def twice(p, rows):
        return P.count(p, rows).selectExpr("2 * value as value")

    assert vals(spark, "( twice all_rows )") == [8.0]
    del P.FUNCTIONS["twice"]


def test_denotations():
    assert P.denotation(["3", "a"], ["A", "3.0"]) and P.denotation(["x  y"], ["X Y"])
    assert not P.denotation(["3"], ["3", "4"]) and not P.denotation(["3"], ["4"])


def test_select_of_two_rows_and_sets_of_values(spark):
    p = P.Program(table(spark))
    p.names["two"] = P.Value("entity_list", p.table.filter("row_idx in (1, 2)"))
    assert [x.row_idx for x in p.run("( select_ge two r.n-number )").data.collect()] == [1]
    assert [x.row_idx for x in p.run("( select_less two r.n-number )").data.collect()] == [2]
    with pytest.raises(ValueError):
        p.run("( select_ge all_rows r.n-number )")
    assert rows(spark, "( first all_rows )\n( same v0 r.k-string )") == []  # a is a value of row 2, but not its only one


def test_dates_without_some_parts(spark):
    days = ["1994-07-01", "1995-02-03", "1996-06-15", "1996-12-31"]
    t = spark.createDataFrame([(i, [d]) for i, d in enumerate(days)], "row_idx long, `r.d-date` array<string>")
    run = lambda text: sorted(x.row_idx for x in P.Program(t).run(text).data.collect())
    assert run("( filter_ge all_rows xx-06-xx r.d-date )") == [0, 2, 3]
    assert run("( filter_less all_rows 1996-xx-xx r.d-date )") == [0, 1]
    assert run("( filter_greater all_rows 1996-06-15 r.d-date )") == [3]


def test_valid_tokens(spark):
    p = P.Program(table(spark))
    p.run("( first all_rows )\n( count all_rows )")
    assert p.valid_tokens([]) == ["("] and "argmax" in p.valid_tokens(["("])
    assert p.valid_tokens(["(", "argmax"]) == ["(", "all_rows", "v0"]
    assert p.valid_tokens(["(", "argmax", "all_rows"]) == ["(", "r.n-number"]
    assert p.valid_tokens(["(", "argmax", "(", "first", "all_rows", ")", "r.n-number"]) == [")"]
    assert p.valid_tokens(["(", "count", "all_rows", ")"]) == []


def test_answers_are_made_comparable(spark):
    from pyspark.sql import functions as F

    from lakeweave.functions import serialise as S

    cases = {
        "Caf\u00e9 [1][2]": "cafe", "f(x)": "f(x)", "Paris (France) [note]": "paris", "\u201cHello  World.\u201d": "hello world", "a\u2013b \u2212c": "a-b -c", "a\u2015b": "a\u2015b",
        "[note]": "[note]", "[12]": "", "(only)": "(only)", "x* \u2020 (a) (b)": "x", '"quoted (aside)"': "quoted", '"a" and "b"': '"a" and "b"', " 3.50. ": "3.50", "\ufb01n\u00a0e": "fin e", "it\u2019s": "it's", "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", S.normal_answer(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases
    assert spark.createDataFrame([(None,)], "x string").select(S.normal_answer(F.col("x"))).first()[0] is None


def test_programs_are_read_token_by_token(spark):
    p = P.Program(table(spark), most=2)
    assert p.valid_tokens() == ["("]
    with pytest.raises(SyntaxError):
        p.read_token("END")
    p = P.Program(table(spark), most=2)
    for token in P.tokenize("( argmax all_rows r.n-number )"):
        assert token in p.valid_tokens()
        last = p.read_token(token)
    assert last.kind == "entity_list" and p.valid_tokens() == ["(", "END"]
    for token in P.tokenize("( count v0 )"):
        assert token in p.valid_tokens()
        p.read_token(token)
    assert p.valid_tokens() == ["END"]
    assert p.read_token("END").data.collect() == [(2.0,)] and p.valid_tokens() == []
    with pytest.raises(SyntaxError):
        p.read_token("(")
