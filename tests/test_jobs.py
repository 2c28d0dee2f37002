from crystalspark.operators import jobs

SCHEMA = "structure_id string, atom_idx int, element string, fx double, fy double, fz double, a double, b double, c double, alpha double, beta double, gamma double"
CELL = (5.0, 6.0, 7.0, 80.0, 95.0, 103.0)
GOOD = [("C", 0.1, 0.2, 0.3), ("C", 0.9, 0.8, 0.7), ("H", 0.4, 0.15, 0.77), ("H", 0.6, 0.85, 0.23)]


def rows_of(name, atoms, cell=CELL):
    return [(name, i, *a, *cell) for i, a in enumerate(atoms)]


def test_one_bad_structure_is_a_row_and_the_rest_goes_on(spark):
    rows = rows_of("good", GOOD) + rows_of("unknown", [("Qq", 0.0, 0.0, 0.0)]) + rows_of("null", [(None, 0.0, 0.0, 0.0)])
    rows += rows_of("flat", GOOD, (5.0, 6.0, 0.0, 90.0, 90.0, 90.0)) + rows_of("missing", [("C", None, 0.0, 0.0)]) + rows_of("bare", [("C", 0.1, 0.1, 0.1)])
    rows += rows_of("twice", [*GOOD, GOOD[0]]) + rows_of("nowhere", GOOD, (None,) * 6)
    found = {r.structure_id: r for r in jobs.check_cells(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    good = found.pop("good")
    assert (good.formula, good.n_operations, good.n_unique, good.symbol, good.failed_step, good.error) == ("C2 H2", 2, 2, "P -1", None, None)
    assert {k: r.failed_step for k, r in found.items()} == {"unknown": "elements", "null": "elements", "flat": "cell", "missing": "cell", "bare": "composition", "twice": "symmetry", "nowhere": "cell"}
    assert found["unknown"].error == "nothing is known of element Qq" and found["bare"].volume > 0  # what came before stays
    summary = jobs.failures(jobs.check_cells(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.failed_step, r.n) for r in summary][0] == ("cell", 2) and sum(r.n for r in summary) == 7


def test_steps_run_in_turn_and_stop(spark):
    def count(state):
        return {"n": len(state["rows"])}

    def halve(state):
        return {"half": 10 // (state["n"] - 2)}

    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "structure_id string, place int")
    found = sorted(jobs.run(df, ["place"], [("count", count), ("halve", halve), ("nothing", lambda s: None)], "n int, half int").collect())
    assert [tuple(r) for r in found] == [("a", 2, None, "halve", "integer division or modulo by zero"), ("b", 1, -10, None, None)]
    assert jobs.run(df.limit(0), ["place"], [("count", count)], "n int").count() == 0
