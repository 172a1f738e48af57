import math

from galewright.operators.imputation import fill_category, fill_numbers


def test_numbers_back_off_from_fine_to_coarse(spark):
    rows = [(k, "a", 1, float(k)) for k in range(5)] + [(10, "a", 1, None), (11, "a", 2, float("nan")), (12, "b", 1, -9999.0), (13, "b", 1, 500.0), (14, "b", 1, 8.0)]
    df = spark.createDataFrame(rows, "id int, src string, h int, v double")
    out = {r["id"]: r for r in fill_numbers(df, {"v": (0.0, 100.0)}, [["src", "h"], ["src"], []], min_support=3).collect()}
    assert len(out) == len(rows)
    assert (out[10]["v"], out[10]["v_fill_level"], out[10]["v_filled"], out[10]["v_missing"]) == (2.0, 1, True, True)
    assert (out[11]["v"], out[11]["v_fill_level"]) == (2.0, 2)
    assert out[12]["v_fill_level"] == 3 and out[13]["v_fill_level"] == 3 and out[12]["v"] == out[13]["v"]
    assert (out[14]["v"], out[14]["v_fill_level"], out[14]["v_filled"]) == (8.0, 0, False)


def test_nothing_to_fill_from(spark):
    df = spark.createDataFrame([(1, None, "x", "y")], "id int, v double, v_missing string, v_filled string")
    (row,) = fill_numbers(df, {"v": (0.0, 1.0)}, [[]]).collect()
    assert row["v"] is None and row["v_missing"] is True and row["v_fill_level"] is None
    assert fill_numbers(df.where("false"), {"v": (0.0, 1.0)}, [[]]).collect() == []


def test_names_by_the_mode_of_their_file(spark):
    rows = [(1, "f1", "A"), (2, "f1", "A"), (3, "f1", None), (4, "f1", " "), (5, "f2", "B"), (6, "f2", "n/a"), (7, "f2", "zzz"), (8, "f1", "zzz"), (9, "f3", None), (10, "f2", "B "), (11, None, None)]
    df = spark.createDataFrame(rows, "id int, f string, name string")
    from pyspark.sql import functions as F

    out = {r["id"]: r for r in fill_category(df, "name", [["f"]], F.when(F.col("f") == "f3", "C")).collect()}
    assert {k: r["name"] for k, r in out.items()} == {1: "A", 2: "A", 3: "A", 4: "A", 5: "B", 6: "B", 7: "B", 8: "A", 9: "C", 10: "B", 11: None}
    assert {k for k, r in out.items() if r["name_missing"]} == {3, 4, 6, 7, 8, 9, 11}
    assert out[9]["name_fill_level"] == 2 and out[11]["name_fill_level"] is None and out[1]["name_fill_level"] == 0
    assert not math.isnan(out[3]["name_fill_level"])
