import dataclasses
import datetime
import decimal
import itertools
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridflow.functions import convert, scalars
from gridflow.functions.text import norm_text
from gridflow.operators import binding, changes, joins, lineage, pivot, places, profile, rows, sheets, source, validate
from gridflow.sources import hashes, xlsx
from gridflow.sources.release import ReleaseError, Releases


def test_filter_error_drops_row_with_issue(spark):
    df = spark.createDataFrame([(1, 0), (4, 2), (None, 1)], "a int, b int")
    value, error = scalars.safe_div(F.col("a"), F.col("b"))
    flow = rows.filter_rows(df, (value > 1, error))
    assert [tuple(r) for r in flow.out.collect()] == [(4, 2)]
    assert flow.issues.first()["n"] == 1


def test_derive_uses_earlier_columns_and_sides(spark):
    df = spark.createDataFrame([(1, 0), (4, 2)], "a int, b int")
    flow = rows.derive(df, {"q": scalars.safe_div(F.col("a"), F.col("b")), "r": F.col("q") + 1})
    assert [tuple(r) for r in flow.out.collect()] == [(4, 2, 2.0, 3.0)]
    assert flow.reject.first()["_error_field"] == "q"


def test_union_aligns_and_casts(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("7", 2.5)], "i string, d double")
    assert sorted(map(tuple, rows.union_by_name(a, b).collect())) == [(1, "x", None), (7, None, 2.5)]


def test_params_need_one_row(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="PARAM_NOT_SINGLE_ROW"):
        rows.with_params(df, df.union(df), "p")
    assert rows.with_params(df, df, "p").first()["p_a"] == 1


def test_join_policies_and_checks(spark):
    left = spark.createDataFrame([("1", "a"), (" 2 ", "b"), (None, "c")], "k string, v string")
    right = spark.createDataFrame([(1.0, "x")], "k double, w string")
    side = joins.join(left, right, ["k"], ["k"], how="LEFT")
    assert [r["v"] for r in side.out.collect()] == ["a"]
    assert sorted(r["v"] for r in side.reject.collect()) == ["b", "c"]
    keep = joins.join(left, right, ["k"], ["k"], how="LEFT", unmatched="KEEP_NULLS")
    assert keep.out.count() == 3
    with pytest.raises(joins.JoinError, match="JOIN_KEY_NOT_UNIQUE"):
        joins.join(left, right.union(right), ["k"], ["k"])
    with pytest.raises(joins.JoinError, match="JOIN_EXPLOSION"):
        joins.join(left, right.union(right), ["k"], ["k"], cardinality="MANY_TO_MANY", max_rows=1)
    with pytest.raises(joins.JoinError, match="LOOKUP_KEY_NOT_UNIQUE"):
        joins.lookup(left, right.union(right), ["k"], ["k"], ["w"])


def test_pivot_first_and_unknown(spark):
    df = spark.createDataFrame([(1, "g", "a", 5), (2, "g", "a", 6), (3, "h", "z", 7)], "o int, g string, p string, v int")
    flow = pivot.pivot(df, ["g"], "p", "v", "FIRST", {"a": "a"}, "o")
    assert sorted(map(tuple, flow.out.collect())) == [("g", 5), ("h", None)]
    assert {r["code"] for r in flow.issues.collect()} == {"PIVOT_UNKNOWN_VALUE", "PIVOT_DUPLICATE"}
    with pytest.raises(ValueError):
        pivot.pivot(df, ["g"], "p", "p", "SUM", {"a": "a"}, "o")


def test_validate_severities(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, s string")
    flow = validate.validate(df, [validate.unique("u", ["k"], severity="WARN"), validate.not_null("n", ["s"])])
    assert flow.out.count() == 2 and flow.reject.first()["_broken"] == ["n"]
    assert {(r["rule"], r["n"]) for r in flow.issues.collect()} == {("u", 2), ("n", 1)}


def test_changes_with_null_keys_and_values(spark):
    kind = "k int, v double"
    before = spark.createDataFrame([(1, 1.0), (2, None), (None, 3.0)], kind)
    after = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], kind)
    found = {(r["op"], r["k"]): r["changed"] for r in changes.keyed(before, after, ["k"]).collect()}
    assert found == {("u", 2): ["v"], ("c", 3): None, ("d", None): None}
    assert changes.guards(10, 0, 0, 0, 10) == ["EMPTY", "ROW_CHANGE", "DELETES"]


def test_checksum_keeps_multiplicity(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert changes.checksum(df).first() != changes.checksum(df.union(df)).first()


def test_releases(spark, tmp_path):
    store = Releases(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame([(i, i % 2) for i in range(10)], "k int, p int")
    assert store.publish({"t": one}, {"t": ["k"]})["changes"]["t"]["created"] == 10
    with pytest.raises(ReleaseError, match="GUARDS"):
        store.publish({"t": one.where("k < 2")}, {"t": ["k"]})
    assert store.read("t").count() == 10
    store.publish({"t": one.where("k < 2")}, {"t": ["k"]}, force=True)
    assert store.read("t").count() == 2
    store.roll_back(1)
    assert store.read("t").count() == 10
    with pytest.raises(ReleaseError, match="LIVE_CHANGED"):
        store.roll_back(1, expected=1)
    part = spark.createDataFrame([(100, 1)], "k int, p int")
    store.publish({"t": part}, {"t": ["k"]}, force=True, partitions={"t": ["p"]})
    assert sorted(r["k"] for r in store.read("t").collect()) == [0, 2, 4, 6, 8, 100]
    assert store.changes_between("t", 1, 4, ["k"]).count() == 6


def test_release_guards_of_schema_values_and_drift(spark, tmp_path):
    store = Releases(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k int, s string")
    target = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("s", T.StringType())])
    with pytest.raises(ReleaseError, match="SCHEMA"):
        store.publish({"t": one.withColumn("more", F.lit(1))}, {"t": ["k"]}, force=True, targets={"t": target})
    with pytest.raises(ReleaseError, match="VALUES"):
        store.publish({"t": one}, {"t": ["k"]}, force=True, targets={"t": target}, lengths={"t": {"s": 1}})
    with pytest.raises(ReleaseError, match="VALUES"):  # repeated keys
        store.publish({"t": one.union(one)}, {"t": ["k"]}, force=True)
    assert not list((tmp_path / "r").glob("t/*"))  # nothing of a refused publication stays
    store.publish({"t": one}, {"t": ["k"]}, targets={"t": target}, lengths={"t": {"s": 5}})
    version = store.manifest()["live"]["t"]
    one.limit(1).write.mode("append").parquet(f"{tmp_path}/r/t/{version}")
    assert store.drifted("t")
    with pytest.raises(ReleaseError, match="DRIFT"):
        store.publish({"t": one}, {"t": ["k"]}, drift="REJECT")
    store.publish({"t": one}, {"t": ["k"]})
    assert not store.drifted("t")


def test_baseline_partition_undo_preview_and_retention(spark, tmp_path):
    store = Releases(spark, f"file://{tmp_path}/r")
    base = spark.createDataFrame([(i, i % 3) for i in range(9)], "k int, p int")
    store.take_over("t", base)
    with pytest.raises(ReleaseError, match="TAKEN_OVER"):
        store.take_over("t", base)
    put = lambda k, p: store.publish({"t": spark.createDataFrame([(k, p)], "k int, p int")}, {"t": ["k"]}, force=True, partitions={"t": ["p"]})["manifest"]["id"]
    first, second = put(100, 0), put(200, 1)
    store.undo_partitions("t", first)
    assert sorted(r["k"] for r in store.read("t").collect()) == [0, 2, 3, 5, 6, 8, 200]
    again = put(300, 1)
    with pytest.raises(ReleaseError, match="PARTITION_TOUCHED_LATER"):
        store.undo_partitions("t", second)
    assert store.preview_roll_back(1, {"t": ["k"]})["t"] == {"created": 3, "updated": 0, "deleted": 1, "schema": [], "drifted": False}
    assert store.regress("t", [(base, 1), (base, again)], ["k"])[1]["created"] == 3
    assert store.drop_old(1) == []  # all are too young
    gone = store.drop_old(1, days=-1)
    assert gone and store.read("t").count() == 7 and store.read("t", store.manifest()["history"][0]["live"]["t"]).count() == 9


def test_rolling_back_refuses_and_rewrites(spark, tmp_path):
    store = Releases(spark, f"file://{tmp_path}/r")
    old = spark.createDataFrame([(1, "5", 1.5), (2, "x", 2.5)], "k int, v string, gone double")
    new = spark.createDataFrame([(1, 5, "a")], "k long, v int, more string")
    store.publish({"t": old}, {"t": ["k"]})
    store.publish({"t": new}, {"t": ["k"]}, force=True)
    with pytest.raises(ReleaseError, match="SCHEMA: t: unknown field gone"):
        store.roll_back(1, same_schema=True)
    with pytest.raises(ReleaseError, match="gone no longer there"):
        store.rewrite_back(1)
    with pytest.raises(ReleaseError, match="LIVE_CHANGED"):
        store.rewrite_back(1, expected=1)
    with pytest.raises(ReleaseError, match="NO_RELEASE"):
        store.rewrite_back(9)
    store.publish({"t": new.withColumn("gone", F.lit(0.0))}, {"t": ["k"]}, force=True)
    with pytest.raises(ReleaseError, match="1 values of v"):
        store.rewrite_back(1)
    assert store.manifest()["id"] == 3 and store.read("t").count() == 1
    store.rewrite_back(1, defaults={"t": {"more": "m"}}, lossy=True)
    assert sorted(map(tuple, store.read("t").select("k", "v", "more", "gone").collect())) == [(1, 5, "m", 1.5), (2, None, "m", 2.5)] and dict(store.read("t").dtypes)["k"] == "bigint"
    version = store.manifest()["live"]["t"]
    store.read("t").limit(1).write.mode("append").parquet(f"{tmp_path}/r/t/{version}")
    for back in (lambda: store.rewrite_back(3), lambda: store.roll_back(3, drift="REJECT")):
        with pytest.raises(ReleaseError, match="DRIFT"):
            back()
    assert store.roll_back(3)["id"] == 5 and store.read("t").count() == 1


def test_partitions_touch_only_their_own(spark, tmp_path):
    store = Releases(spark, f"file://{tmp_path}/r")
    base = spark.createDataFrame([(i, i % 5, f"t {i % 2}") for i in range(40)], "k int, p int, q string")
    put = lambda df, **more: store.publish({"t": df}, {"t": ["k"]}, force=True, partitions={"t": ["p", "q"]}, **more)["manifest"]["id"]
    put(base)
    mine = lambda: {f.relative_to(tmp_path / "r" / "t").as_posix(): f.stat().st_mtime_ns for f in (tmp_path / "r" / "t").rglob("*.parquet")}
    before, first = mine(), store._sum(store.read("t"))
    put(spark.createDataFrame([(100, 3, "t 1"), (101, 9, "new")], "k int, p int, q string"))
    fresh = {f.split("/")[1] + "/" + f.split("/")[2] for f in set(mine()) - set(before)}
    assert fresh == {"p=3/q=t 1", "p=9/q=new"} and {f: t for f, t in mine().items() if f in before} == before
    rows = store.read("t")
    assert rows.columns == ["k", "p", "q"] and rows.schema == base.schema and rows.count() == 40 - 4 + 2
    now = store.manifest()
    assert now["history"][-1]["sums"]["t"] == store._sum(rows) and not store.drifted("t")
    plan = rows.where("p = 3 and q = 't 1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and rows.where("p = 3 and q = 't 1'").count() == 1
    assert len(rows.where("p = 3 and q = 't 1'").inputFiles()) >= 1 and rows.where("p = 4").count() == 8
    put(base.where("p = 2").withColumn("k", F.col("k") + 1000))
    files = set(mine())
    store.undo_partitions("t", 2)
    assert set(mine()) == files  # undoing points back and writes no rows
    assert sorted(r["k"] for r in store.read("t").where("p <> 2").collect()) == [i for i in range(40) if i % 5 != 2] and store.read("t").where("p = 2").count() == 8
    assert store.manifest()["history"][-1]["sums"]["t"] == store._sum(store.read("t"))
    store.undo_partitions("t", 3)
    assert store._sum(store.read("t")) == first
    for bad in (None, ""):
        with pytest.raises(ReleaseError, match="PARTITION_NULL"):
            put(spark.createDataFrame([(1, 1, bad)], "k int, p int, q string"))
    with pytest.raises(ReleaseError, match="VALUES"):  # the key is held by a partition that is not touched
        put(spark.createDataFrame([(1, 77, "x")], "k int, p int, q string"))
    with pytest.raises(ReleaseError, match="PARTITION_FIELDS"):
        store.publish({"t": base}, {"t": ["k"]}, force=True, partitions={"t": ["p"]})
    assert set(mine()) == files
    store.publish({"t": base.where("k < 3")}, {"t": ["k"]}, force=True)
    put(spark.createDataFrame([(9, 2, "t 0")], "k int, p int, q string"))  # a whole version is split once
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(0, 0, "t 0"), (1, 1, "t 1"), (9, 2, "t 0")]
    gone = store.drop_old(1, days=-1)
    assert gone and store.read("t").count() == 3


def test_hashes_are_compared_without_exchange(spark, tmp_path):
    one = spark.createDataFrame([(i, None if i == 5 else f"a{i % 4}", i * 1.5) for i in range(60)], "k int, s string, v double")
    two = one.where("k <> 7").withColumn("v", F.when(F.col("k") % 10 == 0, -1.0).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(99, "n", 0.0)], "k int, s string, v double"))
    a, b = (hashes.write(df, ["k", "s"], f"file://{tmp_path}/{n}") for n, df in (("a", one), ("b", two)))
    found = hashes.changed(a, b)
    joined = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in joined and "Bucketed: true" in joined
    assert {(r["op"], r["_k0"]) for r in found.collect()} == {(r["op"], str(r["k"])) for r in changes.keyed(one, two, ["k", "s"]).collect()}
    again = hashes.read(spark, f"file://{tmp_path}/a")
    spark.sql(f"DROP TABLE {hashes._name(f'file://{tmp_path}/a')}")  # as another session finds it
    assert hashes.changed(hashes.read(spark, f"file://{tmp_path}/a"), b).count() == found.count() and again.about == a.about
    assert hashes.repeated(a) == 0 and hashes.repeated(hashes.write(one.union(one.where("k = 5")), ["k", "s"], f"file://{tmp_path}/c")) == 1
    assert hashes.read(spark, f"file://{tmp_path}/none") is None
    store = Releases(spark, f"file://{tmp_path}/r")
    store.publish({"t": one}, {"t": ["k"]})
    assert store.publish({"t": two}, {"t": ["k"]})["changes"]["t"] == {"created": 1, "updated": 6, "deleted": 1}
    get = lambda: sorted((r["op"], r["k"], r["changed"], r["before"], r["after"]) for r in store.changes_between("t", 1, 2, ["k"]).collect())
    few = get()
    held, hashes.FEW = hashes.FEW, 0
    try:
        assert get() == few and len(few) == 8  # row by row: the same
    finally:
        hashes.FEW = held


def test_profile_of_fields_and_bindings(spark):
    grid = [["职业 Job", "Yes", "Born on", "x", "x"], *[[f"j{i}", ["true", "false"][i % 2], f"2024-01-0{i + 1}", 2**33 + i, 7] for i in range(6)]]
    found = {r["col"]: r for r in profile.fields(grid_cells(spark, grid), source.Region("r", sheets.Rect(1, 1, 7, 6))).collect()}
    assert [(found[c]["source"], found[c]["field"], found[c]["type"], found[c]["is_key"], found[c]["values"]) for c in sorted(found)] == [
        ("职业 Job", "col1", "string", True, None), ("Yes", "col2", "bool", False, ["false", "true"]), ("Born on", "bornOn", "date", True, None), ("x", "col4", "long", True, None), ("x_2", "col5", "int", False, ["7"]), ("_col_F", "colF", "string", False, None),
    ]
    heads = spark.createDataFrame([("s", 1, "Credit Support 2"), ("s", 2, "credit support 2"), ("s", 3, "9 Lives left")], "sheet string, col int, name string")
    assert [r["field"] for r in profile.field_names(heads).orderBy("col").collect()] == ["creditSupport2", "creditSupport2_2", "livesLeft9"]
    assert profile.matrix_names("Job \\ Level") == ("Job", "Level") and profile.matrix_names("Currency") == ("item", "Currency") and profile.matrix_names(None) == ("item", "col")
    own, want = T._parse_datatype_string("a int, b string, d date"), T.StructType([T.StructField("A", T.DoubleType(), False), T.StructField("B", T.IntegerType()), T.StructField("D", T.TimestampType(), False)])
    assert profile.binding_problems(own, want, {"a": "A", "b": "B", "q": "Z"}, [["D"], ["A"]]) == (["no column Z", "no field q", "b (string) does not fit B (int)", "column D needs a field"], ["a"])
    assert profile.binding_problems(own, want, {"a": "A", "d": "D"}, [["A"]], ["a"], ["b"]) == (["partition field b is not mapped"], None)


def test_offending_values_are_bounded_by_field(spark):
    df = spark.range(50).select("id", F.lit("é").alias("a"), F.lit(300).alias("b"), F.map_from_arrays(F.array(F.lit("a")), F.array(F.array(F.lit("s!A1")))).alias("_cells"))
    target = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.ByteType()), T.StructField("c", T.StringType(), False)])
    got = changes.offending(df, target, ["id"], charsets={"a": "ascii"}, most=3).collect()
    assert sorted((r["field"], r["problem"], r["key"], r["cells"]) for r in got) == sorted((f, p, k, c) for f, p, c in (("a", "not in ascii", ["s!A1"]), ("b", "out of range", None)) for k in ("0", "1", "10"))
    assert changes.offending(df, target, ["id"], charsets={"a": "latin1"}).where("field = 'a'").count() == 0 and changes.offending(df, T.StructType([])).count() == 0


def test_lineage_through_derive_join_and_union(spark):
    cells = grid_cells(spark, [["id", "a", "b"], [1, 10, 20], [2, 5, None]], [["id", "n"], [1, "x"], [3, "y"]])
    one, two = (source.region_rows(cells.where(f"sheet = '{n}'"), source.Region("r", sheets.Rect(1, 1, 3, w), specs=tuple(binding.Spec(f, type=t) for f, t in fields)), lineage=True).out.drop("sheet", "row")
                for n, w, fields in (("s0", 3, (("id", "int"), ("a", "int"), ("b", "int"))), ("s1", 2, (("id", "int"), ("n", "string")))))
    assert lineage.used(one, F.col("a") + F.coalesce("b", F.lit(0))) == ["a", "b"]
    made = lineage.derive(one, {"s": F.col("a") + F.coalesce("b", F.lit(0)), "t": F.col("s") * F.col("a"), "c": F.lit(1)}).out
    by = {r["id"]: r["_cells"] for r in made.collect()}
    assert by[1]["s"] == ["s0!B2", "s0!C2"] and by[1]["t"] == ["s0!B2", "s0!C2"] and by[1]["c"] == [] and by[2]["s"] == ["s0!B3"] and "b" not in by[2]
    flow = lineage.join(made, two, ["id"], ["id"], "LEFT", "KEEP_NULLS", merge=False, prefix="r")
    got = {r["id"]: r for r in flow.out.collect()}
    assert got[1]["_rid"] == "s0!2+s1!2" and got[1]["_cells"]["n"] == ["s1!B2"] and got[1]["_cells"]["r_id"] == ["s1!A2"] and got[1]["_cells"]["id"] == ["s0!A2"]
    assert got[2]["_rid"] == "s0!3" and "n" not in got[2]["_cells"] and flow.issues.first()["n"] == 1
    both = rows.union_by_name(one, two)
    assert {r["_rid"] for r in both.collect()} == {"s0!2", "s0!3", "s1!2", "s1!3"}
    page = changes.page(made, ["id"], 1, 1).collect()
    assert [(r["_rid"], r["_cells"]["a"]) for r in page] == [("s0!3", ["s0!B3"])]


def test_null_and_hot_keys_are_spread(spark):
    n = 20_000
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise((F.col("id") % 997).cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", "h")] + [(str(i), f"v{i}") for i in range(0, 997, 2)], "k string, v string")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        get = lambda **more: joins.join(left, right, ["k"], ["k"], "LEFT", "KEEP_NULLS", checked=False, **more).out
        plain, even = get(), get(hot_rows=500)
        share = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert share(plain) > n / 3 and share(even) < n / 5
        rows = lambda df: sorted(map(str, df.collect()))
        want = rows(left.join(right, "k", "left"))
        assert rows(plain) == rows(even) == want
        for how in ("INNER", "LEFT"):
            a, b = (joins.join(left, right, ["k"], ["k"], how, checked=False, hot_rows=h) for h in (None, 500))
            assert rows(a.out) == rows(b.out) == rows(left.join(right, "k")) and (how == "INNER" or a.reject.count() == b.reject.count() == left.join(right, "k", "left_anti").count())
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    twice = spark.createDataFrame([("a", 1)] * 5 + [("b", 2)] * 2, "k string, x int")
    with pytest.raises(joins.JoinError, match=r"29 rows, at most 10; most from a \(25\), b \(4\)"):
        joins.join(twice, twice.withColumnRenamed("x", "y"), ["k"], ["k"], cardinality="MANY_TO_MANY", max_rows=10)


def test_source_over_workbooks(spark, tmp_path):
    grid = [["Heroes", None, None, None], ["Id", "Power", "Power", "Born"], [1, 10, "x", 45000], [2, "#N/A", "y", 45001.5], ["# note", None, None, None], [3, None, "z", None], ["Total", 10, None, None], [None] * 4, ["other", None, None, None]]
    workbook(tmp_path / "a.xlsx", grid, hidden=(6,))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "b.txt").write_bytes(b"x")
    found = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in xlsx.upload_report(spark, f"file://{tmp_path}/*").collect()}
    assert found == {"a.xlsx": None, "broken.xlsx": "FILE_BROKEN", "b.txt": "FILE_TYPE"}
    cells = xlsx.read_cells(spark, f"file://{tmp_path}/*.xlsx").cache()
    assert xlsx.over_cap(cells, 5).count() == 1 and xlsx.over_cap(cells, 500).count() == 0
    region = source.Region(
        "h", sheets.Rect(2, 1, 7, 4), locator="ANCHOR", anchor="Heroes", offset=(1, 0), rows="UNTIL_BLANK_ROWS", cols="UNTIL_BLANK_HEADER", comment="#", subtotals=("Total",),
        specs=(binding.Spec("id", "Id", "long", required=True), binding.Spec("power", "Power", "int", default=5), binding.Spec("mark", "Power_2"), binding.Spec("born", "Born", "datetime"), binding.Spec("lack", type="int", required=True, default=9)),
    )
    flow = source.region_rows(cells, region)
    born = datetime.datetime(2023, 3, 15)
    assert sorted(map(tuple, flow.out.drop("sheet").collect())) == [(3, 1, 10, "x", born, 9), (6, 3, 5, "z", None, 9)]
    assert [tuple(r) for r in flow.reject.drop("sheet").collect()] == [(4, "power", "CELL_ERROR_VALUE", "#N/A")]
    codes = {(r["severity"], r["code"], r["field"]): r["n"] for r in flow.issues.collect()}
    assert codes == {("ERROR", "CELL_ERROR_VALUE", "power"): 1, ("ERROR", "HEADER_MISSING_REQUIRED", "lack"): 1, ("WARN", "HEADER_DUPLICATE", "Power_2"): 1, ("WARN", "HIDDEN_ROWS", None): 1}
    lost = source.locate(cells, source.Region("n", sheets.Rect(1, 1, 2, 2), locator="ANCHOR", anchor="nowhere"))
    assert lost.out.count() == 0 and [r["code"] for r in lost.issues.collect()] == ["ANCHOR_NOT_FOUND"]
    ended = source.locate(cells, source.Region("n", sheets.Rect(1, 1, 2, 2), rows="UNTIL_ANCHOR", end="nowhere"))
    assert ended.out.count() == 0 and [r["code"] for r in ended.issues.collect()] == ["END_ANCHOR_NOT_FOUND"]
    blocks = source.detect(cells)
    assert sorted((r["top"], r["bottom"], r["left"], r["right"], r["title"]) for r in blocks.collect()) == [(2, 7, 1, 4, "Heroes"), (9, 9, 1, 1, None)]
    assert {(r["top"], r["locator"], r["shape"]) for r in source.suggested(cells, blocks).collect()} == {(2, "ANCHOR", "DETAIL"), (9, "ANCHOR", "DETAIL")}
    assert source.picked_sheets(cells, "INDEX", 0).count() == cells.count() and source.picked_sheets(cells, "EXACT", "S2").count() == 0
    two = source.source(cells, [region, source.Region("mask", sheets.Rect(3, 2, 4, 2), shape="IGNORE")])["h"]
    assert sorted((r["id"], r["power"]) for r in two.out.collect()) == [(1, 5), (2, 5), (3, 5)]


def grid_cells(spark, *grids):
    rows = [(f"s{k}", i + 1, j + 1, str(v), "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "s", 0) for k, g in enumerate(grids) for i, line in enumerate(g) for j, v in enumerate(line) if v is not None]
    return spark.createDataFrame(rows, "sheet string, row int, col int, value string, kind string, flags int")


def scans(df):
    """(file scans, reused exchanges) of the plan that ran."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return final.count("FileScan"), final.count("ReusedExchange")


def test_source_reads_cells_once(spark, tmp_path):
    grid_cells(spark, [["Top", None], ["a", "b"], [1, 2], [3, 4]]).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    region = source.Region("r", sheets.Rect(2, 1, 3, 2), locator="ANCHOR", anchor="Top", offset=(1, 0), rows="UNTIL_BLANK_ROWS", cols="UNTIL_BLANK_HEADER", specs=(binding.Spec("a", type="int"), binding.Spec("b", type="int")))
    out = source.source(cells, [region, source.Region("f", sheets.Rect(9, 1, 9, 1), shape="FORM", fields={"x": (1, 1)}, specs=(binding.Spec("x"),))])
    found = scans(out["r"].out)
    assert found[0] == 1 and found[1] >= 3
    assert sorted(tuple(r)[2:] for r in out["r"].out.collect()) == [(1, 2), (3, 4)] and [r["x"] for r in out["f"].out.collect()] == [None]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_shapes_of_the_source_node(spark):
    kv = source.Region("kv", sheets.Rect(1, 1, 2, 3), shape="KEY_VALUE", orientation="HORIZONTAL", specs=(binding.Spec("a"), binding.Spec("b", type="int"), binding.Spec("c", required=True, default="d")))
    flow = source.region_rows(grid_cells(spark, [["a", "b", "a"], ["x", 7, "y"]]), kv)
    assert [tuple(r) for r in flow.out.collect()] == [("s0", 1, "x", 7, "d")]
    assert {(r["code"], r["field"], r["n"]) for r in flow.issues.collect()} == {("KV_DUPLICATE_KEY", "a", 1), ("HEADER_MISSING_REQUIRED", "c", 1)}
    last = source.region_rows(grid_cells(spark, [["a", "b", "a"], ["x", 7, "y"]]), dataclasses.replace(kv, duplicates="LAST"))
    assert [r["a"] for r in last.out.collect()] == ["y"]
    twice = grid_cells(spark, [[None, "p", "q"], ["k", 1, 2], ["k", 3, None]])
    m = source.Region("m", sheets.Rect(1, 1, 3, 3), shape="MATRIX", row_dims=("key",), col_dims=("what",), metric="what", specs=(binding.Spec("key"), binding.Spec("p", type="int"), binding.Spec("q", type="int"), binding.Spec("r")))
    flow = source.region_rows(twice, m)
    assert [tuple(r) for r in flow.out.collect()] == [("s0", 2, "k", 1, 2, None)]
    assert {(r["code"], r["field"], r["n"]) for r in flow.issues.collect()} == {("MATRIX_DUPLICATE_CELL", "p", 1), ("HEADER_MISSING", "r", 1)}
    form = source.Region("f", sheets.Rect(1, 1, 3, 3), cols="UNTIL_BLANK_HEADER", shape="FORM", fields={"a": (1, 3)}, specs=(binding.Spec("a"),))
    flow = source.region_rows(grid_cells(spark, [["u", "v", "w"]], [["u", None, "w"]]), form)
    assert [(r["sheet"], r["a"]) for r in flow.out.collect()] == [("s0", "w")] and [(r["code"], r["field"], r["n"]) for r in flow.issues.collect()] == [("FORM_FIELD_OUT_OF_RANGE", "a", 1)]
    bold = grid_cells(spark, [["n", "v"], ["G", None], ["x", 1], [None, 2], ["H", None], ["y", 3]]).withColumn("flags", F.when(F.col("value") == "G", 2).otherwise(0))
    g = source.Region("g", sheets.Rect(1, 1, 6, 2), shape="GROUPED_DETAIL", group_by="BOLD", specs=(binding.Spec("n"), binding.Spec("v", type="int"), binding.Spec("group")))
    assert sorted((r["row"], r["n"], r["v"], r["group"]) for r in source.region_rows(bold, g).out.collect()) == [(3, "x", 1, "G"), (4, None, 2, "G"), (5, "H", None, "G"), (6, "y", 3, "G")]


def test_blocks_of_the_source_node(spark):
    one = [["B", 1, "B", 2], ["x", 3, "x", 4], [None] * 4, [None, "B", 5, None], [None, "x", 6, None]]
    region = source.Region("b", sheets.Rect(1, 1, 4, 4), shape="REPEATING_BLOCK", block=(2, 2), block_anchor="B", fields={"k": (1, 2), "x": (2, 2)}, specs=(binding.Spec("k", type="int"), binding.Spec("x", type="int")))
    get = lambda r, *g: sorted(tuple(x) for x in source.region_rows(grid_cells(spark, *g), r).out.collect())
    assert get(region, one) == [("s0", 1, 1, 1, 3), ("s0", 1, 2, 2, 4), ("s0", 4, 3, 5, 6)]  # the last block reaches beyond the region
    assert get(dataclasses.replace(region, inner="KEY_VALUE", specs=(binding.Spec("k", "B", "int"), binding.Spec("x", type="int"))), one) == get(region, one)
    assert get(dataclasses.replace(region, block_anchor="", stride=(0, 2)), one) == [("s0", 1, 1, 1, 3), ("s0", 1, 2, 2, 4)]
    assert get(dataclasses.replace(region, block_anchor="", stride=(3, 1)), one) == [("s0", 1, 1, 1, 3), ("s0", 4, 2, 5, 6)]
    blank = dataclasses.replace(region, block_anchor="", stride=(1, 0), block=(1, 2), fields={"k": (1, 2)}, specs=(binding.Spec("k", type="int"),))
    assert get(blank, [r[:2] for r in one[:3]] + [[None, 9]]) == [("s0", 1, 1, 1), ("s0", 2, 2, 3), ("s0", 4, 3, 9)]
    assert get(dataclasses.replace(blank, skip_empty=False), [r[:2] for r in one[:3]] + [[None, 9]]) == [("s0", 1, 1, 1), ("s0", 2, 2, 3), ("s0", 3, 3, None), ("s0", 4, 4, 9)]
    with pytest.raises(ValueError, match="OUT_OF_RANGE"):
        source.region_rows(grid_cells(spark, one), dataclasses.replace(region, fields={"k": (3, 1)}))


@given(st.sets(st.tuples(st.integers(1, 12), st.integers(1, 12)), min_size=1, max_size=8), st.integers(1, 4), st.integers(1, 4))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_overlapping_blocks_against_all_pairs(spark, starts, high, wide):
    want = any(abs(a - c) < high and abs(b - d) < wide for (a, b), (c, d) in itertools.combinations(starts, 2))
    frame = spark.createDataFrame([("s", a, b) for a, b in starts], "sheet string, top int, left int")
    assert (sheets.overlapping(frame, high, wide).count() > 0) == want


def test_regions_that_meet_have_no_rows(spark):
    a, b = (source.Region(n, sheets.Rect(1, c, 3, c + 1), specs=(binding.Spec("x"),)) for n, c in (("a", 1), ("b", 2)))
    cells = grid_cells(spark, [["x", "y", "z"], [1, 2, 3]])
    flow = source.source(cells, [a, b])
    assert flow["a"].out.count() == flow["b"].out.count() == 0
    assert [(r["code"], r["message"]) for r in flow["a"].issues.where("code = 'REGION_OVERLAP'").collect()] == [("REGION_OVERLAP", "b")]
    assert source.source(cells, [dataclasses.replace(a, exclude=("b",)), b])["a"].out.count() == 1


@given(st.lists(st.booleans(), min_size=1, max_size=40), st.integers(1, 3), st.integers(1, 4))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_ends_by_gaps_across_buckets(spark, filled, blanks, top):
    held, places.BUCKET = places.BUCKET, 4
    try:
        want, gap = top, 0
        for i in range(top, len(filled) + 1):
            gap = 0 if filled[i - 1] else gap + 1
            if gap >= blanks:
                break
            want = i if filled[i - 1] else want
        cells = grid_cells(spark, [["h" if f else None] for f in filled] + [[None]] * 9 + [["end"]])
        region = source.Region("r", sheets.Rect(top, 1, top, 1), rows="UNTIL_BLANK_ROWS", blanks=blanks)
        assert source.locate(cells, region).out.first()["bottom"] == want
    finally:
        places.BUCKET = held


def test_headers_of_several_levels(spark):
    cells = spark.createDataFrame([("s", 1, 1, "A"), ("s", 1, 3, "B"), ("s", 2, 1, "x"), ("s", 2, 2, "y"), ("s", 2, 3, "B"), ("s", 3, 1, "1")], "sheet string, row int, col int, value string")
    region = source.Region("r", sheets.Rect(1, 1, 3, 4), header_rows=2, specs=(binding.Spec("a", "A_x"),))
    place = source.locate(cells, region).out
    own = source.cut(cells, place)
    assert [r["name"] for r in source.header_names(own, place, region).orderBy("col").collect()] == ["A_x", "A_y", "B", "B_2"]
    assert [spark.range(1).select(sheets.letters(F.lit(n))).first()[0] for n in (1, 26, 27, 52, 53, 702, 703, 16384)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD"]
    assert binding.spec_problems([binding.Spec("1x"), binding.Spec("meta"), binding.Spec("a", type="what"), binding.Spec("a")]) == ["1x: not a name", "meta: reserved", "a: unknown type what", "a: repeated"]


def test_types_of_cells(spark):
    one = spark.range(1)
    def made(text, kind="s", flags=0, **spec):
        value, error = binding.coerce(binding.lone(F.lit(text), kind, flags), binding.Spec("x", **spec))
        return tuple(one.select(value, error).first())

    assert made("12.0", "n") == ("12", None) and made("1234567890123456", "n") == (None, "ID_PRECISION_LOST") and made("1", "b") == ("true", None)
    assert made("45000.5", "d") == ("2023-03-15 12:00:00", None) and made("45000", "d") == ("2023-03-15", None)
    assert made("1,234", type="int") == (1234, None) and made("3000000000", type="int") == (None, "TYPE_COERCE_FAILED") and made("3000000000", type="long") == (3_000_000_000, None)
    assert made("1", "b", type="float") == (None, "TYPE_COERCE_FAILED") and made("2.345", type="decimal", options={"precision": 5, "scale": 2})[0] == decimal.Decimal("2.35")
    assert made("t", type="bool") == (None, "TYPE_COERCE_FAILED") and made("是", type="bool") == (True, None)
    assert made("b", type="enum", options={"values": {"a": 1}}) == (None, "ENUM_UNKNOWN") and made("1|2", type="list", options={"item": "int"}) == ([1, 2], None)
    assert made(" - ", required=True) == (None, "REQUIRED_EMPTY") and made("", default="d") == ("d", None) and made(None) == (None, None)
    assert made("2026年1月2日", type="date")[0] == datetime.date(2026, 1, 2) and made("1", "n", binding.NO_CACHE) [1] == "CELL_FORMULA_NO_CACHE"


def test_conversions(spark):
    df = spark.createDataFrame([("1,000",), ("x",), (None,), ("1.5",)], "t string")
    v, e = convert.to_int(F.col("t"))
    assert [tuple(r) for r in df.select(v, e).collect()] == [(1000, None), (None, "INT_INVALID"), (None, None), (None, "INT_INVALID")]
    d, _ = convert.to_date(F.lit("46254"))
    assert df.select(d).first()[0] == datetime.date(2026, 8, 20)
    assert df.select(norm_text(F.lit("​ a \n b "))).first()[0] == "a b"


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(scalars.diff_days(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"))).first()[0] == -1
    assert one.select(scalars.substr(F.lit("abcdef"), -2)).first()[0] == "ef"
    assert one.select(scalars.regex_match(F.lit("a\n"), "a")).first()[0] is False
    with pytest.raises(ValueError):
        scalars.format_text("{:>3}", F.lit(1))


def workbook(path, grid, merges=(), hidden=()):
    def cell(r, c, v):
        ref = xlsx.address("", r, c)[1:]
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    lines = "".join(f'<row r="{r}"{" hidden=" + chr(34) + "1" + chr(34) if r in hidden else ""}>' + "".join(cell(r, c, v) for c, v in enumerate(line, 1) if v is not None) + "</row>" for r, line in enumerate(grid, 1))
    merged = f"<mergeCells>{''.join(f'<mergeCell ref={chr(34)}{m}{chr(34)}/>' for m in merges)}</mergeCells>" if merges else ""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{lines}</sheetData>{merged}</worksheet>")


def large_workbook(path, names=("S1",), broken=(), prefix=""):
    """Sheets of 60 rows with shared strings, rows without numbers, a merge over many rows and a hidden column."""
    main = f'xmlns{":" + prefix if prefix else ""}="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = prefix + ":" if prefix else ""
    rows = "".join(f'<{p}row{f" r={chr(34)}{i}{chr(34)}" if i % 7 == 1 else ""}><{p}c t="s"><{p}v>{i % 9}</{p}v></{p}c><{p}c><{p}v>{i}</{p}v></{p}c><{p}c t="s"><{p}f>A1</{p}f><{p}v>10</{p}v></{p}c></{p}row>' for i in range(1, 61))
    sheet = f'<{p}worksheet {main}><{p}cols><{p}col min="2" max="2" hidden="1"/></{p}cols><{p}sheetData>{rows}</{p}sheetData>' + ("" if prefix else '<mergeCells><mergeCell ref="A5:B40"/></mergeCells>') + f"</{p}worksheet>"
    own = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {own} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {own}>" + "".join(f"<si><t>t{i}</t></si>" for i in range(12)) + "</sst>")
        for i, n in enumerate(names):
            z.writestr(f"xl/worksheets/s{i}.xml", "no xml <" if n in broken else sheet)


def test_workbook_in_parts(spark, tmp_path):
    large_workbook(tmp_path / "a.xlsx", ("one", "two"))
    whole = sorted(map(tuple, xlsx.read_cells(spark, f"file://{tmp_path}/a.xlsx").collect()), key=repr)
    content = (tmp_path / "a.xlsx").read_bytes()
    for size in (1, 300, 2000):
        parts = list(xlsx.parts_of("a.xlsx", content, size=size))
        assert len(parts) > 2 if size < 2000 else len(parts) >= 2
        assert sorted(map(tuple, xlsx.read_cells(spark, f"file://{tmp_path}/a.xlsx", part_bytes=size).collect()), key=repr) == whole
    by = {(c[1], c[3], c[4]): (c[5], c[7]) for c in whole}
    assert by["one", 1, 1] == ("t1", 0) and by["two", 60, 2] == ("60", xlsx.HIDDEN_COL) and by["one", 9, 3] == ("t10", 0) and by["one", 40, 2][0] == by["one", 5, 1][0] == "t5"
    large_workbook(tmp_path / "p.xlsx", prefix="x")
    assert {(c[3], c[4]): (c[5], c[7]) for c in map(tuple, xlsx.read_cells(spark, f"file://{tmp_path}/p.xlsx", part_bytes=300).collect())}[60, 2] == ("60", xlsx.HIDDEN_COL)
    large_workbook(tmp_path / "b.xlsx", [f"n{i}" for i in range(8)], broken=[f"n{i}" for i in range(8) if i != 5])
    got = xlsx.read_cells(spark, f"file://{tmp_path}/b.xlsx", sheets="n5")  # the others could not be read
    assert {r["sheet"] for r in got.collect()} == {"n5"} and got.count() == len(whole) // 2
    assert xlsx.read_cells(spark, f"file://{tmp_path}/b.xlsx", sheets="m.*").count() == 0


def test_workbook_and_shapes(spark, tmp_path):
    grid = [["title", None, None], ["job", "Lv1", "Lv2"], ["war", 100, 120], ["mage", 60, None], [None, None, None], ["Hero: H1", None, None], ["hp", 5, None], ["Hero: H2", None, None], ["hp", 6, None], ["#N/A", None, None]]
    workbook(tmp_path / "a.xlsx", grid, merges=("A1:B1",), hidden=(4,))
    cells = xlsx.read_cells(spark, f"file://{tmp_path}/*.xlsx").cache()
    found = {(r["row"], r["col"]): r for r in cells.collect()}
    assert found[1, 2]["value"] == "title" and found[1, 2]["flags"] == xlsx.MERGED
    assert found[4, 1]["flags"] == xlsx.HIDDEN_ROW and found[10, 1]["flags"] == xlsx.ERROR
    assert xlsx.sheet_report(cells).first()["max_row"] == 10
    hit = sheets.anchors(cells, "job", sheets.Rect(2, 1, 2, 1)).first()
    assert (hit["row"], hit["col"], hit["hits"]) == (2, 1, 1)
    region = sheets.cut(cells, sheets.Rect(2, 1, 4, 3))
    long = sheets.matrix(region, {2: "level"}, {1: "job"})
    assert sorted((r["job"], r["level"], r["value"]) for r in long.collect()) == [("mage", "Lv1", "60"), ("war", "Lv1", "100"), ("war", "Lv2", "120")]
    blocks = sheets.repeating(cells, r"Hero: H\d", 2, 2, {"name": (1, 1), "hp": (2, 2)})
    assert sorted((r["block"], r["name"], r["hp"]) for r in blocks.collect()) == [(1, "Hero: H1", "5"), (2, "Hero: H2", "6")]
    assert sheets.end_rows(cells, 1).first()["bottom"] == 4
    assert sheets.headers(region, [2]) == {1: "job", 2: "Lv1", 3: "Lv2"}
    assert sheets.detect_rows(cells).count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, s string, row int, sheet string")
    assert validate.validate(none, [validate.unique("u", ["k"])]).out.count() == 0
    assert changes.summary(changes.keyed(none, none, ["k"])).first()["created"] == 0
    assert joins.join(none, none, ["k"], ["k"]).out.count() == 0


def test_stream_publishes(spark, tmp_path):
    from gridflow.streaming.publish import publishing

    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, t int").write.parquet(src)
    store = Releases(spark, f"file://{tmp_path}/r")
    stream = spark.readStream.schema("k int, t int").parquet(src)
    publishing(stream, store, "t", ["k"], "t").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, store.read("t").collect())) == [(1, 2), (2, 1)]


def test_stream_touches_only_its_partitions(spark, tmp_path):
    from gridflow.streaming.publish import beside, publishing

    src, schema = f"{tmp_path}/in", "k int, day string, t int, gone boolean"
    store = Releases(spark, f"file://{tmp_path}/r")

    def come(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        own = publishing(stream, store, "t", ["k", "day"], "t", changes.Limits(change_ratio=9.0), ["day"])
        own.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        return store._layout("t", store.manifest()["live"]["t"])

    first = come((1, "mon", 5, False), (2, "tue", 1, False), (2, "tue", 3, False), (None, "wed", 1, False), (None, "wed", 2, False))
    assert sorted(first.own) == ["day=mon", "day=tue", "day=wed"]
    assert sorted(map(tuple, store.read("t").collect()), key=str) == [(1, "mon", 5, False), (2, "tue", 3, False), (None, "wed", 2, False)]
    # a late row, a deletion, a new key: only monday's folder changes
    second = come((1, "mon", 4, True), (3, "mon", 1, True), (3, "mon", 0, False))
    assert second.own == ("day=mon",) and {p: v for p, v in second.folders.items() if p != "day=mon"} == {p: v for p, v in first.folders.items() if p != "day=mon"}
    assert sorted(map(tuple, store.read("t").where("day = 'mon'").collect())) == [(1, "mon", 5, False), (3, "mon", 1, True)]
    # the same batch again, and an empty one, change nothing
    before = sorted(map(tuple, store.read("t").collect()), key=str)
    come((3, "mon", 1, True))
    come()
    assert sorted(map(tuple, store.read("t").collect()), key=str) == before
    rows = spark.createDataFrame([(1, "mon")], "k int, day string")
    plan = beside(store.read("t"), rows, ["day"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "mon" in plan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(ReleaseError, match="LIVE_CHANGED"):
        store.publish({"t": store.read("t")}, {"t": ["k", "day"]}, expected=1)
    with pytest.raises(ValueError):
        publishing(rows, store, "t", ["k"], "t", by=["day"])
