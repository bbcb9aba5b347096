"""What reviewers found: queries on inputs that the small tables do not have."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gridflow.functions import text as text_functions
from gridflow.operators import profile, sheets, source
from gridflow.operators.binding import Spec
from gridflow.plans.queries import QUERIES, SQL


def same(spark, tmp_path, name, **tables):
    """Whether a query gives what its SQL does over these tables."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toArrow(), duck.sql(SQL[name]).to_arrow_table()
    return [sorted(map(repr, zip(*[t[c].to_pylist() for c in sorted(t.column_names)]))) for t in (got, want)]


def parts(spark, keys, brand="Brand#3"):
    k = spark.createDataFrame([(k,) for k in keys], "p_partkey long")
    return k.select("p_partkey", F.concat(F.lit("part "), "p_partkey").alias("p_name"), F.lit(brand).alias("p_brand"), F.lit("T").alias("p_type"), (F.col("p_partkey") % 50).cast("int").alias("p_size"), (900 + F.col("p_partkey") / 10).alias("p_retailprice"))


@pytest.mark.parametrize("keys", [[13, 14], [13, 22], [26, 39], [12, 13]])
def test_summary_of_a_column_that_begins_blank(spark, tmp_path, keys):
    got, want = same(spark, tmp_path, "shape_summary", part=parts(spark, keys))
    assert got == want and len(got) == 1


def test_values_are_listed_only_where_they_are_all(spark):
    """Many values: the sketch of the frequent ones names none of them, or only those that are frequent."""
    k = spark.range(6000)
    texts = {1: F.concat(F.lit("v"), "id"), 2: F.when(F.col("id") % 2 == 0, "often").otherwise(F.concat(F.lit("v"), "id")), 3: F.concat(F.lit("v"), F.col("id") % 20), 4: F.concat(F.lit("v"), F.col("id") % 21)}
    cells = k.select(F.lit("s").alias("sheet"), (F.col("id") + 2).cast("int").alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in texts.items()])).alias("x")).select("sheet", "row", "x.*")
    found = profile.fields(cells, source.Region("c", sheets.Rect(1, 1, 9, 4), rows="SHEET_END"))
    assert {r["col"]: r["values"] for r in found.collect()} == {1: None, 2: None, 3: sorted(f"v{i}" for i in range(20)), 4: None}


@pytest.fixture
def uneven(spark):
    """A session that neither broadcasts nor joins small partitions, as with tables that are too large for both."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def most(df):
    """The share of the rows that the fullest task has."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def one_sheet(spark, blocks):
    """A sheet of blocks of two rows and columns, each a row below the other."""
    each = [(0, 1, F.lit("Order")), (0, 2, F.col("id")), (1, 1, F.lit("Total")), (1, 2, F.col("id") * 2)]
    cells = F.array(*[F.struct((F.col("id") * 3 + 1 + r).cast("int").alias("row"), F.lit(c).alias("col"), v.cast("string").alias("value")) for r, c, v in each])
    return spark.range(blocks).select(F.lit("s").alias("sheet"), F.explode(cells).alias("x")).select("sheet", "x.*")


def test_lines_of_one_sheet_are_dealt_over_tasks(uneven):
    cells = one_sheet(uneven, 6000)
    rows = source.region_rows(cells, source.Region("d", sheets.Rect(1, 1, 9, 2), rows="SHEET_END", header_rows=0, specs=(Spec("a", "A"), Spec("b", "B", "long")))).out
    assert rows.count() == 12000 and most(rows) < 0.7
    assert source.locate(cells, source.Region("d", sheets.Rect(1, 1, 9, 2), rows="SHEET_END")).out.select("bottom").first()[0] == 17999


@pytest.mark.parametrize("inner", ["FORM", "KEY_VALUE"])
def test_blocks_of_one_sheet_are_numbered_by_many_tasks(uneven, inner):
    specs = (Spec("key", "Order" if inner == "KEY_VALUE" else None, "long"), Spec("total", "Total" if inner == "KEY_VALUE" else None, "long"))
    own = source.Region("b", sheets.Rect(1, 1, 9, 2), rows="SHEET_END", shape="REPEATING_BLOCK", block=(2, 2), block_anchor="Order", inner=inner, fields={"key": (1, 2), "total": (2, 2)}, specs=specs)
    rows = source.region_rows(one_sheet(uneven, 6000), own).out
    assert not re.search(r"row_number\(\) windowspecdefinition\(sheet#\d+, top#", rows._jdf.queryExecution().toString())
    assert most(rows) < 0.7
    assert rows.where("_block = key + 1 and total = 2 * key and row = 3 * key + 1").count() == rows.count() == 6000


@pytest.mark.parametrize("inner", ["FORM", "KEY_VALUE"])
def test_cells_of_blocks_are_sent_once(uneven, inner):
    """Blocks that reach over bands of rows, side by side in lines that are cut into tiles; two that meet leave a sheet without rows."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.struct((F.col("id") * 7 + 1 + i % 3).alias("top"), (i * 3 + 1).alias("left"), (F.col("id") * 60 + i).alias("key")))
    at = uneven.range(160).select(F.explode(keys).alias("b")).select("b.*")
    each = [(0, 0, F.lit("Order")), (0, 1, F.col("key")), (4, 0, F.lit("Total")), (4, 1, F.col("key") * 2)]
    cells = at.select(F.lit("s").alias("sheet"), F.explode(F.array(*[F.struct((F.col("top") + r).cast("int").alias("row"), (F.col("left") + c).cast("int").alias("col"), v.cast("string").alias("value")) for r, c, v in each])).alias("x")).select("sheet", "x.*")
    meeting = uneven.createDataFrame([("t", 511, 1, "Order"), ("t", 515, 2, "Order"), ("u", 511, 1, "Order"), ("u", 516, 2, "Order")], cells.schema)
    specs = (Spec("key", "Order" if inner == "KEY_VALUE" else None, "long"), Spec("total", "Total" if inner == "KEY_VALUE" else None, "long"))
    own = source.Region("b", sheets.Rect(1, 1, 9, 180), rows="SHEET_END", shape="REPEATING_BLOCK", block=(5, 2), block_anchor="Order", inner=inner, fields={"key": (1, 2), "total": (5, 2)}, specs=specs)
    flow = source.region_rows(cells.unionByName(meeting), own)
    assert [(r["code"], r["field"]) for r in flow.issues.where("code like 'REPEATING%'").collect()] == [("REPEATING_BLOCK_OVERLAP", "t")]
    assert flow.out.where("sheet <> 's'").groupBy("sheet").count().collect() == [("u", 2)]
    got = [tuple(r) for r in flow.out.where("sheet = 's'").select("row", "_block", "key", "total").orderBy("_block").collect()]
    want = sorted((r["top"], r["left"], r["key"]) for r in at.collect())
    assert got == [(top, n + 1, key, 2 * key) for n, (top, _, key) in enumerate(want)]
    flow.out.collect()
    plan = flow.out._jdf.queryExecution().executedPlan().toString()
    sent = {x for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan) if re.search(r"\b(gy|gx|left)#", x)}
    assert not sent


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "a  b", " a", "a ", "a\n", "\na", "a\tb", "a b", "　a", "a​b", "​", "a⁠ ", "\x7f", "é", "a é", "a\x85", "a b", None])
def test_plain_texts_need_no_cleaning(spark, text):
    """What the shortcut of visible texts leaves alone is what the whole way leaves alone."""
    df = spark.createDataFrame([(text,)], "t string")
    slow = text_functions.strip(F.translate(F.replace("t", F.lit(" "), F.lit(" ")), text_functions.INVISIBLE, ""))
    whole = text_functions.strip(F.regexp_replace(F.translate("t", text_functions.INVISIBLE, ""), text_functions.SPACE, " "))
    r = df.select(text_functions.clean_text(F.col("t")).alias("a"), slow.alias("b"), text_functions.norm_text(F.col("t")).alias("c"), whole.alias("d")).first()
    assert (r["a"], r["c"]) == (r["b"], r["d"])
