"""Notes are dealt out in tasks of as many rows at every size."""

from pyspark.sql import functions as F
from textveil.functions.spans import SPANS
from textveil.sources import tables
from textveil.sources.notes import gold_sql, notes, text_sql


def test_tasks_grow_with_the_orders(spark, tmp_path):
    """Tasks were as many as the join or the cores made, however many notes there were."""
    n = 6 * tables.TASK_ROWS
    spark.range(n).selectExpr("id as o_orderkey", "id % 50 as o_custkey", "date'1996-03-04' as o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id as c_custkey", "int(id % 5) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).selectExpr("int(id) as n_nationkey", "concat('N', id) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    counted = notes(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(counted) == 6 and sum(r["count"] for r in counted) == n and max(r["count"] for r in counted) < 1.1 * tables.TASK_ROWS
    assert tables.tasks(spark.range(0)) == spark.sparkContext.defaultParallelism


def test_small_tables_have_tasks_of_the_same_rows(spark):
    """Up to 50,000 rows were one task, so that the longest one grew with the table until there were more tasks than cores."""
    assert all(n / tables.tasks(spark.range(n)) <= 10_000 for n in (60_000, 150_000, 900_000))


def test_values_are_made_once(spark):
    """Texts and spans made of a note's values are those of the expressions that the SQL shares, which make a value for each use."""
    sf, gold = "/root/testdata/sf0.001", gold_sql("array({})", "named_struct('s', {s}, 'e', {e}, 'label', {label})")
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    every = read("orders").join(read("customer"), F.expr("o_custkey = c_custkey")).join(read("nation"), F.expr("c_nationkey = n_nationkey"))
    none = f"cast(array() as {SPANS})"
    wanted = every.selectExpr("o_orderkey as doc_id", f"{text_sql()} as text", f"coalesce({gold}, {none}) as gold").orderBy("doc_id").collect()
    found = notes(spark, sf).select("doc_id", "text", "gold")
    assert found.orderBy("doc_id").collect() == wanted and len({r.doc_id % 16 for r in wanted}) == 16
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("@mail.example.org") <= 5


def test_batches_are_named_before_their_texts_are_made(spark):
    """Whole texts were moved to the ranges in which a batch is numbered, and masked and restored in these."""
    from textveil.plans.registry import QUERIES

    plan = QUERIES["roundtrip_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan[plan.index("Window") :]  # bounds of ranges were looked through row by row
    window, made, dealt = (plan.index(part) for part in ("Window", "Seen by ", "RepartitionByExpression"))
    assert made < dealt < window  # the plan is listed from its last step to its first one


def test_items_are_made_once(spark):
    """Each identifier was made into a struct twice before its date was moved, and a lone one was sorted and counted."""
    from textveil.operators import masking

    docs = spark.createDataFrame([(1, "a 1/2/2024, b@x.org", [(2, 10, "DATE"), (12, 19, "EMAIL")]), (2, "B@x.org", [(0, 7, "EMAIL")]), (3, "", [])], f"doc_id long, text string, spans {SPANS}")
    done = masking.mask(docs.withColumn("shift", F.lit(1)))
    assert [(r.masked, [tuple(t) for t in r._tokens]) for r in done.orderBy("doc_id").collect()] == [("a 01/03/2024, [EMAIL_1]", [("EMAIL", "b@x.org", 1)]), ("[EMAIL_1]", [("EMAIL", "b@x.org", 1)]), ("", [])]
    assert "transform(transform(" not in done.select("masked")._jdf.queryExecution().optimizedPlan().toString()
