"""The plans hold at scale: pruned scans, early aggregation, no forced broadcasts, split hot keys."""

from __future__ import annotations

import contextlib
import re

import pytest
from pyspark.sql import functions as F

from lakemart import operators as ops
from lakemart import plans
from lakemart.queries import QUERIES

from helpers import physical_plan

PYTHON_STEPS = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")
PYTHON_ALLOWED = {"r06_rewrite", "r07_notebooks", "r07_notebook_errors"}


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_all_pairs_join(spark, small_dir, name):
    plan = physical_plan(QUERIES[name](spark, small_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_ALLOWED:
        assert not any(step in plan for step in PYTHON_STEPS)


def test_flagship_scan_is_pruned_and_sum_is_partial(spark, small_dir):
    plan = physical_plan(QUERIES["d20_sum_by_category"](spark, small_dir))
    assert "ReadSchema: struct<p_size:int,p_retailprice:double>" in plan
    assert "partial_try_sum" in plan or "partial_sum" in plan
    exchanges = re.findall(r"Exchange (\w+)", plan)
    assert sorted(exchanges) == ["hashpartitioning", "rangepartitioning"]


@pytest.mark.parametrize(
    "name",
    ["d01_scan", "d09_truncate", "d14_model", "r01_scope", "r03_find_replace", "r05_find_key",
     "r05_malformed", "r05_find_keys", "r05_find_key_errors", "r07_array", "r09_swap", "r09_swap_by_name", "r09_swap_long",
     "r13_package", "d12_shortcut", "d13_entity_scan"],
)
def test_row_local_operators_do_not_shuffle(spark, small_dir, name):
    plan = physical_plan(QUERIES[name](spark, small_dir))
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_ids_leave_before_the_shuffle(spark, small_dir):
    """What is an id already is filtered out below the exchange of the names."""
    refs = spark.range(10).selectExpr("CAST(id AS STRING) AS ref")
    items = spark.range(5).selectExpr("CAST(id AS STRING) AS id", "'n' || id AS display_name")
    with settings(spark, **NO_BROADCAST):
        plan = physical_plan(ops.resolve_ref(refs, "ref", items))
    ready, named = plan[plan.index("Union") :].split("\n   +- ", 1)
    assert "Exchange" not in ready and "RLIKE" in ready
    assert named.count("hashpartitioning(ref") == 1


@pytest.mark.parametrize("name", ["r11_report_model", "r11_report_without_model"])
def test_reports_take_one_join(spark, small_dir, name):
    with settings(spark, **NO_BROADCAST):
        plan = physical_plan(QUERIES[name](spark, small_dir))
    assert plan.count("Join") == 1


def test_scope_filter_reaches_the_scan(spark, small_dir):
    plan = physical_plan(QUERIES["r01_scope"](spark, small_dir))
    assert "PushedFilters: [In(event_type, [click,view])]" in plan


def test_find_key_parses_each_document_once(spark, small_dir):
    plan = physical_plan(QUERIES["r05_find_event_key"](spark, small_dir))
    assert plan.count("parseJson") == 1
    assert plan.count("FileScan") == 1


def test_rebind_shuffles_the_big_side_at_most_once(spark, small_dir):
    with settings(spark, **NO_BROADCAST):
        lines = spark.read.parquet(f"{small_dir}/lineitem.parquet")
        items = spark.range(100).selectExpr("id", "'n' || id AS display_name")
        plan = physical_plan(
            ops.rebind(lines.select("l_suppkey"), "l_suppkey", items, items, by=["display_name"])
        )
    assert plan.count("hashpartitioning(l_suppkey") <= 1


def test_several_keys_take_one_parse(spark, small_dir):
    assert physical_plan(QUERIES["r05_find_keys"](spark, small_dir)).count("parseJson") == 1


def test_texts_that_name_nothing_are_not_shuffled(spark, small_dir):
    """Only the branch of candidates has an exchange below its scan of bodies."""
    docs = spark.range(10).selectExpr("id AS doc_id", "CAST(id AS STRING) AS body")
    items = spark.range(5).selectExpr("CAST(id AS STRING) AS id", "'n' || id AS display_name", "'Notebook' AS type")
    for df in (
        ops.rewrite_pipelines(docs, items, items, "w"),
        ops.repair_notebooks(docs, items, items, "w"),
    ):
        plan = physical_plan(df)
        assert plan.count("Union") >= 1
        plain = plan[plan.index("Union") :].split("\n")[1:6]
        assert not any("Exchange" in line for line in plain[:3])


def test_rewriting_computes_texts_and_deals_rows_once(spark, small_dir):
    """No filter on the text moves below the shuffle of its columns, so all branches share that."""
    result = QUERIES["r06_rewrite"](spark, small_dir)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    dealt = [part.split("Relation")[0] for part in plan.split("RepartitionByExpression")[1:]]
    assert dealt
    assert not any("Filter" in part or "activities" in part for part in dealt)
    assert "get_json_object(new_body" not in plan


def test_ids_are_joined_to_one_row_for_all_types(spark):
    docs = spark.createDataFrame([('{"linkedService":{"properties":{"type":"Lakehouse","typeProperties":{"artifactId":"a"}}}}',)], "body string")
    items = spark.createDataFrame([("a", "n", t) for t in ("Warehouse", "Lakehouse", "Notebook")], "id string, display_name string, type string")
    with settings(spark, **NO_BROADCAST):
        plan = ops.rewrite_pipelines(docs, items, items, "w")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("(id#") :].split("\n")
    below = next(line for line in joined if "Aggregate" in line and "old_id" in line)
    assert "type#" not in below[: below.index("]")]


def test_notebooks_are_looked_up_by_narrow_rows(spark, small_dir):
    """Bodies take part in one join only, the last; what is distinct and looked up has none."""
    docs = spark.range(10).selectExpr("id AS doc_id", "CAST(id AS STRING) AS body")
    items = spark.range(5).selectExpr("CAST(id AS STRING) AS id", "'n' || id AS display_name", "'Lakehouse' AS type")
    with settings(spark, **NO_BROADCAST):
        plan = ops.repair_notebooks(docs, items, items, "w")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join LeftOuter" in line]
    assert len(joins) == 2
    looked_up = plan[plan.index(joins[1]) :]
    aggregate = looked_up[looked_up.index("Aggregate") :].split("\n")[0]
    assert "body" not in aggregate and "from_json" not in aggregate


def test_operators_start_no_job(spark, small_dir):
    """All but the sinks and the two that resolve a list of names are lazy."""
    context = spark.sparkContext
    items = spark.read.parquet(f"{small_dir}/supplier.parquet").selectExpr(
        "CAST(s_suppkey AS STRING) AS id", "s_name AS display_name", "'Lakehouse' AS type",
        "CAST(s_suppkey AS STRING) AS dataset_id", "s_name AS dataset_name",
    )
    docs = items.selectExpr("id AS doc_id", "display_name AS body")
    context.setJobGroup("lazy", "no jobs expected")
    try:
        ops.lookup(docs, items, {"body": "display_name"})
        ops.rebind(docs, "doc_id", items, items)
        ops.resolve_ref(docs, "body", items)
        ops.resolve_tokens(docs, "body", items, "w")
        ops.report_model(items, items)
        ops.report_without_model(items, items)
        ops.publish(items, items)
        ops.orphans(items, items)
        ops.find_key(docs, "k")
        ops.rewrite_pipelines(docs, items, items, "w", [("a", "b")])
        ops.repair_notebooks(docs, items, items, "w")
        ops.swap(docs, "body", [(str(i), "x") for i in range(100)])
        assert list(context.statusTracker().getJobIdsForGroup("lazy")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("operator", ["lookup", "rebind", "resolve_ref", "resolve_tokens", "orphans", "publish", "with_model", "cross_filter"])
def test_hot_keys_are_split(spark, tmp_path, operator):
    """One key holds a third of the rows: adaptive execution splits its partition."""
    n = 600_000
    big = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("ref"),
        F.concat(F.lit("payload"), F.sha2(F.col("id").cast("string"), 256)).alias("payload"),
    )
    big.repartition(16).write.parquet(str(tmp_path / "big"))
    big = spark.read.parquet(str(tmp_path / "big"))
    names = F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id")))
    catalog = spark.range(0, n, 5).select(
        names.alias("display_name"), F.concat(F.lit("i"), F.col("id")).alias("id"), F.lit("T").alias("type")
    )
    adaptive = {
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "1m",
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "1m",
    }
    with settings(spark, **NO_BROADCAST, **adaptive):
        if operator == "lookup":
            result = ops.lookup(big, catalog, {"ref": "display_name"})
        elif operator == "resolve_ref":
            result = ops.resolve_ref(big, "ref", catalog)
        elif operator == "resolve_tokens":
            tokens = big.withColumn("ref", F.concat(F.lit("$items.T."), "ref", F.lit(".id")))
            result = ops.resolve_tokens(tokens, "ref", catalog, "w")
        elif operator == "rebind":
            source = catalog.select(F.col("display_name").alias("id"), F.col("id").alias("display_name"))
            target = source.withColumn("id", F.concat(F.lit("new"), "id"))
            result = ops.rebind(big, "ref", source, target, by=["display_name"])
        elif operator == "orphans":
            keys = catalog.select(F.col("display_name").alias("ref"))
            result = ops.orphans(big, keys, key=["ref"])
        elif operator == "publish":
            own = catalog.select(F.col("display_name").alias("ref"), F.lit("").alias("payload"))
            result = ops.publish(own, big, key=["ref"])
        elif operator == "with_model":
            result = ops.with_model(big, catalog, "ref", "display_name", "id")
        else:
            result = plans.cross_filter(big, "ref", catalog.select("display_name"))
        counted = result.agg(F.count("*"), F.max("payload"))
        found = counted.collect()[0][0]
        plan = physical_plan(counted)
    assert "skew=true" in plan
    matched = n // 5 + n // 3 - n // 15  # every fifth key, and the hot one throughout
    kept = {"orphans": n - matched, "cross_filter": matched, "publish": n - matched + n // 5}
    assert found == kept.get(operator, n)


@pytest.mark.parametrize("operator", ["rewrite_pipelines", "shape", "repair_notebooks"])
def test_hot_texts_are_split(spark, tmp_path, operator):
    """A template that a third of the documents share is rewritten in many tasks."""
    n = 60_000
    name = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id")))
    filler = F.concat(F.lit('{"pad":"'), F.when(F.col("id") % 3 == 0, F.lit("x" * 400)).otherwise(F.repeat(F.sha2(name, 256), F.lit(6))))
    if operator == "repair_notebooks":
        rest = F.concat(F.lit('","metadata":{"dependencies":{"lakehouse":{"default_lakehouse_name":"'), name, F.lit('"}}}}'))
    else:
        rest = F.concat(
            F.lit('","linkedService":{"properties":{"type":"Lakehouse","typeProperties":{"artifactId":"'), name,
            F.lit('"}}}}'),
        )
    # equal texts compress to nothing: what else a row has makes the partition large
    payload = F.concat(*[F.sha2(F.concat("id", F.lit(i)), 256) for i in range(4)])
    docs = spark.range(n).select("id", F.concat(filler, rest).alias("body"), payload.alias("payload"))
    docs.repartition(16).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    keys = F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id")))
    catalog = spark.range(0, n, 5).select(keys.alias("id"), keys.alias("display_name"), F.lit("Lakehouse").alias("type"))
    shape = None
    if operator == "shape":
        place = "struct<artifactId: string, workspaceId: string, endpoint: string>"
        shape = f"pad string, linkedService struct<properties: struct<type: string, typeProperties: {place}>>"
    adaptive = {
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "1m",
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "1m",
        "spark__sql__adaptive__forceOptimizeSkewedJoin": "true",
    }
    with settings(spark, **NO_BROADCAST, **adaptive):
        if operator == "repair_notebooks":
            result = ops.repair_notebooks(docs, catalog, catalog, "w")
        else:
            result = ops.rewrite_pipelines(docs, catalog, catalog, "w", shape=shape)
        counted = result.agg(F.count_if("changed"), F.max("new_body"), F.max("payload"))
        found = counted.collect()[0][0]
        plan = physical_plan(counted)
    assert "skew=true" in plan
    even = spark.range(n).where("id % 3 = 0 or id % 5 = 0").count()
    assert found == even


@pytest.mark.parametrize("operator", ["lookup", "rebind", "resolve_tokens"])
def test_null_keys_are_spread(spark, operator):
    """Rows with nothing to look up are dealt by a hash of the row."""
    n = 40_000
    big = spark.range(n).select(F.lit(None).cast("string").alias("ref"), "id")
    catalog = spark.range(100).selectExpr("'i' || id AS id", "'k' || id AS display_name", "'T' AS type")
    with settings(spark, **NO_BROADCAST, spark__sql__adaptive__coalescePartitions__enabled="false"):
        if operator == "lookup":
            result = ops.lookup(big, catalog, {"ref": "display_name"}, alias="found")
        elif operator == "rebind":
            result = ops.rebind(big, "ref", catalog, catalog, alias="found")
        else:
            plain = big.withColumn("ref", F.lit("plain"))
            result = ops.resolve_tokens(plain, "ref", catalog, "w", alias="found")
        sizes = result.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < n / 4


def test_status_and_sums_combine_before_the_shuffle(spark, small_dir):
    for name, marker in (("r14_status", "partial_max"), ("d19_default_sums", "partial_")):
        assert marker in physical_plan(QUERIES[name](spark, small_dir))
