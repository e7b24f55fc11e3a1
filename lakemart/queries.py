"""Every operator as a query on the test tables, next to the SQL that must agree with it.

The tables stand in for the data the operators are made for: ``part`` for a model
table, ``customer`` and ``supplier`` for item catalogs, ``events`` for a log of job
runs, and definitions are built from the columns of ``orders``. Every query reads
its tables whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemart import operators as ops
from lakemart import plans, sources
from lakemart.functions.rewriting import NOTEBOOK_ACTIVITY
from lakemart.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fresh(label: str) -> str:
    return f"lakemart_{label}_{uuid.uuid4().hex}"


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- ingest ---------------------------------------------------------------


@query("d01_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def d01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sources.scan(spark, sf_dir, "lineitem*.parquet")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "d05_append",
    """
    SELECT c_custkey, c_name, c_nationkey FROM customer
    UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer
    """,
)
def d05_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, path = _fresh("d05"), scratch_path(spark, "d05")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    sources.append(rows, name, path=path)
    sources.append(rows, name, path=path)
    return spark.table(name)


@query(
    "d07_by_name",
    """
    SELECT s_suppkey, s_name FROM supplier
    UNION ALL SELECT s_suppkey, s_name FROM supplier
    """,
)
def d07_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, path = _fresh("d07"), scratch_path(spark, "d07")
    rows = table(spark, sf_dir, "supplier")
    sources.append(rows.select("s_suppkey", "s_name"), name, path=path)
    sources.append(rows.select("s_name", "s_suppkey"), name, path=path)
    return spark.table(name)


@query(
    "d09_truncate",
    """
    SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS price_int,
           CAST(trunc(-l_quantity * l_tax) AS BIGINT) AS negative_int
    FROM lineitem
    """,
)
def d09_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("price_int"),
        (-F.col("l_quantity") * F.col("l_tax")).alias("negative_int"),
    )
    sink = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_linenumber", T.IntegerType()),
            T.StructField("price_int", T.LongType()),
            T.StructField("negative_int", T.LongType()),
        ]
    )
    return sources.convert(lines, sink)


@query(
    "d10_bool_text",
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS is_returned
    FROM lineitem
    """,
)
def d10_bool_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("is_returned")
    )
    sink = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_linenumber", T.IntegerType()),
            T.StructField("is_returned", T.StringType()),
        ]
    )
    return sources.convert(lines, sink)


@query("d12_shortcut", "SELECT p_partkey, p_name FROM part")
def d12_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sources.register_source(spark, "lakemart_part", sf_dir, "/part.parquet")
    return parts.select("p_partkey", "p_name")


@query("d13_entity_scan", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def d13_entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _fresh("d13")
    sources.create_external_table(spark, name, sf_dir, "supplier.parquet")
    return sources.entity(spark, name).select("s_suppkey", "s_name", "s_acctbal")


# --- model and report -----------------------------------------------------

PARTS = plans.Model(
    "parts",
    (
        plans.Column("age", "p_size", "int64"),
        plans.Column("part_key", "p_partkey", "int64"),
        plans.Column("bmi", "p_retailprice", "double", "sum"),
    ),
)

LINES = plans.Model(
    "lines",
    (
        plans.Column("l_linenumber", "l_linenumber", "int64"),
        plans.Column("quantity", "l_quantity", "double", "sum"),
        plans.Column("price", "l_extendedprice", "double", "sum"),
        plans.Column("discount", "l_discount", "double", "sum"),
    ),
)


@query(
    "d14_model",
    """
    SELECT CAST(p_size AS BIGINT) AS age, CAST(p_partkey AS BIGINT) AS part_key,
           CAST(p_retailprice AS DOUBLE) AS bmi
    FROM part
    """,
)
def d14_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.view(table(spark, sf_dir, "part"), PARTS)


@query(
    "d17_errors_null",
    """
    SELECT o_orderkey, TRY_CAST(o_orderpriority AS BIGINT) AS whole,
           TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS lead_digit
    FROM orders
    """,
)
def d17_errors_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = plans.Model(
        "priorities",
        (
            plans.Column("o_orderkey", "o_orderkey", "int64"),
            plans.Column("whole", "o_orderpriority", "int64"),
            plans.Column("lead_digit", "first_letter", "int64"),
        ),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.substring("o_orderpriority", 1, 1).alias("first_letter"),
    )
    return plans.view(orders, model)


@query(
    "d18_collation",
    """
    SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS segment,
           count(*) AS n
    FROM customer GROUP BY 1
    """,
)
def d18_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(
        F.lower("c_mktsegment")
    )
    rows = table(spark, sf_dir, "customer").select(segment.alias("segment"), F.lit(1).alias("one"))
    return plans.sum_by_category(rows, "segment", "one", measure_name="n", ordered=False)


@query(
    "d19_default_sums",
    """
    SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, round(sum(l_quantity), 2) AS sum_quantity,
           round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_discount), 2) AS sum_discount
    FROM lineitem GROUP BY 1
    """,
)
def d19_default_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = plans.summarize(plans.view(table(spark, sf_dir, "lineitem"), LINES), LINES)
    return sums.select(
        "l_linenumber",
        *[
            F.round(F.col(f"`Sum of {name}`"), 2).alias(f"sum_{name}")
            for name in ("quantity", "price", "discount")
        ],
    )


@query(
    "d20_sum_by_category",
    """
    SELECT CAST(p_size AS BIGINT) AS category, round(sum(p_retailprice), 2) AS sum_measure
    FROM part GROUP BY p_size HAVING sum(p_retailprice) IS NOT NULL
    ORDER BY sum_measure DESC, category
    """,
)
def d20_sum_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = plans.view(table(spark, sf_dir, "part"), PARTS)
    sums = plans.sum_by_category(parts, "age", "bmi", "category", "sum_measure")
    return sums.select("category", F.round("sum_measure", 2).alias("sum_measure"))


@query(
    "d22_blank_groups",
    """
    SELECT category, round(sum(measure), 2) AS sum_measure
    FROM (SELECT nullif(l_linenumber, 3) AS category,
                 CASE WHEN l_linenumber <> 5 AND l_tax > 0 THEN l_quantity END AS measure
          FROM lineitem)
    GROUP BY category HAVING sum(measure) IS NOT NULL
    """,
)
def d22_blank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(
        F.nullif(number, F.lit(3)).alias("category"),
        F.when((number != 5) & (F.col("l_tax") > 0), F.col("l_quantity")).alias("measure"),
    )
    sums = plans.sum_by_category(lines, "category", "measure", measure_name="sum_measure")
    return sums.select("category", F.round("sum_measure", 2).alias("sum_measure"))


@query(
    "d24_cross_filter",
    """
    SELECT p_brand, round(sum(p_retailprice), 2) AS sum_measure
    FROM part WHERE p_size IN (1, 2, 3) GROUP BY p_brand
    """,
)
def d24_cross_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = plans.cross_filter(table(spark, sf_dir, "part"), "p_size", [1, 2, 3])
    sums = plans.sum_by_category(
        chosen, "p_brand", "p_retailprice", measure_name="sum_measure", ordered=False
    )
    return sums.select("p_brand", F.round("sum_measure", 2).alias("sum_measure"))


@query(
    "d24_cross_filter_table",
    """
    SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_measure
    FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')
    GROUP BY l_returnflag
    """,
)
def d24_cross_filter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = table(spark, sf_dir, "part").where("p_brand = 'Brand#7'").select("p_partkey")
    chosen = plans.cross_filter(table(spark, sf_dir, "lineitem"), "l_partkey", selected)
    sums = plans.sum_by_category(
        chosen, "l_returnflag", "l_quantity", measure_name="sum_measure", ordered=False
    )
    return sums.select("l_returnflag", F.round("sum_measure", 2).alias("sum_measure"))


# --- catalogs -------------------------------------------------------------


@query("r01_scope", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def r01_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ops.in_scope(events, ["view", "click"], "event_type")


@query(
    "r02_lookup",
    """
    WITH f AS (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name
               FROM supplier WHERE s_acctbal < 5000 GROUP BY s_nationkey)
    SELECT c_custkey, coalesce(s_name, 'NotExists') AS first_supplier
    FROM customer LEFT JOIN f ON s_nationkey = c_nationkey
    """,
)
def r02_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lookup(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        table(spark, sf_dir, "supplier").where("s_acctbal < 5000"),
        on={"c_nationkey": "s_nationkey"},
        value="s_name",
        alias="first_supplier",
        order=["s_suppkey"],
    ).drop("c_nationkey")


@query(
    "r02_lookup_typed",
    """
    WITH f AS (SELECT p_brand, p_type, min(p_name) AS p_name
               FROM part WHERE p_size < 10 GROUP BY p_brand, p_type)
    SELECT p.p_partkey, coalesce(f.p_name, 'NotExists') AS first_name
    FROM part p LEFT JOIN f ON f.p_brand = p.p_brand AND f.p_type = p.p_type
    """,
)
def r02_lookup_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return ops.lookup(
        parts.select("p_partkey", "p_brand", "p_type"),
        parts.where("p_size < 10"),
        on={"p_brand": "p_brand", "p_type": "p_type"},
        value="p_name",
        alias="first_name",
    ).select("p_partkey", "first_name")


def supplier_items(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    """Suppliers as catalog items of type Supplier."""
    return table(spark, sf_dir, "supplier").select(
        _text(prefix, F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("display_name"),
        F.lit("Supplier").alias("type"),
    )


@query(
    "r08_rebind",
    """
    SELECT l_orderkey, l_linenumber, l_suppkey,
           CASE WHEN l_suppkey % 10 <> 3 THEN t.s_suppkey + 1000 END AS new_suppkey
    FROM lineitem
    LEFT JOIN supplier s ON l_suppkey = s.s_suppkey
    LEFT JOIN supplier t ON t.s_name = s.s_name
    """,
)
def r08_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("display_name")
    )
    target = suppliers.where("id % 10 <> 3").withColumn("id", F.col("id") + 1000)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return ops.rebind(lines, "l_suppkey", suppliers, target, "new_suppkey", by=["display_name"])


@query(
    "r10_name_or_id",
    """
    WITH r AS (
      SELECT l_orderkey, l_linenumber,
             CASE l_suppkey % 5
               WHEN 0 THEN md5(CAST(l_suppkey AS VARCHAR))
               WHEN 1 THEN 'urn:uuid:' || md5(CAST(l_suppkey AS VARCHAR))
               WHEN 2 THEN '{' || substr(md5(CAST(l_suppkey AS VARCHAR)), 1, 8) || '-'
                               || substr(md5(CAST(l_suppkey AS VARCHAR)), 9) || '}'
               WHEN 3 THEN 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
               ELSE 'nobody ' || l_returnflag
             END AS ref
      FROM lineitem)
    SELECT l_orderkey, l_linenumber, r.ref,
           CASE WHEN regexp_full_match(replace(trim(replace(replace(r.ref, 'urn:', ''), 'uuid:', ''), '{}'), '-', ''), '[0-9a-fA-F]{32}')
                THEN r.ref ELSE 'id-' || s_suppkey END AS resolved
    FROM r LEFT JOIN supplier ON s_name = r.ref
    """,
)
def r10_name_or_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_suppkey")
    form, digest = key % 5, F.md5(key.cast("string").cast("binary"))
    ref = (
        F.when(form == 0, digest)
        .when(form == 1, _text("urn:uuid:", digest))
        .when(form == 2, _text("{", digest.substr(1, 8), "-", digest.substr(9, 24), "}"))
        .when(form == 3, F.format_string("Supplier#%09d", key))
        .otherwise(_text("nobody ", F.col("l_returnflag")))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref"))
    return ops.resolve_ref(lines, "ref", supplier_items(spark, sf_dir, "id-"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models, some of them without a name and some twice."""
    models = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    name = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name"))
    return models.withColumn("c_name", name).unionByName(models.where("c_custkey % 5 = 0"))


@query(
    "r11_report_model",
    """
    SELECT o_orderkey, o_custkey, CASE WHEN c_custkey % 7 <> 0 OR c_custkey % 5 = 0 THEN c_name END AS c_name
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'
    """,
)
def r11_report_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.report_model(
        reports(spark, sf_dir), datasets(spark, sf_dir), "o_custkey", "c_custkey", "c_name"
    )


@query(
    "r11_report_without_model",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM customer
                      WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')
    """,
)
def r11_report_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.report_without_model(
        reports(spark, sf_dir), datasets(spark, sf_dir), "o_custkey", "c_custkey"
    )


@query(
    "r12_exclude",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    """,
)
def r12_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return ops.exclude(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
        urgent.select(F.col("o_custkey").alias("c_custkey")),
        on=["c_custkey"],
    )


@query(
    "r15_publish",
    """
    WITH keyed AS (SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey // 2 END AS c_custkey,
                          c_custkey AS number, c_mktsegment FROM customer),
    source AS (SELECT c_custkey, min(c_mktsegment) AS c_mktsegment FROM keyed
               WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_custkey)
    SELECT c_custkey, c_mktsegment, 'source' AS origin FROM source
    UNION ALL
    SELECT c_custkey, c_mktsegment, 'target' AS origin FROM keyed t
    WHERE number % 2 = 0
      AND NOT EXISTS (SELECT 1 FROM source s WHERE s.c_custkey IS NOT DISTINCT FROM t.c_custkey)
    """,
)
def r15_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    # keys that are null, and two rows with each key
    halved = F.when(F.col("c_custkey") % 50 != 0, F.floor(F.col("c_custkey") / 2))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("number"), halved.alias("c_custkey"), "c_mktsegment"
    )
    return ops.publish(
        customers.drop("number").withColumn("origin", F.lit("source")),
        customers.where("number % 2 = 0").drop("number").withColumn("origin", F.lit("target")),
        key=["c_custkey"],
        types=["BUILDING", "MACHINERY"],
        type_column="c_mktsegment",
    )


@query(
    "r16_orphans",
    """
    SELECT DISTINCT o_custkey, o_orderstatus
    FROM (SELECT CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus FROM orders) o
    WHERE o_orderstatus = 'F' AND NOT EXISTS (
        SELECT 1 FROM (SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS k
                       FROM customer WHERE c_mktsegment = 'BUILDING') c
        WHERE k IS NOT DISTINCT FROM o.o_custkey)
    """,
)
def r16_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some keys are null on both sides, and many of the source are there more than once."""
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus"
    )
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    keys = building.select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("o_custkey"))
    return ops.orphans(
        orders.distinct(), keys.union(keys), key=["o_custkey"], types=["F"], type_column="o_orderstatus"
    )


# --- documents ------------------------------------------------------------


@query(
    "r03_find_replace",
    """
    SELECT doc_id, CASE lang WHEN 'en' THEN replace(text, 'the', 'DEV')
                             WHEN 'fr' THEN replace(replace(text, 'le', 'TEST'), 'ES', 'es')
                             ELSE text END AS new_text
    FROM documents
    """,
)
def r03_find_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("the", {"en": "DEV", "es": "the"}),
        ("le", {"fr": "TEST"}),
        ("ES", {"fr": "es"}),
    ]
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return ops.find_replace(docs, rules, "lang", "text", "new_text").select("doc_id", "new_text")


@query(
    "r04_tokens",
    """
    WITH t AS (SELECT l_orderkey, l_linenumber,
                      CASE l_linenumber % 3
                        WHEN 0 THEN '$items.Supplier.Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '.id'
                        WHEN 1 THEN '$workspace.id'
                        ELSE l_returnflag END AS token
               FROM lineitem)
    SELECT l_orderkey, l_linenumber, token,
           CASE WHEN token LIKE '$items.%' THEN 'id-' || s_suppkey
                WHEN token = '$workspace.id' THEN 'ws-1' ELSE token END AS resolved
    FROM t LEFT JOIN supplier ON s_suppkey % 10 <> 3 AND s_name = split_part(token, '.', 3)
    """,
)
def r04_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("l_linenumber") % 3
    token = (
        F.when(form == 0, F.format_string("$items.Supplier.Supplier#%09d.id", F.col("l_suppkey")))
        .when(form == 1, F.lit("$workspace.id"))
        .otherwise(F.col("l_returnflag"))
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", token.alias("token")
    )
    items = supplier_items(spark, sf_dir, "id-").where("NOT endswith(display_name, '3')")
    return ops.resolve_tokens(lines, "token", items, "ws-1")


@query(
    "r04_resolved_rules",
    """
    SELECT doc_id,
           CASE lang
             WHEN 'en' THEN replace(text, 'the', (SELECT 'id-' || min(s_suppkey) FROM supplier
                                                  WHERE s_name = 'Supplier#000000001'))
             WHEN 'fr' THEN replace(text, 'le', 'ws-1') ELSE text END AS new_text
    FROM documents
    """,
)
def r04_resolved_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ops.resolve_rules(
        [
            ("the", {"en": "$items.Supplier.Supplier#000000001.id"}),
            ("le", {"fr": "$workspace.id"}),
        ],
        supplier_items(spark, sf_dir, "id-"),
        "ws-1",
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return ops.find_replace(docs, rules, "lang", "text", "new_text").select("doc_id", "new_text")


@query(
    "r05_find_key",
    """
    SELECT o_orderkey, CAST(unnest(json_extract(j, '$..ref')) AS VARCHAR) AS found
    FROM (SELECT o_orderkey, '{"ls":{"ref":' || o_custkey || '},"xs":[{"ref":' || o_orderkey
                             || '},{"y":{"ref":{"ref":7}}}]}' AS j FROM orders)
    """,
)
def r05_find_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _text(
        '{"ls":{"ref":', F.col("o_custkey"), '},"xs":[{"ref":', F.col("o_orderkey"),
        '},{"y":{"ref":{"ref":7}}}]}',
    )
    docs = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return ops.find_key(docs, "ref").select("o_orderkey", F.to_json("value").alias("found"))


@query(
    "r05_find_keys",
    """
    WITH docs AS (SELECT o_orderkey, '{"ls":{"ref":' || o_custkey || '},"xs":[{"id":' || o_orderkey
                                     || '},{"y":{"ref":{"id":7}}}]}' AS j FROM orders)
    SELECT o_orderkey, 'ref' AS key, CAST(unnest(json_extract(j, '$..ref')) AS VARCHAR) AS found FROM docs
    UNION ALL
    SELECT o_orderkey, 'id' AS key, CAST(unnest(json_extract(j, '$..id')) AS VARCHAR) AS found FROM docs
    """,
)
def r05_find_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _text(
        '{"ls":{"ref":', F.col("o_custkey"), '},"xs":[{"id":', F.col("o_orderkey"),
        '},{"y":{"ref":{"id":7}}}]}',
    )
    docs = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    found = ops.find_key(docs, ["ref", "id"], key_alias="key")
    return found.select("o_orderkey", "key", F.to_json("value").alias("found"))


@query(
    "r05_find_event_key",
    "SELECT event_id, CAST(unnest(json_extract(props, '$..k')) AS VARCHAR) AS found FROM events",
)
def r05_find_event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    found = ops.find_key(events, "k", body="props")
    return found.select("event_id", F.to_json("value").alias("found"))


@query(
    "r05_find_key_errors",
    """
    WITH docs AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '[' || props ELSE props END AS body
                  FROM events)
    SELECT event_id, CAST(unnest(json_extract(body, '$..k')) AS VARCHAR) AS found, CAST(NULL AS VARCHAR) AS error
    FROM docs WHERE json_valid(body)
    UNION ALL
    SELECT event_id, NULL, 'not JSON' FROM docs WHERE NOT json_valid(body) AND contains(body, '"k"')
    """,
)
def r05_find_key_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values found and documents refused, from one parse."""
    broken = F.when(F.col("event_type") == "error", _text("[", F.col("props")))
    events = table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(broken, F.col("props")).alias("body")
    )
    found = ops.find_key(events, "k", error_alias="error")
    return found.select("event_id", F.to_json("value").alias("found"), "error")


@query(
    "r05_malformed",
    """
    SELECT event_id, body
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '[' || props ELSE props END AS body
          FROM events)
    WHERE NOT json_valid(body)
    """,
)
def r05_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_type") == "error", _text("[", F.col("props")))
    events = table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(broken, F.col("props")).alias("body")
    )
    return ops.malformed(events)


def pipeline_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipeline definition per order: a copy sink, a notebook activity and a connection."""
    kind = (
        F.when(F.col("o_orderstatus") == "F", "Lakehouse")
        .when(F.col("o_orderstatus") == "O", "DataWarehouse")
        .otherwise("Blob")
    )
    # Texts of known form are joined, a free one is quoted; a missing number leaves its fields out.
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    sink = _text('"artifactId":"item-', customer, '","workspaceId":"ws-', customer % 3, '",')
    item = _text('"notebookId":"item-', order % 100, '",')
    body = _text(
        '{"properties":{"activities":[{"type":"Copy","typeProperties":{"sink":{"linkedService":{"properties":{"type":"',
        kind, '","typeProperties":{', F.coalesce(sink, F.lit("")), '"endpoint":"old-endpoint"}}}}},"externalReferences":',
        F.to_json(F.struct(F.col("o_orderpriority").alias("connection"))),
        '},{"type":"', NOTEBOOK_ACTIVITY, '","typeProperties":{', F.coalesce(item, F.lit("")), '"workspaceId":"ws-1"}}]}}',
    )
    # a test table is one row group, which one task reads: deal its narrow rows out first
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    spread = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    return spread.select(F.col("o_orderkey").alias("doc_id"), body.alias("body"))


# Copy sinks and notebooks in one list: each has some of the fields.
PIPELINE_SHAPE = """properties struct<activities: array<struct<
    type: string,
    typeProperties: struct<
        sink: struct<linkedService: struct<properties: struct<
            type: string,
            typeProperties: struct<artifactId: string, workspaceId: string, endpoint: string>>>>,
        notebookId: string,
        workspaceId: string>,
    externalReferences: struct<connection: string>>>>"""


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    source = customers.select(
        _text("item-", F.col("c_custkey")).alias("id"), F.col("c_name").alias("display_name")
    )
    target = customers.where("c_nationkey <> 4").select(
        F.col("c_name").alias("display_name"),
        _text("endpoint-", F.col("c_custkey")).alias("endpoint"),
        F.explode(F.array(F.lit("Lakehouse"), F.lit("Warehouse"), F.lit("Notebook"))).alias("type"),
        F.col("c_custkey"),
    )
    target = target.withColumn("id", _text(F.col("type"), "-", F.col("c_custkey")))
    pairs = [
        ("1-URGENT", "2-HIGH"),
        ("2-HIGH", "3-MEDIUM"),
        ("3-MEDIUM", "1-URGENT"),
        ("5-LOW", "4-NOT SPECIFIED"),
    ]
    docs = ops.rewrite_pipelines(
        pipeline_docs(spark, sf_dir), source, target, "ws-0", pairs, shape=PIPELINE_SHAPE
    )
    # every new text is read once for all its values
    docs = docs.withColumn("tree", F.from_json("new_body", PIPELINE_SHAPE))
    copy, notebook = (F.get("tree.properties.activities", F.lit(i)) for i in (0, 1))
    linked = copy["typeProperties"]["sink"]["linkedService"]["properties"]["typeProperties"]
    values = {
        "artifact": linked["artifactId"],
        "workspace": linked["workspaceId"],
        "endpoint": linked["endpoint"],
        "notebook": notebook["typeProperties"]["notebookId"],
        "notebook_workspace": notebook["typeProperties"]["workspaceId"],
        "connection": copy["externalReferences"]["connection"],
    }
    return docs.select(
        "doc_id",
        *[value.alias(name) for name, value in values.items()],
        "changed",
        F.size("unresolved").cast("bigint").alias("n_unresolved"),
    )


REWRITE_SQL = """
    WITH d AS (
      SELECT o.*, CASE o_orderstatus WHEN 'F' THEN 'Lakehouse' WHEN 'O' THEN 'Warehouse' END AS kind,
             o_custkey % 3 AS ws, s.c_nationkey <> 4 AS sink_known, n.c_nationkey <> 4 AS nb_known
      FROM orders o
      LEFT JOIN customer s ON s.c_custkey = o_custkey
      LEFT JOIN customer n ON n.c_custkey = o_orderkey % 100),
    e AS (
      SELECT *, kind IS NOT NULL AND ws <> 0 AS wanted,
             kind IS NOT NULL AND ws <> 0 AND coalesce(sink_known, false) AS sink_moves,
             coalesce(nb_known, false) AS nb_moves,
             CASE o_orderpriority WHEN '2-HIGH' THEN '1-URGENT' WHEN '3-MEDIUM' THEN '1-URGENT'
                                  WHEN '5-LOW' THEN '4-NOT SPECIFIED'
                                  ELSE o_orderpriority END AS connection
      FROM d)
    SELECT o_orderkey AS doc_id,
           CASE WHEN sink_moves THEN kind || '-' || o_custkey ELSE 'item-' || o_custkey END AS artifact,
           CASE WHEN sink_moves THEN 'ws-0' ELSE 'ws-' || ws END AS workspace,
           CASE WHEN sink_moves AND kind = 'Warehouse' THEN 'endpoint-' || o_custkey
                ELSE 'old-endpoint' END AS endpoint,
           CASE WHEN nb_moves THEN 'Notebook-' || (o_orderkey % 100)
                ELSE 'item-' || (o_orderkey % 100) END AS notebook,
           CASE WHEN nb_moves THEN 'ws-0' ELSE 'ws-1' END AS notebook_workspace,
           connection,
           sink_moves OR nb_moves OR connection <> o_orderpriority AS changed,
           CAST(wanted AND NOT sink_moves AS BIGINT) + CAST(NOT nb_moves AS BIGINT) AS n_unresolved
    FROM e
    """


@query("r06_rewrite", REWRITE_SQL)
def r06_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir)


@query(
    "r07_array",
    """
    SELECT l_orderkey, l_linenumber,
           len(list_filter([l_suppkey, l_partkey % 7, l_linenumber], lambda x: x <> 5)) > 0 AS updated,
           len([l_suppkey, l_partkey % 7, l_linenumber]) AS n_refs,
           CAST(list_sum(list_transform([l_suppkey, l_partkey % 7, l_linenumber], lambda x: 5)) AS BIGINT) AS sum_new_refs
    FROM lineitem
    """,
)
def r07_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [F.col("l_suppkey"), F.col("l_partkey") % 7, F.col("l_linenumber")]
    entries = F.array(*[F.struct(i.cast("bigint").alias("id")) for i in ids])
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", entries.alias("refs")
    )
    total = F.aggregate("refs", F.lit(0).cast("bigint"), lambda acc, e: acc + e["id"])
    return ops.rewrite_array(lines, "refs", F.lit(5).cast("bigint")).select(
        "l_orderkey",
        "l_linenumber",
        "updated",
        F.size("refs").cast("bigint").alias("n_refs"),
        total.alias("sum_new_refs"),
    )


@query(
    "r07_notebooks",
    """
    WITH d AS (
      SELECT c_custkey, c_custkey % 3 AS ws, l.s_suppkey AS lh, w.s_suppkey AS wh, c_nationkey
      FROM customer
      LEFT JOIN supplier l ON l.s_suppkey = c_custkey % 200
      LEFT JOIN supplier w ON w.s_suppkey = c_nationkey)
    SELECT c_custkey AS doc_id,
           CASE WHEN lh IS NOT NULL AND ws <> 0 THEN 'lh-' || lh ELSE 'old-lh' END AS lakehouse,
           CASE WHEN lh IS NOT NULL THEN 'ws-0' ELSE 'ws-' || ws END AS workspace,
           CASE WHEN lh IS NOT NULL THEN 'lh-' || lh ELSE 'old-lh' END AS known_0,
           CASE WHEN lh IS NOT NULL THEN 'lh-' || lh ELSE 'lh-0' END AS known_1,
           CASE WHEN wh IS NOT NULL THEN 'wh-' || wh ELSE 'old-wh-' || c_nationkey END AS warehouse,
           CASE WHEN wh IS NOT NULL THEN 'wh-' || wh ELSE 'old-wh-' || c_nationkey END AS known_wh_0,
           'other' AS known_wh_1,
           lh IS NOT NULL OR wh IS NOT NULL AS changed
    FROM d
    """,
)
def r07_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old_warehouse = _text("old-wh-", F.col("c_nationkey"))
    known = [F.lit("old-lh"), F.lit("lh-0")]
    lakehouse = F.struct(
        F.lit("old-lh").alias("default_lakehouse"),
        F.format_string("Supplier#%09d", F.col("c_custkey") % 200).alias("default_lakehouse_name"),
        _text("ws-", F.col("c_custkey") % 3).alias("default_lakehouse_workspace_id"),
        F.array(*[F.struct(k.alias("id")) for k in known]).alias("known_lakehouses"),
    )
    warehouse = F.struct(
        old_warehouse.alias("default_warehouse"),
        F.array(
            F.struct(old_warehouse.alias("id")), F.struct(F.lit("other").alias("id"))
        ).alias("known_warehouses"),
    )
    dependencies = F.struct(lakehouse.alias("lakehouse"), warehouse.alias("warehouse"))
    body = F.to_json(F.struct(F.struct(dependencies.alias("dependencies")).alias("metadata")))
    docs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), body.alias("body")
    )
    suppliers = table(spark, sf_dir, "supplier")
    name = F.col("s_name").alias("display_name")
    source = suppliers.select(_text("old-wh-", F.col("s_suppkey")).alias("id"), name)
    target = suppliers.select(
        _text("lh-", F.col("s_suppkey")).alias("id"), name, F.lit("Lakehouse").alias("type")
    ).unionByName(
        suppliers.select(
            _text("wh-", F.col("s_suppkey")).alias("id"), name, F.lit("Warehouse").alias("type")
        )
    )
    paths = {
        "lakehouse": "lakehouse.default_lakehouse",
        "workspace": "lakehouse.default_lakehouse_workspace_id",
        "known_0": "lakehouse.known_lakehouses[0].id",
        "known_1": "lakehouse.known_lakehouses[1].id",
        "warehouse": "warehouse.default_warehouse",
        "known_wh_0": "warehouse.known_warehouses[0].id",
        "known_wh_1": "warehouse.known_warehouses[1].id",
    }
    return ops.repair_notebooks(docs, source, target, "ws-0").select(
        "doc_id",
        *[
            F.get_json_object("new_body", f"$.metadata.dependencies.{path}").alias(alias)
            for alias, path in paths.items()
        ],
        "changed",
    )


@query(
    "r07_notebook_errors",
    """
    SELECT c_custkey AS doc_id, c_custkey % 4 = 1 AS changed,
           CASE WHEN c_custkey % 4 >= 2 THEN 'JSONDecodeError' END AS error,
           CASE WHEN c_custkey % 4 = 0 THEN 'Lakehouse:nobody' ELSE '' END AS unresolved
    FROM customer
    """,
)
def r07_notebook_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks without a counterpart, with text behind their end, and cut off."""
    form = F.col("c_custkey") % 4
    known = F.format_string("Supplier#%09d", F.col("c_custkey") % 10 + 1)
    name = F.when(form == 0, F.lit("nobody")).otherwise(known)
    lakehouse = F.struct(
        F.lit("old-lh").alias("default_lakehouse"),
        name.alias("default_lakehouse_name"),
        F.lit("ws-1").alias("default_lakehouse_workspace_id"),
    )
    dependencies = F.struct(lakehouse.alias("lakehouse"))
    body = F.to_json(F.struct(F.struct(dependencies.alias("dependencies")).alias("metadata")))
    broken = F.when(form == 2, _text(body, " and more")).when(
        form == 3, F.substring(body, 1, F.length(body) - 2)
    )
    docs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.coalesce(broken, body).alias("body")
    )
    target = table(spark, sf_dir, "supplier").select(
        _text("lh-", F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("display_name"),
        F.lit("Lakehouse").alias("type"),
    )
    repaired = ops.repair_notebooks(docs, target.where("false"), target, "ws-0")
    return repaired.select(
        "doc_id", "changed", "error", F.array_join("unresolved", ",").alias("unresolved")
    )


@query(
    "r09_swap",
    """
    SELECT event_id, CASE WHEN x2 = 'purchase' THEN 'click' ELSE x2 END AS swapped
    FROM (SELECT event_id, CASE WHEN x1 = 'view' THEN 'purchase' ELSE x1 END AS x2
          FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS x1
                FROM events))
    """,
)
def r09_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("swapped"))
    return ops.swap(
        events, "swapped", [("click", "view"), ("view", "purchase"), ("purchase", "click")]
    )


@query(
    "r09_swap_long",
    """
    SELECT o_orderkey, CASE WHEN o_custkey < 60 THEN '60' ELSE CAST(o_custkey AS VARCHAR) END AS swapped
    FROM orders
    """,
)
def r09_swap_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("swapped")
    )
    return ops.swap(orders, "swapped", [(str(i), str(i + 1)) for i in range(60)])


@query(
    "r09_swap_short",
    """
    SELECT o_orderkey, CASE WHEN o_custkey < 20 THEN '20' ELSE CAST(o_custkey AS VARCHAR) END AS swapped
    FROM orders
    """,
)
def r09_swap_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("swapped")
    )
    return ops.swap(orders, "swapped", [(str(i), str(i + 1)) for i in range(20)])


@query(
    "r09_swap_by_name",
    """
    SELECT l_orderkey, l_linenumber,
           md5(CAST(CASE l_suppkey WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 5 THEN 6
                                   ELSE l_suppkey END AS VARCHAR)) AS connection
    FROM lineitem
    """,
)
def r09_swap_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(key: Column) -> Column:
        return F.md5(key.cast("string").cast("binary"))

    connections = table(spark, sf_dir, "supplier").select(
        digest(F.col("s_suppkey")).alias("connection_id"), F.col("s_name").alias("connection_name")
    )
    named = [f"Supplier#{number:09d}" for number in (1, 2, 3, 5, 6)]
    one, two, three, five, six = named
    pairs = ops.resolve_pairs([(one, two), (two, three), (five, six)], connections)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", digest(F.col("l_suppkey")).alias("connection")
    )
    return ops.swap(lines, "connection", pairs)


@query(
    "r13_package",
    """
    SELECT conv_id, turn, base64(encode(replace(text, 'the', 'THE'))) AS payload,
           '{"definition":{"parts":[{"path":"pipeline-content.json","payload":"'
           || base64(encode(replace(text, 'the', 'THE')))
           || '","payloadType":"InlineBase64"}]}}' AS request
    FROM conversations WHERE replace(text, 'the', 'THE') <> text
    """,
)
def r13_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    changed = turns.withColumn("new_text", F.replace("text", F.lit("the"), F.lit("THE")))
    packed = ops.package(changed, "text", "new_text", request="request")
    return packed.select("conv_id", "turn", "payload", "request")


# --- runs -----------------------------------------------------------------


@query(
    "r14_status",
    """
    SELECT user_id, last_status,
           CASE WHEN last_status IN ('signup', 'view') THEN 'pending'
                WHEN last_status = 'error' THEN 'failed' ELSE 'succeeded' END AS outcome,
           CASE WHEN last_status = 'error' THEN message END AS failure
    FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_status,
                 arg_max(props, (ts, event_id)) AS message
          FROM events GROUP BY user_id)
    """,
)
def r14_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.final_status(
        table(spark, sf_dir, "events"),
        job="user_id",
        status="event_type",
        ts="ts",
        poll="event_id",
        pending=["signup", "view"],
        failed=["error"],
        message="props",
    )
