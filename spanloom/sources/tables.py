"""Adapters: relational tables as span events.

Each adapter is SQL that Spark and DuckDB both run, apart from the few expressions filled in per
engine; logs and attributes are scalar there and become an array and a map on the Spark side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SPARK = {"days": "CAST(datediff(CAST({0} AS DATE), DATE '1970-01-01') AS BIGINT)"}
DUCKDB = {"days": "CAST(date_diff('day', DATE '1970-01-01', CAST({0} AS DATE)) AS BIGINT)"}

#: Rows of an order line are the events of a span; the order is the trace, its customer the session, the region the tenant.
EVENTS = """
SELECT trace_id, span_id, ts, seq, CASE WHEN seq = 1 THEN 1 WHEN seq = n AND l_linestatus = 'F' THEN 2 ELSE 3 END AS event_type,
  CAST(trace_id AS VARCHAR(20)) || '-' || CAST(span_id AS VARCHAR(20)) AS ext_span_id,
  CASE WHEN span_id > 1 THEN span_id // 2 END AS parent_span_id,
  session_id, tenant_id,
  CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS status,
  CASE WHEN l_tax > 0.01 THEN quantity * 1000003 END AS duration_ns,
  CASE WHEN l_partkey % 3 > 0 THEN quantity END AS input_tokens,
  CASE WHEN l_partkey % 3 > 0 THEN price END AS output_tokens,
  CASE WHEN l_suppkey % 4 = 0 THEN quantity % 7 END AS cache_read_tokens,
  CASE WHEN l_suppkey % 5 = 0 THEN quantity % 3 END AS cache_write_tokens,
  'order-' || CAST(trace_id AS VARCHAR(20)) AS external_trace_id,
  CASE WHEN l_partkey % 4 = 0 THEN 'tool-' || CAST(l_suppkey % 6 AS VARCHAR(20)) END AS tool_name,
  CASE WHEN l_partkey % 3 > 0 THEN 'model-' || CAST(l_suppkey % 3 AS VARCHAR(20)) END AS model,
  CASE WHEN span_id % 5 > 0 THEN agent END AS agent_name,
  CASE WHEN seq = 1 AND span_id < 4 THEN 'ask ' || agent || ' about part ' || CAST(l_partkey AS VARCHAR(20)) END AS input_text,
  CASE WHEN l_linestatus = 'F' THEN 'part ' || CAST(l_partkey AS VARCHAR(20)) || CASE l_returnflag WHEN 'R' THEN ' refused' ELSE ' shipped' END END AS output_text,
  CASE WHEN l_partkey % 5 = 0 THEN 'log ' || CAST(l_suppkey % 9 AS VARCHAR(20)) END AS log,
  CASE WHEN trace_id % 3 > 0 THEN '"loop-' || CAST(trace_id % 50 AS VARCHAR(20)) || '"' END AS loop_id,
  CASE WHEN span_id = 1 THEN '"task-' || CAST(session_id % 20 AS VARCHAR(20)) || '"' END AS task_fingerprint,
  CASE WHEN l_partkey % 7 = 0 THEN CASE l_returnflag WHEN 'R' THEN '"fail"' ELSE '"pass"' END END AS validation_status
FROM (
  SELECT l.*, l_orderkey AS trace_id, CAST(l_linenumber AS BIGINT) AS span_id, o_custkey AS session_id, CAST(n_regionkey AS BIGINT) AS tenant_id,
    c_mktsegment AS agent, CAST(l_quantity AS BIGINT) AS quantity, CAST(floor(l_extendedprice) AS BIGINT) AS price,
    {days} * 86400000000000 AS ts,
    CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT) AS seq,
    count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
) x
"""

#: A message is a span of its conversation's session; a user message opens a turn, which is a trace.
CHAT = """
SELECT conv_id AS session_id, conv_id * 1000 + sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS trace_id,
  turn AS span_id, role, CASE WHEN role = 'user' THEN text END AS input_text, CASE WHEN role = 'assistant' THEN text END AS output_text
FROM conversations
"""

ATTRS = ("loop_id", "task_fingerprint", "validation_status")
_JOINS = "FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
#: Stored bytes of lines, some 150,000 of them, that one task numbers and folds.
PART_BYTES = 2 << 20
#: How many times as much a part holds before there are more parts than a shuffle writes without holding a task's rows in memory.
PART_GROWTH = 12


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def for_duckdb(sql: str) -> str:
    return sql.replace("{days}", DUCKDB["days"].format("l_shipdate"))


def for_spark(sql: str) -> str:
    """Orders meet their customers before the lines do, so that lines are dealt once, by their order."""
    assert _JOINS in sql
    sql = sql.replace(_JOINS, "FROM lineitem l JOIN buyers ON l_orderkey = bought").replace("SELECT l.*, l_orderkey", "SELECT /*+ SHUFFLE_HASH(buyers) */ l.*, l_orderkey")
    return sql.replace("{days}", SPARK["days"].format("l_shipdate")).replace("span_id // 2", "span_id DIV 2")


def _parts(lines: DataFrame) -> int:
    """Parts that grow with the stored lines, so that a task's rows do not.

    Up to a number of parts (200 unless configured), a task that deals rows writes them to their parts at once; for more
    parts it keeps all rows of its split in memory, to sort them.  So at that number parts grow first, up to PART_GROWTH times.
    """
    context = lines.sparkSession.sparkContext
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    direct = int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(context.defaultParallelism, min(direct, -(-size // PART_BYTES)), -(-size // (PART_BYTES * PART_GROWTH)))


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts of the order lines, also for what is shuffled of them again."""
    return _parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span events of the order lines."""
    _views(spark, sf_dir, "orders", "customer", "nation")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = _parts(lines)
    # dealt by trace once: numbering events, folding them and rolling spans up by trace need no other shuffle
    lines.repartition(parts, "l_orderkey").createOrReplaceTempView("lineitem")
    # customers are hashed: sorting the orders would hold more of them in a task the more there are
    buyers = spark.sql("SELECT /*+ SHUFFLE_HASH(customer) */ o_orderkey, o_custkey, c_mktsegment, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
    # renamed: where both sides of a join are nothing but shuffles, Spark raises their parts to spark.sql.shuffle.partitions
    buyers.repartition(parts, "o_orderkey").withColumnRenamed("o_orderkey", "bought").createOrReplaceTempView("buyers")
    flat = spark.sql(for_spark(EVENTS))
    entries = F.filter(F.array(*[F.struct(F.lit(a).alias("key"), F.col(a).alias("value")) for a in ATTRS]), lambda e: e["value"].isNotNull())
    return flat.withColumns(
        {
            "logs": F.when(F.col("log").isNotNull(), F.array("log")),
            "attrs": F.map_from_entries(entries),
            "_arrival": F.col("seq"),
        }
    ).drop("log", *ATTRS)


def chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "conversations")
    return spark.sql(CHAT)
