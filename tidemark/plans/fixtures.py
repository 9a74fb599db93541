"""The driver tables as the engine's inputs, in DataFrames and, for the oracles, as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "merchant_id, merchant_product_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small table is one row group, which one task reads,
    whatever a row then costs. A table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landing log: 100 changes a commit, versions that run ahead and fall back, deletes, reclassifies."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("pos"),
        F.expr("event_id div 100").alias("_commit_version"),
        (F.col("event_id") % 100).cast("int").alias("seq"),
        F.concat(F.lit("m_"), F.col("user_id") % 10).alias("merchant_id"),
        F.concat(F.lit("p"), "user_id").alias("merchant_product_id"),
        F.expr("1 + event_id div 500 + (event_id * 7919) % 4").alias("source_version"),
        F.expr("CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'reclassify' ELSE 'upsert' END").alias("op"),
        F.expr("CASE WHEN event_type = 'error' THEN 'null' ELSE concat(event_type, event_id % 2) END").alias("content"),
        F.col("ts").cast("timestamp").alias("received_at"),
    ).withColumns({"hash": F.sha2("content", 256), "is_tombstone": F.col("op") == "delete", "submission_id": F.col("_commit_version").cast("string"), "change_index": F.col("seq")})


LANDED = """landed AS (
  SELECT *, sha256(content) AS hash, op = 'delete' AS is_tombstone, _commit_version::VARCHAR AS submission_id, seq AS change_index FROM (
    SELECT event_id AS pos, event_id // 100 AS _commit_version, (event_id % 100)::INT AS seq,
           concat('m_', user_id % 10) AS merchant_id, concat('p', user_id) AS merchant_product_id,
           1 + event_id // 500 + (event_id * 7919) % 4 AS source_version,
           CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'reclassify' ELSE 'upsert' END AS op,
           CASE WHEN event_type = 'error' THEN 'null' ELSE concat(event_type, event_id % 2) END AS content, ts AS received_at FROM events))"""

HALF = "half AS (SELECT (max(event_id) + 1) // 2 AS h FROM events)"


def fold_sql(source: str, name: str = "decided") -> str:
    """The fold of a common table's rows (with is_base) as a common table."""
    earlier = f"(PARTITION BY {KEY} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name} AS (
  SELECT *, CASE WHEN is_base THEN NULL WHEN NOT versioned THEN CASE WHEN dead THEN 'skipped' ELSE 'reclassified' END
                 WHEN applies THEN 'written' WHEN source_version < held THEN 'stale'
                 WHEN hash = holder_hash THEN 'already_applied' ELSE 'conflict' END AS outcome
  FROM (SELECT *, coalesce(last_value(CASE WHEN applies THEN is_tombstone END IGNORE NULLS) OVER {earlier}, TRUE) AS dead
        FROM (SELECT *, versioned AND (held IS NULL OR source_version > held) AS applies
              FROM (SELECT *, max(CASE WHEN versioned THEN source_version END) OVER {earlier} AS held,
                           first_value(hash) OVER (PARTITION BY {KEY}, source_version, versioned ORDER BY pos) AS holder_hash
                    FROM (SELECT *, op <> 'reclassify' AS versioned FROM {source})))))"""


ALL = f"{LANDED}, log AS (SELECT *, FALSE AS is_base FROM landed), {fold_sql('log')}"


def store_sql(source: str, name: str) -> str:
    """The store that a log's rows leave, from the first row of each key's greatest version."""
    return f"""{name} AS (
  SELECT {KEY}, source_version, hash, is_tombstone, content FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY source_version DESC, pos) AS nth FROM {source} WHERE op <> 'reclassify') WHERE nth = 1)"""


FIRST_HALF = f"{LANDED}, {HALF}, early AS (SELECT landed.* FROM landed, half WHERE pos < h), {store_sql('early', 'stored')}"
STORED = f"""{FIRST_HALF}, late AS (
  SELECT {KEY}, pos, source_version, op, hash, content, is_tombstone, FALSE AS is_base FROM landed, half WHERE pos >= h
  UNION ALL SELECT {KEY}, -1, source_version, 'stored', hash, content, is_tombstone, TRUE FROM stored), {fold_sql('late')}"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = landed(spark, sf_dir)
    half = log.agg(F.expr("(max(pos) + 1) div 2")).first()[0]
    return log.filter(F.col("pos") < half), log.filter(F.col("pos") >= half)


def event_log(spark: SparkSession, sf_dir: str, decided: DataFrame) -> DataFrame:
    """Accepted changes, their outcomes some ms later (none for some), and outcomes that a replay repeats."""
    base = decided.select("submission_id", "change_index", "merchant_id", "pos", "outcome", F.unix_millis("received_at").alias("t"))
    accepted = base.select("submission_id", "change_index", "merchant_id", F.lit("accepted").alias("type"), F.col("t").alias("ts"))
    first = base.filter("pos % 29 <> 0").select("submission_id", "change_index", "merchant_id", F.col("outcome").alias("type"), (F.col("t") + F.col("pos") % 97).alias("ts"))
    again = base.filter("pos % 13 = 0").select("submission_id", "change_index", "merchant_id", F.when(F.col("outcome") == "written", "already_applied").otherwise("stale").alias("type"), (F.col("t") + 1000).alias("ts"))
    return accepted.unionByName(first).unionByName(again)


EVENT_LOG = f"""{ALL}, event_log AS (
  SELECT submission_id, change_index, merchant_id, 'accepted' AS type, (epoch_us(received_at) // 1000) AS ts FROM decided
  UNION ALL SELECT submission_id, change_index, merchant_id, outcome, (epoch_us(received_at) // 1000) + pos % 97 FROM decided WHERE pos % 29 <> 0
  UNION ALL SELECT submission_id, change_index, merchant_id, CASE WHEN outcome = 'written' THEN 'already_applied' ELSE 'stale' END, (epoch_us(received_at) // 1000) + 1000 FROM decided WHERE pos % 13 = 0)"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, classify, append_retry and refused events."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp")))
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'batch' WHEN 'view' THEN 'classify' WHEN 'click' THEN 'append_retry' WHEN 'error' THEN 'refused' END")
    return e.select(
        kind.alias("type"), "ts", (F.col("k") * 3 + 1).alias("ms"), (F.col("k") + 1).alias("listings"), (F.col("user_id") % 4).cast("int").alias("worker"),
        F.concat(F.lit("r"), F.col("event_id") % 3).alias("reason"), F.expr("event_id div 100").alias("head"),
        F.create_map((F.col("user_id") % 8).cast("string"), F.array(F.expr("event_id div 100"), F.col("event_id") % 100)).alias("next"),
    ).filter("type is not null")


DIAGNOSTICS = """diagnostics AS (SELECT * FROM (
  SELECT CASE event_type WHEN 'purchase' THEN 'batch' WHEN 'view' THEN 'classify' WHEN 'click' THEN 'append_retry' WHEN 'error' THEN 'refused' END AS type,
         (epoch_us(ts) // 1000) AS ts, k * 3 + 1 AS ms, k + 1 AS listings, (user_id % 4)::INT AS worker, concat('r', event_id % 3) AS reason,
         event_id // 100 AS head, (user_id % 8)::INT AS partition, event_id // 100 AS commit_at, event_id
  FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events)) WHERE type IS NOT NULL),
win AS (SELECT (min((epoch_us(ts) // 1000)) + max((epoch_us(ts) // 1000))) // 2 AS since, max((epoch_us(ts) // 1000)) + 1 AS now FROM events)"""


def window(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    low, high = table(spark, sf_dir, "events").agg(F.min(t), F.max(t)).first()
    return (low + high) // 2, high + 1


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as merchants' changes, some of them wrong."""
    o = spread(table(spark, sf_dir, "orders"))
    k = F.col("o_orderkey")
    content = F.struct(
        F.when(k % 29 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"),
        F.concat(F.lit("order "), k).alias("description"),
        F.when(k % 31 == 0, 0).otherwise(F.round(F.col("o_totalprice") * 100).cast("long") * 10000).alias("price_micros"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'USD' WHEN 'F' THEN 'EUR' ELSE 'usd' END").alias("currency"),
        F.when(k % 37 == 0, "gone").otherwise("in_stock").alias("availability"),
        F.create_map(F.lit("size"), F.concat(F.lit("x"), k % 7), F.lit("color"), F.concat(F.lit("é\"\\/"), k % 3)).alias("attributes"),
    )
    op = F.expr("CASE WHEN o_orderkey % 23 = 0 THEN 'remove' WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.expr("concat('m_', o_custkey % 10)").alias("merchant_id"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN concat(' ', o_orderkey) WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('p', o_orderkey) END").alias("merchant_product_id"),
        F.expr("CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN o_orderkey % 19 = 0 THEN 4102444800001 ELSE o_custkey END").cast("long").alias("source_version"),
        op.alias("op"),
        F.when(op == "upsert", content).alias("listing"),
    )


NOW_MS = 4102444800000 - 24 * 60 * 60 * 1000

LISTINGS = """listings AS (
  SELECT o_orderkey AS id, concat('m_', o_custkey % 10) AS merchant_id,
         CASE WHEN o_orderkey % 11 = 0 THEN concat(' ', o_orderkey) WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('p', o_orderkey) END AS merchant_product_id,
         CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN o_orderkey % 19 = 0 THEN 4102444800001 ELSE o_custkey END AS source_version,
         CASE WHEN o_orderkey % 23 = 0 THEN 'remove' WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op,
         CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE o_orderpriority END AS title, concat('order ', o_orderkey) AS description,
         CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE round(o_totalprice * 100)::BIGINT * 10000 END AS price_micros,
         CASE o_orderstatus WHEN 'O' THEN 'USD' WHEN 'F' THEN 'EUR' ELSE 'usd' END AS currency,
         CASE WHEN o_orderkey % 37 = 0 THEN 'gone' ELSE 'in_stock' END AS availability,
         concat('x', o_orderkey % 7) AS size, concat('é"\\/', o_orderkey % 3) AS color
  FROM orders)"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, index): id, vector, label as a path of three levels."""
    path = F.concat(F.lit("L"), F.col("label") % 2, F.lit(" > M"), F.col("label") % 5, F.lit(" > N"), F.col("label"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), path.alias("label"))
    return v.filter("id % 5 = 0"), v.filter("id % 5 <> 0")


VECTORS = """vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, concat('L', label % 2, ' > M', label % 5, ' > N', label) AS label FROM embeddings),
asked AS (SELECT * FROM vectors WHERE id % 5 = 0), held AS (SELECT * FROM vectors WHERE id % 5 <> 0)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw rows for a training set: n, title (the first line), description, category."""
    d = spread(table(spark, sf_dir, "documents"))
    title = F.when(F.col("doc_id") % 41 == 0, F.lit(None)).otherwise(F.trim(F.split("text", "\n")[0]))
    category = F.expr("CASE WHEN doc_id % 43 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN concat('Old > S', doc_id % 5, ' > T > U') WHEN doc_id % 11 = 0 THEN 'Lost > X' ELSE concat('New > S', doc_id % 5, ' > T') END")
    return d.select(F.col("doc_id").alias("n"), title.alias("title"), F.col("text").alias("description"), category.alias("category"), F.col("source").alias("origin"))


CANDIDATES = """candidates AS (
  SELECT doc_id AS n, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE trim(string_split(text, chr(10))[1], ' ') END AS title, text AS description, source AS origin,
         CASE WHEN doc_id % 43 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN concat('Old > S', doc_id % 5, ' > T > U') WHEN doc_id % 11 = 0 THEN 'Lost > X' ELSE concat('New > S', doc_id % 5, ' > T') END AS category
  FROM documents)"""


def category_paths(spark: SparkSession) -> DataFrame:
    """A small taxonomy: New > S0 .. S3 > T, with their parents."""
    paths = ["New", *(f"New > S{i}" for i in range(4)), *(f"New > S{i} > T" for i in range(4))]
    return spark.createDataFrame([(p,) for p in paths], "path string")


def renames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Old", "New"), ("Old > S3", "New > S2"), ("Old > S3 > T", "New > S1 > T")], "old string, new string")


PATHS = """paths AS (SELECT 'New' AS path UNION ALL SELECT concat('New > S', i) FROM range(4) t(i) UNION ALL SELECT concat('New > S', i, ' > T') FROM range(4) t(i)),
renames AS (SELECT * FROM (VALUES ('Old', 'New'), ('Old > S3', 'New > S2'), ('Old > S3 > T', 'New > S1 > T')) AS t(old, new))"""


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" > ", "p_type", name[1], name[0]).alias("path"))


PART_PATHS = "part_paths AS (SELECT p_partkey AS id, concat(p_type, ' > ', split_part(p_name, ' ', 2), ' > ', split_part(p_name, ' ', 1)) AS path FROM part)"
