"""Every query of the engine over the driver tables, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import curate, envelope, evaluate, feed, fold, knn, metrics, retention, status, taxonomy
from tidemark.plans import fixtures as X
from tidemark.schemas import KEYS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K = X.KEY


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _r(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


# --- fold --------------------------------------------------------------------------------------------


@query(f"WITH {X.ALL} SELECT pos, {K}, outcome FROM decided")
def fold_outcomes(spark, d):
    return fold.decided(X.landed(spark, d)).select("pos", *KEYS, "outcome")


@query(f"WITH {X.STORED} SELECT pos, {K}, outcome FROM decided WHERE NOT is_base")
def fold_outcomes_with_stored(spark, d):
    early, late = X.halves(spark, d)
    return fold.decided(late, fold.expected_store(early, "content")).select("pos", *KEYS, "outcome")


@query(f"WITH {X.ALL} SELECT outcome, count(*) AS changes, min(pos) AS first FROM decided WHERE op = 'reclassify' GROUP BY outcome")
def fold_reclassify(spark, d):
    rows = fold.decided(X.landed(spark, d)).filter("op = 'reclassify'")
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("changes"), F.min("pos").alias("first"))


@query(f"WITH {X.ALL} SELECT outcome, count(*) AS changes FROM decided GROUP BY outcome")
def outcome_counts(spark, d):
    return fold.decided(X.landed(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("changes"))


@query(f"WITH {X.LANDED}, {X.store_sql('landed', 'store')} SELECT {K}, source_version, hash, is_tombstone FROM store")
def expected_store(spark, d):
    return fold.expected_store(X.landed(spark, d))


def _stored(early: DataFrame) -> DataFrame:
    """The first half's store with what a classifier would have said."""
    rows = fold.expected_store(early, "content").withColumnRenamed("content", "view")
    n = F.expr("cast(substring(merchant_product_id, 2) as int)")
    return rows.withColumns({"primary_category": F.when(~F.col("is_tombstone"), F.concat(F.lit("C"), n % 3)), "taxonomy_version": F.when(n % 4 == 0, "t-1").otherwise("t-2"), "needs_reclassify": n % 6 == 0})


_WRITES = f"""{X.STORED}, base AS (
  SELECT {K}, is_tombstone AS base_dead, content AS base_view, CASE WHEN NOT is_tombstone THEN concat('C', n % 3) END AS cat,
         CASE WHEN n % 4 = 0 THEN 't-1' ELSE 't-2' END AS tax, n % 6 = 0 AS flag
  FROM (SELECT *, substr(merchant_product_id, 2)::INT AS n FROM stored)),
touched AS (SELECT {K}, min(pos) AS first_touch, bool_or(outcome = 'reclassified') AS asked FROM decided WHERE outcome IN ('written', 'reclassified') GROUP BY ALL),
final AS (SELECT * FROM (SELECT {K}, source_version, hash, is_tombstone, content AS view, row_number() OVER (PARTITION BY {K} ORDER BY source_version DESC, pos) AS nth FROM decided WHERE applies) WHERE nth = 1),
written AS (
  SELECT f.*, first_touch, cat, coalesce(NOT base_dead AND base_view IS NOT DISTINCT FROM view, FALSE) AS same, asked,
         coalesce(cat IS NOT NULL AND NOT flag AND tax = 't-2', FALSE) AS answered
  FROM final f JOIN touched USING ({K}) LEFT JOIN base USING ({K}))"""


@query(f"""WITH {_WRITES} SELECT {K}, first_touch, source_version, hash, is_tombstone, view,
  NOT is_tombstone AND (asked OR NOT same OR NOT answered) AS needs_classify,
  CASE WHEN same AND NOT is_tombstone THEN cat END AS fallback_primary_category FROM written""")
def store_writes(spark, d):
    early, late = X.halves(spark, d)
    rows = fold.writes(late.withColumnRenamed("content", "view"), _stored(early), "t-2")
    return rows.select(*KEYS, "first_touch", "source_version", "hash", "is_tombstone", "view", "needs_classify", "fallback_primary_category")


@query(f"WITH {_WRITES} SELECT NOT is_tombstone AND (asked OR NOT same OR NOT answered) AS needs_classify, is_tombstone, count(*) AS writes FROM written GROUP BY ALL")
def needs_classify(spark, d):
    early, late = X.halves(spark, d)
    rows = fold.writes(late.withColumnRenamed("content", "view"), _stored(early), "t-2")
    return rows.groupBy("needs_classify", "is_tombstone").agg(F.count(F.lit(1)).alias("writes"))


# --- merge, feed, export ----------------------------------------------------------------------------


def _store(rows: DataFrame) -> DataFrame:
    return fold.expected_store(rows).withColumnRenamed("hash", "content_hash")


_MERGED = f"""{X.FIRST_HALF}, late AS (SELECT landed.* FROM landed, half WHERE pos >= h), {X.store_sql('late', 'source')},
joined AS (SELECT coalesce(s.merchant_id, t.merchant_id) AS merchant_id, coalesce(s.merchant_product_id, t.merchant_product_id) AS merchant_product_id,
  s.source_version AS sv, s.hash AS sh, s.is_tombstone AS sd, t.source_version AS tv, t.hash AS th, t.is_tombstone AS td,
  CASE WHEN t.merchant_id IS NULL THEN 'insert' WHEN s.source_version > t.source_version OR (s.source_version = t.source_version AND s.hash = t.hash) THEN 'update' END AS change
  FROM stored t FULL JOIN source s ON t.merchant_id = s.merchant_id AND t.merchant_product_id = s.merchant_product_id)"""


@query(f"""WITH {_MERGED} SELECT {K}, CASE WHEN change IS NULL THEN tv ELSE sv END AS source_version,
  CASE WHEN change IS NULL THEN th ELSE sh END AS content_hash, CASE WHEN change IS NULL THEN td ELSE sd END AS is_tombstone FROM joined""")
def conditional_merge(spark, d):
    early, late = X.halves(spark, d)
    return feed.merged(_store(early), _store(late))


@query(f"""WITH {_MERGED} SELECT {K}, sv AS source_version, sh AS content_hash, sd AS is_tombstone, CASE change WHEN 'insert' THEN 'insert' ELSE 'update_postimage' END AS _change_type, 1::BIGINT AS _commit_version FROM joined WHERE change IS NOT NULL
UNION ALL SELECT {K}, tv, th, td, 'update_preimage', 1 FROM joined WHERE change = 'update'""")
def merge_change_feed(spark, d):
    early, late = X.halves(spark, d)
    return feed.feed_rows(feed.merge(_store(early), _store(late), touched_only=True), 1)


_FEED = f"""{X.ALL}, per AS (
  SELECT {K}, _commit_version, source_version, hash, is_tombstone, row_number() OVER (PARTITION BY {K}, _commit_version ORDER BY pos DESC) AS nth
  FROM decided WHERE outcome = 'written'),
feed AS (SELECT *, lag(hash) OVER w AS p_hash, lag(source_version) OVER w AS p_version, lag(is_tombstone) OVER w AS p_dead FROM per WHERE nth = 1 WINDOW w AS (PARTITION BY {K} ORDER BY _commit_version))"""


def _feed(spark, d) -> DataFrame:
    return feed.log_feed(fold.decided(X.landed(spark, d)), "source_version", "hash", "is_tombstone")


@query(f"""WITH {_FEED} SELECT {K}, source_version, hash, is_tombstone, CASE WHEN p_hash IS NULL THEN 'insert' ELSE 'update_postimage' END AS _change_type, _commit_version FROM feed
UNION ALL SELECT {K}, p_version, p_hash, p_dead, 'update_preimage', _commit_version FROM feed WHERE p_hash IS NOT NULL""")
def log_change_feed(spark, d):
    return _feed(spark, d)


@query(f"""WITH {_FEED}, cut AS (SELECT max(_commit_version) // 2 AS c FROM landed)
SELECT {K}, source_version, hash, is_tombstone, CASE WHEN is_tombstone THEN 'delete' ELSE 'upsert' END AS op FROM (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY _commit_version DESC) AS r FROM feed, cut WHERE _commit_version >= c) WHERE r = 1""")
def collapse_feed(spark, d):
    rows = _feed(spark, d)
    cut = X.landed(spark, d).agg(F.expr("max(_commit_version) div 2")).first()[0]
    return feed.collapse(rows.filter(F.col("_commit_version") >= cut))


@query(f"""WITH {_FEED}, files AS (
  SELECT *, row_number() OVER (PARTITION BY {K}, _commit_version // 10 ORDER BY _commit_version DESC) AS r FROM feed)
SELECT _commit_version // 10 AS file, count(*) AS rows, sum(is_tombstone::INT)::BIGINT AS deletes FROM files WHERE r = 1 GROUP BY 1""")
def export_files(spark, d):
    rows = _feed(spark, d).withColumn("file", F.expr("_commit_version div 10"))
    return feed.collapse(rows, "file").groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("op") == "delete").alias("deletes"))


@query(f"WITH {X.LANDED}, {X.store_sql('landed', 'store')} SELECT {K}, source_version, hash, is_tombstone FROM store WHERE NOT is_tombstone")
def export_replay(spark, d):
    rows = _feed(spark, d).withColumn("file", F.expr("_commit_version div 10"))
    return feed.replayed(feed.collapse(rows, "file")).select(*KEYS, "source_version", "hash", "is_tombstone")


@query(f"WITH {X.LANDED}, {X.store_sql('landed', 'store')} SELECT {K}, source_version, hash, is_tombstone, CASE WHEN is_tombstone THEN 'delete' ELSE 'upsert' END AS op FROM store")
def full_export(spark, d):
    return feed.whole(fold.expected_store(X.landed(spark, d)))


@query(f"""WITH {X.FIRST_HALF}, {X.store_sql('landed', 'store')}
SELECT merchant_id, merchant_product_id, t.source_version AS was, s.source_version AS now FROM store s LEFT JOIN stored t USING ({K})
WHERE t.hash IS DISTINCT FROM s.hash OR t.source_version IS DISTINCT FROM s.source_version OR t.is_tombstone IS DISTINCT FROM s.is_tombstone""")
def oracle_diff(spark, d):
    early, _ = X.halves(spark, d)
    rows = feed.difference(fold.expected_store(early), fold.expected_store(X.landed(spark, d)), "source_version", "hash", "is_tombstone")
    return rows.select(*KEYS, F.col("expected.source_version").alias("was"), F.col("actual.source_version").alias("now"))


@query(f"""WITH {X.ALL}, cut AS (SELECT max(_commit_version) // 2 AS c FROM landed), early AS (SELECT landed.* FROM landed, cut WHERE _commit_version <= c), {X.store_sql('early', 'store')}
SELECT {K}, source_version, hash, is_tombstone FROM store""")
def store_rewind(spark, d):
    log = X.landed(spark, d)
    version = log.agg(F.expr("max(_commit_version) div 2")).first()[0]
    return feed.rewound(fold.expected_store(log), _feed(spark, d), version)


# --- keys, hashes, ids ------------------------------------------------------------------------------


@query(f"WITH {X.LANDED} SELECT DISTINCT {K}, (('0x' || substr(sha256(merchant_id || '/' || merchant_product_id), 9, 8))::BIGINT % 64)::INT AS partition FROM landed")
def partition_hash(spark, d):
    return X.landed(spark, d).select(*KEYS).distinct().withColumn("partition", C.partition_of("merchant_id", "merchant_product_id"))


@query(f"""WITH {X.LANDED}, p AS (SELECT (('0x' || substr(sha256(merchant_id || '/' || merchant_product_id), 9, 8))::BIGINT % 64)::INT AS partition, merchant_product_id FROM landed)
SELECT partition, count(*) AS changes, count(DISTINCT merchant_product_id) AS listings FROM p GROUP BY partition""")
def partition_skew(spark, d):
    rows = X.landed(spark, d).withColumn("partition", C.partition_of("merchant_id", "merchant_product_id"))
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("merchant_product_id").alias("listings"))


@query("""SELECT w.workers::INT AS workers, p.p::INT AS partition, (p.p * w.workers // 64)::INT AS owner, ceil((p.p * w.workers // 64) * 64.0 / w.workers)::INT AS first, ceil(((p.p * w.workers // 64) + 1) * 64.0 / w.workers)::INT AS after
FROM range(64) p(p), (SELECT n_nationkey + 1 AS workers FROM nation) w""")
def owner_blocks(spark, d):
    workers = X.table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("workers"))
    rows = workers.withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rows = rows.withColumn("owner", C.owner("partition", F.col("workers")))
    first, after = C.owned(F.col("owner"), F.col("workers"))
    return rows.select("workers", "partition", "owner", first.alias("first"), after.alias("after"))


_CANONICAL = """'{"attributes":{"color":' || to_json(color) || ',"size":' || to_json(size) || '},"availability":' || to_json(availability) || ',"currency":' || to_json(currency) || ',"description":' || to_json(description) || ',"price_micros":' || price_micros || ',"title":' || to_json(title) || '}'"""


@query(f"WITH {X.LISTINGS} SELECT id, sha256(CASE WHEN op = 'upsert' THEN {_CANONICAL} ELSE 'null' END) AS hash, CASE WHEN op = 'upsert' THEN '{{\"color\": ' || to_json(color) || ', \"size\": ' || to_json(size) || '}}' END AS attributes FROM listings")
def content_hash(spark, d):
    rows = X.listings(spark, d)
    return rows.select("id", C.content_hash(F.col("listing")).alias("hash"), C.attributes_text(F.col("listing.attributes")).alias("attributes"))


@query(f"""WITH {X.LANDED} SELECT pos, strftime(date_trunc('hour', received_at), '%Y-%m-%dT%H') AS hour, (epoch_us(received_at) // 1000) AS ms, 36 AS length, '7' AS version FROM landed""")
def uuid7_hour(spark, d):
    rows = X.landed(spark, d).withColumn("id", C.uuid7(F.unix_millis("received_at"), F.col("pos")))
    ms = C.uuid_ms(F.concat(F.lit("backfill-"), F.col("id")))
    return rows.select("pos", C.hour(ms).alias("hour"), ms.alias("ms"), F.length("id").alias("length"), F.substring("id", 15, 1).alias("version"))


# --- envelope ---------------------------------------------------------------------------------------

_ERRORS = f"""{X.LISTINGS}, checked AS (SELECT *, CASE
  WHEN op = 'remove' THEN ['change: op must be upsert or delete'] ELSE list_filter([
    CASE WHEN merchant_product_id = '' THEN 'merchant_product_id: String should have at least 1 character' WHEN merchant_product_id[1] = ' ' THEN 'merchant_product_id: must be printable, with no leading or trailing whitespace' END,
    CASE WHEN source_version <= 0 THEN 'source_version: Input should be greater than 0' END,
    CASE WHEN op = 'upsert' AND title = '' THEN 'listing.title: String should have at least 1 character' END,
    CASE WHEN op = 'upsert' AND price_micros <= 0 THEN 'listing.price_micros: Input should be greater than 0' END,
    CASE WHEN op = 'upsert' AND currency = 'usd' THEN 'listing.currency: String should match pattern ''^[A-Z]{{3}}$''' END,
    CASE WHEN op = 'upsert' AND availability = 'gone' THEN 'listing.availability: Input should be ''in_stock'', ''out_of_stock'' or ''preorder''' END
  ], lambda x: x IS NOT NULL) END AS structure,
  list_filter([CASE WHEN source_version > 4102444800000 THEN 'source_version: must not be more than 24 hours in the future' END,
    CASE WHEN op = 'upsert' AND currency <> 'USD' THEN 'listing.currency: must be USD, the merchant''s currency' END], lambda x: x IS NOT NULL) AS business FROM listings),
errors AS (SELECT *, CASE WHEN len(structure) > 0 THEN structure ELSE business END AS errors FROM checked)"""


def _checked(spark, d) -> DataFrame:
    return envelope.checked(X.listings(spark, d), F.lit("USD"), F.lit(X.NOW_MS).cast("long"))


@query(f"WITH {_ERRORS} SELECT id, array_to_string(errors, '; ') AS errors FROM errors WHERE len(errors) > 0")
def envelope_errors(spark, d):
    return _checked(spark, d).filter("not accepted").select("id", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {_ERRORS} SELECT op, len(errors) = 0 AS accepted, count(*) AS changes, sum(len(errors))::BIGINT AS errors FROM errors GROUP BY 1, 2")
def accepted_rejected(spark, d):
    return _checked(spark, d).groupBy("op", "accepted").agg(F.count(F.lit(1)).alias("changes"), F.sum(F.size("errors").cast("long")).alias("errors"))


@query(f"WITH {_ERRORS} SELECT (id // 100)::VARCHAR AS submission_id, id AS change_index, merchant_id, CASE WHEN len(errors) = 0 THEN 'accepted' ELSE 'rejected' END AS type FROM errors")
def submission_events(spark, d):
    rows = _checked(spark, d).withColumn("change_index", F.col("id"))
    return envelope.submission_events(rows, F.expr("cast(id div 100 as string)"))


# --- status and metrics -----------------------------------------------------------------------------

_RANK = "CASE type WHEN 'written' THEN 0 WHEN 'reclassified' THEN 1 WHEN 'already_applied' THEN 2 WHEN 'conflict' THEN 3 WHEN 'stale' THEN 4 WHEN 'skipped' THEN 5 WHEN 'failed' THEN 6 WHEN 'rejected' THEN 7 END"
_STATUS = f"{X.EVENT_LOG}, status AS (SELECT submission_id, change_index, any_value(merchant_id) AS merchant_id, coalesce(arg_min(type, {_RANK}), 'pending') AS outcome FROM event_log GROUP BY 1, 2)"


def _events(spark, d) -> DataFrame:
    return X.event_log(spark, d, fold.decided(X.landed(spark, d)))


@query(f"WITH {_STATUS} SELECT submission_id, change_index, merchant_id, outcome FROM status")
def submission_status(spark, d):
    return status.folded(_events(spark, d))


@query(f"""WITH {_STATUS} SELECT submission_id, count(*) AS changes, {', '.join(f"count_if(outcome = '{x}')::BIGINT AS {x}" for x in ('pending', 'written', 'reclassified', 'already_applied', 'conflict', 'stale', 'skipped', 'failed', 'rejected'))},
count_if(outcome = 'pending') = 0 AS done FROM status GROUP BY submission_id""")
def submission_counts(spark, d):
    return status.counts(status.folded(_events(spark, d)))


@query(f"WITH {X.LANDED} SELECT submission_id, change_index FROM landed WHERE pos % 29 = 0 AND pos % 13 <> 0")
def pending_changes(spark, d):
    found = _events(spark, d).filter("type <> 'accepted'").select("submission_id", "change_index")
    return status.unanswered(X.landed(spark, d), found).select("submission_id", "change_index")


_CHANGES = f"""{X.EVENT_LOG}, win AS (SELECT (min((epoch_us(ts) // 1000)) + max((epoch_us(ts) // 1000))) // 2 AS since FROM events),
a AS (SELECT submission_id AS s, change_index AS i, min(ts) AS accepted FROM event_log WHERE type = 'accepted' GROUP BY ALL),
o AS (SELECT submission_id AS s, change_index AS i, min(ts) AS first, arg_min(type, {_RANK}) AS best FROM event_log WHERE type <> 'accepted' GROUP BY ALL),
ch AS (SELECT o.*, accepted FROM o JOIN a USING (s, i), win WHERE first >= since)"""


@query(f"WITH {_CHANGES} SELECT count(*) AS changes, round(quantile_cont((first - accepted) / 1000, 0.5), 6) AS p50, round(quantile_cont((first - accepted) / 1000, 0.99), 6) AS p99 FROM ch")
def freshness(spark, d):
    return metrics.freshness(_events(spark, d), X.window(spark, d)[0]).select("changes", *_r("p50", "p99"))


@query(f"WITH {_CHANGES} SELECT count(*) AS changes, round(avg((best = 'stale')::INT), 6) AS stale, round(avg((best = 'conflict')::INT), 6) AS conflict, round(avg((best = 'failed')::INT), 6) AS failed FROM ch")
def outcome_rates(spark, d):
    return metrics.outcome_rates(_events(spark, d), X.window(spark, d)[0]).select("changes", *_r("stale", "conflict", "failed"))


@query(f"WITH {X.DIAGNOSTICS} SELECT count(*) AS calls, sum(listings)::BIGINT AS listings, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.99), 6) AS p99 FROM diagnostics, win WHERE type = 'classify' AND ts >= since")
def classify_latency(spark, d):
    return metrics.classify_latency(X.diagnostics(spark, d), X.window(spark, d)[0]).select("calls", "listings", *_r("p50", "p99"))


@query(f"WITH {X.DIAGNOSTICS} SELECT count(*) AS count, round(avg(ms), 6) AS mean_ms FROM diagnostics, win WHERE type = 'append_retry' AND ts >= since")
def append_retries(spark, d):
    return metrics.append_retries(X.diagnostics(spark, d), X.window(spark, d)[0]).select("count", *_r("mean_ms"))


@query(f"WITH {X.DIAGNOSTICS} SELECT partition, (SELECT max(head) FROM diagnostics WHERE type = 'batch') + 1 - arg_max(commit_at, ts) AS lag FROM diagnostics WHERE type = 'batch' GROUP BY partition")
def lag_commits(spark, d):
    return metrics.lag_commits(X.diagnostics(spark, d))


@query(f"WITH {X.DIAGNOSTICS} SELECT worker, round(sum(ms) / any_value(now - since), 6) AS utilization FROM diagnostics, win WHERE type = 'batch' AND ts >= since GROUP BY worker")
def utilization(spark, d):
    return metrics.utilization(X.diagnostics(spark, d), *X.window(spark, d))


@query(f"WITH {X.DIAGNOSTICS} SELECT reason, count(*) AS refused FROM diagnostics, win WHERE type = 'refused' AND ts >= since GROUP BY reason")
def refused(spark, d):
    return metrics.refused(X.diagnostics(spark, d), X.window(spark, d)[0])


_LIVE = f"""{X.LANDED}, {X.store_sql('landed', 'store0')}, store AS (SELECT *, CASE WHEN is_tombstone THEN NULL WHEN n % 5 = 0 THEN 'Uncategorized' ELSE concat('C', n % 3) END AS primary_category,
  n % 6 = 0 AS needs_reclassify, CASE WHEN n % 4 = 0 THEN 't-1' ELSE 't-2' END AS taxonomy_version FROM (SELECT *, substr(merchant_product_id, 2)::INT AS n FROM store0))"""


def _live(spark, d) -> DataFrame:
    rows = fold.expected_store(X.landed(spark, d), "received_at").withColumnRenamed("received_at", "updated_at")
    n = F.expr("cast(substring(merchant_product_id, 2) as int)")
    return rows.withColumns({"primary_category": F.when(~F.col("is_tombstone"), F.when(n % 5 == 0, "Uncategorized").otherwise(F.concat(F.lit("C"), n % 3))), "needs_reclassify": n % 6 == 0, "taxonomy_version": F.when(n % 4 == 0, "t-1").otherwise("t-2")})


@query(f"WITH {_LIVE} SELECT count(*) AS live, round(avg((primary_category = 'Uncategorized')::INT), 6) AS share FROM store WHERE NOT is_tombstone")
def uncategorized(spark, d):
    return metrics.uncategorized(_live(spark, d)).select("live", *_r("share"))


@query(f"WITH {_LIVE} SELECT count_if(needs_reclassify)::BIGINT AS flagged, count_if(NOT needs_reclassify AND taxonomy_version <> 't-2')::BIGINT AS outdated FROM store WHERE NOT is_tombstone")
def backlog(spark, d):
    return metrics.backlog(_live(spark, d), "t-2")


@query(f"""WITH {X.LANDED}, s AS (SELECT {K}, is_tombstone, received_at, substr(merchant_product_id, 2)::INT AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY source_version DESC, pos) AS nth FROM landed WHERE op <> 'reclassify') WHERE nth = 1)
SELECT {K}, epoch_us(received_at) AS updated FROM s WHERE NOT is_tombstone AND (n % 6 = 0 OR n % 4 = 0) ORDER BY received_at, {K} LIMIT 20""")
def backfill_pending(spark, d):
    return fold.pending(_live(spark, d), "t-2", 20).select(*KEYS, F.unix_micros("updated_at").alias("updated"))


@query(f"WITH {X.LANDED} SELECT _commit_version, seq, {K} FROM landed WHERE (_commit_version = 2 AND seq >= 37 OR _commit_version > 2) AND _commit_version < 102 ORDER BY _commit_version, seq LIMIT 1000")
def landing_batch_cut(spark, d):
    return fold.batch_cut(X.landed(spark, d), 2, 37, 1000).select("_commit_version", "seq", *KEYS)


@query(f"""WITH {X.LANDED}, p AS (SELECT *, (('0x' || substr(sha256(merchant_id || '/' || merchant_product_id), 9, 8))::BIGINT % 64)::INT AS partition FROM landed)
SELECT pos, partition, row_number() OVER (PARTITION BY partition ORDER BY received_at, submission_id, change_index)::INT AS nth FROM p""")
def replay_order(spark, d):
    rows = X.landed(spark, d).withColumn("partition", C.partition_of("merchant_id", "merchant_product_id"))
    return fold.replay_order(rows).select("pos", "partition", "nth")


@query("SELECT o_orderstatus AS status, count(*) AS requests, quantile_disc(o_totalprice, 0.5) AS p50_ms, quantile_disc(o_totalprice, 0.99) AS p99_ms, max(o_totalprice) AS max_ms FROM orders GROUP BY 1")
def load_summary(spark, d):
    rows = X.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("ms"))
    return metrics.load_summary(rows, "status")


@query(f"WITH {X.DIAGNOSTICS} SELECT type, count(*) AS events FROM diagnostics GROUP BY type")
def effects(spark, d):
    return metrics.effects(X.diagnostics(spark, d))


# --- vectors and evaluation -------------------------------------------------------------------------

_NEAR = f"""{X.VECTORS}, sims AS (SELECT q.id AS query_id, q.label AS truth, i.id, i.label, list_cosine_similarity(q.vector, i.vector) AS sim FROM asked q, held i),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS place FROM sims) WHERE place <= 10)"""
_VOTES = f"""{_NEAR}, votes AS (SELECT query_id, any_value(truth) AS truth, label, sum(greatest(sim, 0)) AS votes, max(sim) AS nearest FROM near GROUP BY query_id, label),
answers AS (SELECT query_id AS id, truth AS label, label AS category, CASE WHEN total > 0 THEN votes / total ELSE 0 END AS confidence FROM (
  SELECT *, sum(votes) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY round(votes, 9) DESC, round(nearest, 9) DESC, label DESC) AS r FROM votes) WHERE r = 1)"""
_GRID = ", grid AS (SELECT round(0.30 + 0.05 * i, 2)::DOUBLE AS t FROM range(13) x(i))"


def _answers(spark, d) -> DataFrame:
    asked, held = X.vectors(spark, d)
    votes = knn.vote(knn.nearest(asked, held, 10))
    return asked.select("id", "label").join(votes.select(F.col("query_id").alias("id"), F.col("label").alias("category"), "confidence"), "id")


@query(f"WITH {_NEAR} SELECT query_id, place::INT AS place, id, label, round(sim, 6) AS sim FROM near")
def nearest_rows(spark, d):
    return knn.nearest(*X.vectors(spark, d), 10).select("query_id", "place", "id", "label", *_r("sim"))


@query(f"WITH {_VOTES} SELECT id, category, round(confidence, 6) AS confidence FROM answers")
def knn_vote(spark, d):
    return _answers(spark, d).select("id", "category", *_r("confidence"))


_CENTROIDS = f"""{X.VECTORS}, normed AS (SELECT label, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS u FROM held),
parts AS (SELECT label, unnest(range(1, 65)) AS i, unnest(u) AS x FROM normed),
texts AS (SELECT label, list(m ORDER BY i) AS vector FROM (SELECT label, i, avg(x) AS m FROM parts GROUP BY 1, 2) GROUP BY label),
scores AS (SELECT q.id AS query_id, q.label AS truth, t.label, list_cosine_similarity(q.vector, t.vector) AS sim, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.vector, t.vector) DESC) AS place FROM asked q, texts t)"""


@query(f"WITH {_CENTROIDS} SELECT query_id, CASE WHEN sim >= 0.2 THEN label ELSE 'Uncategorized' END AS category, round(least(greatest(sim, 0), 1), 6) AS confidence FROM scores WHERE place = 1")
def nearest_text(spark, d):
    asked, held = X.vectors(spark, d)
    return knn.best_text(asked, knn.centroids(held), 0.2).select("query_id", "category", *_r("confidence"))


@query(f"WITH {_CENTROIDS} SELECT query_id, string_agg(label, '|' ORDER BY place) AS paths FROM scores WHERE place <= 5 GROUP BY query_id")
def shortlist_topk(spark, d):
    asked, held = X.vectors(spark, d)
    return knn.shortlist(asked, knn.centroids(held), 5).select("query_id", F.array_join("paths", "|").alias("paths"))


def _shortlists(spark, d, k: int) -> DataFrame:
    asked, held = X.vectors(spark, d)
    lists = knn.shortlist(asked, knn.centroids(held), k)
    return asked.select("id", "label").join(lists.withColumnRenamed("query_id", "id"), "id")


_CUT = "array_to_string(string_split({}, ' > ')[1:{}], ' > ')"


@query(f"""WITH {_CENTROIDS}, ks AS (SELECT * FROM (VALUES (1), (3), (5)) t(k)),
hits AS (SELECT k, query_id, bool_or(label = truth)::INT AS e, bool_or({_CUT.format('label', 2)} = {_CUT.format('truth', 2)})::INT AS l2, bool_or({_CUT.format('label', 1)} = {_CUT.format('truth', 1)})::INT AS l1 FROM scores, ks WHERE place <= k GROUP BY ALL)
SELECT k, round(avg(e), 6) AS exact, round(avg(l2), 6) AS level2, round(avg(l1), 6) AS level1 FROM hits GROUP BY k""")
def recall_at_k(spark, d):
    return evaluate.recall(_shortlists(spark, d, 5), [1, 3, 5]).select("k", *_r("exact", "level2", "level1"))


@query(f"""WITH {_VOTES}{_GRID} SELECT t AS threshold, round(count_if(kept AND category = label) / count(*), 6) AS accuracy, round(count_if(kept AND category = label) / nullif(count_if(kept), 0), 6) AS precision,
round(1 - count_if(kept) / count(*), 6) AS uncategorized, round(count_if(kept AND {_CUT.format('category', 1)} = {_CUT.format('label', 1)}) / count(*), 6) AS level1, round(count_if(kept AND {_CUT.format('category', 2)} = {_CUT.format('label', 2)}) / count(*), 6) AS level2
FROM (SELECT *, confidence >= t AS kept FROM answers, grid) GROUP BY t""")
def threshold_sweep(spark, d):
    return evaluate.score(_answers(spark, d)).select("threshold", *_r("accuracy", "precision", "uncategorized", "level1", "level2"))


@query(f"WITH {_VOTES} SELECT id, CASE WHEN confidence >= 0.35 THEN category ELSE concat('F', id % 3) END AS label, confidence >= 0.35 AS kept FROM answers")
def cascade(spark, d):
    answers = _answers(spark, d).select("id", F.col("category").alias("label"), "confidence")
    return knn.cascade(answers, answers.select("id", F.concat(F.lit("F"), F.col("id") % 3).alias("label")), 0.35)


_TAUS = evaluate.THRESHOLDS


def _scored(spark, d) -> DataFrame:
    return _answers(spark, d).withColumn("right", F.col("category") == F.col("label"))


@query(f"WITH {_VOTES}{_GRID} SELECT min(t) AS tau FROM (SELECT t FROM answers, grid WHERE confidence >= t GROUP BY t HAVING count(*) >= 10 AND avg((category = label)::INT) >= 0.1)")
def pick_tau(spark, d):
    return knn.pick_tau(_scored(spark, d), _TAUS, 0.1, 10)


@query(f"""WITH {_VOTES}{_GRID}, steps AS (SELECT t, lead(t, 1, 'inf'::DOUBLE) OVER (ORDER BY t) AS upper FROM grid)
SELECT t AS tau, count(id) AS answers, coalesce(sum((category = label)::INT), 0)::BIGINT AS right FROM steps LEFT JOIN answers ON confidence >= t AND confidence < upper GROUP BY t""")
def bands(spark, d):
    return knn.bands(_scored(spark, d), _TAUS)


@query(f"""WITH {_CENTROIDS}, top AS (SELECT * FROM scores WHERE place = 1 AND label <> truth), listed AS (SELECT s.query_id FROM scores s JOIN top USING (query_id) WHERE s.place <= 4 AND s.label = s.truth)
SELECT 4 AS k, count(*) AS wrong, count(l.query_id) AS chooser, count(*) - count(l.query_id) AS retrieval FROM top LEFT JOIN listed l USING (query_id)""")
def miss_split(spark, d):
    lists = _shortlists(spark, d, 5)
    answers = lists.select("id", "label", F.get("paths", F.lit(0)).alias("category"))
    return evaluate.misses(answers, lists.select("id", "paths"), 4)


@query(f"""WITH {_VOTES}, b AS (SELECT (event_id % 211 + 1) / 1000.0 AS seconds FROM events)
SELECT round(quantile_disc(seconds * 1000, 0.5), 6)::DOUBLE AS p50_ms, round(quantile_disc(seconds * 1000, 0.99), 6)::DOUBLE AS p99_ms, round(any_value(n) / sum(seconds), 6)::DOUBLE AS per_s, any_value(none)::BIGINT AS none, any_value(invalid)::BIGINT AS invalid, round(any_value(1.5 / n * 1000000), 6)::DOUBLE AS usd_per_m
FROM b, (SELECT count(*) AS n, count_if(id % 15 = 0) AS none, count_if(confidence < 0.2) AS invalid FROM answers)""")
def eval_summary(spark, d):
    answers = _answers(spark, d).withColumn("valid", F.col("confidence") >= 0.2).withColumn("category", F.when(F.col("id") % 15 != 0, F.col("category")))
    batches = X.table(spark, d, "events").select(((F.col("event_id") % 211 + 1) / 1000).alias("seconds"))
    return evaluate.summary(answers, batches, 1.5).select(*_r("p50_ms", "p99_ms", "per_s"), "none", "invalid", *_r("usd_per_m"))


@query(f"WITH {_VOTES} SELECT round(avg((category = label)::INT), 6) AS exact, round(avg(({_CUT.format('category', 1)} = {_CUT.format('label', 1)})::INT), 6) AS level1, round(avg(({_CUT.format('category', 2)} = {_CUT.format('label', 2)})::INT), 6) AS level2 FROM answers")
def agreement(spark, d):
    return evaluate.agreement(_answers(spark, d)).select(*_r("exact", "level1", "level2"))


@query("SELECT list_extract(l, (len(l) // 2 + 1)::BIGINT) AS p50_ms, list_extract(l, (least(len(l) - 1, floor(len(l) * 0.99)) + 1)::BIGINT) AS p99_ms FROM (SELECT list(o_totalprice ORDER BY o_totalprice) AS l FROM orders)")
def student_latency(spark, d):
    return evaluate.student_latency(X.table(spark, d, "orders").select(F.col("o_totalprice").alias("ms")))


@query()
def softmax_answers(spark, d):
    asked, held = X.vectors(spark, d)
    return knn.Softmax.fit(held, steps=60).predict(asked).select("id", "label", *_r("confidence"))


# --- curation and taxonomy --------------------------------------------------------------------------

_EN, _OTHER = (f"[{', '.join(chr(39) + w + chr(39) for w in x)}]" for x in (C.ENGLISH_WORDS, C.OTHER_WORDS))
_ENGLISH = """(letters = 0 OR (letters - plain) / letters < 0.03) AND (en > other OR (en = 0 AND other = 0))"""


def _english_sql(source: str, text: str) -> str:
    return f"""SELECT *, {_ENGLISH} AS english FROM (SELECT *, len(regexp_extract_all({text}, '\\p{{L}}')) AS letters, len(regexp_extract_all({text}, '[A-Za-z]')) AS plain,
  len(list_filter(w, lambda x: list_contains({_EN}, x))) AS en, len(list_filter(w, lambda x: list_contains({_OTHER}, x))) AS other FROM (SELECT *, regexp_extract_all(lower({text}), '[a-zà-ÿ]+') AS w FROM {source}))"""


@query(f"SELECT doc_id, english FROM ({_english_sql('documents', 'text')})")
def english_filter(spark, d):
    return X.spread(X.table(spark, d, "documents")).select("doc_id", C.english(F.col("text")).alias("english"))


@query("SELECT doc_id, substr(sha256(concat(string_split(text, chr(10))[1], chr(10), text)), 1, 16) AS id FROM documents")
def shape_ids(spark, d):
    return X.table(spark, d, "documents").select("doc_id", C.shape_id(F.split("text", "\n")[0], F.col("text")).alias("id"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first(spark, d):
    rows = X.table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", "source")
    return curate.first_seen(rows, "h", "doc_id").select("doc_id", "source")


_USABLE = f"""{X.CANDIDATES}, {X.PATHS}, shaped AS (
  SELECT n, origin, category AS raw, CASE WHEN title IS NULL OR trim(title, ' ') = '' THEN NULL ELSE t END AS title, d AS description,
         CASE WHEN title IS NULL OR trim(title, ' ') = '' THEN NULL ELSE substr(sha256(concat(t, chr(10), d)), 1, 16) END AS id
  FROM (SELECT *, CASE WHEN length(title) <= 150 THEN title WHEN rtrim(regexp_extract(substr(title, 1, 151), '(?s)^(.*) ', 1), ' ') <> '' THEN rtrim(regexp_extract(substr(title, 1, 151), '(?s)^(.*) ', 1), ' ') ELSE substr(title, 1, 150) END AS t,
               substr(trim(description, ' '), 1, 5000) AS d FROM candidates)),
judged AS ({_english_sql("(SELECT *, concat_ws(' ', title, description) AS joined FROM shaped)", 'joined')}),
ren AS (SELECT raw, arg_max(concat(new, substr(raw, length(old) + 1)), length(old)) AS renamed FROM (SELECT DISTINCT raw FROM shaped), renames WHERE raw = old OR starts_with(raw, concat(old, ' > ')) GROUP BY raw),
mapped AS (SELECT j.*, coalesce(p1.path, p2.path) AS category FROM judged j LEFT JOIN ren USING (raw) LEFT JOIN paths p1 ON p1.path = {_CUT.format('renamed', 3)} LEFT JOIN paths p2 ON p2.path = {_CUT.format('raw', 3)}),
early AS (SELECT *, CASE WHEN id IS NULL OR raw IS NULL THEN 'malformed' WHEN NOT english THEN 'non_english' WHEN category IS NULL THEN 'unmapped' END AS e FROM mapped),
usable AS (SELECT *, CASE WHEN e IS NULL AND row_number() OVER (PARTITION BY id, e IS NULL ORDER BY n) > 1 THEN 'duplicates' ELSE e END AS reason FROM early)"""


def _usable(spark, d) -> DataFrame:
    return curate.usable(X.candidates(spark, d), "docs", X.category_paths(spark), X.renames(spark))


@query(f"WITH {_USABLE} SELECT n, id, category, reason FROM usable")
def usable_rows(spark, d):
    return _usable(spark, d).select("n", "id", "category", "reason")


@query(f"WITH {_USABLE} SELECT count(*) AS read, count_if(reason IS NULL)::BIGINT AS kept, {', '.join(f"count_if(reason = '{x}')::BIGINT AS {x}" for x in curate.REASONS[:-1])} FROM usable")
def drop_counts(spark, d):
    return curate.drop_counts(_usable(spark, d))


@query(f"WITH {_USABLE} SELECT raw, count(*) AS rows FROM usable WHERE reason = 'unmapped' GROUP BY raw ORDER BY rows DESC, raw LIMIT 20")
def common_unmapped(spark, d):
    return curate.most_common(_usable(spark, d).filter("reason = 'unmapped'"), "raw")


@query("""WITH train AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE doc_id % 4 <> 0), test AS (SELECT doc_id, lower(text) AS low FROM documents WHERE doc_id % 4 = 0)
SELECT doc_id FROM train WHERE low NOT IN (SELECT low FROM test) AND doc_id + 1 NOT IN (SELECT doc_id FROM test WHERE doc_id % 8 = 0)""")
def leak_free(spark, d):
    docs = X.table(spark, d, "documents")
    train = docs.filter("doc_id % 4 <> 0").select((F.col("doc_id") + 1).alias("id"), F.col("text").alias("title"))
    test = docs.filter("doc_id % 4 = 0").select(F.when(F.col("doc_id") % 8 == 0, F.col("doc_id")).otherwise(-1).alias("id"), F.col("text").alias("title"))
    return curate.leak_free(train, test).select((F.col("id") - 1).alias("doc_id"))


@query("""SELECT doc_id, source, r <= n // 10 AS held FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0/' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def held_out(spark, d):
    return curate.held_out(X.table(spark, d, "documents").select("doc_id", "source"), 0, "doc_id", "source")


@query("""SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN rtrim(h, ' ') <> '' THEN rtrim(h, ' ') ELSE substr(text, 1, 60) END AS cut
FROM (SELECT *, regexp_extract(substr(text, 1, 61), '(?s)^(.*) ', 1) AS h FROM documents)""")
def cut_text(spark, d):
    return X.table(spark, d, "documents").select("doc_id", C.cut(F.col("text"), 60).alias("cut"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7/' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, d):
    return curate.sample(X.table(spark, d, "documents").select("doc_id", "source"), 5, 7, "doc_id", "source")


@query(f"WITH {X.PART_PATHS} SELECT id, path, {_CUT.format('path', 1)} AS level1, {_CUT.format('path', 2)} AS level2 FROM part_paths")
def taxonomy_ancestor(spark, d):
    return X.part_paths(spark, d).select("id", "path", C.ancestor(F.col("path"), 1).alias("level1"), C.ancestor(F.col("path"), 2).alias("level2"))


@query(f"WITH {X.PART_PATHS} SELECT {_CUT.format('path', 2)} AS category, string_agg(DISTINCT path, '|' ORDER BY path) AS deeper FROM part_paths GROUP BY 1")
def descendants(spark, d):
    rows = taxonomy.descendants(X.part_paths(spark, d).select("path").distinct(), 2)
    return rows.select("category", F.array_join("deeper", "|").alias("deeper"))


@query(f"""WITH {X.CANDIDATES}, {X.PATHS} SELECT category, (SELECT arg_max(concat(new, substr(category, length(old) + 1)), length(old)) FROM renames WHERE category = old OR starts_with(category, concat(old, ' > '))) AS renamed
FROM (SELECT DISTINCT category FROM candidates WHERE category IS NOT NULL)""")
def rename_longest_prefix(spark, d):
    return taxonomy.renamed(X.candidates(spark, d).filter("category is not null").select("category").distinct(), X.renames(spark), "category")


# --- retention --------------------------------------------------------------------------------------


@query(f"WITH {X.LANDED}, w AS (SELECT max(received_at) AS now, max(_commit_version) // 2 AS slow FROM landed) SELECT pos, received_at < now - INTERVAL 7 DAY - INTERVAL 1 HOUR AND _commit_version < slow AS prune FROM landed, w")
def retention_prune(spark, d):
    log = X.landed(spark, d)
    now, slow = log.agg(F.max("received_at"), F.expr("max(_commit_version) div 2")).first()
    return retention.landing(log, F.lit(now), F.lit(slow)).select("pos", "prune")


@query("""WITH s AS (SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y%m%dT%H0000Z') AS name, date_trunc('hour', ts) AS taken FROM events), r AS (SELECT *, row_number() OVER (ORDER BY name DESC) AS nth FROM s)
SELECT name, nth > 7 AS prune, epoch(taken - lag(taken) OVER (ORDER BY name)) >= 7200 OR lag(taken) OVER (ORDER BY name) IS NULL AS due FROM r""")
def snapshot_due(spark, d):
    from pyspark.sql import Window

    ts = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    names = X.table(spark, d, "events").select(F.date_format(ts, "yyyyMMdd'T'HH'0000Z'").alias("name"), ts.alias("at")).distinct()
    rows = retention.snapshots(names, 7).withColumn("before", F.lag("at").over(Window.orderBy("name")))
    return rows.select("name", "prune", retention.snapshot_due(F.col("before"), F.col("at"), 7200).alias("due"))


@query("""WITH f AS (SELECT o_orderkey AS file, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS removed_at, o_orderkey % 9 = 0 AS pinned FROM orders), w AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT file FROM f, w WHERE removed_at IS NOT NULL AND NOT pinned AND epoch_us(now) - epoch_us(removed_at) > 86400 * 30 * 1000000::BIGINT""")
def vacuum_candidates(spark, d):
    rows = X.table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    now = rows.agg(F.max("o_orderdate")).first()[0]
    files = rows.select(F.col("o_orderkey").alias("file"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("removed_at"), (F.col("o_orderkey") % 9 == 0).alias("pinned"))
    return retention.vacuum(files, F.lit(now), 86400 * 30).select("file")
