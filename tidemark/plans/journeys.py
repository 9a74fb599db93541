"""Queries that go through tables, files and jobs: each lands, drains, exports or saves whole driver tables in a
scratch folder and returns what is read back, with the SQL that says what that must be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import fold, knn, metrics, taxonomy
from tidemark.plans import fixtures as X
from tidemark.plans.queries import K, query
from tidemark.schemas import KEYS, OUTCOMES
from tidemark.session import scratch
from tidemark.sources import files, generate, vectors
from tidemark.sources.vtable import Files, VTable
from tidemark.streaming.export import Export
from tidemark.streaming.ingest import Ingest
from tidemark.streaming.landing import LandingLog

COMMITS = 4
_MS = "1700000000000 + part * 3600000"

# --- a log that is landed in COMMITS commits and drained, a commit a batch ---------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The fixtures' log as rows to land, with the commit that each comes with (part)."""
    rows = X.landed(spark, d)
    size = rows.agg(F.expr(f"(max(pos) + {COMMITS}) div {COMMITS}")).first()[0] or 1
    rows = rows.withColumn("part", F.expr(f"pos div {size}")).withColumn("ms", F.lpad(F.lower(F.hex(F.expr(_MS))), 12, "0"))
    listing = F.to_json(F.struct(F.col("content").alias("title"), F.lit("").alias("description"), F.lit(1).alias("price_micros"), F.lit("USD").alias("currency"), F.lit("in_stock").alias("availability"), F.create_map(F.lit("a"), F.lit("b")).alias("attributes")))
    submission = F.concat(F.substring("ms", 1, 8), F.lit("-"), F.substring("ms", 9, 4), F.lit("-7000-8000-000000000000"))
    return rows.select("part", F.expr(f"cast(pos % {size} as int)").alias("nth"), "pos", *KEYS, "source_version", "op", F.when(F.col("op") == "upsert", listing).alias("listing"), submission.alias("submission_id"), F.expr(f"cast(pos % {size} as int)").alias("change_index"), "received_at")


_LOG = f"""{X.ALL}, size AS (SELECT (max(pos) + {COMMITS}) // {COMMITS} AS n FROM landed),
parts AS (SELECT * EXCLUDE (submission_id, change_index), pos // n AS part, (pos % n)::INT AS change_index,
  printf('%012x', 1700000000000 + pos // n * 3600000) AS ms FROM decided, size),
named AS (SELECT *, concat(substr(ms, 1, 8), '-', substr(ms, 9, 4), '-7000-8000-000000000000') AS submission_id FROM parts)"""

_made: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, d: str, name: str, make) -> str:
    """A scratch folder that make(path) fills once per application and input."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _made:
        path = scratch(spark, name)
        make(path)
        _made[key] = path
    return _made[key]


def _land(log: LandingLog, rows: DataFrame) -> None:
    rows = rows.persist()
    try:
        for k in range(COMMITS):
            part = rows.filter(F.col("part") == k)
            if not part.isEmpty():
                log.append(part)
    finally:
        rows.unpersist()


def _quiet(line: dict) -> None:
    pass


def _drained(spark: SparkSession, d: str) -> str:
    def make(path: str) -> None:
        job = Ingest(spark, path, say=_quiet)
        _land(job.landing, _log(spark, d))
        job.start(max_bytes=None, max_files=1).awaitTermination()

    return _once(spark, d, "drained", make)


def _store(spark: SparkSession, d: str) -> VTable:
    return VTable(spark, f"{_drained(spark, d)}/store")


@query(f"WITH {_LOG} SELECT submission_id, change_index, {K}, source_version, op, CASE WHEN op = 'upsert' THEN content END AS title, part AS _commit_version FROM named")
def landing_rows(spark, d):
    rows = LandingLog(spark, f"{_drained(spark, d)}/landing").read()
    return rows.select("submission_id", "change_index", *KEYS, "source_version", "op", F.get_json_object("listing", "$.title").alias("title"), "_commit_version")


@query(f"""WITH {X.LANDED}, {X.store_sql('landed', 'store')} SELECT {K}, source_version, is_tombstone,
  CASE WHEN NOT is_tombstone THEN content END AS title, CASE WHEN NOT is_tombstone THEN concat('Fake > ', substr(content, 1, 1)) END AS primary_category,
  CASE WHEN NOT is_tombstone THEN 0.9::DOUBLE END AS classify_confidence, CASE WHEN NOT is_tombstone THEN 'fake-0' END AS taxonomy_version, FALSE AS needs_reclassify FROM store""")
def ingest_store(spark, d):
    return _store(spark, d).read().select(*KEYS, "source_version", "is_tombstone", "title", "primary_category", "classify_confidence", "taxonomy_version", "needs_reclassify")


@query(f"WITH {_LOG} SELECT submission_id, change_index, outcome, strftime(make_timestamp(({_MS}) * 1000), '%Y-%m-%dT%H') AS hour FROM named")
def ingest_outcomes(spark, d):
    table = VTable(spark, f"{_drained(spark, d)}/outcomes")
    return table.read_hours("0000", "9999").select("submission_id", "change_index", "outcome", "hour")


@query(f"WITH {_LOG} SELECT submission_id, change_index, outcome FROM named WHERE part = 1")
def outcomes_of_an_hour(spark, d):
    hour = X.table(spark, d, "region").limit(1).select(C.hour(F.expr(_MS.replace("part", "1L")))).first()[0]
    return VTable(spark, f"{_drained(spark, d)}/outcomes").read_hours(hour, hour).select("submission_id", "change_index", "outcome")


_STATES = f"""{_LOG}, touched AS (SELECT DISTINCT {K}, part FROM named WHERE outcome IN ('written', 'reclassified')),
state AS (SELECT t.merchant_id, t.merchant_product_id, t.part, max(source_version) AS source_version, arg_max(is_tombstone, source_version) AS is_tombstone
  FROM touched t JOIN named n ON t.merchant_id = n.merchant_id AND t.merchant_product_id = n.merchant_product_id AND n.part <= t.part AND n.outcome = 'written' GROUP BY ALL)"""


@query(f"""WITH {_STATES}, lined AS (SELECT *, lag(source_version) OVER w AS v, lag(is_tombstone) OVER w AS t FROM state WINDOW w AS (PARTITION BY {K} ORDER BY part))
SELECT {K}, source_version, is_tombstone, CASE WHEN v IS NULL THEN 'insert' ELSE 'update_postimage' END AS _change_type, part + 1 AS _commit_version FROM lined
UNION ALL SELECT {K}, v, t, 'update_preimage', part + 1 FROM lined WHERE v IS NOT NULL""")
def ingest_feed(spark, d):
    return _store(spark, d).feed().select(*KEYS, "source_version", "is_tombstone", "_change_type", "_commit_version")


@query(f"""WITH {_STATES}, ranged AS (SELECT *, part // 2 AS r, row_number() OVER (PARTITION BY {K}, part // 2 ORDER BY part DESC) AS nth FROM state)
SELECT {K}, source_version, CASE WHEN is_tombstone THEN 'delete' ELSE 'upsert' END AS op, concat(printf('%020d', r * 2 + 1), '-', printf('%020d', r * 2 + 2)) AS file FROM ranged WHERE nth = 1""")
def export_ticks(spark, d):
    """Two versions a tick until nothing is new."""
    store = _store(spark, d)

    def make(path: str) -> None:
        out = Export(spark, store, path, max_versions=2)
        while out.watermark() < store.head():
            out.tick()

    return files.read_exports(spark, _once(spark, d, "exports", make)).select(*KEYS, "source_version", "op", "file")


@query(f"WITH {_LOG}, early AS (SELECT * FROM named WHERE part < 2), {X.store_sql('early', 'store')} SELECT {K}, source_version, is_tombstone FROM store")
def time_travel(spark, d):
    return _store(spark, d).read(2).select(*KEYS, "source_version", "is_tombstone")


@query(f"WITH {_LOG}, early AS (SELECT * FROM named WHERE part < 3), {X.store_sql('early', 'store')} SELECT {K}, source_version, is_tombstone FROM store SEMI JOIN (SELECT * FROM named WHERE part = 3) USING ({K})")
def store_lookup(spark, d):
    """What a batch finds of its keys at the version before, from the files that may hold them."""
    keys = _log(spark, d).filter("part = 3").select(*KEYS).distinct()
    return _store(spark, d).lookup(keys, 3).select(*KEYS, "source_version", "is_tombstone")


@query(f"WITH {X.LANDED}, {X.store_sql('landed', 'store')} SELECT {K}, source_version, is_tombstone FROM store")
def store_snapshot(spark, d):
    store = _store(spark, d)
    folder = _once(spark, d, "snapshots", lambda path: store.snapshot(path, "20240101T000000Z"))
    return spark.read.parquet(f"{folder}/20240101T000000Z/data").select(*KEYS, "source_version", "is_tombstone")


@query(f"WITH {X.LANDED}, {X.store_sql('landed', 'store')} SELECT {K}, source_version, is_tombstone, CASE WHEN NOT is_tombstone THEN content END AS title FROM store")
def bounded_rebuild(spark, d):
    """An empty store that catches up from the log in steps of some rows a partition."""

    def make(path: str) -> None:
        job = Ingest(spark, path, say=_quiet)
        rows = _log(spark, d)
        _land(job.landing, rows)
        most = rows.groupBy(C.partition_of(*KEYS)).count().agg(F.max("count")).first()[0] or 1
        if job.rebuild(-(-most // 3)) != 3:
            raise AssertionError("a rebuild in thirds takes three steps")

    store = VTable(spark, f"{_once(spark, d, 'rebuilt', make)}/store")
    return store.read().select(*KEYS, "source_version", "is_tombstone", "title")


@query(f"WITH {X.ALL}, kept AS (SELECT * FROM decided WHERE pos % 9 <> 0), {X.store_sql('kept', 'store')} SELECT {K}, source_version, hash, is_tombstone FROM store")
def expected_store_without_failed(spark, d):
    log = X.landed(spark, d)
    return fold.expected_store(log, failed=log.filter("pos % 9 = 0").select("submission_id", "change_index"))


@query(f"WITH {_LOG} SELECT submission_id, change_index, outcome FROM named")
def compacted(spark, d):
    """Outcomes appended in parts, compacted, their log pruned and their old files removed."""

    def make(path: str) -> None:
        table, rows = VTable.create(spark, path, OUTCOMES, keyed=False), VTable(spark, f"{_drained(spark, d)}/outcomes").read()
        for k in range(3):
            table.append(rows.filter(F.pmod("change_index", F.lit(3)) == k), ("parts", k))
            table.append(rows.limit(1), ("parts", k))  # a repeated transaction adds nothing
        if table.compact(small_files=2, small_rows=1 << 40) is None or not table.vacuum(-1000):
            raise AssertionError("small files are compacted and removed")
        table.prune_log(table.head())

    return VTable(spark, _once(spark, d, "compacted", make)).read().select("submission_id", "change_index", "outcome")


# --- files -------------------------------------------------------------------------------------------


@query(f"""WITH {X.EVENT_LOG}, since AS (SELECT (min(ts) + max(ts)) // 2 AS t FROM event_log)
SELECT type, ts, submission_id, change_index, merchant_id FROM event_log, since WHERE ts // 3600000 >= t // 3600000""")
def event_files(spark, d):
    """Events written by hour and read from an hour on."""
    log = X.event_log(spark, d, fold.decided(X.landed(spark, d)))
    folder = _once(spark, d, "events", lambda path: files.write_events(log, path))
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    return files.read_events(spark, folder, since_ms=(low + high) // 2).select("type", "ts", "submission_id", "change_index", "merchant_id")


@query("SELECT doc_id::VARCHAR AS id, text AS title, lang AS category, source FROM documents WHERE text IS NOT NULL")
def training_files(spark, d):
    rows = X.table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), F.lit("").alias("description"), F.col("lang").alias("category"), "source")
    folder = _once(spark, d, "training", lambda path: files.write_training(rows, path))
    return files.read_training(spark, [folder]).select("id", "title", "category", "source")


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title, concat('New > S', p_partkey % 4) AS category FROM part")
def label_file(spark, d):
    """A label file, one JSON line each, checked against the taxonomy."""
    rows = X.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("New > S"), F.col("p_partkey") % 4).alias("category"))
    folder = _once(spark, d, "labels", lambda path: rows.coalesce(1).write.json(path))
    part = next(x for x in Files(spark, folder).list(folder) if x.endswith(".json"))
    return files.read_labels(spark, f"{folder}/{part}", X.category_paths(spark))[0].select("id", "title", "category")


@query("SELECT p_name AS title, p_type AS description, p_brand AS category FROM part")
def paged_rows(spark, d):
    """Parts from a paged service, a task a run of pages."""
    rows = X.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"))
    folder = _once(spark, d, "pages", lambda path: files.write_pages(rows, path, ["p_partkey"]))
    spark.dataSource.register(files.PagedSource)
    return spark.read.format("paged").option("path", folder).option("total", rows.count()).load()


def _line(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(key)  # rows of a small export


@query("SELECT source AS category, least(7, count(*)) AS drawn FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20 GROUP BY source")
def seeded_draw(spark, d):
    """Of each source's first 20 documents 7, by a seeded hash."""
    from pyspark.sql import Window

    rows = X.table(spark, d, "documents").select(F.col("source").alias("category"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("n"))
    return files.sampled(rows, 7, seed=5, lines=20).groupBy("category").agg(F.count_distinct("id").alias("drawn"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey, step) - 1 AS n, concat('m_', n_nationkey) AS merchant_id, action FROM (SELECT n_nationkey, unnest([0, 1, 2]) AS step, unnest(['create', 'rotate', 'revoke']) AS action FROM nation)")
def registry_audit(spark, d):
    """Nations as merchants: keys made, changed and taken back; only keys that count are accepted."""
    ids = [f"m_{r['n_nationkey']}" for r in X.table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    registry = files.Registry(spark, scratch(spark, "registry"))
    for m in ids:
        first = registry.create(m, "USD")
        second = registry.rotate(m)
        if registry.verify(first) or registry.verify(second) != (m, "USD"):
            raise AssertionError("a rotated key replaces the one before")
        registry.revoke(m)
        if registry.verify(second):
            raise AssertionError("a revoked key counts no more")
    return registry.audit().select(F.col("n").cast("long").alias("n"), "merchant_id", "action")


@query("""SELECT i::INT AS nth, concat('m_', i % 10) AS merchant_id, concat('p', i) AS merchant_product_id, 1::BIGINT AS source_version, 'upsert' AS op, i // 50 AS request, (i % 50)::INT AS change_index
FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS i)""")
def generated_changes(spark, d):
    rows = generate.requests(generate.changes(spark, X.table(spark, d, "customer").count(), seed=3), 50)
    return rows.select("nth", *KEYS, "source_version", "op", "request", "change_index")


@query(f"WITH {X.VECTORS} SELECT id, label, len(vector) AS width FROM vectors")
def vector_index(spark, d):
    """Vectors saved under a name that their origin gives, loaded with all checks, and a cached copy of them."""
    asked, held = X.vectors(spark, d)
    rows, name = asked.unionByName(held), vectors.name_of("embeddings", "1")
    paths = rows.select(F.col("label").alias("path")).distinct()
    folder = _once(spark, d, "index", lambda path: vectors.save(rows, path, name))
    width = rows.select(F.max(F.size("vector"))).first()[0] or 0
    index = vectors.load(spark, folder, name, paths, width)
    kept = vectors.cached(index, folder, vectors.name_of("copy", name), lambda x: x)
    return kept.select("id", "label", F.size("vector").cast("long").alias("width"))


# --- taxonomy, recipes, readers, comparisons ------------------------------------------------------------


_RELEASE = """release AS (SELECT row_number() OVER (ORDER BY r_name, n_name NULLS FIRST) + 2 AS number, CASE WHEN n_name IS NULL THEN r_name ELSE concat(r_name, ' > ', n_name) END AS path, CASE WHEN n_name IS NULL THEN 1 ELSE 2 END AS depth
FROM (SELECT r_name, NULL AS n_name FROM region UNION ALL SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey))"""


def _release(spark: SparkSession, d: str) -> str:
    regions, nations = X.table(spark, d, "region"), X.table(spark, d, "nation")
    both = regions.select("r_name", F.lit(None).cast("string").alias("n_name")).unionByName(regions.join(nations, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name"))
    names = [r["r_name"] if r["n_name"] is None else f"{r['r_name']} > {r['n_name']}" for r in both.orderBy("r_name", F.col("n_name").asc_nulls_first()).collect()]  # regions and nations
    lines = ["# Product Categories: 2024-01", "", *(f"gid/{i} : {x}" for i, x in enumerate(names))]

    def make(path: str) -> None:
        store = Files(spark, path)
        store.make(path)
        store.publish(f"{path}/release.txt", "\n".join(lines) + "\n")

    return f"{_once(spark, d, 'release', make)}/release.txt"


@query(f"WITH {_RELEASE} SELECT number::INT AS number, path, depth::INT AS depth, '2024-01' AS version FROM release")
def taxonomy_release(spark, d):
    """A release read from its file: version, paths in order, levels."""
    version, paths = taxonomy.load(spark, _release(spark, d))
    return paths.select("number", "path", "depth", F.lit(version).alias("version"))


@query(f"WITH {_RELEASE} SELECT path AS category, replace(path, ' > ', ' ') AS text, 'joined' AS recipe FROM release UNION ALL SELECT path, path, 'path' FROM release")
def category_texts(spark, d):
    _, paths = taxonomy.load(spark, _release(spark, d))
    return taxonomy.texts(paths, "joined").withColumn("recipe", F.lit("joined")).unionByName(taxonomy.texts(paths, "path").withColumn("recipe", F.lit("path")))


@query(f"WITH {_RELEASE} SELECT split_part(path, ' > ', 1) AS category, string_agg(path, '|' ORDER BY path) AS deeper FROM release WHERE depth > 1 GROUP BY 1")
def release_descendants(spark, d):
    """The paths below each category, from a release of the same version."""
    path = _release(spark, d)
    version, paths = taxonomy.load(spark, path)
    return taxonomy.load_deeper(spark, path, version, paths, depth=1).select("category", F.array_join("deeper", "|").alias("deeper"))


_OLD = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in taxonomy.RENAMES)


@query(f"""WITH renames AS (SELECT * FROM (VALUES {_OLD}) AS t(old, new)), paths AS (SELECT concat(old, ' > ', p_brand) AS path, concat(new, ' > ', p_brand) AS renamed FROM renames, (SELECT DISTINCT p_brand FROM part))
SELECT path, renamed FROM paths UNION ALL SELECT concat(old, 's > x'), NULL FROM renames""")
def published_renames(spark, d):
    """The published renames over a path below each of them, and over paths that only begin alike."""
    renames = spark.createDataFrame(list(taxonomy.RENAMES), "old string, new string")
    brands = X.table(spark, d, "part").select("p_brand").distinct()
    below = brands.select(F.explode(F.transform(F.lit([x for x, _ in taxonomy.RENAMES]), lambda old: F.concat_ws(" > ", old, "p_brand"))).alias("path"))
    beside = renames.select(F.concat("old", F.lit("s > x")).alias("path"))
    return taxonomy.renamed(below.unionByName(beside), renames).select("path", "renamed")


@query("""WITH t AS (SELECT o_orderpriority AS load, o_orderkey % 1999 = 0 AS stopped, o_orderkey % 997 = 0 AS timed_out, o_orderkey % 499 = 0 AS refused, o_custkey AS sent, o_custkey // 2 AS accepted FROM orders)
SELECT load, count(*) AS processes, sum(sent)::BIGINT AS sent, sum(accepted)::BIGINT AS accepted, CASE WHEN bool_or(stopped) THEN 'ctrl_c' WHEN bool_or(timed_out) THEN 'seconds' WHEN bool_or(refused) THEN '401' ELSE 'changes' END AS ended_by FROM t GROUP BY load""")
def load_ended_by(spark, d):
    k = F.col("o_orderkey")
    tallies = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("load"), (k % 1999 == 0).alias("stopped"), (k % 997 == 0).alias("timed_out"), (k % 499 == 0).alias("refused"), F.col("o_custkey").alias("sent"), F.expr("o_custkey div 2").alias("accepted"))
    return metrics.ended_by(tallies, "load")


@query(f"WITH {X.CANDIDATES}, {X.PATHS} SELECT n FROM candidates WHERE category <> 'Uncategorized' AND category NOT IN (SELECT path FROM paths)")
def unknown_labels(spark, d):
    return taxonomy.unknown(X.candidates(spark, d), X.category_paths(spark)).select("n")


@query("SELECT doc_id, trim(concat(source, ' ', left(text, 80)), ' ') AS text, concat('t-1+', lang) AS version FROM documents WHERE text IS NOT NULL")
def classifier_text(spark, d):
    docs = X.table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", C.recipe(F.col("source"), F.col("text"), 80).alias("text"), C.version("t-1", F.col("lang")).alias("version"))


@query("SELECT arg_min(user_id, (event_id // 100, event_id % 100, user_id)) AS reader, min(event_id // 100) AS commit FROM events")
def slowest_reader(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("reader"), F.expr("event_id div 100").alias("commit"), (F.col("event_id") % 100).alias("seq"))
    return metrics.slowest_reader(e)


@query("""SELECT n_nationkey, bool_or(e >= 0.5 AND k > n_nationkey / 25 OR e > 0.5 AND k >= n_nationkey / 25) AND n_nationkey / 25 >= 0.5 + 0.02 AS beats
FROM (SELECT n.n_nationkey, t.i / 10 AS k, 1 - t.i / 20 AS e FROM nation n, range(11) t(i)) GROUP BY n_nationkey""")
def student_beats(spark, d):
    """Whether a student with this accuracy, on a curve of kept rates, beats another at one point of its own."""
    keys = [r["n_nationkey"] for r in X.table(spark, d, "nation").select("n_nationkey").collect()]
    curve = [(i / 10, 1 - i / 20) for i in range(11)]
    rows = [(k, knn.beats(k / 25, curve, 0.5, (k / 25, 0.5), 0.02)) for k in keys]
    return spark.createDataFrame(rows, "n_nationkey long, beats boolean")


@query(f"""WITH {_LOG}, last AS (SELECT {K}, hash, source_version, is_tombstone FROM named WHERE outcome = 'written' QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY pos DESC) = 1)
SELECT row_number() OVER (ORDER BY {K}) AS place, {K}, source_version, CASE WHEN is_tombstone THEN 'delete' ELSE 'upsert' END AS op FROM last""")
def collapsed_in_order(spark, d):
    """An export's rows in the order in which its files hold them."""
    store = _store(spark, d)

    def make(path: str) -> None:
        Export(spark, store, path, max_versions=1 << 20).tick()

    rows = files.read_exports(spark, _once(spark, d, "export", make))
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return rows.withColumn("at", place).withColumn("place", F.row_number().over(_line("at")).cast("long")).select("place", *KEYS, "source_version", "op")


