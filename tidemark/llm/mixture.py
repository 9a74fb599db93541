"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Every source gets a target (its share by weight, at most ``max_repeat`` times its size). The mix is cut
into seats of ``block`` words; sources get seats by highest quotients weight / (2k + 1), a source's groups
of shards get its seats in the same way, and a group's shards the group's. A shard's words lie end to end and
are cut into equal blocks; a seeded permutation selects as many as the shard's seats are worth, all blocks
again and again where that is more than it has. A block's place in the permutation is arithmetic, so a
document's share is an expression over its own row: there is no row per block anywhere. Only document numbers
and sizes are shuffled, never texts; a large source is many shards, so that none meets in one task.

Documents go to shards by a hash of id and text, so that neither null ids nor one id of many texts is hot.

Defined cases: null texts have size 0 and are never taken; a null source is a source of its own, the
last; equal rows are documents of their own; without words, all targets are 0; extra columns are
ignored by mix() and kept by materialised().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

WEIGHTS, MAX_REPEAT = (5, 2, 1), 3
#: Words in a seat; documents in a shard, about; shards in a group.
BLOCK, SHARD_DOCS, GROUP_SHARDS, SEED = 32, 512, 4096, "mix-1"
#: Primes above any shard's number of blocks.
STEPS = (2654435761, 2246822519, 3266489917, 668265263, 374761393)


def seeded(*parts: Column | str) -> Column:
    """32 bits of a seeded hash that any SQL engine can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(SEED), *(F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts))), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sources (source, source_size, ...) with their number s from 0, weight and target.

    The water level is the largest of (total - capped sizes) / (weights not capped), over how many of
    the sources that reach their limit first are capped: reshared excess ends at that level."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("s", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    limit = F.lit(max_repeat) * F.col("source_size")
    before = every.orderBy(limit / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return out.withColumn("target", F.least(limit.cast("double"), F.col("level") * F.col("weight"))).drop("level")


def apportioned(rows: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """rows with their quota of the group's seats by Sainte-Laguë: the largest quotients weight / (2k + 1)
    win a seat each; ties go to the smaller key. Most seats are certain from the weight alone; only the
    quotients near the last seat are listed and ranked, about two per row."""
    each = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(each) / 2, F.sum(F.col(weight).cast("double")).over(each)
    share = lambda m: F.when(total > 0, F.col(weight) * m / total).otherwise(0.0)
    rows = rows.withColumn("low", F.greatest(F.lit(0), F.floor(share(F.col(seats) - n) - 0.5)).cast("long"))
    rows = rows.withColumn("high", F.when(F.col(weight) > 0, F.ceil(share(F.col(seats) + n) + 0.5) + 1).otherwise(0).cast("long"))
    rows = rows.withColumn("left", F.col(seats) - F.sum("low").over(each))
    listed = rows.filter(F.col("high") > F.col("low")).select(*group, key, weight, "left", F.explode(F.sequence("low", F.col("high") - 1)).alias("__k"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("__k") + 1)).desc(), key))
    won = listed.withColumn("rank", rank).filter(F.col("rank") <= F.col("left")).groupBy(*group, key).agg(F.count(F.lit(1)).alias("won"))
    return rows.join(won, [*group, key], "left").withColumn("quota", F.col("low") + F.coalesce("won", F.lit(0))).drop("low", "high", "left", "won")


def located(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK) -> DataFrame:
    """Every document in its shard: its words are begin to end of the shard's, which lie in blocks low to
    high. The mix takes every block of the shard ``whole`` times and ``more`` of the shard's blocks once more:
    those whose rank is below more. The rank of block b is (b * step + shift) mod blocks, a permutation, as
    step is a prime above the number of blocks; the seed draws both."""
    size = F.coalesce(F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("long")
    draw = seeded("doc_id", F.coalesce(F.md5("text"), F.lit("")))
    sized = shared.settled(docs.select("doc_id", "source", size.alias("size"), draw.alias("draw")), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_repeat)
    sources = sources.withColumn("all_", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("all_")) / block).cast("long"))
    sources = apportioned(sources, ["all_"], "s", "target", "seats").withColumn("shards", F.greatest(F.lit(1), F.expr(f"n_docs div {SHARD_DOCS}")))
    sources = sources.select(F.col("source").alias("of"), "s", "source_size", "target", "shards", F.col("quota").alias("source_quota"))
    sources = shared.settled(sources, "sources")

    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.col("draw") % F.col("shards"))
    shards = placed.groupBy("s", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    shards = shared.settled(shards.filter("words > 0").withColumn("g", F.expr(f"shard div {GROUP_SHARDS}")), "shards")
    groups = shards.groupBy("s", "g").agg(F.sum("words").alias("group_words"), F.first("source_quota").alias("source_quota"))
    groups = apportioned(groups, ["s"], "g", "group_words", "source_quota").select("s", "g", F.col("quota").alias("group_quota"))
    shards = apportioned(shards.join(groups, ["s", "g"]), ["s", "g"], "shard", "words", "group_quota")
    shards = shards.withColumn("blocks", F.expr(f"(words + {block - 1}) div {block}"))
    wanted = F.least(F.col("blocks") * max_repeat, F.round(F.col("quota") * block * F.col("blocks") / F.col("words")).cast("long"))
    step = F.element_at(F.array(*map(F.lit, STEPS)), (seeded(F.lit("step"), "s", "shard") % len(STEPS) + 1).cast("int"))
    shards = shards.withColumn("wanted", wanted).withColumn("step", step).withColumn("shift", seeded(F.lit("shift"), "s", "shard"))
    shards = shards.select("s", "shard", "words", "blocks", F.expr("wanted div blocks").alias("whole"), F.expr("wanted % blocks").alias("more"), "step", "shift")

    line = Window.partitionBy("s", "shard").orderBy("doc_id", "size")
    lain = placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.expr("end - size"))
    lain = lain.join(shared.settled(shards, "quotas").hint("merge"), ["s", "shard"], "left")
    number = lambda x: F.expr(f"if(size > 0, (({x} + 1) * blocks - 1) div words, null)")  # noqa: E731  of the block that holds a word
    return lain.withColumn("low", number("begin")).withColumn("high", number("end - 1"))


#: Of block b of a shard: whether it is taken once more, its first word and the one after its last, both in the document.
_MORE = "((b * step + shift) % blocks < more)"
_FIRST, _AFTER = "greatest(0L, b * words div blocks - begin)", "least(size, (b + 1) * words div blocks - begin)"


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken."""
    extra = f"aggregate(filter(sequence(low, high), b -> {_MORE}), 0L, (n, b) -> n + {_AFTER} - {_FIRST})"
    taken = F.expr(f"if(size > 0, whole * size + {extra}, 0L)")
    return located(docs, weights, max_repeat, block).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, begin (in its shard), whole and runs of each document of which the mix takes
    words: how often it takes all of them, and (first, words) of each run of neighbouring blocks that it
    takes once more. A shard's blocks are taken n or n + 1 times, so that these are all. A document whose
    blocks are all taken once more is taken whole once more."""
    beside = lambda d: _MORE.replace("b *", f"(b {d} 1) *")
    starts = F.expr(f"transform(filter(sequence(low, high), b -> {_MORE} and (b = low or not {beside('-')})), b -> {_FIRST})")
    afters = F.expr(f"transform(filter(sequence(low, high), b -> {_MORE} and (b = high or not {beside('+')})), b -> {_AFTER})")
    out = located(docs).filter("size > 0").withColumn("starts", starts).withColumn("afters", afters)
    out = out.withColumn("every", F.expr("size(starts) = 1 and starts[0] = 0 and afters[0] = size"))
    found = F.expr("if(every, array(), zip_with(starts, afters, (a, z) -> named_struct('first', a, 'words', z - a)))")
    out = out.select("doc_id", "source", "size", "begin", F.expr("whole + cast(every as long)").alias("whole"), found.alias("runs"))
    return out.filter("whole > 0 or size(runs) > 0")


def materialised(docs: DataFrame) -> DataFrame:
    """The mix as documents: each as often as all its blocks are taken, and a row for each run of its
    blocks that is taken once more, from the run's first word to its last; all columns are kept, n_chars is
    counted anew where text is cut. Documents of one id, source and size meet their places in the order
    of their texts' hashes; texts are shuffled once, together with the places."""
    size = F.coalesce(F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), size.alias("__size"), F.lit(1).alias("__kind"), F.xxhash64("text").alias("__order"), F.struct(*docs.columns).alias("__row"))
    places = runs(docs).select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.lit(0).alias("__kind"), F.col("begin").alias("__order"), F.col("whole").alias("__whole"), F.col("runs").alias("__runs"))
    both = rows.filter("__size > 0").unionByName(places, allowMissingColumns=True)
    group = Window.partitionBy("__doc", "__source", "__size")
    nth = F.row_number().over(group.orderBy("__kind", "__order")) - F.col("__kind") * F.sum(1 - F.col("__kind")).over(group)
    pair = Window.partitionBy("__doc", "__source", "__size", "__nth").orderBy("__kind")
    both = both.withColumn("__nth", nth).withColumn("__whole", F.lag("__whole").over(pair)).withColumn("__runs", F.lag("__runs").over(pair)).filter("__kind = 1 and __whole is not null")

    text = F.col("__row.text")
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the white space before it
    piece = lambda w, r: F.array_join(F.slice(w, (r["first"] + 1).cast("int"), r["words"].cast("int")), "")
    begun = lambda w, r: F.when(r["first"] > 0, F.regexp_replace(piece(w, r), r"^[\x20\x09-\x0D]+", "")).otherwise(piece(w, r))
    # the words are found once per document, not once per run
    cut = F.element_at(F.transform(F.array(words), lambda w: F.transform("__runs", lambda r: F.struct(begun(w, r).alias("text"), F.lit(True).alias("cut")))), 1)
    whole = F.array_repeat(F.struct(text.alias("text"), F.lit(False).alias("cut")), F.col("__whole").cast("int"))
    taken = F.when(F.size("__runs") > 0, F.concat(whole, cut)).otherwise(whole)
    others = [x for x in docs.columns if x != "text"]
    out = both.select(*(F.col(f"__row.`{x}`").alias(x) for x in others), F.explode(taken).alias("__taken"))
    out = out.withColumn("text", F.col("__taken.text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__taken.cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents"))


_SEEDED = "('0x' || substr(md5('mix-1/' || {}), 1, 8))::BIGINT"

ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         {_SEEDED.format("coalesce(doc_id::VARCHAR, '') || '/' || coalesce(md5(text), '')")} AS draw
  FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][s % 3 + 1] AS weight, 3 * source_size AS lim FROM named
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS lv
  FROM weighed WINDOW w AS (ORDER BY lim::DOUBLE / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
  SELECT *, least(lim::DOUBLE, max(lv) OVER () * weight) AS target, greatest(1, n_docs // {SHARD_DOCS}) AS shards FROM levels
), listed AS (
  SELECT s, target, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, s) AS rank, round(tt / 32)::BIGINT AS seats
  FROM (SELECT s, target, sum(target) OVER () AS tt FROM aimed), LATERAL (SELECT unnest(range(0, ceil(target / 32)::BIGINT + 40)) AS k)
  WHERE target > 0
), source_quota AS (
  SELECT s, count(*) FILTER (rank <= seats) AS quota FROM listed GROUP BY s
), placed AS (
  SELECT z.doc_id, z.size, a.s, a.source_size, a.target, z.draw % a.shards AS shard
  FROM sized z JOIN aimed a ON z.source IS NOT DISTINCT FROM a.source
), shard_words AS (
  SELECT s, shard, shard // {GROUP_SHARDS} AS g, sum(size)::BIGINT AS words, ceil(sum(size)::DOUBLE / 32)::BIGINT AS blocks
  FROM placed GROUP BY s, shard HAVING sum(size) > 0
), group_words AS (
  SELECT s, g, sum(words)::BIGINT AS words FROM shard_words GROUP BY s, g
), group_listed AS (
  SELECT w.s, g, k, row_number() OVER (PARTITION BY w.s ORDER BY words::DOUBLE / (2 * k + 1) DESC, g) AS rank, quota AS seats
  FROM group_words w JOIN source_quota q ON w.s = q.s, LATERAL (SELECT unnest(range(0, 3 * words // 32 + 40)) AS k)
), group_quota AS (
  SELECT s, g, count(*) FILTER (rank <= seats) AS quota FROM group_listed GROUP BY s, g
), shard_listed AS (
  SELECT w.s, w.g, shard, k, quota AS seats,
         row_number() OVER (PARTITION BY w.s, w.g ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard) AS rank
  FROM shard_words w JOIN group_quota q ON w.s = q.s AND w.g = q.g, LATERAL (SELECT unnest(range(0, 3 * blocks + 3)) AS k)
), shard_quota AS (
  SELECT s, shard, count(*) FILTER (rank <= seats) AS quota FROM shard_listed GROUP BY s, g, shard
), wanted AS (
  SELECT w.s, w.shard, words, blocks, least(3 * blocks, round((quota * 32 * blocks)::DOUBLE / words)::BIGINT) AS wanted,
         [{", ".join(map(str, STEPS))}][{_SEEDED.format("'step/' || w.s || '/' || w.shard")} % {len(STEPS)} + 1] AS step,
         {_SEEDED.format("'shift/' || w.s || '/' || w.shard")} AS shift
  FROM shard_words w JOIN shard_quota q ON w.s = q.s AND w.shard = q.shard
), chosen AS (
  SELECT s, shard, block, words, blocks,
         wanted // blocks + ((block * step + shift) % blocks < wanted % blocks)::BIGINT AS times
  FROM wanted, LATERAL (SELECT unnest(range(0, blocks)) AS block)
), lain AS (
  SELECT *, sum(size) OVER (PARTITION BY s, shard ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM placed
)
SELECT doc_id, size, source_size, target,
       coalesce((SELECT sum((least(l.e, (c.block + 1) * c.words // c.blocks) - greatest(l.e - l.size, c.block * c.words // c.blocks)) * c.times)
                 FROM chosen c WHERE c.s = l.s AND c.shard = l.shard
                   AND (c.block + 1) * c.words // c.blocks > l.e - l.size AND c.block * c.words // c.blocks < l.e), 0)::BIGINT AS taken
FROM lain l
"""
