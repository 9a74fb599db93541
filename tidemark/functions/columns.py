"""Column functions: key hashing, canonical JSON, ids, paths, text and vectors. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTITIONS = 64
SEPARATOR = " > "

# Stop words by language.
STOPWORDS = {
    "en": "the and for with of to in is on a an your this that it are be you from by or",
    "de": "der die das und für mit ein eine nicht ist von zu den dem auf",
    "fr": "le la les et pour avec une des du est dans sur",
    "es": "el los las y para con una del es en por",
    "it": "il gli e per con una della di che",
    "pt": "o os e para com uma do da em",
    "nl": "de het een en voor met van is op",
    "sv": "och för med en ett av är på",
}
ENGLISH_WORDS = sorted(set(STOPWORDS["en"].split()))
OTHER_WORDS = sorted({w for k, x in STOPWORDS.items() if k != "en" for w in x.split()} - set(ENGLISH_WORDS))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def partition_of(merchant: Column | str, product: Column | str) -> Column:
    """The key's partition: its SHA-256's first eight bytes mod 64, which is their last byte's low bits.
    A merchant with a slash has none."""
    digest = F.sha2(F.concat(col(merchant), F.lit("/"), col(product)), 256)
    low = (F.conv(F.substring(digest, 15, 2), 16, 10).cast("int") % PARTITIONS).cast("int")
    return F.when(~F.contains(col(merchant), F.lit("/")), low)


def owner(partition: Column | str, workers: Column | int) -> Column:
    """The worker of a partition when partitions are dealt in contiguous blocks."""
    workers = F.lit(workers) if isinstance(workers, int) else workers
    return F.floor(col(partition) * workers / PARTITIONS).cast("int")


def owned(worker: Column, workers: Column) -> tuple[Column, Column]:
    """The block [first, after) of a worker."""
    return F.ceil(worker * PARTITIONS / workers).cast("int"), F.ceil((worker + 1) * PARTITIONS / workers).cast("int")


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def canonical(content: Column) -> Column:
    """A listing's content as compact JSON with sorted keys and unescaped letters; null is ``null``."""
    names = ["attributes", "availability", "currency", "description", "price_micros", "title"]
    body = F.struct(*(sorted_map(content[x]).alias(x) if x == "attributes" else content[x].alias(x) for x in names))
    return F.when(content.isNull(), F.lit("null")).otherwise(F.to_json(body, {"ignoreNullFields": "false"}))


def content_hash(content: Column) -> Column:
    return F.sha2(canonical(content), 256)


def attributes_text(m: Column) -> Column:
    """A map as stored: sorted keys, a space after each comma and colon."""
    quoted = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    items = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.when(m.isNotNull(), F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")))


def uuid7(ms: Column, seed: Column) -> Column:
    """A version 7 UUID: 48 bits of milliseconds, the rest from a hash of seed."""
    time, rest = F.lpad(F.lower(F.hex(ms)), 12, "0"), F.sha2(seed.cast("string"), 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(rest, 4, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(rest, 1, 3), F.lit("-"), variant, F.substring(rest, 5, 3), F.lit("-"), F.substring(rest, 9, 12))


def uuid_ms(uuid: Column) -> Column:
    """The milliseconds in a version 7 UUID, one of a backfill included."""
    bare = F.regexp_replace(F.regexp_replace(uuid, "^backfill-", ""), "-", "")
    return F.conv(F.substring(bare, 1, 12), 16, 10).cast("long")


def hour(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH")


def cut(text: Column, n: int) -> Column:
    """text within n characters, cut at the last space within them, else hard."""
    head = F.rtrim(F.regexp_extract(F.substring(text, 1, n + 1), r"^(?s)(.*) ", 1))
    return F.when(F.length(text) <= n, text).when(head != "", head).otherwise(F.substring(text, 1, n))


def levels(path: Column, depth: Column | int) -> Column:
    """A path's first levels as an array."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.slice(F.split(path, SEPARATOR), F.lit(1), depth)


def ancestor(path: Column, depth: Column | int = 3) -> Column:
    return F.array_join(levels(path, depth), SEPARATOR)


def english(text: Column) -> Column:
    """Under 3% of letters beyond ASCII, and more English stop words than others', or none of either."""
    letters, ascii_ = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit("[A-Za-z]"))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    en, other = hits(ENGLISH_WORDS), hits(OTHER_WORDS)
    return ((letters == 0) | ((letters - ascii_) / letters < 0.03)) & ((en > other) | ((en == 0) & (other == 0)))


def shape_id(title: Column, description: Column) -> Column:
    return F.substring(F.sha2(F.concat(title, F.lit("\n"), description), 256), 1, 16)


def recipe(title: Column, description: Column, n: int) -> Column:
    """What a classifier reads: the title and the description's first n characters."""
    return F.trim(F.concat_ws(" ", title, F.substring(description, 1, n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length, or over 1e-12 if that is greater."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def version(*parts: Column | str) -> Column:
    return F.concat_ws("+", *(F.lit(p) if isinstance(p, str) else p for p in parts))
