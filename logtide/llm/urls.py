"""URL filters: a blocked Bloom filter over listed canonical URLs, then an exact hash join of the possible hits.

A rule is a canonical URL prefix: a host, which also stands for its subdomains, and the start of a path. The
candidates of a URL are its host suffixes joined to the starts of its path that are as long as some rule's path;
the longest listed candidate decides, and a URL without one gets the default verdict.

The filter is an array of 64-bit blocks; a key sets `BITS` bits of one block, so a test reads one array entry. Its
size is a parameter, not a function of the data; a fuller filter lets more candidates through to the exact join but
never changes a result. The rules are joined by key as a table of any size: Spark broadcasts them only below its
size threshold. All of it is DataFrame functions.

Nulls: a null URL or one without `://` has an empty host and path and gets the default. Rules with a null host,
path or verdict are left out. Rules given twice: `block` wins over `allow`. Repeated rows get a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = 1 << 12
BITS = 4
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) from a short list."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _listed(rules: DataFrame) -> DataFrame:
    """(key, verdict, size), one row per canonical rule."""
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    return known.groupBy(F.concat(F.translate("host", _UPPER, _LOWER), "path").alias("key")).agg(
        F.max("verdict").alias("verdict"), F.max(F.length(F.concat("host", "path"))).alias("size")
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key within its block."""
    hashed = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(63).cast("int") for i in range(BITS)]
    mask = F.lit(0).cast("bigint")
    for bit in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def bloom_filter(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row with the array of the filter's blocks."""
    words = listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))
    every = listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    filled = every.join(words, "block", "left").select("block", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "word"))), lambda entry: entry["word"]).alias("words"))


def _candidates(name: Column, rest: Column, sizes: Column) -> Column:
    """Every host suffix with every start of the path that a rule could have."""
    labels = F.split(name, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(sizes, lambda n: n <= F.length(rest)), lambda n: F.substring(rest, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda suffix: F.transform(starts, lambda start: F.concat(suffix, start)))))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, blocks: int = BLOCKS, key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of the pages."""
    listed = _listed(rules)
    words = bloom_filter(listed, blocks).scalar()
    sizes = rules.where("path IS NOT NULL").agg(F.collect_set(F.length("path"))).scalar()
    # Rows that repeat both id and URL travel as one with their number.
    rows = pages.groupBy(F.col(key), F.col("url")).agg(F.count("*").alias("copies"))
    rows = rows.select(key, "url", "copies", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), sizes.alias("sizes"))
    spread = rows.select(key, "url", F.explode(_candidates(F.col("host"), F.col("path"), F.col("sizes"))).alias("key"))
    possible = spread.where(F.get(words, _block(F.col("key"), blocks)).bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    hits = possible.join(listed, "key").select(key, "url", F.struct("size", F.col("key").alias("rule"), "verdict").alias("best"))
    # Hits and URLs meet in one aggregation, where null ids and URLs are values like others.
    best = rows.drop("sizes").unionByName(hits, allowMissingColumns=True).groupBy(key, "url").agg(
        F.max("copies").alias("copies"), F.max("host").alias("host"), F.max("path").alias("path"), F.max("best").alias("best")
    )
    copies = best.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return copies.select(F.col(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


# The rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def sql() -> str:
    """The rows of `judged` with `RULES` in DuckDB's SQL."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    after = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://"
    lower = f"translate({after}([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    return f"""WITH r(h, p, v) AS (VALUES {values}),
    u AS (SELECT row_number() OVER () AS n, page_id, {lower} AS host, {after}[^/?#]*([^?#]*)', 1) AS path FROM pages),
    m AS (SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM u, r
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM u LEFT JOIN m USING (n)"""
