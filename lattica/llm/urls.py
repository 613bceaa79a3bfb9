"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed URL is host and path, such as `example.net/en/`; it fits the host and all its subdomains, if the url's path
starts with the listed path. A url's candidates are its host's domain suffixes with those prefixes of its path that are
as long as some listed path. Candidates that the Bloom filter, of fixed size, may hold go into a hash join with the list,
which removes false positives; the longest listed URL that fits decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.llm import staging
from lattica.llm.bytetext import mix

#: Listed URLs and what they say: fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: What the method says where no listed URL fits.
DEFAULT = "allow"
#: Blocks of 512 bits: 4 MB in all, whatever the length of the list; bits set for each URL, all in one block.
BLOCKS, PROBES = 1 << 16, 6
#: Parts into which the hits of one listed URL are dealt: SALTS at least, one for each SALT_BYTES of pages, SALTS_MOST at most.
SALTS, SALT_BYTES, SALTS_MOST = 8, 1 << 30, 1024


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(rule, verdict)."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def host_of(url) -> F.Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url) -> F.Column:
    """After the host up to `?`, `#` or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bloom_places(hashes):
    """(block, bit) of each probe of 64-bit hashes, as lists of arrays: the top bits choose the block, others the bits."""
    h = mix(hashes.astype(np.uint64))
    block = (h >> np.uint64(48)).astype(np.int64) % BLOCKS
    again = mix(h + np.uint64(1))
    return block, [((again >> np.uint64(9 * k)) & np.uint64(511)).astype(np.int64) for k in range(PROBES)]


def bloom(keys: DataFrame) -> bytes:
    """The filter of the 64-bit hashes in the column `h`: at most BLOCKS * 8 words reach the driver."""

    def places(batches):
        for pdf in batches:
            block, bits = bloom_places(pdf["h"].to_numpy())
            word = np.concatenate([block * 8 + (b >> 6) for b in bits]) if len(pdf) else np.zeros(0, np.int64)
            bit = np.concatenate([np.left_shift(np.int64(1), b & 63) for b in bits]) if len(pdf) else np.zeros(0, np.int64)
            yield pd.DataFrame({"word": word, "bit": bit})

    rows = keys.mapInPandas(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BLOCKS * 8, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.tobytes()


def may_hold(data: bytes, hashes) -> np.ndarray:
    """Whether the filter may hold each hash."""
    words = np.frombuffer(data, np.int64)
    block, bits = bloom_places(hashes)
    ok = np.ones(len(hashes), bool)
    for b in bits:
        ok &= (words[block * 8 + (b >> 6)] >> (b & 63)) & 1 == 1
    return ok


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict), one row for each row of pages.

    rule is the longest listed URL that fits, null where none does; of equally long ones the one with the longer host,
    then the first by code point; a URL listed twice blocks if either row does. Null urls and urls without `://` have an
    empty host and path and fit nothing but a rule whose host and path are empty, which is dropped. Null rules are
    dropped; rows that share an id and a url are alike, and each is returned. Other columns of pages are not read.
    """
    spark = pages.sparkSession
    # a rule without a slash has a host only
    listed = (
        rules.filter("rule IS NOT NULL AND rule <> ''")
        .groupBy("rule")
        .agg(F.min(F.struct((F.col("verdict") != "block").alias("kind"), "verdict"))["verdict"].alias("verdict"))
        .select(
            "rule",
            "verdict",
            F.translate(F.regexp_extract("rule", "^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"),
            F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1).alias("rule_path"),
        )
        .withColumn("key", F.concat_ws("", "rule_host", "rule_path"))
        .withColumn("h", F.xxhash64("key"))
    )
    # lengths of listed paths: as many as there are lengths, not URLs
    lengths = sorted(r[0] for r in listed.select(F.length("rule_path")).distinct().collect())
    held = spark.sparkContext.broadcast(bloom(listed.select("h")))

    @F.arrow_udf("array<boolean>")
    def possible(hashes: pa.Array) -> pa.Array:
        """Of each url, which of its candidates' hashes the filter may hold."""
        ends = hashes.offsets.to_numpy()
        own = hashes.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(may_hold(held.value, own), pa.bool_()))

    salts = min(staging.pieces_for(pages, SALT_BYTES, SALTS), SALTS_MOST)
    # rows that repeat an id and a url go through once; the tag is never null
    tag = F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")), F.lit("\n"), F.coalesce("url", F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumn("tag", tag)
    rows = rows.groupBy("tag", "id", "url").agg(F.count(F.lit(1)).alias("copies"))
    parsed = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths))) if lengths else F.array().cast("array<string>")
    # all candidates of a url stay in one row until the filter has dropped those that aren't listed
    candidates = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("rule_host"), p.alias("rule_path")))))
    tried = parsed.filter(F.col("url").contains("://")).select("tag", candidates.alias("candidates"))
    tried = tried.withColumn("ok", possible(F.transform("candidates", lambda c: F.xxhash64(F.concat(c["rule_host"], c["rule_path"])))))
    held_ones = F.filter("candidates", lambda c, i: F.get("ok", i))
    hits = tried.select("tag", F.explode(held_ones).alias("c")).select("tag", "c.*")
    # the hits of one listed URL may be very many: they are dealt to many tasks
    salted = listed.select("rule_host", "rule_path", "rule", "verdict").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    order = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), F.transform(F.split("rule", ""), lambda c: -F.ascii(c)).alias("o"), "rule", "verdict")
    best = (
        hits.withColumn("salt", F.pmod(F.xxhash64("tag"), F.lit(salts)).cast("int"))
        .join(salted, ["rule_host", "rule_path", "salt"])
        .groupBy("tag")
        .agg(F.max(order).alias("best"))
    )
    both = parsed.join(best, "tag", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return both.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


#: The contract's rule in DuckDB SQL.
ORACLE = r"""
WITH r(rule, verdict, rh, rp) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
