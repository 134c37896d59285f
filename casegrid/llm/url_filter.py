"""URL rules by a blocked Bloom filter and an exact hash join.

A rule (host, path) fits its host, all subdomains, and paths that start with
its own.  A url's possible keys (a host suffix with a path prefix, of the
shapes that occur among the rules) are tested against a blocked Bloom filter;
the keys that pass are joined exactly with the rules, which removes the false
positives, and the longest rule decides.  Only built-in functions are used.

Defined results: a null url, or one without ``://``, has an empty host and
path and fits no rule; a url that no rule fits gets the default verdict; equal
urls get equal verdicts, row by row; a null ``page_id`` is kept; of rules of
equal length the one with the longer host wins, then the greater text; rules
with equal keys count as one, block before allow; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import BROADCAST_IDS

#: Bits of the filter per rule, bits set per key, and the filter's largest size
#: in 64-bit blocks (8 MB): beyond it more keys pass, and the join still decides.
BITS_PER_RULE, HASHES, MOST_BLOCKS = 16, 4, 1 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    some = url.isNotNull() & (at > 0)
    # (?s): the parts may hold line ends.
    host = F.when(some, ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise("")
    path = F.when(some, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def _mask(host: Column, path: Column) -> Column:
    """The key's bits within its 64-bit block."""
    bits = F.xxhash64(path, host)
    out = None
    for i in range(HASHES):
        one = F.call_function("shiftleft", F.lit(1).cast("long"),
                              F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = one if out is None else out.bitwiseOR(one)
    return out


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks))


def bloom_filter(rules: DataFrame, blocks: int) -> list[int]:
    """The filter's blocks: an or per block, gathered (8 MB at most)."""
    host, path = F.col("rule_host"), F.col("rule_path")
    found = rules.groupBy(_block(host, path, blocks).alias("b")).agg(F.bit_or(_mask(host, path)).alias("m")).collect()
    out = [0] * blocks
    for r in found:
        out[r["b"]] = r["m"]
    return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``
    (page_id, url) under ``rules`` (verdict, host, path)."""
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = (rules.where("host IS NOT NULL AND path IS NOT NULL")
             .groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
             .agg(F.max("verdict").alias("rule_verdict")))
    n = keyed.count()
    if n == 0:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # The shapes: how many labels a rule's host has, how long its path is.
    shape = keyed.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
                      F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    blocks = max(1, min(MOST_BLOCKS, -(-n * BITS_PER_RULE // 64)))
    bloom = F.lit(bloom_filter(keyed, blocks))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.lit(shape["labels"]), F.size(labels))),
                        lambda k: F.array_join(F.slice(labels, -k, k), "."))
    lengths = F.filter(F.lit(list(shape["lengths"])), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.struct(
        h.alias("rule_host"), F.substring(F.col("path"), F.lit(1), n).alias("rule_path")))))

    def passes(k: Column) -> Column:
        h, p = k["rule_host"], k["rule_path"]
        mask = _mask(h, p)
        return F.element_at(bloom, (_block(h, p, blocks) + 1).cast("int")).bitwiseAND(mask) == mask

    tested = urls.withColumn("keys", F.filter(keys, passes))
    some = tested.where(F.size("keys") > 0)
    # One row per distinct (host, path): the verdict depends on nothing else,
    # and a common url is settled once.
    distinct = some.groupBy("host", "path").agg(F.first("keys").alias("keys"))
    hits = distinct.select("host", "path", F.inline("keys"))
    exact = hits.join(F.broadcast(keyed) if n <= BROADCAST_IDS else keyed, ["rule_host", "rule_path"])
    text = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(text).alias("n"), F.length("rule_host").alias("h"), text.alias("r"))
    best = exact.groupBy("host", "path").agg(
        F.max_by(F.struct(text.alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("best"))
    found = best.select(F.col("host").alias("h_"), F.col("path").alias("p_"), "best")
    judged = (some.drop("keys").join(found, (F.col("host") == F.col("h_")) & (F.col("path") == F.col("p_")), "left")
              .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
    clear = tested.where(F.size("keys") == 0).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(clear)
