"""Cross-site boilerplate: lines spread over many distinct sites, removed with DataFrame functions only.

A line is what stands between line feeds, compared without the white space at
its ends. One aggregation merges a HyperLogLog sketch of sites for every line
hash. Estimates clearly under or over ``min_sites`` decide; lines within the
sketch's error of it (three standard errors and one site more) get an exact
count of distinct sites. Lines on ``min_sites`` sites or more are boilerplate.

A document loses its boilerplate lines, unless they hold more than
``copy_share`` of its non-blank characters: then it is a copy of a widely copied
document and not a page with chrome around it, and near-duplicate removal keeps
one of its kind; taking its lines would lose the document itself.

Rows: a null text stays null and has no lines; blank lines are never boilerplate;
a null site counts as no site; equal rows are kept as they are, ``doc_id`` need
not be unique or present. Extra columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, materialize

MIN_SITES = 10
COPY_SHARE = 0.5
LG_K = 12
COMMON = 256  # lines told by a list at most

ORACLE = """
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(line, chr(32) || chr(9) || chr(13)) AS key
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)
), spread AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT doc_id, pos, line, length(lines.key) AS chars, spread.key IS NOT NULL AS bad FROM lines LEFT JOIN spread ON lines.key = spread.key
), per_doc AS (
  SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS n_bad, sum(chars) AS chars, sum(CASE WHEN bad THEN chars ELSE 0 END) AS bad_chars,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN n_bad > 0 AND bad_chars <= 0.5 * chars THEN kept ELSE text END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(CASE WHEN n_bad > 0 AND bad_chars <= 0.5 * chars THEN n_bad ELSE 0 END AS BIGINT) AS n_removed,
       CAST(coalesce(n_bad, 0) AS BIGINT) AS n_spread
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(" \t\r")))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """line, n: the hash of every line found on at least ``min_sites`` distinct sites, and how often it stands."""
    lines = docs.select(F.col("source").cast("string").alias("site"), F.explode(F.split("text", "\n")).alias("raw")).where((F.trim("raw", F.lit(" \t\r")) != "") & F.col("site").isNotNull()).select(_key(F.col("raw")).alias("line"), "site")
    # A line seen fewer times than that cannot be on so many sites.
    seen = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n")).where(F.col("n") >= min_sites)
    estimated = seen.select("line", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    slack = math.ceil(3 * 1.04 / math.sqrt(1 << lg_k) * min_sites) + 1
    near = estimated.where(F.col("sites").between(min_sites - slack, min_sites + slack)).select("line")
    # Counted by line and site first, a line has a row a site when it meets the near ones.
    exact = lines.groupBy("line", "site").agg(F.count("*").alias("n")).join(near, "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites"), F.sum("n").alias("n")).where(F.col("sites") >= min_sites)
    return estimated.where(F.col("sites") > min_sites + slack).select("line", "n").union(exact.select("line", "n"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, copy_share: float = COPY_SHARE) -> DataFrame:
    """The documents without cross-site boilerplate lines, and three more columns: n_lines, n_removed and n_spread."""
    docs = docs.drop("n_lines", "n_removed", "n_spread")
    text_key, bad, kept = (fresh(n, docs) for n in ("text_key", "bad", "kept"))
    trimmed = lambda l: F.trim(l, F.lit(" \t\r"))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, l: s + F.length(trimmed(l)))
    lines = F.split("text", "\n")
    # Lines of each text; a text's hash finds it again, so no row needs an id of its own.
    keys = F.array_distinct(F.filter(F.transform(lines, lambda l: F.when(trimmed(l) != "", _key(l))), lambda k: k.isNotNull()))
    spread = materialize(spread_lines(docs, min_sites))
    total = spread.agg(F.sum("n")).first()[0] or 0
    common = [r["line"] for r in spread.where(F.col("n") * COMMON >= total).select("line").collect()]  # COMMON rows at most
    is_common = (lambda k: k.isin(common)) if common else (lambda k: F.lit(False))
    wanted = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias(text_key), F.explode(F.filter(keys, lambda k: ~is_common(k))).alias("line"))
    hits = wanted.join(spread.where(F.col("n") * COMMON < total).select("line"), "line").groupBy(text_key).agg(F.collect_set("line").alias(bad))
    marked = docs.withColumn(text_key, F.xxhash64("text")).join(hits, text_key, "left").drop(text_key)
    told = F.filter(keys, is_common)
    marked = marked.withColumn(bad, F.when(F.col(bad).isNotNull() | (F.size(told) > 0), F.concat(F.coalesce(F.col(bad), F.array().cast("array<bigint>")), told)))
    rest = F.filter(lines, lambda l: ~F.array_contains(bad, _key(l)) | (trimmed(l) == ""))
    some = marked.withColumn(kept, F.when(F.col(bad).isNotNull() & F.col("text").isNotNull(), rest))
    cut = F.col(kept).isNotNull() & (chars(lines) - chars(F.col(kept)) <= copy_share * chars(lines))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    n_spread = F.when(F.col(kept).isNotNull(), n_lines - F.size(kept)).otherwise(0).cast("bigint")
    counted = some.withColumn("n_lines", n_lines).withColumn("n_spread", n_spread).withColumn("n_removed", F.when(cut, F.col("n_spread")).otherwise(0).cast("bigint"))
    return counted.withColumn("text", F.when(F.col("n_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).drop(kept, bad)
