"""Line dedup by distinct-site spread.

Lines that stand on many sites are boilerplate. Lines are known by two 64-bit hashes. One aggregation gives a row for
each line and site; which lines are boilerplate is found from that table, so that a line that a third of all documents
hold has no more rows than there are sites. Lines of one site fall out by a plain minimum and
maximum. For the others HyperLogLog sketches of their sites are built and merged by aggregation. An estimate well above
or below the threshold decides; lines near it get an exact distinct count. Every occurrence of a boilerplate line but the
first in the corpus is removed. Lines that many documents hold are joined by broadcast, the others by shuffle. Everything
runs in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, attach, by_place, read_table

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers: 1.6 % relative standard error.
LG_K = 12
#: Estimates within this ratio of the threshold are counted exactly: over ten standard errors.
NEAR = 1.25
#: What is trimmed off a line before it is compared.
SPACE = " \t\r\x0b\x0c"

KEY = ["k1", "k2"]
#: Keys up to which a list is sent to all tasks; of longer ones only the heavy keys are.
LISTED = 200_000


def _lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, site, doc_id, at): a row per line that isn't blank."""
    line = F.btrim(F.col("line"), F.lit(SPACE))
    return docs.select("doc_id", F.xxhash64(F.coalesce("site", F.lit(""))).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(
        line != "").select(F.xxhash64(line).alias("k1"), F.xxhash64(line, F.lit(1)).alias("k2"), "site", "doc_id", "at")


def boilerplate(docs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """(k1, k2, n): keys of the lines of docs (doc_id, site, text) on min_sites sites or more, and their occurrences."""
    spots = scratch.keep(_lines(docs).groupBy(*KEY, "site").agg(F.count("*").alias("n")), "spots")
    spread = spots.groupBy(*KEY).agg(F.min("site").alias("low"), F.max("site").alias("high"), F.sum("n").alias("n"), F.count("*").alias("rows"))
    spread = scratch.keep(spread.where("low <> high").select(*KEY, "n", "rows"), "spread")
    shared = attach(spots.select(*KEY, "site"), spread.select(*KEY, F.col("rows").alias("n")), KEY, *_size(spread, "rows"), LISTED)
    # A row per line, site and task at most goes on to the sketches.
    sketched = shared.groupBy(*KEY).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    judged = sketched.select(*KEY, F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") * NEAR >= min_sites).join(spread, KEY)
    judged = scratch.keep(judged, "sketched")
    near = judged.where(F.col("sites") < min_sites * NEAR).select(*KEY, F.col("rows").alias("n"))
    counted = attach(spots.select(*KEY, "site"), near, KEY, *_size(near, "n"), LISTED).groupBy(*KEY).agg(F.count("*").alias("exact"))
    known = judged.join(counted, KEY, "left").where((F.col("sites") >= min_sites * NEAR) | (F.col("exact") >= min_sites)).select(*KEY, "n")
    out = scratch.keep(known, "boilerplate")
    scratch.drop(spots, spread, judged)
    return out


def _size(keys: DataFrame, n: str) -> tuple[int, int]:
    """Keys, and rows that have one."""
    return tuple(keys.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first())


def _removals(docs: DataFrame, min_sites: int) -> DataFrame:
    """(gone_id, gone): for each document that loses lines the places of those, from 0; docs: (doc_id, site, text)."""
    scratch = Scratch(docs.sparkSession, "lines")
    keys = boilerplate(docs, scratch, min_sites)
    size = _size(keys, "n")
    hits = scratch.keep(attach(_lines(docs).select(*KEY, "doc_id", "at"), keys, KEY, *size, LISTED), "hits")
    first = hits.groupBy(*KEY).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    # Equality of structs that may hold a null id.
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    gone = attach(hits, scratch.keep(first, "first"), KEY, *size, LISTED).where(later)
    return gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("at").alias("gone"))


def _kept(text_col: str):
    return F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and kept (the lines left) of every row of docs.

    Lines end at line feeds and are compared without surrounding white space; blank lines always stay. A boilerplate
    line stays where it comes first, by id and place (a null id comes first of all). A null site counts as the site ''.
    A null text has no lines and keeps ''. Rows that repeat an id lose the same places. Other columns are ignored; an
    empty table gives an empty result."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    met = docs.join(_removals(docs, min_sites), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    return met.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(_kept("text"), F.lit("")).alias("kept"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs (doc_id, source, text and any other columns) with the lines left as text, and n_chars, if it is there, as
    their length; null texts stay null, as do the other columns and all rows. See dedup_lines for what a line is."""
    plain, name = by_place(docs)
    doc_id, site, text = (F.col(name(c)) for c in ("doc_id", "source", "text"))
    gone = _removals(plain.select(doc_id.alias("doc_id"), site.cast("string").alias("site"), text.alias("text")), min_sites)
    met = plain.join(gone, doc_id.eqNullSafe(F.col("gone_id")), "left").withColumn(name("text"), _kept(name("text")))
    if "n_chars" in [c.lower() for c in docs.columns]:
        own = name("n_chars")
        met = met.withColumn(own, F.when(F.col("gone").isNull(), F.col(own)).otherwise(F.length(name("text"))).cast(dict(plain.dtypes)[own]))
    return met.select(*plain.columns).toDF(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, i AS pos, l[i] AS line, trim(l[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS t
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))),
boilerplate AS (SELECT t FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= 10),
marked AS (
  SELECT lines.*, b.t IS NOT NULL AND row_number() OVER (PARTITION BY lines.t ORDER BY doc_id, pos) > 1 AS gone
  FROM lines LEFT JOIN boilerplate b ON b.t = lines.t),
kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS k
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
