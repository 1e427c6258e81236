"""Line dedup: lines that stand on many sites are boilerplate and go.

A line's *spread* is the number of distinct sites it stands on, over all its occurrences.
It is estimated with one HyperLogLog sketch per line hash, merged by aggregation from map
side sketches; only lines whose estimate lies within three standard errors of the threshold
get an exact distinct count. Marking joins the few boilerplate keys back to the lines under
a salt, so that a line which a third of all documents carry is dealt over many tasks.

By this definition the lines of a document that is copied to ``min_sites`` sites go in all
its copies. Where copies are dealt with elsewhere (as in a pipeline that removes near
duplicates later), ``spare`` keeps them: a document of which boilerplate would be more than
that share of the non-white characters is a copy rather than a page with a footer, and is left whole.

Lines are compared without surrounding white space; lines without a word are neither
counted nor removed. Sites: the source column, null being a site of its own. Rows are told
apart by id and text, so repeated rows and null ids are kept as they are, ties need no
order. Null text: no lines. Texts of any length are read whole. Empty table: empty result.
Other columns pass through, whatever their names; only columns named like the three results
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native as N

MIN_SITES = 8
LG_K = 12
#: Tasks that the occurrences of one line are dealt over; a boilerplate key is sent to each, and has at least MIN_SITES occurrences.
SALT = 16


def _lines(text: Column) -> Column:
    """Worded lines as (h, g, i): two hashes and the place among all lines."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.btrim(x, F.lit(N.WHITE)).alias("s"), i.alias("i")))
    worded = F.filter(trimmed, lambda x: x["s"] != "")
    return F.transform(worded, lambda x: F.struct(F.xxhash64(x["s"]).alias("h"), F.hash(x["s"]).alias("g"), x["i"].alias("i")))


def _among(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose (h, g) is one of ``keys``."""
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return lines.join(salted, ["h", "g", "salt"], "left_semi")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (h, g) of lines of columns h, g, site, salt that stand on ``min_sites`` distinct sites or more."""
    error = 3 * 1.04 / 2 ** (LG_K / 2)
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.select("h", "g", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= min_sites * (1 - error))
    near = spread.where(F.col("n") <= min_sites * (1 + error)).select("h", "g")
    sites = _among(lines, near).select("h", "g", "site").distinct()
    exact = sites.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(F.col("n") > min_sites * (1 + error)).select("h", "g").unionByName(exact.select("h", "g"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, spare: float | None = None) -> DataFrame:
    """The documents with _n_lines (worded), _n_removed and _kept, the text left."""
    results = ("_n_lines", "_n_removed", "_kept")
    passed = [c for c in docs.columns if c not in results]
    key, th, marked = N.fresh(docs, "key", "th", "marked")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({key: F.col(id_col), th: F.xxhash64(text)})
    lines = keyed.select(
        F.col(key).alias("id"), F.col(th).alias("th"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit(""))).alias("site"), F.pmod(F.xxhash64(key, th), F.lit(SALT)).cast("int").alias("salt"), F.inline(_lines(text))
    )
    bad = boilerplate(lines.select("h", "g", "site", "salt"), min_sites)
    marks = _among(lines.select("id", "th", "h", "g", "i", "salt"), bad).groupBy("id", "th").agg(F.collect_set("i").alias(marked))
    joined = keyed.join(marks, keyed[key].eqNullSafe(marks["id"]) & (keyed[th] == marks["th"]), "left").drop(marks["id"], marks["th"])

    def left(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(marked)), lambda i: parts[i]), "\n")

    whole = F.struct(text.alias("kept"), F.lit(0).cast("long").alias("n"))
    cut = F.struct(N.let(F.split(text, "\n", -1), left).alias("kept"), F.size(marked).cast("long").alias("n"))
    if spare is not None:
        size = lambda x: F.length(N.without_white(x))
        cut = N.let(cut, lambda c: F.when(size(c["kept"]) < (1 - spare) * size(text), whole).otherwise(c))
    got = F.when(F.col(marked).isNull(), whole).otherwise(cut)
    out = joined.withColumn(marked, got)
    return out.select(*[F.col(f"`{c}`") for c in passed], F.size(N.worded_lines(text)).cast("long").alias("_n_lines"), F.col(f"{marked}.n").alias("_n_removed"), F.col(f"{marked}.kept").alias("_kept"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = remove_boilerplate(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
t AS (SELECT *, trim(raw, {_WHITE}) AS s FROM l),
b AS (SELECT s FROM t WHERE s <> '' GROUP BY s HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT t.*, s IN (SELECT s FROM b) AS bad FROM t)
SELECT doc_id, count(*) FILTER (WHERE s <> '') AS n_lines, count(*) FILTER (WHERE bad) AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
