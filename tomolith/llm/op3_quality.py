"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a built-in expression over the whole text; a rule compares two integer
sums, so SQL and Spark agree to the last row. No user functions, no shuffle.

Defined results: null text: no words, so base_failed. Words of any length, texts of any
length and any number of lines are counted whole. Repeated rows give repeated rows, ties play
no part. An empty table gives an empty result. Other columns pass through, whatever their
names; only columns named like the three results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native as N

# Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of to and in is was for that with as by on are this at from it be or an not "
    "de la le les et des en un une que est pour dans qui par sur au pas du avec "
    "el los las se por su una del con lo al y no "
    "der die und das den von zu mit sich ist im dem nicht ein eine auf als auch es für"
).split()
SYMBOLS = "#*$%&|<>"

#: name, left weight, left metric, comparison, right weight, right metric: a document passes if it holds.
RULES = (
    ("mean word length at least 2", 1, "word_chars", ">=", 2, "n_words"),
    ("mean word length at most 15", 1, "word_chars", "<=", 15, "n_words"),
    ("at most one symbol in ten words", 10, "n_symbols", "<=", 1, "n_words"),
    ("one stop word in fifty words", 50, "n_stop_words", ">=", 1, "n_words"),
    ("half of the lines said once", 2, "n_dup_lines", "<=", 1, "n_lines"),
)


def _repeat_words(words: Column) -> Column:
    """Words inside a window of three words that the text holds twice or more."""

    def counted(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + 3 - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))

        def among(w: Column) -> Column:  # most texts repeat no window, and need no sorting
            placed = F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(N.let(F.sort_array(placed), counted))

        return N.let(windows, among)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(N.let(F.transform(words, lambda w: F.xxhash64(w)), of))


def metrics(text: Column) -> Column:
    """All metrics of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = N.let(N.worded_lines(text), lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("unlike")))
        out = {
            "n_words": F.size(words),
            "word_chars": F.length(N.without_white(text)),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_lines": lines["all"],
            "n_dup_lines": lines["all"] - lines["unlike"],
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            "n_repeat_words": _repeat_words(words),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in out.items()])

    return N.let(N.words(text), of)


def judged(m: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) of a struct of metrics."""
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    passes = [(a * m[x] >= b * m[y]) if op == ">=" else (a * m[x] <= b * m[y]) for _, a, x, op, b, y in rules]
    return base, ~base & reduce(lambda p, q: p & q, passes, F.lit(True))


def with_verdict(docs: DataFrame, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """The documents with the structs ``_m`` (metrics), ``_base_failed`` and ``_kept``."""
    out = docs.withColumn("_m", metrics(docs[text_col]))
    base, kept = judged(F.col("_m"), rules)
    return out.withColumns({"_base_failed": base, "_kept": kept})


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
    return with_verdict(docs).select("doc_id", *[F.col("_m")[k].alias(k) for k in names], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def rules_sql(source: str) -> str:
    """The same judgement in DuckDB's SQL, over a relation with doc_id and text."""
    sign = " AND ".join(f"{a} * {x} {op} {b} * {y}" for _, a, x, op, b, y in RULES)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    white = "[\\x20\\x09-\\x0D]"
    return f"""
WITH q_in AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
q_words AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{white}+'), lambda x: x <> '') AS w FROM q_in),
q_at AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM q_words),
q_three AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM q_at WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
q_win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM q_three WHERE z IS NOT NULL),
q_rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM q_win WHERE c > 1) GROUP BY doc_id),
q_lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM q_in) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
q_all AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{white}', '', 'g'))::BIGINT AS word_chars,
          (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
          coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
          len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
          FROM q_words d LEFT JOIN q_rep USING (doc_id) LEFT JOIN q_lines USING (doc_id)),
q_base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q_all)
SELECT *, NOT base_failed AND {sign} AS kept FROM q_base"""


SQL = rules_sql("documents")
