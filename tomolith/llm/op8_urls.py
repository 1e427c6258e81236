"""URL filters: explicit rules first, else logistic regression on hashed character n-grams.

The model reads the n-grams (3 to 5 bytes) of host and path, with marks for their borders,
in 2**16 weights; it is trained here, by gradient descent, from a small labelled table of
URLs: any table of (url, label) through ``read_labels`` (at most ``MAX_LABELS`` of its rows, by
hash), else the built-in one. Host, path and rules are column expressions; only the score is
computed in Arrow batches.

Null urls and urls without ``://`` have an empty host and path and are judged like any
other, very long ones whole. Of rules that fit the longest wins (no two of a length can fit one
url). Repeated rows and null ids are carried. An empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS_LOG2 = 16
GRAMS = (3, 4, 5)
MAX_LABELS = 100_000

# The rules (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Words that the built-in labelled table is made of. MILD ones are suspect in company only.
BAD_NAMES = (
    "casino poker bets betting jackpot slots roulette bingo gambling xxx porn adult escort webcam nude sexchat viagra cialis pills meds "
    "pharma steroids warez torrent cracked keygen serials hacks malware phishing ads adserver popads banner clickbank affiliate tracker spam linkfarm payday loans replica counterfeit"
).split()
MILD = "free win cheap hot best x track click farm fast bonus prize online now buy vip".split()
GOOD_NAMES = (
    "news library museum university science journal weather garden recipes history archive forum music travel physics health school poetry sports wiki "
    "blog city council hospital theatre bakery kitchen nature climate energy railway harbour village chess painting software hardware notes daily review market"
).split()
SITES = ("www.{}.com", "{}.example.com", "{}.net", "m.{}.example.org", "{}.example.net", "blog.{}.org")
PATHS = ("/en/{}", "/article/{}.html", "/de/{}/", "/{}?page=2", "/fr/docs/{}", "/2024/05/{}", "/es/{}#top", "/")


def _invented(i: int) -> str:
    """A word of two to four syllables that means nothing."""
    syllables = [c + v for c in "b d f g k l m n p r s t th v st".split() for v in "a e i o u an er in on".split()]
    return "".join(syllables[(i * (31 + 7 * k) + i // len(syllables) * (11 + 5 * k) + 17 * k) % len(syllables)] for k in range(2 + i % 3))


def labelled_urls() -> list[tuple[str, int]]:
    """The small table the model is trained from if no other is given: (url, 1 = to be blocked)."""
    names: list[tuple[str, int]] = []
    for k, bad in enumerate(BAD_NAMES):
        mild, good = MILD[k % len(MILD)], GOOD_NAMES[k % len(GOOD_NAMES)]
        names += [(x, 1) for x in (bad, f"{mild}-{bad}", f"{bad}-{MILD[(k + 5) % len(MILD)]}", f"{bad}{k}", f"my{bad}", f"{bad}-{good}")]
    for k, mild in enumerate(MILD):
        names += [(f"{mild}-{MILD[(k + j) % len(MILD)]}", 1) for j in (3, 7)] + [(f"{mild}-{GOOD_NAMES[k]}", 0)]
    for k, good in enumerate(GOOD_NAMES):
        names += [(x, 0) for x in (good, f"{good}-{GOOD_NAMES[(k + 11) % len(GOOD_NAMES)]}", f"the{good}", f"{good}{k}", f"{good}-{_invented(k)}")]
    names += [(_invented(i), 0) for i in range(600)]
    out = []
    for i, (name, label) in enumerate(names):
        for j in (i, i + 1 + i // len(PATHS)):
            path = PATHS[j % len(PATHS)].format(1000 + 37 * i % 9000)
            out.append((f"https://{SITES[j % len(SITES)].format(name)}{path}", label))
    return out


def read_labels(labels: DataFrame, url_col: str = "url", label_col: str = "label", most: int = MAX_LABELS) -> list[tuple[str, int]]:
    """(url, 0 or 1) of a table of labelled URLs; of more than ``most`` rows those with the least hashes, a sample that no order of the table biases.

    Rows without a url or a label are left out; any label above 0 means block.
    """
    known = labels.select(labels[url_col].cast("string").alias("u"), (labels[label_col] > 0).cast("int").alias("l")).dropna()
    return [(r.u, r.l) for r in known.orderBy(F.xxhash64("u"), "u", "l").limit(most).collect()]


def parts(url: Column) -> tuple[Column, Column]:
    found = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, found, 1), upper, upper.lower()), F.regexp_extract(url, found, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def features(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks as (first row, row of each n-gram, bucket of each n-gram)."""
    for c in K.chunks(col):
        rolling = K.Rolling(c.data)
        rows, buckets = [], []
        for n in GRAMS:
            count = np.maximum(np.diff(c.off) - n + 1, 0)
            start = K.slices_of(c.off[:-1], count)
            rows.append(np.repeat(np.arange(len(c)), count))
            buckets.append((rolling.slices(start, start + n) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64))
        yield c.first, np.concatenate(rows), np.concatenate(buckets)


def scores(col: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams of each string, plus the bias (the last weight)."""
    out = np.full(len(col), weights[-1])
    for first, row, bucket in features(col):
        n = int(row.max(initial=-1)) + 1
        total, count = np.bincount(row, weights[bucket], n), np.bincount(row, minlength=n)
        out[first : first + n] += total / np.sqrt(np.maximum(count, 1))
    return out


def _marked(host: str, path: str) -> str:
    return f"^{host}$^{path}$"


def train(rows: Sequence[tuple[str, int]], epochs: int = 30, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Weights of 2**16 buckets and a bias, by full-batch gradient descent with a step size for each weight; the same rows give the same weights."""
    import re

    texts, y = [], []
    for url, label in sorted(rows):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        texts.append(_marked(m[1].lower(), m[2]) if m else _marked("", ""))
        y.append(label)
    truth, col = np.array(y, float), pa.array(texts)
    found = list(features(col))
    row, bucket = np.concatenate([f + r for f, r, _ in found]), np.concatenate([b for _, _, b in found])
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    weights = np.zeros((1 << BUCKETS_LOG2) + 1)
    squares = np.full(len(weights), 1e-12)
    for _ in range(epochs):
        z = np.bincount(row, weights[bucket], len(y)) * scale + weights[-1]
        error = 1 / (1 + np.exp(-z)) - truth
        gradient = np.bincount(bucket, (error * scale)[row], len(weights)) / len(y)
        gradient[-1] = error.mean()
        gradient += decay * weights
        squares += gradient * gradient
        weights -= rate * gradient / np.sqrt(squares)
    return weights


@lru_cache(maxsize=1)
def default_weights() -> np.ndarray:
    return train(labelled_urls())


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", weights: np.ndarray | None = None) -> DataFrame:
    """page id, host, path, rule, verdict and the model's probability of block."""
    shared = pages.sparkSession.sparkContext.broadcast((default_weights() if weights is None else weights).tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value)
        for batch in batches:
            p = 1 / (1 + np.exp(-scores(batch.column(3), w)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], ["id", "host", "path", "score"])

    host, path = parts(pages[url_col])
    split = pages.select(pages[id_col].cast("long").alias("id"), host.alias("host"), path.alias("path"))
    scored = split.withColumn("marked", F.concat(F.lit("^"), "host", F.lit("$^"), "path", F.lit("$"))).mapInArrow(work, "id long, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), F.round("score", 6).alias("score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumnRenamed("id", "page_id")
