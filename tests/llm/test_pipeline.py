from __future__ import annotations

import hashlib
import os
import subprocess
import sys

import corpus_pipeline
import duckdb
from tests.llm import brute
from tomolith.llm import op2_decontaminate, op3_quality, op10_jaccard, registry
from pyspark.sql import functions as F


def kept_by_hand(rows, items, spark):
    """Documents before packing, by the plain versions: rows are (doc_id, text, source)."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    good = {r.doc_id for r in op3_quality.with_verdict(df).where("_kept").collect()}
    assert {d for d, *_, base in brute.quality([(d, t) for d, t, _ in rows]) if base} & good == set()
    rows = [r for r in rows if r[0] in good]
    changed = {r[0]: r[3] for r in brute.lines(rows)}
    left = [(d, t) for d, t, _ in rows]
    assert all(brute.sha(t) == changed[d] for d, t in left), "this fixture has no boilerplate"
    left = [(d, t) for d, t in left if dict((x, c) for x, _, c in brute.components(left))[d] == d]
    index = op2_decontaminate.Index(items)
    return sorted(d for d, t in left if not index.search(t, op2_decontaminate.THRESHOLD))


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 4000).limit(90)
    docs.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("item_id", "text").collect()]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = kept_by_hand(rows, items, spark)
    assert sorted({r.doc_id for r in out}) == want and 0 < len(want) < len(rows)
    size = {d: len(brute.WORDS.findall(t)) for d, t, _ in rows}
    for d in want:
        assert sum(r.n_words for r in out if r.doc_id == d) == size[d]


def test_stages_keep_the_columns(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    docs = spark.createDataFrame([(1, None, "en", "s", None), (None, "", None, None, 0), (2, "a word " * 40, "en", "s", 9), (2, "a word " * 40, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, docs, sf_dir).columns) == corpus_pipeline.COLUMNS
    once = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted((r.doc_id for r in once.collect()), key=str) == [1, 2, None]


def test_stages_of_an_empty_table_and_of_odd_rows(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long, _n_removed long, k long, _kept string, th long"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], kind), sf_dir).collect() == []
    long = " ".join(f"w{i % 9000} the" for i in range(40_000))
    rows = [(1, long, "en", None, 1), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "other text of the same id", "en", "s", 3), (3, long + " end", None, "s", 1)]
    docs = spark.createDataFrame([(*r, 7, 8, "z", 9) for r in rows], kind)
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        sizes.append(sorted((r.doc_id or 0, len(r.text or "")) for r in out.collect()))
    whole = sorted((r[0] or 0, len(r[1] or "")) for r in rows)
    assert sizes[1] == whole and sizes[3] == whole and sizes[2] == [x for x in whole if x[0] != 3] and {d for d, _ in sizes[0]} <= {1, 3}
    packed = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    assert sum(r.n_words for r in packed) == sum(len(brute.WORDS.findall(r[1] or "")) for r in rows)


def test_line_spread_is_counted_whole(spark, sf_dir):
    """A block of two lines ends texts of ten sites; copies and near copies of one text stand on twelve; seven texts of seven sites share a line."""
    text = lambda k: [" ".join(f"{k}x{i}y{j}" for j in range(8)) for i in range(6)]
    block = ["Read more on our pages.", "All rights reserved."]
    rows = [(i, "\n".join(text(i) + block), f"s{i % 10}") for i in range(20)]
    near = [[*text(100)[:5], text(100)[5] + f" {k}"] for k in range(24)]
    rows += [(100 + k, "\n".join(t), f"s{k % 12}") for k, t in enumerate(near)]
    rows += [(200 + k, "\n".join(["Share this page.", *text(200 + k)]), f"s{k % 7}") for k in range(14)]
    rows += [(None, "\n".join(text(300) + block), None)]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf_dir).collect()}
    assert got == {d: t.removesuffix("\n" + "\n".join(block)) for d, t, _ in rows}


def test_contaminated_row_takes_no_other_row_of_its_id(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "clean of no id"), (1, f"some {item} more"), (1, "clean of a shared id"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_near_copies_at_five_words_and_80_percent(spark, sf_dir):
    one = [f"v{i}" for i in range(45)]
    less = [*one[:20], "other", *one[21:]]  # shares 36 of 46 shingles of five words (0.783), 38 of 46 of four (0.826): no copy
    ends = [f"u{i}" for i in range(45)]
    tail = [*ends[:41], "x", "y", "z", "q"]  # 37 of 45 (0.822) and 38 of 46 (0.826): a copy here, none at four words and 85 %
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate([one, less, ends, tail])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [0, 1, 2]
    assert sorted(r.component_id for r in op10_jaccard.near_duplicates(docs).collect()) == [0, 1, 2, 3]


def shuffled_bytes(spark):
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_copies_leave_other_documents_in_place(spark, sf_dir, tmp_path):
    """Texts that nothing is like are not dealt out; copies, repeated rows and rows without words are told apart as before."""
    text = lambda k: " ".join(hashlib.sha512(f"{k} {i}".encode()).hexdigest() for i in range(300))
    rows = [(k, text(k), "s") for k in range(60)]
    rows += [(60 + k, text(k) + " end", "s") for k in range(3)] + [(1, text(1), "a"), (70, text(2), "s"), (71, "", "s"), (72, " ", "s"), (71, "", "b"), (None, None, "s"), (None, None, "s")]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled_bytes(spark)
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), sf_dir).collect()]
    sent = shuffled_bytes(spark) - before
    want = [r for r in rows[:60] if r[0] != 1] + [(1, text(1), "a"), (71, "", "b"), (72, " ", "s"), (None, None, "s")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sent < sum(len(t or "") for _, t, _ in rows) / 2


def test_unlike_texts_of_one_id_are_no_copies(spark, sf_dir):
    text = lambda k: " ".join(f"{k}x{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (None, text("c")), (None, text("d")), (6, text("b") + " end"), (None, text("d") + " end")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text[:1]) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(5, "a"), (5, "b"), (None, "c"), (None, "d")], key=str)


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf_dir)
        cols = sorted(df.columns)
        got = con.sql(sql)
        rows = sorted(map(str, got.select(*cols).fetchall()))
        assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == rows, name
    assert sorted(registry.queries(), key=lambda k: int(k[2:].split("_")[0])) == [next(k for k in registry.queries() if k.startswith(f"op{n}_")) for n in range(1, 11)]


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("__spark_entry__.py", "tomolith"):
        os.symlink(os.path.join(root, name), tmp_path / name) if name.endswith("py") else None
    package = tmp_path / "tomolith"
    package.mkdir()
    for part in os.listdir(os.path.join(root, "tomolith")):
        if part not in ("llm", "__pycache__"):
            os.symlink(os.path.join(root, "tomolith", part), package / part)
    code = "import __spark_entry__ as e; assert 'cgls' in e.queries() and not any(k.startswith('op1_') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
