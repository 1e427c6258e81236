from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tomolith.llm import anchors as A
from tomolith.llm import kernels as K
from tomolith.llm import components, op1_lines, op3_quality, op4_substrings, op9_suffix_array, op10_jaccard
from tomolith.llm import suffixes as S

RND = random.Random(7)
VOCABULARY = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(300)]


def words(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, periodic and very long texts, nulls, empties, repeated rows and ids."""
    rows, base, passage = [], words(120), words(45)
    for _ in range(40):
        w = list(base)
        for _ in range(RND.randint(0, 4)):
            w[RND.randrange(len(w))] = RND.choice(VOCABULARY)
        rows.append(" ".join(w))
    for _ in range(30):
        w = words(RND.randint(0, 90))
        w[len(w) // 2 : len(w) // 2] = passage
        rows.append("\n ".join(w[:10]) + "\t" + " ".join(w[10:]))
    rows += [" ".join(words(RND.randint(0, 7))) for _ in range(20)]
    rows += ["a b " * 60, "x" * 700, "un un un deux " * 30, " ".join(words(9000)), None, "", "  \n\t ", "A b", "a B", "one"]
    out = list(enumerate(rows))
    RND.shuffle(out)
    return [*out, (None, rows[0]), (None, "nobody has this text"), (5, rows[5]), (5, "the id of another text " + rows[3])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, id string, n_words int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for n in [*range(1, 40), 300]:
        for letters in (1, 2, 4):
            b = rng.integers(0, letters, n).astype(np.uint8) + 65
            want = sorted(range(n), key=lambda i: bytes(b[i:]))
            assert S.suffix_array(b.astype(np.int64) + 1).tolist() == want
            assert S.suffix_array(b.astype(np.int64) + 1, S.eights(b)).tolist() == want
    b = np.frombuffer(b"abcabcabd", np.uint8)
    assert S.same_prefix(b, np.array([0, 0]), np.array([3, 6]), 2).tolist() == [True, True]
    assert S.suffix_array(np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_substrings(spark, docs, monkeypatch, block):
    rows, df = docs
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    out = op4_substrings.remove_repeats(df)
    got = rows_of(out.select("id", "n_words", "n_removed", F.sha2("kept", 256)))
    hashes = {r.text or "": r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert got == brute.substrings(rows, hashes=hashes)
    assert sum(r[2] for r in got) > 0


def test_long_texts_in_pieces(spark, docs, monkeypatch):
    """All three searches, with documents cut into pieces far smaller than they are."""
    rows, df = docs
    long = " ".join(words(400)) + "  " + " ".join(words(3)) + " " * 700 + "x" * 900 + " y z " * 150
    rows = [*rows, (300, long), (301, "start " + long[500:] + " end"), (302, long[:1500] + long[300:1400])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for piece in (350, 1000):
        monkeypatch.setattr(K, "PIECE_BYTES", piece)
        monkeypatch.setattr(K, "CHUNK_BYTES", 300)
        hashes = {r.text or "": r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        got = rows_of(op4_substrings.remove_repeats(df).select("id", "n_words", "n_removed", F.sha2("kept", 256)))
        assert got == brute.substrings(rows, hashes=hashes)
        got = rows_of(op9_suffix_array.remove_repeats(df).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)))
        assert got == brute.repeated_bytes(rows)
        assert rows_of(op10_jaccard.near_duplicates(df).select("id", "n_shingles", "component_id")) == brute.components(rows)


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_bytes(spark, docs, monkeypatch, block):
    rows, df = docs
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    out = op9_suffix_array.remove_repeats(df)
    assert rows_of(out.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == brute.repeated_bytes(rows)


def test_subtrees_split_by_longer_prefixes():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2, 4000).astype(np.uint32)
    start = np.arange(3980)
    whole = {frozenset(r[n == k]) for r, n in op4_substrings.deep_nodes(symbols, start, 20) for k in np.unique(n)}
    split = {frozenset(r[n == k]) for r, n in op4_substrings.deep_nodes(symbols, start, 20, budget=50) for k in np.unique(n)}
    assert whole == split


def test_maximal_repeats():
    rng = np.random.default_rng(4)
    for _ in range(20):
        symbols = rng.integers(0, 3, 120).astype(np.uint32)
        start = np.arange(120)
        end = np.where(start < 70, 70, 120)  # two texts
        tails = {i: tuple(symbols[i : end[i]].tolist()) for i in start}
        classes = {}
        for i, t in tails.items():
            if len(t) >= 5:
                classes.setdefault(t[:5], []).append(i)
        want = set()
        for members in classes.values():
            if len(members) > 1:
                shared = 5
                while len({tails[i][shared : shared + 1] for i in members} - {()}) == 1 and all(len(tails[i]) > shared for i in members):
                    shared += 1
                want.add((frozenset(members), shared))
        assert {(frozenset(r.tolist()), n) for r, n in op4_substrings.maximal_repeats(symbols, start, end, 5)} == want


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_components(spark, docs, monkeypatch, block):
    rows, df = docs
    monkeypatch.setattr(op10_jaccard, "BLOCK_BYTES", block)
    got = rows_of(op10_jaccard.near_duplicates(df).select("id", "n_shingles", "component_id"))
    assert got == brute.components(rows)


def test_parts_lose_no_link():
    """Any two linked sets agree on a part, at sizes from one up."""
    rng = np.random.default_rng(11)
    for n in [1, 2, 3, 5, 6, 7, 8, 13, 20, 40, 100, 333]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = 15 * len(x) // 100
            drop = rng.integers(0, most + 1) if most else 0
            y = np.unique(np.append(x[drop:], rng.integers(0, 2**63, most - drop).astype(np.uint64)))
            both = len(np.intersect1d(x, y))
            if not 100 * both >= 85 * (len(x) + len(y) - both):
                continue
            owner, key = op10_jaccard.parts(np.append(x, y), np.array([0, len(x), len(x) + len(y)]))
            assert set(key[owner == 0]) & set(key[owner == 1]), n


def test_parts_lose_no_link_at_80_percent():
    rng = np.random.default_rng(12)
    for n in [1, 2, 3, 4, 5, 6, 9, 10, 11, 20, 41, 100, 333]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, n // 5 + 1)
            y = np.unique(np.append(x[drop:], rng.integers(0, 2**63, rng.integers(0, n // 5 - drop + 1)).astype(np.uint64)))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            both_ = np.append(x, y)
            for common in (None, both_ % 3 < 2, both_ % 7 > 0):
                owner, key = op10_jaccard.parts(both_, np.array([0, len(x), len(x) + len(y)]), 80, 100, common)
                assert set(key[owner == 0]) & set(key[owner == 1]), n


@pytest.mark.parametrize("num", [80, 85])
def test_parts_are_as_few_as_linked_sets_allow(num):
    """No more parts are dealt out than the most that two linked sets of a level and its next can differ in; at the borders of levels none is lost."""
    edge, most, spare = op10_jaccard.levels(num, 100)
    rng = np.random.default_rng(13)
    differ = lambda a, b: a + b - 2 * -(-num * (a + b) // (num + 100))
    for j in range(30):
        low, high = range(int(edge[j]), int(edge[j + 1])), range(int(edge[j]), int(edge[j + 2]))
        assert most[j] == max(differ(a, b) for b in low for a in high if 100 * min(a, b) >= num * max(a, b)), j
        for a, b in [(high[-1], low[-1]), (low[-1], low[-1]), (high[-1], high[-1]), (high[-1], int(edge[j + 1])), (int(edge[j + 1]), low[0])]:
            if 100 * min(a, b) < num * max(a, b):
                continue
            both = -(-num * (a + b) // (num + 100))
            h = rng.integers(0, 2**63, a + b - both).astype(np.uint64)
            x, y = np.sort(h[:a]), np.sort(np.append(h[:both], h[a:]))
            x_y = np.append(x, y)
            for common in (None, x_y % 3 < 2):
                owner, key = op10_jaccard.parts(x_y, np.array([0, a, a + b]), num, 100, common)
                assert set(key[owner == 0]) & set(key[owner == 1]), (a, b)


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(components.connected(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("batch", [1 << 20, 16])
def test_connected_against_search(spark, monkeypatch, batch):
    """A star around its greatest node, stars of stars, a chain in random order, random links, repeated links."""
    monkeypatch.setattr(components, "BATCH", batch)
    rnd = random.Random(5)
    links = [(5000, i) for i in range(300)] + [(1000 + i, 2000 + i % 7) for i in range(200)] + [(2000 + i, 2100) for i in range(7)]
    chain = rnd.sample(range(10_000, 11_000), 150)
    links += list(zip(chain, chain[1:])) + [(rnd.randrange(20_000, 20_300), rnd.randrange(20_000, 20_300)) for _ in range(150)]
    links += links[:50] + [(-(2**63), 2**63 - 1)]
    rnd.shuffle(links)
    near, want = {}, {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    got = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want


def test_quality(spark, docs):
    rows, df = docs
    out = op3_quality.with_verdict(df).select("doc_id", *[F.col("_m")[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "_base_failed")
    assert rows_of(out) == brute.quality(rows)
    assert op3_quality.with_verdict(df).where("_kept and _base_failed").count() == 0
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(op3_quality.with_verdict(df)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_lines(spark):
    rows, footer = [], ["All rights reserved.", "Contact us", " Imprint "]
    for i in range(60):
        own = [" ".join(words(6)) for _ in range(3)]
        own.insert(RND.randint(0, 3), "Share this page.")
        rows.append((i, "\n".join(own + footer), f"s{i % 12}"))
    rows += [(80 + i, f"own line {i}\nseven sites", f"s{i % 7}") for i in range(40)]
    rows += [(120 + i, f"own line {i}\neight sites\n", f"s{i % 8}") for i in range(24)]
    rows += [(150 + i, "one site, many times", "s1") for i in range(30)]
    rows += [(200, None, "s1"), (201, "", None), (202, "\n \n", None), (None, "All rights reserved.\n x ", None), (203, "only here\n\nonly here", "s2"), (0, rows[0][1], "s0")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "k") for r in rows], "doc_id long, text string, source string, h int, site int, _id int, _bad int, key string")
    for least in (8, 12):
        out = op1_lines.remove_boilerplate(df, min_sites=least)
        assert set(out.columns) == {*df.columns, "_n_lines", "_n_removed", "_kept"}
        assert rows_of(out.select("doc_id", "_n_lines", "_n_removed", F.sha2("_kept", 256))) == brute.lines(rows, least)
        assert {tuple(r) for r in out.select("h", "site", "_id", "_bad", "key").collect()} == {(1, 2, 3, 4, "k")}
    assert {r._n_removed for r in op1_lines.remove_boilerplate(df).where("doc_id < 60").collect()} == {4}


def test_lines_of_copies_may_be_spared(spark):
    copy = "\n".join(" ".join(words(5)) for _ in range(4))
    rows = [(i, copy, f"s{i % 12}") for i in range(30)] + [(100 + i, f"{' '.join(words(9))}\nfooter", f"s{i % 9}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.doc_id < 100, r._n_removed) for r in op1_lines.remove_boilerplate(df).collect()} == {(True, 4), (False, 1)}
    left = op1_lines.remove_boilerplate(df, spare=0.5).collect()
    assert {(r.doc_id < 100, r._n_removed) for r in left} == {(True, 0), (False, 1)}
    assert {r._kept for r in left if r.doc_id < 100} == {copy}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    for out in (op4_substrings.remove_repeats(none), op9_suffix_array.remove_repeats(none), op10_jaccard.near_duplicates(none), op3_quality.with_verdict(none), op1_lines.remove_boilerplate(none)):
        assert out.collect() == []
