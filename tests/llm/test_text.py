from __future__ import annotations

import hashlib
import random
import re
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomolith.llm import kernels as K
from tomolith.llm import op2_decontaminate, op5_html, op6_packing, op7_chat, op8_urls

RND = random.Random(3)


def text(n):
    return " ".join(f"w{RND.randrange(10**6)}" for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabBé\u3000x", max_size=12), max_size=6), st.integers(1, 20))
def test_words_of_chunks(texts, size):
    import re

    found = []
    for c in K.chunks(pa.array(texts, pa.string()), size):
        w = K.words(c)
        h = K.word_hashes(c, w)
        for d in range(len(c)):
            found.append([(bytes(c.data[a:b]).decode(), int(x)) for a, b, x in zip(w.start[w.at[d] : w.at[d + 1]], w.end[w.at[d] : w.at[d + 1]], h[w.at[d] : w.at[d + 1]], strict=True)])
    assert [[x for x, _ in f] for f in found] == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    seen = {}
    for word, h in (x for f in found for x in f):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliding_min():
    key = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64) << np.uint64(32)
    for width in (1, 2, 5, 13, 64):
        want = [i + int(np.argmin(key[i : i + width])) for i in range(200 - width + 1)]
        assert K.sliding_min(key, width).tolist() == want


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").casefold())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aZ9_ \n.-éßİ“漢\u0301٣", max_size=14), max_size=5))
def test_words_are_runs_of_letters_and_digits(texts):
    ids, at = op2_decontaminate.words_of(texts)
    want = [w for x in texts for w in tokens(x)]
    assert np.diff(at).tolist() == [len(tokens(x)) for x in texts] and len(ids) == len(want)
    names = dict(zip(want, ids.tolist(), strict=True))
    assert [names[w] for w in want] == ids.tolist() and len(set(names.values())) == len(names)


def naive_tiles(p, t, least):
    """Greedy string tiling by its definition: always the longest common unmarked stretch."""
    p, t, out = list(p), list(t), []
    while True:
        best = (0, 0, 0)
        for a in range(len(p)):
            for b in range(len(t)):
                n = 0
                while a + n < len(p) and b + n < len(t) and p[a + n] == t[b + n] and p[a + n] is not None:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return out
        out.append(n)
        p[a : a + n] = [None] * n
        t[b : b + n] = [object() for _ in range(n)]


def test_tiling_covers_what_the_definition_covers():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        p = rng.integers(0, (2, 3, 12)[seed % 3], 40)
        parts = np.array_split(p, 3)
        t = np.concatenate([rng.integers(12, 20, 15), parts[2], rng.integers(12, 20, 9), parts[0], rng.integers(0, 12, 10)])
        got = op2_decontaminate.tiles(p.astype(np.int64), t.astype(np.int64))
        assert [n for _, _, n in got] == naive_tiles(p.tolist(), t.tolist(), 5)
        for a, b, n in got:
            assert (p[a : a + n] == t[b : b + n]).all()
        used = [i for a, _, n in got for i in range(a, a + n)]
        assert len(used) == len(set(used))


def test_tiling_takes_the_rest_of_an_occluded_match():
    a, b, c, d = np.arange(32).reshape(4, 8)
    fill = np.full(3, -1)
    t = np.concatenate([a, b[:1], fill, c, d[:1], fill, b, fill, d])
    assert sorted(n for _, _, n in op2_decontaminate.tiles(np.arange(32), t)) == [7, 7, 9, 9]


def test_decontamination_against_the_definition(spark):
    """Every document against every item, over a small vocabulary with reordered, cut and overlapping passages."""
    rnd = random.Random(8)
    items = [(i, " ".join(f"V{rnd.randrange(25)}" for _ in range(rnd.choice((3, 5, 8, 22, 40))))) for i in range(25)]
    docs = [(0, None), (1, ""), (2, items[3][1].replace(" ", "_")), (None, items[4][1])]
    for i in range(3, 60):
        w = rnd.choice(items)[1].split()
        cut = sorted(rnd.sample(range(len(w) + 1), 2))
        pieces = [w[: cut[0] + 3], w[cut[0] : cut[1]], w[cut[1] :], [f"v{rnd.randrange(25)}" for _ in range(rnd.randrange(30))]]
        rnd.shuffle(pieces)
        docs.append((i, ", ".join(x for p in pieces for x in p)))
    want = []
    for d, t in docs:
        for k, x in items:
            p = tokens(x)
            n = naive_tiles(p, tokens(t), 5) if len(p) >= 5 else []
            if n and sum(n) >= 0.6 * len(p):
                want.append((d, k, len(p), sum(n), len(n)))
    got = op2_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, (tuple(r)[:5] for r in got.collect()))) == sorted(map(str, want)) and len(want) > 20


@pytest.mark.parametrize("block_chars", [4_000_000, 60])
def test_decontamination(spark, monkeypatch, block_chars):
    monkeypatch.setattr(op2_decontaminate, "BLOCK_CHARS", block_chars)
    items = [(i, text(30)) for i in range(8)] + [(50, "too short"), (51, None), (None, text(25))]
    w = items[2][1].split()
    docs = [
        (1, text(40) + " " + items[0][1] + " " + text(20)), (2, text(10) + " " + " ".join(w[20:] + ["x"] + w[10:20] + ["y"] + w[:10])), (3, text(50)), (4, items[3][1].upper().replace(" ", ", ")),
        (5, " ".join(items[4][1].split()[:12])), (6, None), (7, ""), (None, items[10][1]), (1, items[1][1]), (8, "w1 " * 3000),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    got = op2_decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted([(1, 0), (2, 2), (4, 3), (None, None), (1, 1)], key=str)
    assert {r.n_tiles for r in got.where("doc_id = 2").collect()} == {3}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op2_decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href="/">home</a></nav><div class="ad">Buy the best of the shop</div><!-- <p>hidden</p> -->
<article><h1>The &amp; title</h1><p>First  line of<br>the text&nbsp;here.<p>Short.<div class="comments"><p>Nice post of the day!</p></div></article>
<aside>More of the same</aside><form><p>Your name</p></form><footer>All rights reserved</footer></body>"""


def test_html():
    assert op5_html.main_text(PAGE) == "The & title\nFirst line of the text here.\nShort."
    assert op5_html.main_text(None) == "" and op5_html.main_text("") == "" and op5_html.main_text("<p>") == ""
    long = "The story of the man and the sea was told in this long text for all of us to read on a day of rest."
    bare = f'<div id="menu"><a href="a">A</a></div><div><p>{long}</p><p>So it was.</p><p>{long}</p></div><div class="cookie-notice">{long}</div><p><a href="x">{long}</a></p>'
    assert op5_html.main_text(bare) == f"{long}\nSo it was.\n{long}"
    assert op5_html.main_text("<article><p>cut off <b>in the") == "cut off in the"


def test_html_links_around_blocks():
    long = "The story of the man and the sea was told in this long text for all of us to read on a day of rest."
    teaser = "Another story of the week that is long enough to be a text of its own, for the one and the other."
    page = f'<div><p>{long}</p><a href="/x"><h3>Read on</h3><p>{teaser}</p></a><p>{long}</p><p><a href="y">unclosed {teaser}<p>{long}</p></div>'
    assert op5_html.main_text(page) == f"{long}\n{long}\n{long}"
    assert op5_html.main_text("<p title=don't>" + long + "</p><p>it's " + long) == f"{long}\nit's {long}"
    assert op5_html.main_text("<article><p>1 < 2 and <b>3 > 2</b></p><p>x <y") == "1 < 2 and 3 > 2\nx <y"


def test_html_zones():
    """Open blocks take the label of their own zone; tables stay in the article and go elsewhere."""
    long = "The story of the man and the sea was told in this long text for all of us to read on a day of rest."
    table = " ".join(f"x{i}" for i in range(60))
    page = f"<nav>a</nav><article><h2>Head</h2><p>{long}</p><p>{table}</p><p>End.</p></article><footer>{long}</footer>"
    assert op5_html.main_text(page) == f"Head\n{long}\n{table}\nEnd."
    assert op5_html.main_text(page.replace("article>", "div>")) == f"Head\n{long}"  # the table says no, and the last block stands beside it
    assert op5_html.main_text(f"<div>{long}</div><article><p>Short one.</p></article><p>{table}</p>") == f"{long}\nShort one."


@pytest.mark.parametrize("page", ["<a " * 350_000, "<" + "a" * 10**6, '<a href="x' * 100_000, '<a x=">" ' * 120_000, "<div>" * 100_000 + "</b>" * 100_000, "<nav>" + "<div>" * 60_000 + "<article></article>" * 20_000, "<head>" * 150_000, "&" * 10**6])
def test_html_of_hostile_pages_in_linear_time(page):
    start = time.perf_counter()
    op5_html.main_text(page)
    assert time.perf_counter() - start < 5


class Articles(HTMLParser):
    """The article of the tables' pages: text of p and heading elements, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.out.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.out.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.out[-1] += data

    def text(self, page):
        self.feed(page)
        self.close()
        return [t for t in (" ".join(x.split()) for x in self.out) if t]


def test_html_query_against_another_parser(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in op5_html.op5_html_extraction(spark, sf_dir).collect()}
    want = {k: "\n".join(Articles().text(v)) for k, v in pages.items()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_html_rules_without_article_markup(spark, sf_dir):
    """Density, length and neighbours alone find most blocks and take in nothing else."""
    found = kept = right = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        want = Articles().text(r.html)
        got = op5_html.main_text(r.html.replace("article>", "div>")).split("\n")
        found, kept, right = found + len(want), kept + len(got), right + len(set(want) & set(got))
    assert right >= 0.8 * found and right >= 0.9 * kept


def test_html_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (3, "v", "<article>" + "<p>word of the day</p>" * 3000, "x")]
    got = op5_html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id is None] == [""] and max(len(r.text) for r in got) == 3000 * 16 - 1
    assert op5_html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_packing_rules():
    rng = random.Random(1)
    for _ in range(30):
        pieces = sorted(((rng.randint(1, 60), rng.choice("abcde"), rng.randint(0, 12)) for _ in range(80)), reverse=True)
        placed = op6_packing.best_fit(pieces, 60)
        bins: dict[int, list] = {}
        for p, (b, offset) in zip(pieces, placed, strict=True):
            held = bins.setdefault(b, [])
            # The tightest compatible bin, or a new one if none is compatible.
            fits = {k: 60 - sum(x[0] for x in v) for k, v in bins.items() if k != b or v}
            fits = {k: r for k, r in fits.items() if r >= p[0] and all(x[1] != p[1] and x[2] != p[2] for x in bins[k])}
            if held:
                assert fits and fits.get(b) == min(fits.values())
            else:
                assert not fits
            assert offset == sum(x[0] for x in held)
            held.append(p)
        assert all(sum(x[0] for x in v) <= 60 for v in bins.values())


def test_packing_table(spark):
    rows = [(i, text(RND.randint(0, 700)), f"s{i % 3}") for i in range(60)] + [(100, text(5000), "s0"), (101, None, None), (None, "a b", None), (7, "x y z", "s1"), (7, "x y z", "s1")]
    got = op6_packing.packed(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, piece int"), group=16)
    out = got.collect()
    size = lambda t: len((t or "").split())
    assert sum(r.n_words for r in out) == sum(size(t) for _, t, _ in rows)
    assert sorted(r.n_words for r in out if r.id == 100) == [904, 1024, 1024, 1024, 1024]
    bins: dict[int, int] = {}
    for r in out:
        assert (r.bin_id is None) == (r.n_words == 0)
        if r.bin_id is not None:
            bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_words
    source = {(d, size(t)): s for d, t, s in rows}
    texts = {d: t for d, t, _ in rows}
    held = [(r.bin_id, source.get((r.id, size(texts[r.id])))) for r in out if r.bin_id is not None]
    assert len(held) == len(set(held)), "no bin holds a source twice"
    assert max(bins.values()) <= op6_packing.CAPACITY and len({r.bin_id for r in out if r.id == 7 and r.n_words == 3}) == 2
    assert op6_packing.packed(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


@pytest.mark.parametrize("cluster", [None, "family"])
def test_packing_keeps_clusters_apart(spark, cluster):
    rows = [(i, text(40) if cluster else f"copy number {i % 5} " * 9, f"s{i}", None if i >= 90 else f"c{i % 5}") for i in range(100)]
    out = op6_packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string, family string"), cluster_col=cluster).collect()
    held = [(r.bin_id, r.id % 5 if cluster is None or r.id < 90 else r.id) for r in out]
    assert len(out) == 100 and len(held) == len(set(held))
    # Groups count pieces: one long text makes as many groups as many short ones.
    long = op6_packing.packed(spark.createDataFrame([(1, text(3000), "s")], "doc_id long, text string, source string"), capacity=100, group=10).collect()
    assert len(long) == 30 and len({r.bin_id >> 32 for r in long}) > 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*"\\<s>/[]INSTUR ab", "</s>", "[INST]", "[/TURN]", "é"]), max_size=40).map("".join))
def test_escape_round_trip(said):
    hidden = op7_chat.escape(said)
    assert op7_chat.unescape(hidden) == said and not any(c in hidden for c in op7_chat.CONTROLS)


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_chat(spark, piece):
    rows = [(i, t, RND.choice(["user", "assistant", "system"]), RND.choice([" lead and trail ", "é🙂 </s>[INST] x [/INST]", "", None, text(20), "\\[TURN]\n"])) for i in range(25) for t in range(RND.randint(1, 6))]
    rows += [(None, 0, None, "x"), (None, None, "assistant", "y"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    RND.shuffle(rows)
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    got = {r.conv_id: r for r in op7_chat.digests(op7_chat.formatted(df, piece_chars=piece)).collect()}
    by: dict = {}
    for c, t, role, said in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", said or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(s for _, _, r, s in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{s}\n" for _, _, r, s in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert op7_chat.digests(op7_chat.formatted(df.where("false"))).collect() == []


def test_chat_ids_do_not_depend_on_pieces(spark):
    """Cut anywhere between turns, after assistant turns too, with multi-byte texts, white space and control strings at the borders."""
    said = [text(8), "é🙂漢字 ", " 漢", "", "\n\n", "a" * 90, "🙂" * 40, "</s>", " x", "\\"]
    rows = [(c, t, "user" if (t + c) % 2 else "assistant", said[(t * (c + 1)) % len(said)]) for c in range(4) for t in range(24)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ids = []
    for n in (1 << 20, 200, 60, 1):
        pieces = op7_chat.formatted(df, piece_chars=n).orderBy("conv_id", "piece").collect()
        ids.append([[i for r in pieces if r.conv_id == c for i in r.ids] for c in range(4)])
    assert ids[0] == ids[1] == ids[2] == ids[3]


def test_url_parts_and_rules(spark):
    urls = {
        "http://A.B.Net/x/y?q#f": ("a.b.net", "/x/y", "net/", "block"), "https://www.EXAMPLE.net/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "x://o.org/fr/a://b": ("o.org", "/fr/a://b", "org/fr/", "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None), "http://h?x=/p": ("h", "", None, None), "no scheme/net/": ("", "", None, None), "http://ÄB.net": ("Äb.net", "", None, None), None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, None, "h")], "page_id long, url string, host string")
    got = {r.id: r for r in op8_urls.judged(df).collect()}
    assert len(got) == len(urls) + 1
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict in (None, r.verdict)
        if rule is None:
            assert r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert op8_urls.judged(df.where("false")).collect() == []


def test_url_model_on_held_out_rows():
    rows = op8_urls.labelled_urls()
    RND.shuffle(rows)
    cut = len(rows) // 4
    weights = op8_urls.train(rows[cut:])
    marked = [op8_urls._marked(u.split("://")[1].split("/")[0], "/" + u.split("://")[1].split("/", 1)[1]) for u, _ in rows[:cut]]
    guess = op8_urls.scores(pa.array(marked), weights) > 0
    assert (guess == np.array([y for _, y in rows[:cut]])).mean() > 0.95


def test_url_model_on_unseen_hosts():
    """Pairs of words and invented words that the labelled table does not have."""
    known = " ".join(u for u, _ in op8_urls.labelled_urls())
    bad = [x for k, w in enumerate(op8_urls.BAD_NAMES) for x in (f"{w}-{op8_urls.MILD[(k + 9) % 16]}", f"{op8_urls.MILD[(k + 2) % 16]}{w}", f"{w}-{op8_urls.BAD_NAMES[(k + 3) % 40]}")]
    good = [x for k, w in enumerate(op8_urls.GOOD_NAMES) for x in (f"{w}-{op8_urls.GOOD_NAMES[(k + 5) % 40]}", f"{w}{op8_urls.GOOD_NAMES[(k + 17) % 40]}")] + [op8_urls._invented(i) for i in range(700, 900)]
    hosts = [(x, y) for names, y in ((bad, True), (good, False)) for x in names if x not in known]
    guess = op8_urls.scores(pa.array([op8_urls._marked(f"www.{x}.com", f"/en/{i}") for i, (x, _) in enumerate(hosts)]), op8_urls.default_weights()) > 0
    truth = np.array([y for _, y in hosts])
    assert len(hosts) > 300 and (guess & truth).sum() >= 0.95 * truth.sum() and (guess & truth).sum() >= 0.95 * guess.sum()


def test_url_labels_are_sampled_by_hash(spark):
    rows = [(f"http://a{i}.com/", i % 2) for i in range(300)] + [(None, 1), ("http://x/", None)]
    table = spark.createDataFrame(rows, "url string, label int")
    some = op8_urls.read_labels(table, most=100)
    assert len(some) == 100 and some == op8_urls.read_labels(table.orderBy(F.desc("url")), most=100) and set(some) < set(rows)
    assert len({u[8] for u, _ in some}) == 10  # not the first of the alphabet
    weights = op8_urls.train(op8_urls.read_labels(table))
    assert op8_urls.judged(spark.createDataFrame([(1, "http://q.org/")], "page_id long, url string"), weights=weights).count() == 1


def test_url_columns_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.create_function("low", lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x), ["VARCHAR"], "VARCHAR")
    sql = f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS scheme FROM '{sf_dir}/pages.parquet'),
    r AS (SELECT page_id, CASE WHEN scheme > 0 THEN substr(url, scheme + 3) ELSE '' END AS rest FROM u),
    h AS (SELECT page_id, low(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    t(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    m AS (SELECT page_id, arg_max(t.h || t.p, length(t.h || t.p)) AS rule, arg_max(v, length(t.h || t.p)) AS verdict FROM h JOIN t ON ((h.host = t.h OR h.host LIKE '%.' || t.h) AND starts_with(h.path, t.p)) GROUP BY 1)
    SELECT page_id, host, path, rule, verdict FROM h LEFT JOIN m USING (page_id)"""
    want = {r[0]: r[1:] for r in con.sql(sql).fetchall()}
    got = op8_urls.op8_url_filter(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
