"""Joins, runs, mixes, matches, searches and pages against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from footfall.llm import anchors, line_runs, mixing, ngram_join, style_tree, suffix_levels, vector_graph
from footfall.llm.components import components
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS

F = pytest.importorskip("pyspark.sql.functions")


def near_copies(seed: int, groups: int = 12, words: int = 60) -> list[tuple[int, str]]:
    """Texts in groups: a base, exact copies, and copies with one to four words changed, with lines shared by all groups."""
    rng = random.Random(seed)
    shared = " ".join(f"common{k}" for k in range(14)) + "."
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(words // 6, words * 2))]
        for copy in range(rng.randint(1, 7)):
            text = base.copy()
            for _ in range(rng.randint(0, 4) if copy else 0):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 9)}"
            for k in range(9, len(text), 10):
                text[k] += "\n"
            rows.append((len(rows), " ".join(text).replace("\n ", "\n") + (f"\n{shared}" if g % 2 else "")))
    rng.shuffle(rows)
    return rows


# ---- components and n-gram join ----


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(rng.randint(50, 150), rng.randint(50, 150)) for _ in range(60)] + [(7, 7), (3, 2)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = brute.components(range(200), [x for x in links if x[0] != x[1]])
    assert got == {n: c for n, c in want.items() if any(n in x and x[0] != x[1] for x in links)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, 2048), (5, 80, 3)])
def test_jaccard_components(docs_of, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # three nodes a block: every list goes out as pairs of blocks
    rows = near_copies(width)
    want = brute.jaccard_components(rows, width, percent)
    assert len({c for _, c in want.values()}) < len(want)
    got = ngram_join.linked_components(docs_of(rows), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = ngram_join.one_of_each(docs_of(rows), width=width, percent=percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert kept.columns == docs_of(rows).columns


def test_prefixes_hold_the_shared_n_grams():
    """The two bounds that the filters rest on, for random pairs at the edge of the similarity."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n, percent = int(rng.integers(1, 200)), int(rng.choice([80, 90]))
        x = np.sort(rng.choice(10_000, n, replace=False)).astype(np.uint64)
        lost = rng.choice(n, int(rng.integers(0, n // 8 + 1)), replace=False)
        y = np.unique(np.concatenate([np.delete(x, lost), rng.choice(10_000, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < percent * (len(x) + len(y) - common):
            continue
        least = min(-(-len(x) // 40), -(-len(y) // 40))
        prefixes = [ngram_join.extended_prefix(s, percent) for s in (x, y)]
        assert len(np.intersect1d(*prefixes)) >= least
        assert max(ngram_join.shared_least(len(s), percent) for s in (x, y)) <= max(1, least)
        shapes = [ngram_join._shapes([ngram_join._histogram(s << np.uint64(50))]) for s in (x, y)]
        counts = [np.bincount((s >> np.uint64(5)).astype(int), minlength=ngram_join.RANGES) % 4 for s in (x, y)]
        apart = np.abs(counts[0] - counts[1])
        gap = ngram_join.shape_gap(*shapes)[0]
        assert gap == np.minimum(apart, 4 - apart).sum()
        assert gap <= len(x) + len(y) - 2 * ngram_join.overlap(len(x), len(y), percent)


def test_pairs_are_tested_once_and_shared_passages_make_none(docs_of, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(50)) + " " + passage) for i in range(150)]
    # Groups of near copies whose first member is not alike to all others.
    for g in range(12):
        words = [word() for _ in range(60)]
        for k in range(6):
            rows.append((1_000 + 10 * g + k, " ".join([*words[k:], *(f"n{g}x{j}" for j in range(k))])))
    tested = []
    real = ngram_join.verified

    def counted(pairs, *args):
        tested.append({tuple(sorted(r)) for r in pairs.collect()})
        return real(pairs, *args)

    monkeypatch.setattr(ngram_join, "verified", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.linked_components(docs_of(rows), width=3, percent=90).collect()}
    want = brute.jaccard_components(rows, 3, 90)
    assert got == {d: c for d, (_, c) in want.items()}
    first, second = tested
    assert first and not first & second
    assert all(a >= 1_000 for pair in first | second for a in pair)


def test_order_of_n_grams_is_rare_first():
    numbers = np.arange(1, 41, dtype=np.uint64) << np.uint64(50)
    counts = np.ones(ngram_join.BUCKETS, np.int64)
    counts[ngram_join._bucket(numbers[:20])] = 900
    prefix = ngram_join.extended_prefix(numbers, 90, counts)
    assert prefix.tolist() == numbers[20 : 20 + len(prefix)].tolist()


def test_jaccard_odd_rows(docs_of):
    rows = [*ODD_TEXTS, ODD_TEXTS[5], (30, ODD_TEXTS[5][1].upper()), (None, "one two")]
    got = ngram_join.linked_components(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_shingles == 0 and by[0].component_id == 0 and by[12].component_id == 12
    assert {by[5].component_id, by[6].component_id, by[30].component_id} == {5}
    assert sorted(r.component_id if r.component_id is not None else -1 for r in got if r.doc_id is None) == [-1, 4]
    kept = ngram_join.one_of_each(docs_of(rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 5, 7, 8, 9, 10, 12]
    assert ngram_join.linked_components(docs_of([])).count() == 0


# ---- line runs ----


@pytest.mark.parametrize("min_words", [1, 5, 12])
def test_line_runs(docs_of, min_words):
    rng = random.Random(min_words)
    lines = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 7))) for _ in range(25)]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for d in range(60)]
    start = rng.randint(0, 5)
    rows += [(100 + d, "\n".join([f"own {d}", *lines[start : start + 6], f"end {d}"])) for d in range(5)]
    want = brute.repeated_lines(rows, min_words)
    got = line_runs.without_repeats(docs_of(rows), "runs", min_words=min_words).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert r.text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[r.doc_id])
        assert r.runs.n_removed == len(want[r.doc_id])


def test_line_runs_odd_rows(docs_of):
    rows = [*ODD_TEXTS, ODD_TEXTS[5], (31, ODD_TEXTS[5][1]), (None, ODD_TEXTS[6][1])]
    got = line_runs.without_repeats(docs_of(rows), "runs").collect()
    texts = [(r.doc_id, r.text) for r in got]
    assert len(got) == len(rows)
    assert texts.count(ODD_TEXTS[5]) == 2 and (31, "") in texts and (None, "") in texts and (0, None) in texts
    assert dict(texts)[8].split("\n").count("same line of six words here") == 1
    kept = line_runs.keep_first_runs(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert kept.count() == len(rows) - 2
    assert line_runs.keep_first_runs(docs_of([])).count() == 0


# ---- mixing ----


def test_mix(spark):
    rng = random.Random(5)
    rows = [(d, rng.choice(["a", "b", "ä", "z", None]), rng.randint(0, 60)) for d in range(400)] + [(400, "b", 5000)]
    want = brute.mix(rows)
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = mixing.mixed(sized, "mix", F.col("size")).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(rows)
    for source, (size, target) in want.items():
        mine = [r for r in got if r.source == source]
        assert mine[0].source_size == size and abs(mine[0].target - target) < 1e-6
        assert abs(sum(r.taken for r in mine) - target) <= 0.5
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    again = mixing.mixed(sized.repartition(7), "mix", F.col("size")).select("doc_id", "mix.taken").collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_repeated_rows_hold_the_words_taken(docs_of):
    docs = docs_of([*ODD_TEXTS, ODD_TEXTS[5], *((50 + k, f" text {k}  of some\nwords " + "and more " * k) for k in range(30))])
    figures = mixing.mixed(docs, "mix", mixing.n_words(F.col("text")), tie=F.xxhash64("text"))
    taken = sum(r.taken for r in figures.select("mix.taken").collect())
    rows = mixing.repeated(figures, "mix")
    assert rows.columns == docs.columns
    texts = [r.text or "" for r in rows.collect()]
    assert sum(len(brute.WORD.findall(t)) for t in texts) == taken
    whole = {t or "" for _, t in ODD_TEXTS} | {r.text or "" for r in docs.collect()}
    assert sum(t not in whole for t in texts) <= 1
    assert mixing.repeated(mixing.mixed(docs_of([]), "mix", mixing.n_words(F.col("text"))), "mix").count() == 0


# ---- suffix levels ----


def test_anchors_are_the_same_in_equal_windows():
    rng = np.random.default_rng(6)
    shared = rng.integers(97, 101, 700, np.uint8).tobytes()
    parts = [rng.integers(97, 101, n, np.uint8).tobytes() + shared + b"x" * n for n in (0, 13, 300)] + [b"ab" * 300, b"short"]
    found = anchors.Pieces(parts).anchored()
    seen: dict[bytes, set] = {}
    for part, at, n, off, gram in zip(*(found[k] for k in ("part", "at", "n", "off", "gram")), strict=True):
        for s in range(at, at + n):
            seen.setdefault(parts[part][s : s + anchors.LENGTH], set()).add((at + off - s, int(gram)))
    assert sum(found["n"]) == sum(max(0, len(p) - anchors.LENGTH + 1) for p in parts)
    assert all(len(v) == 1 for v in seen.values())


@pytest.mark.parametrize(("batches", "group", "piece"), [(4, 4096, 1 << 20), (7, 1, 500)])
def test_repeated_bytes(docs_of, monkeypatch, batches, group, piece):
    monkeypatch.setattr(suffix_levels, "GROUP", group)  # one: every suffix that differs around is dealt out by digest
    monkeypatch.setattr(anchors, "PIECE", piece)  # texts go through in pieces
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (199, 200, 201, 260, 900)]
    rows = []
    for d in range(40):
        parts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 400))) for _ in range(3)]
        rows.append((d, rng.choice(passages).join(parts)))
    rows += [(50, rows[0][1]), (51, rows[3][1][:-1] + "#"), (52, "ab" * 400), (53, "z" * 199), (54, "z" * 200)]
    want = dict(zip([d for d, _ in rows], brute.repeated_bytes([t.encode() for _, t in rows]), strict=True))
    got = suffix_levels.without_repeats(docs_of(rows), batches=batches).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_repeated_bytes_odd_rows(docs_of):
    rows = [*ODD_TEXTS, ODD_TEXTS[8]]
    got = suffix_levels.without_repeats(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].n_bytes == 0 and by[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.n_removed for r in got if r.doc_id == 8] == [len(ODD_TEXTS[8][1])] * 2
    assert by[9].n_removed == 70_000 and by[None].n_removed == 0
    assert suffix_levels.without_repeats(docs_of([])).count() == 0


# ---- vectors ----


def exact_nearest(rows: list[tuple], queries: list[tuple], k: int) -> dict:
    out = {}
    for q, x in queries:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, v in rows if i != q)
        out[q] = near[:k]
    return out


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 700)
    monkeypatch.setattr(vector_graph, "QUERIES", 10)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 32))
    points = (centres[rng.integers(0, 20, 2500)] + 0.4 * rng.normal(size=(2500, 32))).astype(np.float32)
    points[1500:2000] = points[1499] + 1e-3 * rng.normal(size=(500, 32)).astype(np.float32)
    points[2000:2300] = points[100]
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vector_graph.nearest(df, df.where("vec_id % 100 = 0")).collect()
    want = exact_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    found = {q: [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert all(len(f) == 10 and f == sorted(f) for f in found.values())
    # Equally near ones count as found, as 301 equal vectors leave no other measure.
    recall = np.mean([np.isclose([s for s, _ in found[q]], [s for s, _ in want[q]], rtol=1e-9, atol=1e-9).mean() for q in want])
    assert recall >= 0.9
    assert found[100] == want[100]
    for q, near in found.items():
        for score, i in near:
            exact = np.sqrt(((points[q].astype(float) - points[i].astype(float)) ** 2).sum())
            assert score == pytest.approx(exact, rel=1e-12, abs=1e-12)


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, []), (5, [None, 1.0]),
            (6, [float("inf"), 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.1]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_graph.nearest(df, df.where("vec_id % 100 = 0")).collect()}
    assert got == {(0, 1): (7, 0.0), (0, 2): (100, 0.5), (100, 1): (0, 0.5), (100, 2): (7, 0.5)}
    assert vector_graph.nearest(df.limit(0), df.limit(0)).count() == 0


def test_queries_are_not_copied_for_every_shard(spark, monkeypatch):
    """Neither shuffled nor broadcast once per shard: the driver's memory and the shuffle would grow with queries times shards."""
    monkeypatch.setattr(vector_graph, "SHARD", 8)
    monkeypatch.setattr(vector_graph, "QUERIES", 5)
    monkeypatch.setattr(vector_graph, "FILE_GRAPHS", 2)
    monkeypatch.setattr(vector_graph, "FILE_BLOCKS", 1)
    rng = np.random.default_rng(5)
    # Two lengths, which meet only their like; ten equal queries in one block.
    rows = [(i, [float(v) for v in rng.normal(size=2 + i % 2)]) for i in range(120)]
    rows += [(1000 + i, [1.0, 2.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = vector_graph.nearest(df, df.where("vec_id % 3 = 0"), k=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastExchange" not in plan
    # The one shuffle brings the answers to a query together.
    assert len(re.findall(r"Exchange (\w+)\(", plan)) == 1 and re.search(r"Exchange hashpartitioning\(query_id#", plan)
    want = {}
    for q, x in rows:
        if q % 3 == 0:
            near = exact_nearest([r for r in rows if len(r[1]) == len(x)], [(q, x)], 4)[q]
            want.update({(q, n): (i, score) for n, (score, i) in enumerate(near, 1)})
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    assert {at: i for at, (i, _) in got.items()} == {at: i for at, (i, _) in want.items()}
    assert all(got[at][1] == pytest.approx(want[at][1], rel=1e-12, abs=1e-12) for at in want)


# ---- pages ----


def test_page_text():
    cases = {
        "<p>a &lt;b&gt; &amp;amp; c&nbsp;d<br>e<p>f<div class='ad'>X</div><p>g": "a <b> &amp; c d e f g",
        "<div class=side-bar>s</div><div class=sidebar>n</div><main><h2>t</h2><p>x</p></main><p>out": "t x",
        "plain & text": "plain & text",
        "<article><header><h1>T</h1></header><p>1<section id='comments'><p>no</section><p>2</article><footer>f": "T 1 2",
        "<header>top</header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>": "a b c d",
        "<article>a<script>x < y </p></script>b<!-- c -->d<style>p{}</style></article>": "abd",
        "<div>un<b>bold</b>ed 1 < 2 and <i>x": "unbolded 1 < 2 and x",
        "<form>f<input></form><nav><a>n</a></nav><aside>s</aside><div role='alert'>r</div><p>kept</p><div hidden>h</div>": "kept",
        "<article><p>one</p></article><article class='comment'><p>reply</p></article>": "one",
    }
    for page, text in cases.items():
        assert style_tree.main_text(page, frozenset()) == text
    assert style_tree.main_text(None, frozenset()) == ""


def test_tree_removes_what_all_pages_of_a_host_share(spark):
    def page(k: int) -> str:
        return (f"<body><div class=top><span>Our fine site</span><ul><li>Home<li>News</ul></div><div class=txt><p>Story {k} "
                f"tells of {k * 7} things.</p><p>It ends with {k + 1}.</p></div><div class=end>Made by us</div></body>")

    rows = [(k, f"http://Host.example.com:80/{k}", page(k)) for k in range(30)]
    rows += [(100, "http://lone.example.com/", page(3)), (101, None, None), (102, "no url", ""), (100, "http://lone.example.com/", page(3))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = style_tree.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(30):
        assert by[k].text == f"Story {k} tells of {k * 7} things. It ends with {k + 1}." and by[k].n_chars == len(by[k].text)
    assert "Our fine site" in by[100].text and by[101].text == "" and by[102].n_chars == 0
    assert style_tree.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrapped_articles_stay(spark, tag):
    def page(k: int) -> str:
        return (f"<body><div class=top><p>Our fine site</div><div id=content><p>Read on</p><{tag}><p>Story {k} tells of {k * 7}.</p>"
                f"</{tag}></div></body>")

    rows = [(k, f"http://many.example.com/{k}", page(k)) for k in range(30)]
    rows += [(100 + k, "http://same.example.com/", f"<body><div><section><{tag}>One text {k // 6}.</{tag}></section></div>") for k in range(12)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"Story {k} tells of {k * 7}." for k in range(30))
    assert all(got[100 + k] == f"One text {k // 6}." for k in range(12))


def test_copies_of_a_page_do_not_empty_their_host(spark):
    def page(k: int) -> str:
        return f"<body><div class=top>Our site</div><div class=txt><p>Story {k} tells of {k * 7} things.</p></div></body>"

    rows = [(k, "http://copies.example.com/", f"<body><div class=txt><p>Only page.</p></div><!-- {k} --></body>") for k in range(10)]
    rows += [(100 + k, "http://most.example.com/", page(max(0, k - 80))) for k in range(100)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == "Only page." for k in range(10))
    assert all(got[100 + k] == f"Story {max(0, k - 80)} tells of {max(0, k - 80) * 7} things." for k in range(100))


def test_tree_judges_inside_and_beside_articles(spark):
    def page(k: int) -> str:
        return (f"<body><p>Welcome</p><div class=txt>Body {k} is here, {k * 7}.</div><article class=teaser><p>Teaser {k}, seen {k * 3} times."
                f"</p><div class=end>Told by us</div></article></body>")

    def near(k: int) -> str:
        return f"<body><article><p>The same long text on every page of this host.</p><i>{k}</i></article></body>"

    rows = [(k, "http://teasers.example.com/", page(k)) for k in range(30)]
    rows += [(100 + k, "http://near.example.com/", near(k)) for k in range(20)]
    rows += [(200, "http://lone.example.com/", page(3))]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"Body {k} is here, {k * 7}. Teaser {k}, seen {k * 3} times." for k in range(30))
    assert all(got[100 + k].startswith("The same long text") for k in range(20))
    assert got[200] == "Teaser 3, seen 9 times. Told by us"
