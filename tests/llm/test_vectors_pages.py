"""Vector operators against brute force, and template deduction on made-up sites."""

import html as entities
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import neighbours, templates, vecdedup
from sigloom.llm.work import Workspace


def table(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 16))
    near = base[:40].repeat(12, 0) + 0.05 * rng.standard_normal((480, 16))
    return np.concatenate([base, near, base[:5], base[:5], np.tile(base[7], (300, 1))])


def test_search_recall(spark, clustered):
    u = clustered / np.linalg.norm(clustered, axis=1)[:, None]
    got: dict = {}
    for r in neighbours.search(table(spark, clustered)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.arange(0, len(u), 50)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -2
    hits = 0
    for i, row in zip(q.tolist(), s):
        mine = sorted(got[i])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        kth = np.sort(row)[-5]
        hits += sum(v >= kth - 1e-12 for _, _, v in mine)
        assert all(abs(row[j] - v) < 1e-12 for _, j, v in mine)
    assert hits / (5 * len(q)) >= 0.9


def test_structured_vectors_meet_few_parts(spark):
    """Rows around 80 centres, two levels of parts: most true neighbours in a small share of rows; a hot centre is dealt in blocks."""
    rng = np.random.default_rng(21)
    centre = rng.standard_normal((80, 24))
    x = centre[rng.integers(0, 80, 9000)] + 0.45 * rng.standard_normal((9000, 24))
    x[:3000] = centre[0] + 0.3 * rng.standard_normal((3000, 24))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q = np.arange(0, len(u), 50)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -2
    truth = np.argsort(-s, axis=1, kind="stable")[:, :5]
    got: dict = {}
    rows = neighbours.search(table(spark, x)).collect()
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert rows[0].of_parts == 128 and rows[0].parts < 64
    assert np.mean([v in got[i] for i, t in zip(q.tolist(), truth.tolist()) for v in t]) >= 0.9
    assert rows[0].compared < 0.5 and rows[0].recall >= 0.9


def test_parts_are_balanced(clustered):
    x = clustered[:1024] / np.linalg.norm(clustered[:1024], axis=1)[:, None]
    label = neighbours.partition_graph(x, neighbours.neighbour_graph(x, 8), 8)
    assert np.bincount(label).tolist() == [128] * 8


@pytest.mark.parametrize("piece", [vecdedup.PIECE, 64])
def test_links_against_brute_force(spark, clustered, piece, monkeypatch):
    monkeypatch.setattr(vecdedup, "PIECE", piece)  # small pieces: a hot shard is many groups
    monkeypatch.setattr(vecdedup, "SHARD", 400)
    u = clustered / np.linalg.norm(clustered, axis=1)[:, None]
    link = u @ u.T >= 0.9 - 1e-12
    np.fill_diagonal(link, False)
    got = sorted(vecdedup.near_duplicates(table(spark, clustered)).collect())
    want = link.sum(1)
    assert sum(r.n_links for r in got) >= 0.995 * want.sum() and all(r.n_links <= n for r, n in zip(got, want))
    label = np.arange(len(u))
    while (new := np.minimum(label, np.where(link, label[None, :], len(u)).min(1))).tolist() != label.tolist():
        label = new
    assert np.mean([r.component_id == c for r, c in zip(got, label)]) >= 0.995
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_cross_shards(spark, monkeypatch):
    """Rows on an arc in shards of few rows and a single home: most links have ends in different shards, some through a third one."""
    monkeypatch.setattr(vecdedup, "SHARD", 25)
    monkeypatch.setattr(vecdedup, "PIECE", 32)
    monkeypatch.setattr(vecdedup, "LARGEST", 2)
    monkeypatch.setattr(vecdedup, "OVERLAPS", (2,))
    monkeypatch.setattr(vecdedup, "DEGREES", (16,))
    angle = np.linspace(0, 1.5, 400)
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    got = sorted(vecdedup.near_duplicates(table(spark, x)).collect())
    assert [r.n_links for r in got] == ((x @ x.T >= 0.9).sum(1) - 1).tolist()
    assert {r.component_id for r in got} == {0}


def test_lost_small_groups_are_not_hidden_by_a_large_one(spark, monkeypatch):
    """One group holds a third of the rows; nothing of the pairs is found by the shards, so that all rows are compared."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((200, 24))
    x = np.concatenate([base, base + 0.02 * rng.standard_normal(base.shape), rng.standard_normal(24) + 0.02 * rng.standard_normal((200, 24))])
    search = vecdedup.range_search

    def poor(x, graph, medoid, cosine):
        label = search(x, graph, medoid, cosine)
        return np.where(np.bincount(label, minlength=len(x))[label] < 20, np.arange(len(x)), label)

    monkeypatch.setattr(vecdedup, "range_search", poor)
    got = sorted(vecdedup.near_duplicates(table(spark, x)).collect())
    assert [r.n_links for r in got] == [1] * 400 + [199] * 200 and {r.recall for r in got} == {1.0}


def test_an_audit_without_links_decides_nothing(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((400, 24))
    x[7] = x[300] + 0.01
    monkeypatch.setattr(vecdedup, "AUDITS", (16, 4, 4))
    got = sorted(vecdedup.near_duplicates(table(spark, x)).collect())
    assert [r.vec_id for r in got if r.n_links] == [7, 300]


def test_few_links_come_through_the_graph(spark, monkeypatch):
    """One row in a hundred has a link: the audit tells by the rows near the range, and blocks are never compared."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 32))
    x[3000:3030] = x[:30] + 0.3 * rng.standard_normal((30, 32))
    called = []
    monkeypatch.setattr(vecdedup, "_all_edges", lambda *a: called.append(a))
    got = sorted(vecdedup.near_duplicates(table(spark, x)).collect())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert not called and want.sum() >= 40 and got[0].recall >= 0.99
    assert sum(r.n_links for r in got) >= 0.99 * want.sum() and all(r.n_links <= n for r, n in zip(got, want))


def test_two_levels_of_clusters_give_the_same_links(spark, clustered, monkeypatch):
    monkeypatch.setattr(vecdedup, "SHARD", 100)
    monkeypatch.setattr(vecdedup, "CLUSTERS", 4)
    u = clustered / np.linalg.norm(clustered, axis=1)[:, None]
    want = (u @ u.T >= 0.9 - 1e-12).sum(1) - 1
    got = sorted(vecdedup.near_duplicates(table(spark, clustered)).collect())
    assert sum(r.n_links for r in got) >= 0.995 * want.sum() and all(r.n_links <= n for r, n in zip(got, want))


def test_the_graph_is_pruned_and_navigable():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((800, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, medoid = vecdedup.build_graph(x, 10)
    assert (graph != np.arange(800)[:, None]).all() and ((graph >= 0).sum(1) <= 10).all()
    for i in range(0, 800, 97):  # no kept neighbour stands for another, by the definition
        near = graph[i][graph[i] >= 0]
        near = near[np.argsort(-(x[near] @ x[i]), kind="stable")]
        for k, b in enumerate(near):
            assert all(1.2 * (1 - x[a] @ x[b]) > (1 - x[i] @ x[b]) - 1e-9 for a in near[:k])
    reached = vecdedup.beam_search(x, graph, medoid, np.arange(800), 8)[0]
    assert np.mean((reached == np.arange(800)[:, None]).any(1)) > 0.97


def page(i, body, extra=""):
    menu = "".join(f"<li><a href=/{k}>item {k}</a></li>" for k in range(3 + i % 3))
    return f'<!DOCTYPE html><html><head><title>T {i}</title><style>p{{x:1}}</style><script>var a="</p>";</script></head><body><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies {i}</div>{body}<div class="comments"><p>reader says {i}</p></div>{extra}<footer>&copy; site</footer></body></html>'


def test_articles(spark):
    html = [page(i, f"<article><h1>Title {i} &amp; more</h1><p>First <b>para</b>\n graph {i}<br>next<p>Second &lt;{i}&gt;</article>") for i in range(12)]
    df = spark.createDataFrame([(i, "http://a.example/x", h) for i, h in enumerate(html)] + [(99, None, None), (98, "", "plain words only")], "page_id long, url string, html string")
    got = {r.page_id: r for r in templates.extract(df).collect()}
    assert got[3].text == "Title 3 & more\n\nFirst para graph 3 next\n\nSecond <3>" and got[3].n_chars == len(got[3].text)
    assert (got[99].text, got[99].n_chars, got[98].text) == ("", 0, "plain words only")


def test_template_without_articles(spark):
    bodies = [f'<div id="wrap"><div class="crumb">You are here</div><div class="body"><p>Story {i} tells of {"day " * (i + 5)}</p><p>It ends {i * 7}</p></div></div>' for i in range(10)]
    df = spark.createDataFrame([(i, "https://b.example/", page(i, b)) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in templates.extract(df).collect()}
    assert got[2] == f"Story 2 tells of {'day ' * 7}".strip() + "\n\nIt ends 14"


def test_copies_of_one_page_are_not_a_template(spark):
    h = page(1, "<article><p>the same story</p></article>")
    df = spark.createDataFrame([(i, "http://c.example/", h) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in templates.extract(df).collect()} == {"the same story"}


def extracted(spark, htmls, url="http://d.example/"):
    df = spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in templates.extract(df).collect()}


def test_the_template_decides_inside_articles(spark):
    line = '<div class="box9"><p>Get our letter every week</p></div>'
    pages = [page(i, f"<article class=a{i % 2}><h1>Title {i}</h1><p>Story {i} {'tale ' * 9}</p>{line}</article><article id=more><p>Part two of {i}</p></article>") for i in range(12)]
    assert extracted(spark, pages)[4] == f"Title 4\n\nStory 4 {'tale ' * 9}".strip() + "\n\nPart two of 4"


def test_near_copies_keep_what_they_share(spark):
    pages = [page(i, f"<article><h1>Number {i}</h1><p>{'The same long story. ' * 8}</p><p>And its end.</p></article>") for i in range(12)]
    assert extracted(spark, pages)[4] == f"Number 4\n\n{'The same long story. ' * 8}".strip() + "\n\nAnd its end."


@pytest.mark.parametrize("url", ["http://d.example/", None])
def test_headings_and_lists_stay_without_an_article(spark, url):
    body = lambda i: f"<div class=c><h1>Head {i}</h1><p>{f'long text {i} ' * 20}</p><ul><li>Point {i}</ul><table><tr><td>Cell {i}</table><pre>code {i}</pre><blockquote>Said {i}</blockquote><p>End {i}</p></div>"
    got = extracted(spark, [page(i, body(i)) for i in range(8 if url else 2)], url)
    assert got[1] == f"Head 1\n\n{'long text 1 ' * 20}".strip() + "\n\nPoint 1\n\nCell 1\n\ncode 1\n\nSaid 1\n\nEnd 1"


def plain_article(html):
    """What stands in the article of one of the made pages, read without a parser."""
    inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    inner = re.split(r"<footer>", inner)[0]
    blocks = re.split(r"</?(?:p|h1|div|article)[^>]*>", inner)
    return "\n\n".join(filter(None, (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in blocks)))


def test_the_template_decides_on_pages_without_telling_names(spark, small):
    """The table's pages with every telling tag and class renamed: the text stays the article's, and names alone would give another on most pages."""
    given = spark.read.parquet(f"{small}/../sf0.01/pages.parquet").where("html is not null")
    blank = given
    for old, new in (("nav", "div"), ("article", "div"), ("footer", "div")):
        blank = blank.withColumn("html", F.regexp_replace("html", f"<{old}>", f'<{new} class="k{old[:1]}">')).withColumn("html", F.regexp_replace("html", f"</{old}>", f"</{new}>"))
    blank = blank.withColumn("html", F.replace("html", F.lit('class="ad"'), F.lit('class="kk"')))
    got = {r.page_id: r.text for r in templates.extract(blank).collect()}
    want = {r.page_id: plain_article(r.html) for r in given.collect()}
    same = [got[i] == want[i] for i in want]
    assert np.mean(same) >= 0.99
    alone = [templates.main_text(r.html, templates.Template()) == want[r.page_id] for r in blank.collect()]
    assert np.mean(alone) < 0.1
    plain = {r.page_id: r.text for r in templates.extract(given).collect()}
    assert np.mean([plain[i] == want[i] for i in want]) >= 0.99


def test_classes_against_explicit_vectors(spark):
    """Occurrence vectors written out, page by page, give the same valid tokens as their fingerprints."""
    rng = np.random.default_rng(8)
    html = [page(i, "".join(f"<div class=s{'ab'[int(rng.integers(2))]}><h2>Part</h2><p>Text {i} {j}</p></div>" for j in range(int(rng.integers(1, 4))))) for i in range(30)]
    html += [html[3], html[4]]
    df = spark.createDataFrame([(h,) for h in html], "html string").selectExpr("'x.example' as host", "html")
    rows = templates.classes(Workspace(spark, "t"), df).where("kind > 0").collect()
    got = {r.token for r in rows if r.valid}
    pages = [templates.tokens(h) for h in html]
    vectors: dict = {}
    for t in set().union(*pages) - {0}:
        v = tuple(p[t][1] if t in p else 0 for p in pages)
        kind = next(p[t][0] for p in pages if t in p)
        if sum(x > 0 for x in v) >= len(pages) / 2:
            vectors.setdefault(v, []).append((t, kind))
    want = {t for group in vectors.values() if len(group) >= templates.SIZE and any(k != templates.TEXT for _, k in group) for t, _ in group}
    signed = {t - (1 << 64) if t >> 63 else t for t in want}
    assert got == signed and len(signed) > 10


def test_adverts_inside_the_article_go_and_titles_stay(spark):
    lines = ["Buy one now", "Our cheap tea", "Best shoes here"]
    bodies = [f"<div class=x1><h1>Title {i}</h1><p>Story {i} {'tale ' * 20}</p><div class=q7><p>{lines[i % 3]}</p></div><p>Then {i} came.</p></div><div class=x2><p>Said of {i}</p></div>" for i in range(24)]
    got = extracted(spark, [f"<html><body><div class=m><a href=/>home</a></div>{b}</body></html>" for b in bodies])
    assert got[5] == f"Title 5\n\nStory 5 {'tale ' * 20}".strip() + "\n\nThen 5 came."
    deep = "<div>" * 20000 + "text" + "</div>" * 20000
    assert extracted(spark, [deep, "<b", "a < b"], None) == {0: "text", 1: "", 2: "a < b"}
