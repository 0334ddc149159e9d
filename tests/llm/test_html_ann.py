import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import ann, html_text

P = "A long paragraph of the article, with commas, stops and words enough to count. "


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        "<nav><a>Menu</a></nav><article><h1>Head</h1><p>{p}</p><p>{p}</p></article><footer>&copy; me</footer>",
        "<header><a>Site</a></header><div class='sidebar'><p>{p}</p></div><div id=main><h1>Head</h1><p>{p}<p>{p}</div><aside>more</aside>",
        "<main><h1>Head</h1><p>{p}</p><div class=\"ad\">Buy now, cheap.</div><p>{p}</p><section class='comments'><p>{p}{p}</p></section></main>",
        "<div class=cookie-notice>We use cookies.</div><article><h1>Head</h1><script>var a='</p>';</script><p><b>{p}<br><p>{p}</article><form><input><p>{p}</p></form>",
        "<article><h1>Head</h1><!-- <p>no</p> --><p>{p}</p><style>p{{}}</style><p hidden>{p}</p><p>{p}</p><ul class='share'><li>Tweet</li></ul></article>",
    ],
)
def test_article_alone(body):
    assert html_text.main_text(page(body.format(p=P))) == "\n".join(["Head", P.strip(), P.strip()])


@pytest.mark.parametrize(
    "body",
    [
        "<div class='page with-sidebar'><nav>Menu</nav><article class='article-body comments-open'><h1>Head</h1><p>{p}</p><p class='related-work'>{p}</p></article></div>",
        "<div class=no-sidebar><div class=top><a>Log in</a></div><h1>Head</h1><div class=text><p>{p}</p><p>{p}</p></div><div class=bottom>Imprint</div></div>",
        "<div id=page><div class=menu><a>A</a><a>B</a></div><div class=title><h1>Head</h1></div><div class=body><p>{p}</p></div><div><p>{p}</p></div></div><div id=legal>Terms</div>",
        "<article><h1>Head</h1><section id=discussion><p>{p}</p></section><div class=related><a>x</a> <a>y</a></div><p>{p}</p></article>",
        "<main><h1>Head</h1><p>{p}</p><p>{p}</p><section class=comments><article><h4>me</h4><p>{p}</p></article><article><p>{p}{p}</p></article></section></main>",
    ],
)
def test_names_are_a_weight_and_ratios_choose(body):
    assert html_text.main_text(page(body.format(p=P))) == "\n".join(["Head", P.strip(), P.strip()])


def test_captions_and_formulas_stay():
    got = html_text.main_text(page(f"<article><h1 id='related-work'>Head</h1><p>{P}<math><mi>x</mi><mo>+</mo><mn>1</mn></math></p><figure><img src=a><figcaption>A figure.</figcaption></figure><p>short</p></article>"))
    assert got == f"Head\n{P}x+1\nA figure.\nshort"


def test_long_and_deep_pages_take_linear_time():
    import time

    texts = ["<a " * 350_000, "<a " * 350_000 + ">", '<a "' * 250_000, "<a x='" * 150_000, "<div>" * 100_000, "<div>x" * 100_000 + "</span>" * 100_000, "<b>x" * 100_000 + "<div></div>" * 50_000, "<p><b>" * 50_000, "<!--" * 100_000, "<script>" * 100_000, "<li><div>" * 50_000]
    for t in texts:
        start = time.process_time()
        assert isinstance(html_text.main_text(t), str)
        assert time.process_time() - start < 3, t[:20]


def test_references_and_white_space():
    got = html_text.main_text(page("<article><p>a&amp;b &lt;x&gt;\n\n  caf&eacute; &#9731; <em>in</em>line</p><p>  </p><ul><li>one<li>two</ul></article>"))
    assert got == "a&b <x> café ☃ inline\none\ntwo"


@pytest.mark.parametrize("bad", [None, "", "   ", "<", "<p", "<p>x", "plain text", "<script>never closed", "<div><div><div>", "</p></p>", "<a href='unclosed>text</a>"])
def test_broken_pages(bad):
    assert isinstance(html_text.main_text(bad), str)


def test_extract_rows(spark):
    rows = [(1, "u", page("<article><p>" + P + "</p></article>")), (2, None, None), (None, "u", ""), (3, "v", page("<article><p>" + P * 3000 + "</p></article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in rows]
    assert html_text.extract(df.limit(0)).collect() == []


def brute(rows, k):
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    return {q: sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:k] for q in x if q % 100 == 0}


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for g in ann.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(g.query_id, {})[g.rank] = (g.score, g.vec_id)
    want = brute(rows, 10)
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    assert all([v[k] for k in sorted(v)] == sorted(v.values()) for v in got.values())
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in v.values()}) / 10 for q, v in got.items()]) >= 0.9
    for q, v in got.items():
        for s, i in v.values():
            assert s == float(np.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum()))


def test_odd_vectors_and_many_copies(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (200, [0.0, 0.0]), (None, [1.0, 1.0])]
    rows += [(1000 + i, [1.0, 0.0]) for i in range(1, 60)] + [(7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("clash")).withColumn("id", F.lit(0))
    got = {}
    for g in ann.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    assert set(got) == {0, 100}
    assert sorted(got[0]) == [(1, 100, 0.0)] + [(k + 1, 1000 + k, 0.0) for k in range(1, 10)]
    assert sorted(got[100])[0] == (1, 0, 0.0)
    few = df.filter("vec_id in (0, 7)")
    assert [(g.query_id, g.vec_id) for g in ann.nearest(few, few.filter("vec_id = 0")).collect()] == [(0, 7)]
    assert ann.nearest(df.limit(0), df).collect() == []


def test_vectors_of_another_length_dont_drop_the_others(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0, 2.0]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    assert {g.query_id for g in got} == {0, 100, 200} and len(got) == 30 and max(g.vec_id for g in got) < 300
