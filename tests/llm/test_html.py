"""Main text of pages: what containers say, what the cut decides, and the cut beside all labellings."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from terrace.llm import html_extract as h
from terrace.llm import queries

LONG = "The house stands at the end of a long road, and nobody has lived there since the year of the flood."
OTHER = "In the evening the windows catch the sun, so that from the village it looks as if there were a fire."
MENU = "<div><div><a href=/a>Home</a></div><div><a href=/b>News of today</a></div><div><a href=/c>All about us here</a></div>{}</div>"


def test_only_the_cut_keeps_short_lines_among_paragraphs():
    """No container says anything: a short line scores as boilerplate by itself, and stays for its neighbours."""
    page = MENU.format("") + f"<div><div>{LONG}</div><div>The road</div><div>{OTHER}</div><div>Yes.</div><div>{LONG} {OTHER}</div></div>"
    found = {text: (score > 0, keep) for text, score, keep in h.labelled(page)}
    assert found["The road"] == found["Yes."] == (False, True)
    assert found[LONG] == found[OTHER] == (True, True)
    assert found["Home"] == found["News of today"] == (False, False)
    assert h.main_text(page) == "\n\n".join([LONG, "The road", OTHER, "Yes.", f"{LONG} {OTHER}"])


def test_only_the_cut_drops_a_line_among_links():
    line = "Read all that we have written, today and long ago, on one page here."
    weak = tuple(w * (0.4 if k else 0.3) for k, w in enumerate(h.DEFAULT))
    page = MENU.format(f"<div>{line}</div><div><a href=/d>Archive of the year</a></div>") + f"<div>{LONG}</div>"
    found = {text: (score > 0, keep) for text, score, keep in h.labelled(page, weak)}
    assert found[line][0] and not found[line][1] and found[LONG][1]


def test_containers_stand_against_the_cut():
    page = (
        f"<header><div>{LONG}</div></header><nav>{LONG}</nav><article><header><h1>Head</h1></header><p>{LONG}</p><div class='ad box'>{OTHER}</div>"
        f"<p>No.</p><aside>{OTHER}</aside><ul><li>One</li><li>Two &amp; three</li></ul><form><p>{LONG}</p></form><p>{OTHER}</p></article>"
        f"<div id='comments'><p>{LONG}</p></div><div class=cookie-notice>{LONG}</div><div hidden>{LONG}</div><footer>{LONG}</footer>"
    )
    assert h.main_text(page) == "\n\n".join(["Head", LONG, "No.", "One", "Two & three", OTHER])


def test_blocks_and_references():
    page = "<main><p>a\n b\u00a0c &eacute;&#8364;&lt;p&gt;<b>d</b>e<br>f<p>g<script>x</script>h<!-- no --> i</main><p>"
    assert h.main_text(page) == "a b c é€<p>de f\n\ngh i"
    for odd in ("", "<", "<p", "&", "<div>" * 3000 + LONG, "<article><p>" + "w " * 200_000, "</p></div>" * 50, "<a href='x>" + LONG):
        assert isinstance(h.main_text(odd), str)


def test_the_cut_is_the_cheapest_labelling():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        containers = [tuple(sorted(rng.sample(range(6), rng.randrange(0, 4)))) for _ in range(n)]
        edges = h.edges_of(containers)
        cost = lambda keep: sum(max(0, s) if not k else max(0, -s) for s, k in zip(scores, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])
        least = min(cost(keep) for keep in itertools.product((False, True), repeat=n))
        assert abs(cost(h.min_cut(scores, edges)) - least) < 0.02


def test_fit_is_where_the_likelihood_is_flat():
    rng = np.random.default_rng(1)
    good = rng.random(400) < 0.2
    x = np.c_[np.ones(400), rng.normal(size=(400, 2)) + good[:, None] * [1.0, -0.5]]
    w = h.fit(x, good)
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * 400
    slope = x.T @ (weight * (good - 1 / (1 + np.exp(-x @ w)))) - h.RIDGE * 400 * w
    assert np.abs(slope).max() < 1e-4 and w[1] > 0.5 and w[2] < -0.2


def page(k):
    rng = random.Random(k)
    words = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma.", "delta"]) for _ in range(n)) + "."
    parts = [words(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 6))]
    html = "<nav><ul>" + "".join(f"<li><a href=/{j}>{words(1)}</a>" for j in range(5)) + f"</ul></nav><div class=ad>{words(9)}</div><article><h1>Title {k}</h1>"
    return html + "".join(f"<p>{p}</p>" for p in parts) + f"</article><footer>{words(6)}</footer>", "\n\n".join([f"Title {k}", *parts])


def test_query(spark, tmp_path):
    rows = [(k, f"http://h/{k}", *page(k)) for k in range(40)] + [(40, None, None, ""), (41, "u", "", ""), (3, "u", *page(3)), (None, "u", *page(5))]
    columns = {"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows], "html": [r[2] for r in rows], "main_text": ["x"] * len(rows)}
    pq.write_table(pa.table(columns), f"{tmp_path}/pages.parquet")
    found = queries.op7_html_extraction(spark, str(tmp_path))
    assert sorted(map(str, found.collect())) == sorted(str(type(found.first())(**dict(page_id=i, url=u, text=t, n_chars=len(t)))) for i, u, _, t in rows)
    weights = h.learn(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    assert weights != h.DEFAULT and weights[h.FEATURES.index("links")] < 0
    pq.write_table(pa.table(columns).slice(0, 0), f"{tmp_path}/pages.parquet")
    assert queries.op7_html_extraction(spark, str(tmp_path)).count() == 0
    assert h.learn(spark.createDataFrame([(None,), ("<p>x",)], "html string")) == h.DEFAULT
