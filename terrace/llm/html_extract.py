"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text (what stands between block-level tags). The cost of calling a block content or
boilerplate has two parts. What its text says is a logistic curve over a few features, fitted on the pages themselves: on a bounded sample of pages, blocks in containers that name themselves (``article`` and the like;
``nav``, ``footer``, ``class="ad"`` and the like) are the labelled ones, and the curve is applied to all. What the
containers say themselves is a fixed weight on top, as they are what labels were taken from. Both together are the
capacities from the source and to the sink. Blocks next to each other, and consecutive blocks of the same container,
are joined by edges whose capacity grows with how deep their common container is, of the order of what a text can
say. The minimum cut labels all blocks of a page at once: where containers say nothing, a heading or a short line goes
with the paragraphs around it, and a lone sentence with the menu it stands in.

White space inside a block becomes one space; character references are decoded; blocks of content are joined by
an empty line in page order. Scripts, styles, comments and markup are never text. Broken markup is read as far
as it goes: open tags are closed by their container, a cut tag at the end is dropped. Null and empty pages, and
pages without content, give the empty text. Pages are read whole and each for itself, repeated ones too. An empty
table gives an empty result; a column named ``main_text`` is replaced, all others pass through.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import add_columns, ship, slices, texts

#: Tags that never hold page text.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "audio", "video"}
#: Tags that stand within a line of text; every other tag ends a block.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rb rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Containers that name themselves content or boilerplate.
GOOD_TAGS = {"article", "main"}
BAD_TAGS = set("nav aside footer header form button select textarea fieldset menu dialog option input".split())
#: Words in class, id and role that mark boilerplate or content.
BAD_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscri\w*|"
    r"signup|login|menu\w*|nav\w*|breadcrumbs?|sidebar\w*|side|widget\w*|footer|foot|header|masthead|toolbar|social|shar(?:e|ing)\w*|"
    r"related|recommend\w*|comments?|commentlist|replies|reply|disqus|respond|pagination|pager|tags|search\w*|copyright|legal|disclaimer|"
    r"complementary|contentinfo|navigation|dialog|form)(?:[^a-z]|$)"
)
GOOD_NAMES = re.compile(r"(?:^|[^a-z])(?:article\w*|content|main|post|entry|story|body|text)(?:[^a-z]|$)")
#: What containers say; boilerplate in content is boilerplate. ``header`` in an ``article`` may hold its heading.
GOOD, BAD = 3.0, -8.0
#: Most that a text can say, and pages whose blocks the curve is fitted on.
TEXT, SAMPLE_PAGES = 2.5, 2000
#: Features of a block's text. Its tag is none: in pages of one make tags tell all, and of another make nothing.
FEATURES = ("constant", "links", "length", "sentence", "one word", "commas", "digits")
#: The curve where nothing can be learnt; blocks of a kind that are needed to learn, decay of the weights by block.
DEFAULT, LEAST, RIDGE = (-0.6, -4.0, 3.0, 0.6, -0.4, 0.3, -0.3), 20, 2e-3
#: Capacities of the edges: neighbours, neighbours in one container, consecutive blocks of a container farther apart.
NEAR, SAME, FAR = 0.3, 1.2, 0.5
SCALE = 1000


#: A comment, a declaration or a tag: slash, name, attributes. A quoted value may hold ``>``.
TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">])*+)>)""", re.S)
#: The same where quotes don't close: up to the next ``>``, or cut at the end of the page.
BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
#: Tags whose content is not markup.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}


class _Blocks:
    """Blocks as (text, linked characters, what containers say: -1, 0 or 1, containers from the outside in)."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.open: list[tuple[str, int, int]] = []
        self.count = self.hidden = self.links = self.linked = 0
        self.text: list[str] = []
        at = 0
        while (next_ := html.find("<", at)) >= 0:
            self.data(html[at:next_])
            found = TAG.match(html, next_)
            if not found and html.find(">", next_) < 0 and re.match(r"</?[a-zA-Z]", html[next_ : next_ + 3]):
                at = len(html)  # a tag that the end of the page cuts
                break
            found = found or BROKEN_TAG.match(html, next_)
            if not found:  # a sign in the text
                self.data("<")
                at = next_ + 1
                continue
            at = found.end()
            close, tag, attributes = found.groups()[:3]
            if not tag:
                continue
            tag = tag.lower()
            if close:
                self.end(tag)
            else:
                self.start(tag, attributes)
                if tag in RAW:
                    stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    at = stop.start() if stop else len(html)
        self.data(html[at:])
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            said = {w for _, _, w in self.open}
            around = -1 if -1 in said else 1 if 1 in said else 0
            self.blocks.append((text, self.linked, around, tuple(n for _, n, _ in self.open)))
        self.text, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in HIDDEN:
            if tag == "head":
                return  # may be left open; what it holds is hidden by itself
            self.hidden += tag not in VOID
            return
        if tag in INLINE:
            self.links += tag == "a"
            if tag == "br":
                self.text.append(" ")
            return
        self.flush()
        if tag in ("body", "html") or tag in VOID:
            return
        if tag in ("p", "li", "td", "th", "tr", "option", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.close(tag, {"ul", "ol", "table", "dl", "article", "main", "section", "div", "nav", "aside", "footer", "header"})
        says = -1 if tag in BAD_TAGS else 1 if tag in GOOD_TAGS else 0
        if tag == "header" and any(t in GOOD_TAGS for t, _, _ in self.open):
            says = 0
        attrs = []
        if attributes:
            found = (m.groups("") for m in ATTRIBUTE.finditer(attributes))
            attrs = [((g[0] or g[4]).lower(), unescape(g[1] or g[2] or g[3])) for g in found]
        names = " ".join(v.lower() for k, v in attrs if v and k in ("class", "id", "role"))
        if names:
            says = -1 if BAD_NAMES.search(names) else says or int(bool(GOOD_NAMES.search(names)))
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                says = -1
        self.count += 1
        self.open.append((tag, self.count, says))

    def close(self, tag: str, until: set[str]) -> None:
        """Close the innermost open ``tag`` and all in it, unless one of ``until`` is in between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in until:
                return

    def end(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - (tag != "head"))
        elif tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
        else:
            self.flush()
            self.links = 0
            self.close(tag, set())

    def data(self, data: str) -> None:
        if data and not self.hidden:
            data = unescape(data) if "&" in data else data
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    return _Blocks(html).blocks


def features_of(text: str, linked: int) -> list[float]:
    words = text.count(" ") + 1
    sentence = text.rstrip("\"')»”")[-1:] in ".!?…:;" or words > 25
    some = text[:400]  # shares of signs; all else counts the whole text
    return [
        1.0,
        min(1.0, linked / max(1, len(text))),
        min(words, 40) / 40,
        float(sentence),
        float(words == 1),
        min(1.0, 8 * (some.count(",") + some.count(";")) / max(1, len(some.split()))),
        sum(c.isdigit() for c in some) / max(1, len(some)),
    ]


def fit(features: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton's steps, both kinds of blocks counting the same; held near zero."""
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * len(good)
    x = np.zeros(features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ x, -30, 30)))
        gradient = features.T @ (weight * (good - p)) - RIDGE * len(good) * x
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + RIDGE * len(good) * np.eye(len(x))
        step = np.linalg.solve(curve, gradient)
        x = x + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return x


def score(text: str, linked: int, around: int, weights: tuple[float, ...]) -> float:
    """Over 0: rather content."""
    said = sum(w * f for w, f in zip(weights, features_of(text, linked)))
    return max(-TEXT, min(TEXT, said)) + (GOOD if around > 0 else BAD if around else 0.0)


def edges_of(containers: list[tuple[int, ...]]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours on the page, and consecutive blocks whose innermost container holds both."""
    found, last = [], {}
    for k, path in enumerate(containers):
        if k:
            before = containers[k - 1]
            common = next((i for i, (a, b) in enumerate(zip(path, before)) if a != b), min(len(path), len(before)))
            deep = common / max(1, max(len(path), len(before)))
            found.append((k - 1, k, NEAR + (SAME - NEAR) * deep))
        holder = path[-2:-1]
        if holder in last and last[holder] != k - 1:
            found.append((last[holder], k, FAR))
        last[holder] = k
    return found


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks are on the source's side of the minimum cut, by Dinic's maximum flow."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    capacity: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        capacity.append(round(forth * SCALE))
        at[b].append(len(to))
        to.append(a)
        capacity.append(round(back * SCALE))

    for k, s in enumerate(scores):
        if s > 0:
            join(source, k, s, 0)
        else:
            join(k, sink, -s, 0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if capacity[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(capacity[e] for e in path)
                cut = None
                for i, e in enumerate(path):
                    capacity[e] -= flow
                    capacity[e ^ 1] += flow
                    if cut is None and not capacity[e]:
                        cut = i
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            edges_here = at[a]
            while following[a] < len(edges_here):
                e = edges_here[following[a]]
                if capacity[e] and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                following[a] += 1
                continue
            path.append(e)
            a = to[e]


def labelled(html: str, weights: tuple[float, ...] = DEFAULT) -> list[tuple[str, float, bool]]:
    """Each block's text, its score by itself, and whether the cut leaves it as content."""
    blocks = blocks_of(html)
    scores = [score(text, linked, around, weights) for text, linked, around, _ in blocks]
    keep = min_cut(scores, edges_of([b[3] for b in blocks])) if blocks else []
    return [(b[0], s, k) for b, s, k in zip(blocks, scores, keep)]


def main_text(html: str, weights: tuple[float, ...] = DEFAULT) -> str:
    """The blocks that the cut leaves as content."""
    return "\n\n".join(text for text, _, keep in labelled(html, weights) if keep)


def learn(pages: DataFrame, html: str = "html") -> tuple[float, ...]:
    """The curve fitted on blocks whose containers name themselves, of the ``SAMPLE_PAGES`` pages that hash lowest."""
    own = pages.select(F.col(html).alias("html")).where("html IS NOT NULL").withColumn("mark", F.xxhash64("html"))
    last = own.select("mark").distinct().orderBy("mark").limit(SAMPLE_PAGES).agg(F.max("mark")).first()[0]
    if last is None:
        return DEFAULT

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "html"):
                out = []
                for value in rows.column("html").to_pylist():
                    found = [[around, *features_of(text, linked)] for text, linked, around, _ in blocks_of(value) if around]
                    out.append(np.array(found, "<f4").tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("mark"), pa.array(out, pa.binary())], names=["mark", "blocks"])

    ship(pages.sparkSession)
    sample = own.where(F.col("mark") <= last).dropDuplicates(["mark"]).select("mark", "html")
    found = sorted(map(tuple, sample.mapInArrow(run, "mark long, blocks binary").collect()))
    table = np.frombuffer(b"".join(bytes(b) for _, b in found), "<f4").reshape(-1, len(FEATURES) + 1).astype(float)
    good = table[:, 0] > 0
    if min(good.sum(), (~good).sum()) < LEAST:
        return DEFAULT
    return tuple(fit(table[:, 1:], good).tolist())


def extract(pages: DataFrame, html: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """``pages`` with ``main_text``, the page's content. Without ``weights`` the curve is fitted on the pages."""
    weights = learn(pages, html) if weights is None else weights
    return add_columns(texts(pages, html), html, "main_text string", lambda values: [[main_text(v, weights) for v in values]])
