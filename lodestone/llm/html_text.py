"""Main text of HTML pages by minimum cut.

A page becomes text blocks (runs of text between block-level tags). The graph has a node for
each block and one for each element that says by its tag, role, class or id what it holds.

* Blocks: a linear classifier of the block alone (its tag, link density, length, punctuation)
  gives log-odds of being content, held to OWN. They are the capacity of the block's edge to
  the source (content) or the sink (boilerplate).
* Elements: what tag, role and words say, times the blocks that hang on the element.
* Smoothness: a block is tied to the innermost such element around it, and to the blocks next
  to it and to next siblings of the same parent, more strongly the nearer they lie in the DOM;
  an element that speaks for itself counts as a longer way.

Maximum flow gives the cut of least total cost, and blocks on the source side are the text. So
a short paragraph goes with its article and prose in an advert with the advert, against their
own log-odds, and where no element says anything a block goes with its neighbours. Nodes whose
log-odds exceed all their edges are decided before (they are so in every minimum cut), which
leaves small graphs for the flow.

``fit`` learns the classifier from pages that label themselves by an article or main element:
it sees none of the elements around a block, which give the label. The fixed weights PRIOR are
what it starts from, and all there is where no page has such an element.

The content of hidden elements and of head is no text of the page. Character references
are decoded, white space inside a block becomes one space, and blocks are joined by one
newline. Null, empty and text-less pages give an empty text. Every row is extracted by
itself, so repeated rows give equal texts.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag.
RAW = frozenset("script style title textarea noscript template iframe object svg math canvas audio video noframes".split())
#: What a start tag ends if it is open: an item by its like, a paragraph by any block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}

# Log-odds that elements give the blocks in them: for content (positive) or boilerplate.
TAG_WEIGHT = {
    "article": 2.5, "main": 2.0, "nav": -4.0, "menu": -4.0, "header": -3.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "fieldset": -3.0, "button": -3.0,
    "select": -4.0, "label": -2.0, "dialog": -4.0, "legend": -2.0,
}
ROLE_WEIGHT = {"main": 2.0, "article": 2.5, "navigation": -4.0, "banner": -4.0, "contentinfo": -4.0, "complementary": -4.0, "search": -4.0, "form": -4.0, "dialog": -4.0, "alert": -4.0, "menu": -4.0, "menubar": -4.0}
GOOD_WORDS = frozenset("article content entry main post story text".split())
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer discussion "
    "disqus feedback foot footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay paging pagination "
    "popup promo promoted promotion recommend recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
#: A word after one of these tells what a layout has beside its content, or lacks.
BESIDE = frozenset("has no with without".split())
WORD_SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
BAD, GOOD, MOST = -4.0, 1.5, 6.0
#: Features of a block that the classifier weighs, with the weights it starts from.
PRIOR = {
    "bias": -1.0, "links": -2.5, "length": 0.8, "sentence": 0.5,
    "h1": 1.5, "h2": 1.0, "h3": 0.75, "h4": 0.75, "p": 0.75, "blockquote": 0.5, "pre": 0.5, "li": 0.0, "td": 0.0,
}
OWN_TAGS = {tag: i for i, tag in enumerate(PRIOR) if tag in BLOCK}
#: Most log-odds that a block has by itself; capacity of its tie to an element. OWN with the
#: edges to two blocks of other elements is below TIE.
OWN, TIE = 1.25, 2.0
#: Pages that ``fit`` learns from at most, blocks of each, and the variance of a weight.
PAGES, BLOCKS, VARIANCE = 1000, 128, 4.0
#: Pages that label themselves.
LABELLED = r"(?i)<(article|main)[\s>]"
#: Smoothness of neighbours: NEAR / (1 + steps in the tree + WALL for each element between
#: them that has log-odds of its own); least capacity that counts.
NEAR, WALL, LEAST = 3.0, 6, 1e-9
#: Elements whose class words speak of the page as a whole.
WHOLE = ("html", "body")


@functools.lru_cache(8192)
def weight(tag: str, attrs: str) -> tuple[float, float, bool, bool]:
    """Log-odds for content and for boilerplate that an element gives the blocks in it,
    whether its tag or role speaks against content, and whether it is hidden."""
    told, hidden, role = [TAG_WEIGHT.get(tag, 0.0)], False, 0.0
    if attrs:
        found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
        words = WORD_SPLIT.split(CAMEL.sub(" ", html.unescape(f"{found.get('class', '')} {found.get('id', '')}")).lower()) if tag not in WHOLE else []
        named = {w for before, w in zip(["", *words], words, strict=False) if before not in BESIDE}
        role = ROLE_WEIGHT.get(found.get("role", "").lower(), 0.0)
        told += [BAD * bool(named & BAD_WORDS), GOOD * bool(named & GOOD_WORDS), role]
        style = found.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return max(0.0, *told, 0.0), sum(x for x in told if x < 0), min(told[0], role) < 0, hidden


def blocks(page: str) -> tuple[list[tuple[str, str, float, int, tuple[int, ...]]], dict[int, float]]:
    """(text, own tag, link density, element that it is tied to or 0, path of elements) of
    each block in order, and the log-odds of the elements that say what they hold."""
    out: list = []
    # of each open element: tag, number, log-odds for and against, whether it is hidden,
    # whether a tag or role on its path speaks against content, innermost element that says
    # what it holds
    stack: list[tuple[str, int, float, float, bool, bool, int]] = [("", 0, 0.0, 0.0, False, False, 0)]
    open_: dict[str, int] = {}
    walls: dict[int, float] = {}
    serial, linked = 0, False
    parts: list[str] = []
    chars = links = 0
    at, size = 0, len(page)

    def flush():
        nonlocal parts, chars, links
        if parts and not stack[-1][4]:
            text = " ".join("".join(parts).split())
            if text:
                density = links / chars if chars else 0.0
                out.append((text, stack[-1][0], density, stack[-1][6], tuple(e[1] for e in stack)))
        parts, chars, links = [], 0, 0

    def take(raw):
        nonlocal chars, links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            n = len(text) - text.count(" ")
            chars += n
            if linked:
                links += n

    def close(tag):
        while len(stack) > 1:
            name = stack.pop()[0]
            open_[name] -= 1
            if name == tag:
                return

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                take(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                linked = False
            elif tag in BLOCK:
                flush()
                if open_.get(tag):
                    close(tag)
            continue
        if tag in RAW:
            if not m["attrs"].endswith("/"):
                end = _end_tag(tag).search(page, at)
                at = end.end() if end else size
            if tag in ("object", "svg", "iframe", "noscript", "template", "video", "audio", "textarea"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append("\n")
        elif tag == "a":
            linked = True
        elif tag in BLOCK:
            flush()
            if tag != "head" and open_.get("head"):
                close("head")
            if open_.get("p"):
                close("p")
            for other in ENDS.get(tag, ()):
                if open_.get(other) and _inner(stack, other, tag):
                    close(other)
            if tag not in VOID:
                serial += 1
                good, bad, firm, hidden = weight(tag, m["attrs"])
                # inside what speaks against content, what is around it no longer speaks for
                # it; an article in an aside or a footer is a teaser
                _, _, around, against, covered, within, tied = stack[-1]
                if good or bad:
                    tied = serial
                good = 0.0 if firm or within else good if bad else max(around, good)
                stack.append((tag, serial, good, against + bad, covered or hidden or tag == "head", firm or within, tied))
                if tied == serial:
                    walls[serial] = max(-MOST, min(MOST, good + against + bad))
                open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out, walls


@functools.cache
def _end_tag(tag: str):
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


def _inner(stack: list, other: str, tag: str) -> bool:
    """Whether ``other`` is open inside the innermost list or table, so that tag ends it."""
    for name, *_ in reversed(stack):
        if name == other:
            return True
        if name in ("ul", "ol", "menu", "dl", "table", "select"):
            return False
    return False


def distance(a: tuple[int, ...], b: tuple[int, ...], walls=frozenset()) -> int:
    """Steps between two elements of the tree, by their paths; WALL more for each of
    ``walls`` that the way leaves or enters."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same + WALL * sum(x in walls for x in (*a[same:], *b[same:]))


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node pays -score if it is content (True), and an edge its
    weight if its ends differ."""
    n = len(scores)
    score = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(score[i]) >= sum(near[i].values()):
            label[i] = score[i] > LEAST
            for j, w in near[i].items():
                score[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    core = [i for i in range(n) if label[i] is None]
    if core:
        side = source_side(core, score, near)
        for i in core:
            label[i] = i in side
    return [bool(x) for x in label]


def source_side(core: list[int], score: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut, by Dinic's algorithm."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in core}
    cap[source] = {i: score[i] for i in core if score[i] > 0}
    cap[sink] = {}
    for i in core:
        if score[i] > 0:
            cap[i][source] = 0.0
        elif score[i] < 0:
            cap[i][sink] = -score[i]
            cap[sink][i] = 0.0
    while True:
        level, front = {source: 0}, [source]
        while front and sink not in level:
            after = []
            for u in front:
                for v, c in cap[u].items():
                    if c > LEAST and v not in level:
                        level[v] = level[u] + 1
                        after.append(v)
            front = after
        if sink not in level:
            return set(level)
        steps = {u: [v for v in cap[u] if level.get(v, 0) == level[u] + 1] for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                back = len(path)
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cap[a][b] <= LEAST:
                        back = k + 1
                path = path[:back]
                continue
            while steps[u] and cap[u][steps[u][-1]] <= LEAST:
                steps[u].pop()
            if steps[u]:
                path.append(steps[u][-1])
            else:
                path.pop()
                if path:
                    steps[path[-1]].pop()


def features(found: list[tuple]) -> list[tuple[float, float, float, int]]:
    """(link density, length, whether it ends a sentence, place of its tag's weight or -1) of
    each block."""
    return [(density, min(len(text) / 60, 3.0), float(text[-1] in ".!?…:"), OWN_TAGS.get(tag, -1)) for text, tag, density, _, _ in found]


def log_odds(rows: list[tuple[float, float, float, int]], w: list[float]) -> list[float]:
    """Log-odds of each block by the classifier's weights, held to OWN."""
    bias, by_links, by_length, by_end = w[:4]
    odds = [bias + by_links * links + by_length * length + by_end * end + (w[own] if own >= 0 else 0.0) for links, length, end, own in rows]
    return [max(-OWN, min(OWN, x)) for x in odds]


def labelled(page: str | None, weights: dict[str, float] = PRIOR) -> list[tuple[str, float, bool]]:
    """(text, log-odds, whether it is content) of each block of a page."""
    found, walls = blocks(page or "")
    scores = log_odds(features(found), list(weights.values()))
    n, places, edges, last = len(found), {}, [], {}
    for i, (_, _, _, tied, path) in enumerate(found):
        if tied:
            at = places.get(tied)
            if at is None:
                at = places[tied] = len(scores)
                scores.append(0.0)
            scores[at] += walls[tied]
            edges.append((i, at, TIE))
        if i:
            edges.append((i - 1, i, NEAR / (1 + distance(found[i - 1][4], path, walls))))
        up = path[-2] if len(path) > 1 else 0
        if up in last and last[up] != i - 1:
            edges.append((last[up], i, NEAR / (1 + distance(found[last[up]][4], path, walls))))
        last[up] = i
    labels = cut(scores, edges)
    return [(b[0], score, keep) for b, score, keep in zip(found, scores[:n], labels[:n], strict=True)]


def main_text(page: str | None, weights: dict[str, float] = PRIOR) -> str:
    return "\n".join(text for text, _, keep in labelled(page, weights) if keep)


def examples(page: str, masked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the classifier's features, and whether each block is content by the elements
    around it; of a page of more than BLOCKS blocks every second, third and so on. ``masked``
    hides the blocks' own tags."""
    found, walls = blocks(page)
    rows = features(found)
    every = range(0, len(rows), -(-len(rows) // BLOCKS) or 1)
    x = np.zeros((len(every), len(PRIOR)), np.float32)
    for k, i in enumerate(every):
        x[k, :4] = (1, *rows[i][:3])
        if rows[i][3] >= 0 and not masked:
            x[k, rows[i][3]] = 1
    return x, np.array([walls.get(found[i][3], 0.0) > 0 for i in every], bool)


def learned(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Weights of a logistic regression, by Newton's method with halved steps: the most likely
    ones if each is normally distributed about that of PRIOR, with VARIANCE."""
    start = np.array(list(PRIOR.values()))

    def cost(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + np.sum((w - start) ** 2) / (2 * VARIANCE)

    w, now = start, cost(start)
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(x @ w / 2))
        slope = x.T @ (y - p) - (w - start) / VARIANCE
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / VARIANCE, slope)
        while np.abs(step).max() > 1e-9 and not cost(w + step) < now:
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w + step
        now = cost(w)
    return dict(zip(PRIOR, w.tolist(), strict=True))


def fit(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights of the block classifier, learned from pages that have an article or main
    element: the PAGES of smallest hash (of all columns that can be hashed), at most BLOCKS
    blocks of each; of those of odd hash without the blocks' own tags, so that what is learned
    holds for pages of plain divisions. Tasks make the features; the driver gets those of the sample, 7 MB at
    most, and solves for 13 weights. Null and empty pages are not learned from; without pages
    of that kind the weights are PRIOR."""
    hashed = [F.col(f"`{c}`") for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    rows = pages.select(F.xxhash64(*hashed).alias("hash"), F.col(f"`{html_col}`").alias("html")).where(F.col("html").rlike(LABELLED))
    top = rows.select("hash").orderBy("hash").limit(PAGES).agg(F.max("hash")).first()[0]
    if top is None:
        return dict(PRIOR)

    def run(batches):
        for batch in batches:
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = examples(page, masked=bool(key & 1))
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([x.tobytes()]), pa.array([y.tobytes()])], ["hash", "x", "y"])

    # rows of one hash are equal, so a limit among them changes nothing
    told = rows.where(F.col("hash") <= top).mapInArrow(run, "hash long, x binary, y binary").orderBy("hash").limit(PAGES).collect()
    x = np.frombuffer(b"".join(r["x"] for r in told), np.float32).reshape(-1, len(PRIOR)).astype(np.float64)
    return learned(x, np.frombuffer(b"".join(r["y"] for r in told), bool))


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", weights: dict[str, float] = PRIOR) -> DataFrame:
    """df with the main text of its HTML instead of the HTML; a column of df that has the
    new name already is replaced. ``weights`` are those of ``fit``."""
    kept = [c for c in df.columns if c not in (html_col, text_col)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col).alias("__html"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [main_text(x, weights) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*kept, text_col])

    schema = "".join(f"`{c}` {t}, " for c, t in df.select(*[F.col(f"`{c}`") for c in kept]).dtypes)
    return source.mapInArrow(run, f"{schema}`{text_col}` string")
