"""Main-text extraction by minimum-cut labelling.

A page becomes a sequence of text blocks with their places in the element tree. A logistic classifier over features of
a block (its length, links, element, the marks that elements around it carry) gives its log odds of being content;
they are the capacities of its two terminal edges. Neighbouring blocks, and a block and the element that holds it, are
joined by smoothness edges. The minimum cut, found by maximum flow, labels the blocks.

A mark (a class of "sidebar", a form) counts by the share of the page's text that stands below its element: what holds
nearly all text is a frame of the page and no sidebar. The classifier is fitted on generated pages of many layouts.
"""

from __future__ import annotations

import html
import random
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

#: Comments, CDATA, declarations, elements; an element whose quotes don't close ends at the first bracket; one cut
#: off by the end of the page is dropped.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
MARKED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")

#: Element names as HTML has them, and names that pages give to what is not the article.
DROPPED = frozenset("script style template noscript iframe svg math head title object canvas audio video select option textarea datalist".split())
RAW = frozenset("script style template noscript iframe title textarea svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
BOILERPLATE = frozenset("nav footer aside button menu dialog".split())
FRAMES = frozenset("form fieldset header".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BAD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr sidebar aside menu nav navigation navbar breadcrumb breadcrumbs footer masthead comment comments disqus reply replies discussion respond share sharing social related recommended newsletter subscribe subscription popup pagination pager copyright".split())
BAD_STARTS = ("advert", "adsense", "adbox", "adslot", "sponsor", "comment", "cookie", "newsletter", "sidebar", "navbar", "navig", "footer", "promo", "banner", "breadcrumb", "popup", "discuss", "subscri", "copyright")
DOUBTFUL = frozenset("notice notices alert header signup login modal overlay toolbar legal disclaimer widget skip complementary contentinfo search top bottom tools meta".split())
GOOD = frozenset("article content post entry story main body text".split())
TALK = ("comment", "disqus", "repl", "discuss", "respond")
#: What stands before the name of something that a page has or lacks as a whole.
ABOUT = frozenset("has no with without layout is not hide single page template js".split())


class Block:
    """Text of one block: the strings it is made of, how much of it is inside links, and where it stands."""

    __slots__ = ("holder", "linked", "tag", "text")

    def __init__(self, holder: int, tag: str):
        self.holder, self.tag, self.text, self.linked = holder, tag, [], 0


class Element:
    """An element: its parent, tag, mark (0 none, 1 boilerplate, 2 doubtful), whether it is a discussion or named like
    content."""

    __slots__ = ("good", "mark", "parent", "tag", "talk")

    def __init__(self, parent: int, tag: str, mark: int = 0, good: bool = False, talk: bool = False):
        self.parent, self.tag, self.mark, self.good, self.talk = parent, tag, mark, good, talk


def _attributes(written: str, tag: str) -> tuple[int, bool, bool, bool]:
    """(mark, named like content, a discussion, hidden) of one element."""
    mark, good, talk, hidden = 1 if tag in BOILERPLATE else 2 if tag in FRAMES else 0, tag in ("article", "main"), False, False
    if written and ("=" in written or "hidden" in written):
        for name, value in MARKED.findall(written):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
            elif name in ("class", "id", "role"):
                for label in value.split():
                    words = NAME.findall(label)
                    if len(words) > 1 and words[0] in ABOUT:
                        continue
                    if any(w in BAD or w.startswith(BAD_STARTS) for w in words):
                        mark = 1
                        talk = talk or any(w.startswith(TALK) for w in words)
                    elif any(w in DOUBTFUL for w in words):
                        mark = mark or 2
                    elif any(w in GOOD for w in words):
                        good = True
    return mark, good and not mark, talk, hidden


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and its elements, the first being the page itself."""
    elements, out = [Element(-1, "")], []
    # open elements: tag, number, hidden, link
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    block: Block | None = None
    at, n = 0, len(page)
    lower: str | None = None

    def add(text: str) -> None:
        nonlocal block
        top = stack[-1]
        if top[2] or not text:
            return
        if block is None:
            if not text.strip():
                return
            k = len(stack) - 1
            while stack[k][0] in INLINE:
                k -= 1
            block = Block(stack[k][1], stack[k][0])
        block.text.append(text)
        if top[3]:
            block.linked += len(text)

    def end() -> None:
        nonlocal block
        if block is not None:
            out.append(block)
            block = None

    while at < n:
        found = MARKUP.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        closing, tag, written = found[1], found[2], found[3]
        if tag is None and found[5] is not None:
            closing, tag, written = found[4], found[5], found[6]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                add(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        end()
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
        else:
            end()
            if tag in CLOSES_P or tag in ("li", "tr", "td", "th", "dt", "dd"):
                ends = "p" if tag in CLOSES_P else tag
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == ends:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE and stack[k][0] != "p":
                        break
        if tag in VOID or written.endswith("/"):
            continue
        top = stack[-1]
        mark, good, talk, hidden = _attributes(written, tag)
        if tag in RAW:
            if lower is None:
                lower = page.lower()
            close = lower.find(f"</{tag}", at)
            at = n if close < 0 else close
        elements.append(Element(top[1], tag, mark, good, talk))
        stack.append((tag, len(elements) - 1, top[2] or hidden or tag in DROPPED, top[3] or tag == "a"))
    end()
    return out, elements


def surroundings(found: list[tuple[Block, str]], elements: list[Element]) -> list[tuple[float, float, bool]]:
    """For each element (how surely it is boilerplate, how surely it is by a doubtful mark, whether it is content by name).

    A mark is weighed by the share of the page's text below its element. One that holds an article and most text is a
    frame; a boilerplate mark otherwise only fades where it holds nearly all, a doubtful one where it holds half.
    """
    n = len(elements)
    below, holds = [0] * n, [False] * n
    for block, text in found:
        below[block.holder] += len(text)
    total = max(1, sum(below))
    for i in range(n - 1, 0, -1):
        e = elements[i]
        below[e.parent] += below[i]
        holds[e.parent] = holds[e.parent] or holds[i] or e.tag in ("article", "main")
    out: list[tuple[float, float, bool]] = [(0.0, 0.0, False)]
    for i in range(1, n):
        e, share = elements[i], below[i] / total
        bad, doubtful, good = out[e.parent]
        if e.mark and e.tag not in ("body", "html") and not (e.tag == "header" and good):
            if holds[i] and not e.talk:
                strength = (0.6 - share) / 0.3
            elif e.mark == 1:
                strength = (1.0 - share) / 0.15
            else:
                strength = (0.8 - share) / 0.3
            strength = min(1.0, max(0.0, strength))
            if e.mark == 1:
                bad = max(bad, strength)
            else:
                doubtful = max(doubtful, strength)
            good = good and strength < 0.5
        out.append((bad, doubtful, good or e.good))
    return out


def features(found: list[tuple[Block, str]], elements: list[Element]) -> np.ndarray:
    """One row of features for each block."""
    around = surroundings(found, elements)
    words = [min(text.count(" ") + 1, 60) for _, text in found]
    rows = []
    for i, (block, text) in enumerate(found):
        bad, doubtful, good = around[block.holder]
        n, near = words[i], words[max(0, i - 1) : i] + words[i + 1 : i + 2]
        linked = min(1.0, block.linked / max(1, sum(map(len, block.text))))
        rows.append([
            1.0, min(n, 40) / 40, float(n <= 3), linked, linked * float(n <= 10), float(text[-1:] in ".!?:;\"'”’…"),
            float(block.tag in ("p", "pre", "blockquote")), float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(block.tag in ("li", "td", "th", "dt", "dd")),
            bad, doubtful, float(good), float(text[:1] == "©" or text[:9].lower() == "copyright"), sum(near) / max(1, len(near)) / 60,
        ])
    return np.array(rows)


def _generated(rng: random.Random) -> str:
    """A page of some layout; words of the article begin with k, those of everything else don't."""
    word = lambda first: first + "".join(rng.choice("aeioutrnsl") for _ in range(rng.randrange(1, 9)))
    say = lambda n, first="b", end=".": " ".join(word(first) for _ in range(n)) + (end if rng.random() < 0.9 else "")
    links = lambda n: "".join(f"<li><a href='#'>{say(rng.randrange(1, 4), end='')}</a></li>" for _ in range(n))

    def box(names: str, inner: str, tags: str = "div section ul") -> str:
        name = rng.choice(names.split())
        return f'<{(tag := rng.choice(tags.split()))} {rng.choice(["class", "id"])}="{name}">{inner}</{tag}>'

    def article() -> str:
        out = [f"<{(h := rng.choice(['h1', 'h1', 'h2']))}>{say(rng.randrange(2, 10), 'k', '')}</{h}>"] if rng.random() < 0.9 else []
        for _ in range(rng.randrange(1, 14)):
            kind, n = rng.random(), rng.choice([2, 4, 9, 20, 40, 80, 120])
            if kind < 0.72:
                out.append(f"<p>{say(n, 'k')} <a href='#'>{say(2, 'k', '')}</a> {say(n, 'k')}</p>" if rng.random() < 0.2 else f"<p>{say(n, 'k')}</p>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>{say(rng.randrange(2, 15), 'k', '')}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<h3>{say(rng.randrange(1, 7), 'k', '')}</h3>")
            elif kind < 0.92:
                out.append(f"<blockquote>{say(n, 'k')}</blockquote>")
            elif kind < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{say(rng.randrange(1, 4), 'k', '')}</td>" for _ in range(4)) + "</tr></table>")
            else:
                out.append(rng.choice([box("ad advert sponsored-box", f"<p>{say(rng.randrange(3, 30))}</p>"), f"<form><p>{say(rng.randrange(3, 20))}</p><input></form>", box("share social-links related", links(3))]))
        return "".join(out)

    inner = article()
    frame = rng.choice(["{}", "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div class='post entry'>{}</div>", "<div>{}</div>", "<div><div>{}</div></div>", "<section>{}</section>"]).format(inner)
    top = rng.choice([f"<header><h1>{say(3, end='')}</h1><p>{say(9)}</p></header>", box("header masthead site-header top", f"<p>{say(rng.randrange(2, 12))}</p>"), ""])
    menu = rng.choice([f"<nav><ul>{links(6)}</ul></nav>", box("menu navbar main-navigation", links(5)), f"<ul>{links(5)}</ul>"])
    notice = rng.choice([box("cookie-banner gdpr-consent notice", f"<p>{say(rng.randrange(5, 50))}</p>"), "", box("ad advert", say(rng.randrange(3, 15)), "div")])
    side = rng.choice(["", f"<aside><p>{say(rng.randrange(5, 40))}</p><ul>{links(4)}</ul></aside>", box("sidebar widget right-sidebar", f"<h3>{say(2, end='')}</h3><p>{say(rng.randrange(3, 40))}</p>")])
    talk = rng.choice(["", "", box("comments comment-list disqus_thread", "".join(f"<article><p>{say(rng.randrange(3, 70))}</p></article>" if rng.random() < 0.5 else f"<div><p>{say(rng.randrange(3, 70))}</p></div>" for _ in range(rng.randrange(1, 7))))])
    foot = rng.choice([f"<footer><p>&copy; {say(rng.randrange(2, 20))}</p></footer>", box("footer legal copyright", f"<p>{say(rng.randrange(3, 25))}</p><ul>{links(3)}</ul>"), f"<p>&copy; {say(4)}</p>"])
    whole = top + menu + notice + (frame + talk + side if rng.random() < 0.7 else side + frame + talk) + foot
    whole = rng.choice(["{}", "{}", "{}", "<div class='page has-sidebar'>{}</div>", "<form id='aspnetForm'>{}</form>", "<div class='widget'>{}</div>", "<div class='wrap'>{}</div>"]).format(whole)
    return f"<html><head><title>t</title><script>var b = '<p>';</script></head><body class='{rng.choice(['', 'has-sidebar', 'no-comments single-post', 'layout-search'])}'>{whole}</body></html>"


def _texts(page: str) -> tuple[list[tuple[Block, str]], list[Element]]:
    """The blocks of a page that hold text, with it, and the elements."""
    found, elements = blocks(page)
    texts = [" ".join(html.unescape("".join(b.text)).split()) for b in found]
    return [(b, t) for b, t in zip(found, texts, strict=True) if t], elements


@lru_cache(maxsize=1)
def classifier(pages: int = 400, seed: int = 42, ridge: float = 0.3) -> tuple[float, ...]:
    """Weights of the features: logistic regression by Newton steps over the blocks of generated pages."""
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        found, elements = _texts(_generated(rng))
        rows.append(features(found, elements))
        labels += [text.lstrip("© ")[:1] == "k" for _, text in found]
    x, y = np.concatenate(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]], nodes: int) -> np.ndarray:
    """Which of `nodes` nodes stand on the source side; node i < len(scores) is tied to a terminal by scores[i].

    Maximum flow by shortest augmenting paths in layers; links carry their capacity both ways.
    """
    source, sink = nodes, nodes + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(nodes + 2)]

    def edge(u: int, v: int, there: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(there)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            edge(source, i, s, 0.0)
        elif s < 0:
            edge(i, sink, -s, 0.0)
    for u, v, c in links:
        edge(u, v, c, c)
    while True:
        level = [-1] * (nodes + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([level[i] >= 0 for i in range(nodes)], dtype=bool)
        at = [0] * (nodes + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(out[u][at[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1


def main_text(page: str, near: float = 0.6, inside: float = 0.9, weights: tuple[float, ...] | None = None) -> str:
    """The article of a page: its content blocks in page order, joined by two line breaks; empty if there are none.

    `near` is the smoothness between neighbouring blocks, `inside` that between a block and its parent element.
    Blocks of which one surely stands in boilerplate and the other surely doesn't are not tied.
    """
    found, elements = _texts(page)
    if not found:
        return ""
    x = features(found, elements)
    scores = (x @ np.array(weights or classifier())).tolist()
    marked = (np.maximum(x[:, 9], x[:, 10]) > 0.5).tolist()
    holders: dict[int, int] = {}
    links = []
    for i, (b, _) in enumerate(found):
        own = elements[b.holder].parent if b.holder else 0
        node = holders.setdefault(own, len(found) + len(holders))
        if not marked[i]:
            links.append((i, node, inside))
        if i and marked[i - 1] == marked[i]:
            links.append((i - 1, i, near))
    side = minimum_cut(scores, links, len(found) + len(holders))
    return "\n\n".join(t for (_, t), content in zip(found, side[: len(found)].tolist(), strict=True) if content)


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None, rows: int = 128) -> DataFrame:
    """`keep` columns (default page_id, url) with `text`, the main text, and `n_chars`, its code points.

    A null or empty page, and one without content blocks, has an empty text. Repeated rows each keep their row; an
    empty table gives no rows. Null ids and addresses are kept as they are.
    """

    weights = classifier()

    def work(texts: list[str]) -> list[pa.Array]:
        made = [main_text(t, weights=weights) for t in texts]
        return [pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())]

    return map_text(pages, page, keep or ["page_id", "url"], work, [("text", "string"), ("n_chars", "long")], rows)


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
