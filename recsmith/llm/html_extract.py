"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of its block elements with the text runs between them as
leaves. Every node is content or not. Node potentials weigh features of a node
(tag, class words, text length, share of link text, and for text runs the tags
and class words above); parent-child potentials weigh the four joint states by
the kind of the child. Sum-product message passing, upward and then downward,
gives exact marginals; text runs with a content marginal over a half are kept,
in page order.

The weights are fitted on labelled pages by the gradient of the exact
log-likelihood (observed minus expected features, from the same marginals).
``labelled_pages`` writes them: pages of many layouts whose elements carry
``data-y``, 1 for article text and 0 for all else.

Defined results: a null or empty page has no text (an empty string); broken
markup is read as far as it goes (unclosed elements end with their parent, an
unclosed script, style or comment swallows the rest); scripts, styles, titles,
frames and text areas have no text, and neither have the DROPPED elements if
their own end tag closes them: without it their text is judged like any other;
repeated rows get equal results; pages of any length and depth are read whole;
a marginal of exactly a half is no content; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: kinds of HTML elements
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe".split())
DROPPED = set("button select svg canvas audio video template".split())     # with all below them
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter nobr noscript object q rp "
             "rt ruby s samp small span strike strong sub sup time tt u var wbr input "
             "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup "
             "munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
               "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
            "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_MARK = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>?)""")
_DROP = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})[\s/>]", re.I)
_ATTR = re.compile(r"""([^\s=/>"']++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_NAMING = ("class", "id", "role", "itemprop", "aria-label", "data-y", "style")


class Node:
    __slots__ = ("tag", "parent", "feats", "text", "links", "label", "names")

    def __init__(self, tag: str, parent: int, names: list[str], label: int | None):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.text: str | None = None
        self.feats: list[str] = []
        self.links = 0


def parse(page: str, labelled: bool = True) -> list[Node]:
    """Block elements and text runs, parents before children; node 0 is the root.
    Only a ``labelled`` page's data-y is read."""
    spans: dict[int, int] = {}
    if _DROP.search(page):               # the first reading finds which elements their own end tags close
        _read(page, False, {}, spans)
    return _read(page, labelled, spans, {})


def _read(page: str, labelled: bool, skip: dict[int, int], closed: dict[int, int]) -> list[Node]:
    """The nodes of a page without the spans ``skip``; ``closed`` gets the spans
    (end of start tag, end of end tag) of other DROPPED elements."""
    nodes = [Node("#root", -1, [], None)]
    stack: list[tuple[str, int]] = [("#root", 0)]       # open elements: tag, nearest block node
    run: list[str] = []
    count: dict[str, int] = {}           # open elements of each tag: an end tag without one costs no search
    opened: list[int] = []               # ends of the start tags of the open DROPPED elements
    endless: set[str] = set()            # raw-text elements that no end tag follows
    links = anchors = drawings = 0
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(run).split())
        if text:
            owner = stack[-1][1]
            leaf = Node("#text", owner, [], nodes[owner].label)
            leaf.text, leaf.links = text, links
            nodes.append(leaf)
        run.clear()
        links = 0

    def pop_to(k: int) -> None:
        nonlocal anchors, drawings
        if any(t not in INLINE and t not in DROPPED for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            count[t] -= 1
            anchors -= t == "a"
            drawings -= t == "svg"
        del opened[len(opened) - sum(t in DROPPED for t, _ in stack[k:]):]
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            run.append(raw)
            if anchors:
                links += len(raw)

    while pos < end:
        m = _MARK.search(page, pos)
        say(page[pos:m.start() if m else end])
        if not m:
            break
        pos = m.end()
        if not m[2]:
            if m[0] == "<!--":
                pos = end if (q := page.find("-->", pos)) < 0 else q + 3
            elif m[0] == "<![CDATA[":
                q = page.find("]]>", pos)
                say(page[pos:end if q < 0 else q].replace("&", "&amp;"))
                pos = end if q < 0 else q + 3
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                run.append(" ")
            for k in range(len(stack) - 1, 0, -1) if count.get(tag) else ():
                if stack[k][0] == tag:
                    if tag in DROPPED:
                        closed[opened[-1 - sum(t in DROPPED for t, _ in stack[k + 1:])]] = pos
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW or tag == "head":
            q = None
            if tag not in endless:
                q = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|<body", re.I).search(page, pos)
            if q:
                pos = q.start() if tag == "head" and q[0][1] != "/" else q.end()
            elif tag in ("script", "style"):
                pos = end
            else:                                    # one that never ends: read on
                endless.add(tag)
            continue
        if tag in DROPPED:
            if pos in skip:
                pos = skip[pos]
            elif not m[3].endswith("/>"):
                stack.append((tag, stack[-1][1]))
                count[tag] = count.get(tag, 0) + 1
                opened.append(pos)
                drawings += tag == "svg"
            continue
        if drawings and m[3].endswith("/>"):
            continue
        if tag in VOID:
            run.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if count.get("p") else ():
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            lowest = None
            for k in range(len(stack) - 1, 0, -1) if any(count.get(t) for t in SIBLINGS[tag]) else ():
                if stack[k][0] in SCOPE[tag]:
                    break
                if stack[k][0] in SIBLINGS[tag]:
                    lowest = k
            if lowest is not None:
                pop_to(lowest)
        block = stack[-1][1]
        anchors += tag == "a"
        if tag not in INLINE:
            flush()
            names, label = [], nodes[block].label
            if m[3]:
                for a in _ATTR.finditer(m[3]):
                    key, value = a[1].lower(), a[2].strip("\"'")
                    if key == "data-y":
                        label = int(value) if labelled else label
                    elif key == "style":
                        if "none" in value and re.search(r"display\s*:\s*none", value):
                            names.append("hidden")
                    elif key in _NAMING:
                        names += _WORDS.findall(_CAMEL.sub(r"\1 \2", value).lower())
                if re.search(r"\shidden[\s/>]", m[3]):
                    names.append("hidden")
            nodes.append(Node(tag, block, names, label))
            block = len(nodes) - 1
        if not m[3].endswith("/>") or tag not in INLINE:
            stack.append((tag, block))
            count[tag] = count.get(tag, 0) + 1
    stack[1:] and pop_to(1)
    flush()
    return nodes


def features(nodes: list[Node]) -> None:
    """Fills the features of every node."""
    above: list[list[str]] = []
    for n in nodes:
        if n.text is None:
            own = [f"t={n.tag}", *[f"c={w}" for w in set(n.names)]]
            n.feats = own
            above.append(above[n.parent] + [x for x in own if x not in above[n.parent]] if n.parent >= 0 else own)
        else:
            t = n.text
            length, words = len(t), t.count(" ") + 1
            n.feats = ["text", f"len={min(9, int(math.log2(length + 1)))}", f"words={min(6, int(math.log2(words)))}",
                       f"link={min(4, int(5 * n.links / max(1, length)))}", f"in={nodes[n.parent].tag}",
                       f"end={t[-1] in '.!?。！？:;\"”'}", *[f"up:{x}" for x in above[n.parent]]]
            if "©" in t[:40]:
                n.feats.append("copyright")
            above.append([])


def kind(n: Node) -> str:
    """Kind of a child for its parent-child potential."""
    return "text" if n.text is not None else "section" if n.tag in (
        "div section article main aside nav header footer form body html table ul ol dl").split() else "block"


class Model:
    """Weights of node features, and log potentials (parent, child) by kind."""

    def __init__(self):
        self.node: dict[str, float] = {}
        self.edge: dict[str, list[float]] = {k: [0.0] * 4 for k in ("text", "section", "block")}

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[list[float]]]:
        """P(content) of each node and the joint (parent, child) marginals of
        each node with its parent, by two passes over the tree."""
        get, n = self.node.get, len(nodes)
        score = [sum(get(f, 0.0) for f in x.feats) for x in nodes]
        pot = [self.edge[kind(x)] for x in nodes]
        up0, up1 = [0.0] * n, score[:]                 # log of what a subtree says, by the node's state
        msg = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):                  # upward: children come after parents
            a, b, e = up0[i], up1[i], pot[i]
            m0, m1 = _log_add(a + e[0], b + e[1]), _log_add(a + e[2], b + e[3])
            msg[i] = (m0, m1)
            p = nodes[i].parent
            up0[p] += m0
            up1[p] += m1
        prob, pair = [0.0] * n, [[0.0] * 4 for _ in range(n)]
        belief = [(0.0, 0.0)] * n
        belief[0] = (up0[0], up1[0])
        prob[0] = _sigmoid(up1[0] - up0[0])
        for i in range(1, n):                          # downward
            p, e = nodes[i].parent, pot[i]
            out0, out1 = belief[p][0] - msg[i][0], belief[p][1] - msg[i][1]
            j = (out0 + e[0] + up0[i], out0 + e[1] + up1[i], out1 + e[2] + up0[i], out1 + e[3] + up1[i])
            top = max(j)
            w = [math.exp(x - top) for x in j]
            total = sum(w)
            pair[i] = [x / total for x in w]
            prob[i] = pair[i][1] + pair[i][3]
            d0, d1 = _log_add(out0 + e[0], out1 + e[2]), _log_add(out0 + e[1], out1 + e[3])
            belief[i] = (up0[i] + d0, up1[i] + d1)
        return prob, pair

    def extract(self, page: str | None) -> str:
        nodes = parse(page or "", labelled=False)
        if len(nodes) == 1:
            return ""
        features(nodes)
        prob, _ = self.marginals(nodes)
        return "\n\n".join(x.text for x, p in zip(nodes, prob, strict=True) if x.text is not None and p > 0.5)


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def node_labels(nodes: list[Node]) -> list[int]:
    """Text runs have their page's label; an element is content if over half of
    the text below it is."""
    good, size = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].text is not None:
            size[i] = len(nodes[i].text)
            good[i] = size[i] * (nodes[i].label or 0)
        if i:
            good[nodes[i].parent] += good[i]
            size[nodes[i].parent] += size[i]
    return [int(2 * g > s) for g, s in zip(good, size, strict=True)]


def fit(pages: list[str], epochs: int = 8, rate: float = 0.3, seed: int = 5, decay: float = 1e-3) -> Model:
    """Adagrad on the exact log-likelihood of the labelled pages."""
    model, rng = Model(), random.Random(seed)
    trees = []
    for page in pages:
        nodes = parse(page)
        features(nodes)
        trees.append((nodes, node_labels(nodes)))
    seen: dict[str, float] = {}
    seen_edge = {k: [1e-6] * 4 for k in model.edge}
    for _ in range(epochs):
        rng.shuffle(trees)
        for nodes, y in trees:
            prob, pair = model.marginals(nodes)
            grad: dict[str, float] = {}
            for x, p, t in zip(nodes, prob, y, strict=True):
                for f in x.feats:
                    grad[f] = grad.get(f, 0.0) + t - p
            for f, g in grad.items():
                g -= decay * model.node.get(f, 0.0)
                seen[f] = seen.get(f, 1e-6) + g * g
                model.node[f] = model.node.get(f, 0.0) + rate * g / math.sqrt(seen[f])
            edges: dict[str, list[float]] = {}
            for i in range(1, len(nodes)):
                e = edges.setdefault(kind(nodes[i]), [0.0] * 4)
                e[2 * y[nodes[i].parent] + y[i]] += 1
                for k in range(4):
                    e[k] -= pair[i][k]
            for name, e in edges.items():
                for k in range(4):
                    seen_edge[name][k] += e[k] * e[k]
                    model.edge[name][k] += rate * e[k] / math.sqrt(seen_edge[name][k])
    return model


# fixed values: class words of page parts that are not article text, by part
PARTS = {
    "nav": "nav navbar menu navigation topnav breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar banner site-header logo branding hero-banner",
    "footer": "footer site-footer copyright colophon bottom legal credits",
    "aside": "sidebar aside widget rail related recommended popular trending more-stories tags",
    "ad": "ad ads advert advertisement sponsored sponsor promo adsense banner-ad promotion",
    "notice": "notice cookie cookie-banner consent alert popup modal gdpr disclaimer message paywall",
    "form": "form search login signup newsletter subscribe contact-form register",
    "comments": "comments comment comment-list reply replies disqus discussion respond user-comment reviews",
    "share": "share social sharing follow buttons byline-tools toolbar meta",
}
# fixed values: class words of article containers
CONTAINERS = "article post entry content main story article-body entry-content post-content story-body page-content text body-text".split()


def labelled_pages(count: int = 240, seed: int = 11) -> list[str]:
    """Pages of varying layout with data-y on their elements."""
    rng = random.Random(seed)
    syllables = "an be co de er fi ga ho in ka lo mi ne or pa qu re so ti un ve wa yo zu ch st th ing tion é ä ó ñ".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int, hi: int) -> str:
        s = words(lo, hi).capitalize()
        if rng.random() < 0.12:
            s = s.replace(" ", f" <a href='/{words(1, 1)}'>{words(1, 2)}</a> ", 1)
        if rng.random() < 0.1:
            s = f"<b>{s}</b>"
        if rng.random() < 0.08:
            s = s.replace(" ", rng.choice([" &amp; ", " ### ", "*** ", " | ", " &lt;"]))
        return s + rng.choice([".", ".", ".", "!", "?", ""])

    def para() -> str:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        return " ".join(sentence(1, rng.choice([4, 12, 25])) for _ in range(n))

    def links(n: int) -> str:
        return "".join(f"<li><a href='/{words(1, 1)}'>{words(1, 3)}</a></li>" for _ in range(n))

    def named(tag: str, name: str, y: int, inner: str) -> str:
        how = rng.random()
        attr = f" class=\"{name}\"" if how < 0.6 else f" id=\"{name}\"" if how < 0.8 else f" class=\"{words(1, 1)} {name}\"" if how < .95 else ""
        return f"<{tag}{attr} data-y=\"{y}\">{inner}</{tag}>"

    def part(which: str) -> str:
        name = rng.choice(PARTS[which].split())
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(which)
        tag = plain if plain and rng.random() < 0.6 else rng.choice(["div", "div", "section"])
        if tag == plain and rng.random() < 0.5:
            name = words(1, 1)
        body = {
            "nav": lambda: f"<ul>{links(rng.randint(2, 9))}</ul>" if rng.random() < .7 else " | ".join(f"<a href='#'>{words(1, 2)}</a>" for _ in range(5)),
            "header": lambda: rng.choice([f"<h1>{words(1, 4)}</h1>", f"<a href='/'>{words(1, 3)}</a>", f"<p>{words(2, 8)}</p>"]) + rng.choice(["", f"<ul>{links(4)}</ul>"]),
            "footer": lambda: rng.choice(["&copy; ", "&copy; 2020 ", "", "Copyright "]) + words(1, 3) + rng.choice([" &middot; ", ". ", " "]) + sentence(2, 14) + rng.choice(["", f"<ul>{links(3)}</ul>"]),
            "aside": lambda: f"<h3>{words(1, 3)}</h3>" + rng.choice([f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{para()}</p>"]),
            "ad": lambda: rng.choice([sentence(3, 25), f"<p>{sentence(3, 20)}</p>", f"<a href='#'>{sentence(3, 10)}</a>"]),
            "notice": lambda: rng.choice([f"<p>{sentence(4, 30)}</p>", sentence(4, 30)]) + rng.choice(["", "<button>OK</button>", "<a href='#'>ok</a>"]),
            "form": lambda: f"<label>{words(1, 3)}</label><input name='q'>{rng.choice(['', f'<p>{sentence(3, 14)}</p>'])}<button>Go</button>",
            "comments": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(rng.choice(["<div class='comment'>", "<li>", "<div>"]) + f"<p>{para()}</p>" + rng.choice(["</div>", ""]) for _ in range(rng.randint(1, 4))),
            "share": lambda: "".join(f"<a href='#'>{words(1, 1)}</a> " for _ in range(4)),
        }[which]()
        return named(tag, name, 0, body)

    def article() -> str:
        out = [f"<h1>{words(2, 10)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.15:
            out.append(f"<p><b>{sentence(3, 14)}<br>")
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14])):
            r = rng.random()
            out.append(f"<p>{para()}</p>" if r < 0.72 else f"<h2>{words(1, 6)}</h2>" if r < 0.8 else
                       "<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(3)) + "</ul>" if r < 0.86 else
                       f"<blockquote><p>{para()}</p></blockquote>" if r < 0.9 else f"<pre>{words(3, 20)}</pre>" if r < 0.92 else
                       f"<div>{para()}</div>" if r < 0.95 else f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>" if r < 0.97 else
                       part(rng.choice(["ad", "aside", "form", "notice", "share"])))
        inner = "".join(out)
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        named_ = tag in ("div", "section", "td") or rng.random() < 0.4
        attr = f" class=\"{rng.choice(CONTAINERS)}\"" if named_ and rng.random() < 0.9 else ""
        inner = f"<{tag}{attr} data-y=\"1\">{inner}</{tag}>" if tag != "td" else f"<table><tr><td{attr} data-y=\"1\">{inner}</td></tr></table>"
        return f"<div class=\"{rng.choice(['wrap', 'container', 'page', 'row'])}\">{inner}</div>" if rng.random() < 0.4 else inner

    def page() -> str:
        if rng.random() < 0.03:
            return f"<html><body data-y=\"1\">{''.join(f'<p>{para()}</p>' for _ in range(3))}</body></html>"
        before = [part(x) for x in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < 0.5]
        after = [part(x) for x in ("share", "aside", "ad", "comments", "form", "nav", "notice", "footer") if rng.random() < 0.45]
        rng.shuffle(before)
        return (f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body data-y=\"0\">"
                + "".join(before) + article() + "".join(after) + rng.choice(["</body></html>", ""]))

    return [page() for _ in range(count)]


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = model or fit(labelled_pages())

    def run(batches):
        for batch in batches:
            texts = [model.extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                          F.col(f"`{html_col}`").alias("html"))
    return narrow.mapInArrow(run, SCHEMA)
