"""Main text of web pages by tree scoring.

A page becomes a tree. Each paragraph earns points for being one, for its commas and for its length, and passes them to
its ancestors: all to the parent, half to the grandparent, less further up. Points shrink with a container's link
density. The best container and those of its siblings that score well are kept; their blocks, in page order, are the text.
"""

from __future__ import annotations

from collections import Counter
from html import unescape

from pyspark.sql import DataFrame

from mediaops.llm.common import add_columns

# Element names of the HTML standard by how they are treated here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table
    tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - frozenset("html body caption tbody td tfoot th thead tr legend optgroup option".split())
PARAGRAPHS = frozenset("p pre td blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
DROPPED = frozenset("""script style noscript template nav aside footer form button select input textarea iframe object embed svg canvas
    dialog menu head title noembed noframes audio video map fieldset""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name what is not content, unless it wraps the page's text.
ALWAYS_OUT = frozenset("""ad ads adv advert adverts advertisement advertisements adsense adbox adslot sponsor sponsors sponsored promo promos
    promotion comment comments commentlist disqus reply replies respond nav navbar navigation menu menus breadcrumb breadcrumbs pagination
    pager cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay paywall hidden skip""".split())
#: Of these, words of what readers write. It can be most of a page and yet not its text.
DISCUSSION = frozenset("comment comments commentlist disqus reply replies respond".split())
#: A class with one of these words tells a state or a look (has-menu, nav-open, ad-free), not what an element is.
STATES = frozenset("has no not non with without free open opened overflow".split())
#: Words that name an element only alone or beside the given ones: not overflow-hidden, md:hidden or skip-ink.
ALONE = {"hidden": frozenset("is js u visually".split()), "skip": frozenset("to link links nav navigation content main".split())}
#: Those that count unless the element holds most of the page's text.
OFTEN_OUT = frozenset("""header masthead footer sidebar sidebars aside widget widgets banner notice notices notification alert share sharing
    social related recommended recommendations toolbar copyright legal disclaimer outbrain taboola form login search topbar bottombar""".split())
#: Words that say where or how an element stands. A name that holds any others besides the ones above (share-price, legal-analysis)
#: may well tell what a text is about; it counts only for elements that are mostly links.
LAYOUT = frozenset("""box boxes list lists bar bars row rows container wrapper wrap inner outer block blocks section area panel pane link links button
    buttons btn item items top bottom left right main site page global primary secondary mobile desktop post posts article articles entry
    entries content text body title heading icon icons slot unit zone label field thread tree count media follow us tools js css id the is u
    visually dropdown sub sticky fixed floating inline rail stories story news user users reader readers your on off to""".split())
# An open element of the keys ends when one of the values begins, within the given bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "tbody", "tfoot", "thead"}, {"table"}), "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
        "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}), "tbody": ({"tbody", "tfoot", "thead"}, {"table"}),
        "thead": ({"tbody", "tfoot"}, {"table"}), "option": ({"option", "optgroup"}, {"select"})}
_BEGINS = {begin: [k for k, (begins, _) in ENDS.items() if begin in begins] for _, (bs, _) in ENDS.items() for begin in bs}

#: Ancestors that a paragraph passes points to.
LEVELS = 5
#: A sibling of the best container stays with this part of its score.
SIBLING_SHARE = 0.2
#: Outside an article, a list with more than this part of its text in links, and several links, is a menu.
LINK_LIST = 0.5

_TAG = r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*)(?:>|\Z))"""
_ATTRIBUTE = r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "points", "out")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts, self.points, self.out = [], 0.0, False


def parse(source: str) -> Node:
    """The tree of a page. Unclosed and stray tags are mended roughly as browsers do; nothing fails."""
    from re import DOTALL, IGNORECASE, compile as rx

    tag = rx(_TAG, DOTALL)
    root = node = Node("#root", "", None)
    at, end = 0, len(source)
    opened: Counter[str] = Counter()  # open elements by name, so that no walk up is in vain

    def leave(upto: Node) -> Node:
        up = node
        while up is not upto:
            opened[up.tag] -= 1
            up = up.parent
        return upto

    while at < end:
        hit = tag.search(source, at)
        if not hit:
            node.parts.append(unescape(source[at:]))
            break
        if hit.start() > at:
            node.parts.append(unescape(source[at:hit.start()]))
        at = hit.end()
        name = hit.group(2)
        if not name:
            if hit.group().startswith("<![CDATA["):
                node.parts.append(hit.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if hit.group(1):
            if opened[name]:
                node = leave(_close(node, name))
            continue
        if opened["p"] and name in CLOSES_P or any(opened[other] for other in _BEGINS.get(name, ())):
            node = leave(_make_room(node, name))
        child = Node(name, hit.group(3), node)
        node.parts.append(child)
        if name in VOID:
            continue
        if name in RAW:
            shut = rx(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", IGNORECASE).search(source, at)
            child.parts.append(source[at:shut.start()] if shut else source[at:])
            at = shut.end() if shut else end
        else:
            node = child
            opened[name] += 1
    return root


def _close(node: Node, name: str) -> Node:
    up = node
    while up.parent and up.tag != name:
        # an end tag inside does not close what surrounds a table cell or the like
        if up.tag in ("td", "th", "table", "article", "main", "section", "div") and name not in BLOCKS:
            return node
        up = up.parent
    return up.parent if up.parent else node


def _make_room(node: Node, name: str) -> Node:
    if name in CLOSES_P:
        up = node
        while up.parent and up.tag not in BLOCKS:
            up = up.parent
        if up.tag == "p":
            node = up.parent
    for other in _BEGINS.get(name, ()):
        bounds, up = ENDS[other][1], node
        while up.parent and up.tag != other and up.tag not in bounds:
            up = up.parent
        if up.parent and up.tag == other:
            node = up.parent
    return node


def _attributes(text: str) -> dict[str, str]:
    from re import findall

    return {k.lower(): unescape(v.strip("\"'")) for k, v in findall(_ATTRIBUTE, text)} if text and not text.isspace() else {}


def _words(value: str) -> set[str]:
    from re import findall

    return {w.lower() for w in findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value)}


def _named(names: str, numbers: bool) -> tuple[set[str], set[str]]:
    """The words of classes or ids that say what an element is, and those that only may. Sizes and numbers may stand
    beside the words of a class (ad-300x250)."""
    sure, maybe = set(), set()
    for name in names.split():
        words = _words(name)
        if not words & STATES:
            found = {w for w in words if w not in ALONE or words - {w} <= ALONE[w]}
            plain = {w for w in words if len(w) > 1 or not numbers} <= ALWAYS_OUT | OFTEN_OUT | LAYOUT and (numbers or not any(map(str.isdigit, name)))
            (sure if plain else maybe).update(found)
    return sure, maybe


def _walk(root: Node):
    """Nodes before their children, without recursion."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(p for p in reversed(node.parts) if type(p) is Node)


def _mark(root: Node, order: list[Node], size: dict[Node, int], links: dict[Node, int]) -> set[Node]:
    """Sets ``out`` on what cannot be content. Returns what the page itself calls its articles, with all in them."""
    whole, inside = max(1, size[root]), set()
    titled = set()  # what holds a main heading or <main>
    for node in order:
        if node.tag in ("h1", "main"):
            up = node
            while up and up not in titled:
                titled.add(up)
                up = up.parent
    for node in order:
        if node.parent in inside or node.tag in ("article", "main"):
            inside.add(node)
        if node.tag in DROPPED:
            # a form around most of the text is the page itself
            node.out = node.tag not in ("form", "fieldset") or 2 * size[node] <= whole
            continue
        if node.tag == "header" and node not in inside:
            node.out = True
            continue
        if not node.attrs or node.tag in ("html", "body", "main"):
            continue
        attrs = _attributes(node.attrs)
        role, words = attrs.get("role", "").lower(), set()
        # the id of a heading is what links lead to, made of its text
        for sure, maybe in (_named(attrs.get("class", ""), True), _named("" if node.tag in HEADINGS else attrs.get("id", ""), False)):
            words |= sure | (maybe if 2 * links[node] > size[node] else set())
        style = attrs.get("style", "").replace(" ", "").lower()
        large = 2 * size[node] > whole
        # what holds most of the text is the page itself, whatever it is called; a discussion only with the title or nearly all
        wraps = large and (not words & DISCUSSION or node in titled or 10 * size[node] > 9 * whole)
        node.out = ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style
                    or "visibility:hidden" in style or role in DROPPED_ROLES
                    or not wraps and bool(words & ALWAYS_OUT) and node.tag not in ("a", "span", "b", "i", "em", "strong")
                    or bool(words & OFTEN_OUT) and not large and not (node in inside and words & {"header"}))
    return inside


def main_blocks(source: str) -> list[str]:
    """The blocks of the main text, in page order, with white space turned into single spaces."""
    root = parse(source)
    order = list(_walk(root))
    size, links = {}, {}
    for node in reversed(order):  # children first; what is never text does not count
        if node.tag in ("script", "style", "template", "head", "noscript"):
            size[node] = links[node] = 0
            continue
        size[node] = sum(size[p] if type(p) is Node else len(p.strip()) for p in node.parts)
        links[node] = size[node] if node.tag == "a" else sum(links[p] for p in node.parts if type(p) is Node)
    inside = _mark(root, order, size, links)
    out = {node for node in order if node.out}
    for node in order:
        if node.parent in out:
            out.add(node)
    seen = [node for node in order if node not in out]

    scored = []
    for node in seen:
        own = node.tag in PARAGRAPHS or node.tag in ("div", "section", "article", "li", "dd") and not any(
            type(p) is Node and p.tag in BLOCKS for p in node.parts)
        if not own:
            continue
        text = _text(node, out)
        if not text:
            continue
        points, up, level = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3), node.parent, 1
        while up and level <= LEVELS:
            if not up.points:
                scored.append(up)
            up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * level)
            up, level = up.parent, level + 1
    density = lambda node: links[node] / size[node] if size[node] else 0.0
    score = {node: node.points * (1 - density(node)) for node in dict.fromkeys(scored) if node.tag in CONTAINERS}
    if score:
        best = max(score.values())
        top = next(node for node in seen if score.get(node) == best)  # of equals the outermost
    else:
        top = next((n for tag in ("article", "main", "body", "html", "#root") for n in seen if n.tag == tag), None)
        if top is None:
            return []
    up = top
    while up:  # what the page itself calls its article
        if up.tag in ("article", "main"):
            top = up
            break
        up = up.parent
    kept = {top}
    if top.parent and top.tag not in ("main", "body"):
        least, plain = max(score.get(top, 0) * SIBLING_SHARE, 1), SIBLING_SHARE * (size[top] - links[top])
        for node in (p for p in top.parent.parts if type(p) is Node and p not in out):
            if top.tag == "article":  # beside an article stand only others; what is deep in them scores elsewhere
                if node.tag == "article" and (score.get(node, 0) >= least or size[node] - links[node] >= max(plain, 1)):
                    kept.add(node)
            elif score.get(node, 0) >= least or node.tag in ("p", "h1", "h2", "h3") and density(node) < 0.25 and size[node]:
                kept.add(node)
    blocks: list[list[str]] = [[]]
    for node in (p for p in (top.parent.parts if len(kept) > 1 else [top]) if type(p) is Node and p in kept):
        _collect(node, out, inside, links, size, blocks)
        blocks.append([])
    texts = (" ".join("".join(parts).split()) for parts in blocks)
    return [text for text in texts if text]


def _text(node: Node, out: set) -> str:
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if type(x) is str:
            parts.append(x)
        elif x not in out:
            stack.extend(reversed(x.parts))
    return " ".join("".join(parts).split())


def _collect(top: Node, out: set, inside: set, links: dict, size: dict, blocks: list[list[str]]) -> None:
    """Appends the text of a subtree; every block element begins and ends a block. Lists of links are menus, but not
    ``inside`` of an article."""
    stack: list = [(top, False)]
    while stack:
        x, done = stack.pop()
        if done:
            blocks.append([])
        elif type(x) is str:
            blocks[-1].append(x)
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif x not in out and not (x is not top and x not in inside and x.tag in ("ul", "ol", "table", "dl") and size[x] and links[x] > LINK_LIST * size[x]
                                   and sum(n.tag == "a" for n in _walk(x)) >= 3):
            if x.tag in BLOCKS:
                blocks.append([])
                stack.append((x, True))
            stack.extend((p, False) for p in reversed(x.parts))


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out``: the main text of each page, its blocks joined by line feeds; empty if there is none.

    The whole page is read; a null page is empty. Broken markup never fails. Other columns pass through; a
    column named ``out`` is replaced.
    """

    def run(pages):
        import pyarrow as pa

        return [pa.array(["\n".join(main_blocks(page.as_py() or "")) for page in pages], pa.string())]

    return add_columns(df, [html], f"`{out}` string", run)
