"""HTML extraction by union-free regular expressions inferred from all distinct pages of a host.

A page is read into a tree of tags and texts and from it into a stream of blocks, each with a place (the
labels that lead to it) and a text. Two streams are aligned on equal blocks; between these,
blocks of one place become one slot whose pattern is the words they share in order, blocks of one
place in a row a repeated group, and what only one has an optional group. All pages of a host are folded into its
expressions, one for each class of pages (``mark``), one after another in parts of about ``PART`` pages, and the parts'
expressions into one by the same alignment. Parts and their order come from hashes of the pages, so the result does not
depend on how Spark deals out rows. Then each page is matched against the expression of its class: its blocks are template
where they match a constant, or a slot most of which is constant words, that ``SHARE`` percent of the pages have.

Tags and names label the expression's fields (``candidates``). Of several candidates the one that holds most varying text is the
article. All blocks under it but forms, adverts, comments and the like (``dropped``) are its text, constants too; but
what stands under a name that may be a paragraph's or a notice's (legal, search, side, header) goes where it matches template. Where a
candidate is one by its name alone and nothing in it varies, though other text does, it is not the article. There, and
where there is no candidate, the article reaches from the first block that is not template to the last, with all
that stands between. An expression whose constants outweigh what varies tells near copies from each other, not articles
from a template, and decides nothing of this; nor does one of a single page.

Expressions are broadcast while all of them together are under ``BROADCAST_BYTES``; beyond, parts of
pages and the expression of their class meet in one group each.

Defined results for edge cases: null and empty pages have an empty text; a page without
tags is one block; very long pages are read whole; a null URL or one without a host counts
to the host ''; repeated rows are extracted row by row and count once in the expression; an
empty table gives an empty result; further columns of the input pass through, apart from
columns named as a result, which are replaced.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import partial, reduce

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, set_aside
from .url_rules import parse

BROADCAST_BYTES = 32_000_000
#: Percent of a host's pages that must have what counts as its template.
SHARE = 90
#: Distinct pages, about, that one task folds or extracts together.
PART = 1000

_RAW = "script|style|noscript|template|iframe|textarea|svg|math|object"
_MARKUP = re.compile(rf"""<!--.*?(?:-->|$)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|</[^>]*>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of the first closes an open one of the second, up to the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_DROPPED_TAGS = frozenset("head nav footer aside form button select menu dialog title option label input".split())
_DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebars?|side|widgets?|header|masthead|topbar|footer|comments?|replies|reply|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|skip\w*|toolbar|copyright|legal)(?:$|[\s_-])",
    re.I,
)
#: Names that say the same inside an article. Others there (legal, search, side, notice) may name its own paragraphs.
_DROPPED_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|nav|navbar|navigation|menu|breadcrumbs?|sidebars?|widgets?|comments?|replies|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|pagination|pager)(?:$|[\s_-])",
    re.I,
)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:main|article(?:-?body)?|post(?:-?(?:body|content))?|entry(?:-?content)?|content|story(?:-?body)?)(?:$|[\s_-])", re.I)


class Node:
    """A tag with its children; a text is a node with the tag '#'."""

    __slots__ = ("tag", "names", "text", "children")

    def __init__(self, tag: str, names: str = "", text: str = ""):
        self.tag, self.names, self.text, self.children = tag, names, text, []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def read(page: str) -> Node:
    """The tree of a page; open ends and stray ends are borne."""
    root = Node("root")
    open_nodes, at = [root], 0

    def add(text: str) -> None:
        if text:
            open_nodes[-1].children.append(Node("#", text=entities.unescape(text)))

    for m in _MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    del open_nodes[k:]
                    break
            continue
        if tag in _ENDS_P:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == "p":
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag not in _INLINE:
                    break
        if tag in _CLOSES:
            ends, stop = _CLOSES[tag]
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag in stop:
                    break
                if open_nodes[k].tag in ends:
                    del open_nodes[k:]
                    break
        if tag in ("article", "main"):  # never inside something that was left open by mistake
            for k in range(1, len(open_nodes)):
                if open_nodes[k].tag not in ("html", "body") and dropped(open_nodes[k]) and open_nodes[k].tag not in ("aside", "footer", "section", "ol", "ul") and not _comments(open_nodes[k]):
                    del open_nodes[k:]
                    break
        names = " ".join(sorted(x[2].strip("\"'").strip() for x in _ATTRIBUTE.finditer(m[4] or "")))
        node = Node(tag, re.sub(r"\d+", "0", names))
        open_nodes[-1].children.append(node)
        if tag not in _VOID and not (m[4] or "").rstrip().endswith("/"):
            open_nodes.append(node)
    add(page[at:])
    return root


def _comments(node: Node) -> bool:
    return bool(re.search(r"comment|repl|respond|disqus", node.names, re.I))


def dropped(node: Node, within_main: bool = False) -> bool:
    """Whether what the node holds is no part of an article, by its tag and names; inside an article fewer names count."""
    if node.tag in ("html", "body", "root", "#", "main") or node.tag == "article" and not _comments(node):
        return False
    if node.tag == "header":
        return not within_main
    names = _DROPPED_INSIDE if within_main else _DROPPED_NAMES
    return node.tag in _DROPPED_TAGS or bool(node.names and names.search(node.names) and not (_MAIN_NAMES.search(node.names) and not _comments(node)))


def kept_size(node: Node) -> int:
    """Characters of article text under a node; link texts do not count."""
    if node.tag == "#":
        return len(node.text.strip())
    return 0 if dropped(node) or node.tag == "a" else sum(map(kept_size, node.children))


# ---- expressions: JSON-ready {"pages": number, "tokens": [[place, text or None, words, often, pages, characters, owners, plain]]}
#
# Owners are the candidates that a block stands in, as bits; plain are its characters outside links and doubtful names.
# A token with a text is a constant. Without, it is a slot: its words are what all its texts share, in order. often is '1' (each
# page has it), '?' (some have), '+' or '*' (in a row).

_PLACE, _TEXT, _WORDS, _OFTEN, _PAGES, _CHARS, _OWNERS, _PLAIN = range(8)


def expression(blocks: list[tuple]) -> dict:
    """The expression of one page's blocks (place, text, owners, plain, doubtful)."""
    return {"pages": 1, "tokens": _folded([[place, text, text.split(), "1", 1, len(text), owners, plain] for place, text, owners, plain, _ in blocks])}


def _key(token: list) -> tuple:
    return token[_PLACE], token[_TEXT]


def _shared(a: list[str], b: list[str]) -> list[str]:
    """The words of two patterns that match in order."""
    if a == b:
        return a
    if not a or not b:
        return []
    return [w for x, _, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for w in a[x : x + n]]


def _optional(token: list) -> list:
    if token[_OFTEN] in "1+":
        token[_OFTEN] = "?" if token[_OFTEN] == "1" else "*"
    return token


def _both(a: list, b: list, in_row: bool = False) -> list:
    """Two tokens of one place as one: equal texts stay a constant, others make a slot. In a row: of the same page."""
    often = {a[_OFTEN], b[_OFTEN]}
    many, some = in_row or bool(often & {"+", "*"}), often <= {"?", "*"} if in_row else bool(often & {"?", "*"})
    same = a[_TEXT] is not None and a[_TEXT] == b[_TEXT]
    pages = max(a[_PAGES], b[_PAGES]) if in_row else a[_PAGES] + b[_PAGES]
    return [a[_PLACE], a[_TEXT] if same else None, a[_WORDS] if same else _shared(a[_WORDS], b[_WORDS]), ("*" if some else "+") if many else "?" if some else "1", pages, a[_CHARS] + b[_CHARS], a[_OWNERS] | b[_OWNERS], a[_PLAIN] + b[_PLAIN]]


def _firm(token: list) -> bool:
    """A constant that different pages have agreed on; it is not dissolved into a slot any more."""
    return token[_TEXT] is not None and token[_PAGES] > 1


def _folded(tokens: list[list]) -> list[list]:
    """Tokens with slots of one place in a row, and what is not firm beside them, made one repeated group."""
    out: list[list] = []
    for token in tokens:
        if out and out[-1][_PLACE] == token[_PLACE] and (out[-1][_TEXT] is None or token[_TEXT] is None) and not _firm(out[-1]) and not _firm(token):
            out[-1] = _both(out[-1], token, in_row=True)
        else:
            out.append(token)
    return out


def _matches(a: list, b: list) -> Iterator[tuple[int, int, int]]:
    """The matching blocks of a and b. Stretches of a that have no equal in b stand as one mark while blocks are sought, which
    changes none of them: a long expression is gone through once for a page, not once for each block."""
    there, mark = set(b), object()
    short: list = []
    at: list[int] = []
    for k, x in enumerate(a):
        if x in there:
            short.append(x)
            at.append(k)
        elif not short or short[-1] is not mark:
            short.append(mark)
            at.append(k)
    at.append(len(a))
    for p, q, n in SequenceMatcher(None, short, b, autojunk=False).get_matching_blocks():
        yield at[p], q, n


def align(a: dict, b: dict) -> dict:
    """Two expressions as one. Equal constants are matched first, then places between them. Everything that a page has stays in it,
    however rare: what varies decides on the template by its amount, and what is rare so far may be on all pages that follow."""
    x, y, out = a["tokens"], b["tokens"], []
    i = j = 0
    slots = iter(range(len(x) + len(y)))  # a slot is equal to nothing here
    left, right = ([_key(t) if t[_TEXT] is not None else next(slots) for t in tokens] for tokens in (x, y))
    for p, q, n in _matches(left, right):
        out += _between(x[i:p], y[j:q])
        out += [_both(x[p + k], y[q + k]) for k in range(n)]
        i, j = p + n, q + n
    return {"pages": a["pages"] + b["pages"], "tokens": _folded(out)}


def _between(x: list[list], y: list[list]) -> list[list]:
    """Tokens between two matches: those of one place that are not firm become slots, the others optional."""
    if not x or not y:
        return [_optional(t) for t in x or y]
    out, i, j = [], 0, 0
    marks = iter(range(len(x) + len(y)))
    left, right = ([next(marks) if _firm(t) else (t[_PLACE],) for t in tokens] for tokens in (x, y))
    for p, q, n in _matches(left, right):
        out += [_optional(t) for t in x[i:p]] + [_optional(t) for t in y[j:q]]
        out += [_both(x[p + k], y[q + k]) for k in range(n)]
        i, j = p + n, q + n
    return out


def infer(pages: list[str]) -> dict:
    """The wrapper of a host's pages: {"expression": of those without a candidate, "named": {mark: expression of those of a class}}."""
    classes = defaultdict(list)
    for mark, blocks in map(stream, map(read, dict.fromkeys(pages))):
        if blocks:
            classes[mark].append(blocks)
    found = {mark: reduce(align, map(expression, streams)) for mark, streams in classes.items()}
    return {"expression": found.pop(NAMELESS, None), "named": found}


def regex(found: dict) -> str:
    """An expression as text: constants, words and #slots, with ?, + or * behind groups."""
    parts = []
    for _, text, words, often, *_ in found["tokens"]:
        inner = text if text is not None else " ".join([*words, "#slot"])
        parts.append(inner if often == "1" else f"({inner}){often}")
    return " | ".join(parts)


def decides(found: dict | None) -> bool:
    """Whether an expression tells a template from articles: several pages, and more varies than is constant."""
    if not found or found["pages"] < 2:
        return False
    template = sum(t[_CHARS] for t in found["tokens"] if _is_template(t, found["pages"]))
    return 2 * template <= sum(t[_CHARS] for t in found["tokens"])


def _is_template(token: list, pages: int) -> bool:
    """Constants, and slots most of whose text is words that all share, which SHARE percent of the pages have."""
    if 100 * token[_PAGES] < SHARE * pages or token[_PAGES] < 2:
        return False
    return token[_TEXT] is not None or (token[_OFTEN] in "1?" and 2 * token[_PAGES] * sum(map(len, token[_WORDS])) > token[_CHARS])


def varying(blocks: list[tuple], found: dict) -> list[bool]:
    """For each block of a page whether it is other than template, by its match with the expression of its class."""
    x = found["tokens"]
    slots = iter(range(len(x)))
    left = [_key(t) if t[_TEXT] is not None else next(slots) for t in x]
    varies = [True] * len(blocks)
    i = j = 0
    for p, q, n in _matches(left, [b[:2] for b in blocks]):
        for s, t, m in _matches([t[_PLACE] for t in x[i:p]], [b[0] for b in blocks[j:q]]):
            for k in range(m):
                token, text = x[i + s + k], blocks[j + t + k][1]
                if token[_TEXT] is None and _is_template(token, found["pages"]):
                    varies[j + t + k] = 2 * sum(map(len, _shared(token[_WORDS], text.split()))) <= len("".join(text.split()))
        for k in range(n):
            varies[q + k] = not _is_template(x[p + k], found["pages"])
        i, j = p + n, q + n
    return varies


def chosen(tokens: list[list], varies: list[bool], by_name: bool) -> int | None:
    """The candidate that is the article: the one with most varying text, of equal ones with most text. None: no candidate, or,
    where names alone made the candidates, none in which anything varies though other text does."""
    amounts: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    outside = inside = 0
    for token, varied in zip(tokens, varies, strict=True):
        for k in range(token[_OWNERS].bit_length()):
            if token[_OWNERS] >> k & 1:
                amounts[k][0] += token[_PLAIN] * varied
                amounts[k][1] += token[_PLAIN]
        if token[_OWNERS]:
            inside += varied
        else:
            outside += token[_PLAIN] * varied
    most = max(((a, n, k) for k, (a, n) in amounts.items()), default=None)
    return None if most is None or (by_name and not inside and outside) else most[2]


class Wrapper:
    """An expression of a class of pages with what follows from it."""

    def __init__(self, mark: str, found: dict):
        self.found, self.decides = found, decides(found)
        varies = [self.decides and not _is_template(t, found["pages"]) for t in found["tokens"]]
        self.article = chosen(found["tokens"], varies, mark.startswith("1"))

    def text(self, blocks: list[tuple]) -> list[str]:
        """The texts of a page's blocks that are its article."""
        varies = varying(blocks, self.found) if self.decides else [True] * len(blocks)
        if self.article is not None:
            return [text for (_, text, owners, _, doubtful), varied in zip(blocks, varies, strict=True) if owners >> self.article & 1 and (varied or not doubtful)]
        there = [k for k, v in enumerate(varies) if v]
        return [b[1] for b in blocks[there[0] : there[-1] + 1]] if there else []


#: The mark of pages without a candidate.
NAMELESS = "0"


def candidates(tree: Node) -> list[tuple[int, tuple, list[Node]]]:
    """(rank, labels from the root, nodes) of what a tag or name says to be the article; only the best rank, in order of labels. Nodes
    with text in links alone (teasers) are none."""
    found = defaultdict(list)
    stack: list[tuple[Node, tuple]] = [(tree, ())]
    while stack:
        node, path = stack.pop()
        if node.tag == "#" or dropped(node):
            continue
        rank = 3 if node.tag == "article" else 2 if node.tag == "main" or re.search(r"(?:^|\s)(?:main|articleBody)(?:\s|$)", node.names) else 1 if node.tag in ("div", "section", "td") and _MAIN_NAMES.search(node.names) else 0
        if rank and kept_size(node):
            found[rank, path].append(node)
        stack += [(c, (*path, c.label)) for c in node.children]
    best = max((rank for rank, _ in found), default=0)
    return [(rank, path, nodes) for (rank, path), nodes in sorted(found.items()) if rank == best]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


def stream(tree: Node) -> tuple[str, list[tuple[int, str, int, int, bool]]]:
    """A page's mark and its blocks (place, text, owners, plain, doubtful), in page order, white space as one space.

    The mark names the class of pages: without a candidate, with one of a rank, or with several at these labels. Places under a
    single candidate begin there, so that pages of a host share them wherever it stands. Inside a candidate fewer names leave
    a block out; what other names would leave out is doubtful.
    """
    found = candidates(tree)
    owner = {id(n): 1 << k for k, (_, _, nodes) in enumerate(found) for n in nodes}
    mark = NAMELESS if not found else str(found[0][0]) if len(found) == 1 else f"{found[0][0]}:{_hash(json.dumps([path for _, path, _ in found]))}"
    blocks: list[tuple[int, str, int, int, bool]] = []
    run: list[str] = []
    plain = 0

    def block(labels: tuple, owners: int, doubtful: bool) -> None:
        nonlocal plain
        if text := " ".join("".join(run).split()):
            blocks.append((_hash("/".join(labels)), text, owners, plain, doubtful))
        run.clear()
        plain = 0

    def walk(n: Node, labels: tuple, owners: int, doubtful: bool, aside: bool) -> None:
        nonlocal plain
        for c in n.children:
            if c.tag == "#":
                run.append(c.text)
                plain += 0 if aside else len(c.text.strip())
                continue
            own = owner.get(id(c), 0) if not owners or c.tag not in _INLINE else 0
            if not own and dropped(c, within_main=owners > 0):
                continue
            other = owners > 0 and not own and dropped(c)
            beside = other or c.tag == "a" or aside and (owners > 0 or not own)
            if c.tag in _INLINE and not own:
                walk(c, labels, owners, doubtful, beside)
                continue
            block(labels, owners, doubtful)
            under = ("article",) if own and len(found) == 1 else labels if c.tag in _INLINE else (*labels, c.label)
            inner = under, owners | own, doubtful or other
            walk(c, *inner, beside)
            block(*inner)

    walk(tree, (), 0, False, False)
    block((), 0, False)
    return mark, blocks


def main_text(page: str | None, find: Callable[[str], Wrapper | None]) -> str:
    """The main text of a page, by the wrapper that is found for its mark; without one it is a class by itself."""
    if not page:
        return ""
    mark, blocks = stream(read(page))
    return " ".join((find(mark) or Wrapper(mark, expression(blocks))).text(blocks))


def extract(page: str | None, wrapper: dict | None) -> str:
    """The main text of a page by its host's wrapper, as ``infer`` gives it."""
    known = {} if wrapper is None else {NAMELESS: wrapper["expression"], **wrapper["named"]}
    return main_text(page, lambda mark: Wrapper(mark, known[mark]) if known.get(mark) else None)


# ---- on Spark


def _features(pages: DataFrame) -> DataFrame:
    """(_host, _page, _part, _mark, blocks as packed JSON): of each page, whatever its tags say, the class and the blocks. Copies may come again."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, page, part, body in b.drop_duplicates(["_host", "_page"])[["_host", "_page", "_part", "_html"]].itertuples(index=False):
                mark, blocks = stream(read(body))
                if blocks:
                    out.append((host, page, part, mark, zlib.compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)))
            yield pd.DataFrame(out, columns=["_host", "_page", "_part", "_mark", "blocks"])

    given = pages.where(F.col("_html").isNotNull()).select("_host", F.xxhash64("_html").alias("_page"), "_html")
    parts = materialise(given.groupBy("_host").agg(F.ceil(F.countDistinct("_page") / PART).alias("_parts")), "page-parts")
    dealt = given.join(parts, "_host").select("_host", "_page", F.pmod(F.xxhash64("_page"), F.col("_parts")).alias("_part"), "_html")
    return dealt.mapInPandas(make, "_host string, _page long, _part long, _mark string, blocks binary")


def _expressions(features: DataFrame) -> DataFrame:
    """(_host, _mark, _pages, expression as JSON) of pages as ``_features`` gives them, folded in parts, and parts of parts, by hash."""
    dealt = features.select("_host", "_mark", "_part", F.col("_page").alias("_at"), "blocks", F.lit(None).cast("string").alias("expression"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = at = whole = None  # sorted rows of one part come together, copies of a page too
        for b in batches:
            out = []
            for host, mark, part, page, blocks, made in b[["_host", "_mark", "_part", "_at", "blocks", "expression"]].itertuples(index=False):
                if key == (host, mark, part):
                    if at != page:
                        whole = align(whole, _unpacked(blocks, made))
                else:
                    if key:
                        out.append((*key, whole["pages"], json.dumps(whole)))
                    key, whole = (host, mark, part), _unpacked(blocks, made)
                at = page
            yield pd.DataFrame(out, columns=["_host", "_mark", "_at", "_pages", "expression"])
        if key:
            yield pd.DataFrame([(*key, whole["pages"], json.dumps(whole))], columns=["_host", "_mark", "_at", "_pages", "expression"])

    now = None
    while True:
        sorted_parts = dealt.repartition("_host", "_mark", "_part").sortWithinPartitions("_host", "_mark", "_part", "_at")
        folded = materialise(sorted_parts.mapInPandas(fold, "_host string, _mark string, _at long, _pages long, expression string"), "expressions")
        if now is not None:
            release(now)
        now = folded
        sizes = now.groupBy("_host", "_mark").agg(F.count(F.lit(1)).alias("_n"))
        if not sizes.where("_n > 1").limit(1).count():
            return now.select("_host", "_mark", "_pages", "expression")
        parts = sizes.withColumn("_part", F.ceil(F.col("_n") / PART))
        dealt = now.join(parts, ["_host", "_mark"]).select("_host", "_mark", F.pmod(F.xxhash64("_at"), F.col("_part")).alias("_part"), "_at", F.lit(None).cast("binary").alias("blocks"), "expression")


def _unpacked(blocks: bytes | None, made: str | None) -> dict:
    """The expression of a page's packed blocks, or one that is made already."""
    return json.loads(made) if blocks is None else expression(json.loads(zlib.decompress(blocks).decode("utf-8", "surrogatepass")))


def _wrappers(pages: DataFrame) -> DataFrame:
    """(_host, _mark, expression as JSON) of pages (_host, _html): of each class of several pages of a host; one alone tells nothing."""
    return materialise(_expressions(_features(pages)).where("_pages > 1").drop("_pages"), "wrappers")


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    given, names = set_aside(pages.select(keep), ["_host", "_html", "_part", "_parts", "_mark", "_text", "host", "path", "expression"])
    named = dict(zip(keep, names, strict=True))
    url = given.select("*", F.col(named["url"]).alias("_url")) if "url" not in given.columns else given
    placed = parse(url if "url" in given.columns else url.withColumnRenamed("_url", "url")).withColumn("_host", F.col("host")).drop("host", "path").withColumn("_html", F.col(named[html]))
    known = _wrappers(placed.select("_host", "_html"))
    size = known.agg(F.sum(F.length("expression"))).first()[0] or 0
    result = [F.col(new).alias(old) for old, new in named.items()]
    if size > BROADCAST_BYTES:
        done = _extracted_by_group(placed, known, names)
    else:
        shared = spark.sparkContext.broadcast({(r["_host"], r["_mark"]): r["expression"] for r in known.toLocalIterator()})

        def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            ready: dict[tuple, Wrapper] = {}

            def find(host: str, mark: str) -> Wrapper | None:
                if (host, mark) not in ready and (host, mark) in shared.value:
                    ready[host, mark] = Wrapper(mark, json.loads(shared.value[host, mark]))
                return ready.get((host, mark))

            for bodies, hosts in batches:
                yield pd.Series([main_text(body, partial(find, host)) for body, host in zip(bodies, hosts, strict=True)], dtype=object)

        done = placed.select(*names, F.pandas_udf(texts, "string")("_html", "_host").alias("_text"))
    return done.select(*result, F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def _extracted_by_group(placed: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
    """placed with _text where wrappers are too large to broadcast: parts of a class of pages meet its wrapper once each."""

    def marks(bodies: pd.Series) -> pd.Series:
        return pd.Series([stream(read(body))[0] if body else NAMELESS for body in bodies], dtype=object)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(names).schema)
    parts = materialise(placed.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts")), "page-parts")
    part = F.pmod(F.xxhash64("_html", F.monotonically_increasing_id()), F.col("_parts"))
    dealt = placed.join(parts, "_host").select(*names, "_host", "_html", F.pandas_udf(marks, "string")("_html").alias("_mark"), part.alias("_part"))
    each = known.join(parts, "_host").select("_host", "_mark", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), "expression")

    def texts(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        wrapper = Wrapper(found["_mark"].iloc[0], json.loads(found["expression"].iloc[0])) if len(found) else None
        return rows[names].assign(_text=[main_text(body, lambda mark: wrapper) for body in rows["_html"]])

    return dealt.groupBy("_host", "_mark", "_part").cogroup(each.groupBy("_host", "_mark", "_part")).applyInPandas(texts, f"{kinds}, _text string")
