"""Main-text extraction with wrappers: union-free expressions inferred from the pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.text import BROADCAST_ROWS, by_size, hot_join
from gridfolio.session import written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"<>]*\"|'[^'<>]*'|[^'\">])*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][\w:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Elements that start a block of text.
BLOCKS = frozenset(
    "html body article main section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset legend details summary address hr menu dialog center option button label".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the second kind ends an open one of the first.
IMPLIED = {
    "p": BLOCKS - {"button", "label", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"},
}
#: Elements whose content is no text of the page.
SILENT = frozenset("head svg math select canvas object".split())
#: Elements that never hold the main text.
ASIDE = frozenset("nav aside footer form menu dialog button label option fieldset".split())
#: Words of a class, id or role that mark what isn't the main text.
ASIDE_WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement adverts alert announcement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright "
    "disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted "
    "recommended related replies respondents share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACE = re.compile(r"\s+")
#: Different pages that must agree before a text counts as part of the template.
SUPPORT = 3
#: Inside a marked article a text is a constant only if so large a share of the host's pages have it, or so large a share of the texts
#: under its path of elements are it: articles of a host may share passages.
FIRM = 2 / 3
#: Cells of an alignment's table; longer sequences are first cut where both have the same rare token.
CELLS = 1_000_000
#: Nodes of a wrapper from which it is put aside and a new one begun, to be aligned with it at the end.
LONGEST = 4_000
#: Partial wrappers of a host that are aligned in one task.
FAN_IN = 64
#: Longest texts of a page by which it is told from its copies.
TELLING = 3
#: Wrappers of all hosts together that may be broadcast, in bytes; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass
class Leaf:
    path: tuple[str, ...]
    text: str
    linked: int
    #: Set aside by an element around it, and by one inside the article.
    aside: bool
    aside_inside: bool
    article: bool
    #: Number of the outermost article around it.
    region: int = 0

    @property
    def weight(self) -> int:
        """Characters that speak for main text: those outside links, none where it is set aside."""
        return 0 if self.aside else max(0, len(self.text) - 2 * self.linked)


@dataclass
class _Element:
    tag: str
    key: str
    aside: bool
    article: bool
    number: int = 0


def _described(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Key of an element (its tag and first class), whether it is set aside, and whether it is the article."""
    words: list[str] = []
    first, hidden, main = "", False, False
    if attrs.strip(" /"):
        for name, value in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", ""))
            main |= name == "role" and value == "main"
            words += re.findall(r"[a-z]+", value) if name != "style" else []
            if name == "class" and not first:
                first = value.split()[0] if value.split() else ""
    aside = tag in ASIDE or hidden or (tag not in ("html", "body") and any(w in ASIDE_WORDS for w in words))
    return (f"{tag}.{first}" if first else tag), aside, tag in ("article", "main") or main


def leaves(page: str | None) -> tuple[list[str], list[Leaf]]:
    """The token stream of a page (element starts and ends, ``#`` for a block's text) and its blocks of text.

    Elements inside a line are no tokens; missing end tags are supplied; scripts, styles and comments are left out.
    """
    stream: list[str] = []
    found: list[Leaf] = []
    stack: list[_Element] = []
    buffer: list[str] = []
    linked, in_link = 0, False
    opened = 0

    def flush():
        nonlocal linked
        text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
        if text:
            inside = [i for i, e in enumerate(stack) if e.article]
            own = stack[inside[0] :] if inside else stack
            # A header outside an article is the page's; inside it only the headings belong to the text.
            header = any(e.tag == "header" for e in own) and not (inside and any(e.tag in HEADINGS for e in stack))
            within, around = (header or any(e.aside for e in part) for part in (own, stack))
            stream.append("#")
            found.append(Leaf(tuple(e.key for e in stack), text, min(linked, len(text)), around, within, bool(inside), own[0].number if inside else 0))
        buffer.clear()
        linked = 0

    def close():
        stream.append(f"</{stack.pop().key}>")

    silent: list[str] = []
    for m in TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            if not silent:
                buffer.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end = tag.lower(), bool(m["end"] or m["end2"])
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        # A silent element ends with its end tag, or where text must go on: its end tag may be missing.
        if silent and (tag in BLOCKS and not (tag == "option" and silent[-1] == "select")):
            silent.clear()
        if tag in SILENT:
            if end and tag in silent:
                del silent[silent.index(tag) :]
            elif not end and not attrs.rstrip().endswith("/"):
                silent.append(tag)
            continue
        if silent:
            continue
        if tag == "a":
            in_link = not end
        if tag == "br":
            buffer.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if end:
            if any(e.tag == tag for e in stack):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        while stack and tag in IMPLIED.get(stack[-1].tag, ()):
            close()
        key, aside, article = _described(tag, attrs)
        if tag in VOID:
            continue
        opened += 1
        stack.append(_Element(tag, key, aside, article, opened))
        stream.append(f"<{key}>")
    flush()
    while stack:
        close()
    return stream, found


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


# Wrapper nodes are lists: ["t", token], ["o", nodes] optional, ["r", nodes] repeated, and for text ["x", weight, members]:
# the characters that speak for main text, and, of a single page, the numbers of its blocks.


def _signature(node: list) -> str:
    if node[0] == "t":
        return node[1]
    if node[0] == "x":
        return "#"
    return ("(" if node[0] == "r" else "[") + "".join(map(_signature, node[1])) + (")+" if node[0] == "r" else "]?")


def _merged(a: list, b: list) -> list:
    """One node for two with the same signature."""
    if a[0] == "t":
        return a
    if a[0] in "or":
        return [a[0], [_merged(x, y) for x, y in zip(a[1], b[1], strict=True)]]
    return ["x", a[1] + b[1], a[2] + b[2]]


def fold(nodes: list[list]) -> list[list]:
    """Turn tandem repeats into repeated groups, shortest groups first, so that groups may nest."""
    signs = [_signature(n) for n in nodes]
    while width := _shortest_repeat(signs):
        out, i = [], 0
        while i < len(nodes):
            j = i + width
            if _opens(signs[i]) and signs[i:j] == signs[j : j + width] and _balanced(signs[i:j]):
                group = nodes[i:j]
                while signs[j : j + width] == signs[i : i + width]:
                    group = [_merged(a, b) for a, b in zip(group, nodes[j : j + width], strict=True)]
                    j += width
                out.append(["r", group])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
        signs = [_signature(n) for n in nodes]
    return nodes


def _opens(sign: str) -> bool:
    return sign.startswith("<") and not sign.startswith("</")


def _shortest_repeat(signs: list[str]) -> int:
    """The width of the shortest group of whole elements that is followed by itself; 0 without one.

    A group begins with an element and ends where a later sibling of it begins, so only these places are compared.
    """
    n = len(signs)
    # Where the next sibling of what begins at a place begins; 0 where there is none.
    after, stack = [0] * n, []
    for i, sign in enumerate(signs):
        if _opens(sign):
            stack.append(i)
        elif not sign.startswith("</"):
            after[i] = i + 1
        elif stack:
            after[stack.pop()] = i + 1
    best = 0
    for i, sign in enumerate(signs):
        if not _opens(sign):
            continue
        j = after[i]
        while j and 2 * j - i <= n and (not best or j - i < best):
            if signs[j] == sign and signs[i:j] == signs[j : 2 * j - i]:
                best = j - i
                break
            j = after[j] if j < n else 0
    return best


def _balanced(signs: list[str]) -> bool:
    depth = 0
    for s in signs:
        depth += s.startswith("<") and not s.startswith("</")
        depth -= s.startswith("</")
        if depth < 0:
            return False
    return depth == 0


def _as_repeats(nodes: list[list], groups: dict[str, list]) -> list[list]:
    """A single occurrence of what the other side repeats is a repeated group too."""
    for inner, group in sorted(groups.items(), key=lambda x: -len(x[0])):
        width = len(group)
        signs = [_signature(n) for n in nodes]
        out, i = [], 0
        while i < len(nodes):
            if i + width <= len(nodes) and "".join(signs[i : i + width]) == inner:
                own = nodes[i : i + width]
                if out and _signature(out[-1]) == f"({inner})+":
                    out[-1] = _merged(out[-1], ["r", own])
                else:
                    out.append(["r", own])
                i += width
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _groups(nodes: list[list]) -> dict[str, list]:
    out = {}
    for n in nodes:
        if n[0] in "or":
            out |= _groups(n[1])
            if n[0] == "r":
                out["".join(map(_signature, n[1]))] = n[1]
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers: what matches is merged, what only one side has becomes optional.

    The match is a longest common subsequence of node signatures, in which optional groups match what they hold;
    mismatches between two matches are resolved as repeats where the group occurs on the other side, else as
    optional groups.
    """
    a, b = _as_repeats(a, _groups(b)), _as_repeats(b, _groups(a))
    sa, sb = [_signature(n) for n in a], [_signature(n) for n in b]
    if sa == sb:
        return [_merged(x, y) for x, y in zip(a, b, strict=True)]
    pairs = iter([*_matches(sa, sb), (len(a), len(b))])
    match = next(pairs)
    out, i, j = [], 0, 0
    gap_a: list[list] = []
    gap_b: list[list] = []

    def close_gap():
        if gap_a and gap_b and gap_a[-1][0] == "o" and "".join(map(_signature, gap_a[-1][1])) == "".join(map(_signature, gap_b)):
            out.extend(gap_a[:-1])
            out.append(["o", [_merged(x, y) for x, y in zip(gap_a[-1][1], gap_b, strict=True)]])
        elif gap_a and gap_b and gap_b[-1][0] == "o" and "".join(map(_signature, gap_b[-1][1])) == "".join(map(_signature, gap_a)):
            out.append(["o", [_merged(x, y) for x, y in zip(gap_b[-1][1], gap_a, strict=True)]])
        else:
            for gap in (gap_a, gap_b):
                if len(gap) == 1 and gap[0][0] == "o":
                    out.append(gap[0])
                elif gap:
                    out.append(["o", list(gap)])
        gap_a.clear(), gap_b.clear()

    while i < len(a) or j < len(b):
        if (i, j) == match:
            close_gap()
            out.append(_merged(a[i], b[j]))
            i, j, match = i + 1, j + 1, next(pairs)
        elif i < match[0]:
            gap_a.append(a[i])
            i += 1
        else:
            gap_b.append(b[j])
            j += 1
    close_gap()
    return out


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; of very long sequences one between rare tokens that both have."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    n, m = len(a) - start - end, len(b) - start - end
    inner = _longest(a[start : start + n], b[start : start + m]) if n * m <= CELLS else _anchored(a[start : start + n], b[start : start + m])
    same = [(k, k) for k in range(start)]
    return same + [(start + i, start + j) for i, j in inner] + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _anchored(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matches around the tokens that either side has once, as many in order as there are; none without such tokens."""
    ca, cb = Counter(a), Counter(b)
    place = {t: j for j, t in enumerate(b) if cb[t] == 1}
    common = [(i, place[t]) for i, t in enumerate(a) if ca[t] == 1 and t in place]
    tails: list[int] = []
    chain: list[tuple[int, int | None]] = []
    ends: list[int] = []
    for k, (_, j) in enumerate(common):
        at = bisect_left(tails, j)
        chain.append((k, ends[at - 1] if at else None))
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    anchors, k = [], ends[-1] if ends else None
    while k is not None:
        anchors.append(common[k])
        k = chain[k][1]
    out, i, j = [], 0, 0
    for x, y in [*anchors[::-1], (len(a), len(b))] if anchors else []:
        out += [(i + p, j + q) for p, q in _matches(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def page_number(found: list[Leaf]) -> int:
    """What a page is told from others by: its longest texts, so that copies count once."""
    longest = sorted({f.text for f in found if not f.aside} or {f.text for f in found}, key=lambda t: (-len(t), t))[:TELLING]
    return text_key("\0".join(longest))


def path_key(leaf: Leaf) -> int:
    return text_key("/".join(leaf.path))


def place_key(leaf: Leaf) -> int:
    """A text with the path of elements that it stands under."""
    return text_key("/".join(leaf.path) + "\0" + leaf.text)


def page_wrapper(stream: list[str], found: list[Leaf]) -> list[list]:
    """The wrapper of one page."""
    at = iter(range(len(found)))
    return fold([["x", found[k := next(at)].weight, [k]] if token == "#" else ["t", token] for token in stream])


@dataclass
class Template:
    """What extraction needs of a host: its constants, texts with their places, those that are constants inside articles too, and its wrapper's nodes."""

    constants: set[int] = field(default_factory=set)
    firm: set[int] = field(default_factory=set)
    nodes: list[list] = field(default_factory=list)

    def constant(self, leaf: Leaf, inside: bool = False) -> bool:
        return place_key(leaf) in (self.firm if inside else self.constants)


def _texts(nodes: list[list]) -> Iterator[list]:
    for n in nodes:
        if n[0] == "x":
            yield n
        elif n[0] in "or":
            yield from _texts(n[1])


def region(nodes: list[list]) -> set[int]:
    """The blocks of a page that lie in the main region of the wrapper that it was aligned to.

    The main region is the smallest element that holds seven tenths of the weight of all texts of the host's pages; what is
    constant or set aside has no weight. Optional and repeated groups count as part of the element around them.
    """
    weight: Counter = Counter()
    inside: list[tuple[tuple[int, ...], int, list[int]]] = []
    stack: list[tuple[int, str]] = []
    number = 0

    def walk(part: list[list]) -> None:
        nonlocal number
        for n in part:
            if n[0] == "x":
                # The element of a single block is no region.
                own = tuple(k for k, _ in stack[:-1])
                inside.append((own, n[1], n[2]))
                weight.update(dict.fromkeys(own, n[1]))
            elif n[0] in "or":
                walk(n[1])
            elif n[1].startswith("</"):
                name = n[1][2:]
                if any(t == name for _, t in stack):
                    while stack.pop()[1] != name:
                        pass
            else:
                number += 1
                stack.append((number, n[1][1:]))

    walk(nodes)
    total = sum(w for _, w, _ in inside)
    best = max((k for k, w in weight.items() if w * 10 >= total * 7), default=0) if total else 0
    return {m for own, _, members in inside if not best or best in own for m in members}


def main_text(found: list[Leaf], host: Template, stream: list[str] | None = None) -> str:
    """The blocks of the article, joined by blank lines.

    Where a page marks its article, the blocks inside it that aren't set aside are candidates; if all its articles
    lie in elements that are set aside (a class of the whole layout, say), only what is inside them counts. The
    host's template decides there too: its firm constants go, unless nothing else is left (copies of one article agree
    in all their blocks), and so do articles that are mostly links where others aren't.

    Elsewhere the host's wrapper decides alone: the page is aligned to it, its constants go, and of the rest what lies in the
    wrapper's main region stays, without blocks that are mostly links.
    """
    marked = [f for f in found if f.article]
    if article := [f for f in marked if not f.aside] or [f for f in marked if not f.aside_inside]:
        article = [f for f in article if not host.constant(f, True)] or article
        plain: dict[int, int] = {}
        for f in article:
            plain[f.region] = plain.get(f.region, 0) + len(f.text) - 2 * f.linked
        article = [f for f in article if plain[f.region] >= 0] or article
        return "\n\n".join(f.text for f in article)
    fixed = [host.constant(f) for f in found]
    kept = {i for i, f in enumerate(found) if not f.aside and not fixed[i] and f.linked * 2 <= len(f.text)}
    if stream is not None and kept:
        own = page_wrapper(stream, found)
        for n in _texts(own):
            # The page counts for the wrapper already; a constant of it speaks for nothing.
            n[1] = 0 if host.nodes else sum(found[i].weight for i in n[2] if not fixed[i])
        kept &= region(align(host.nodes, own) if host.nodes else own)
    return "\n\n".join(found[i].text for i in sorted(kept))


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", (url or "").strip(), re.I)
    return m[1].lower() if m else ""


def _read(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Of each task the partial wrappers of its hosts (host, wrapper), and of each page its number and its texts by path and place (host, page, paths, keys).

    Every page is aligned to the wrapper of its host where it is read, so a host with very many pages sends one partial wrapper a task.
    """
    schema = "host string, wrapper string, page long, paths array<long>, keys array<long>"
    names = ["host", "wrapper", "page", "paths", "keys"]

    def partial(batches):
        wrappers: dict[str, list] = {}
        seen: set[int] = set()
        out: list[tuple] = []

        def flush(hosts: list[str]) -> None:
            out.extend((h, json.dumps(wrappers.pop(h)), None, None, None) for h in hosts)

        def frame() -> pd.DataFrame:
            # Column by column: numbers of 63 bits beside nulls would become floating-point ones.
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pd.DataFrame({n: pd.array(c, dtype="Int64") if n == "page" else pd.Series(c, dtype=object) for n, c in zip(names, columns, strict=True)})

        for pdf in batches:
            for part in by_size([pdf], "html"):
                for url, page in zip(part["url"], part["html"], strict=True):
                    key = text_key(f"{url}\0{page}")
                    if not page or key in seen:
                        continue
                    seen.add(key)
                    host = host_of(url)
                    stream, found = leaves(page)
                    own = page_wrapper(stream, found)
                    for n in _texts(own):
                        n[2] = []
                    wrappers[host] = align(wrappers[host], own) if host in wrappers else own
                    own_places = {place_key(f): path_key(f) for f in found}
                    out.append((host, None, page_number(found), list(own_places.values()), list(own_places)))
                    if len(wrappers[host]) > LONGEST:
                        flush([host])
                if len(seen) >= 200_000 or len(wrappers) >= 5_000:
                    flush(list(wrappers))
                    seen.clear()
                yield frame()
        flush(list(wrappers))
        yield frame()

    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return written(rows.mapInPandas(partial, schema), "page-parts")


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON of nodes and constants): one union-free expression for all pages of a host.

    The partial wrappers of a host are aligned with each other in the order of their texts. A text is constant where SUPPORT
    different pages of the host have it under one path of elements, and a firm one where they are FIRM of its pages or of the texts
    under that path; that is counted over all pages, in whatever order they are read.
    """

    def merged(pdf) -> list:
        out: list = []
        for w in sorted(pdf["wrapper"]):
            out = align(out, json.loads(w)) if out else json.loads(w)
        return out

    def merge(key, pdf):
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(merged(pdf))]})

    read = _read(pages, url_col, html_col)
    pages_read = read.where("page is not null")
    places = pages_read.select("host", "page", F.explode(F.arrays_zip("paths", "keys")).alias("at")).select("host", "page", "at.paths", "at.keys")
    # Counts are summed where they are, so a text that all pages have is no hot key.
    counted = written(places.distinct().groupBy("host", "paths", "keys").agg(F.count(F.lit(1)).alias("n")), "page-texts")
    on_path = counted.groupBy("host", "paths").agg(F.sum("n").alias("on_path"))
    of_host = pages_read.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    constant = counted.where(F.col("n") >= SUPPORT).join(on_path, ["host", "paths"]).join(of_host, "host")
    firm = F.col("n") >= FIRM * F.least("on_path", "of_host")
    constants = constant.groupBy("host").agg(F.sort_array(F.collect_list("keys")).alias("constants"), F.sort_array(F.collect_list(F.when(firm, F.col("keys")))).alias("firm"))
    # Equal wrappers come from copies of pages and count once.
    parts = written(read.where("wrapper is not null").select("host", "wrapper").distinct(), "partial-wrappers")
    # A host with very many pages has very many partial wrappers: FAN_IN of them or so are aligned in one task.
    while (parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 2 * FAN_IN:
        groups = parts.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / FAN_IN).alias("groups")).where("groups > 1")
        salted = parts.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "host", "left")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.coalesce("groups", F.lit(1))))
        parts = written(salted.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string"), "partial-wrappers")
    whole = parts.groupBy("host").applyInPandas(merge, "host string, wrapper string")
    shown = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
    parts_of = (F.lit('{"nodes":'), F.col("wrapper"), F.lit(',"constants":'), shown("constants"), F.lit(',"firm":'), shown("firm"), F.lit("}"))
    return whole.join(constants, "host", "left").select("host", F.concat(*parts_of).alias("wrapper"))


def loaded(wrapper: str | None) -> Template:
    own = json.loads(wrapper) if wrapper else {"nodes": [], "constants": [], "firm": []}
    return Template(set(own["constants"]), set(own["firm"]), own["nodes"])


def extract(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block is one space, blocks are joined in page order
    by a blank line, and the text is empty where a page (or a null html) has none. A null url belongs to the host
    without a name. Repeated rows give repeated results; other columns are not read. Wrappers of BROADCAST_BYTES or less in all go to
    the tasks as they are; more meet their pages by a join in which the pages of hosts with many stay where they are.
    """
    spark = pages.sparkSession
    wrappers = written(infer(pages, url_col, html_col) if wrappers is None else wrappers, "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    host = F.lower(F.regexp_extract(F.trim(F.coalesce(F.col(url_col), F.lit(""))), r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    if size <= BROADCAST_BYTES:
        # Bounded by the check above; a page doesn't carry its host's wrapper through its batch then.
        sent = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        sent = spark.sparkContext.broadcast({})
        named = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("weight")).join(wrappers, "host", "left"), "wrappers")
        rows = hot_join(rows, named, "host", "weight", pages.count())

    def run(batches):
        known: dict[str, Template] = {}
        for pdf in by_size(batches, "html"):
            texts = []
            for own, wrapper, page in zip(pdf["host"], pdf["wrapper"], pdf["html"], strict=True):
                if own not in known:
                    if len(known) >= 2_000:
                        known.clear()
                    known[own] = loaded(sent.value.get(own, wrapper))
                stream, found = leaves(page)
                texts.append(main_text(found, known[own], stream))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]}).astype({"page_id": "Int64"})

    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
