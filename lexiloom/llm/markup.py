"""Clean text from HTML, Markdown, wiki and LaTeX sources, with headings, list items, code blocks and formulas kept as such.

Each text is read by the reader of its dialect, told from the signs it uses (never from its file name), into one kind of
tree. Tree scoring then finds the main content: paragraphs pass points for length and commas to the containers above them,
discounted by link density; the best container and its siblings are kept, so navigation, sidebars and link lists fall away.
Texts are independent of one another: one narrow pass without a shuffle, whatever the size.
"""
from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML that stand by themselves, and those without content.
BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
]
EMPTY = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
]
INLINE = [
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
]
HIDDEN = [
    "head", "script", "style", "template", "noscript", "title", "textarea",
]
CONTAINERS = [
    "article", "aside", "body", "div", "footer", "header", "html", "main", "nav", "section",
]
#: TeX commands that print a sign, and accents as combining marks.
TEX_SIGNS = {"oe": "œ", "OE": "Œ", "ae": "æ", "AE": "Æ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ss": "ß", "i": "ı", "j": "ȷ", "ldots": "…", "dots": "…", "textellipsis": "…", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textquotedblleft": "“", "textquotedblright": "”", "textquoteleft": "‘", "textquoteright": "’", "guillemotleft": "«", "guillemotright": "»", "og": "« ", "fg": " »", "textendash": "–", "textemdash": "—", "S": "§", "P": "¶", "copyright": "©", "pounds": "£", "euro": "€", "TeX": "TeX", "LaTeX": "LaTeX", "quad": " ", "qquad": " ", "textbar": "|", "textless": "<", "textgreater": ">", "textdollar": "$"}
TEX_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "b": "\u0331", "d": "\u0323"}
TEX_SECTIONS = [
    "part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph",
]
TEX_DROPPED = [
    "label", "footnote", "footnotetext", "thanks", "index", "includegraphics", "documentclass", "usepackage", "input", "include", "bibliography",
    "bibliographystyle", "cite", "citep", "citet", "ref", "pageref", "vspace", "hspace", "setcounter", "pagestyle", "thispagestyle", "title",
    "author", "date",
]
TEX_LISTS = [
    "itemize", "enumerate", "description",
]
TEX_CODE = [
    "verbatim", "verbatim*", "Verbatim", "lstlisting", "minted", "alltt",
]
TEX_MATH = [
    "equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "eqnarray*", "displaymath", "math",
]
#: Of a container's score a sibling container must have this share to be kept; more than this part of its text in links drops it.
#: A list of fewer items is never taken for navigation.
SIBLING_SHARE, LINK_LIMIT, LEAST_ITEMS = 0.2, 0.5, 3


@dataclass
class Node:
    kind: str  # root, box, quote, list, item, heading, para, code, formula, table, note
    text: str = ""
    children: list = field(default_factory=list)
    linked: int = 0  # signs of text that are a link's
    level: int = 0
    score: float = 0.0

    def add(self, kind: str, text: str = "", **more) -> "Node":
        self.children.append(Node(kind, text, **more))
        return self.children[-1]

    def walk(self):
        """The node and all below it in order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


_aside = re.compile("\ue000(\\d+)\ue001")


class Kept:
    """Stretches of a text set aside while the rest is worked on; a private-use sign and a number stand for each."""

    def __init__(self):
        self.items: list[tuple[str, str]] = []
        self.links = 0

    def put(self, kind: str, text: str) -> str:
        self.items.append((kind, text))
        return f"\ue000{len(self.items) - 1}\ue001"

    def restore(self, text: str) -> str:
        while "\ue000" in text:  # what is set aside holds only what was set aside before it
            text = _aside.sub(lambda m: self.items[int(m[1])][1], text)
        return text

    def inside(self, text: str):
        return [self.items[int(k)] for k in _aside.findall(text)] if "\ue000" in text else []


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _own(text: str) -> str:
    """Input without the private-use signs that stand for what is set aside."""
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\ue000", "").replace("\ue001", "").replace("\x00", "")


def _formulas(node: Node, text: str, kept: Kept) -> None:
    for kind, tex in kept.inside(text):
        if kind == "formula":
            node.add("formula", tex)
        elif kind in ("text", "link"):
            _formulas(node, tex, kept)


# --- HTML -------------------------------------------------------------------------------------------------------------

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<![A-Za-z\[][^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s+[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?)>", re.S)
_tex_in_html = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$", re.S)
_literal = re.compile("\ue002(.*?)\ue003", re.S)
_ends = {name: re.compile(rf"</{name}\s*>", re.I) for name in [*HIDDEN, "pre"]}
_closers = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def read_html(text: str, root: Node) -> None:
    """HTML, whole or in part, tag soup included, below root."""
    stack: list[tuple[str, Node]] = [("", root)]
    pieces: list[tuple[bool, str]] = []  # (in a link, text) of the open block
    link = literal = 0

    def flush(node: Node) -> None:
        nonlocal pieces
        if any(not t.isspace() for _, t in pieces if t):
            kept = Kept()
            raw = "".join(t for _, t in pieces)
            linked = sum(len(squeeze(t)) for in_link, t in pieces if in_link)
            if "\ue002" in raw:
                raw = _literal.sub(lambda m: kept.put("literal", m[1]), raw)
            if "\\" in raw or "$$" in raw:
                raw = _tex_in_html.sub(lambda m: kept.put("formula", squeeze(kept.restore(m[1] or m[2] or m[3]))), raw)
            if node.kind in ("heading", "para") and not node.text:
                at = node
            else:
                at = node.add("para")
            at.text, at.linked = squeeze(kept.restore(raw)), at.linked + linked
            _formulas(at, raw, kept)
        pieces = []

    def close_to(depth: int) -> None:
        flush(stack[-1][1])
        del stack[depth:]

    def find(names, stop=()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stop:
                return 0
        return 0

    at = 0
    while at < len(text):
        m = _tag.search(text, at)
        plain = text[at : m.start() if m else len(text)]
        if plain:
            pieces.append((link > 0, html.unescape(plain)))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in HIDDEN and not closing:
            end = _ends[name].search(text, at)
            at = end.end() if end else len(text)
            continue
        if name == "a":
            link = max(0, link + (-1 if closing else 1))
        elif name == "br":
            pieces.append((False, "\n"))
        elif name == "code" or name in ("kbd", "samp", "tt"):
            if closing and literal or not closing and not literal:
                literal = 0 if closing else 1
                pieces.append((False, "\ue003" if closing else "\ue002"))
        elif name == "pre" and not closing:
            end = _ends["pre"].search(text, at)
            inner = text[at : end.start() if end else len(text)]
            at = end.end() if end else len(text)
            if k := find({"p"}):
                close_to(k)
            flush(stack[-1][1])
            code = html.unescape(_tag.sub(lambda t: "" if t[2] is None or t[2].lower() in INLINE else t[0], inner))
            stack[-1][1].add("code", code.strip("\n"))
        elif name in BLOCKS:
            link = literal = 0
            if closing:
                k = find({name}, () if name in CONTAINERS or name in ("table", "ul", "ol", "blockquote") else {"ul", "ol", "table"} - {name})
                if k:
                    close_to(k)
                elif name != "p":
                    flush(stack[-1][1])
                continue
            if k := find({"p", "h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "td", "th", "div", "blockquote"}):
                close_to(k)
            if name in _closers and (k := find(_closers[name], {"ul", "ol", "table", "dl"})):
                while (again := next((j for j in range(1, k) if stack[j][0] in _closers[name] and not any(stack[i][0] in ("ul", "ol", "table", "dl") for i in range(j, k))), 0)):
                    k = again
                close_to(k)
            flush(stack[-1][1])
            parent = stack[-1][1]
            if name == "hr":
                continue
            if name[0] == "h" and name[1:].isdigit():
                node = parent.add("heading", level=int(name[1]))
            elif name == "p":
                node = parent.add("para")
            elif name in ("ul", "ol"):
                node = parent.add("list", level=int(name == "ol"))
            elif name == "li":
                node = parent.add("item")
            elif name == "blockquote":
                node = parent.add("quote")
            elif name in ("table", "tbody", "thead", "tfoot", "tr", "td", "th"):
                node = parent.add("table")
            else:
                node = parent.add("box")
            stack.append((name, node))
    flush(stack[-1][1])


# --- Markdown ---------------------------------------------------------------------------------------------------------

_fence = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_atx = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_rule = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_marker = re.compile(r"( *)([-*+]|\(?\d{1,9}[.)]|#\.)( +|\t)(?=\S)")
_html_block = re.compile(r" {0,3}<(/?)(" + "|".join([*BLOCKS, *HIDDEN]) + r")(?=[\s/>])", re.I)
_note = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]?")
_reference = re.compile(r" {0,3}\[([^\]^][^\]]*)\]:[ \t]*\S+.*$")
_quoted = re.compile(r"^(?: {0,3}> ?)+")
_quote = re.compile(r" {0,3}>")
_fences = re.compile(r" {0,3}:{3,}")
_hashes = re.compile(r" {0,3}#{1,6}$")
_under = re.compile(r" {0,3}(=+|-{2,}) *")
_attributes = re.compile(r"[ \t]*\{[#.:][^{}]*\}[ \t]*$")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def read_markdown(text: str, root: Node) -> None:
    lines = text.expandtabs(4).split("\n") if "\t" in text else text.split("\n")
    if lines and re.fullmatch(r"---[ ]*", lines[0]):  # front matter
        for k in range(1, len(lines)):
            if re.fullmatch(r"(---|\.\.\.)[ ]*", lines[k]):
                if any(re.match(r"[\w-]+\s*:", x) for x in lines[1:k]):
                    lines = lines[k + 1 :]
                break
    references = {m[1].lower() for x in lines if "]:" in x and (m := _reference.match(x))}
    todo = [(lines, root)]
    while todo:  # what is nested in a quotation, an item or a note waits its turn, however deep it is
        _markdown_blocks(*todo.pop(), references, todo)


def _markdown_blocks(lines: list[str], parent: Node, references: set[str], todo: list) -> None:
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        bare = line.strip()
        if not bare:
            i += 1
        elif bare.startswith("<!--"):
            while i < n and "-->" not in lines[i]:
                i += 1
            rest = lines[i].split("-->", 1)[1] if i < n else ""
            i += 1
            if rest.strip():
                lines[i - 1] = rest
                i -= 1
        elif m := _fence.match(line):
            mark, info = m[1], m[2]
            if mark[0] == "`" and "`" in info:
                i = _markdown_paragraph(lines, i, parent, references)
                continue
            end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ ]*$")
            i += 1
            code = []
            while i < n and not end.match(lines[i]):
                code.append(lines[i])
                i += 1
            i += 1
            parent.add("code", "\n".join(code))
        elif _fences.match(line):
            i += 1
        elif (m := _atx.match(line)) and not _hashes.match(line):
            _markdown_inline(parent.add("heading", level=len(m[1])), _attributes.sub("", m[2] or ""), references)
            i += 1
        elif _rule.match(line):
            i += 1
        elif _quote.match(line):
            inner = []
            while i < n and lines[i].strip() and (_quote.match(lines[i]) or inner and not _starts_block(lines[i])):
                inner.append(_quoted.sub("", lines[i], 1))
                i += 1
            todo.append((inner, parent.add("quote")))
        elif _marker.match(line) and _indent(line) < 4:
            i = _markdown_list(lines, i, parent, todo)
        elif _indent(line) >= 4:
            code = []
            while i < n and (not lines[i].strip() or _indent(lines[i]) >= 4):
                code.append(lines[i][4:])
                i += 1
            parent.add("code", "\n".join(code).strip("\n"))
        elif m := _note.match(line):
            inner = [line[m.end() :]]
            i += 1
            while i < n and (lines[i].strip() and not (_starts_block(lines[i]) or _note.match(lines[i])) or not lines[i].strip() and i + 1 < n and _indent(lines[i + 1]) >= 4):
                inner.append(lines[i][4:] if _indent(lines[i]) >= 4 else lines[i])
                i += 1
            todo.append((inner, parent.add("note")))
        elif _reference.match(line):
            i += 1
        elif m := _html_block.match(line):
            i = _markdown_html(lines, i, m, parent)
        elif bare.startswith("|"):
            while i < n and lines[i].strip():
                _markdown_inline(parent.add("table"), lines[i], references)
                i += 1
        else:
            i = _markdown_paragraph(lines, i, parent, references)


def _starts_block(line: str) -> bool:
    return bool(_fence.match(line) or _atx.match(line) and not line.strip("# ") == "" or _marker.match(line) and _indent(line) < 4 or _quote.match(line) or _rule.match(line))


def _markdown_paragraph(lines: list[str], i: int, parent: Node, references: set[str]) -> int:
    """Lines up to a blank one, a fence or an underline; a marker within a paragraph is text, as where a year begins a line."""
    start = i
    while i < len(lines) and lines[i].strip() and not (i > start and (_fence.match(lines[i]) or lines[i].lstrip().startswith("<!--") or _fences.match(lines[i]))):
        if i > start and _under.fullmatch(lines[i]):
            _markdown_inline(parent.add("heading", level=1 if "=" in lines[i] else 2), _attributes.sub("", "\n".join(lines[start:i])), references)
            return i + 1
        i += 1
    i = max(i, start + 1)
    _markdown_inline(parent.add("para"), "\n".join(lines[start:i]), references)
    return i


def _markdown_list(lines: list[str], i: int, parent: Node, todo: list) -> int:
    first = _marker.match(lines[i])
    family = first[2][-1] if first[2][-1] in ".)" else first[2]
    here = parent.add("list", level=int(first[2] not in "-*+"))
    n = len(lines)
    while i < n and (m := _marker.match(lines[i])) and len(m[1]) < len(first[1]) + 4 and (m[2][-1] if m[2][-1] in ".)" else m[2]) == family and not _rule.match(lines[i]):
        base = len(m[1])
        content = base + len(m[2]) + (len(m[3]) if len(m[3]) <= 4 else 1)
        inner, i, blank = [lines[i][m.end() :]], i + 1, False
        while i < n:
            line = lines[i]
            if not line.strip():
                blank = True
                inner.append("")
                i += 1
                continue
            deep = _indent(line)
            if deep >= content or deep > base and deep >= 2 and (_marker.match(line) or not blank):
                inner.append(line[min(content, deep) :])
            elif blank or _starts_block(line):
                break
            else:
                inner.append(line)  # a lazy line of the paragraph
            blank = False
            i += 1
        item = here.add("item")
        if len(inner) == 1:  # markers behind one another on a line: lists within lists, taken at once
            rest, at = inner[0], 0
            signs = len(rest.rstrip(" \t-*_"))  # only from here on can it be a rule
            while (m := _marker.match(rest, at)) and not (at >= signs and _rule.match(rest, at)):
                item, at = item.add("list", level=int(m[2] not in "-*+")).add("item"), m.end()
            todo.append(([rest[at:]], item))
            continue
        # a nested list needs no blank line before it within an item
        spaced = []
        for k, x in enumerate(inner):
            if k and inner[k - 1].strip() and _marker.match(x) and not _marker.match(inner[k - 1]) and _indent(x) < 4 and not (spaced and _indent(inner[k - 1]) >= 2):
                spaced.append("")
            spaced.append(x)
        todo.append((spaced, item))
    return i


def _markdown_html(lines: list[str], i: int, m: re.Match, parent: Node) -> int:
    """A block of HTML: to the end of its element, or to a blank line where that doesn't come."""
    name, start = m[2].lower(), i
    if m[1] or name in EMPTY:
        return i + 1
    text = "\n".join(lines[start:])
    depth, end = 0, None
    for t in re.finditer(rf"<(/?){name}(?=[\s/>])[^<>]*>", text, re.I):
        depth += -1 if t[1] else 1
        if depth <= 0:
            end = t.end()
            break
    if end is None:
        while i < len(lines) and lines[i].strip():
            i += 1
        read_html("\n".join(lines[start:i]), parent)
        return i
    read_html(text[:end], parent)
    i = start + text[:end].count("\n")
    rest = lines[i][len(text[:end].rsplit("\n", 1)[-1]) :]
    if rest.strip():
        lines[i] = rest
        return i
    return i + 1


_md_literal = re.compile(r"\\([!-/:-@\[-`{-~])|\\\n|(?<!`)(`+)(?!`)(.+?)(?<!`)\2(?!`)|<!--.*?-->|\$\$(.+?)\$\$|\$(?=[^\s$])((?:[^$\\\n]|\\.|\n(?!\s*\n))*?)(?<=[^\s\\])\$(?!\d)|<(https?://[^\s<>]+)>|</?([A-Za-z][A-Za-z0-9-]*)((?:\s[^<>]*)?/?)>", re.S)
_money = re.compile(r"\d[\d.,\s]*(?:$|[^\W\d_]{2,}|\s)")
_md_image = re.compile(r"!\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\]]*\])(?:\{[^{}]*\})?")
_md_link = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\](\((?:[^()]|\([^()]*\))*\)|\{[^{}]*\}|\[[^\]]*\])(?:\{[^{}]*\})?")
_md_strong = [
    (signs, re.compile(pattern, re.S))
    for signs, pattern in (
        ("***", r"(?<![\\*])\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*"),
        ("**", r"\*\*(?=\S)(.+?)(?<=\S)\*\*(?!\*)"),
        ("__", r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)"),
        ("*", r"\*(?=[^\s*])(.+?)(?<=[^\s*])\*"),
        ("_", r"(?<!\w)_(?=[^\s_])(.+?)(?<=[^\s_])_(?!\w)"),
        ("~~", r"~~(?=\S)(.+?)(?<=\S)~~"),
    )
]


_md_any = re.compile(r"[\\`<$\[*_~!&{]")
_md_foot = re.compile(r"\[\^[^\]\s]+\]")
_md_sums = re.compile(r"\d[\d.,]*\s+[^\W\d_]{2,}")
_md_span = re.compile(r"\{[.#:]|\{[\w-]+=")


def _markdown_inline(node: Node, text: str, references: set[str]) -> None:
    if not _md_any.search(text):
        node.text = squeeze(text)
        return
    kept = Kept()

    def literal(m: re.Match) -> str:
        if m[1]:
            return kept.put("sign", m[1])
        if m[0] == "\\\n":
            return "\n"
        if m[3] is not None:
            return kept.put("literal", m[3].strip() or m[3])
        if m[4] is not None:
            return kept.put("formula", squeeze(m[4]))
        if m[5] is not None:
            if _md_sums.match(m[5]) and "\\" not in m[5]:  # two sums of money
                return kept.put("sign", "$") + m[5] + kept.put("sign", "$")
            return kept.put("formula", squeeze(m[5]))
        if m[6]:
            return kept.put("link", m[6])
        if m[7] and (m[7].lower() in INLINE or m[7].lower() in BLOCKS):
            return ""
        return "" if m[0].startswith("<!--") else m[0]

    text = _md_literal.sub(literal, text)
    if "[" in text:
        text = _md_foot.sub("", text)
        text = _md_image.sub("", text)

        def link(m: re.Match) -> str:
            if m[2][0] == "[" and (m[2][1:-1] or m[1]).lower() not in references:
                return m[0]
            if m[2][0] == "{" and not _md_span.match(m[2]):
                return m[0]
            kept.links += len(squeeze(m[1])) if m[2][0] != "{" else 0
            return m[1]

        before = None
        while text != before:  # links within links, inner ones first
            before, text = text, _md_link.sub(link, text)
    for signs, pattern in _md_strong:
        if signs in text:
            text = pattern.sub(r"\1", text)
    node.text, node.linked = squeeze(kept.restore(html.unescape(text))), kept.links
    _formulas(node, text, kept)


# --- wiki -------------------------------------------------------------------------------------------------------------

_wiki_aside = re.compile(r"<!--.*?(?:-->|\Z)|<(nowiki|pre|syntaxhighlight|source|math|chem|ref|gallery|score|style|script)\b([^<>]*?)(?:/>|>(.*?)</\1\s*>)", re.S | re.I)


_braces = re.compile(r"\{\{|\}\}")
_named = re.compile(r"\s*\w+\s*=")
_table_opens, _table_ends = re.compile(r"[ :]*\{\|"), re.compile(r"[ ]*\|\}")


def _template(inner: str) -> str:
    """What a template prints: its values if it is a quotation, else nothing."""
    name, *parts = inner.split("|")
    quotes = name.strip().lower() in ("quote", "blockquote", "cquote", "citation", "lang")
    return "\n\n" + "\n".join(p.split("=", 1)[-1] if _named.match(p) else p for p in parts) + "\n\n" if quotes else ""


def _templates(text: str) -> str:
    """The text with its templates, inner ones first, however deep, in one pass; braces without a partner stay."""
    stack: list[list[str]] = [[]]
    at = 0
    for m in _braces.finditer(text):
        stack[-1].append(text[at : m.start()])
        at = m.end()
        if m[0] == "{{":
            stack.append([])
        elif len(stack) > 1:
            inner = "".join(stack.pop())
            stack[-1].append(_template(inner))
        else:
            stack[-1].append("}}")
    stack[-1].append(text[at:])
    return "{{".join("".join(part) for part in stack)


def _without_tables(text: str) -> str:
    """The text without tables, nested ones included; one that isn't closed stays."""
    if "{|" not in text:
        return text
    lines, opened, gone = text.split("\n"), [], []
    for i, line in enumerate(lines):
        if _table_opens.match(line):
            opened.append(i)
        elif opened and (m := _table_ends.match(line)):
            gone.append((opened.pop(), i, m.end()))
    for first, last, end in sorted(gone, reverse=True):
        if last < len(lines):
            lines[first : last + 1] = [lines[last][end:]]
    return "\n".join(lines)


def read_wiki(text: str, root: Node) -> None:
    kept = Kept()

    def aside(m: re.Match) -> str:
        name = (m[1] or "").lower()
        inner = m[3] or ""
        if name == "nowiki":
            return kept.put("sign", html.unescape(inner))
        if name in ("pre", "syntaxhighlight", "source"):
            if "inline" in (m[2] or ""):
                return kept.put("literal", inner)
            return "\n" + kept.put("code", html.unescape(inner) if name == "pre" else inner) + "\n"
        if name in ("math", "chem"):
            return kept.put("formula", squeeze(html.unescape(inner)))
        if name == "ref":
            return kept.put("hidden", "") + "".join(_wiki_aside.sub(aside, inner) and "" for _ in (0,))
        return ""

    text = _wiki_aside.sub(aside, text)
    for kind, tex in kept.items:
        if kind == "formula":
            root.add("note").add("formula", tex)  # also those in notes, templates and tables, which print elsewhere
    text = _without_tables(_templates(text) if "{{" in text else text)
    para: list[str] = []
    levels: list[Node] = []

    def flush() -> None:
        nonlocal para
        if para:
            _wiki_inline(root.add("para"), "\n".join(para), kept)
        para = []

    for line in text.split("\n"):
        if m := re.fullmatch(r"(={1,6})(.+?)\1\s*(?:\ue000\d+\ue001\s*)*", line):
            flush()
            levels = []
            _wiki_inline(root.add("heading", level=len(m[1])), m[2], kept)
        elif m := re.match(r"([*#:;]+)\s*(.*)$", line):
            flush()
            prefix = m[1]
            if prefix[-1] in "*#":
                deep = sum(c in "*#" for c in prefix)
                del levels[deep:]
                while len(levels) < deep:
                    above = levels[-1].children[-1] if levels and levels[-1].children else root
                    levels.append(above.add("list", level=int(prefix[-1] == "#")))
                _wiki_inline(levels[-1].add("item").add("para"), m[2], kept)
            else:
                levels = []
                _wiki_inline(root.add("para"), m[2], kept)
        elif not line.strip():
            flush()
            levels = []
        elif line.startswith(" ") and not para and not kept.inside(line):
            levels = []
            if root.children and root.children[-1].kind == "code" and root.children[-1].level == -1:
                root.children[-1].text += "\n" + line[1:]
            else:
                root.add("code", line[1:], level=-1)
        elif (inside := kept.inside(line)) and inside[0][0] == "code" and re.fullmatch("\\s*\ue000\\d+\ue001\\s*", line):
            flush()
            levels = []
            root.add("code", inside[0][1].strip("\n"))
        else:
            levels = []
            para.append(line)
    flush()


def _wiki_inline(node: Node, text: str, kept: Kept) -> None:
    text = re.sub(r"\[\[(?:File|Image|Fichier|Category|Catégorie)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "", text, flags=re.I)
    links = 0

    def inner(m: re.Match) -> str:
        nonlocal links
        shown = m[1].split("|", 1)[-1]
        links += len(shown)
        return shown

    text = re.sub(r"\[\[([^\[\]]*)\]\]", inner, text)
    text = re.sub(r"\[(?:https?|ftp|mailto):[^\s\]]*\s*([^\]]*)\]", inner, text)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"</?(?:" + "|".join([*INLINE, *BLOCKS, "references", "blockquote"]) + r")\b[^<>]*>", lambda m: "\n" if m[0].startswith("<br") else "", text, flags=re.I)
    text = re.sub(r"__[A-Z]+__", "", text)
    node.text, node.linked = squeeze(kept.restore(html.unescape(text))), links


# --- LaTeX ------------------------------------------------------------------------------------------------------------

_tex_code = re.compile(r"\\begin\{(" + "|".join(map(re.escape, TEX_CODE)) + r")\}(?:\[[^\]]*\])?(?:(?<=\{minted\})\{[^}]*\})?(.*?)\\end\{\1\}|\\(?:verb|lstinline)\*?([^\sA-Za-z*{\[])(.*?)\3|\\begin\{comment\}.*?\\end\{comment\}|\\iffalse\b.*?\\fi\b|(?<!\\)((?:\\\\)*)%[^\n]*(?:\n[ \t]*(?=\S))?", re.S)
_tex_math = re.compile(r"\\begin\{(" + "|".join(map(re.escape, TEX_MATH)) + r")\}(.*?)\\end\{\1\}|(?<!\\)\$\$(.+?)(?<!\\)\$\$|(?<!\\)\$((?:[^$\\]|\\.)+?)\$|(?<!\\)\\\((.+?)(?<!\\)\\\)|(?<!\\)\\\[(.+?)(?<!\\)\\\]", re.S)
_tex_event = re.compile(r"\n[ \t]*\n\s*|\\begin\{([A-Za-z]+\*?)\}((?:\[[^\]]*\]|\{[^{}]*\})*)|\\end\{([A-Za-z]+\*?)\}|\\item\b\s*(\[[^\]]*\])?|\\(" + "|".join(sorted(TEX_SECTIONS, key=len, reverse=True)) + r")\*?\s*(?:\[[^\]]*\])?\s*(?=\{)|\\(caption)\s*(?:\[[^\]]*\])?\s*(?=\{)|\ue000\d+\ue001|\\(?:par|newpage|clearpage|hrule|maketitle|tableofcontents|medskip|bigskip|smallskip)\b")


_tex_brace = re.compile(r"\\.|[{}]", re.S)


def _braced(text: str, at: int) -> int:
    """Where the group that opens at `at` ends, behind its brace."""
    depth = 0
    for m in _tex_brace.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return m.end()
    return len(text)


def read_latex(text: str, root: Node) -> None:
    kept = Kept()

    def code(m: re.Match) -> str:
        if m[1]:
            return kept.put("code", m[2].strip("\n"))
        if m[3]:
            return kept.put("literal", m[4])
        return m[5] or ""

    text = _tex_code.sub(code, text)
    text = _tex_math.sub(lambda m: kept.put("formula", squeeze(next(x for x in (m[2], m[3], m[4], m[5], m[6], "") if x is not None))), text)
    if m := re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.S):
        text = m[1]
    for kind, tex in kept.inside(text):
        if kind == "formula":
            root.add("note").add("formula", tex)
    stack: list[tuple[str, Node]] = [("", root)]
    pieces: list[str] = []

    def flush() -> None:
        nonlocal pieces
        raw = "".join(pieces)
        pieces = []
        if raw.strip():
            _latex_inline(stack[-1][1].add("para"), raw, kept)

    def leave_item() -> None:
        if stack[-1][0] == "item":
            stack.pop()

    at = skip = 0
    for m in _tex_event.finditer(text):
        if m.start() < skip:
            continue
        pieces.append(text[at : m.start()])
        at = skip = m.end()
        if m[0][0] == "\ue000":
            kind, value = kept.inside(m[0])[0]
            if kind == "code":
                flush()
                stack[-1][1].add("code", value)
            else:
                pieces.append(m[0])
            continue
        if m[5] or m[6]:
            end = _braced(text, m.end())
            inner = text[m.end() + 1 : end - 1]
            at = skip = end
            flush()
            if m[5]:
                while len(stack) > 1 and stack[-1][0] in ("item", *TEX_LISTS):
                    stack.pop()
                _latex_inline(stack[-1][1].add("heading", level=TEX_SECTIONS.index(m[5]) + 1), inner, kept)
            else:
                _latex_inline(stack[-1][1].add("para"), inner, kept)
            continue
        flush()
        if m[1] in TEX_LISTS:
            stack.append((m[1], stack[-1][1].add("list", level=int(m[1] == "enumerate"))))
        elif m[1]:
            name = "quote" if m[1] in ("quote", "quotation", "verse") else "table" if m[1].startswith(("tabular", "longtable", "array")) else "para"
            stack.append((m[1], stack[-1][1].add("box" if name == "para" else name)))
        elif m[3]:
            if m[3] in TEX_LISTS:
                leave_item()
            if any(name == m[3] for name, _ in stack):
                while stack[-1][0] != m[3]:
                    stack.pop()
                stack.pop()
        elif m[0].startswith("\\item"):
            leave_item()
            if stack[-1][0] in TEX_LISTS:
                stack.append(("item", stack[-1][1].add("item")))
                if m[4]:
                    pieces.append(m[4][1:-1] + " ")
    pieces.append(text[at:])
    flush()


_tex_command = re.compile(r"\\([A-Za-z]+)\*?|\\(.)|[{}~]|``|''|---?|\[[^\[\]]*\](?=\{)", re.S)


_tex_behind = re.compile(r"[ \t]*(?:\[[^\]]*\])?(?=\{)|[ \t]+")
_tex_gap = re.compile(r"\{\}|[ \t]*\n?[ \t]*")
_tex_letter = re.compile(r"\s*(?:\{\s*(\\?[A-Za-z])\s*\}|(\\[ij])(?![A-Za-z])\s?|([A-Za-z]))")


def _latex_inline(node: Node, text: str, kept: Kept) -> None:
    links = 0

    def plain(text: str) -> str:
        nonlocal links
        out, at = [], 0
        while m := _tex_command.search(text, at):
            out.append(text[at : m.start()])
            at = m.end()
            name = m[1]
            if name is None and m[2] is None:
                out.append({"{": "", "}": "", "~": " ", "``": "“", "''": "”", "--": "–", "---": "—"}.get(m[0], m[0]))
                continue
            accent = name if name in TEX_ACCENTS else m[2] if m[2] in TEX_ACCENTS else None
            if accent and (a := _tex_letter.match(text, at)) and (m[2] or text[at : at + 1] in "{ "):
                base = (a[1] or a[2] or a[3]).lstrip("\\")
                out.append(unicodedata.normalize("NFC", base + TEX_ACCENTS[accent]))
                at = a.end()
            elif name in TEX_DROPPED:
                while at < len(text) and text[at] in "[{":
                    at = _braced(text, at) if text[at] == "{" else max(at + 1, text.find("]", at) + 1)
            elif name == "href" and text[at : at + 1] == "{":
                at = _braced(text, at)
                if text[at : at + 1] == "{":  # what the link shows is read on
                    links += _braced(text, at) - at - 2
            elif name in TEX_SIGNS:
                out.append(TEX_SIGNS[name])
                at = _tex_gap.match(text, at).end()
            elif name is not None:  # the command goes, its argument stays
                at = a.end() if (a := _tex_behind.match(text, at)) else at
            elif m[2] in "\\\n ":
                out.append(" ")
            elif m[2] in ",;:!/-@":
                out.append(" " if m[2] in ",;:" else "")
            else:
                out.append(m[2])
        out.append(text[at:])
        return "".join(out)

    node.text = squeeze(kept.restore(plain(text)))
    node.linked = links


# --- dialects, scoring, output ----------------------------------------------------------------------------------------

#: Every alternative begins with a sign of its own (a line with the line end before it), so that the search jumps from one to the next.
_signs = {
    "html": re.compile(r"<(?:!DOCTYPE|html|body|p|div|ul|ol|li|blockquote|table)\b[^<>]*>|</(?:p|div|ul|ol|li|blockquote|h[1-6]|em|strong|span)>", re.I),
    "latex": re.compile(r"\\(?:documentclass|begin\{|end\{|(?:sub)*section\*?\{|chapter\*?\{|paragraph\{|emph\{|textbf\{|underline\{|texttt\{|href\{|item\b|footnote\{|usepackage)"),
    "wiki": re.compile(r"\n={1,6}[^=\n][^\n]*=[ \t]*(?=\n)|'{2,3}(?=\S)|\[\[|\{\{|\n\{\||<(?:math|nowiki|syntaxhighlight|ref)\b|\[https?://\S+ |\n[*#]+[^\s*#]"),
    "markdown": re.compile(r"\n#{1,6} |\]\(|\]\{\.|\n(?:```|~~~)|\n> |\*\*\S|\n\|[-: |]+\|(?=\n)|\n\[\^|\n(?:=+|-{3,})(?=\n)|\n *(?:[-+]|\d+[.)]) +\S|[_*](?<!\w[_*])(?=\w)[^_*\n]+(?<=\w)[_*](?!\w)|\n:::"),
}
_strong_sign = {"html": re.compile(r"\n[ \t]*<(?:!DOCTYPE\s+html|html\b)", re.I), "latex": re.compile(r"\n[ \t]*\\(?:documentclass|begin\{document\})")}
_shown_code = re.compile(r"\n(```|~~~).*?\n\1|<pre\b.*?</pre>|<syntaxhighlight\b.*?</syntaxhighlight>|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\2\}", re.S)
_no_html = re.compile(r"\n(?:#{1,6} |> |```|~~~|- |\+ |\d+[.)] )|\]\(http|\]\{\.|\*\*\w")
READERS = {"html": read_html, "latex": read_latex, "wiki": read_wiki, "markdown": read_markdown}


def dialect(text: str) -> str:
    """The markup language of a text: the one whose document begins on any of its lines, else the one whose signs it has most
    of, code blocks left out; markdown, to which unmarked text is plain, without any. The whole text is looked at."""
    bare = _shown_code.sub("", f"\n{text}\n")
    tagged, commands = "<" in bare, "\\" in bare
    if tagged and _strong_sign["html"].search(bare):
        return "html"
    if commands and _strong_sign["latex"].search(bare):
        return "latex"
    counts = {name: len(sign.findall(bare)) if (name != "html" or tagged) and (name != "latex" or commands) else 0 for name, sign in _signs.items()}
    if counts["html"] and _no_html.search(bare):
        counts["html"] = counts["html"] // 4  # Markdown may hold any HTML; HTML holds no Markdown
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else "markdown"


def read(text: str | None) -> Node:
    """The tree of a text. Null, empty and blank texts give a root without children."""
    root = Node("root")
    if text and not text.isspace():
        text = _own(text)
        READERS[dialect(text)](text, root)
    return root


def score(root: Node) -> tuple[Node, list[tuple[Node, int]]]:
    """The best container, and all nodes from the top down with the number of the node above (-1 for the root).

    A paragraph's points (one, its commas, its hundreds of signs up to three) go whole to the nearest container above, by half to
    the next, and so on. A container's score is its points times the part of its text outside links; so is a list's, which
    can be dropped but not chosen. Node.level of a container is its link density in thousandths."""
    order: list[tuple[Node, int]] = [(root, -1)]
    for i, (node, _) in enumerate(order):  # grows on the way
        order += [(c, i) for c in node.children]
    points, size, linked = [0.0] * len(order), [0] * len(order), [0] * len(order)
    best = root
    for i in range(len(order) - 1, -1, -1):
        node, above = order[i]
        text = node.text
        size[i] += len(text)
        linked[i] += node.linked
        inner = node.kind in ("root", "box")
        if text and not inner:
            points[i] += 1 + text.count(",") + text.count("，") + min(3, len(text) // 100)
        if inner or node.kind == "list":
            density = min(1.0, linked[i] / size[i]) if size[i] else 0.0
            node.score = points[i] * (1 - density)
            if inner:
                node.level = int(1000 * density)
                if node.score >= best.score or best is root:
                    best = node
        if above >= 0:
            points[above] += points[i] / 2 if inner else points[i]
            size[above] += size[i]
            linked[above] += linked[i]
    return best, order


def main_content(root: Node, scoring: bool = True) -> Node:
    """The best container with those of its siblings, of the siblings of the containers around it, and of what is nested in it that
    belong to the content, as a tree below the root.

    Headings, code, formulas and paragraphs belong to it. A container or a list is left out if most of its text is links and its
    score is below SIBLING_SHARE of the best: navigation, sidebars and link lists. The way from the root to the best is kept.
    A text without links has no navigation and is kept whole."""
    if not scoring or not any(n.linked for n in root.walk()):
        return root
    best, order = score(root)
    at = next(i for i, (n, _) in enumerate(order) if n is best)
    way = {-1}
    while at >= 0:
        way.add(at)
        at = order[at][1]
    for i in range(len(order) - 1, 0, -1):
        node, above = order[i]
        if node.kind != "box" and (node.kind != "list" or len(node.children) < LEAST_ITEMS) or i in way:
            continue
        if node.score < SIBLING_SHARE * best.score and _links(node) > LINK_LIMIT:
            order[above][0].children = [c for c in order[above][0].children if c is not node]
    return root


def _links(node: Node) -> float:
    """The part of a container's or list's text that is links'."""
    size = linked = 0
    for n in node.walk():
        size, linked = size + len(n.text), linked + n.linked
    return linked / size if size else 0.0


def item_text(node: Node) -> str:
    """An item's own text, without the items nested in it."""
    parts, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.kind in ("list", "code") or n.kind == "formula":
            continue
        if n.text:
            parts.append(n.text)
        stack.extend(reversed(n.children))
    return squeeze(" ".join(parts))


def elements(text: str | None, scoring: bool = True) -> list[tuple[str, str]]:
    """Distinct (kind, content) of a text's main content: heading, list_item, code, formula; contents with single spaces, none empty."""
    out: dict[tuple[str, str], None] = {}
    for n in main_content(read(text), scoring).walk():
        if n.kind == "heading":
            found = ("heading", item_text(n))
        elif n.kind == "item":
            found = ("list_item", item_text(n))
        elif n.kind in ("code", "formula"):
            found = (n.kind, squeeze(n.text))
        else:
            continue
        if found[1]:
            out[found] = None
    return list(out)


def clean_text(text: str | None) -> str | None:
    """Plain text with headings as `# `, list items as `- `, code in fences and formulas between dollar signs; null for null."""
    if text is None:
        return None
    out: list[str] = []
    stack = [(main_content(read(text)), 0)]
    while stack:
        n, deep = stack.pop()
        if n.kind == "heading":
            out.append("#" * max(1, n.level) + " " + item_text(n))
        elif n.kind == "item":
            out.append("  " * max(0, deep - 1) + "- " + item_text(n))
            stack.extend((c, deep) for c in reversed(n.children) if c.kind in ("list", "code"))
        elif n.kind == "code":
            out.append("```\n" + n.text + "\n```")
        elif n.kind == "list":
            stack.extend((c, deep + 1) for c in reversed(n.children))
        elif n.kind == "note" and all(c.kind == "formula" for c in n.children):
            continue
        else:
            only = n.text and len(n.children) == 1 and n.children[0].kind == "formula" and n.children[0].text == n.text
            if n.text:
                out.append(f"$$ {n.text} $$" if only else n.text)
            stack.extend((c, deep) for c in reversed(n.children) if c.kind != "formula")
    return "\n\n".join(x for x in out if x.strip())


def _map(df: DataFrame, id_col: str, text_col: str, schema: str, rows) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        for batch in batches:
            ids, found = batch.column(0), rows(batch.column(1).to_pylist())
            at = pa.array([i for i, _ in found], pa.int32())
            columns = [ids.take(at), *(pa.array([x[k] for _, x in found], pa.string()) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")).mapInArrow(work, f"`{id_col}` {kind}, {schema}")


def markup_elements(df: DataFrame, id_col: str = "interior_id", text_col: str = "text") -> DataFrame:
    """(id_col, kind, content): the distinct headings, list items, code blocks and formulas of every row's text.

    Null, empty and unmarked texts have none. Rows are taken each by itself; a row delivered twice gives its elements
    once if id_col is unique otherwise. A null id is kept. Other columns are not read."""
    return _map(df, id_col, text_col, "kind string, content string", lambda texts: [(i, x) for i, t in enumerate(texts) for x in elements(t)]).distinct()


def markup_clean(df: DataFrame, id_col: str = "interior_id", text_col: str = "text") -> DataFrame:
    """(id_col, dialect, clean): every row's clean text; null for null, one row out for each row in."""

    def rows(texts):
        return [(i, (None if t is None else dialect(t), clean_text(t))) for i, t in enumerate(texts)]

    return _map(df, id_col, text_col, "dialect string, clean string", rows)
