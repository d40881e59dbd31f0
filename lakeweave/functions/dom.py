"""A light tree of an HTML page, built by one tolerant pass without recursion. Used inside vectorised helpers."""

from __future__ import annotations

import html as escapes
import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    __slots__ = ("attrs", "kids", "nth", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str | None] | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.kids: list[Node] = []
        self.parent: Node | None = None
        self.nth = 0

    def add(self, kid: Node) -> None:
        kid.parent = self
        self.kids.append(kid)

    def put(self, *new: Node) -> None:
        """Take this node's place."""
        if self.parent is not None:
            at = self.parent.kids.index(self)
            for n in new:
                n.parent = self.parent
            self.parent.kids[at : at + 1] = new
            self.parent = None

    def walk(self) -> list[Node]:
        """This node and all below it, in document order."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append(n)
            stack.extend(reversed(n.kids))
        return out

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, dict(attrs))
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].add(Node(None, text=data))

    def handle_comment(self, data: str) -> None:
        self.open[-1].add(Node(None))  # without text, but it parts what stands around it


def parse(page: str | None) -> Node:
    """Tree of a page; whatever the markup, there is one. Elements end at their end tags and at those of elements around them, never before."""
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def serialize(root: Node, inner: bool = False) -> str:
    """HTML of a node, or of what is in it. Comments and declarations are gone."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(root.kids)) if inner or root.tag == "" else [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            raw = n.parent is not None and n.parent.tag in ("script", "style")
            out.append(n.text if raw else escapes.escape(n.text, quote=False))
        else:
            out.append("<" + n.tag + "".join(f" {k}" if v is None else f' {k}="{escapes.escape(v)}"' for k, v in n.attrs.items()) + ">")
            if n.tag not in VOID:
                stack.append(f"</{n.tag}>")
                stack.extend(reversed(n.kids))
    return "".join(out)


def drop(root: Node, tags: tuple[str, ...]) -> Node:
    for n in root.all(*tags):
        n.put()
    return root


def text_of(root: Node) -> str:
    """Visible text, white space collapsed."""
    hidden: set[int] = set()
    out = []
    for n in root.walk():
        if n.tag in ("script", "style", "noscript", "template", "head") or (n.parent is not None and id(n.parent) in hidden):
            hidden.add(id(n))
        elif n.tag is None:
            out.append(n.text)
    return " ".join(" ".join(out).split())


# --- Markdown -------------------------------------------------------------------------------

#: What a node may stand in: preformatted text, code of any kind, a heading or a table cell (one line), a list item.
PRE, CODE, LINE, ITEM = 1, 2, 4, 8
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: White space just inside these, and outside them, says nothing.
SOLID = {*HEADINGS, "p", "blockquote", "article", "div", "section", "ol", "ul", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th"}
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "sub": "", "sup": ""}
BULLETS = "*+-"
BLANK = " \t\r\n"
BREAKS, GAPS, SPACES = re.compile(r"[ \t\r\n]*[\r\n][ \t\r\n]*"), re.compile(r"[\t ]+"), re.compile(r"[\t\r\n ]+")
LINES = re.compile(r"^(.*)", re.MULTILINE)


def _within(n: Node) -> int:
    """What the children of a node stand in on its account."""
    return PRE * (n.tag == "pre") | CODE * (n.tag in ("pre", "code", "kbd", "samp")) | LINE * (n.tag in HEADINGS or n.tag in ("td", "th")) | ITEM * (n.tag == "li")


def _solid(n: Node | None, outside: bool = False) -> bool:
    return n is not None and (n.tag in SOLID or (outside and n.tag == "pre"))


def _plain_text(n: Node, before: Node | None, after: Node | None, place: int) -> str:
    """A text between two siblings: white space runs become one sign, signs with a meaning are escaped."""
    text = n.text
    edge = _solid(n.parent)
    if not text.strip() and ((edge and (before is None or after is None)) or _solid(before, True) or _solid(after, True)):
        return ""
    if not place & PRE:
        text = GAPS.sub(" ", BREAKS.sub("\n", text))
    if not place & CODE:
        text = text.replace("*", "\\*").replace("_", "\\_")
    if _solid(before, True) or (edge and before is None):
        text = text.lstrip(BLANK)
    if _solid(after, True) or (edge and after is None):
        text = text.rstrip()
    return text


def _side_by_side(parts: list[str]) -> str:
    """Children's texts; where line ends of two meet, the larger number stays, two at most."""
    out, ends = [], 0
    for part in parts:
        core = part.strip("\n")
        begins = len(part) - len(part.lstrip("\n"))
        out.append("\n" * (min(2, max(ends, begins)) if ends and begins else ends + begins))
        out.append(core)
        ends = len(part) - len(part.rstrip("\n")) if core else 0
    return "".join(out) + "\n" * ends


def _marked(text: str, mark: str, wide: str = "") -> str:
    """The text between marks; one space at either end stays outside."""
    core = text.strip()
    return f"{' ' * text.startswith(' ')}{mark}{wide}{core}{wide}{mark}{' ' * text.endswith(' ')}" if core else ""


def _block(text: str, place: int) -> str:
    return f" {text} " if place & LINE else f"\n\n{text}\n\n" if text else ""


def _titled(url: str, n: Node) -> str:
    title = n.attrs.get("title")
    return url + (' "' + title.replace('"', '\\"') + '"' if title else "")


def _link(n: Node, text: str, place: int) -> str:
    core, href = text.strip(), n.attrs.get("href")
    if place & CODE:
        return text
    if not core:
        return ""
    if core.replace("\\_", "_") == href and not n.attrs.get("title"):
        return f"<{href}>"
    linked = f"[{core}]({_titled(href, n)})" if href else core
    return f"{' ' * text.startswith(' ')}{linked}{' ' * text.endswith(' ')}" if href else text


def _image(n: Node, text: str, place: int) -> str:
    alt = n.attrs.get("alt") or ""
    return alt if place & LINE else f"![{alt}]({_titled(n.attrs.get('src') or '', n)})"


def _video(n: Node, text: str, place: int) -> str:
    if place & LINE:
        return text
    src = n.attrs.get("src") or next((k.attrs["src"] for k in n.all("source") if k.attrs.get("src") is not None), "")
    poster = n.attrs.get("poster")
    still = f"![{text}]({poster})" if poster else text
    return f"[{still}]({src})" if src else still


def _code(n: Node, text: str, place: int) -> str:
    if place & CODE:
        return text
    longest = max(map(len, re.findall("`+", text)), default=0)
    return _marked(text, "`" * (longest + 1), " " * (longest > 0))


def _item(n: Node, text: str, place: int) -> str:
    text = text.strip()
    if not text:
        return "\n"
    if n.parent is not None and n.parent.tag == "ol":
        start = n.parent.attrs.get("start") or ""
        mark = f"{(int(start) if start.isdecimal() else 1) + n.nth}. "
    else:
        depth, up = -1, n
        while up is not None:
            depth += up.tag == "ul"
            up = up.parent
        mark = BULLETS[depth % len(BULLETS)] + " "
    return mark + _indented(text, " " * len(mark))[len(mark) :] + "\n"


def _indented(text: str, by: str, blank: str = "") -> str:
    return LINES.sub(lambda m: by + m[1] if m[1] else blank, text)


def _list(n: Node, text: str, place: int) -> str:
    if place & ITEM:
        return "\n" + text.rstrip()
    kids = n.parent.kids if n.parent is not None else [n]
    later = kids[next(i for i, k in enumerate(kids) if k is n) + 1 :]
    following = next((k for k in later if k.tag is not None or k.text.strip()), None)
    return "\n\n" + text + "\n" * (following is not None and following.tag not in ("ul", "ol"))


def _quote(n: Node, text: str, place: int) -> str:
    text = text.strip()
    if place & LINE:
        return f" {text} "
    return "\n" + _indented(text, "> ", ">") + "\n\n" if text else "\n"


def _definition(n: Node, text: str, place: int) -> str:
    text = text.strip()
    if place & LINE:
        return f" {text} "
    return ":" + _indented(text, "    ")[1:] + "\n" if text else "\n"


def _term(n: Node, text: str, place: int) -> str:
    text = SPACES.sub(" ", text.strip())
    if place & LINE:
        return f" {text} "
    return f"\n\n{text}\n" if text else "\n"


def _preformatted(n: Node, text: str, place: int) -> str:
    return "\n\n```\n" + re.sub(r"[ \n]*\Z", "", re.sub(r"\A[ \n]*\n", "", text)) + "\n```\n\n" if text else ""


def _span(n: Node) -> int:
    span = n.attrs.get("colspan") or ""
    return max(1, min(1000, int(span))) if span.isdigit() else 1


def _cell(n: Node, text: str, place: int) -> str:
    return " " + text.strip().replace("\n", " ") + " |" * _span(n)


def _row(n: Node, text: str, place: int) -> str:
    """A table row; the first one gets a rule below it where it is a heading, else an empty heading above it."""
    cells, up = n.all("td", "th"), n.parent
    width = sum(map(_span, cells))
    rule = "| " + " | ".join(["---"] * width) + " |\n"

    def leads(x: Node) -> bool:
        return x.parent is None or next(k for k in x.parent.kids if k.tag is not None) is x

    row, first = f"|{text}\n", leads(n)
    if first and (all(c.tag == "th" for c in cells) or (up.tag == "thead" and len(up.all("tr")) == 1)):
        return row + rule
    headless = up.tag != "tbody" or up.parent is None or not up.parent.all("thead") or leads(up)
    return "| " + " | ".join([""] * width) + " |\n" + rule + row if first and headless else row


WAYS = {
    "a": _link, "img": _image, "video": _video, "code": _code, "kbd": _code, "samp": _code, "li": _item, "ul": _list, "ol": _list, "blockquote": _quote, "dd": _definition, "dt": _term, "pre": _preformatted, "td": _cell, "th": _cell, "tr": _row,
    "br": lambda n, text, place: " " if place & LINE else "  \n",
    "hr": lambda n, text, place: "\n\n---\n\n",
    "q": lambda n, text, place: f'"{text}"',
    "p": lambda n, text, place: _block(text.strip(BLANK), place),
    "table": lambda n, text, place: "\n\n" + text.strip() + "\n\n",
    "caption": lambda n, text, place: text.strip() + "\n\n",
    "figcaption": lambda n, text, place: "\n\n" + text.strip() + "\n\n",
    **dict.fromkeys(("div", "article", "section", "dl"), lambda n, text, place: _block(text.strip(), place)),
    **dict.fromkeys(("script", "style"), lambda n, text, place: ""),
    **{h: lambda n, text, place: text if place & LINE else f"\n\n{'#' * int(n.tag[1])} {SPACES.sub(' ', text.strip())}\n\n" for h in HEADINGS},
    **{t: lambda n, text, place: text if place & CODE else _marked(text, MARKS[n.tag]) for t in MARKS},
}


def markdown(root: Node) -> str:
    """Markdown with ATX headings, escaped stars and underscores, ``<address>`` links and bullets by depth, by the rules of the public markdownify converter with its defaults. Children come before parents, so depth costs no stack."""
    nodes = root.walk()
    place = {id(root): 0}
    for n in nodes:
        inside, items = place[id(n)] | _within(n), 0
        for k in n.kids:
            place[id(k)], k.nth = inside, items
            items += k.tag == "li"
    done: dict[int, str] = {}
    for n in reversed(nodes):
        if n.tag is None:
            continue
        kids, parts = n.kids, []
        for i, k in enumerate(kids):
            text = done.pop(id(k)) if k.tag is not None else _plain_text(k, kids[i - 1] if i else None, kids[i + 1] if i + 1 < len(kids) else None, place[id(k)])
            if text:
                parts.append(text)
        text = "".join(parts) if n.tag == "pre" or place[id(n)] & PRE else _side_by_side(parts)
        way = WAYS.get(n.tag)
        done[id(n)] = way(n, text, place[id(n)]) if way else text
    return done[id(root)].strip("\n")
