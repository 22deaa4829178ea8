"""Pages to rows: text, links, tables, metadata, structured data, Markdown, selection.

The standard library's parser builds a small tree; everything else reads that tree. One function
call per page gives all facts as one struct (``page_facts``), so a page is parsed once.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul body html".split())
HIDDEN = frozenset("script style noscript template head title".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead")}
_SCOPES = frozenset(("table", "ul", "ol", "dl", "select", "body", "html"))
_CLOSE_P = BLOCKS - frozenset(("li", "dt", "dd", "td", "th", "tr", "body", "html", "tbody", "thead", "tfoot"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find(self, *tags: str):
        return (n for n in self.walk() if n.tag in tags)

    def text(self) -> str:
        """All text, white space squeezed, blocks apart."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in HIDDEN or n is self:
                if n.tag in BLOCKS or n.tag == "br":
                    out.append(" ")
                    stack.append(" ")
                stack += reversed(n.children)
        return re.sub(r"\s+", " ", "".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def _leave(self, tags: tuple[str, ...]) -> None:
        n = self.at
        while n is not self.root and n.tag not in _SCOPES:
            if n.tag in tags:
                self.at = n.parent
                if n.tag != "td" and n.tag != "th":
                    return
            n = n.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS:
            self._leave(_ENDS[tag])
        elif tag in _CLOSE_P and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not self.root:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def parse(html: str | None) -> Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except AssertionError:  # malformed declarations
        pass
    return b.root


# ---------------------------------------------------------------- selection
_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


def _fits(n: Node, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m:
        raise ValueError(f"can't read the selector {step!r}")
    if m[1] and m[1] not in ("*", n.tag):
        return False
    for i, c, a, op, v in _PART.findall(m[2]):
        if i and n.attrs.get("id") != i or c and c not in n.attrs.get("class", "").split():
            return False
        if a:
            have = n.attrs.get(a)
            if have is None or op and not {"=": have == v, "~=": v in have.split(), "^=": have.startswith(v), "$=": have.endswith(v), "*=": v in have, "|=": have == v or have.startswith(v + "-")}[op]:
                return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements by a CSS selector: types, #ids, .classes, [attributes], descendants, ``>`` and commas."""
    out = []
    for part in selector.split(","):
        steps = re.sub(r"\s*>\s*", " > ", part.strip()).split()
        for n in root.walk():
            if n.tag != "#root" and _matches(n, steps) and n not in out:
                out.append(n)
    order = {id(n): i for i, n in enumerate(root.walk())}
    return sorted(out, key=lambda n: order[id(n)])


def _matches(n: Node, steps: list[str]) -> bool:
    if not steps:
        return True
    if not _fits(n, steps[-1]):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    p = n.parent
    if rest[-1] == ">":
        return p is not None and p.tag != "#root" and _matches(p, rest[:-1])
    while p is not None and p.tag != "#root":
        if _matches(p, rest):
            return True
        p = p.parent
    return False


def extract(html: str | None, fields: dict) -> dict:
    """Declared fields: ``{name: selector}`` or ``{name: {selector, attr, many}}``."""
    root, out = parse(html), {}
    for name, spec in fields.items():
        spec = {"selector": spec} if isinstance(spec, str) else spec
        nodes = select(root, spec["selector"])
        got = [n.attrs.get(spec["attr"]) if spec.get("attr") else n.text() for n in nodes]
        got = [g for g in got if g]
        out[name] = got if spec.get("many") else got[0] if got else None
    return out


# ---------------------------------------------------------------- facts
def title_of(root: Node) -> str | None:
    t = next(root.find("title"), None)
    return t.text() or None if t else None


def metadata(root: Node) -> dict[str, str]:
    """``meta`` names and properties (OpenGraph among them), canonical link, language of the page."""
    out: dict[str, str] = {}
    for m in root.find("meta"):
        name = m.attrs.get("property") or m.attrs.get("name") or m.attrs.get("itemprop")
        if name and m.attrs.get("content"):
            out.setdefault(name.lower(), m.attrs["content"].strip())
    for link in root.find("link"):
        if "canonical" in link.attrs.get("rel", "").lower().split() and link.attrs.get("href"):
            out.setdefault("canonical", link.attrs["href"])
    top = next(root.find("html"), None)
    if top and top.attrs.get("lang"):
        out.setdefault("lang", top.attrs["lang"])
    return out


def links(root: Node, base: str | None = None) -> list[dict]:
    """``href`` (absolute, without a fragment), text, rel and whether it stands in a navigation part."""
    b = next((n.attrs["href"] for n in root.find("base") if n.attrs.get("href")), None)
    base = urljoin(base or "", b) if b else base
    out = []
    for a in root.find("a"):
        href = a.attrs.get("href", "").strip()
        if not href or href.startswith(("javascript:", "mailto:", "tel:", "data:", "#")):
            continue
        p, nav = a.parent, False
        while p is not None:
            nav = nav or p.tag in ("nav", "header", "footer", "aside")
            p = p.parent
        try:
            full = urljoin(base or "", href)
        except ValueError:
            continue
        out.append({"href": full.split("#")[0], "text": a.text(), "rel": a.attrs.get("rel", ""), "nav": nav})
    return out


def tables(root: Node) -> list[dict]:
    """Tables as ``headers`` and ``rows``, spans expanded, stacked header rows joined."""
    out = []
    for t in root.find("table"):
        grid: list[list[tuple[str, bool]]] = []
        held: dict[tuple[int, int], tuple[str, bool]] = {}
        rows = [r for r in t.find("tr") if next((p for p in _up(r) if p.tag == "table"), None) is t]
        for y, r in enumerate(rows):
            line, x = [], 0
            for c in [c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]:
                while (y, x) in held:
                    line.append(held.pop((y, x)))
                    x += 1
                cell = (c.text(), c.tag == "th")
                wide, high = (max(1, min(1000, int(m[0]))) if (m := re.match(r"\d+", c.attrs.get(k, ""))) else 1 for k in ("colspan", "rowspan"))
                for dx in range(wide):
                    line.append(cell)
                    for dy in range(1, high):
                        held[(y + dy, x + dx)] = cell
                x += wide
            while (y, x) in held:
                line.append(held.pop((y, x)))
                x += 1
            grid.append(line)
        n = 0
        while n < len(grid) and grid[n] and all(h for _, h in grid[n]):
            n += 1
        width = max((len(g) for g in grid), default=0)
        heads = [" ".join(dict.fromkeys(g[i][0] for g in grid[:n] if i < len(g) and g[i][0])) for i in range(width)]
        out.append({"headers": heads if n else [], "rows": [[c for c, _ in g] for g in grid[n:]]})
    return out


def _up(n: Node):
    while n.parent is not None:
        n = n.parent
        yield n


def json_ld(root: Node) -> list:
    """Objects of JSON-LD scripts, graphs flattened; unreadable ones left out."""
    out = []
    for s in root.find("script"):
        if s.attrs.get("type", "").lower() == "application/ld+json":
            try:
                got = json.loads("".join(c for c in s.children if isinstance(c, str)))
            except ValueError:
                continue
            for o in got if isinstance(got, list) else [got]:
                out += o["@graph"] if isinstance(o, dict) and isinstance(o.get("@graph"), list) else [o]
    return out


def microdata(root: Node) -> list[dict]:
    """Top items of microdata as nested objects."""

    def value(n: Node):
        if "itemscope" in n.attrs:
            return item(n)
        for a in ("content", "href", "src", "datetime", "value"):
            if n.attrs.get(a):
                return n.attrs[a]
        return n.text()

    def item(n: Node) -> dict:
        out: dict = {"@type": n.attrs.get("itemtype", "").rsplit("/", 1)[-1]}
        todo = list(reversed([c for c in n.children if isinstance(c, Node)]))
        while todo:
            c = todo.pop()
            if name := c.attrs.get("itemprop"):
                v = value(c)
                out[name] = v if name not in out else (out[name] if isinstance(out[name], list) else [out[name]]) + [v]
            if "itemscope" not in c.attrs:
                todo += reversed([x for x in c.children if isinstance(x, Node)])
        return out

    return [item(n) for n in root.walk() if "itemscope" in n.attrs and "itemprop" not in n.attrs]


def main_content(root: Node) -> Node:
    """``main`` or ``article``, else the element with most text outside links and navigation."""
    for tag in ("main", "article"):
        got = [n for n in root.find(tag) if len(n.text()) > 40]
        if got:
            return max(got, key=lambda n: len(n.text()))
    body = next(root.find("body"), root)
    best, top = body, 0.0
    for n in body.find("div", "section", "td", "body"):
        own = sum(len(c) if isinstance(c, str) else len(c.text()) for c in n.children if isinstance(c, str) or c.tag in ("p", "h1", "h2", "h3", "ul", "ol", "blockquote", "table", "pre", "b", "i", "em", "strong", "span", "a"))
        linked = sum(len(a.text()) for a in n.find("a"))
        if own - 1.5 * linked > top:
            best, top = n, own - 1.5 * linked
    return best


def markdown(root: Node) -> str:
    """Headings, paragraphs, lists, links, emphasis, code, quotes and tables as Markdown."""

    def inline(n) -> str:
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n)
        if n.tag in HIDDEN:
            return ""
        s = "".join(map(inline, n.children))
        if n.tag in ("strong", "b") and s.strip():
            return f"**{s.strip()}**"
        if n.tag in ("em", "i") and s.strip():
            return f"*{s.strip()}*"
        if n.tag == "code":
            return f"`{s.strip()}`"
        if n.tag == "a" and n.attrs.get("href"):
            return f"[{s.strip()}]({n.attrs['href']})"
        if n.tag == "img":
            return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})"
        return "\n" if n.tag == "br" else s

    out: list[str] = []

    def block(n: Node, depth: int, mark: str) -> None:
        run: list = []

        def flush() -> None:
            s = "".join(map(inline, run)).strip()
            run.clear()
            if s:
                out.append(mark + s)

        for c in n.children:
            if isinstance(c, str) or c.tag not in BLOCKS:
                run.append(c)
                continue
            flush()
            if c.tag in HIDDEN:
                continue
            if re.fullmatch(r"h[1-6]", c.tag):
                s = inline(c).strip()
                if s:
                    out.append("#" * int(c.tag[1]) + " " + s)
            elif c.tag in ("ul", "ol"):
                for i, li in enumerate(x for x in c.children if isinstance(x, Node) and x.tag == "li"):
                    before = len(out)
                    block(li, depth + 1, "")
                    if len(out) > before:
                        out[before] = "  " * depth + (f"{i + 1}. " if c.tag == "ol" else "- ") + out[before]
            elif c.tag == "blockquote":
                block(c, depth, mark + "> ")
            elif c.tag == "pre":
                out.append("```\n" + "".join(x if isinstance(x, str) else x.text() for x in c.children).strip("\n") + "\n```")
            elif c.tag == "table":
                for t in tables(c)[:1]:
                    heads = t["headers"] or (t["rows"][0] if t["rows"] else [])
                    rows = t["rows"] if t["headers"] else t["rows"][1:]
                    if heads:
                        out.append("\n".join(["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads), *["| " + " | ".join(r) + " |" for r in rows]]))
            elif c.tag == "hr":
                out.append("---")
            else:
                block(c, depth, mark)
        flush()

    block(root, 0, "")
    return "\n\n".join(out)


FACTS = "struct<title:string,text:string,h1:string,lang:string,canonical:string,description:string,links:array<struct<href:string,text:string,rel:string,nav:boolean>>,types:array<string>,words:bigint,tables:int>"


def _facts(html: str, url: str | None) -> dict:
    root = parse(html)
    meta = metadata(root)
    body = next(root.find("body"), root)
    text = body.text()
    h1 = next(root.find("h1"), None)
    types = [t for o in json_ld(root) if isinstance(o, dict) for t in (o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type")]) if t] + [m["@type"] for m in microdata(root) if m["@type"]]
    return {"title": title_of(root), "text": text, "h1": (h1.text() or None) if h1 else None, "lang": meta.get("lang"), "canonical": meta.get("canonical"), "description": meta.get("description") or meta.get("og:description"), "links": links(root, url), "types": types, "words": len(text.split()), "tables": sum(1 for _ in root.find("table"))}


def page_facts(html: Column, url: Column) -> Column:
    """``FACTS`` of a page, parsed once; null where there is no HTML."""

    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        rows = [_facts(x, y) if x else {} for x, y in zip(h, u)]
        names = ["title", "text", "h1", "lang", "canonical", "description", "links", "types", "words", "tables"]
        out = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})
        out["words"], out["tables"] = out["words"].astype("Int64"), out["tables"].astype("Int32")
        return out

    run.__annotations__ = {"h": pd.Series, "u": pd.Series, "return": pd.DataFrame}
    return F.when(html.isNotNull(), F.pandas_udf(run, FACTS)(html, url))


def _mapped(f, kind: str):
    def call(c: Column) -> Column:
        from loomspark.functions.columns import mapped

        return mapped(f, kind)(c)

    return call


html_text = _mapped(lambda h: next(parse(h).find("body"), parse(h)).text(), "string")
html_markdown = _mapped(lambda h: markdown(next(parse(h).find("body"), parse(h))), "string")
html_main = _mapped(lambda h: main_content(parse(h)).text(), "string")
html_tables = _mapped(lambda h: tables(parse(h)), "array<struct<headers:array<string>,rows:array<array<string>>>>")
html_json_ld = _mapped(lambda h: [json.dumps(o, ensure_ascii=False, sort_keys=True) for o in json_ld(parse(h))], "array<string>")
html_microdata = _mapped(lambda h: [json.dumps(o, ensure_ascii=False, sort_keys=True) for o in microdata(parse(h))], "array<string>")


def html_extract(c: Column, fields: dict) -> Column:
    """Declared fields as a struct of texts (lists of texts with ``many``)."""
    from loomspark.functions.columns import mapped

    kinds = ",".join(f"`{n}`:" + ("array<string>" if isinstance(s, dict) and s.get("many") else "string") for n, s in fields.items())
    return F.from_json(mapped(lambda h: json.dumps(extract(h, fields)), "string")(c), f"struct<{kinds}>")
