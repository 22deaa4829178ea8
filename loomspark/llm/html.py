"""Blocks of a page from the events of the standard library's HTML parser."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

#: Tags that don't end a block.
INLINE = frozenset("a abbr b br code em i img small span strong sub sup u wbr".split())
#: Elements whose content is left out.
HIDDEN = frozenset("script style noscript template".split())
#: Elements whose content the parser reads in modes of its own.
_RAW = frozenset("script style title textarea plaintext xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag of the same kind closes, where their own end is left out.
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SPACE = re.compile(r"[ \t\r\n]+")


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


#: Tags in their usual spelling; all others go the way of the parser itself. Attributes aren't needed.
_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)(?:\s+[a-zA-Z-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>=`]+))?)*\s*>""")
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)\s*>")


@dataclass(slots=True)
class Block:
    """One block: its text, the innermost element, and what its lines need.

    ``path`` has the tags of the open elements; ``tags`` counts the tags since the block before; ``linked`` the characters within links, ``spanned``
    those other than white space within span elements, of which there are ``spans``.
    """

    text: str
    path: tuple
    tags: int
    linked: int
    spanned: int
    spans: int


class BlockParser(HTMLParser):
    """Collects the blocks of one page; reading never fails, whatever the markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.title = ""
        self._stack: list[str] = []
        self._path: tuple = ()
        self._tags = self._linked = self._in_link = self._spans = self._spanned = self._in_span = 0
        self._hidden: list[str] = []
        self._buffer: list[str] = []
        self._body = self._in_title = False
        self._head = False

    def updatepos(self, i: int, j: int) -> int:  # line numbers aren't needed
        return j

    def parse_starttag(self, i: int) -> int:
        m = _START.match(self.rawdata, i)
        if m is None or (tag := m[1].lower()) in _RAW:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [])
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = None if self.cdata_elem else _END.match(self.rawdata, i)
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def _flush(self) -> None:
        if self._buffer:
            text = squeeze("".join(self._buffer))
            self._buffer.clear()
            if text:
                self.blocks.append(Block(text, self._path, self._tags, min(self._linked, len(text)), self._spanned, self._spans))
                self._tags = 0
        self._linked = self._spanned = self._spans = 0

    def _close_to(self, at: int) -> None:
        del self._stack[at:]
        self._path = tuple(self._stack)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tags += 1
        if tag in INLINE:
            if tag == "a":
                self._in_link = 1
            elif tag == "span":
                self._in_span = 1
                self._spans += 1
            return
        self._flush()
        if self._hidden:
            if tag == self._hidden[-1]:
                self._hidden.append(tag)
            return
        if tag in HIDDEN:
            self._hidden.append(tag)
            return
        if tag == "head":
            self._head = True
        elif tag == "body":
            self._body, self._head = True, False
        elif tag == "title" and not self._body:
            self._in_title = True
        elif not self._body and tag not in ("html", "meta", "link", "base"):
            self._body, self._head = True, False
        if tag in VOID or tag in ("html", "head", "body"):
            return
        stack = self._stack
        if tag in _CLOSES:
            shut = _CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in shut:
                    self._close_to(i)
                    if tag != "tr":
                        break
                elif stack[i] in ("ul", "ol", "table", "dl", "div", "section"):
                    break
        if tag in _ENDS_P and stack and stack[-1] == "p":
            self._close_to(len(stack) - 1)
        stack.append(tag)
        self._path = tuple(stack)
        self._in_link = self._in_span = 0

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in INLINE:
            if tag == "a":
                self._in_link = 0
            elif tag == "span":
                self._in_span = 0
            return
        if self._hidden:
            if tag == self._hidden[-1]:
                self._hidden.pop()
            self._flush()
            return
        self._flush()
        if tag == "title":
            self._in_title = False
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i] == tag:
                self._close_to(i)
                break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self._hidden:
            return
        if self._in_title:
            self.title += data
        elif self._body or (not self._head and data.strip()):
            self._body = True
            self._buffer.append(data)
            if self._in_link:
                self._linked += len(data)
            if self._in_span:
                self._spanned += len("".join(data.split()))

    def unknown_decl(self, data: str) -> None:
        pass


def page_blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order; none of a null or empty page."""
    return parse_page(html)[0]


def parse_page(html: str | None) -> tuple[list[Block], str]:
    """The blocks of a page, and its title."""
    if not html:
        return [], ""
    p = BlockParser()
    try:
        p.feed(html)
        p.close()
    except AssertionError:  # malformed declarations
        pass
    p._flush()
    return p.blocks, squeeze(p.title)
