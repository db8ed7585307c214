"""HTML: a symbol and a chunk for each structural element, loose text and comments,
scripts and styles as delegates.  Markup is cut as it stands; entities stay."""

from __future__ import annotations

import re
import textwrap
from collections import Counter
from html.parser import HTMLParser

from quillstrata.operators.parsers.base import Chunk, Limits, Parsed, Places, Symbol

#: Elements that make symbols, and those that have no end tag.
STRUCTURAL = frozenset("body head header footer section article aside main nav div p ul ol li table thead tbody tr td form fieldset legend figure figcaption details summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script": ("javascript", "inline_script"), "style": ("css", "inline_style")}


def tidy(markup: str) -> str:
    """Lines without trailing white space, without blank lines at either end."""
    return re.sub(r"\A\n+|\n+\Z", "", "\n".join(x.rstrip() for x in markup.split("\n")))


class _Walk(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.starts = text, [0, *(m.end() for m in re.finditer("\n", text))]
        self.open: list[tuple[str, int, int, dict]] = []
        self.depth: Counter[str] = Counter()  # open elements by tag
        self.elements: list[tuple[str, int, int, int, int, dict]] = []  # tag, start, inner start, inner end, end, attributes
        self.loose: list[tuple[str, int, int]] = []
        self.run: int | None = None
        self.feed(text)
        self.close()
        self.flush(len(text))
        while self.open:
            self.finish(len(text), len(text))

    def here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def flush(self, end: int) -> None:
        if self.run is not None:
            if not (self.open and self.open[-1][0] in RAW):
                self.loose.append(("text", self.run, end))
            self.run = None

    def finish(self, inner_end: int, end: int) -> None:
        tag, start, inner, attributes = self.open.pop()
        self.depth[tag] -= 1
        self.elements.append((tag, start, inner, inner_end, end, attributes))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self.here()
        self.flush(at)
        end = at + len(self.get_starttag_text() or "")
        if tag in VOID:
            return
        self.open.append((tag, at, end, dict(attrs)))
        self.depth[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        at = self.here()
        self.flush(at)
        if tag not in VOID:
            end = at + len(self.get_starttag_text() or "")
            self.elements.append((tag, at, end, end, end, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        at = self.here()
        self.flush(at)
        if self.depth[tag] > 0:
            close = self.text.find(">", at)
            end = len(self.text) if close < 0 else close + 1
            while self.open[-1][0] != tag:
                self.finish(at, at)
            self.finish(at, end)

    def _text(self) -> None:
        if self.run is None:
            self.run = self.here()

    def handle_data(self, data: str) -> None:
        self._text()

    def handle_entityref(self, name: str) -> None:
        self._text()

    def handle_charref(self, name: str) -> None:
        self._text()

    def handle_comment(self, data: str) -> None:
        at = self.here()
        self.flush(at)
        self.loose.append(("comment", at, min(len(self.text), at + len(data) + 7)))

    def handle_decl(self, decl: str) -> None:
        self.flush(self.here())


def parse(path: str, text: str, limits: Limits) -> Parsed:
    out, at, walk = Parsed(), Places(text), _Walk(text)
    whole = f"html:{path}::document"
    out.symbols.append(Symbol(whole, path, "document", 0, at.byte(len(text))))
    kept = sorted((e for e in walk.elements if e[0] in STRUCTURAL or e[0] in RAW), key=lambda e: (e[1], -e[4]))
    stack: list[tuple[int, int, str, str]] = []

    def owner(start: int, end: int) -> tuple[str, str | None]:
        while stack and stack[-1][1] <= start:
            stack.pop()
        return (stack[-1][2], stack[-1][3]) if stack else (whole, None)

    items = [(e[1], 0, e) for e in kept] + [(s, 1, (k, s, e)) for k, s, e in walk.loose if text[s:e].strip()]
    for part, (_, loose, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1]))):
        if loose:
            kind, start, end = item
            parent, _ = owner(start, end)
            out.chunks.append(Chunk(f"html:{kind}:{at.byte(start)}:{at.byte(end)}", " ".join(text[start:end].split()), at.byte(start), at.byte(end), part, parent, meta={"kind": kind, **at.span(start, end)}))
            continue
        tag, start, inner, inner_end, end, attributes = item
        parent, _ = owner(start, end)
        sid, cid = f"html:{path}::{tag}:{at.byte(start)}:{at.byte(end)}", f"html:{tag}:{at.byte(start)}:{at.byte(end)}"
        out.symbols.append(Symbol(sid, tag, "element", at.byte(start), at.byte(end), parent, meta={"attributes": attributes or None, "line": at.line(start)}))
        out.chunks.append(Chunk(cid, tidy(text[start:end]), at.byte(start), at.byte(end), part, sid, meta={"tag": tag, **at.span(start, end)}))
        if tag in RAW and text[inner:inner_end].strip():
            delegate, component = RAW[tag]
            code = textwrap.dedent(tidy(text[inner:inner_end]))
            if not limits.may_delegate(delegate):
                out.warnings.append(f"{tag} is kept inline: the {delegate} handler is disabled")
                out.chunks.append(
                    Chunk(f"html:{tag}:inline:{at.byte(inner)}:{at.byte(inner_end)}", code, at.byte(inner), at.byte(inner_end), part, sid, meta={"kind": tag, "delegate": delegate, "handler_enabled": False, **at.span(inner, inner_end)})
                )
                stack.append((start, end, sid, cid))
                continue
            out.chunks.append(
                Chunk(f"{delegate}:delegate:html:{component}:{at.byte(inner)}:{at.byte(inner_end)}", code, at.byte(inner), at.byte(inner_end), part, sid, delegate, cid,
                      {"delegate_parent_chunk": cid, "delegate_parent_symbol": sid, **at.span(inner, inner_end)})
            )
        stack.append((start, end, sid, cid))
    return out
