"""CSS: rules, at-rules, keyframes, comments; selectors split where a rule is too long."""

from __future__ import annotations

import re

from quillstrata.operators.parsers.base import Chunk, Limits, Parsed, Places, Symbol

TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|[{};]", re.S)


def split_selectors(text: str) -> list[tuple[int, int]]:
    """Places of the selectors between commas outside brackets and strings."""
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append((start, i))
            start = i + 1
    out.append((start, len(text)))
    return [(s + len(text[s:e]) - len(text[s:e].lstrip()), s + len(text[s:e].rstrip())) for s, e in out if text[s:e].strip()]


def parse(path: str, text: str, limits: Limits) -> Parsed:
    out, at = Parsed(), Places(text)
    sheet = f"css:{path}::stylesheet"
    out.symbols.append(Symbol(sheet, path, "stylesheet", 0, at.byte(len(text))))
    part = 0

    def emit(kind: str, start: int, end: int, body: str, symbol: str, **meta: object) -> None:
        nonlocal part
        out.chunks.append(Chunk(f"css:{kind}:{at.byte(start)}:{at.byte(end)}", body, at.byte(start), at.byte(end), part, symbol, meta={**at.span(start, end), **meta}))
        part += 1

    def close(start: int, brace: int, end: int, parents: list[tuple[str, str]]) -> None:
        selector = text[start:brace].strip()
        kind = "keyframe" if parents and "keyframes" in parents[-1][0].split()[0] else "rule"
        sid = f"css:{path}::{kind}:{at.byte(start)}:{at.byte(end)}"
        cascade = [p[0] for p in parents]
        out.symbols.append(Symbol(sid, " ".join(selector.split()), kind, at.byte(start), at.byte(end), parents[-1][1] if parents else sheet, meta={"cascade": cascade or None}))
        body = text[start:end]
        names = split_selectors(text[start:brace])
        if kind == "rule" and limits.max_tokens is not None and limits.count(body) > limits.max_tokens and len(names) > 1:
            for s, e in names:
                emit("rule", start + s, start + e, f"{text[start + s : start + e]} {text[brace:end]}", sid, selector=text[start + s : start + e], overflow=True)
        else:
            emit(kind, start, end, body, sid, selector=" ".join(selector.split()))

    def block(i: int, end: int, parents: list[tuple[str, str]]) -> int:
        start = i
        while True:
            while start < end and text[start].isspace():
                start += 1
            i = max(i, start)
            m = TOKEN.search(text, i, end)
            if m is None:
                if text[start:end].strip():
                    emit("error", start, end, text[start:end], parents[-1][1] if parents else sheet)
                    out.warnings.append("a block is not closed")
                return end
            t = m[0]
            if t.startswith("/*"):
                if m.start() == start:
                    emit("comment", m.start(), m.end(), t, parents[-1][1] if parents else sheet)
                    start = m.end()
                i = m.end()
            elif t[0] in "\"'":
                i = m.end()
            elif t == "}":
                if text[start : m.start()].strip():
                    emit("error", start, m.start(), text[start : m.start()], parents[-1][1] if parents else sheet)
                return m.end()
            elif t == ";":
                if text[start] == "@":
                    sid = f"css:{path}::at:{at.byte(start)}:{at.byte(m.end())}"
                    out.symbols.append(Symbol(sid, text[start : m.start()].strip(), "at_rule", at.byte(start), at.byte(m.end()), parents[-1][1] if parents else sheet))
                    emit("at", start, m.end(), text[start : m.end()], sid)
                start = i = m.end()
            elif text[start] == "@" and nested(m.end(), end):
                name = " ".join(text[start : m.start()].split())
                where, known, chunks = len(out.symbols), sheet if not parents else parents[-1][1], m.start()
                sid = f"css:{path}::at:{at.byte(start)}"
                emit("at", start, chunks, text[start:chunks].rstrip(), sid, name=name)
                mark = len(out.chunks) - 1
                stop = block(m.end(), end, [*parents, (name, sid)])
                out.symbols.insert(where, Symbol(sid, name, "at_rule", at.byte(start), at.byte(stop), known))
                out.chunks[mark].meta["end_line"] = at.line(max(start, chunks - 1))
                start = i = stop
            else:
                stop = matching(m.end(), end)
                close(start, m.start(), stop, parents)
                start = i = stop

    def matching(i: int, end: int) -> int:
        depth = 1
        for m in TOKEN.finditer(text, i, end):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if not depth:
                return m.end()
        out.warnings.append("a block is not closed")
        return end

    def nested(i: int, end: int) -> bool:
        """Does an at-rule's block hold rules (rather than declarations)?"""
        for m in TOKEN.finditer(text, i, end):
            if m[0] in "{};":
                return m[0] == "{" or (m[0] == "}" and not text[i : m.start()].strip())
        return False

    block(0, len(text), [])
    return out
