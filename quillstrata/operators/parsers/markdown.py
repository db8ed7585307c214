"""Markdown: front matter, a section for each heading, fenced code as delegates."""

from __future__ import annotations

import re
from bisect import bisect_right

from quillstrata.operators.parsers.base import Chunk, Limits, Parsed, Places, Symbol

FRONT = re.compile(r"\A---[ \t]*\n.*?\n---[^\n]*(?:\n|\Z)", re.S)
FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^ {0,3}\2[`~]*[ \t]*(?:\n|\Z)|\Z)", re.S | re.M)
HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", re.M)


def parse(path: str, text: str, limits: Limits) -> Parsed:
    out, at = Parsed(), Places(text)
    front = FRONT.match(text)
    body = front.end() if front else 0
    if front:
        out.chunks.append(Chunk("markdown:front-matter", front[0], 0, at.byte(body), meta=at.span(0, body)))
    fences = [m for m in FENCE.finditer(text, body)]
    opened = [m.start() for m in fences]

    def inside(i: int) -> bool:
        k = bisect_right(opened, i)
        return k > 0 and i < fences[k - 1].end()

    heads = [m for m in HEADING.finditer(text, body) if not inside(m.start())]
    stack: list[tuple[int, str]] = []
    ids = []
    for m in heads:
        level = len(m[1])
        while stack and stack[-1][0] >= level:
            stack.pop()
        sid = f"markdown:heading:{at.byte(m.start())}"
        out.symbols.append(Symbol(sid, m[2].strip(), "heading", at.byte(m.start()), at.byte(m.end()), stack[-1][1] if stack else None, meta={"level": level, "line": at.line(m.start())}))
        stack.append((level, sid))
        ids.append(sid)
    sections: list[tuple[int, int, str, str]] = []
    if not heads:
        if text[body:].strip():
            cid = f"markdown:body:{at.byte(body)}:{at.byte(len(text))}"
            out.chunks.append(Chunk(cid, text[body:], at.byte(body), at.byte(len(text)), meta=at.span(body, len(text))))
    else:
        intro = bool(text[body : heads[0].start()].strip())
        for i, m in enumerate(heads):
            start = body if i == 0 and intro else m.start()
            end = heads[i + 1].start() if i + 1 < len(heads) else len(text)
            cid = f"markdown:section:{at.byte(start)}:{at.byte(end)}"
            out.chunks.append(Chunk(cid, text[start:end], at.byte(start), at.byte(end), i, ids[i], meta={"title": m[2].strip(), "level": len(m[1]), "intro_attached": i == 0 and intro, **at.span(start, end)}))
            sections.append((start, end, ids[i], cid))
    begun = [s[0] for s in sections]
    for n, m in enumerate(fences):
        code = m[4]
        if not code.strip():
            continue
        start, end = m.start(4), m.end(4)
        k = bisect_right(begun, m.start())
        owner = sections[k - 1] if k and m.start() < sections[k - 1][1] else None
        words = m[3].split()
        language = words[0].lower() if words else None
        if language:
            cid = f"{language}:delegate:markdown:fenced_code:{at.byte(start)}:{at.byte(end)}:{n}"
            out.chunks.append(Chunk(cid, code, at.byte(start), at.byte(end), n, owner and owner[2], language, owner and owner[3], {"language": language, "delegate_parent_chunk": owner and owner[3], "delegate_parent_symbol": owner and owner[2], **at.span(start, end)}))
        else:
            out.chunks.append(Chunk(f"markdown:fence:{at.byte(start)}:{at.byte(end)}:{n}", code, at.byte(start), at.byte(end), n, owner and owner[2], meta=at.span(start, end)))
    return out
