"""JavaScript and TypeScript, by a scanner that knows strings, comments, templates and
brackets: modules, classes with methods and fields, functions, constants, types,
re-exports, and JSX as HTML delegates."""

from __future__ import annotations

import re
from bisect import bisect_left

from quillstrata.operators.parsers.base import Chunk, Limits, Parsed, Places, Symbol, split_lines
from quillstrata.operators.parsers.python import module_name

SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
DECLARE = re.compile(
    r"(?P<export>export\s+)?(?P<default>default\s+)?(?P<mods>(?:declare\s+|abstract\s+|async\s+)*)"
    r"(?:(?P<kind>class|function\*?|interface|enum|type|const|let|var|namespace)\b\s*(?P<name>[\w$]+)?)"
)
REEXPORT = re.compile(r"export\s*(?:type\s*)?(?P<what>\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*(?:from\s*(?P<from>['\"][^'\"]+['\"]))?\s*;?")
MEMBER = re.compile(r"(?P<mods>(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract|declare)\s+)*)(?P<star>\*\s*)?(?P<name>#?[\w$]+|\[[^\]]*\])\s*(?P<mark>[?!])?\s*(?P<next><[^>(]*>\s*\(|\(|=(?!=)|:|;|\n|\}|$)")
JSX = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][\w.]*)?(?=[\s/>])")
TAG_END = re.compile(r"[{>]|/>")
BRACKET = re.compile(r"[()\[\]{}]")
OPENER = {")": "(", "]": "[", "}": "{"}
#: Open tags that an end tag is looked for in.
JSX_DEPTH = 1000
SOLID = re.compile(r"\S")
DEFAULT = re.compile(r"export\s+default\s+")
BEFORE_JSX = frozenset("=(,?:&|>{[")
KINDS = {"class": "class", "function": "function", "function*": "function", "interface": "interface", "enum": "enum", "type": "type_alias", "const": "const", "namespace": "namespace"}


def blank(text: str) -> str:
    """The text with strings and comments blanked, of equal length, lines kept."""
    return SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


class Scan:
    """Blanked code with the partner of every bracket, each found once."""

    def __init__(self, code: str):
        self.code, self.after = code, {}
        open_: dict[str, list[int]] = {"(": [], "[": [], "{": []}
        for m in BRACKET.finditer(code):
            if m[0] in open_:
                open_[m[0]].append(m.start())
            elif held := open_[OPENER[m[0]]]:
                self.after[held.pop()] = m.end()
        self.tokens = {c: [m.start() for m in re.finditer(re.escape(c), code)] for c in "({;"}

    def closing(self, i: int) -> int:
        """The place after the bracket that closes the one at i."""
        return self.after.get(i, len(self.code))

    def find(self, what: str, i: int) -> int:
        """The next of a few characters from i on, or -1."""
        found = [at[k] for at in map(self.tokens.__getitem__, what) if (k := bisect_left(at, i)) < len(at)]
        return min(found, default=-1)

    def statement_end(self, i: int, end: int | None = None) -> int:
        """The place after a statement: its semicolon, or a line end outside brackets
        after which nothing goes on."""
        code, end = self.code, len(self.code) if end is None else end
        begin, last = i, -1  # the last character that is no white space
        while i < end:
            c = code[i]
            if c in "([{":
                i = min(self.closing(i), end)
                last = i - 1
                continue
            if c in ")]}":
                return i
            if c == ";":
                return i + 1
            if c == "\n":
                m = SOLID.search(code, i, end)
                after = m.start() if m else end
                goes_on = after < end and code[after] in ".?:+-*/&|=,"
                if not goes_on and not (last >= begin and (code[last] in "=,+-*/&|?:" or code[last - 1 : last + 1] == "=>")):
                    return i
                i = after
                continue
            if not c.isspace():
                last = i
            i += 1
        return end


def _parse(handler: str, path: str, text: str, limits: Limits) -> Parsed:
    out, at, code = Parsed(), Places(text), blank(text)
    scan = Scan(code)
    module = module_name(path)
    root = f"{handler}:{path}::{module}"
    lead = re.match(r"\s*(/\*\*?.*?\*/|(?://[^\n]*\n?)+)", text, re.S)
    doc = None
    if lead:
        s, e = lead.start(1), lead.end(1)
        doc = "\n".join(x.strip().lstrip("/*").rstrip("*/").strip() for x in lead[1].split("\n")).strip() or None
        out.chunks.append(Chunk(f"{handler}:module-doc:{at.byte(s)}:{at.byte(e)}", text[s:e], at.byte(s), at.byte(e), 0, root, meta=at.span(s, e)))
    out.symbols.append(Symbol(root, module, "module", 0, at.byte(len(text)), docstring=doc))

    def emit(label: str, s: int, e: int, symbol: str, **meta: object) -> None:
        parts = split_lines(text[s:e], limits, joined=True)
        if len(parts) > 1:
            meta["overflow"] = True
            out.warnings.append(f"a {label} is split into {len(parts)} parts")
        for n, (a, b) in enumerate(parts):
            out.chunks.append(Chunk(f"{handler}:{label}:{at.byte(s + a)}:{at.byte(s + b)}:{n}", text[s + a : s + b], at.byte(s + a), at.byte(s + b), n, symbol, meta={**at.span(s + a, s + b), **meta}))

    def symbol(name: str, kind: str, s: int, e: int, parent: str, **meta: object) -> str:
        sid = f"{handler}:{path}::{module}.{name}:{at.byte(s)}:{at.byte(e)}"
        out.symbols.append(Symbol(sid, name, kind, at.byte(s), at.byte(e), parent, meta=meta))
        return sid

    def members(owner: str, cls: str, s: int, e: int) -> None:
        i, fields = s, []
        while i < e:
            m = MEMBER.match(code, i)
            if not m or not m["name"].strip():
                i += 1
                continue
            if m["next"].endswith("("):
                brace = scan.find("{;", scan.closing(m.end() - 1))
                end = e if not 0 <= brace < e else scan.closing(brace) if code[brace] == "{" else brace + 1
                sid = symbol(f"{cls}.{m['name']}", "method", m.start(), end, owner, static="static" in m["mods"] or None)
                emit("method", m.start(), end, sid)
                i = end
            else:
                end = max(scan.statement_end(m.end("name"), e), m.end("name"))
                if text[m.start() : end].strip():
                    fields.append((m.start(), end))
                i = max(end, i + 1)
        if fields:
            emit("class-field", fields[0][0], fields[-1][1], owner)

    i = 0
    while i < len(code):
        if code[i].isspace() or code[i] == ";":
            i += 1
            continue
        r = REEXPORT.match(code, i)
        if r:
            original = REEXPORT.match(text, i) or r
            names = original["what"].strip("{} \n")
            sid = symbol(" ".join(names.split()) or "*", "reexport", i, r.end(), root, source=(original["from"] or "").strip("'\"") or None)
            emit("chunk", i, r.end(), sid)
            i = r.end()
            continue
        m = DECLARE.match(code, i)
        if not m:
            default = DEFAULT.match(code, i)
            end = max(scan.statement_end(default.end() if default else i), i + 1)
            if default:
                emit("chunk", i, end, symbol("default", "const", i, end, root, exported=True, default_export=True))
            i = end
            continue
        kind, name = m["kind"], m["name"] or "default"
        flags = {"exported": bool(m["export"]) or None, "default_export": bool(m["default"]) or None}
        if kind in ("class", "interface", "enum", "namespace") or kind.startswith("function"):
            head = m.end()
            if kind.startswith("function") and (params := scan.find("(", head)) >= 0:
                head = scan.closing(params)
            brace = scan.find("{;", head)
            end = scan.closing(brace) if brace >= 0 and code[brace] == "{" else brace + 1 if brace >= 0 else scan.statement_end(i)
            if kind == "class":
                extends = re.search(r"\bextends\b([^{]*)", code[m.end() : max(brace, m.end())])
                sid = symbol(name, "class", i, end, root, **flags, extends=extends[1].split("implements")[0].strip() if extends else None)
                emit("chunk", i, end, sid)
                members(sid, name, brace + 1, end - 1)
            else:
                sid = symbol(name, KINDS[kind], i, end, root, **flags)
                emit("function" if kind.startswith("function") else "chunk", i, end, sid)
        else:
            end = max(scan.statement_end(i), m.end())
            sid = symbol(name, KINDS[kind], i, end, root, **flags) if kind in KINDS else root
            emit("chunk", i, end, sid)
        i = end
    for s, e in jsx(scan):
        out.chunks.append(Chunk(f"html:delegate:{handler}:jsx:{at.byte(s)}:{at.byte(e)}", text[s:e], at.byte(s), at.byte(e), 0, root, "html", meta={"delegate_parent_symbol": root, **at.span(s, e)}))
    return out


def jsx(scan: Scan) -> list[tuple[int, int]]:
    """Places of JSX elements of every level: a tag where an expression may begin, or
    within another, up to its end tag.  One pass with a stack of open tags."""
    code, out, held, past = scan.code, [], [], 0
    for m in JSX.finditer(code):
        if m.start() < past:  # within the head of a tag
            continue
        name = m["name"] or ""
        if m["close"]:
            close = code.find(">", m.end())
            if close >= 0 and any(t == name for t, _ in held[-JSX_DEPTH:]):
                while held[-1][0] != name:
                    held.pop()
                out.append((held.pop()[1], close + 1))
            continue
        before = m.start() - 1
        while before >= 0 and code[before].isspace():
            before -= 1
        word = code[max(0, before - 5) : before + 1] == "return" and not (before > 5 and (code[before - 6].isalnum() or code[before - 6] in "_$"))
        if not held and not (before >= 0 and (code[before] in BEFORE_JSX or word)):
            continue
        if not name and code[m.end()] != ">":
            continue
        end = TAG_END.search(code, m.end())
        while end and end[0] == "{":
            end = TAG_END.search(code, scan.closing(end.start()))
        if not end:
            break
        past = end.end()
        if end[0] == "/>":
            out.append((m.start(), past))
        else:
            held.append((name, m.start()))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def parse_js(path: str, text: str, limits: Limits) -> Parsed:
    return _parse("javascript", path, text, limits)


def parse_ts(path: str, text: str, limits: Limits) -> Parsed:
    return _parse("typescript", path, text, limits)
