"""Python, by the standard ast: module, class and function symbols and their chunks."""

from __future__ import annotations

import ast
import re

from quillstrata.operators.parsers.base import Chunk, Limits, Parsed, Places, Symbol, split_lines


def module_name(path: str) -> str:
    name = re.sub(r"\.[^./]*$", "", path.strip("/")).replace("/", ".")
    return name.removesuffix(".__init__")


def parse(path: str, text: str, limits: Limits) -> Parsed:
    tree = ast.parse(text)
    out, at = Parsed(), Places(text)
    lines = text.split("\n")
    starts = at.lines

    def char(line: int, column: int) -> int:
        row = lines[line - 1]
        return starts[line - 1] + (column if row.isascii() else len(row.encode()[:column].decode()))

    module = module_name(path)
    root = f"python:{path}::{module}"
    out.symbols.append(Symbol(root, module, "module", 0, at.byte(len(text)), docstring=ast.get_docstring(tree)))
    first = tree.body[0] if tree.body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        s, e = char(first.lineno, first.col_offset), char(first.end_lineno, first.end_col_offset)
        out.chunks.append(Chunk(f"python:{path}:{s}:{e}:module-doc", text[s:e], at.byte(s), at.byte(e), 0, root, meta=at.span(s, e)))

    def leading(line: int) -> int:
        """A definition takes the comments and blank lines that stand right before it."""
        while line > 1 and (not lines[line - 2].strip() or lines[line - 2].lstrip().startswith("#")):
            line -= 1
        return line

    def visit(node: ast.AST, scope: list[str], parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                visit(child, scope, parent)
                continue
            names = [*scope, child.name]
            qualified = ".".join([module, *names])
            sid = f"python:{path}::{qualified}"
            line = min([child.lineno, *(d.lineno for d in child.decorator_list)])
            s, e = starts[leading(line) - 1], char(child.end_lineno, child.end_col_offset)
            kind = "class" if isinstance(child, ast.ClassDef) else "function"
            meta: dict = {"decorators": [ast.unparse(d) for d in child.decorator_list] or None, "line": line, **at.span(s, e)}
            if kind == "class":
                meta["bases"] = [ast.unparse(b) for b in child.bases] or None
            else:
                meta |= {"parameters": ast.unparse(child.args) or None, "returns": ast.unparse(child.returns) if child.returns else None, "async": isinstance(child, ast.AsyncFunctionDef) or None}
            out.symbols.append(Symbol(sid, child.name, kind, at.byte(s), at.byte(e), parent, ast.get_docstring(child), meta))
            parts = split_lines(text[s:e], limits)
            if len(parts) > 1:
                out.warnings.append(f"{qualified} is split into {len(parts)} parts")
            for n, (a, b) in enumerate(parts):
                more = {"overflow": True, "sequence_index": n} if len(parts) > 1 else {}
                out.chunks.append(Chunk(f"python:{path}:{s + a}:{s + b}:{n}", text[s + a : s + b], at.byte(s + a), at.byte(s + b), n, sid, meta={**more, **at.span(s + a, s + b)}))
            visit(child, names, sid)

    visit(tree, [], root)
    return out
