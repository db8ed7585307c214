"""Structure parsers on inputs of every shape."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstrata.operators.parsers import base
from quillstrata.operators.parsers.base import Limits, run_one

LETTERS = Limits(2000, len)


def test_markdown():
    text = "---\nt: x\n---\nintro\n# One\nbody é\n```python\nprint(1)\n# not a heading\n```\n## Two\nmore\n# Three\n```\nplain\n```\n```bash\n\n```\n"
    p = run_one("markdown", "a.md", text, LETTERS)
    assert p.chunks[0].chunk_id == "markdown:front-matter"
    assert [(s.name, s.meta["level"]) for s in p.symbols] == [("One", 1), ("Two", 2), ("Three", 1)]
    assert p.symbols[1].parent == p.symbols[0].symbol_id and p.symbols[2].parent is None
    sections = [c for c in p.chunks if ":section:" in c.chunk_id]
    assert sections[0].meta["intro_attached"] and sections[0].text.startswith("intro")
    assert "".join(c.text for c in p.chunks[:1] + sections) == text
    fence = [c for c in p.chunks if c.delegate]
    assert [(c.delegate, c.text, c.delegate_parent, c.symbol) for c in fence] == [("python", "print(1)\n# not a heading\n", sections[0].chunk_id, p.symbols[0].symbol_id)]
    assert [c.text for c in p.chunks if c.chunk_id.startswith("markdown:fence")] == ["plain\n"]
    raw = text.encode()
    assert all(raw[c.start : c.end].decode() == c.text for c in p.chunks)


def test_markdown_without_headings():
    p = run_one("markdown", "a.md", "just\ntext\n", LETTERS)
    assert [c.chunk_id for c in p.chunks] == ["markdown:body:0:10"] and not p.symbols


HTML = """<!doctype html><html><head><style>
  body { color: red; }
</style></head><body><!-- note --><section id="a"><h1>Títle &amp; more</h1><p>one<br>two</section>
<script>if (a < b) { x = "</p>"; }</script><script src="x"></script>tail</body></html>"""


def test_html():
    p = run_one("html", "u", HTML, LETTERS)
    kinds = [s.name for s in p.symbols]
    assert kinds == ["u", "head", "style", "body", "section", "p", "script", "script"]  # html and h1 are not structural
    by = {s.name: s for s in p.symbols}
    assert by["p"].parent == by["section"].symbol_id and by["section"].parent == by["body"].symbol_id
    title = next(c for c in p.chunks if c.text == "Títle &amp; more")
    assert title.symbol == by["section"].symbol_id
    code = {c.delegate: c for c in p.chunks if c.delegate}
    assert code["javascript"].text == 'if (a < b) { x = "</p>"; }' and code["css"].text == "body { color: red; }"
    shells = {c.chunk_id for c in p.chunks}
    assert all(c.delegate_parent in shells for c in code.values())
    loose = {c.meta["kind"]: c.text for c in p.chunks if "kind" in c.meta}
    assert loose["comment"] == "<!-- note -->" and "tail" in [c.text for c in p.chunks]
    raw = HTML.encode()
    assert raw[by["p"].start : by["p"].end].decode() == "<p>one<br>two"
    assert not p.warnings


def test_html_structural_elements():
    tags = "article aside body details div fieldset figcaption figure footer form head header legend li main nav ol p section summary table tbody td thead tr ul".split()
    p = run_one("html", "u", "".join(f"<{t}>x</{t}>" for t in (*tags, "html", "h1", "dl", "pre", "template", "span", "th")), LETTERS)
    assert [s.name for s in p.symbols[1:]] == tags


def test_html_with_a_disabled_delegate():
    p = run_one("html", "u", HTML, Limits(2000, len, enabled=frozenset({"html", "css"})))
    assert [c.delegate for c in p.chunks if c.delegate] == ["css"] and len(p.warnings) == 1
    inline = next(c for c in p.chunks if ":inline:" in c.chunk_id)
    assert inline.chunk_id.startswith("html:script:inline:") and inline.text == 'if (a < b) { x = "</p>"; }'
    assert inline.meta["handler_enabled"] is False and inline.meta["delegate"] == "javascript"


CSS = """/* head */
a, b:is(.x, .y) { color: red; content: "}"; }
@media (min-width: 1px) { .in { top: 0 } @supports (x: y) { .deep { left: 0 } } }
@keyframes k { from { top: 0 } to { top: 1px } }
@import "x.css";
@font-face { font-family: q }
broken {
"""


def test_css():
    p = run_one("css", "s.css", CSS, Limits(30, len))
    kinds = [s.kind for s in p.symbols]
    assert kinds.count("rule") == 5 and kinds.count("keyframe") == 2 and kinds.count("at_rule") == 4 or p.warnings
    split = [c for c in p.chunks if c.meta.get("overflow")]
    assert [c.meta["selector"] for c in split] == ["a", "b:is(.x, .y)"]
    assert p.chunks[0].text == "/* head */"
    deep = next(s for s in p.symbols if s.name == ".deep")
    assert deep.meta["cascade"] == ["@media (min-width: 1px)", "@supports (x: y)"]
    assert any(c.text == '@import "x.css";' for c in p.chunks)
    assert p.warnings


PY = '''"""Doc of module."""
import os


# about A
@deco
class A(Base):
    """Doc of A."""

    async def m(self, x: int = 1) -> str:
        """Doc of m."""
        return "é"


def f(a, *b):
    return [
        1,
        2,
    ]
'''


def test_python():
    p = run_one("python", "pkg/mod.py", PY, LETTERS)
    assert [(s.kind, s.symbol_id.split("::")[1]) for s in p.symbols] == [("module", "pkg.mod"), ("class", "pkg.mod.A"), ("function", "pkg.mod.A.m"), ("function", "pkg.mod.f")]
    assert [s.docstring for s in p.symbols] == ["Doc of module.", "Doc of A.", "Doc of m.", None]
    assert p.symbols[2].parent == p.symbols[1].symbol_id and p.symbols[1].parent == p.symbols[0].symbol_id
    assert p.symbols[1].meta["decorators"] == ["deco"] and p.symbols[1].meta["bases"] == ["Base"]
    assert p.symbols[2].meta["returns"] == "str" and p.symbols[2].meta["async"]
    assert p.chunks[0].chunk_id.endswith(":module-doc")
    raw = PY.encode()
    assert all(raw[c.start : c.end].decode() == c.text for c in p.chunks)


def test_python_split_and_errors():
    p = run_one("python", "m.py", PY, Limits(40, len))
    parts = [c for c in p.chunks if c.symbol.endswith("m.f")]
    assert len(parts) > 1 and [c.part_index for c in parts] == list(range(len(parts))) and all(c.meta["overflow"] for c in parts) and p.warnings
    assert run_one("python", "m.py", "def (", LETTERS).errors and not run_one("python", "m.py", "", LETTERS).chunks
    assert run_one("python", "m.py", b"\xff\xfe", LETTERS).errors


JS = """/** Module doc */
import x from "y";
export class A extends B {
  static z = 1;
  #p = "}";
  async run(a, b) { return `${a}`; }
}
export default function main(a) { return a > 1 ? "{" : '}'; }
export const n = 1, q = () => { return 2 };
let v = 3;
export { a as b, c } from './d';
export * from "e";
"""


def test_javascript():
    p = run_one("javascript", "src/a.js", JS, LETTERS)
    by = {s.name: s for s in p.symbols}
    assert {"src.a", "A", "A.run", "main", "n", "a as b, c", "*"} <= set(by)
    assert by["A"].meta["exported"] and by["A"].meta["extends"] == "B" and by["main"].meta["default_export"]
    assert by["A.run"].parent == by["A"].symbol_id and by["*"].meta["source"] == "e"
    text = {c.chunk_id.split(":")[1]: c.text for c in p.chunks}
    assert text["method"] == "async run(a, b) { return `${a}`; }" and text["class-field"].startswith("static z = 1;")
    assert text["function"].startswith("export default function main") and text["module-doc"] == "/** Module doc */"
    raw = JS.encode()
    assert all(raw[c.start : c.end].decode() == c.text for c in p.chunks)


def test_typescript_and_jsx():
    ts = "interface P { a: string }\ntype U = A | B;\nexport enum E { X }\nexport function C(p: P) {\n  return <div id='a'><b>x</b></div>;\n}\n"
    p = run_one("typescript", "c.tsx", ts, LETTERS)
    assert {"interface", "type_alias", "enum", "function"} <= {s.kind for s in p.symbols}
    assert [c.text for c in p.chunks if c.delegate == "html"] == ["<div id='a'><b>x</b></div>", "<b>x</b>"]


def test_caps_of_handlers():
    assert Limits("auto").of("javascript").max_tokens is None and Limits("auto").of("typescript").max_tokens is None
    assert Limits("auto").of("python").max_tokens == 2000 and Limits("auto", general=7).of("css").max_tokens == 7
    assert Limits("12").of("javascript").max_tokens == 12 and Limits().of("javascript").max_tokens == 2000 and Limits(0).of("css").max_tokens is None
    body = "function f() {\n" + "  x();\n" * 40 + "}\n"
    assert len([c for c in run_one("javascript", "a.js", body, Limits("auto", len, 50)).chunks if ":function:" in c.chunk_id]) == 1
    assert len([c for c in run_one("javascript", "a.js", body, Limits(50, len)).chunks if ":function:" in c.chunk_id]) > 1


def test_packing_by_sums_and_as_a_whole():
    text, quarter = "a\nb\nc\nd\n", lambda t: -(-len(t) // 4)  # each line rounds up to one token; two lines together are one
    assert base.split_lines(text, Limits(1, quarter)) == [(0, 2), (2, 4), (4, 6), (6, 8)]
    assert base.split_lines(text, Limits(1, quarter), joined=True) == [(0, 4), (4, 8)]


@pytest.mark.parametrize("handler,body", [("python", "-" * 100_000 + "1"), ("nosuch", "x"), ("html", None), ("python", "x = 1\0")])
def test_one_bad_file_is_one_error_row(spark, handler, body):
    df = spark.createDataFrame([(1, "a", body), (2, "b", "ok = 1")], "id long, path string, body string")
    got = {r["key"]: r["errors"] for r in base.parse(df, F.when(F.col("id") == 1, handler).otherwise("python"), "id", "path", "body").collect()}
    assert got["2"] == [] and len(got["1"]) == (body is not None)


def test_typescript_overloads_end_at_their_semicolon():
    p = run_one("typescript", "a.ts", "declare function f(a: string): void;\nexport class B { m(): void; n() { return 1 } }\n", LETTERS)
    by = {s.name: s for s in p.symbols}
    assert (by["f"].start, by["f"].end) == (0, 36) and {"B.m", "B.n"} <= set(by)


def test_jsx_attributes_and_fragments():
    p = run_one("javascript", "a.jsx", "const a = <><B on={() => { f(a > b) }} c='1'/><D>t</D></>;\nif (a < b) c();\n", LETTERS)
    assert [c.text for c in p.chunks if c.delegate == "html"] == ["<><B on={() => { f(a > b) }} c='1'/><D>t</D></>", "<B on={() => { f(a > b) }} c='1'/>", "<D>t</D>"]


def timed(handler, text):
    began = time.process_time()
    run_one(handler, "a", text, LETTERS)
    return time.process_time() - began


@pytest.mark.parametrize(
    "handler,piece,n",
    [("javascript", "const a = 1\n\n", 8000), ("javascript", "class A { a = 1\n b() { return 2 }\n}\n", 3000), ("javascript", "const x = <p class='y'>\n<b>{z}</b></p>;\n", 3000), ("markdown", "# h\n```js\nx\n```\n", 4000), ("html", "<div><p>x</p></div>\n", 4000), ("css", "a, b { top: 0 }\n", 4000)],
)
def test_parsers_are_linear(handler, piece, n):
    one = min(timed(handler, piece * n) for _ in range(2))
    assert timed(handler, piece * (3 * n)) < 6 * one + 0.5


def test_parse_table_and_registry(spark):
    base.register("loud", lambda path, text, limits: base.Parsed(chunks=[base.Chunk("loud:0", text.upper(), 0, len(text))]))
    df = spark.createDataFrame([(1, "a.py", "x = 1"), (2, "b.py", "def ("), (3, "c.py", None)], "id long, path string, body string")
    got = {r["key"]: r for r in base.parse(df, "python", "id", "path", "body").collect()}
    assert got["1"]["symbols"][0]["name"] == "a" and got["2"]["errors"] and not got["3"]["chunks"]
    assert [r["content_text"] for r in base.chunks(base.parse(df.where("id = 1"), "loud", "id", "path", "body")).collect()] == ["X = 1"]


@pytest.mark.parametrize("path,body,want", [("a.md", "", ("markdown", "extension")), ("run", "#!/usr/bin/env python3\n", ("python", "shebang")), ("x.bin", "", ("text", "default")), ("a.css", "", ("text", "fallback")), ("a.mkd", "", ("markdown", "extension")), ("x", "#!/usr/bin/Python2 -u\n", ("python", "shebang")), ("x", "#!/usr/bin/deno\n", ("text", "default")), ("a.cfg", "", ("text", "extension"))])
def test_resolve(spark, path, body, want):
    h, r = base.resolve(F.lit(path), F.lit(body), enabled={"markdown", "python"})
    assert tuple(spark.range(1).select(h, r).first()) == want


def test_results_leave_in_bounded_runs(spark):
    """A batch of many pages, with deep nesting, gives the same rows in record batches of about one run."""

    class Grab:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    page = "<div>" * 20 + "<p>" + "word " * 300 + "</p><script>f()</script>" + "</div>" * 20
    rows = [{"key": str(i), "handler": "html", "path": f"p{i}", "content": page if i % 7 else None} for i in range(1000)]
    found = list(base.parse(Grab(), "html", "key", "path", "content").run(iter([pa.RecordBatch.from_pylist(rows[:700]), pa.RecordBatch.from_pylist(rows[700:])])))
    assert max(b.nbytes for b in found) < 4 << 20 and len(found) > 5
    got = [r for b in found for r in b.to_pylist()]
    assert [r["key"] for r in got] == [r["key"] for r in rows]
    want = [base.run_one("html", r["path"], r["content"]) for r in rows]
    assert [[c["content_text"] for c in r["chunks"]] for r in got] == [[c.text for c in w.chunks] for w in want]
    assert [[s["symbol_id"] for s in r["symbols"]] for r in got] == [[s.symbol_id for s in w.symbols] for w in want]
