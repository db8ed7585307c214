"""A whole life of a workspace: parse, change, parse, embed, search, remove, check."""

import pytest

from quillstrata.operators import index
from quillstrata.operators.batches import BatchError
from quillstrata.operators.embedding import HashProvider
from quillstrata.plans.workspace import Workspace, WorkspaceError


def test_life(spark, tmp_path):
    code = tmp_path / "code"
    code.mkdir()
    (code / "a.py").write_text('def alpha():\n    "finds apples"\n    return 1\n\n\ndef beta():\n    return "pears"\n')
    (code / "b.md").write_text("# Title\nbody\n## Part\nmore\n")
    (code / "c.txt").write_text("one\ntwo\n")
    w = Workspace(spark, str(tmp_path / "w"))
    w.add_source("s", str(code))
    with pytest.raises(WorkspaceError):
        w.add_source("s", "x")
    first = w.parse("s")
    log = w.table("run_log").first()
    assert (log["files"], log["failed"], log["reused"], log["status"]) == (3, 0, 0, "ok")
    (code / "a.py").write_text('def alpha():\n    "finds apples"\n    return 1\n\n\ndef beta():\n    return "plums"\n')
    second = w.parse("s")
    assert [r["id"] for r in w.batch_summary().collect()] == [second, first]
    assert {r["symbol_id"].rpartition(".")[2]: r["text"] for r in w.recompose(second).where("handler_name = 'python'").collect()}["beta"].endswith('"plums"')
    p = HashProvider(16)
    w.create_vdb("v", "s@latest", "hash", "m", 16)
    w.create_vdb("v", "s@latest", "hash", "m", 16)
    with pytest.raises(WorkspaceError):
        w.create_vdb("v", "s@latest", "hash", "other", 16)
    assert w.sync("v", p, dry_run=True)["embed"] == 4 and w.table("vectors").count() == 0
    assert w.sync("v", p)["inserted"] == 4 and w.sync("v", p)["embed"] == 0
    best = w.search("v", p, ["return plums"], 1).first()
    assert best["symbol_id"].endswith("beta") and "# python:s/a.py::s.a.beta" in best["header_md"]
    assert index.validate(w.table("index_meta"), w.table("vectors"), 16, "cosine").collect() == []
    assert {r["code"] for r in index.validate(w.table("index_meta"), w.table("vectors").limit(1), 8, "l2").collect()} == {"dim-mismatch", "metric-mismatch", "count-mismatch", "checksum-mismatch"}
    with pytest.raises(BatchError):
        w.remove_batch(second, force=True)
    counts = w.remove_batch(first)
    assert counts["chunks_reassigned"] > 0 and counts["chunks_deleted"] > 0 and w.table("batches").count() == 1
    assert {(r["module"], r["name"], r["status"]) for r in w.checkhealth().collect()} == {("parser", "s", "ok"), ("vdb", "v", "ok")}
    assert w.run_sql("SELECT count(*) AS n FROM vectors;")[0].first()["n"] == 4
    assert w.reset_vdb("v", drop=True) == {"chunks_deleted": 4, "vectors_deleted": 4, "vdbs_deleted": 1}
    w.enable("s", False)
    with pytest.raises(WorkspaceError):
        w.parse("s")
    w.rename("s", "t")
    w.retarget("t", "elsewhere")
    w.remove_source("t")
    assert w.sources() == {}
