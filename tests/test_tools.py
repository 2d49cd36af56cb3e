"""The tool layer: the same calls by name, as JSON-RPC lines, over HTTP and on the command line."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from quillgraph import __main__ as main
from quillgraph import serve, tools
from quillgraph.plans.engine import Engine


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    s = tools.Session(Engine(spark, str(tmp_path_factory.mktemp("tools"))), "ann", "org", lambda: 1_700_000_000_000)
    s.admit()
    told = {"text": "Mara Lind works at Helio Labs.\nHelio Labs acquired Brine Systems.", "name": "memo", "record_id": "r1", "episodes": [{"event": "Mara met the board", "actors": ["Mara Lind"]}], "procedures": [{"trigger": "memos", "action": "keep them short"}]}
    assert s.call("context_ingest", told) == "stored: r1"
    return s


def test_tools(session):
    s = session
    assert "Mara Lind works at Helio Labs" in s.call("context_about", {"subject": "Mara Lind"})
    assert "Helio Labs acquired Brine Systems" in s.call("get_context", {"query": "everything about Brine Systems"}).replace("Helio Labs acquired Brine Systems.", "Helio Labs acquired Brine Systems")
    assert "acquired" in s.call("context_relate", {"name": "Brine Systems"}) and "works_at" in s.call("context_graph")
    assert "Mara met the board" in s.call("context_timeline", {"subject": "Mara Lind"})
    assert "keep them short" in s.call("context_reflect") and "chunks" in s.call("context_health")
    with pytest.raises(ValueError):
        s.call("context_about")
    assert "Helio" in tools.resource(s, "record://r1")


def test_lines_and_http(session):
    out = io.StringIO()
    asks = [{"id": 1, "method": "initialize"}, {"method": "initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "context_health"}}, {"id": 4, "method": "resources/list"}, {"id": 5, "method": "none"}, {"id": 6, "method": "tools/call", "params": {"name": "none"}}]
    tools.serve_lines(session, [*map(json.dumps, asks), "", "no json"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, 6, None] and len(got[1]["result"]["tools"]) == len(tools.TOOLS) == 11
    assert "chunks" in got[2]["result"]["content"][0]["text"] and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32602
    web = serve.server(session, token="t")
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_port}"

    def ask(path, body=None, token="t"):
        r = urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None, {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, json.load(f)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert ask("/health", token="")[0] == 200 and ask("/tools", token="no")[0] == 401
    assert "context_about" in ask("/tools")[1]["tools"]
    assert "chunks" in ask("/tools/context_health", {})[1]["text"]
    assert ask("/tools/none", {})[0] == 404 and ask("/tools/context_about", {})[0] == 400
    web.shutdown()


def test_command_line(spark, tmp_path):
    note = tmp_path / "note.txt"
    note.write_text("Mara Lind works at Helio Labs.")
    at = ["--store", str(tmp_path / "s")]
    assert main.run(spark, [*at, "ingest", str(note)]).startswith("stored: file:")
    assert "Helio" in main.run(spark, [*at, "search", "where does Mara work"])
    assert "records" in main.run(spark, [*at, "status"]) and "MERGE" in main.run(spark, [*at, "export"])
    assert main.run(spark, [*at, "delete", f"file:{note}"]).endswith("deleted")
