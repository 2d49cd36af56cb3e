"""The engine as named tools: arguments in, text out. The command line, the HTTP server and the line protocol share them."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.engine import Engine

Tool = Callable[["Session", dict], str]
TOOLS: dict[str, tuple[str, dict[str, str], Tool]] = {}


class Session:
    """An engine used in the name of one user."""

    def __init__(self, engine: Engine, user_id: str = "admin", org_id: str = "default", clock: Callable[[], int] | None = None):
        self.engine, self.user, self.org = engine, user_id, org_id
        self.now = clock or (lambda: int(time.time() * 1000))

    def admit(self) -> None:
        """Registers the user as an administrator, for a store with a single user."""
        self.engine.register([{"id": self.user, "coll": "users", "user_id": self.user, "org_id": self.org, "role": "admin"}, {"id": self.org, "coll": "organizations"}])
        self.engine.link([(self.user, self.org, "belongsTo")])

    def call(self, name: str, arguments: dict | None = None) -> str:
        if name not in TOOLS:
            raise KeyError(f"no tool is called {name}")
        _, needs, run = TOOLS[name]
        given = arguments or {}
        if missing := [n for n, kind in needs.items() if not kind.endswith("?") and n not in given]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        return run(self, given)


def tool(called: str, about: str, /, **needs: str) -> Callable[[Tool], Tool]:
    """needs: arguments and their kinds; a kind that ends in ? may be left out."""

    def add(run: Tool) -> Tool:
        TOOLS[called] = (about, needs, run)
        return run

    return add


def lines(rows: DataFrame, show: Callable, none: str, most: int = 200) -> str:
    """At most so many rows as bullets; a reader of text gets no more."""
    return "\n".join(f"- {show(r)}" for r in rows.limit(most).collect()) or none


@tool("get_context", "What is known about a question: exact answers, memories, how-tos, experiences, related facts, snippets", query="string")
def get_context(s: Session, a: dict) -> str:
    rows = s.engine.context(a["query"], s.user, s.org, s.now()).orderBy("section", "rank").collect()
    return "\n\n".join(f"{name}:\n" + "\n".join(f"- {r['text']}" for r in rows if r["section"] == name) for name in dict.fromkeys(r["section"] for r in rows)) or "Nothing relevant was found."


@tool("context_ingest", "Stores a document and what it says", text="string", name="string?", record_id="string?", share="boolean?", episodes="list?", procedures="list?")
def context_ingest(s: Session, a: dict) -> str:
    spark = s.engine.spark
    record = a.get("record_id") or f"doc:{a.get('name', 'note')}"
    kind = "record_id string, org_id string, record_name string, text string, seq long, owner_id string, share_with_org string"
    doc = spark.createDataFrame([(record, s.org, a.get("name", record), a["text"], 1, s.user, s.org if a.get("share") else None)], kind)
    lived = [(record, e["event"], e.get("occurred_at"), e.get("actors", [])) for e in a.get("episodes", [])]
    ways = [(record, p.get("trigger"), p["action"]) for p in a.get("procedures", [])]
    refused = s.engine.ingest(
        doc, s.now(), s.user, s.org,
        episodes=spark.createDataFrame(lived, "record_id string, event string, occurred_at string, actors array<string>") if lived else None,
        procedures=spark.createDataFrame(ways, "record_id string, trigger string, action string") if ways else None,
    )
    return f"refused: {record}" if refused.count() else f"stored: {record}"


@tool("context_about", "Current facts about a subject", subject="string")
def context_about(s: Session, a: dict) -> str:
    return lines(s.engine.facts(s.user, s.org, s.now(), a["subject"]).orderBy("rank"), lambda r: r["memory"], "Nothing is known.")


@tool("context_relate", "Neighbours of an entity, or a path to another one", name="string", to="string?", relation="string?")
def context_relate(s: Session, a: dict) -> str:
    if a.get("to"):
        return lines(s.engine.path(a["name"], a["to"], s.user, s.org).orderBy("step"), lambda r: f"{r['src']} {r['label']} {r['dst']}", "No path was found.")
    return lines(s.engine.neighbours(a["name"], s.user, s.org, a.get("relation")).orderBy("node", "rank"), lambda r: f"{r['node']} {r['label']} {r['to']} ({r['dir']})", "No neighbours were found.")


@tool("context_graph", "The heaviest relations, central entities and communities", limit="integer?")
def context_graph(s: Session, a: dict) -> str:
    n = int(a.get("limit", 50))
    parts = [
        ("Relations", lines(s.engine.concepts(s.user, s.org, n), lambda r: f"{r['src']} {r['label']} {r['dst']}", "none")),
        ("Central", lines(s.engine.central(s.user, s.org), lambda r: f"{r['node']} ({r['degree']})", "none")),
        ("Communities", lines(s.engine.communities(s.user, s.org), lambda r: f"{r['hub']}: {r['size']}", "none", 20)),
    ]
    return "\n\n".join(f"{name}:\n{text}" for name, text in parts)


@tool("context_timeline", "What was held about a subject, and when", subject="string")
def context_timeline(s: Session, a: dict) -> str:
    return lines(s.engine.timeline(a["subject"], s.user, s.org), lambda r: f"{r['at']} {r['text']}" + (" (superseded)" if r["superseded"] else ""), "Nothing is known.")


@tool("context_profile", "Lasting and recent facts about a subject, and what it is related to", subject="string")
def context_profile(s: Session, a: dict) -> str:
    return lines(s.engine.profile(a["subject"], s.user, s.org, s.now()).orderBy("section", "rank"), lambda r: f"{r['section']}: {r['text']}", "Nothing is known.")


@tool("context_reflect", "What keeps coming up, what changed, what is preferred and what happened last")
def context_reflect(s: Session, a: dict) -> str:
    return lines(s.engine.reflect(s.user, s.org, s.now()), lambda r: f"{r['category']}: {r['text']}", "Nothing stands out.")


@tool("context_forget", "Forgets memories that hold or mean a phrase", phrase="string")
def context_forget(s: Session, a: dict) -> str:
    return lines(s.engine.forget(a["phrase"], s.user, s.org), lambda r: f"forgotten: {r['memory']}", "Nothing matched.")


@tool("context_health", "Tables, their versions and sizes")
def context_health(s: Session, a: dict) -> str:
    return lines(s.engine.health().orderBy("table"), lambda r: f"{r['table']} v{r['version']}: {r['rows']} rows", "The store is empty.")


@tool("context_rebuild", "Extracts the graph anew, then memories from it, then tidies up")
def context_rebuild(s: Session, a: dict) -> str:
    s.engine.rebuild_graph(s.now())
    s.engine.rebuild_memories()
    s.engine.sleep(s.now())
    return "rebuilt"


#: read-only texts by address
RESOURCES = {"graph://summary": "context_graph", "graph://health": "context_health", "memory://reflection": "context_reflect"}


def resource(s: Session, uri: str) -> str:
    if uri.startswith("record://"):
        place = F.substring_index("point_id", "#", -1).cast("int")
        seen = s.engine.access(s.user, s.org).where(F.col("record_id") == uri.removeprefix("record://")).select("virtual_record_id")
        return "\n\n".join(r["content"] for r in s.engine.store.read("chunks").join(seen, "virtual_record_id", "left_semi").orderBy(place).collect())  # one record
    if uri not in RESOURCES:
        raise KeyError(f"no resource is at {uri}")
    return s.call(RESOURCES[uri])


def answer(s: Session, request: dict) -> dict | None:
    """A JSON-RPC answer to a request for tools or resources; None for notifications."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    out: dict = {"jsonrpc": "2.0", "id": request["id"]}
    try:
        if method == "initialize":
            result: dict = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "quillgraph", "version": "1"}}
        elif method == "tools/list":
            kind = lambda k: {"type": {"list": "array"}.get(k.rstrip("?"), k.rstrip("?"))}
            result = {"tools": [{"name": n, "description": about, "inputSchema": {"type": "object", "properties": {k: kind(v) for k, v in needs.items()}, "required": [k for k, v in needs.items() if not v.endswith("?")]}} for n, (about, needs, _) in TOOLS.items()]}
        elif method == "tools/call":
            result = {"content": [{"type": "text", "text": s.call(params.get("name", ""), params.get("arguments"))}]}
        elif method == "resources/list":
            result = {"resources": [{"uri": u, "name": n, "mimeType": "text/plain"} for u, n in RESOURCES.items()]}
        elif method == "resources/read":
            result = {"contents": [{"uri": params["uri"], "mimeType": "text/plain", "text": resource(s, params["uri"])}]}
        else:
            return out | {"error": {"code": -32601, "message": f"no method is called {method}"}}
    except (KeyError, ValueError) as e:
        return out | {"error": {"code": -32602, "message": str(e.args[0])}}
    return out | {"result": result}


def serve_lines(s: Session, source: Iterable[str] = sys.stdin, sink=sys.stdout) -> None:
    """A request per line, an answer per line."""
    for line in source:
        if line.strip():
            try:
                reply = answer(s, json.loads(line))
            except json.JSONDecodeError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "this line isn't JSON"}}
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()
