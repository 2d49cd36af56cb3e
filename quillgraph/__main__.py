"""python -m quillgraph --store PATH COMMAND: the engine on a command line.

Commands: learn DIR; ingest FILE...; call TOOL [JSON]; ask QUESTION; search QUESTION; status; delete RECORD...; export;
serve [--port N]; lines (JSON-RPC on standard input and output).
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession

from quillgraph import serve, tools
from quillgraph.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--store", required=True, help="folder or URI of the store")
    p.add_argument("--user", default="admin")
    p.add_argument("--org", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *names in (("learn", "root"), ("ask", "question"), ("search", "question"), ("call", "tool"), ("status",), ("export",), ("lines",), ("serve",), ("ingest", "files"), ("delete", "records")):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n, **({"nargs": "+"} if n in ("files", "records") else {}))
        if name == "call":
            c.add_argument("arguments", nargs="?", default="{}")
        if name == "serve":
            c.add_argument("--port", type=int, default=8080)
            c.add_argument("--token")
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> str:
    a = parser().parse_args(argv)
    s = tools.Session(Engine(spark, a.store), a.user, a.org)
    if s.engine.store.read("principals").isEmpty():
        s.admit()
    e, now = s.engine, int(time.time() * 1000)
    if a.command == "learn":
        return tools.lines(e.learn(a.root, a.user, a.org, now), lambda r: f"{r['what']}: {r['n']}", "No files were found.")
    if a.command == "ingest":
        out = []
        for name in a.files:
            with open(name, encoding="utf-8", errors="replace") as f:
                out.append(s.call("context_ingest", {"text": f.read(), "name": os.path.basename(name), "record_id": f"file:{name}"}))
        return "\n".join(out)
    if a.command == "ask":
        return s.call("get_context", {"query": a.question})
    if a.command == "search":
        found, _ = e.search([a.question], a.user, a.org, now)
        return tools.lines(found.orderBy("rank"), lambda r: f"{r['record_id']}: {r['passage']}", "Nothing was found.")
    if a.command == "call":
        return s.call(a.tool, json.loads(a.arguments))
    if a.command == "delete":
        return tools.lines(e.delete(a.records, a.user, a.org), lambda r: f"{r['record_id']}: {r['reason'] or 'deleted'}", "No such records.")
    if a.command == "export":
        return "\n".join(r["statement"] for r in e.cypher(a.user, a.org).orderBy("part", "statement").toLocalIterator())
    if a.command == "serve":
        serve.server(s, a.port, a.token).serve_forever()
    if a.command == "lines":
        tools.serve_lines(s)
        return ""
    return s.call("context_health")


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("quillgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()))
