"""The tools over HTTP: GET /health and /tools, GET /resource?uri=, POST /tools/<name> with JSON arguments."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from quillgraph.tools import TOOLS, Session, resource

MOST = 10_000_000


def server(session: Session, port: int = 0, token: str | None = None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that isn't started yet. With a token, requests need it as a bearer token."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, code: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _barred(self) -> bool:
            if token is None or hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {token}"):
                return False
            self._reply(401, {"error": "a bearer token is needed"})
            return True

        def _run(self, work) -> None:
            try:
                self._reply(200, {"text": work()})
            except KeyError as e:
                self._reply(404, {"error": str(e.args[0])})
            except ValueError as e:
                self._reply(400, {"error": str(e.args[0])})

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            if at.path == "/health":
                return self._reply(200, {"status": "ok"})
            if self._barred():
                return None
            if at.path == "/tools":
                return self._reply(200, {"tools": {n: {"about": about, "arguments": needs} for n, (about, needs, _) in TOOLS.items()}})
            if at.path == "/resource":
                return self._run(lambda: resource(session, parse_qs(at.query).get("uri", [""])[0]))
            return self._reply(404, {"error": "nothing is here"})

        def do_POST(self) -> None:
            if self._barred():
                return None
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST:
                return self._reply(413, {"error": "the request is too large"})
            try:
                given = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                return self._reply(400, {"error": "the body isn't JSON"})
            return self._run(lambda: session.call(self.path.removeprefix("/tools/"), given))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
