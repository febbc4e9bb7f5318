"""A thin service: POST /query?query=...&conv_id=... answers, GET /tools lists the tools, POST /tools/<name> calls one with a JSON record."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine
from .functions import tools


def server(engine: Engine, port: int, host: str = "127.0.0.1") -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: dict, status: int = 200) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if urlsplit(self.path).path != "/tools":
                return self._send({"error": "not found"}, 404)
            rows = tools.described(engine.spark, engine.tools).collect()
            return self._send({"tools": [{"name": r["name"], "description": r["description"], "args": r["args"]} for r in rows]})

        def do_POST(self) -> None:
            at = urlsplit(self.path)
            given = {k: v[0] for k, v in parse_qs(at.query).items()}
            if at.path == "/query" and "query" in given:
                return self._send({"result": engine.ask(given["query"], int(given.get("conv_id", 0)))})
            name = at.path.removeprefix("/tools/")
            if name in engine.tools:
                args = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                row = engine.spark.createDataFrame([(0, name, args)], "id long, tool string, args map<string,string>")
                return self._send({"result": tools.call_tools(row, engine.tools).first()["output"]})
            return self._send({"error": "not found"}, 404)

        def log_message(self, *_) -> None:
            pass

    return HTTPServer((host, port), Handler)
