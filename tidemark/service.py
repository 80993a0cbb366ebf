"""An HTTP service around the live engine."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from .streaming.live import Live

#: The most bytes of a request's body.
BODY = 1_048_576


def serve(engine: Live, host: str = "127.0.0.1", port: int = 8787, token: str | None = None) -> ThreadingHTTPServer:
    """A server for ``serve_forever``: ``POST /observe`` takes a turn or a list of them and answers with the reports,
    ``GET /inspect`` has what was learned, ``GET /healthz`` answers always. With ``token``, all but the last need it as
    a bearer. A list is checked whole before any of it is taken; if a turn fails after that, those before it stay."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def answer(self, status: int, what: dict) -> None:
            body = json.dumps(what).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def body(self) -> str | None:
            """The body; None if it is too long."""
            length = self.headers.get("Content-Length", "0")
            left = int(length) if length.isdigit() else 0
            if left > BODY:
                while left > 0 and (got := self.rfile.read(min(left, 65_536))):
                    left -= len(got)
                return None
            return self.rfile.read(left).decode("utf-8", "replace")

        def observe(self) -> tuple[int, dict]:
            text = self.body()
            if text is None:
                return 413, {"error": "request body exceeds 1 MB"}
            try:
                turns = json.loads(text)
            except (ValueError, RecursionError):
                return 400, {"error": "invalid JSON"}
            turns = turns if isinstance(turns, list) else [turns]
            if not all(isinstance(t, dict) and isinstance(t.get("agentId"), str) and t["agentId"] for t in turns):
                return 400, {"error": "each observation must be an object with a non-empty string agentId"}
            try:
                return 200, {"reports": [engine.observe(t) for t in turns]}
            except Exception as e:  # noqa: BLE001
                return 400, {"error": str(e)}

        def handled(self) -> None:
            route = (self.command, urlsplit(self.path).path)
            try:
                if token is not None and route[1] != "/healthz" and not hmac.compare_digest(self.headers.get("Authorization", "").encode("latin-1"), f"Bearer {token}".encode()):
                    self.body()
                    self.answer(401, {"error": "unauthorized"})
                elif route == ("POST", "/observe"):
                    self.answer(*self.observe())
                elif route == ("GET", "/inspect"):
                    self.answer(200, engine.inspect())
                elif route == ("GET", "/healthz"):
                    self.answer(200, {"ok": True})
                else:
                    self.body()
                    self.answer(404, {"error": "not found"})
            except (BrokenPipeError, ConnectionResetError):
                pass
            except Exception as e:  # noqa: BLE001
                self.answer(500, {"error": str(e)})

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = handled

    return ThreadingHTTPServer((host, port), Handler)
