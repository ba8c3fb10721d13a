"""The engine over HTTP: health, readiness, questions, callbacks. Standard library only; one request is a batch of one."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from corvane.engine import Engine
from corvane.operators import serving

REQUEST = "query string, user_id string, top_k int, model_filter string, use_memory boolean, validate boolean"


class Service:
    """What the routes do; ``on_message`` takes the messages of a callback (a DataFrame) after the reply is decided. Subclasses may change either."""

    def __init__(self, engine: Engine, name: str = "corvane", version: str = "1", code: str = "", secret: str | None = None, group: str | None = None, on_message: Callable | None = None):
        self.engine, self.name, self.version, self.code, self.secret, self.group = engine, name, version, code, secret, group
        self.on_message = on_message or (lambda messages: None)
        self.began = time.time()

    def root(self) -> dict:
        return {"name": self.name, "version": self.version}

    def health(self) -> dict:
        return {"status": "ok", "uptime_seconds": round(time.time() - self.began, 1), "version": self.version}

    def ready(self) -> dict:
        parts = self.engine.ready()
        return {"status": "ready" if parts.pop("ready") else "not_ready", "version": self.version, "indexes": parts}

    def query(self, body: dict) -> tuple[int, dict]:
        """Answer one question, or say which field is out of its limits."""
        began = time.time()
        raw = self.engine.spark.createDataFrame([(json.dumps(body),)], "value string").select(F.from_json("value", REQUEST).alias("r")).select("r.*")
        asked = serving.requests(raw).first()
        if asked is None or asked["error"]:
            return 422, {"detail": asked["error"] if asked else "body"}
        row = [(1, asked["user_id"], asked["query"], asked["model_filter"] or None)]
        own = self.engine.spark.createDataFrame(row, "query_id long, user_id string, query string, facet string")
        got = self.engine.answer(own, asked["top_k"]).first().asDict(recursive=True)
        return 200, {"answer": got["answer"], "sources": got["sources"], "status": got["status"], "latency": round(time.time() - began, 3)}

    def callback(self, text: str) -> str:
        """Reply to a callback; its message, if it has one, goes on."""
        raw = self.engine.spark.createDataFrame([(text,)], "value string")
        row = serving.replies(raw, self.code, secret=self.secret, group=self.group).first()
        if row["process"]:
            self.on_message(serving.incoming(raw, secret=self.secret, group=self.group).withColumn("t", F.unix_timestamp()))
        return row["reply"]

    def handle(self, method: str, path: str, body: str = "") -> tuple[int, dict[str, str], str]:
        """Status, headers and body of a request."""
        began = time.time()
        status, out = 404, json.dumps({"detail": "not found"})
        if method == "GET" and path in ("/", "/health", "/ready"):
            status, out = 200, json.dumps({"/": self.root, "/health": self.health, "/ready": self.ready}[path](), ensure_ascii=False)
        elif method == "POST" and path == "/callback":
            status, out = 200, json.dumps(self.callback(body))
        elif method == "POST" and path == "/query":
            try:
                asked = json.loads(body)
            except ValueError:
                asked = None
            status, reply = self.query(asked) if isinstance(asked, dict) else (422, {"detail": "body"})
            out = json.dumps(reply, ensure_ascii=False)
        return status, {"Content-Type": "application/json; charset=utf-8", "X-Process-Time": f"{time.time() - began:.3f}"}, out


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            status, headers, body = service.handle(self.command, self.path.split("?")[0], self.rfile.read(length).decode("utf-8", "replace"))
            data = body.encode()
            self.send_response(status)
            for k, v in {**headers, "Content-Length": str(len(data))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
