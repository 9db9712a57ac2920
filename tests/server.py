"""A local search and lookup service for tests; it counts what is asked of it."""

import json
import threading
import time
import urllib.parse
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class Service:
    def __init__(self):
        self.records, self.asked, self.connections, self.under_way, self.most_under_way, self.bodies, self.lock = [], [], 0, 0, 0, {}, threading.Lock()

    def found(self, query):
        """Records of a query: every SRC group in it narrows."""
        import re

        out = self.records
        for group in re.findall(r"\(((?:SRC:\"?\w+\"?(?: OR )?)+)\)", query):
            wanted = {w.lower() for w in re.findall(r"SRC:\"?(\w+)", group)}
            out = [r for r in out if (r.get("source") or "").lower() in wanted]
        return out

    def search(self, q):
        size, at = int(q["pageSize"]), 0 if q["cursorMark"] == "*" else int(q["cursorMark"][1:])
        rows = self.found(q["query"])
        part = rows[at : at + size]
        if q["resultType"] == "idlist":
            part = [{"id": r["id"]} for r in part]
        return {"hitCount": len(rows), "nextCursorMark": f"c{at + len(part)}", "resultList": {"result": part}}


@contextmanager
def serving(keep_alive=True):
    service = Service()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1" if keep_alive else "HTTP/1.0"

        def setup(self):
            super().setup()
            with service.lock:
                service.connections += 1

        def do_GET(self):
            parts = urllib.parse.urlsplit(self.path)
            q = dict(urllib.parse.parse_qsl(parts.query))
            with service.lock:
                service.asked.append((parts.path, q, self.headers["User-Agent"], time.monotonic()))
                service.under_way += 1
                service.most_under_way = max(service.most_under_way, service.under_way)
            try:
                status, body = self.answer(parts.path, q)
            finally:
                with service.lock:
                    service.under_way -= 1
            if status is None:  # reset
                self.connection.close()
                return
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def answer(self, path, q):
            if path == "/search":
                return 200, json.dumps(service.search(q))
            name = path.rsplit("/", 1)[1]
            if name.startswith("slow"):
                time.sleep(1.5)
            if name.startswith("reset"):
                return None, ""
            if name.startswith("wait"):
                time.sleep(0.05)
            return service.bodies.get(name, (404, "nothing"))

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    service.url = f"http://127.0.0.1:{server.server_port}"
    try:
        yield service
    finally:
        server.shutdown()
        server.server_close()
