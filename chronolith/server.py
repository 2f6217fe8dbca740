"""A small HTTP service over the engine: JSON in and out, bearer tokens, rate limit, request ids, audit, metrics.

One engine serves all requests: reads run side by side, at most ``PERMITS`` of them, writes one after the other, and each has ``TASK_MS`` to answer.
This is a service shell and adds no query capability.
"""

from __future__ import annotations

import dataclasses
import hmac
import json
import re
import threading
import time
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from chronolith.engine import InvalidInput, MemoryEngine, Query
from chronolith.operators.maintenance import audit_recent
from chronolith.providers import ProviderError
from chronolith.store import StoreError

# Limits of the service.
MAX_BODY, MAX_TOKENS, WINDOW_MS, MAX_REQUESTS = 1 << 20, 8_000, 60_000, 600
MAX_BATCH, PERMITS, TASK_MS = 10_000, 32, 30_000
#: Which error gives which status; the first that fits.
STATUS = [(InvalidInput, 400), (StoreError, 409), (TimeoutError, 504), (ProviderError, 502), ((TypeError, KeyError, ValueError), 400), (Exception, 500)]
_REQUEST_ID = re.compile(r"[A-Za-z0-9._-]{1,128}")


class RateLimit:
    """A fixed window for each actor that opens with its first request; 0 allows everything."""

    def __init__(self, most: int = MAX_REQUESTS, window_ms: int = WINDOW_MS):
        self.most, self.window_ms = most, window_ms
        self.windows: dict[str, tuple[int, int]] = {}

    def check(self, actor: str, now: int) -> int:
        """0 if the request may pass, else the seconds to wait."""
        if not self.most:
            return 0
        if len(self.windows) > 4096:
            self.windows = {a: w for a, w in self.windows.items() if w[0] >= now - 2 * self.window_ms}
        opened, count = self.windows.get(actor, (now, 0))
        if now - opened >= self.window_ms:
            opened, count = now, 0
        if count >= self.most:
            return (max(self.window_ms - (now - opened), 1) + 999) // 1000
        self.windows[actor] = opened, count + 1
        return 0


class Service:
    def __init__(self, engine: MemoryEngine, tokens: dict[str, str] | None = None, most: int = MAX_REQUESTS, permits: int = PERMITS, task_ms: int = TASK_MS):
        """``tokens``: bearer token -> actor; without any, every caller is ``anonymous``."""
        provider = getattr(engine.distiller, "provider", None)
        if provider is not None and (1 + engine.distiller.max_repairs) * getattr(provider, "timeout_s", 0) * 1000 > task_ms:
            raise InvalidInput("a provider's call and its repairs must fit into the time of one request")
        self.engine, self.tokens, self.limit, self.task_ms = engine, tokens or {}, RateLimit(most), task_ms
        self.counts: Counter = Counter()
        self.lock, self.writing, self.permits = threading.Lock(), threading.Lock(), threading.BoundedSemaphore(permits)
        self.tasks = ThreadPoolExecutor(permits, "request")

    def actor(self, header: str | None) -> str | None:
        if not self.tokens:
            return "anonymous"
        given = (header or "").removeprefix("Bearer ").encode()
        found = [name for token, name in self.tokens.items() if hmac.compare_digest(token.encode(), given)]
        return found[0] if found else None

    def handle(self, method: str, path: str, body: dict[str, Any], auth: str | None) -> tuple[int, Any, dict[str, str]]:
        """(status, body, headers) of a request."""
        action = path.strip("/").removeprefix("v1/").replace("/", "_") or "root"
        self._count("requests", action)
        if path == "/livez":
            return 200, {"status": "ok"}, {}
        if path == "/readyz":
            return self._ready()
        who = self.actor(auth)
        if who is None:
            self._count("status", "401")
            return 401, {"error": "missing or unknown bearer token"}, {"WWW-Authenticate": "Bearer"}
        with self.lock:
            wait = self.limit.check(who, int(time.time() * 1000))
        if wait:
            self._count("rate_limited", action)
            return 429, {"error": "too many requests"}, {"Retry-After": str(wait)}
        if not self.permits.acquire(blocking=False):
            self._count("status", "503")
            return 503, {"error": "too many requests are being answered"}, {"Retry-After": "1"}
        began = time.monotonic()
        task = self.tasks.submit(self._run, method, path, body)
        try:
            status, out = task.result(self.task_ms / 1000)
        except Exception as e:
            status = next(code for kind, code in STATUS if isinstance(e, kind))
            out = {"error": str(e) or ("the request took too long" if status == 504 else type(e).__name__)}
        self._count("status", str(status))
        with self.lock:
            self.counts["route_status", f"{method} {action} {status}"] += 1
            self.counts["route_ms", action] += int(1000 * (time.monotonic() - began))
        if method == "POST":
            with self.writing:
                self.engine.audit(who, action, "ok" if status < 400 else "error", path, status)
        return status, out, {}

    def _count(self, what: str, name: str) -> None:
        with self.lock:
            self.counts[what, name] += 1

    def _ready(self) -> tuple[int, Any, dict[str, str]]:
        """Whether the store can be read."""
        try:
            return 200, {"status": "ok", "version": self.engine.store.manifest["version"], "ledger": bool(self.engine.store.read("ledger").columns)}, {}
        except Exception as e:
            return 503, {"status": "unavailable", "error": str(e)}, {}

    def _run(self, method: str, path: str, body: dict[str, Any]) -> tuple[int, Any]:
        """A task of its own: it keeps its permit until it ends, also when nobody waits for it any more."""
        try:
            if method == "POST" and path != "/v1/query":
                with self.writing:
                    return self._route(method, path, body)
            return self._route(method, path, body)
        finally:
            self.permits.release()

    def _route(self, method: str, path: str, body: dict[str, Any]) -> tuple[int, Any]:
        e = self.engine
        match method, path:
            case "GET", "/v1/health":
                return 200, e.health()
            case "GET", "/v1/stats":
                return 200, e.stats()
            case "GET", "/v1/metrics":
                return 200, {f"{a}_{b}": n for (a, b), n in sorted(self.counts.items())}
            case "GET", "/v1/metrics/prometheus":
                return 200, "".join(f'chronolith_{a}_total{{name="{b}"}} {n}\n' for (a, b), n in sorted(self.counts.items()))
            case "GET", "/v1/audit":
                return 200, [r.asDict() for r in audit_recent(e.store.read("audit"), 100).collect()]
            case "POST", "/v1/remember":
                out = e.remember(body["text"], body.get("kind", "fact"), body.get("tenant_id", "local"), body.get("project_id", "default"), body.get("environment_id"), idempotency_key=body.get("idempotency_key"))
                return 200, out | (e.project() if body.get("project", True) else {})
            case "POST", "/v1/manage" | "/v1/project":
                limit = body.get("limit", 1_000)
                if not isinstance(limit, int) or not 0 < limit <= MAX_BATCH:
                    raise InvalidInput(f"limit must be between 1 and {MAX_BATCH}")
                return 200, e.project(limit=limit)
            case "POST", "/v1/rebuild":
                return 200, e.rebuild()
            case "POST", "/v1/query":
                names = {f.name for f in dataclasses.fields(Query)}
                if set(body) - names:
                    raise InvalidInput(f"unknown fields {sorted(set(body) - names)}")
                query = Query(**body)
                if query.max_tokens > MAX_TOKENS:
                    raise InvalidInput(f"max_tokens must be at most {MAX_TOKENS}")
                policy = getattr(e.policy, "provider", None)
                if policy is not None and query.reconstruction != "off" and getattr(policy, "timeout_s", 0) * 1000 * query.max_steps >= self.task_ms:
                    raise InvalidInput("the provider's timeout for all steps must be less than the time of one request")
                answer = dataclasses.asdict(e.ask(query))
                self._count("query_tier", answer["tier_used"])
                with self.lock:
                    self.counts["query_tokens", answer["tier_used"]] += answer["token_estimate"]
                return 200, answer
            case "POST", "/v1/maintenance":
                return 200, e.maintenance(**body)
        return 404, {"error": f"no route {method} {path}"}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound and not started; call serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            given = self.headers.get("X-Request-Id", "")
            request = given if _REQUEST_ID.fullmatch(given) else uuid.uuid4().hex
            size = int(self.headers.get("Content-Length") or 0)
            try:
                if size > MAX_BODY:
                    status, out, more = 413, {"error": "body too large"}, {}
                else:
                    body = json.loads(self.rfile.read(size) or b"{}") if size else {}
                    if not isinstance(body, dict):
                        raise ValueError("body must be an object")
                    status, out, more = service.handle(method, self.path.split("?")[0], body, self.headers.get("Authorization"))
            except ValueError as e:
                status, out, more = 400, {"error": str(e)}, {}
            text = out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)
            self.send_response(status)
            for name, value in ({"Content-Type": "text/plain" if isinstance(out, str) else "application/json", "X-Request-Id": request} | more).items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(text.encode())

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
