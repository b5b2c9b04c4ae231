"""An Engine behind HTTP, as a WSGI application of the standard library.

Every route gives JSON; errors are {"error": {"code", "message"}} under a status that says whose they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict
from urllib.parse import parse_qs

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import edge_key
from weftgraph.operators import answer, match, retrieval, service
from weftgraph.schema import BOOK_ERA, LABELS

MAX_BODY, NEIGHBOURS, MAX_TOP_K = 64 * 1024, 30, 50


class HttpError(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


def _bad(message: str) -> HttpError:
    return HttpError(400, "invalid_request", message)


class App:
    """Routes of one engine."""

    def __init__(self, engine: service.Engine):
        self.engine = engine
        self.routes: dict[tuple[str, str], Callable[[dict, dict], dict]] = {
            ("GET", "/api/methods"): lambda query, body: {"methods": sorted(answer.METHODS)},
            ("GET", "/api/health"): lambda query, body: engine.health(),
            ("POST", "/api/ask"): self._ask,
            ("POST", "/api/ask_auto"): lambda query, body: self._reply(body, None),
            ("POST", "/api/qa"): self._with_graph,
            ("GET", "/api/node/neighbor"): lambda query, body: self.neighbours(_one(query, "nodeId", True), _one(query, "era")),
            ("GET", "/api/graph/byera"): lambda query, body: self.graph_of(_one(query, "era")),
        }

    def __call__(self, environ: dict, start_response: Callable) -> Iterable[bytes]:
        method = environ.get("REQUEST_METHOD", "GET")
        try:
            if method == "OPTIONS":
                status, payload = 200, {}
            else:
                route = self.routes.get((method, environ.get("PATH_INFO", "/")))
                if route is None:
                    raise HttpError(404, "not_found", "no such route")
                status, payload = 200, route(parse_qs(environ.get("QUERY_STRING", "")), _body(environ) if method == "POST" else {})
        except HttpError as e:
            status, payload = e.status, {"error": {"code": e.code, "message": str(e)}}
        except service.RequestError as e:
            status, payload = 400, {"error": {"code": "invalid_request", "message": str(e)}}
        except (retrieval.Unavailable, retrieval.EmbeddingError, PySparkException) as e:
            status, payload = 503, {"error": {"code": "data_unavailable", "message": str(e).split("\n", 1)[0]}}
        except Exception as e:  # a server does not end with a request
            status, payload = 500, {"error": {"code": "internal_error", "message": f"{type(e).__name__}: {e}"}}
        data = json.dumps(payload, ensure_ascii=False).encode()
        headers = [("Content-Type", "application/json; charset=utf-8"), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")]
        start_response(f"{status} {'OK' if status < 400 else 'ERROR'}", [*headers, ("Content-Length", str(len(data)))])
        return [data]

    def _ask(self, query: dict, body: dict) -> dict:
        method = body.get("method_name", "vector")
        if method not in answer.METHODS:
            raise HttpError(400, "invalid_method", f"unknown method {method}")
        return self._reply(body, method)

    def _reply(self, body: dict, method: str | None) -> dict:
        k = body.get("top_k", 5)
        if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MAX_TOP_K:
            raise _bad(f"top_k is a whole number from 1 to {MAX_TOP_K}")
        return asdict(self.engine.ask(body.get("question"), method, k))

    def _with_graph(self, query: dict, body: dict) -> dict:
        """An answer with the neighbours of what it is about and the path that it names."""
        reply = self._reply(body, None)
        path = list(dict.fromkeys(name for line in reply["lines"] for name in line.split(" -> "))) if reply["method"] not in ("vector", "fulltext") else []
        graph = self.neighbours(reply["seed"], body.get("era") or "") if reply["seed"] else {"nodes": [], "edges": []}
        known = {n["id"] for n in graph["nodes"]}
        graph["nodes"] += [{"id": n, "label": n, "type": "", "era": ""} for n in path if n not in known]
        return reply | {"subgraph": graph, "path": {"nodes": path or [reply["seed"]] * bool(reply["seed"]), "edges": [list(p) for p in zip(path, path[1:], strict=False)]}}

    def neighbours(self, name: str, era: str = "") -> dict:
        """At most NEIGHBOURS edges at a node, in their true direction."""
        near = match.neighbours_any_era(self.engine.nodes, self.engine.edges, name, BOOK_ERA.get(era, era) or None)
        near = near.where((F.col("type") != "MENTIONS") & F.col("src_label").isin(*LABELS) & F.col("dst_label").isin(*LABELS))
        return payload(with_edge_ids(near).orderBy("type", "src", "dst").limit(NEIGHBOURS).collect())

    def graph_of(self, era: str = "") -> dict:
        """The nodes of highest degree of an era, and the edges among them."""
        wanted = BOOK_ERA.get(era, era)
        edges = match.scoped_edges(self.engine.nodes, self.engine.edges, [wanted] if wanted else None)
        top = match.capped_subgraph(edges).join(edges.select("src", "type", "dst", "src_label", "dst_label").distinct(), ["src", "type", "dst"])
        return payload(with_edge_ids(top).collect())


def payload(edges: list) -> dict:
    """Rows (id, src, type, dst, src_label, dst_label) as nodes and edges, each once."""
    nodes: dict[str, dict] = {}
    found: dict[str, dict] = {}
    for e in edges:
        for name, label in ((e["src"], e["src_label"]), (e["dst"], e["dst_label"])):
            nodes.setdefault(name, {"id": name, "label": name, "type": label or "", "era": ""})
        found.setdefault(e["id"], {"id": e["id"], "from": e["src"], "to": e["dst"], "label": (service.NAMES | service.CALLED_IN["page"]).get(e["type"], e["type"]), "rel": e["type"]})
    return {"nodes": list(nodes.values()), "edges": list(found.values())}


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """edges (src, type, dst) with their stable id."""
    return edges.withColumn("id", edge_key(F.col("src"), F.col("type"), F.col("dst")))


def _one(query: dict, name: str, needed: bool = False) -> str:
    value = (query.get(name) or [""])[0]
    if needed and not value:
        raise _bad(f"{name} is missing")
    return value


def _body(environ: dict) -> dict:
    try:
        size = int(environ.get("CONTENT_LENGTH") or 0)
    except ValueError as e:
        raise _bad("Content-Length is no number") from e
    if size > MAX_BODY:
        raise HttpError(413, "payload_too_large", f"more than {MAX_BODY} bytes")
    try:
        data = json.loads(environ["wsgi.input"].read(size) or b"{}") if size else {}
    except ValueError as e:
        raise HttpError(400, "invalid_json", str(e)) from e
    if not isinstance(data, dict):
        raise _bad("the body has to be a JSON object")
    return data


def serve(engine: service.Engine, host: str = "127.0.0.1", port: int = 8000) -> None:
    """Answer requests until interrupted."""
    from wsgiref.simple_server import make_server

    with make_server(host, port, App(engine)) as server:
        server.serve_forever()
