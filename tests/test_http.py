import io
import json

import pytest

from weftgraph import service_http
from weftgraph.operators import service


@pytest.fixture(scope="module")
def app(spark):
    nodes = spark.createDataFrame([("人物", "郭靖", "射雕"), ("人物", "黄蓉", "神雕"), ("人物", "黄药师", "射雕")], "label string, name string, era string")
    rows = [("SPOUSE_OF", "人物", "郭靖", "人物", "黄蓉"), ("PARENT_OF", "人物", "黄药师", "人物", "黄蓉")]
    edges = spark.createDataFrame([(*r, ["c1"]) for r in rows], "type string, src_label string, src string, dst_label string, dst string, chunk_ids array<string>")
    return service_http.App(service.Engine(spark, nodes, edges, spark.createDataFrame([("c1", "黄蓉是黄药师的女儿。")], "chunk_id string, text string")))


def call(app, method, path, query="", body=None, size=None):
    said = []
    raw = body if isinstance(body, bytes) else json.dumps(body).encode() if body is not None else b""
    environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(raw) if size is None else size), "wsgi.input": io.BytesIO(raw)}
    data = b"".join(app(environ, lambda status, headers: said.append(status)))
    return int(said[0].split()[0]), json.loads(data)


def test_answers(app):
    status, found = call(app, "POST", "/api/qa", body={"question": "郭靖的岳父是谁", "top_k": 3})
    assert status == 200 and found["method"] == "person_relation" and found["path"]["nodes"] == ["郭靖", "黄蓉", "黄药师"]
    assert {n["id"] for n in found["subgraph"]["nodes"]} == {"郭靖", "黄蓉", "黄药师"}
    assert call(app, "POST", "/api/ask_auto", body={"question": "郭靖的妻子是谁"})[1]["lines"] == ["郭靖 -> 黄蓉"]
    assert call(app, "POST", "/api/ask", body={"question": "黄蓉", "method_name": "fulltext"})[1]["method"] == "fulltext"


def test_graphs(app):
    _, near = call(app, "GET", "/api/node/neighbor", "nodeId=%E9%BB%84%E8%93%89")
    assert {e["id"] for e in near["edges"]} == {"郭靖|SPOUSE_OF|黄蓉", "黄药师|PARENT_OF|黄蓉"}
    assert len(call(app, "GET", "/api/graph/byera", "")[1]["edges"]) == 2
    assert "vector" in call(app, "GET", "/api/methods")[1]["methods"] and call(app, "GET", "/api/health")[1]["graph"] == "ok"


@pytest.mark.parametrize("args,status,code", [
    (("GET", "/api/none"), 404, "not_found"), (("GET", "/api/node/neighbor"), 400, "invalid_request"), (("POST", "/api/ask", "", {"question": ""}), 400, "invalid_request"),
    (("POST", "/api/ask", "", {"question": "x", "method_name": "none"}), 400, "invalid_method"), (("POST", "/api/ask", "", {"question": "x", "top_k": 99}), 400, "invalid_request"),
    (("POST", "/api/ask", "", b"{"), 400, "invalid_json"), (("POST", "/api/ask", "", [1]), 400, "invalid_request"), (("POST", "/api/ask", "", b"", 1 << 20), 413, "payload_too_large"),
])
def test_errors(app, args, status, code):
    got, found = call(app, *args)
    assert (got, found["error"]["code"]) == (status, code)
