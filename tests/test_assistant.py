import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tabloom.plans import assistant as A
from tabloom.plans.facts import ColumnFacts
from tabloom.plans.ontology import default

COLUMNS = [ColumnFacts("c0", 0, "Назва", text_share=1.0, samples=["А"]), ColumnFacts("c1", 1, "Електронна пошта", detectors={"email": 1.0})]


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
        answer = {"subject": "Company", "entities": [{"key": "co", "schema": "Company", "keys": ["c0", "c9"]}, {"key": "x", "schema": "Nope", "keys": []}]}
        if A.stage_of(prompt) == "binding":
            answer = {"c1": {"prop": "Company:email", "entity": "co"}, "c0": {"prop": "Company:nothing", "entity": "co"}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"content": json.dumps(answer)}).encode())

    def log_message(self, *args):
        pass


def test_answers_are_closed_cached_and_replayed(tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = A.LocalModel(f"http://127.0.0.1:{server.server_port}", tmp_path)
    plan = A.propose_with(model, COLUMNS, default())
    server.shutdown()
    assert [(e.key, e.keys) for e in plan.entities] == [("co", ["c0"])]
    assert [(b.column, b.prop, b.type_name) for b in plan.bindings] == [("c1", "Company:email", "email")]
    assert {d.column: d.verdict for d in plan.decisions} == {"c0": "unmapped", "c1": "accepted"}
    again = A.LocalModel(model.url, tmp_path, replay=True)
    assert A.propose_with(again, COLUMNS, default()) == plan and again.counters["structure"] == {"live": 0, "replayed": 1}
    with pytest.raises(LookupError):
        again.ask("[repair] other", {"enum": []})


def test_only_this_machine_is_asked(tmp_path):
    with pytest.raises(A.NotLocal):
        A.LocalModel("http://example.org", tmp_path)


def test_answers_are_pruned():
    g = {"type": "object", "properties": {"a": {"enum": ["x"]}, "b": {"type": "array", "items": {"enum": [1]}}}, "required": ["a"]}
    assert A.prune({"a": "x", "b": [1, 2], "c": 3}, g) == {"a": "x", "b": [1]} and A.prune({"a": "y"}, g) is None and A.prune([], g) is None
