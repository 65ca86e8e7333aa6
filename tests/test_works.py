"""The works source against a local server that fails, stalls and repeats."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from inkwell.sources import works as W


@pytest.fixture()
def server():
    seen, broken = [], {"down"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            topic, size, offset = q.get("query") or q.get("q"), int(q.get("rows") or q.get("limit")), int(q["offset"])
            first = (topic, offset) not in [s[:2] for s in seen]
            seen.append((topic, offset, size))
            status, body = 200, json.dumps({"message": {"items": [self.item(topic, i) for i in range(offset, min(offset + size, 40))]}})
            if topic in broken:
                status = 500
            elif topic == "busy" and first:
                status = 429
            elif topic == "odd":
                body = "<html>"
            elif topic == "none":
                status = 404
            elif "archive" in self.path:
                body = json.dumps({"results": [{"title": "T", "authors": [{"name": "Turing, Alan"}, {"name": "Ada King Lovelace"}], "yearPublished": 1950, "doi": "10.1/x"}, {"title": None}]})
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(body.encode())

        @staticmethod
        def item(topic, i):
            return {"title": [] if i % 5 == 4 else [f" {topic} {i} "], "author": [{"given": "A", "family": "B"}, {}], "issued": {"date-parts": [[2000 + i]]}, "DOI": f"10.1/{topic}{i}" if i % 2 else "", "type": "article"}

        def log_message(self, *a):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", seen, broken
    httpd.shutdown()


FAST = {"pause": 0, "attempts": 2}


def test_pages_are_clamped_and_untitled_works_dropped(spark, server):
    url, seen, _ = server
    rows = W.search(spark, url, ["graphs", " graphs ", "", "busy"], pages=2, rows=99, **FAST).collect()
    assert {s[2] for s in seen} == {25} and {s[1] for s in seen} == {0, 25}
    by = {}
    for r in rows:
        by.setdefault((r.topic, r.page), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {("graphs", 0): 20, ("graphs", 1): 12, ("busy", 0): 20, ("busy", 1): 12}
    one = by["graphs", 0][1]
    assert (one.title, one.year, one.doi, [tuple(a) for a in one.authors], one.error) == ("graphs 1", "2001", "10.1/graphs1", [("A", "B")], None)
    assert [W.clamp_rows(n) for n in (-3, 0, 1, 25, 26)] == [1, 1, 1, 25, 25]


def test_a_page_that_fails_is_a_row(spark, server):
    url, _, broken = server
    broken.remove("down")
    broken.add("gone")
    got = {r.topic: r for r in W.search(spark, url, ["gone", "odd", "none"], **{**FAST, "attempts": 1}).collect()}
    assert got["gone"].error == "Error: status 500" and got["none"].error == "Error: status 404" and got["odd"].error.startswith("Error: invalid answer")
    assert got["gone"].title is None
    lost = W.search(spark, "http://127.0.0.1:9", ["x"], **{**FAST, "attempts": 1}).collect()
    assert len(lost) == 1 and lost[0].error.startswith("Error: not reached")


def test_sweep_resumes_without_repeats(spark, server, tmp_path):
    url, seen, broken = server
    folder = str(tmp_path / "sweep")
    options = {"rows": 10, **FAST, "attempts": 1}
    first = W.sweep(spark, url, ["a", "down"], folder, pages=2, **options)
    assert first.where("error IS NOT NULL").count() == 2 and first.where("topic = 'a'").count() == 16
    broken.clear()
    before = len(seen)
    second = W.sweep(spark, url, ["a", "down", "b"], folder, pages=2, **options)
    assert sorted(s[:2] for s in seen[before:]) == [("b", 0), ("b", 10), ("down", 0), ("down", 10)]
    assert second.where("error IS NOT NULL").count() == 0
    assert second.count() == second.select("topic", "page", "place").distinct().count() == 48
    assert W.sweep(spark, url, ["a", "b"], folder, pages=2, **options).count() == 48 and len(seen) == before + 4


def test_archive_form_and_repeated_works(spark, server):
    url, _, _ = server
    rows = W.search(spark, f"{url}/archive", ["x", "y"], form="archive", token="t", **FAST)
    assert rows.count() == 2
    got = W.works(rows).collect()
    assert len(got) == 1 and got[0].topic == "x" and [tuple(a) for a in got[0].authors] == [("Alan", "Turing"), ("Ada King", "Lovelace")] and got[0].year == "1950"
    with pytest.raises(Exception, match="form is one of"):
        W.search(spark, url, ["x"], form="other").collect()
