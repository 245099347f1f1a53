"""Fetching from a local server, targets that are due, and panel status."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from chronolith.shape import status
from chronolith.sources import pacing, scrape
from chronolith.streaming.ingest import samples_of


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        n = self.path.removeprefix("/hop")
        if self.path == "/metrics" or n == "0":
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"x 1\n")
        elif n.isdigit():
            self.send_response(302)
            self.send_header("Location", f"/hop{int(n) - 1}")
            self.end_headers()
        else:
            self.send_response(503)
            self.end_headers()

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(server):
    assert scrape.fetch_text(f"{server}/hop3", 5) == "x 1\n"
    for url, error in ((f"{server}/hop4", "too many redirects"), (f"{server}/no", "unexpected status 503"), ("ftp://x/", "unsupported target URL protocol: ftp:"), ("nope", "invalid target URL")):
        with pytest.raises(scrape.ScrapeError, match=error):
            scrape.fetch_text(url, 5)


def test_scrape(spark, server):
    targets = [{"job": "a", "url": f"{server}/metrics"}, {"job": "b", "url": f"{server}/no"}]
    got = scrape.scrape(scrape.targets_frame(spark, targets)).cache()
    assert {(r.job, r.up, r.text) for r in got.collect()} == {("a", True, "x 1\n"), ("b", False, None)}
    names = sorted((r.labels["job"], r.labels["__name__"], r.value) for r in samples_of(got).collect() if "duration" not in r.labels["__name__"])
    assert names == [("a", "scrape_samples_scraped", 1), ("a", "up", 1), ("a", "x", 1), ("b", "scrape_samples_scraped", 0), ("b", "up", 0)]


def test_due():
    targets = [{"job": "a", "url": "u", "interval_seconds": 1}, {"job": "b", "url": "v", "interval_seconds": 60}, {"job": "c", "url": "w", "enabled": False}]
    assert [t["job"] for t in scrape.due(targets, {}, 0)] == ["a", "b"]
    assert [t["job"] for t in scrape.due(targets, {"u": 0, "v": 0}, 4999)] == []
    assert [t["job"] for t in scrape.due(targets, {"u": 0, "v": 0}, 5000)] == ["a"]


def test_status():
    h = status.Health
    assert [status.unavailable(x).title for x in (None, h(store_open=False), h(engine_ready=False), h(ingest_error="e"), h(down=2), h(stale=1), h(targets=1, pending=1), h())] == ["The store is being opened", "The store is closed", "Queries can't run yet", "Samples aren't being stored", "Targets are down", "Targets are silent", "No scrape has ended yet", "Nothing found"]
    assert status.no_data(h(down=2)).detail == "Failed in their last scrape: 2." and status.query_error(ValueError("x")).detail == "x"


def test_schedule_has_no_overlap_and_drops_stale_results():
    schedule = scrape.Schedule([{"job": "a", "url": "u", "interval_seconds": 5}, {"job": "b", "url": "v", "interval_seconds": 60}])
    first = schedule.begin(0)
    assert [t["job"] for t, _ in first] == ["a", "b"] and schedule.begin(9000) == []  # both still run
    assert schedule.end(first[0][0], first[0][1]) and [t["job"] for t, _ in schedule.begin(9500)] == ["a"]
    schedule.replace([{"job": "b", "url": "v", "interval_seconds": 60}])
    assert not schedule.end(first[1][0], first[1][1])  # of the targets before
    assert [t["job"] for t, _ in schedule.begin(10_000)] == ["b"]


def test_pacing():
    assert [pacing.COMPACTION.following(128, ms) for ms in (200, 62, 40, 10, 0, float("nan"))] == [64, 128, 128, 160, 128, 128]
    assert pacing.COMPACTION.following(9999, 10) == 512 and pacing.COMPACTION.following(300, 500, least=256) == 256
    assert [pacing.VACUUM.following(64, ms) for ms in (100, 10)] == [25, 80]
    hour = 3_600_000
    assert [pacing.point_floor(a, q) for a, q in ((8 * hour, 10**6), (5 * hour, 10**6), (hour, 10**6), (8 * hour, 3000))] == [512, 256, 64, 64]
    assert [pacing.pause_ms(a, q, w) for a, q, w in ((0, 10**6, 0), (5 * hour, 10**6, 0), (8 * hour, 10**6, 0), (0, 0, 0), (0, 0, 101))] == [500, 400, 250, 750, 1000]
