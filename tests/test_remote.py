"""The archive source over a local server: failures, retries, repeats, what is there already."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from aeropanel.sources import remote


def payload(site, year):
    hours = [f"{year}-01-01T{h:02}:00" for h in range(3)]
    return json.dumps({"hourly": {"time": hours, "temperature_2m": [1.0, None, 3.0], "surface_pressure": [1000.0] * 3, "wind_speed_10m": [2.0, 0.0, 4.0], "wind_direction_10m": [90.0, 0.0, 180.0], "precipitation": [0.0] * 3, "boundary_layer_height": [float(len(site))] * 3}}).encode()


@pytest.fixture
def server():
    asked, lock = [], threading.Lock()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.strip("/")
            with lock:
                asked.append(name)
                n = asked.count(name)
            site, year = name.split("_")
            code = 404 if site == "gone" else 503 if site == "busy" and n < 3 or site == "down" and not self.server.up else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(payload(site, year) if code == 200 else b"")

        def log_message(self, *_):
            pass

    at = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    at.up, at.asked = False, asked
    threading.Thread(target=at.serve_forever, daemon=True).start()
    yield at
    at.shutdown()


def test_pulls(spark, tmp_path, server):
    url, path = f"http://127.0.0.1:{server.server_port}/{{site}}_{{year}}", f"{tmp_path}/raw"
    wanted = spark.createDataFrame([(s, y) for s in ("aa", "busy", "down", "gone") for y in (2019, 2020)] + [("aa", 2019)], "site string, year int")
    pull = lambda: sorted(map(tuple, remote.pull(spark, url, wanted, path, wait="0", grow="0").collect()))
    assert pull() == [("down", 2019, "HTTP 503"), ("down", 2020, "HTTP 503"), ("gone", 2019, "HTTP 404"), ("gone", 2020, "HTTP 404")]
    assert {n: server.asked.count(n) for n in set(server.asked)} == {**{f"aa_{y}": 1 for y in (2019, 2020)}, **{f"busy_{y}": 3 for y in (2019, 2020)}, **{f"down_{y}": 4 for y in (2019, 2020)}, **{f"gone_{y}": 1 for y in (2019, 2020)}}
    server.up = True
    del server.asked[:]
    assert [r[0] for r in pull()] == ["gone", "gone"] and set(server.asked) == {"down_2019", "down_2020", "gone_2019", "gone_2020"}  # the rest is there
    rows = remote.hourly_weather(spark, path).where("site = 'busy' and year = 2020").orderBy("ts").collect()
    assert [(str(r["ts"]), r["t2m_c"], r["blh"]) for r in rows] == [("2020-01-01 00:00:00", 1.0, 4.0), ("2020-01-01 01:00:00", None, 4.0), ("2020-01-01 02:00:00", 3.0, 4.0)]
    assert remote.hourly_weather(spark, path).count() == 3 * 6
    assert rows[0]["u10"] == pytest.approx(-2.0) and rows[2]["v10"] == pytest.approx(4.0)


def test_partitions_and_options(spark):
    reader = remote.Archive({"files": '[["a", 2019], ["b", "2020"]]', "url": "file:///no/such/{site}", "wait": "0", "grow": "0"}).reader(None)
    assert [p.value for p in reader.partitions()] == [("a", 2019), ("b", 2020)]
    row = next(reader.read(reader.partitions()[0]))
    assert row[:4] == ("a", 2019, "file:///no/such/a", None) and "No such file" in row[4]
    with pytest.raises(ValueError):
        remote.Archive({"files": "[]", "url": "x", "retries": "0"}).reader(None)
