import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera.__main__ import main, parse_size
from tessera.operators import costs
from tessera.sources import tables
from tessera.sources.http import FetchOptions, fetch_pages


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        body = f"<title> T </title><p>{self.headers['User-Agent']} {self.headers.get('Cookie', '')}</p><a href=/b#c>l</a><script>x</script>".encode()
        self.send_response(404 if self.path == "/missing" else 200)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(spark, site):
    urls = spark.createDataFrame([(f"{site}/a",), (f"{site}/missing",), ("http://127.0.0.1:1/",), (None,)], "url string")
    got = {r.url.rpartition("/")[2]: r for r in fetch_pages(urls, FetchOptions(user_agent="me", cookies={"k": "v"})).collect()}
    assert got["a"].title == "T" and got["a"].text == "me k=vl" and got["a"].links == [f"{site}/b#c"] and got["a"].status == 200 and got["a"].error is None
    assert got["missing"].status == 404 and got[""].error.startswith("fetch error") and len(got) == 3


def test_snapshots_and_files(spark, tmp_path):
    spark.createDataFrame([("u", "<p>x</p>", 200), ("v", "Robot or human?", 200), ("w", "", 200), ("x", "y", 500)], "url string, html string, status int").write.parquet(f"{tmp_path}/p")
    p = tables.read_pages(spark, f"{tmp_path}/p")
    assert {r.url for r in tables.usable(p).collect()} == {"u", "v"} and set(tables.PAGE_COLUMNS) <= set(p.columns)
    assert {r.url: r.error_kind for r in tables.fetch_errors(p).collect()} == {"u": None, "v": "anti-bot", "w": None, "x": "http-500"}
    (tmp_path / "a.html").write_text("<p>\n1</p>")
    assert tables.read_html_files(spark, f"{tmp_path}/a.html").first().html == "<p>\n1</p>"


def test_command_line(tmp_path, capsys, monkeypatch, site):
    f = tmp_path / "x.html"
    f.write_text("<p>a</p><script>b</script><p class=k>c</p>")
    main(["clean", str(f), "--remove", ".k", "--stats", "json"])
    o = capsys.readouterr()
    assert o.out == "<p>a</p>\n" and json.loads(o.err)["stats"]["elements_kept"] == 4
    monkeypatch.setattr("sys.stdin", io.StringIO("<h1>x</h1>"))
    main(["clean", "--output", "markdown"])
    assert capsys.readouterr().out == "# x\n"
    main(["compare", f"{site}/a"])
    assert capsys.readouterr().out.count("bytes") == 3
    f.write_text("")
    with pytest.raises(SystemExit):
        main(["clean", str(f)])
    with pytest.raises(SystemExit):
        main(["clean", f"{site}/missing"])


def test_sizes_and_models(spark):
    assert [parse_size(s) for s in ("100KB", "200", "1.5 MiB")] == [100_000, 200, 3 << 19]
    with pytest.raises(ValueError):
        parse_size("x")
    assert {r.model for r in costs.models(spark).filter("is_default").collect()} == {"gpt-4o", "claude-sonnet-4-20250514"}
