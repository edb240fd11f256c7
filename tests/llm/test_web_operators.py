"""URL filters and WARC archives."""

import base64
import gzip
import hashlib
import random

import pytest


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:k], rest[k:]
    k = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:k]


def _judge(url, rules):
    host, path = _parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("sweep_rows", [50_000, 7])
def test_url_filter(spark, sweep_rows):
    from txnwatch.llm.url_filter import judge_urls
    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "example", "org", "com", "é"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: rng.choice(["", "/"]) + "/".join(rng.choice(["a", "ab", "fr", "1", "ÿ"]) for _ in range(rng.randrange(4)))
    rules = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(80)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("", "/", "block"), (None, "/", "block"), ("a", None, "block")]
    urls = [None, "", "no scheme", "http://", "http:///x", "http://A.Example.ORG/Fr?x", "x://y://z/", "http://org#f/a", "http://org.", "http://.org/", "http://a..b/a", "http://com\n/fr/"]
    urls += [f"http://{host().upper()}{path()}{rng.choice(['', '?q=/a', '#/b'])}" for _ in range(400)] + ["http://a.example.org/fr/1"] * 300
    df = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, site string")
    got = {r.page_id: r for r in judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), sweep_rows=sweep_rows).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == _judge(u, rules), u
    assert len({got[i].rule for i in got}) > 12
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in judge_urls(df, none, default="block").collect()} == {(None, "block")}
    assert judge_urls(df.limit(0), none).count() == 0


def test_native_queries_run_no_python(spark):
    import io
    from contextlib import redirect_stdout

    from txnwatch.llm.queries import QUERIES
    for name in ("op1_line_dedup", "op3_url_filter"):
        out = io.StringIO()
        with redirect_stdout(out):
            QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
        assert not [w for w in ("Python", "Pandas", "InArrow", "Cartesian", "NestedLoop") if w in out.getvalue()], name


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>y é</p>"), (3, None, "<p>x</p>"), (4, "http://a/\r\nEvil: 1%41", None), (5, "http://a/5", ""),
         (None, "http://a/6", "<p>x</p>"), (None, "u", "alone"), (1, "http://a/1", "<p>x</p>"), (9, "http://a/9", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (10, "b", "z" * 300_000)]


def _pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)


def _digest(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    from txnwatch.llm import warc
    path = str(tmp_path / "archive")
    warc.write_archive(warc.with_revisits(_pages(spark)), path)
    got = warc.read_archive(spark, path, verify=True).collect()
    assert len(got) == len(PAGES)
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = sorted(str((i, u, least.get(h or "") if i != least.get(h or "", i) else None, len((h or "").encode()), _digest(h))) for i, u, h in PAGES)
    assert sorted(str((r.page_id, r.url, r.refers_to, r.payload_bytes, r.payload_digest)) for r in got) == want
    for r in got:
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        assert (r.payload is None) == (r.record_type == "revisit")
    assert {r.payload for r in got} == {None, *[h or "" for _, _, h in PAGES]}


def test_warc_pushdown_skips_payloads(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains
    from txnwatch.llm import warc
    path = str(tmp_path / "archive")
    warc.write_archive(warc.with_revisits(_pages(spark)), path)
    table = warc.read_archive(spark, path)
    plan = table.filter("record_type = 'revisit' and page_id > 2")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert sorted(r.page_id for r in table.filter("record_type = 'revisit' and page_id > 2").collect()) == [3, 5]
    assert sorted(r.page_id for r in table.filter("payload like '%y é%'").collect()) == [2]
    decoded = []
    monkeypatch.setattr(warc, "http_body", lambda b: decoded.append(b) or b"")
    reader = warc.WarcReader({"path": path})
    kept = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 9), StringContains(("payload",), "z")]))
    assert [f.attribute for f in kept] == [("payload",)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1 and len(decoded) == 1


def test_warc_splits_and_foreign_files(spark, tmp_path, monkeypatch):
    from txnwatch.llm import warc
    folder = tmp_path / "foreign"
    folder.mkdir()
    records = [warc.record(i, "response", f"u{i}", None, f"body {i}".encode() * 50, "2020-01-01T00:00:00Z") for i in range(20)]
    (folder / "a.warc").write_bytes(b"".join(records[:10]))
    with gzip.open(folder / "b.warc.gz", "wb") as f:
        f.write(b"".join(records[10:]))
    got = warc.read_archive(spark, str(folder)).collect()
    assert {r.page_id: r.payload for r in got} == {i: f"body {i}" * 50 for i in range(20)}
    monkeypatch.setattr(warc, "SPLIT_BYTES", 500)
    writer = warc.WarcWriter({"path": str(tmp_path / "split")}, False)
    import pyarrow as pa
    rows = pa.RecordBatch.from_pylist([{"page_id": i, "url": "u", "payload": f"text {i}" * 30, "record_type": "response", "refers_to": None} for i in range(30)])
    writer.write(iter([rows]))  # an attempt that is never committed
    writer.commit([writer.write(iter([rows]))])
    reader = warc.WarcReader({"path": str(tmp_path / "split")})
    parts = reader.partitions()
    assert len(parts) > 3
    assert sorted(x for p in parts for b in reader.read(p) for x in b["page_id"].to_pylist()) == list(range(30))


def test_warc_empty(spark, tmp_path):
    from txnwatch.llm import warc
    path = str(tmp_path / "none")
    warc.write_archive(warc.with_revisits(_pages(spark).limit(0)), path)
    assert warc.read_archive(spark, path).count() == 0
