import io
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from loomstat.llm import neighbours, urls, warc
from loomstat.llm._common import new_path

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_rules_and_parts_of_urls(spark):
    some = [None, "", "nothing", "http://A.Example.ORG/es/x?q", "https://example.org/en/12", "https://example.org/en/2", "http://org", "http://org/", "x://b.com/fr/1#t", "x://b.com/fr", "x://com/de/", "http://notexample.org/es/", "http://h?x=://y/z", "a://b://c/d", "http://É.com/de/ü", "http://x.com:80/de/1", "http://" + "a" * 5000 + ".net/" + "p" * 5000]
    rows = spark.createDataFrame([(k, u, "x") for k, u in enumerate(some)], "page_id long, url string, host string")
    weights = [0.0] * (urls.BUCKETS + 1)
    for r in urls.judge(rows, weights).collect():
        url = some[r["page_id"]]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), k, h + p) for k, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((max(fits)[2], max(fits)[1]) if fits else (None, "allow"))


def test_url_model_on_hosts_held_out(spark):
    weights = urls.fit(urls.labelled(spark))
    rows = urls.judge(urls.held_out(spark), weights, rules=(), keep=("url", "label")).collect()
    hits = sum(r["verdict"] == "block" and r["label"] == 1 for r in rows)
    assert hits / sum(r["label"] for r in rows) >= 0.95 and hits / sum(r["verdict"] == "block" for r in rows) >= 0.95
    hosts = {"block": ["m.casino-win.example.com", "free-bets.example.com", "malware-host.net", "online-casino.info"], "allow": ["www.ththing.example.net", "adelaide.net", "spain.net", "github.net", "wikipedia.net", "radio-roads.net"]}
    paths = ["", "/", "/en/77", "/fr/1993.html", "/wiki/Casino", "/user/tracker", "/farm"]
    some = [(k, f"https://{h}{p}", v) for v, hs in hosts.items() for k, h in enumerate(hs) for p in paths]
    out = urls.judge(spark.createDataFrame(some, "page_id long, url string, verdict string").withColumnRenamed("verdict", "want"), weights, rules=(), keep=("url", "want")).collect()
    assert [r["url"] for r in out if r["verdict"] != r["want"]] == []
    assert urls.fit(urls.labelled(spark).limit(0)) == [0.0] * (urls.BUCKETS + 1)


def test_urls_of_odd_rows_and_brute_force_scores(spark, tmp_path):
    """Null, empty and repeated urls, clashing columns, an empty table; scores by plain arithmetic."""
    rng = np.random.default_rng(1)
    weights = rng.normal(size=urls.BUCKETS + 1).round(3).tolist()
    some = [None, "", "no address", "http://", "http://h.net", "https://Ä.net/é?x", "http://h.net", "http://" + "a" * 50_000 + "/" + "b" * 50_000]
    rows = spark.createDataFrame([(k, u, "x", 1.0) for k, u in enumerate(some)], "page_id long, url string, verdict string, f double")
    out = urls.judge(rows, weights, rules=()).collect()
    assert len(out) == len(some) and urls.judge(rows.limit(0), weights).count() == 0
    grams = lambda t: {tuple(f"^^{t}$"[i : i + n]) for n in (3, 4, 5) for i in range(len(t) + 4 - n)}
    pairs = [(r["page_id"], len(grams(r["host"])), len(grams(r["path"]))) for r in out if r["page_id"] < 7]
    sizes = {r["page_id"]: (len(r["f"]["h"]), len(r["f"]["p"])) for r in rows.select("page_id", *(c.alias(n) for n, c in zip(("host", "path"), urls.host_and_path(F.col("url")), strict=True))).select("page_id", urls.features().alias("f")).collect()}
    assert all(sizes[k][0] <= a and sizes[k][1] <= b for k, a, b in pairs)
    made = rows.select("page_id", *(c.alias(n) for n, c in zip(("host", "path"), urls.host_and_path(F.col("url")), strict=True))).select("page_id", urls.features().alias("f")).collect()
    for r in made:
        margin = weights[0] + sum(sum(weights[b + 1] for b in r["f"][side]) / len(r["f"][side]) ** 0.5 for side in "hp")
        assert abs(next(x["score"] for x in out if x["page_id"] == r["page_id"]) - 1 / (1 + np.exp(-margin))) < 1e-6
    rows.select("page_id", "url").withColumn("html", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    found = urls.query(spark, str(tmp_path))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"] and found.count() == len(some)


PAGES = [(1, "http://a/1", "x" * 1000), (2, "http://a/é\r\nX: y", "x" * 1000), (3, None, "x" * 1000), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", "é" * 500), (9, "u", "é" * 500), (None, "u", "x" * 1000), (11, "u", "y" * 2_000_000), (12, "u", "\r\n\r\nWARC/1.1\r\n")]


def test_archives_round_trip_and_random_access(spark):
    folder = new_path(spark, "warc-test")
    rows = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, record_type string")
    manifest = warc.write(rows, folder, frame_bytes=3000, bundle_bytes=2000)
    out = {r["page_id"]: r for r in warc.read(manifest, folder).collect()}
    assert len(out) == len(PAGES)
    for page_id, _, html in PAGES:
        assert out[page_id]["payload_bytes"] == len((html or "").encode())
    assert {k: r["refers_to"] for k, r in out.items() if r["record_type"] == "revisit"} == {1: 3, 2: 3, None: 3, 8: 9}
    assert warc.read(warc.write(rows.limit(0), folder), folder).count() == 0
    store, _ = warc.fs.FileSystem.from_uri(folder)
    for page_id, _, html in PAGES[2:8]:
        with store.open_input_file(out[page_id]["bundle"]) as file:
            head, block = warc.Bundle(file).find(warc.record_id(page_id))
        payload = b"" if out[page_id]["record_type"] == "revisit" else (html or "").encode()
        assert head["X-Page-Id"] == str(page_id) and block.partition(b"\r\n\r\n")[2] == payload


def test_bundles_are_plain_zstandard():
    class Kept(io.BytesIO):
        def close(self):
            pass

    buffer, data = Kept(), []
    writer = warc.BundleWriter(buffer, 50)
    for k in range(5):
        data.append(warc.record(k, "u", b"payload", 7, "0" * 40, "response", None))
        writer.add(warc.record_id(k), data[-1])
    writer.close()
    whole = buffer.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read() == b"".join(data)


def test_neighbours_edges_and_recall(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(10_000, None), (10_020, [0.0] * 16), (10_040, [float("nan")] * 16), (10_060, [None] * 16), (None, [1.0] * 16), (10_080, [1.0, 2.0]), (0, x[0].tolist()), (10_100, [])]
    df = spark.createDataFrame([(*r, "q") for r in rows + odd], "vec_id long, embedding array<double>, score string")
    out = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, shard=800).collect()
    by = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.argsort(-s)[:10].tolist()))
        assert len(found) == 10 and all(abs(score - x[v] @ x[q]) < 1e-9 for v, score in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hits / (10 * len(by)) >= 0.9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_break_ties_by_id(spark):
    rows = [(k, [1.0, 0.0]) for k in range(30)]
    random.Random(1).shuffle(rows)
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 20, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [0, 1, 2, 3, 4]
