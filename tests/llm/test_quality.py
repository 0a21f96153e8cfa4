from __future__ import annotations

import math

from pyspark.sql import functions as F

from trialweave.llm import quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    site = F.col("source")
    out = quality.score(docs, labels.where("doc_id % 4 <> 0"), site, F.concat_ws("/", site, "lang"))
    assert out.count() == docs.count()
    held = out.select("doc_id", "accepted").join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    right = sum(r.accepted == (r.quality == 1 and r.toxic == 0) for r in held)
    assert right / len(held) >= 0.9
    clean = [r.accepted for r in held if r.quality == 1 and r.toxic == 0]
    assert sum(clean) / len(clean) >= 0.95


def test_sparse_sites_shrink_to_their_host_and_hosts_to_the_mean(spark):
    rows = [("good", f"good/{i % 4}", 0.9) for i in range(400)] + [("bad", f"bad/{i % 4}", 0.1) for i in range(400)] + [("good", "good/new", 0.1), ("new", "new/x", 0.1), ("none", "none/x", None), (None, None, 0.9)]
    frame = spark.createDataFrame(rows, "host string, path string, p double")
    out = {(r.host, r.path): r for r in quality.site_posteriors(frame).collect()}
    assert len(out) == len({r[:2] for r in rows})
    base = out["none", "none/x"].base
    assert abs(base - 0.5) < 0.01
    assert math.isclose(out["none", "none/x"].host_posterior, base) and math.isclose(out["none", "none/x"].path_posterior, base)
    assert out["good", "good/1"].host_posterior > 0.85 and out["bad", "bad/1"].path_posterior < 0.15
    assert out["good", "good/new"].path_posterior > 0.5  # one bad document of a good host
    assert 0.1 < out["new", "new/x"].host_posterior < base < out[None, None].host_posterior < 0.9


def test_posteriors_are_those_of_the_formulas(spark):
    rows = [("a", "a/1", 0.9), ("a", "a/1", 0.7), ("a", "a/2", 0.6), ("b", "b/1", 0.2), ("b", "b/1", 0.4), ("c", "c/1", 0.5)]
    out = {r.path: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    base = (sum(p for *_, p in rows) + 0.5) / 7
    hosts = {h: [p for g, _, p in rows if g == h] for h in "abc"}
    mean = {h: sum(x) / len(x) for h, x in hosts.items()}
    noise = sum((p - mean[h]) ** 2 for h, x in hosts.items() for p in x) / (6 - 3)
    between = sum(len(x) * (mean[h] - base) ** 2 for h, x in hosts.items())
    spread = (between - 2 * noise) / (6 - sum(len(x) ** 2 for x in hosts.values()) / 6)
    k = max(1.0, base * (1 - base) / spread - 1)
    for path, host in (("a/1", "a"), ("b/1", "b"), ("c/1", "c")):
        want = (sum(hosts[host]) + k * base) / (len(hosts[host]) + k)
        assert math.isclose(out[path].host_posterior, want, rel_tol=1e-9)


def test_edges_without_labels_and_with_one_class(spark, edges, nothing):
    site = F.col("source")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    named = edges.selectExpr("*", "1 AS path", "2 AS good", "'x' AS p_good")
    out = quality.score(named, none, site, F.concat_ws("/", site, "lang"))
    assert out.columns == [c for c in named.columns if c != "p_good"] + ["p_good", "p_toxic", "host_posterior", "path_posterior", "posterior", "accepted"]
    rows = out.collect()
    assert len(rows) == edges.count() and all(r.accepted for r in rows)
    assert all(r.p_good is None for r in rows if not (r.text or "").strip())
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (6, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(edges, one, site, site).collect()
    assert len(rows) == edges.count() and not any(r.accepted for r in rows if (r.text or "").strip())
    assert quality.score(nothing, none, site, site).count() == 0
