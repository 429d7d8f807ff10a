import random

import numpy as np

from ledgerspark.llm import neighbours, url_filters


def judged(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "clash", 1.0) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, trust double")
    return {r.page_id: r for r in url_filters.filter_urls(df, **options).collect()}


def test_rules_and_parts(spark):
    rows = [
        ("http://A.Example.NET/en/1?x", None), ("http://example.net", ""), ("https://x.net/?q", ""), ("ftp://example.com/de/#", ""), ("http://my-example.com/de/", ""), ("no scheme", ""), (None, ""), ("http://o.org/fr/a://b/c", ""), ("://net/", ""), ("http://net/en/", ""), ("http://é.ORG/FR/", ""),
    ]
    got = judged(spark, rows)
    expected = [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("x.net", "/", "net/", "block"), ("example.com", "/de/", "example.com/de/", "block"), ("my-example.com", "/de/", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("o.org", "/fr/a://b/c", "org/fr/", "allow"), ("net", "/", "net/", "block"), ("net", "/en/", "net/", "block"), ("é.org", "/FR/", None, "allow"),
    ]
    for i, e in enumerate(expected):
        # an url without a rule takes its host's verdict by propagation
        assert (got[i].host, got[i].path, got[i].rule) == e[:3]
        if e[2] is not None:
            assert got[i].verdict == e[3]
    assert len(got) == len(rows)


def plain_scores(edges, seeds, damping=url_filters.DAMPING):
    """Personalised PageRank to the end, mass without links left where it is."""
    hosts = sorted({h for a, b, _ in edges for h in (a, b)} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    step = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        step[at[b], at[a]] += n
    step /= np.maximum(step.sum(axis=0), 1)
    start = np.array([seeds.get(h, 0.0) for h in hosts])
    score = np.linalg.solve(np.eye(len(hosts)) - damping * step, (1 - damping) * start)
    return {h: score[at[h]] for h in hosts if score[at[h]] > 0}


def test_propagation_against_plain_pagerank(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.org" for i in range(30)]
    edges = [(a, b, rng.randrange(1, 4)) for a in hosts for b in rng.sample(hosts, 3) if a != b] + [("h3.org", "end.org", 2)]
    df = spark.createDataFrame(edges, "src string, dst string, links long")
    seeds = spark.createDataFrame([("trust", "h0.org", 0.5), ("trust", "h1.org", 0.5), ("distrust", "h2.org", 1.0)], "flow string, host string, mass double")
    got = {(r.flow, r.host): r.score for r in url_filters.propagate(df, seeds).collect()}
    trust = plain_scores(edges, {"h0.org": 0.5, "h1.org": 0.5})
    distrust = plain_scores([(b, a, n) for a, b, n in edges], {"h2.org": 1.0})
    assert set(got) == {("trust", h) for h in trust} | {("distrust", h) for h in distrust}
    assert all(abs(got["trust", h] - s) < 0.01 * s for h, s in trust.items())
    assert all(abs(got["distrust", h] - s) < 0.01 * s for h, s in distrust.items())


def test_long_chains_and_many_seeds(spark):
    """Distrust goes back over a chain of hosts, however little of all the seeds' mass it is."""
    chain = [(f"http://c{i}.info/", f"<a href='http://c{i + 1}.info/'>x</a>") for i in range(20)] + [("http://c20.info/", "<a href='http://bad.net/'>x</a>"), ("http://bad.net/", "")]
    df = spark.createDataFrame([(f"c{i}.info", f"c{i + 1}.info", 1) for i in range(20)] + [("c20.info", "bad.net", 1)], "src string, dst string, links long")
    few = {(r.flow, r.host): r.score for r in url_filters.propagate(df, spark.createDataFrame([("distrust", "bad.net", 1.0)], "flow string, host string, mass double")).collect()}
    many = spark.createDataFrame([("distrust", "bad.net", 1e-12), ("distrust", "else.net", 1 - 1e-12), ("trust", "t.org", 1.0)], "flow string, host string, mass double")
    lots = {(r.flow, r.host): r.score for r in url_filters.propagate(df, many).collect()}
    assert few["distrust", "c0.info"] > 0
    assert all(lots["distrust", f"c{i}.info"] > 0 for i in range(21))
    got = judged(spark, chain + [("http://else.net/", "")] * 500 + chain[:1])
    assert {got[i].verdict for i in range(len(chain))} == {"block"}
    assert got[len(got) - 1].verdict == got[0].verdict


def test_url_filters_on_an_empty_table(spark):
    assert judged(spark, []) == {}


def test_links_carry_distrust_backwards(spark):
    rows = [("http://bad.net/", ""), ("http://farm.info/", "<a href='http://bad.net/x'>x</a>"), ("http://ok.org/fr/", '<A HREF="//friend.info/">y</A>'), ("http://friend.info/", "<a href=/local>"), ("http://lonely.info/", None)]
    got = judged(spark, rows)
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "allow"]


def found(spark, rows, queries, **options):
    schema = "vec_id long, embedding array<float>, label int, score double"
    df = spark.createDataFrame([(i, v, 0, 9.0) for i, v in rows], schema)
    q = df.where(df.vec_id.isin(queries))
    out = {}
    for r in neighbours.nearest(df, q, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def plain(rows, query, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    own = good[query]
    scored = sorted((-float(v @ own), i) for i, v in good.items() if i != query and len(v) == len(own))
    return [i for _, i in scored[:k]]


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]
    rows += [(200, None), (201, [0.0] * 5), (202, [float("nan")] * 5), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, []), (205, [1.0, 2.0]), (206, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (3, rows[3][1]), (None, rows[4][1])]
    got = found(spark, rows, [0, 3, 40, 105, 200, 201, 205], k=20)
    assert set(got) == {0, 3, 40, 105, }
    for q in got:
        assert [i for i, _ in got[q]] == plain(rows, q, 20)
    assert found(spark, rows[:3], [1], k=20) == {1: [(i, s) for i, s in found(spark, rows[:3], [1], k=20)[1]]}
    assert found(spark, [], [1]) == {}


def test_graph_recall(spark):
    rng = np.random.default_rng(3)
    # lengths differ, so inner product and distance disagree
    vectors = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2.0, size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    queries = list(range(0, 3000, 60))
    got = found(spark, rows, queries, shard=1500, block=20)
    recall = np.mean([len({i for i, _ in got[q]} & set(plain(rows, q, 20))) / 20 for q in queries])
    assert recall >= 0.9
    for q in queries:
        own = np.array(rows[q][1], np.float32).astype(float)
        assert all(abs(s - np.array(rows[i][1], np.float32).astype(float) @ own) < 1e-9 for i, s in got[q])
