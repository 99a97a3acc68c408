"""Url rules and link ranks, weak quality rules and the classifier."""

import random
from collections import Counter, defaultdict

from edges import edge_docs, none_of
from pyspark.sql import functions as F

from loomlog.llm import quality_model, url_filter, weak_rules
from loomlog.llm.queries import QUERIES


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, host string, trust double")


def test_hosts_paths_and_the_longest_rule(spark):
    cases = {
        "http://A.Example.com/en/x?y=/z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://deep.www.example.com/en/a": ("deep.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "com/", "allow"),
        "http://notexample.net/es/1#f": ("notexample.net", "/es/1", "net/es/", "block"),
        "ftp://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://x.org/?q=a://b/c": ("x.org", "/", None, "allow"),
        "no host": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://ÀB.com/é/": ("Àb.com", "/é/", "com/", "allow"),
    }
    urls = list(cases)
    got = url_filter.judge(pages(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()
    assert {urls[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in got} == cases
    assert url_filter.judge(none_of(pages(spark, [(1, "", "")]))).collect() == []


def test_trust_reaches_hosts_beyond_thirty_links(spark):
    hosts = [f"h{i:02d}" for i in range(35)]
    links = spark.createDataFrame([(a, b, 1.0) for a, b in zip(hosts, hosts[1:])], "src string, dst string, n double")
    seeds = spark.createDataFrame([(hosts[0], 1.0, 0.0)], "host string, trusted double, blocked double")
    ranks = url_filter.propagate(seeds, links, enough=4e-3).collect()
    assert len(ranks) == 35 and all(r.trust > 0 for r in ranks)


def test_rounds_are_enough_for_the_bound():
    for damping, enough in ((0.85, 1e-6), (0.5, 1e-3), (0.99, 1e-6)):
        assert 4 * damping ** url_filter.rounds_for(damping, enough) < enough
    assert url_filter.ROUNDS == url_filter.rounds_for(url_filter.DAMPING, url_filter.ENOUGH)


def brute_ranks(seeds, links, rounds=url_filter.ROUNDS):
    out = []
    for mine, arcs in ((0, links), (1, {(b, a): n for (a, b), n in links.items()})):
        hosts = {*seeds, *(h for e in links for h in e)}
        total = sum(s[mine] for s in seeds.values()) or 1.0
        base = {h: seeds.get(h, (0, 0))[mine] / total for h in hosts}
        if not any(base.values()):
            out.append(base)
            continue
        leaving = defaultdict(float)
        for (a, _), n in arcs.items():
            leaving[a] += n
        rank = dict(base)
        for _ in range(rounds):
            got = defaultdict(float)
            for (a, b), n in arcs.items():
                got[b] += rank[a] * n / leaving[a]
            lost = 1 - sum(got.values())
            rank = {h: 0.85 * (got[h] + lost * base[h]) + 0.15 * base[h] for h in hosts}
        out.append(rank)
    return out


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    link = lambda *hosts: "".join(f"<a class='x' href=\"https://{h}/p\">t</a><A HREF=//{h}/q>u</A>" for h in hosts)
    rows = [
        (1, "http://good.com/", link("friend.org", "other.org") + "<a href='/inner'>i</a><link href='http://not.org/x'>"),
        (2, "http://friend.org/", link("friend2.org", "FRIEND.org")),
        (3, "http://shady.org/", link("bad.net", "friend2.org")),
        (4, "http://shady2.org/", link("shady.org")),
        (5, "http://bad.net/es/", link("bad2.net")),
        (6, "http://alone.org/", None),
        (7, "http://bad.net/de/", ""),
        (7, "http://bad.net/de/", ""),
    ]
    table = pages(spark, rows)
    links = {(r.src, r.dst): r.n for r in url_filter.edges(table).collect()}
    assert links == {("good.com", "friend.org"): 1, ("good.com", "other.org"): 1, ("friend.org", "friend2.org"): 1, ("shady.org", "bad.net"): 1, ("shady.org", "friend2.org"): 1, ("shady2.org", "shady.org"): 1, ("bad.net", "bad2.net"): 1}
    trust, distrust = brute_ranks({"good.com": (1, 0), "bad.net": (0, 1)}, links)
    got = url_filter.judge(table).collect()
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-4 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-4
    verdicts = Counter((r.page_id, r.verdict) for r in got)
    assert verdicts == {(1, "allow"): 1, (2, "allow"): 1, (3, "block"): 1, (4, "block"): 1, (5, "block"): 1, (6, "allow"): 1, (7, "block"): 2}


def brute_measures(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_are_those_of_plain_counting(spark):
    docs = edge_docs(spark)
    more = spark.createDataFrame([(90, "a b c d e f a b c d e x a b c d e"), (91, "# | $x <b>\n\n  \nsame\nsame\n same"), (92, "\u000bx\u00a0y\fz ")], "doc_id long, text string")
    rows = weak_rules.measure(docs.select("doc_id", "text").unionByName(more)).collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(r.text), r.doc_id


def test_votes_find_junk_and_keep_clean_texts(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeiostrn") for _ in range(rnd.randrange(2, 9)))
    clean = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(8)) + "."
    junk = [lambda: " | ".join(word() for _ in range(60)), lambda: "!! ".join(word().upper() for _ in range(60)), lambda: " ".join(w for _ in range(6) for w in [word()] * 12)]
    rows = [(i, clean(), True) for i in range(150)] + [(200 + i, junk[i % 3](), False) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    measured = weak_rules.measure(docs, keep=["doc_id", "good"])
    judged = weak_rules.judge(measured, weak_rules.fit(measured))
    assert all(r.kept == r.good for r in judged.collect())
    assert {r.doc_id for r in weak_rules.accepted(judged).collect()} == set(range(150))


def test_fitting_follows_expectation_maximisation(spark):
    rows = [(1, 1, 1)] * 70 + [(1, -1, -1)] * 9 + [(0, -1, -1)] * 6 + [(1, 0, 1)] * 10 + [(-1, 1, 0)] * 5
    votes = spark.createDataFrame(rows, "a int, b int, c int")
    good, right = weak_rules.fit(votes, {k: F.col(k) for k in "abc"})
    import math

    g, r = weak_rules.START_GOOD, dict.fromkeys(range(3), weak_rules.START_RIGHT)
    for _ in range(weak_rules.ROUNDS):
        odds = lambda v: math.log(g / (1 - g)) + sum(0 if not x else math.log(r[k][0] / (1 - r[k][1])) if x > 0 else math.log((1 - r[k][0]) / r[k][1]) for k, x in enumerate(v))
        p = [1 / (1 + math.exp(-odds(v))) for v in rows]
        g = min(max(sum(p) / len(p), 1 - weak_rules.MOST_GOOD), weak_rules.MOST_GOOD)
        for k in range(3):
            yg, ng = (sum(q for q, v in zip(p, rows, strict=True) if v[k] == s) for s in (1, -1))
            yb, nb = (sum(1 - q for q, v in zip(p, rows, strict=True) if v[k] == s) for s in (1, -1))
            on_good = max((yg + 1) / (yg + ng + 2), weak_rules.LEAST_RIGHT_ON_GOOD)
            r[k] = (on_good, min(max((nb + 1) / (nb + yb + 2), (1 - on_good) * weak_rules.LEAST_LIFT), weak_rules.MOST_RIGHT_ON_BAD))
    assert abs(good - g) < 1e-3
    assert all(abs(x - y) < 1e-3 for k, name in enumerate("abc") for x, y in zip(right[name], r[k], strict=True))


def test_an_empty_table_has_the_starting_model(spark):
    measured = weak_rules.measure(none_of(edge_docs(spark)))
    model = weak_rules.fit(measured)
    assert model == (weak_rules.START_GOOD, dict.fromkeys(weak_rules.votes(), weak_rules.START_RIGHT))
    assert weak_rules.judge(measured, model).collect() == []


def test_scores_of_odd_texts(spark):
    docs = edge_docs(spark)
    labels = docs.where("doc_id in (6, 9, 10, 14)").select("doc_id", (F.col("doc_id") == 10).cast("int").alias("label")).union(spark.createDataFrame([(11, None), (None, 1)], "doc_id long, label int"))
    weights = quality_model.train(docs, labels, "doc_id")
    rows = quality_model.score(docs, weights).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[10] > max(score[6], score[9], score[14]) and score[0] == score[1] == score[2]
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    none = quality_model.train(docs, none_of(labels), "doc_id")
    assert {r.score for r in quality_model.score(docs, none).collect()} == {0.5}
    assert quality_model.score(none_of(docs), weights).collect() == []


def test_learner_lowers_the_loss():
    import numpy as np

    learner, rnd = quality_model.Learner(), np.random.default_rng(1)
    samples = [(np.array([5 + y, 9, 1 << quality_model.BUCKET_BITS]), np.array([1.0, rnd.random(), 1.0]), float(y)) for y in rnd.integers(0, 2, 200)]
    for at, x, y in samples:
        learner.learn(at, x, y)
    w = learner.weights()
    assert all((w[at] @ x > 0) == (y == 1) for at, x, y in samples)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op5_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
