"""Rules by joins against the plan's own cases, and html that never closes what it opens."""

import random
import time

from pyspark.sql import functions as F

from loomlog.llm import url_filter


def test_joined_rules_are_the_longest(spark):
    rnd = random.Random(4)
    labels, parts = ["a", "b", "com", "net", "www"], ["/", "/x", "/x/", "/x/y", "", "/é", "/xy"]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 5))) for _ in range(200)] + ["", "com.", ".com", "xcom"]
    rules = list({(rnd.choice(["allow", "block"]), rnd.choice(hosts[:60]), rnd.choice(parts)) for _ in range(90)})
    asked = [(h, rnd.choice(parts) + rnd.choice(parts)) for h in hosts for _ in range(3)]
    rows = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(asked + asked[:50])], "page_id long, host string, path string")
    by_case = rows.select("page_id", url_filter.rule_for(F.col("host"), F.col("path"), rules).alias("r"))
    joined = url_filter.ruled_by_join(rows, url_filter.rule_table(spark, rules))
    assert joined.columns == ["page_id", "host", "path", "r"]
    assert sorted((r.page_id, r.r) for r in joined.collect()) == sorted((r.page_id, r.r) for r in by_case.collect())


def test_a_large_table_of_rules(spark):
    n = 200_000
    rules = spark.range(n).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/p").alias("path"))
    pages = spark.range(0, 2 * n, 1_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".org/page")).alias("url"), F.lit("").alias("html"))
    got = url_filter.judge(pages, rules=rules).collect()
    assert len(got) == 2 * n // 1_000
    assert all((r.verdict, r.rule) == (("block", f"h{r.page_id}.org/p") if r.page_id < n else ("allow", None)) for r in got)


def test_open_html_costs_its_length(spark):
    pages = [("<a " * 1_000_000), '<a href="' * 100_000, "<a href " * 100_000, "<a " + "x " * 500_000, "<a\n" * 9 + "<a title=x href = '//b.org/y'>"]
    rows = spark.createDataFrame([(i, "http://a.org/", h) for i, h in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    started = time.time()
    got = url_filter.edges(rows).collect()
    assert time.time() - started < 30 and [(r.src, r.dst) for r in got] == [("a.org", "b.org")]
