"""The registered queries against their SQL, and the pipeline against its stages' own results."""

import re

import pytest
from check_oracles import compare, duck
from edges import edge_docs, none_of

import corpus_pipeline
from loomlog.llm import decontaminate, surrogates, weak_rules
from loomlog.llm.queries import QUERIES
from loomlog.llm.sql import ORACLES
from test_copies import brute_marks, grams

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(spark, name):
    if name in ORACLES:
        assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF) is None
    elif name == "op12_spelling_variants":  # a row per word; test_spelling has the rows
        words = [r.word for r in QUERIES[name](spark, SF).select("word").collect()]
        assert len(words) == len(set(words)) > 0
    else:
        table = "pages" if name.startswith("op3") else "documents"
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def is_card(digits):
    """The first digit and the checksum of a card; other numbers of 16 digits are left as they are."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[::2])
    return digits[0] in "23456" and (sum(doubled) + sum(map(int, digits[1::2]))) % 10 == 0


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [{r.doc_id: r.text for r in docs.collect()}]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, SF).cache()
        assert frame.columns == docs.columns
        steps.append({r.doc_id: r.text for r in frame.collect()})
    raw, good, lone, clean, private = steps
    # quality rules: what the operator's own query keeps
    judged = QUERIES["op9_quality_rules"](spark, SF).collect()
    assert set(good) == {r.doc_id for r in judged if r.kept}
    # near copies: no two that stay are alike, and whoever went has a chain to one that stays
    sets = {i: grams(t) for i, t in good.items()}
    by_gram: dict = {}
    alike = {i: set() for i in sets}
    for i, s in sets.items():
        for g in s:
            by_gram.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in by_gram[g]}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                alike[i].add(j)

    def group(i):
        seen, todo = {i}, [i]
        while todo:
            new = alike[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    assert set(lone) == {min(group(i)) for i in sets}
    # benchmark passages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {key[0] for key in brute_marks(list(lone.items()), items, 10) if key[2]}
    assert set(clean) == set(lone) - hit
    # personal data
    pattern = re.compile(r"[\w.]+@[\w.]+\.com|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA[A-Z0-9]{16}|\b[0-9a-f]{40}\b")
    assert set(private) == set(clean)
    for i, t in clean.items():
        found = {x for x in pattern.findall(t) if not re.fullmatch(r"\d{16}", x) or is_card(x)}
        assert not any(x in private[i] for x in found) and (found or len(private[i]) == len(t))
    last = corpus_pipeline.STAGES[4][1](spark, frame, SF).collect()
    assert {r.doc_id: r.text for r in last} == private and all(len(r.ids) == r.n_tokens for r in last)


def test_stages_on_odd_rows(spark):
    docs = edge_docs(spark).selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    for frame in (docs, none_of(docs)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() <= docs.count()


def test_native_operators_have_no_python(spark):
    docs = edge_docs(spark)
    measured = weak_rules.measure(docs)
    for frame in (weak_rules.judge(measured, weak_rules.fit(measured)), surrogates.replace(docs, "k")):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().toString())
    assert "MapInArrow" in decontaminate.windows(docs, "doc_id", "text", 10)._jdf.queryExecution().toString()
