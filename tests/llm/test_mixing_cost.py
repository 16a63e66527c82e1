"""A copy taken in part is cut from words that are split once."""

import re

from tagloom.llm import mixing


def test_a_text_is_split_once_however_many_ranges_are_taken(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(500 + i)), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    out = mixing.mixed(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(slice(" in plan and not re.search(r"lambdafunction\(slice\((?!lambda )", plan)
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    parts = [r for r in out.collect() if len(r.text.split()) < len(texts[r.doc_id])]
    assert parts
    for r in parts:
        left = iter(texts[r.doc_id])
        assert all(w in left for w in r.text.split())
