"""The pruned sparse search against scores of all documents."""

import hashlib
import math
import random
import re

import pytest

from weftgraph.operators import retrieval


def by_hand(queries, docs, k):
    df = {}
    for tokens in docs.values():
        for t in tokens:
            df[t] = df.get(t, 0) + 1
    out = set()
    for item, tokens in queries.items():
        scored = []
        for doc, own in docs.items():
            shared = [t for t in tokens if t in own]
            if shared:
                scored.append((-round(sum(tokens[t] * own[t] * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in shared), 6), doc))
        out |= {(item, doc, round(-s, 6), n) for n, (s, doc) in enumerate(sorted(scored)[:k], 1)}
    return out


def rows(spark, counts, name):
    return spark.createDataFrame([(i, t, n) for i, tokens in counts.items() for t, n in tokens.items()], f"{name} long, token_id long, tf long")


@pytest.mark.parametrize(("seed", "probed"), [(1, 200), (2, 1), (3, 1)])
def test_pruned_search(spark, monkeypatch, seed, probed):
    monkeypatch.setattr(retrieval, "PROBED", probed)
    rng = random.Random(seed)
    # token 0 is in every document, the last ones are rare; a few documents are long
    docs = {d: {0: rng.randrange(1, 4)} | {min(int(rng.paretovariate(0.5)), 400): rng.randrange(1, 40 if d % 50 == 0 else 4) for _ in range(60 if d % 50 == 0 else 8)} for d in range(300)}
    docs |= {300 + d: docs[d] for d in range(5)}  # ties
    queries = {q: {0: 1} | {min(int(rng.paretovariate(0.5)), 400): rng.randrange(1, 3) for _ in range(6)} for q in range(12)} | {50: {999: 1}}
    seen = []
    real = retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, name="step": (seen.append((name, real(df, name))), seen[-1][1])[1])
    got = retrieval.sparse_top_k(rows(spark, queries, "item_id"), rows(spark, docs, "doc_id"), len(docs), 4).collect()
    assert {(r.item_id, r.doc_id, round(r.score, 6), r.rank) for r in got} == by_hand(queries, docs, 4)
    scored = dict(seen)["candidates"].count()
    assert len(got) <= scored and (probed == 1 or scored < 0.5 * sum(any(t in own for t in tokens) for tokens in queries.values() for own in docs.values()))


def test_search_of_nothing(spark):
    one = rows(spark, {1: {5: 2}}, "doc_id")
    asked = rows(spark, {7: {5: 1}}, "item_id")
    assert [(r.item_id, r.doc_id, r.rank) for r in retrieval.sparse_top_k(asked, one, 1, 3).collect()] == [(7, 1, 1)]
    assert not retrieval.sparse_top_k(asked.limit(0), one, 1, 3).collect() and not retrieval.sparse_top_k(asked, one.limit(0), 0, 3).collect()


def test_counts_are_made_in_the_row(spark):
    rng = random.Random(5)
    texts = {d: " ".join(rng.choice(["Éa", "b_1", "คำ", "x-y", "b_1", "Zz9"]) for _ in range(rng.randrange(0, 9))) for d in range(40)} | {40: None, 41: "", 42: "--"}
    docs = spark.createDataFrame([*texts.items(), (3, "b_1 only"), (None, "b_1")], "doc_id long, text string")
    by_rows = {}
    for d, text in docs.collect():
        for t in re.findall(r"[\w]+", (text or "").lower()):
            key = (d, int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) & 2147483647)
            by_rows[key] = by_rows.get(key, 0) + 1
    counts = retrieval.term_counts(docs)
    assert {(r.doc_id, r.token_id): r.tf for r in counts.collect()} == by_rows
    asked = spark.createDataFrame([(next(iter(by_rows))[1],), (1,)], "token_id long")
    picked = retrieval.term_counts(docs, tokens=asked)
    assert {(r.doc_id, r.token_id): r.tf for r in picked.collect()} == {k: n for k, n in by_rows.items() if k[1] == next(iter(by_rows))[1]}
    # one shuffle, by the id, of counts and not of tokens
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Generate" not in plan and plan.index("RepartitionByExpression") < plan.index("LeftSemi")


def test_counts_of_one_row_are_not_aggregated(spark):
    """A hash table of all tokens of all documents is what made a task's memory grow; lists are sorted by their id instead."""
    docs = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("a", "x z"), (None, "y y"), (None, "y")], "doc_id string, text string")
    name = {int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) & 2147483647: t for t in "xyz"}
    counts = retrieval.term_counts(docs)
    assert {(r.doc_id, name[r.token_id], r.tf) for r in counts.collect()} == {("a", "x", 3), ("a", "y", 1), ("a", "z", 1), ("b", "y", 1), (None, "y", 3)} and counts.count() == 5
    lone, again = counts._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [", 1)
    assert "(rows#" in lone and "= 1)" in lone and "> 1)" in again
