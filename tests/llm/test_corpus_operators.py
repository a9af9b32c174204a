"""Operators over the whole corpus against brute force, with odd rows; the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import cover_tree, line_dedup, ngram_join

SF = "/root/testdata/sf0.001"


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_cover_tree(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 60)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 12))
    x = np.concatenate([base, base[:30] + 0.12 * rng.normal(size=(30, 12)), base[3] + 0.1 * rng.normal(size=(60, 12)), base[:10], 3 * base[10:12]])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 12, 0), (902, [1.0] * 11 + [None], 0), (903, [1.0] * 11 + [float("nan")], 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = roots(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(link))])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_pairs(df).collect()}
    assert got == {i: (int(link[i].sum()), want[i], want[i] == i) for i in range(len(x))} | {i: (0, i, True) for i, *_ in odd}
    assert not cover_tree.near_pairs(df.where("false")).collect()


def test_cover_tree_odd_ids_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 2)
    monkeypatch.setattr(cover_tree, "GROUP", 64)
    rows = [(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (9, [0.0, 1e300]), (None, [5e-324, 5e-324]), (3, [1e300, 1e300]), (None, [-1.0, 0.0]), (None, None), (8, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, cover_tree.near_pairs(df).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (8, 2, 7, False), (7, 1, 7, True), (9, 1, 7, False), (None, 1, 3, False), (3, 1, 3, True), (None, 0, None, True), (None, 0, None, True)], key=str)


def near_copies():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("dense", [0, 1000])
def test_ngram_join(spark, monkeypatch, dense):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    texts = [*near_copies(), "", None, " \n", "one two", "One  TWO", "a b c d e f", "é b c d"]
    rows = [(i, t, 0, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[0], (None, "quite alone here with these words", 0, 0)], "doc_id long, text string, n int, component_id int")
    sets = {}
    for i, t in enumerate(texts):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    links = [(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = ngram_join.join_classes(df).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets} | {None: (3, None)}


def deduped(docs, least):
    """Every later copy of every run of at least ``least`` words, by comparing all runs."""
    seen, gone = {}, {}
    lines = {d: [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")] for d, t in docs}
    for d in sorted(lines):
        for a in range(len(lines[d])):
            for z in range(a + 1, len(lines[d]) + 1):
                run = tuple(x for _, x in lines[d][a:z])
                if sum(x.count(" ") + 1 for x in run) >= least:
                    if run in seen:
                        gone.setdefault(d, set()).update(i for i, _ in lines[d][a:z])
                    seen.setdefault(run, d)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in docs}


def test_line_dedup(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(5)]
    docs = [(d, "\n".join(rng.choice([*lines, "", " x "]) for _ in range(rng.randint(1, 30)))) for d in range(25)]
    df = spark.createDataFrame([(d, t, "s", 3, 4) for d, t in docs] + [(90, None, "s", 0, 0), (91, "", None, 0, 0)], "doc_id long, text string, source string, id int, h int")
    got = line_dedup.dedup_lines(df, min_words=12).collect()
    want = deduped(docs, 12)
    assert {r.doc_id: r.text for r in got} == want | {90: None, 91: ""}
    assert any(r.n_deleted for r in got) and {(r.id, r.h) for r in got} == {(3, 4), (0, 0)}
    assert not line_dedup.dedup_lines(df.where("false")).collect()


def test_pipeline_keeps_blank_documents(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = [long, long, f"{long}\n\nand more", "\n\n", " \n ", "", "  ", None]
    docs = spark.createDataFrame([(i, t, "en", "s", -1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()}
    assert got == {0: long, 2: "\nand more", 3: "\n\n", 4: " \n ", 5: "", 6: "  ", 7: None}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        assert out.select("doc_id").exceptAll(seen.select("doc_id")).isEmpty()
        seen = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert last.where(~F.col("exact") | (F.size("ids") != F.col("n_tokens"))).isEmpty() and last.count() == seen.count() > 100
