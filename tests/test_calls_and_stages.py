"""Calls with a client that fails, runs that are killed half way, values of unknown shape, evidence by direction."""

import json
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import calls, evidence, nested
from weftgraph.plans import stages
from weftgraph.plans.stages import Stage

FAST = calls.Policy(concurrency=4, batch=5, tries=3, first_wait=0.0)


def _count(folder: str, request: str) -> None:
    open(f"{folder}/{request}~{uuid.uuid4().hex}", "w").close()


def _asked(folder) -> dict[str, int]:
    out: dict[str, int] = {}
    for name in os.listdir(folder):
        out[name.split("~")[0]] = out.get(name.split("~")[0], 0) + 1
    return out


@pytest.fixture()
def folders(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log"), str(tmp_path / "store")


def test_each_distinct_request_is_asked_once_and_kept(spark, folders):
    log, store = folders

    def ask(r):
        _count(log, r)
        return r + "!"

    rows = spark.createDataFrame([(i, f"r{i % 7}") for i in range(50)] + [(99, None), (100, "")], "id long, request string")
    got = {r["id"]: (r["answer"], r["error"]) for r in calls.answered(rows, ask, store, policy=FAST).collect()}
    assert len(got) == 52 and got[8] == ("r1!", None) and got[99] == (None, "no request") and got[100] == ("!", None)
    assert set(_asked(log).values()) == {1} and len(_asked(log)) == 8
    more = spark.createDataFrame([("r1",), ("new",)], "request string")
    assert {r["answer"] for r in calls.answered(more, ask, store, policy=FAST).collect()} == {"r1!", "new!"}
    assert _asked(log)["r1"] == 1 and _asked(log)["new"] == 1


def test_tries_and_error_rows(spark, folders):
    log, store = folders

    def ask(r):
        _count(log, r)
        n = len([x for x in os.listdir(log) if x.startswith(r + "~")])
        if r == "never" or (r == "third" and n < 3):
            raise OSError(f"busy {n}")
        return r

    rows = spark.createDataFrame([("never", "old"), ("third", "old"), ("first", "old")], "request string, answer string")
    got = {r["request"]: (r["answer"], r["error"], r["tries"]) for r in calls.answered(rows, ask, store, policy=FAST).collect()}
    assert got == {"never": (None, "OSError: busy 3", 3), "third": ("third", None, 3), "first": ("first", None, 1)}
    calls.answered(rows, ask, store, policy=FAST).collect()  # only what failed is asked again
    assert _asked(log) == {"never": 6, "third": 3, "first": 1}


def test_empty_requests(spark, folders):
    none = spark.createDataFrame([], "id long, request string")
    out = calls.answered(none, str.upper, folders[1], policy=FAST)
    assert out.columns == ["id", "request", "answer", "error", "tries"] and out.collect() == []


def test_pauses_double_up_to_the_longest_and_pace_is_kept(monkeypatch):
    slept, now = [], [0.0]
    monkeypatch.setattr(calls.time, "sleep", lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    monkeypatch.setattr(calls.time, "monotonic", lambda: now[0])

    def ask(r):
        raise ValueError("no")

    assert calls._called(ask, "x", calls.Policy(tries=6, first_wait=5, longest_wait=60), calls._Pace(0)) == (None, "ValueError: no", 6)
    assert slept == [5, 10, 20, 40, 60]
    slept.clear()
    pace = calls._Pace(2.0)
    for _ in range(3):
        pace.wait()
    assert sum(slept) == 4.0


LOST = """
import os, sys, uuid
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from weftgraph.operators import calls
log, store = {log!r}, {store!r}
spark = SparkSession.builder.master("local[2,4]").config(map={{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def ask(r):
    open(log + "/" + r + "~" + uuid.uuid4().hex, "w").close()
    if r == "r13":
        try:
            os.mkdir(log + "-died")
        except FileExistsError:
            return r
        os._exit(1)  # the Python worker goes, and its task with it
    return r
rows = spark.range(40).selectExpr("concat('r', id) AS request")
out = calls.answered(rows, ask, store, policy=calls.Policy(concurrency=1, batch=1, tries=1, first_wait=0.0), buckets=1)
print("ROWS", out.where("answer = request").count())
"""


def test_a_task_that_dies_does_not_ask_again_what_it_kept(folders):
    log, store = folders
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", LOST.format(repo=repo, log=log, store=store)], capture_output=True, text=True, timeout=240)
    assert "ROWS 40" in out.stdout, out.stderr[-2000:]
    asked = _asked(log)
    assert len(asked) == 40 and asked.pop("r13") == 2 and set(asked.values()) == {1}


def _ranges(fail: list, ran: list) -> list[Stage]:
    def second(t):
        ran.append("b")
        if fail:
            raise RuntimeError("killed")
        return t["a"].selectExpr("id * 2 AS id")

    def first(t):
        ran.append("a")
        return t["x"].where("id > 1")

    return [Stage("a", first, ("x",)), Stage("b", second, ("a",), {"times": 2})]


def test_a_killed_run_resumes(spark, tmp_path):
    folder, ran = str(tmp_path), []
    x = spark.range(5)
    with pytest.raises(stages.StageFailed):
        stages.resumed(spark, _ranges([1], ran), {"x": x}, folder)
    seen = {r["stage"]: (r["status"], r["error"]) for r in stages.states(spark, folder).collect()}
    assert seen == {"a": ("done", None), "b": ("failed", "RuntimeError: killed")}
    out = stages.resumed(spark, _ranges([], ran), {"x": x.orderBy(F.desc("id"))}, folder)
    assert ran == ["a", "b", "b"] and sorted(r["id"] for r in out["b"].collect()) == [4, 6, 8]
    assert {r["stage"]: (r["status"], r["n_rows"]) for r in stages.states(spark, folder).collect()} == {"a": ("reused", 3), "b": ("done", 3)}


def test_half_a_table_is_written_anew(spark, tmp_path):
    folder, ran = str(tmp_path), []
    stages.resumed(spark, _ranges([], ran), {"x": spark.range(5)}, folder)
    table = next(p for p in tmp_path.iterdir() if p.name.startswith("a-"))
    (table / "_SUCCESS").unlink()
    stages.resumed(spark, _ranges([], ran), {"x": spark.range(5)}, folder)
    assert ran == ["a", "b", "a"]  # the same rows come out, so what follows is kept


def test_other_rows_or_parameters_run_again(spark, tmp_path):
    folder, ran = str(tmp_path), []
    stages.resumed(spark, _ranges([], ran), {"x": spark.range(5)}, folder)
    stages.resumed(spark, _ranges([], ran), {"x": spark.range(6)}, folder)
    changed = [s if s.name == "a" else Stage(s.name, s.run, s.needs, {"times": 3}) for s in _ranges([], ran)]
    stages.resumed(spark, changed, {"x": spark.range(6)}, folder)
    assert ran == ["a", "b", "a", "b", "b"]
    with pytest.raises(ValueError):
        stages.resumed(spark, [Stage("x", lambda t: t["x"], ("x",))], {"x": spark.range(1)}, folder)
    with pytest.raises(ValueError):
        stages.resumed(spark, [Stage("c", lambda t: t["d"], ("d",))], {"x": spark.range(1)}, folder)


def test_fingerprints(spark):
    same = [spark.createDataFrame(rows, "a long, b string") for rows in ([(1, "x"), (2, None)], [(2, None), (1, "x")], [(1, "x"), (2, "")], [(1, "x"), (2, None), (2, None)])]
    a, b, c, d = map(stages.content_fingerprint, same)
    assert a == b and len({a, c, d}) == 3
    assert stages.content_fingerprint(spark.range(0)) == stages.content_fingerprint(spark.range(0))


VALUES = ['{"b": 1, "a": {"z": "u v", "n": null}, "l": [1.5, [], {}, "é", [["d"]]]}', '{"l":[1.5,[],{},"é",[["d"]]],"a":{"n":null,"z":"u v"},"b":1}', "{bad", None, '"alone"', "7", "null", "[]", "{}", '{"x": true, "x2": false}', '{"q": "\\"\\n"}']


def _walk(v, path="$"):
    if isinstance(v, dict):
        for k in sorted(v):
            yield from _walk(v[k], f"{path}.{k}")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from _walk(x, f"{path}[{i}]")
    elif v is not None:
        yield path, "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number", str(v).lower() if isinstance(v, bool) else str(v)


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def test_leaves_and_text_against_a_walk(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)) + [(0, VALUES[0])], "id long, path_ string")
    got = nested.leaves(df, "path_", ["id"])
    want = [(i, *leaf) for i, v in [*enumerate(VALUES), (0, VALUES[0])] for leaf in _walk(_parsed(v))]
    assert sorted((r["id"], r["path"], r["kind"], r["value"]) for r in got.collect()) == sorted(want)
    text = {r["id"]: r["text"] for r in nested.all_text(nested.leaves(df.dropDuplicates(), "path_", ["id"]), ["id"]).collect()}
    assert text == {i: " ".join(x for _, kind, x in _walk(_parsed(v)) if kind == "string") for i, v in enumerate(VALUES) if any(k == "string" for _, k, _ in _walk(_parsed(v)))}


def test_equal_values_are_one(spark):
    df = spark.createDataFrame([(10 - i, v) for i, v in enumerate(VALUES)], "id long, v string")
    got = {r["canonical"]: (r["n"], r["first"]) for r in nested.distinct_values(df, "v", "id").collect()}
    assert got[json.dumps(_parsed(VALUES[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)] == (2, 9)
    assert got["text:{bad"] == (1, 8) and len(got) == 9


def test_long_lists_keep_their_order(spark):
    df = spark.createDataFrame([(1, json.dumps([f"w{i}" for i in range(25)]))], "id long, v string")
    assert nested.all_text(nested.leaves(df, "v", ["id"]), ["id"]).first()["text"] == " ".join(f"w{i}" for i in range(25))


POINT = "id string, vec array<double>, community_id string, chunk_id string, entities array<string>, predicates array<string>"


def test_evidence_of_one_direction(spark):
    import random

    random.seed(5)
    base = [[random.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    old = [(f"o{i:02}", v, "c" if i % 3 else None, "1", [f"e{i}"], ["p"]) for i, v in enumerate(base)]
    new = [(f"n{i:02}", [x * (i + 1) * 0.37 for x in v], "c" if i % 3 else None, "1" if i % 4 else "2", [f"f{i}"], ["q"]) for i, v in enumerate(base[:20])]
    new += [("twin1", [9.0] * 8, "c", "1", ["t"], ["q"]), ("twin2", [0.1] * 8, "c", "1", ["s"], ["q"]), ("back", [-9.0] * 8, "c", "1", ["t"], ["q"])]
    new += [("zero", [0.0] * 8, "c", "1", ["z"], []), ("zero2", [0.0] * 8, "c", "1", ["z"], []), ("nan", [float("nan")] * 8, "c", "1", ["z"], []), ("null", None, "c", "1", ["z"], []), ("hole", [1.0, None] * 4, "c", "1", ["z"], [])]
    new += [("near", [x + 1e-4 for x in base[30]], "c", "1", ["z"], [])]
    got = {r["id"]: r for r in evidence.merge_by_direction(spark.createDataFrame(old, POINT), spark.createDataFrame(new, POINT)).collect()}
    for i in range(20):
        if i % 4:
            assert got[f"o{i:02}"]["entities"] == sorted([f"e{i}", f"f{i}"]) and got[f"o{i:02}"]["predicates"] == ["p", "q"] and f"n{i:02}" not in got
        else:  # another chunk
            assert got[f"n{i:02}"]["is_new"] and got[f"o{i:02}"]["entities"] == [f"e{i}"]
    assert got["twin1"]["entities"] == ["s", "t"] and "twin2" not in got
    assert {"back", "zero", "zero2", "nan", "null", "hole", "near"} <= set(got)
    assert len(got) == 40 + 5 + 1 + 7


def test_directions_against_brute_force_with_a_wide_threshold(spark):
    import math
    import random

    random.seed(7)
    v = [[random.gauss(0, 1) for _ in range(3)] for _ in range(160)]
    v += [[x + random.gauss(0, 0.002) for x in random.choice(v[:40])] for _ in range(120)]
    least = 1 - 1e-5

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    up = list(range(len(v)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(v)):
        for j in range(i):
            if cos(v[i], v[j]) >= least:
                up[max(root(i), root(j))] = min(root(i), root(j))
    rows = evidence.same_direction(spark.createDataFrame(list(enumerate(v)), "id long, vec array<double>"), [], least).select("id", "direction").collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["direction"], set()).add(r["id"])
    want: dict = {}
    for i in range(len(v)):
        want.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and any(len(g) > 2 for g in groups.values())
