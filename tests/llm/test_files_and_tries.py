"""The erasure, the prefix trie and the token files against plain Python."""

import hashlib
import math
import os
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import _pieces, bpe, erasure, prefix_trie, token_files
from weftgraph.llm.queries import QUERIES, SHOP, SHOP_COLUMNS

SF = "/root/testdata/sf0.001"
crc = lambda x: zlib.crc32(("" if x is None else str(x)).encode())
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def nulls_first(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def erased_by_hand(tables):
    owner = {}
    for r in tables["sales"]:
        owner.setdefault(r["sale_id"], r["client_id"])
    clicks = Counter(r["client_id"] for r in tables["clicks"])
    busy = Counter()
    for r in tables["clients"]:
        if r["master_id"] is not None:
            busy[r["master_id"]] += clicks[r["client_id"]]
    masters = {m for m in busy if crc(m) % 100 == 0} | ({min(busy, key=lambda m: (-busy[m], m))} if busy else set())
    clients = {r["client_id"] for r in tables["clients"] if r["master_id"] in masters}
    sales = {r["sale_id"] for r in tables["sales"] if r["client_id"] in clients and r["client_id"] is not None}
    gone = {"clients": lambda r: r["master_id"] in masters, "clicks": lambda r: r["client_id"] in clients, "sales": lambda r: r["client_id"] in clients, "sale_lines": lambda r: r["sale_id"] in sales}
    out = {}
    for name, rows in tables.items():
        first, money = SHOP_COLUMNS[name]
        rows = sorted(rows, key=lambda r: (crc(owner.get(r["sale_id"]) if name == "sale_lines" else r["client_id"]), nulls_first(r.values())))
        size = 1 + len(rows) // 150
        for at in range(0, len(rows), size):
            mine = rows[at : at + size]
            kept = [r for r in mine if not gone[name](r)]
            if kept:
                cents = sum(math.floor(100 * r[money] + 0.5) for r in kept if r[money] is not None)
                out[name, at // size] = (len(kept), len(mine) - len(kept), cents, len(kept) < len(mine), sha(",".join("" if r[first] is None else str(r[first]) for r in kept)), ",".join(rows[0]), kept)
    return out


def test_erasure_query(spark):
    got = QUERIES["op11_cascading_erasure"](spark, SF).collect()
    want = erased_by_hand({name: pq.read_table(f"{SF}/{name}.parquet").to_pylist() for name in SHOP_COLUMNS})
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in got} == {k: v[:-1] for k, v in want.items()}
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)
    top = os.path.dirname(os.path.dirname(got[0].path)).removeprefix("file:")
    assert sorted(os.path.join(d, f) for d, _, fs in os.walk(top) for f in fs if not f.endswith(".crc")) == sorted(r.path.removeprefix("file:") for r in got)
    for r in got[::7]:
        file = pq.ParquetFile(r.path.removeprefix("file:"))
        assert file.read().to_pylist() == want[r.table_name, r.file_no][-1]
        first = [x[SHOP_COLUMNS[r.table_name][0]] for x in want[r.table_name, r.file_no][-1]]
        stats = file.metadata.row_group(0).column(0).statistics
        known = [x for x in first if x is not None]
        assert (stats.min, stats.max) == (min(known), max(known)) if known else stats.null_count == len(first)


def test_erasure_of_odd_tables(spark, tmp_path):
    when = datetime(2024, 1, 1)
    tables = {
        "clients": spark.createDataFrame([(1, 11, 5.0), (1, 11, 5.0), (2, None, None), (None, 11, 1.0), (3, 12, float("nan"))], "client_id long, master_id long, balance double"),
        "clicks": spark.createDataFrame([], "click_id long, client_id long, value double"),
        "sales": spark.createDataFrame([(7, 1, when), (7, 1, when), (8, None, None), (9, 3, when)], "sale_id long, client_id long, at timestamp_ntz"),
        "sale_lines": spark.createDataFrame([(7, 1), (7, 1), (None, 2), (99, 3), (9, 4)], "sale_id long, line_no int"),
    }
    victims = erasure.cascade(tables, SHOP, {"masters": spark.createDataFrame([(11,), (11,), (None,)], "key long")})
    assert {k: sorted(r.key for r in v.collect()) for k, v in victims.items()} == {"masters": [11], "clients": [1], "sales": [7]}
    left = {}
    for name, df in tables.items():
        paths = erasure.write_sorted(df, f"{tmp_path}/{name}", 2)
        final = erasure.rewrite(spark, f"{tmp_path}/{name}", paths, SHOP, name, victims)
        left[name] = [tuple(r.values()) for k in sorted(final) for r in pq.read_table(final[k][0]).to_pylist()]
    assert left["clicks"] == [] and left["sales"] == [(8, None, None), (9, 3, when)] and left["sale_lines"] == [(None, 2), (9, 4), (99, 3)]
    assert [r[:2] for r in left["clients"]] == [(2, None), (3, 12)]


def test_cascade_ends_on_cycles(spark):
    people = spark.createDataFrame([(1, 4), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "id long, boss long")
    found = erasure.cascade({"people": people}, [erasure.Relation("people", "people", "boss", "id")], {"people": spark.createDataFrame([(2,)], "key long")})
    assert sorted(r.key for r in found["people"].collect()) == [1, 2, 3, 4]


def trie_by_hand(convs):
    members, sizes = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            sizes[tuple(turns[:d])] = len(turns[d - 1][1].encode()) if d else 0
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(1 for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(n) == len(node) + 1 for n in below), leaves, sum((len(members[n]) - 1) * sizes[n] for n in below), sha(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node)))))
    return out


def nodes(df):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def rebuilt_by_hand(rows, group=5, most=9):
    own = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        own.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    return {c: own.get(c - c % group, [])[: crc(c) % most] + t[crc(c) % most :] for c, t in own.items()}


def test_trie_query(spark):
    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    got = QUERIES["op12_prefix_trie"](spark, SF)
    assert nodes(got) == trie_by_hand(rebuilt_by_hand(rows)) and got.count() == len(nodes(got))


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLOTS", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    monkeypatch.setattr(prefix_trie, "CHAIN", 2)
    rows = [(c, t, "user", f"turn {t}") for c in range(10, 60) for t in range(7)]
    rows += [(c, t, "user", "é" * t) for c in (200, 201) for t in range(12)] + [(200, 12, None, None)] + [(300, t, "x", str(t)) for t in range(9)]
    rows += [(301, None, None, None), (301, None, None, None), (301, 0, "ab", "c"), (302, 0, "a", "bc"), (None, 1, "user", "x"), (302, 1, "user", "y" * 70_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_convs int")
    named = [dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows if r[0] is not None]
    assert nodes(prefix_trie.trie(prefix_trie.turns(df))) == trie_by_hand(rebuilt_by_hand(named, 1, 1))
    assert nodes(prefix_trie.trie(prefix_trie.rebranched(prefix_trie.turns(df)))) == trie_by_hand(rebuilt_by_hand(named))
    assert prefix_trie.trie(prefix_trie.rebranched(prefix_trie.turns(df.limit(0)))).count() == 0
    # one conversation without turns of its own is still a member of the root
    alone = prefix_trie.rebranched(prefix_trie.turns(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")))
    assert nodes(prefix_trie.trie(alone)) == trie_by_hand({1: []} if crc(1) % 9 else {1: [("user", "a")]})


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        raw = token_files.pack(ids, bits)
        assert len(raw) == -(-n * bits // 8)
        assert (token_files.unpack(raw, bits, n) == ids).all()


def test_pieces_are_those_of_the_pattern():
    texts = ["it's  they'll we'VE 'tis \n\n x", "", "'s's ''s", "a'", "'r", "éà 中文 12٣ ²x　  y\x85", "  ", "😀😀 !?'re'", "\t'm\n'd"]
    words, codes, counts = _pieces.cut(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert [words[i] for i in codes[at : at + n]] == bpe.regex.compile(bpe.PATTERN).findall(text)
        at += n


def by_hand(rows, end=0):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = [], 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, at, len(ids), np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    return out


def test_token_files_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    got = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op13_token_files"](spark, SF).collect()}
    assert got == {(d, at, n, zlib.crc32(raw)) for d, at, n, raw in by_hand(rows)}


def test_token_files_of_odd_rows(spark, tmp_path):
    texts = [None, "", "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "it's ' s", "é" * 3000 + " 中文", "a b " * 40_000, "same", "same"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "again")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    manifest = token_files.write(df, public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/f", file_ids=2000)
    assert manifest.count() > 1
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read(spark, f"{tmp_path}/f").collect()), key=lambda r: r[1])
    twice = [r[3] for r in got if r[0] == 3]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by_hand([r])[0][3] != twice[0] if r[0] == 3 else 0))
    assert got == by_hand(order)
    empty = token_files.write(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/e")
    assert empty.count() == 0 and token_files.read(spark, f"{tmp_path}/e").count() == 0


def test_token_files_of_other_vocabularies(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "Hello  World, it's"), (2, "é")], "doc_id long, text string")
    token_files.write(df, path, f"{tmp_path}/w", end_id=49407)
    library = Tokenizer.from_file(path)
    got = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in token_files.read(spark, f"{tmp_path}/w").collect()}
    assert got == {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 49407] for r in df.collect()}


def test_random_access(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k} " * 2000) for k in range(30)], "doc_id long, text string")
    name = token_files.write(df.coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/r").orderBy("start").first().name
    file = token_files.IdFile(f"{tmp_path}/r/{name}")
    whole = file.ids(0, file.n_ids)
    k = file.n_docs // 2
    file.reads = 0
    assert (file.document(k) == whole[file.firsts[k] : file.firsts[k + 1]]).all()
    assert 0 < file.reads <= 3 * token_files.BLOCK_IDS * file.bits // 8 < file.n_ids * file.bits // 8
