"""Operators that work row by row: brute force, round trips, held-out accuracy, odd rows."""

import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm import bpe, chat_format, decontaminate, html_main, lang_id, license_scan, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", None), (None, "   \n\t", "x"), (4, "a" * 300_000 + " bc " * 2000, "y"), (4, "a" * 300_000 + " bc " * 2000, "y"), (5, "!!! 123", None)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("ids", F.lit(1)).withColumn("score", F.lit("s")).withColumn("id", F.lit(0))


def test_odd_rows(spark, odd):
    empty = odd.where("false")
    assert len(bpe.round_trip(odd, queries.VOCABULARY).collect()) == 6 and not bpe.round_trip(empty, queries.VOCABULARY).collect()
    found = {r.doc_id: r for r in license_scan.summary(license_scan.scan(odd)).collect()}
    assert found[1].n_words == 0 and found[1].first_word is None and found[1].labels == "" and found[4].n_words == 2001
    model = lang_id.fit(odd)
    assert {r.doc_id: r.lang_pred for r in lang_id.predict(odd, model).collect()} | {4: ""} == {1: "und", 2: "und", None: "und", 4: "", 5: "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in lang_id.predict(odd, lang_id.fit(empty)).collect())
    nothing = toxicity.fit(odd.withColumn("toxic", F.lit(None).cast("int")))
    assert [r.score for r in toxicity.score(odd, nothing).collect()] == [0.0] * 6
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "!!! 123")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(odd, bench).collect()] == [(5, None)]
    pages = odd.withColumnRenamed("text", "html").withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit(None).cast("string"))
    assert len(html_main.extract(pages).collect()) == 6


def test_bpe_equals_the_library(spark):
    texts = ["Hello world's  test\n\n\tof 123 naïve 漢字 ½ <|endoftext|> é", "ไทย ก็   x \x1c\x85 y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", ""]
    library = Tokenizer.from_file(queries.VOCABULARY)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, queries.VOCABULARY).collect()}
    coded = {r.doc_id: r.ids for r in bpe.encode(df, queries.VOCABULARY).collect()}
    for k, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert got[k].ids == coded[k] == want and got[k].decoded == library.decode(want, skip_special_tokens=False)
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, queries.VOCABULARY), queries.VOCABULARY).collect()} == dict(enumerate(texts))


def test_license_base_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, SF).collect()}
    hits = 0
    for d in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text))
        places = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        hits += len(places)
    assert hits


def test_license_markup():
    a = license_scan.compile_templates({"x": "may <<beginOptional>>freely<<endOptional>> copy <<var;name=n;match=[a-z]+;max=2>> under <<var;name=v;match=v[0-9];max=1;min=1>>"})
    hit = lambda t: [h[0] for h in a.scan(license_scan.words_of(t))]
    assert hit("You may copy under v2") == ["x"] and hit("may freely copy this work under v3") == ["x"]
    assert not hit("may copy under") and not hit("may not copy under v2") and not hit("may copy a b c under v2")


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in queries.op2_language_id(spark, SF).collect() if r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) > 0.95 * len(rows)


def test_toxicity_learns_words(spark):
    rows = [(k, " ".join(["some", "plain", f"w{k}", *(["idiot"] if k % 2 else []), "text", f"v{k % 7}"]), k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 300"))
    out = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((out[k] >= 0.7) == bool(k % 2) for k in range(300, 400)) and len(model[1]) < 200


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "Then Anna Smith has 12 apples and gives 3.5 kg to poor old Bob because he asked for it")], "item_id long, text string")
    docs = [(1, "x. Then Carl has 7 apples and gives 40 kg to poor old Dora Lee because he asked for it!"), (2, "Then Anna Smith has 12 apples and gives 3.5 kg to poor old Bob because he asked for it"), (3, "Then Anna Smith has some pears and gives none to anyone because nobody asked for it")]
    got = {r.doc_id: (r.n_words, r.exact) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_words=1).collect()}
    assert set(got) == {1, 2} and not got[1][1] and got[2][1]


def test_decontamination_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, SF).collect()} >= {(d, i) for d, t in docs for i, q in items if q in t} != set()


def test_decontamination_edges():
    items = [
        b"3 kg Boston 7 kg weigh more than their makers ever said",  # few literal words in the first window
        b"Alice had twelve pears and gave them all away quietly",  # a name or not, by what stands before
        b"Alice Smith Jones sold 3 apples then walked home over the hills",
        b"minutes after noon she closed the little shop with 4 locks and left Bob",  # a unit or not
        b"rows 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 end with these five plain words here",
        b"Ann pays 5 euros, Ben pays 6 euros and both of them walk 7 km home before dark",
    ]
    block = decontaminate.Block(list(enumerate(items)), 8)

    def found(text):
        return {(k, n, exact) for k, n, _, exact in block.find(decontaminate.Template(text), 13)}

    for k, item in enumerate(items):
        for before in (b"", b"we read (x) ", b"as, ", b"so - ", b'he said "', b"it took 5 ", b"and Carol "):
            for after in (b"", b" Smith went on", b". Next", b" 5"):
                hits = {f[0]: f[2] for f in found(before + item + after)}
                assert hits.get(k), (before, item, after)
    assert (0, 12, False) in found(b"so 9 kg Denver 2 kg weigh more than their makers ever said")
    assert {f[0] for f in found(b"they say, Carol had twelve pears and gave them all away quietly")} == {1}
    assert {f[0] for f in found(b"x 1 2 3 4 5 6 7 8 9 10 11 12 13 y")} == {4}  # a run word for word, all of it numbers
    assert not found(b"x 1 2 3 4 5 6 7 8 9 10 11 12 y") and not found(b"x 1 7 3 4 5 6 2 8 9 3 4 5 6 7 8 9 9 y")
    assert {f[:2] for f in found(b"zz pays 8 euros, Dan pays 8 euros and both of them walk 7 km home before dark")} == {(5, 15)}  # behind the clash of 8 with 5 and 6


def test_html():
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy now and save so much money today.</div><article><h1>A &amp; B</h1><p>First <b>para</b>\n graph.<br>More<p>ok<div class="comments"><p>Nice post, thanks for all of these many words.</p></div></article><footer>&copy; x</footer>'
    assert html_main.main_text(page) == "A & B\n\nFirst para graph. More\n\nok"
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<nav>x</nav>") == ""


def test_html_wrappers_and_fallbacks():
    text = "The first of many words that this article has about rivers and how they came to run where they run."
    own = f"<article><h1>Rivers</h1><p>{text}</p></article>"
    for wrapper in ('div class="content no-sidebar"', 'div class="share-enabled"', 'div class="content sidebar"', 'section id="cookie-page"', "form", 'div class="layout has-menu"', 'div class="search popup"'):
        page = f"<body><nav>x</nav><{wrapper}>{own}<footer>y</footer></{wrapper.split()[0]}></body>"
        assert html_main.main_text(page) == f"Rivers\n\n{text}", wrapper
    for other in ('div class="comments"', 'div class="related content-related"', "aside", "nav", 'div class="sidebar"', 'div style="display:none"', 'div class="ad"', 'div class="comment-content"'):
        page = f"<body>{own}<{other}><article><p>{text} Not this.</p></article></{other.split()[0]}></body>"
        assert html_main.main_text(page) == f"Rivers\n\n{text}", other
    page = f"<article><p>{text} Here <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds.</p><p>{text}<noscript> Plain.</noscript><canvas id=c> Drawn.</canvas><object data=o> Shown.</object></p></article>"
    assert html_main.main_text(page) == f"{text} Here x=2 holds.\n\n{text} Plain. Drawn. Shown."


def test_min_cut_is_least():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        odds = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0, 2), 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda keep: sum(max(x, 0) if not k else max(-x, 0) for x, k in zip(odds, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        assert abs(cost(html_main.min_cut(odds, edges)) - min(map(cost, itertools.product((True, False), repeat=n)))) < 1e-6


def test_preferences(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "bad"), (2, 0, "user", "alone"), (None, 0, "user", "z"), (4, 0, None, None), (5, 0, None, None), (5, 1, "assistant", "x")]
    convs = chat_format.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.chosen_id: r for r in chat_format.preferences(convs, chat_format.pair_neighbours(convs)).collect()}
    assert set(out) == {0, 4}
    r = out[0]
    assert r.n_common == 3 and r.prompt.count("<|im_start|>") == 3 and "good" in r.chosen and "bad" in r.rejected
    a, z = map(int, r.chosen_mask.split("-"))
    assert r.chosen[a:z] == "good<|im_end|>"
    assert out[4].n_common == 1 and out[4].chosen == "" and out[4].rejected_mask


def test_other_replies(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (2, 0, "user", "alone"), (4, 0, "assistant", None), (4, 0, "assistant", None), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("n_common", F.lit(1))
    chosen, rejected = chat_format.other_replies(chat_format.turns(df))
    pairs = chosen.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    out = {r.chosen_id: r for r in chat_format.preferences(chosen, pairs, rejected=rejected).collect()}
    assert {k: r.n_common for k, r in out.items()} == {0: 1, 1: 1, 2: 1, 4: 2}
    assert "a<" in out[0].chosen and "b<" in out[0].rejected and "\nr<" not in out[0].chosen and out[0].prompt.count("<|im_start|>") == 1
    assert out[1].rejected.endswith("assistant\n<|im_end|>\n") and out[2].chosen == out[2].rejected == ""
    empty = chat_format.other_replies(chat_format.turns(df.where("false")))
    assert not chat_format.preferences(empty[0], pairs.where("false"), rejected=empty[1]).collect()


def test_preferences_of_long_texts(spark):
    long = "word " * 200_000
    convs = chat_format.turns(spark.createDataFrame([(k, t, "user" if t == 0 else "assistant", long + str(k * t)) for k in (0, 1) for t in (0, 1)], "conv_id long, turn long, role string, text string"))
    (r,) = chat_format.preferences(convs, chat_format.pair_neighbours(convs)).collect()
    a, z = map(int, r.rejected_mask.split("-"))
    assert r.n_common == 1 and r.rejected[a:z] == long + "1<|im_end|>"


def test_decontamination_wrapped_and_lowered():
    item = b"Then Anna Smith has 12 apples and gives 3.5 kg to poor old Bob because he asked for it"
    full = b"Sam bought 5 kg of rice and 3 litres of milk for 12 euros at the shop in Paris then walked 4 km back to see Anna and Bob at home"
    block = decontaminate.Block([(0, item), (1, full)], 8)
    find = lambda t: {k: (n, exact) for k, n, _, exact in block.find(decontaminate.Template(t), 13)}
    for text, k in ((item, 0), (full, 1)):
        words = text.split()
        for form in (text, text.lower(), text.replace(b" ", b"\n"), b"\n".join(b" ".join(words[i : i + 4]) for i in range(0, len(words), 4))):
            assert find(b"so, " + form + b". x")[k] == (len(decontaminate.Template(text)), True)
    assert find(b"then carl has 7 apples and gives 4 kg to poor old dora because he asked for it")[0] == (18, False)
    assert find(b"Then Carl\nhas 7 apples and gives 4 kg to poor old\nDora because he asked for it")[0] == (18, False)
    # Anna and Bob may not both be carl: the run begins behind the first one, and ends before dora.
    assert find(b"then carl has 7 apples and gives 4 kg to poor old carl because he asked for dora and went") == {0: (15, False)}
    assert not find(b"then carl has 7 apples and gives 4 kg to poor old carl because dora went")


def test_html_cut_against_brute_force():
    import itertools
    import random

    rng = random.Random(8)
    moved = 0
    for _ in range(40):
        parts = [rng.choice([f"<p>{'word ' * rng.randint(1, 30)}</p>", f"<div class=ad>{'buy ' * rng.randint(1, 30)}</div>", f"<li><a href=x>{'go ' * rng.randint(1, 9)}</a></li>", "<div><p>short</p></div>"]) for _ in range(rng.randint(1, 10))]
        blocks, elements = html_main.blocks_of("<body>" + "".join(parts))
        odds, edges = html_main.costs(blocks, elements)
        cost = lambda keep: sum(max(x, 0) if not k else max(-x, 0) for x, k in zip(odds, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        found = html_main.min_cut(odds, edges)
        assert abs(cost(found) - min(map(cost, itertools.product((True, False), repeat=len(odds))))) < 0.01
        moved += found != [x > 0 for x in odds]
    assert moved


def test_html_long_and_odd_pages():
    import time

    page = "<body>" + "".join(f"<div class=ad>Buy {i}</div><p>Some text of some words that is long enough to count as content number {i}.</p>" for i in range(4000))
    start = time.time()
    assert html_main.main_text(page).count("\n\n") == 3999
    html_main.main_text("<div>" * 8000 + "x")
    assert time.time() - start < 5
    text = "The first of many words that this article has about rivers and how they came to run."
    for part in ('<div class="content-form"><p>{}</p></div>', '<section id="related-work"><p>{}</p></section>', "<svg><g><svg></svg><text>lost</text></svg><p>{}</p>", "<svg><g><p>{}</p>", '<p>{}</p><div class="comments"><p>' + "A reader's long comment. " * 30 + "</p></div>"):
        assert html_main.main_text(f"<body><article><h1>Rivers</h1>{part.format(text)}</article></body>") == f"Rivers\n\n{text}", part


def test_html_classifier(spark):
    pages = [(k, f"<article><p>{'word ' * 30}{k}</p><p>{'more ' * 12}{k}</p></article><nav><li><a href=x>go {k % 3}</a></li></nav>") for k in range(9)]
    fitted = html_main.fit(spark.createDataFrame(pages, "page_id long, html string"))
    assert fitted[1] > 0 > fitted[2] and (html_main.learn({}) == html_main.WEIGHTS).all()
    assert fitted @ html_main.features(*_only("<p>" + "word " * 20)) > 0 > fitted @ html_main.features(*_only("<li><a href=x>go"))
    copies = spark.createDataFrame(pages[:1] * 9, "page_id long, html string")  # copies of one page teach no boilerplate
    assert (html_main.fit(copies) == html_main.WEIGHTS).all()


def test_html_query_against_written_texts(spark, tmp_path):
    text = "The first of many words that this article has about rivers and how they came to run where they run."
    own, note = f"<h1>Rivers &amp; seas</h1><p>{text}</p>\n<p>Second \n one. {text}</p>", f"<p>{text} Not this.</p>"
    kept = f"Rivers & seas\n\n{text}\n\nSecond one. {text}"
    cases = [tuple(x and x.replace("first", f"first{k}").replace("Second", f"Second{k}").replace("Not", f"Not{k}") for x in case) for k, case in enumerate([
        (f"<form id=aspnetForm><div id=content>{own}</div></form>", kept),
        (f"<div class='content-sidebar-wrap'><div class=content>{own}</div><aside>{note}</aside></div>", kept),
        (f"<div id=search-results-page><div class=entry-content>{own}</div></div>", kept),
        (f"<div class=widget-area><article>{own}</article></div>", kept),
        (f"<form><div>{own}</div><button>Send now</button></form>", kept),
        (f"<form><article>{own}</article><div class=comments>{note * 9}</div></form>", kept),
        (f"<main>{own}</main><div class=sidebar><article>{note * 3}</article></div>", kept),
        (f"<article>{own}<h2>Sources</h2><ul><li><a href=x>One of them</a></li><li><a href=y>Two</a></li></ul></article>", f"{kept}\n\nSources\n\nOne of them\n\nTwo"),
        (f"<header>{note}</header><nav><a href=x>Home</a></nav><article>{own}<div class=ad>{note}</div></article><footer>{note}</footer>", kept),
        (f"<div class=related><article>{note}</article></div>", ""),
        ("", ""),
        (None, ""),
    ])]
    rows = [(k // 2, None if k % 3 else f"u{k}", h and f"<html><body>{h}</body></html>", "x", k) for k, (h, _) in enumerate(cases)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op10_html_main_text(spark, str(tmp_path))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    order = lambda r: (r[0], r[1] or "", r[2])
    expected = [(i, u, t, len(t)) for (i, u, *_), (_, t) in zip(rows, cases, strict=True)]
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_main.extract(none, html_main.fit(none)).count() == 0


def _only(page):
    blocks, elements = html_main.blocks_of(page)
    return blocks[0], elements[blocks[0].element]


def test_toxicity_conflicts_ties_and_names(spark):
    docs = spark.createDataFrame([(k, f"t{k % 2} w{k}", 0, 0) for k in range(60)] + [(7, "t1 again", 0, 0), (None, "t0", 0, 0)], "doc_id long, text string, _id int, _y int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 0), (5, None), (9, 7), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled_rows(docs, labels)
    assert {r.doc_id: r.toxic for r in rows.collect()} == {k: k % 2 for k in range(60)} and rows.count() == 61
    first, again = toxicity.fit(rows), toxicity.fit(rows.repartition(7))
    assert first[0] == again[0] and (first[2] == again[2]).all()
    assert toxicity.labelled_rows(docs, labels, sample_bytes=100).count() < 61
    scored = toxicity.score(docs, first, keep=("_id", "text"))
    assert scored.columns == ["doc_id", "_id", "text", "score"] and scored.count() == 62


def test_sample_of_very_many_rows(spark):
    from weftgraph.llm._frame import sampled

    ids = spark.range(200_000)
    assert ids.where(sampled("id", 10, 2 * 10**13)).count() == 0
    assert 900 < ids.where(sampled("id", 10**11, 2 * 10**13)).count() < 1100


def test_bpe_caches_and_documents(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    monkeypatch.setattr(bpe, "CACHE_STEPS", 5)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    library = Tokenizer.from_file(queries.VOCABULARY)
    with open(queries.VOCABULARY, "rb") as file:
        model = bpe.TrieBpe(file.read())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()] + ["x" * 5000, "long" * 3000 + " word"]
    for k in range(0, len(texts), 20):
        got = model.encode(texts[k : k + 20])
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[k : k + 20]]
    assert not [w for w in model.words if len(w) > bpe.LONG]
