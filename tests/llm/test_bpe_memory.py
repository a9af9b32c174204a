"""What a BPE task holds: the vocabulary as flat arrays, words in two halves, and texts cut a bounded number of characters at a time."""

import tracemalloc

from tokenizers import Tokenizer

from weftgraph.llm import bpe, queries


def held(make):
    """What ``make`` returns, and MB that are held after it and at most during it."""
    tracemalloc.start()
    try:
        out = make()
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return out, now / 1e6, most / 1e6


def test_the_vocabulary_of_a_task_is_small(spark):
    read = bpe._reader(spark.range(1), queries.VOCABULARY)
    read()  # the broadcast's value is loaded
    model, now, most = held(read)
    assert now < 25 and most < 40
    library = Tokenizer.from_file(queries.VOCABULARY)
    texts = ["", "A small vocabulary's tables", "naïve ĳ 東京 \U0001f600 1234567", "\n\n  x y\x00"] + [model.decode([i]) for i in range(0, 50_000, 7)]
    assert [x.tolist() for x in model.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_some_at_a_time(spark):
    model = bpe._reader(spark.range(1), queries.VOCABULARY)()
    texts = [f"document {i} " + "the same few words again, " * 800 for i in range(200)]
    ids, _, most = held(lambda: model.encode(texts))
    assert most < 90
    assert [len(x) for x in ids] == [len(x.ids) for x in Tokenizer.from_file(queries.VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_words_in_use_stay_known_when_the_older_half_goes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    with open(queries.VOCABULARY, "rb") as file:
        model = bpe.TrieBpe(file.read())
    walked = []
    traverse = model.traverse
    monkeypatch.setattr(model, "traverse", lambda words: traverse(walked.extend(w := list(words)) or w))
    for i in range(300):
        model.encode(["common words " + " ".join(f"w{i}x{k}" for k in range(5))])
    assert walked.count("common") == 1
    assert model.held <= 20_000 // 2 + 10_000
