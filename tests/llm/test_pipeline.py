"""The pipeline over planted documents: junk, copies, benchmark passages and secrets, against what should be left."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from ocellus.llm import packing


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(["ba", "to", "li", "ne", "sur", "em"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    say = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n // 12)) + "."
    good = {k: say(120) for k in range(300)}
    junk = {300 + k: " ".join(f"{rng.choice(vocabulary)}%%%{rng.choice('#$&')}" for _ in range(80)) for k in range(120)}
    bench = [(k, say(36)) for k in range(5)]
    leaks = {500 + k: f"{say(48)} {t} {say(48)}" for k, t in bench}
    leaks |= {520: f"{say(1200)} {bench[0][1]} {say(1200)}"}
    copies = {600 + k: good[k] for k in range(20)} | {700 + k: good[k] + " " + rng.choice(vocabulary) for k in range(20, 40)}
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    secret = {800: f'{say(60)} token = "{key}" {say(60)}'}
    docs = good | junk | leaks | copies | secret
    at = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, 0) for k in good if k % 2] + [(k, 0, 0) for k in junk if k % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    want = good | {800: secret[800].replace(f'token = "{key}', "[SECRET]")}
    return at, want


def test_stages_keep_clean_documents(spark, planted):
    at, want = planted
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, at)
        assert docs.columns == columns
        docs.write.parquet(f"{at}/stage{k}")
        docs = spark.read.parquet(f"{at}/stage{k}")
    assert {r.doc_id: r.text for r in docs.collect()} == want
    assert docs.where("n_chars != length(text)").count() == 0


def test_run_packs_what_is_left(spark, planted):
    from tokenizers import Tokenizer

    at, want = planted
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, at).collect():
        got[r.doc_id] += r.length
    assert got == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in want.items()}


def test_empty_documents(spark, planted):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, planted[0])
        assert made.count() == 0
