"""Stages of the pipeline against plain versions."""

import random

import public_tokenizers
from test_documents import plain_components, plain_dedup
from tokenizers import Tokenizer

import corpus_pipeline
from merchantlens.llm import queries


def test_near_copies_between_the_two_rules_go(spark, documents):
    words = [[f"{name}{n}" for n in range(100)] for name in "abc"]
    replaced = [f"x{n}" if n in (30, 60) else word for n, word in enumerate(words[0])]  # 0.811; 0.848 by 4 words
    longer = words[1] + [f"y{n}" for n in range(20)]  # 0.828; 0.829 by 4 words
    apart = [f"z{n}" if n in (20, 40, 60) else word for n, word in enumerate(words[2])]  # 0.730
    texts = [words[0], replaced, words[1], longer, words[2], apart]
    docs = documents([(n, " ".join(text)) for n, text in enumerate(texts)])
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [0, 2, 4, 5]


def test_one_row_of_a_component_stays_whatever_its_key(spark, documents):
    text = {name: " ".join(f"{name}{n}" for n in range(50)) for name in "abcd"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["b"] + " end"), (2, text["c"])]
    rows += [(None, text["c"] + " end"), (None, text["d"]), (None, text["d"] + " end"), (None, text["d"])]
    rows += [(3, None), (3, None), (None, None), (4, "")]
    kept = corpus_pipeline.one_of_each(spark, documents(rows), "").collect()
    found = [(r.doc_id, r.text[0] if r.text else r.text) for r in kept]
    assert sorted(found, key=str) == sorted(
        [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None), (None, None), (4, "")], key=str
    )


def test_stages_after_the_classifiers_against_plain_versions(spark, documents, tmp_path):
    rng = random.Random(9)
    texts = []
    for _ in range(15):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 60, 150]))]
        for _ in range(3):
            if rng.random() < 0.7:
                words = [*words]
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            lines = ["Common line"] * (rng.random() < 0.6) + [" ".join(words), f"own {rng.randrange(20)}"]
            texts.append("\n".join(lines))
    docs = documents(list(enumerate(texts)))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[2:4]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    kept = [text for _, _, text in plain_dedup(texts, 10)]
    stays = {n: kept[n] for n, (_, root) in enumerate(plain_components(kept, corpus_pipeline.NEAR)) if root == n}
    assert 0 < len(stays) < len(texts) and kept != texts
    assert {r.doc_id: r.text for r in docs.collect()} == stays
    tokens = {}
    for r in corpus_pipeline.packed(spark, docs, "").collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = {n: len(library.encode(text, add_special_tokens=False).ids) + 1 for n, text in stays.items()}
    assert tokens == encoded


def test_classifiers_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    clean = queries.table(spark, sf, "labels").where("quality = 1").join(docs, "doc_id").select("doc_id").distinct()
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
    kept, total = docs.join(clean, "doc_id", "left_semi").count(), clean.count()
    assert kept >= 0.95 * total
