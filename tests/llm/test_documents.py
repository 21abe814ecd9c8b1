import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merchantlens.llm import jaccard, langid, lines, packing, quality, sharding

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, "Some text, here."), (1, "Some text, here."), (2, None), (3, ""), (None, "x y " * 30_000), (4, "\n\n")]


# --- Sharding ----------------------------------------------------------------


def test_table_is_even_and_stable():
    names = [f"s{n}" for n in range(7)]
    table = sharding.fill(names, 1009)
    counts = [table.count(n) for n in range(7)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_fill_against_whole_preference_lists():
    names, size = ["a", "b", "c"], 101
    orders = []
    for name in names:
        offset = sharding._number(name, "offset") % size
        skip = sharding._number(name, "skip") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for shard, order in enumerate(orders):
            free = next((slot for slot in order if slot not in owner), None)
            if free is not None:
                owner[free] = shard
    assert sharding.fill(names, size) == [owner[slot] for slot in range(size)]


def test_every_row_gets_a_shard(documents, tmp_path):
    docs = documents(ODD, slot="'mine'", shard="2")
    placed = sharding.assign(docs)
    assert placed.count() == len(ODD)
    assert placed.where("doc_id = 1").select("shard").distinct().count() == 1
    assert placed.where("shard IS NULL").count() == 0
    sharding.write(placed, str(tmp_path / "out"))
    assert sharding.assign(docs.limit(0)).count() == 0


# --- Line dedup --------------------------------------------------------------


def plain_dedup(texts, min_docs):
    split = [(text or "").split("\n") for text in texts]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = {}
    for doc in split:
        for k in {key(line) for line in doc}:
            found[k] = found.get(k, 0) + 1
    out = []
    for doc in split:
        kept = [x for x in doc if not (key(x) and found[key(x)] >= min_docs)]
        out.append((len(doc), len(doc) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("heavy", [2, lines.HEAVY])
def test_lines_against_brute_force(documents, heavy, monkeypatch):
    rng = random.Random(4)
    pool = [" Common ", "common", "other\x0b", "é", "", "rare É", "\xa0x"]
    texts = ["\n".join(rng.choice(pool + [f"own {n}"]) for _ in range(rng.randint(0, 6))) for n in range(80)]
    texts += [None, "", *["same\ntext"] * 5, "long\n" * 20_000]
    rows = [(n % 70, text) for n, text in enumerate(texts)]
    monkeypatch.setattr(lines.dropped_keys, "__defaults__", (heavy,))
    found = lines.dedup(documents(rows, drop="1", kept="2"), min_docs=5, batches=3)
    got = sorted((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect())
    assert got == sorted((key, *e) for (key, _), e in zip(rows, plain_dedup(texts, 5), strict=True))


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2, buckets=2)
    for batch in range(5):
        rows = [(1, 1), (2, batch)] * 1
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long"))
        assert all(len(names) < 2 for names in runs.levels.values())
    assert [tuple(r)[:2] for r in runs.frequent().collect()] == [(1, 1)]


def test_no_lines(documents):
    assert lines.dedup(documents(ODD).limit(0)).count() == 0


# --- Jaccard join ------------------------------------------------------------


def plain_components(texts, rule):
    sets = []
    for text in texts:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        size = min(rule.width, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    root = list(range(len(sets)))
    for a, p in enumerate(sets):
        for b in range(a):
            q = sets[b]
            if p and q and rule.denominator * len(p & q) >= rule.numerator * len(p | q):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


@pytest.mark.parametrize("boundary", [0, 12, 20])
def test_components_against_brute_force(documents, boundary, monkeypatch):
    monkeypatch.setattr(jaccard, "_boundary", lambda rule, counts: boundary)
    monkeypatch.setattr(jaccard, "NEIGHBOURS", 1)  # so that the second pass has work
    rng = random.Random(boundary)
    texts = [None, "", "  ", "one", "ONE", "one two", "a b c d", "a b c D", "long " * 30_000]
    for length in (8, 14, 15, 16, 17, 22, 24, 60, 120):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [f"x{rng.randint(0, 3)}"]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    rule = jaccard.Rule()
    got = jaccard.join(documents(list(enumerate(texts)), component_id="1")).collect()
    expected = plain_components(texts, rule)
    assert sorted(map(tuple, got)) == [(n, *e) for n, e in enumerate(expected)]


def test_first_of_each_keeps_one(documents):
    text = " ".join(f"w{n}" for n in range(50))
    rows = [(5, text), (5, text), (3, text + " end"), (8, "other words are here now"), (None, text), (9, None)]
    kept = jaccard.first_of_each(documents(rows, row="1", key="2", stays="3"))
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted([(3,), (8,), (None,), (9,)], key=str)
    assert jaccard.join(documents(rows).limit(0)).count() == 0


# --- Packing -----------------------------------------------------------------


def test_pieces_cover_documents(documents):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    pool = ["Word", "the", "it's", "é,", "ÉA.", "日本", "<|endoftext|>", "12", "!!", "İ.", "\t"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 90, 400]))) for _ in range(200)]
    rows = [*enumerate(texts), (500, None), (501, ""), (None, "no key"), (502, "long " * 5000)]
    docs = documents(rows, ids="1", part="2").repartition(3)
    got = packing.pack(docs, WORDS, length=256, open_windows=3, with_ids=True).toPandas()
    used = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert used["length"].sum().max() <= 256
    assert used["length"].sum().mean() > 0.9 * 256
    offsets = used["length"].cumsum() - got["length"]
    assert (offsets == got["offset"]).all()
    for key, text in rows:
        mine = got[got["doc_id"].isna() if key is None else got["doc_id"] == key].sort_values("start")
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(mine["ids"]) == ids.tobytes(), text
        assert (mine["start"] == mine["length"].cumsum() - mine["length"]).all()
        assert (mine["doc_tokens"] == len(ids)).all()
        assert [zlib.crc32(i) for i in mine["ids"]] == list(mine["ids_crc32"])
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_no_more_windows_than_allowed():
    packer = packing.Packer(100, 4, 16)
    rng = random.Random(1)
    sizes = {}
    for n in range(500):
        for piece in packer.add(n, np.zeros(rng.randint(1, 250), "<u4")):
            sizes[piece[4]] = sizes.get(piece[4], 0) + len(piece[2])
        assert len(packer.windows) <= 4
    assert min(sizes.values()) > 84


# --- Classifiers -------------------------------------------------------------

LANGS = {"aa": "abab acad ", "bb": "bobo bubi ", "cc": "çéçé xyz "}


def test_language_of_odd_rows(documents):
    rng = random.Random(2)
    rows = [
        (n, "".join(rng.choice(LANGS[lang].split()) + " " for _ in range(rng.randint(3, 300))), lang, "s", 1)
        for n, lang in enumerate(sorted(LANGS) * 60)
    ]
    docs = documents(rows)
    network = langid.fit(docs)
    assert network.langs == sorted(LANGS)
    odd = [*rows[:9], (None, rows[0][1], None, None, None), (901, None), (902, ""), (903, "12 !\n"), (904, LANGS["bb"] * 30_000)]
    got = langid.predict(documents(odd, score="1", lang_pred="2"), network).collect()
    by_id = {r.row.doc_id: r for r in got}
    assert [by_id[n].lang_pred for n in (0, 1, 2, 904)] == ["aa", "bb", "cc", "bb"]
    assert [by_id[n].lang_pred for n in (901, 902, 903)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got) and by_id[901].score == 0
    assert by_id[None].lang_pred == "aa"
    assert langid.predict(documents(odd).limit(0), network).count() == 0
    assert langid.fit(documents(odd).limit(0)) is None
    assert {r.lang_pred for r in langid.predict(documents(odd), None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = langid.held_out(F.col("row.doc_id"))
    found = langid.predict(docs, langid.fit(docs)).where(fold)
    right = found.agg(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    assert docs.where(langid.held_out(F.col("doc_id"))).first().doc_id is not None


def test_tables_equal_the_filters():
    rng = np.random.default_rng(0)
    found = rng.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8)
    network = langid.train(found, np.array([0, 1] * 3), ["a", "b"], epochs=1)
    w = network.weights
    embedded, largest = w["embedding"][found], []
    for width in langid.WIDTHS:
        places = langid.WINDOW - width + 1
        response = sum(embedded[:, at : at + places] @ w[f"filters{width}"][at] for at in range(width))
        largest.append(response.max(axis=1))
    hidden = np.maximum(np.concatenate(largest, axis=1) + w["bias"], 0)
    assert np.allclose(network.scores(found), langid._softmax(hidden @ w["dense"] + w["out"]), atol=1e-5)


def test_quality_separates_junk(spark, documents):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(20, 80))) + "." for _ in range(300)]
    junk = ["!! ".join([word().upper()] * rng.randint(20, 80)) for _ in range(300)]
    rows = [(n, t) for n, t in enumerate([*good, *junk])]
    labels = spark.createDataFrame(
        [*[(n, int(n < 300)) for n in range(0, 600, 2)], (None, 1), (1, None), (3, 0), (3, 1)],
        "doc_id long, quality int",
    )
    model = quality.fit(documents(rows), labels)
    got = {r.row.doc_id: r for r in quality.score(documents(rows, score="1", keep="2"), model).collect()}
    assert np.mean([got[n].keep == (n < 300) for n in range(1, 600, 2)]) > 0.97
    odd = documents([*ODD, (7, "x", None, None, None)])
    scored = quality.score(odd, model).collect()
    assert len(scored) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in scored)
    assert quality.fit(odd, labels.limit(0)) is None
    assert all(r.keep and r.score == 0.5 for r in quality.score(odd, None).collect())
    assert quality.score(odd.limit(0), model).count() == 0


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = (np.arange(400) % 2).astype(float)
    text, meta = y[:, None] * 3 + rng.normal(size=(400, 2)), y[:, None] * 3 + rng.normal(size=(400, 2))
    known = np.arange(400) < 60
    model = quality.co_train(text[known], meta[known], y[known], np.arange(60) % 5 < 2, text[~known], meta[~known])
    assert (((model(text, meta)[0] > 0.5) == y)[~known]).mean() > 0.97


def test_words_of_letters_are_encoded_as_by_the_library(monkeypatch):
    rng = random.Random(4)
    library = packing.tokenizers(WORDS)[0]
    letters = "abcdeinrstuéüßñçœдж語अ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    # Every token of letters comes to itself, which makes the faster coder exact.
    words += [t.removesuffix("</w>") for t in library.get_vocab() if t.removesuffix("</w>").isascii() and t.islower()]
    words += ["".join(rng.choice(letters + "'.-%|12sté!\t\x01") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    words += ["a" * 3000, "naïve", "ﬁ", "İx", "don't", "x,y", "a.b.", "it's,", "é"]
    monkeypatch.setattr(packing, "MEMO_BYTES", 100_000)
    memo = packing.WordIds(WORDS)
    texts = [" ".join(words[at : at + 300]) for at in range(0, len(words), 300)]
    got = [ids.tolist() for start in range(0, len(texts), 4) for ids in memo.encode(texts[start : start + 4])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert memo.used < 300_000


def test_repeated_rows_are_packed_apart(documents):
    docs = documents([(1, "one two three"), (1, "one two three"), (2, None), (2, None)])
    pieces = packing.pack(docs, WORDS, length=4).collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values()) * 2
    places = sorted((p.sequence_id, p.offset + n) for p in pieces for n in range(p.length))
    assert len(places) == len(set(places)) and all(at < 4 for _, at in places)


def test_whole_texts_are_encoded_in_one_call(monkeypatch):
    library = packing.tokenizers(WORDS)[0]
    monkeypatch.setattr(packing, "RUNS", 50)
    rng, words = random.Random(12), packing.WordIds(WORDS)
    pool = [*"aabstrevmldSTREé1²½Ⅷ,.ªʰ日\t\xa0\x85\u200b", *["'"] * 9, "’", '"', "\n", *[" "] * 9, "'s", "'re", "'LL", " the", "10.0.7.1"]
    plain = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(3000)]
    odd = ["Σas ΣΑΣ", "a <| b", "a\x01b", "e\u0301t", "<|endoftext|>"]
    texts = [*plain, *odd, "", "long" * 3000]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in words.encode(texts)] == expected
    assert sum(map(len, words)) <= sum(map(len, odd)) and len(words.runs) <= 50  # no word of the others is kept
    assert [ids.tolist() for ids in words.encode(texts[::-1])] == expected[::-1]
