"""Cross-tokenizer alignment against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merchantlens.llm import alignment, queries
from merchantlens.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\nb", "a\n\nb\n", "\na", "a\tb\t c", "x▁y", "▁",
    "<|endoftext|> and <s> <0x41> </s>", "naïve café 你好 ‍🙂", "a\x00b", "\x1f a\x1fb \x85c\xa0d e　f", "é x",
    "it's we'll 'tis 12,345.67 ...!?  (end)", "a" * 5000, " " * 3000 + "x", "-=" * 2000, "word, word. word;\nWord",
]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(A, B)


def plain(texts):
    """The contract, one text after the other with the libraries."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()
    groups, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            groups.append(None)
            continue
        ends = [np.cumsum(list(map(len, of))).tolist() for of in (bytes_a, bytes_b)]
        found, own_a, own_b, at_b = [], [], [], 0
        for i, end in zip(ids_a, ends[0], strict=True):
            own_a.append(i)
            while at_b < len(ids_b) and ends[1][at_b] <= end:
                own_b.append(ids_b[at_b])
                at_b += 1
            if at_b and ends[1][at_b - 1] == end:
                found.append((own_a, own_b))
                counts[own_a[-1], own_b[-1]] += 1
                own_a, own_b = [], []
        groups.append(found)
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    out = []
    for found in groups:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in found]
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in found)
        out.append(
            (
                sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(links),
                sum(counts[link] == highest[link[1]] for link in links), sum(counts[link] for link in links),
                hashlib.sha256(written.encode()).hexdigest(),
            )
        )
    return out


def aligned(df, **options):
    return {r.doc_id: tuple(r)[1:8] for r in alignment.align(df, A, B, **options).collect()}


def test_odd_texts(spark, documents):
    rng = random.Random(5)
    alphabet = ["a", "the", "é", " ", "  ", "\n", ",", ".", "'s", "1", "\t", "ß", "▁", " ", "X"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = documents(list(enumerate(texts)), n_a="'mine'", groups="1", key="2").repartition(5)
    assert aligned(docs) == dict(enumerate(plain(texts)))


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.table(spark, sf, "documents").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_alignment(spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain([r.text for r in rows]), strict=True))


def test_repeated_rows_null_keys_and_empty_tables(spark, documents):
    docs = documents([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)])
    found = alignment.align(docs, A, B, with_groups=True).collect()
    expected = plain(["one two"] * 3 + [None])
    assert sorted((tuple(r)[1:8] for r in found)) == sorted(expected)
    written = {r.groups for r in found}
    assert {hashlib.sha256(g.encode()).hexdigest() if g else "" for g in written} == {r[6] for r in expected}
    assert alignment.align(docs.limit(0), A, B).count() == 0
    assert alignment.align(docs.where("text IS NULL"), A, B).first().groups_sha256 == ""


def test_memos_in_little_memory(both):
    texts = [f"word{n} word{n % 7}\nand {n}" for n in range(2000)]
    aligner = alignment.Aligner(both)
    for start in range(0, len(texts), 100):
        list(aligner.rows_of(texts[start : start + 100]))
    assert aligner.used > 0
    aligner.clear()
    assert not aligner.rows and aligner.used == 0


def test_forgetting_changes_nothing(spark, documents, monkeypatch):
    texts = [f"word{n} word{n % 7}, and {n}\nLine {n % 3}" for n in range(700)]
    docs = documents(list(enumerate(texts)))
    whole = aligned(docs)
    assert whole == dict(enumerate(plain(texts)))
    monkeypatch.setattr(alignment, "MEMO_BYTES", 1000)
    assert aligned(docs) == whole


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 100_000])
def test_the_hash_is_minimal_and_perfect(size):
    rng = np.random.default_rng(size)
    keys = np.unique(rng.integers(0, 1 << 40, size))
    found = alignment.PerfectHash(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(rng.integers(0, 1 << 40, 1000), keys)
    assert (found.slots(others) == -1).all()


def test_tree_sum(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 9, (20, 2, alignment.SEGMENT))
    rows = [(part, s, bytearray(vectors[part, s].astype("<i8").tobytes())) for part in range(20) for s in range(2)]
    found = alignment.tree_sum(spark.createDataFrame(rows, "part int, segment int, counts binary")).collect()
    got = {r.segment: np.frombuffer(r.counts, dtype="<i8") for r in found}
    assert len(found) == 2 and all((got[s] == vectors[:, s].sum(axis=0)).all() for s in got)


def test_the_bound_on_pairs():
    of_a, of_b = {0: b"ab", 1: b"b", 2: b"cab"}, {0: b"b", 1: b"ab", 2: b"xab", 3: b"b"}
    ends = sum(x.endswith(y) or y.endswith(x) for x in of_a.values() for y in of_b.values())
    assert alignment.most_pairs(of_a, of_b) == ends


def test_merges_of_bytes_are_those_of_the_library(both):
    rng = random.Random(8)
    letters = "aeinrst.,'-1éüßñç" + "ẍ你"
    keys = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 16))) for _ in range(3000)] + ["a" * 400, "=" * 99]
    fast = [key for key in keys if both.fast(key)]
    assert 1000 < len(fast) < len(keys)
    chunks = [" " + key for key in fast] + ["\n" + key for key in fast]
    found = both.piece_of[both.fast_b.encode_ordinary("".join(chunks))].tolist()
    assert found == [i for ids in both.ids_b(chunks) for i in ids]
