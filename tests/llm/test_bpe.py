import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from merchantlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "12", "!", "'s", "'re", "<|endoftext|>", "<|end", "日本", "😀", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, count):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 50, 300]))) for _ in range(count)]


def test_streaming_equals_the_library(library, monkeypatch):
    encoder, decoder = bpe.coder(PATH)
    monkeypatch.setattr(bpe, "PIECE", 200)
    monkeypatch.setattr(bpe, "WINDOW", 64)
    monkeypatch.setattr(encoder.merges, "window", encoder.vocabulary.lookahead + 64)
    runs = [c * n for c in ("a", "ab", " ", " \n", "!", "12", "日", "erth") for n in (7, 3000)]
    for text in [*texts(1, 400), *runs, *[f"x {run} y" for run in runs]]:
        encoder.learn([text])
        pieces = list(encoder.encode(text))
        ids = np.frombuffer(b"".join(pieces), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:60]
        decoded = "".join(map(decoder.feed, pieces)) + decoder.finish()
        assert decoded == library.decode(ids, skip_special_tokens=False)


def test_window_keeps_bounded_text():
    vocabulary = bpe.coder(PATH)[0].vocabulary
    merges = bpe.WindowedMerges(vocabulary)
    for _ in range(20):
        list(merges.feed(b"ab" * 5000))
        assert len(merges.waiting) <= merges.window + bpe.WINDOW + 10_000
    assert 0 < vocabulary.lookahead < 2000


def test_decoder_waits_for_whole_characters():
    decoder = bpe.coder(PATH)[1]
    ids = [decoder.bytes_of.index(bytes([b])) for b in "é".encode()]
    assert decoder.feed(bpe.packed(ids[:1])) == ""
    assert decoder.feed(bpe.packed(ids[1:])) + decoder.finish() == "é"
    assert decoder.feed(bpe.packed(ids[:1])) + decoder.finish() == "\ufffd"


def test_operator_on_odd_rows(spark, documents, library):
    rows = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "x" * 200_000)]
    docs = documents(rows, ids="'mine'", n_tokens="1")
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == 5
    by_id = {r.doc_id: r for r in got}
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert by_id[key].n_tokens == len(ids)
        assert by_id[key].ids_sha256 == hashlib.sha256(bpe.packed(ids)).hexdigest()
        assert by_id[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(docs, PATH)
    back = bpe.decode(encoded.select("row.doc_id", "ids"), PATH).collect()
    assert {r.row.doc_id: r.text for r in back} == {k: t or "" for k, t in rows}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def needed_lookahead(rules, most):
    """How far before its end a shared beginning is no longer the same, over all short texts."""
    merges = {(a, b): (rank, made) for rank, (a, b, made) in enumerate(rules)}
    spelled = {0: "a", 1: "b"}
    for a, b, made in rules:
        spelled[made] = spelled[a] + spelled[b]
    worst = 0
    for size in range(1, most - 3):
        for n in range(2**size):
            start = [n >> at & 1 for at in range(size)]
            seen = []
            for extra in range(5):
                for m in range(2**extra):
                    ids, end, found = bpe.merge(start + [m >> at & 1 for at in range(extra)], merges), 0, []
                    for i in ids:
                        end += len(spelled[i])
                        found.append((end, i))
                    seen.append(found)
            same = 0
            for tokens in zip(*seen, strict=False):
                if len(set(tokens)) > 1 or tokens[0][0] > size:
                    break
                same = tokens[0][0]
            ends = [end for found in seen for end, _ in found if same < end <= size]
            # A token that ends this far before the end of what is shared is not the same everywhere.
            worst = max([worst, *(size - end + 1 for end in ends)])
    return worst


def test_sufficient_lookahead_against_brute_force():
    rng = random.Random(12)
    most = 0
    for _ in range(40):
        spelled, rules = {0: "a", 1: "b"}, []
        for made in range(2, 2 + rng.randint(1, 5)):
            left, right = rng.choice(list(spelled)), rng.choice(list(spelled))
            if spelled[left] + spelled[right] not in spelled.values():
                spelled[made] = spelled[left] + spelled[right]
                rules.append((left, right, made))
        bound = bpe.sufficient_lookahead(rules, {i: len(t) for i, t in spelled.items()})
        needed = needed_lookahead(rules, 10)
        assert needed <= bound, rules
        most = max(most, needed)
    assert most > 1


def test_short_texts_take_the_transducer(monkeypatch):
    encoder = bpe.coder(PATH)[0]
    fed = []
    feed = encoder.feed
    monkeypatch.setattr(encoder, "feed", lambda text: fed.append(text) or feed(text))
    assert b"".join(encoder.encode("a short text")) and fed == ["a short text"]


def test_memos_are_bounded_and_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    encoder = bpe.coder(PATH)[0]
    for n in range(0, 3000, 100):
        found = [f"word{m} other{m}, and{m}" for m in range(n, n + 100)]
        encoder.learn(found)
        for text in found:
            ids = np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids
        assert encoder.chunks.used < 200_000 and encoder.words.used < 200_000
    assert not bpe.coder(PATH)[0].chunks
