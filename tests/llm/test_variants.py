"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from merchantlens.llm import queries, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {upper: upper + 32 for upper in range(65, 91)}


def plain_counts(docs, length=6, least=5, every=199):
    counts = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= length
    return {word: n for word, n in counts.items() if n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[at + 1 :] == b[at + 1 :]
    a, b = sorted((a, b), key=len)
    return a[at:] == b[at + 1 :]


def plain_groups(counts, near_of):
    forms = {}
    for word, n in counts.items():
        best = min(near_of[word], key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best is not None and counts[best] >= 5 * n else None

    def root(word):
        return word if forms[word] is None else root(forms[word])

    return {
        (w, forms[w], root(w), n, len(near_of[w]), None if forms[w] is None else counts[forms[w]])
        for w, n in counts.items()
    }


def found(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("alphabet", ["ab", "abcé"])
def test_groups_against_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(150)}
    counts = {word: rng.choice([1, 2, 3, 7, 7, 40, 300, 2000]) for word in words}
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    got = found(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert len(got) == len(counts) and set(got) == plain_groups(counts, near)
    assert any(r[1] != r[2] and r[1] for r in got)  # a way of two steps


def test_a_long_way_of_forms(spark):
    counts = {"a" * (6 + n): 6**n for n in range(12)}
    got = {r[0]: r for r in found(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert {r[2] for r in got.values()} == {"a" * 17}
    assert got["a" * 17][1] is None and got["a" * 6][1] == "a" * 7
    with pytest.raises(ValueError):
        variants.group(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_query_against_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    counts = plain_counts(docs)
    by_gap = {}
    for word in counts:
        for at in range(len(word)):
            by_gap.setdefault((word[:at], word[at + 1 :]), set()).add(word)
    near = {}
    for word in counts:
        gaps = [(word[:at], word[at + 1 :]) for at in range(len(word))]
        replaced = set().union(*(by_gap[gap] for gap in gaps))
        shorter = {a + b for a, b in gaps} & counts.keys()
        longer = set().union(*(by_gap.get((word[:at], word[at:]), ()) for at in range(len(word) + 1)))
        near[word] = (replaced | shorter | longer) - {word}
    got = found(queries.op13_spelling(spark, "/root/testdata/sf0.01"))
    assert len(got) == len(counts) and set(got) == plain_groups(counts, near)


def test_odd_rows(spark, documents):
    rows = [
        (1, None), (2, ""), (3, "12 $$ short a b"), (None, "sechsn sechsn sechsn"), (4, "SECHSN sechsn"),
        (4, "SECHSN sechsn"), (5, "Ünsichtbar÷x " * 20_000), (6, "y" * 100_000),
    ]
    docs = documents(rows, word="'mine'", n="1", run="2")
    counts = plain_counts(rows)
    assert counts["sechsn"] == 7 and "Ünsichtbar÷x" in counts
    got = {r.word: r.n for r in variants.word_counts(docs).collect()}
    assert got == counts
    nothing = variants.word_counts(docs.limit(0))
    assert nothing.count() == 0 and variants.group(nothing).count() == 0
    repeated = variants.word_counts(docs.unionAll(docs)).where(F.col("word") == "sechsn").first()
    assert repeated.n == 14
