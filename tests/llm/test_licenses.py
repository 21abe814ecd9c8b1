"""License scans against plain versions."""

import random
import re

import pytest

from merchantlens.llm import licenses

LOWER = {upper: upper + 32 for upper in range(65, 91)}


def plain(text, share=licenses.SHARE, stride=licenses.STRIDE):
    words = re.findall(licenses.WORD, (text or "").translate(LOWER))
    base = {}
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for at in range(len(words)):
            if words[at : at + len(parts)] == parts:
                base.setdefault(label, []).append(at)
    labels, score = set(base), 0.0
    for start in range(0, len(words), stride):
        block = set(words[start : start + 2 * stride])
        for template in licenses.TEMPLATES:
            tokens = set(template.tokens)
            if 100 * len(tokens & block) >= share * len(tokens):
                labels.add(template.label)
                score = max(score, len(tokens & block) / len(tokens))
    places = [at for found in base.values() for at in found]
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score,
    )


def scanned(df, **options):
    return {
        r.row.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        for r in licenses.scan(df, **options).collect()
    }


@pytest.mark.parametrize(("share", "stride"), [(80, 40), (100, 15), (50, 7)])
def test_scan_against_plain_version(spark, documents, share, stride):
    rng = random.Random(share)
    common = ["the", "of", "and", "software", "license", "MIT", "Apache", "public", "general", "this", "é"]
    texts = []
    for _ in range(120):
        words = [rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(50)}" for _ in range(rng.randrange(150))]
        for template in rng.sample(licenses.TEMPLATES, rng.randrange(3)):
            notice = template.text.split()
            notice = [w if rng.random() < 0.9 else "changed" for w in notice]
            at = rng.randint(0, len(words))
            words[at:at] = notice
        texts.append(rng.choice([" ", "\n", " - "]).join(words))
    got = scanned(documents(list(enumerate(texts))), share=share, stride=stride)
    assert got == {n: plain(text, share, stride) for n, text in enumerate(texts)}
    assert len({labels for *_, labels, _ in got.values()}) > 5


def test_each_notice_has_its_label(documents):
    rows = [(n, f"code before\n{t.text}\nand after") for n, t in enumerate(licenses.TEMPLATES)]
    got = scanned(documents(rows))
    assert all(t.label in got[n][5].split(",") and got[n][6] == 1.0 for n, t in enumerate(licenses.TEMPLATES))


def test_odd_rows(documents):
    long = "word " * 30_000 + "MIT-License the Apache\tlicense " + "word " * 30_000
    rows = [
        (1, None), (2, ""), (3, "mit license mit LICENSE"), (4, long), (None, "GENERAL public\nlicense"),
        (5, "mitlicense mit licenses"), (6, "\x00\x7f,;"), (7, "ＭＩＴ license"),
    ]
    docs = documents(rows, words="'mine'", blocks="1", labels="2", score="3")
    got = scanned(docs)
    assert got == {n: plain(text) for n, text in rows}
    assert got[3][:5] == (4, 2, 0, 2, "mit") and got[4][2:5] == (30_000, 30_003, "apache,mit")
    assert licenses.scan(docs).select("row.*").columns == docs.columns
    assert licenses.scan(docs.unionAll(docs)).count() == 2 * len(rows)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_blocks_tell_where(documents):
    text = "w " * 100 + "Released under the MIT License" + " w" * 100
    found = licenses.scan(documents([(1, text)])).first().blocks
    assert [(b.label, b.start, b.length, b.containment) for b in found] == [("mit", 40, 80, 1.0), ("mit", 80, 80, 1.0)]


def test_no_python_in_the_plan(documents):
    plan = licenses.scan(documents([(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
