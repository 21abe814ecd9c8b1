"""Operator 13, spelling variants: words of one edit found through permuterm rotations.

A word is marked by a terminator that no word holds and rotated in every way.  For
any cut of a word into ``before + after`` one rotation is ``after$before``:

* A replaced character: of ``before x after`` the rotation that ends in ``x`` begins with
  ``after$before``, whatever ``x`` is.
* An inserted or deleted character: the whole rotation ``after$before`` of the shorter
  word is that same beginning of the longer one's rotation.

So the words near each other lie in one range of the sorted rotations, those that begin
with the same key, and the key leaves out the edited character alone.  A range holds at
most one word a character of the alphabet and one shorter word, hence at most
``len(ALPHABET) + 1`` rows, however many words there are.  Each range is scanned once
and gives every member the number of its near words and the one of largest count; no
pairs are listed.  Deleting any of several equal neighbours gives the same word: such
a pair is taken where the first of them is left out, so each near word counts once.

A word's form is its near word of largest count if that is ``ratio`` times its own or
more.  Counts rise by ``ratio`` with every step to a form, so a way of forms has at most
log(largest count) steps; it is followed by doubling.

Rows: null and empty texts have no words; a null key counts as empty in the hash;
repeated rows are documents of their own, each of which counts; ties between near words
go to the smaller word in code-point order; an empty table gives no word.  Columns other
than key and text are not read.
"""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.session import cut_lineage

#: The characters of words, and the letters lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Fixed values of the registered query.
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 6, 5, 5, 199
TERMINATOR = "$"


def damaged(run: Column, key: Column, every: int = DAMAGED) -> Column:
    """A run without one character if its hash with the key is a multiple of ``every``."""
    hashed = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (hashed % F.char_length(run)).cast("int")
    without = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(hashed % every == 0, without).otherwise(run)


def word_counts(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    every: int = DAMAGED,
) -> DataFrame:
    """(word, n): the words of all texts; counted where they are before the shuffle."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    found = docs.select(F.col(key).alias("key"), F.explode(runs).alias("run"))
    # A run of one character too few stays so.
    found = found.where(F.char_length("run") >= least_length)
    words = found.select(damaged(F.col("run"), F.col("key"), every).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, kind, counts): what each rotation of a word offers to a range.

    ``kind`` 1 leaves out the last character of a rotation, kind 0 is the whole
    rotation; ``counts`` tells whether the character left out is the first of its equals.
    """
    length = F.char_length("word")
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("cut"))
    before = F.substr(F.col("word"), F.lit(1), F.col("cut"))
    after = F.substr(F.col("word"), F.col("cut") + 1)
    whole = F.struct(
        F.concat(after, F.lit(TERMINATOR), before).alias("key"), F.lit(0).alias("kind"), F.lit(True).alias("counts")
    )
    # The rotation that ends in the character before the cut, without it.
    last, but_last = F.substr(before, F.col("cut")), F.substr(before, F.lit(1), F.col("cut") - 1)
    without = F.when(
        F.col("cut") > 0,
        F.struct(
            F.concat(after, F.lit(TERMINATOR), but_last).alias("key"),
            F.lit(1).alias("kind"),
            (~F.endswith(but_last, last)).alias("counts"),
        ),
    )
    offered = F.explode(F.array_compact(F.array(whole, without))).alias("r")
    return cuts.select("word", "n", offered).select("r.key", "word", "n", "r.kind", "r.counts")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near word; ``words`` has word and n.

    ``best`` is the near word of largest count, ties to the smaller word.
    """
    member = F.struct((-F.col("n")).alias("less"), "word", "kind", "counts")
    ranges = rotations(words).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("members"))
    ranges = ranges.where(F.size("members") > 1)
    seen = ranges.select("members", F.explode("members").alias("own"))
    own = F.col("own")

    def near(other: Column) -> Column:
        replaced = (own["kind"] == 1) & (other["kind"] == 1)
        shifted = (own["kind"] != other["kind"]) & own["counts"] & other["counts"]
        return (other["word"] != own["word"]) & (replaced | shifted)

    others = F.filter("members", near)
    found = seen.select(own["word"].alias("word"), others.alias("others")).where(F.size("others") > 0)
    first = F.get("others", F.lit(0))
    best = F.min(F.struct(first["less"].alias("less"), first["word"].alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum(F.size("others")).alias("n_near"), best).select(
        "word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n")
    )


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form): the last form of each way of at most ``steps`` steps."""
    found = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(ceil(log2(max(1, steps)))):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        found = cut_lineage(found)
    return found


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with ``form``, ``root``, ``n_near`` and ``form_n``."""
    if ratio < 2:
        raise ValueError("counts must rise from a word to its form")
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    joined = words.join(near_words(words), "word", "left")
    taken = F.col("best_n") >= ratio * F.col("n")
    described = cut_lineage(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best")).alias("form"),
            F.when(taken, F.col("best_n")).alias("form_n"),
        )
    )
    most = words.agg(F.max("n")).first()[0] or 1
    followed = roots(described.where("form IS NOT NULL"), 1 + ceil(log(most, ratio)))
    whole = described.join(followed, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
