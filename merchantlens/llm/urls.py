"""Operator 5, URL filters: rules first, then a ratio of character language models.

The rules are sure; the pages that they judge teach two smoothed Markov models over
the characters of host and path, one of accepted and one of rejected URLs.  A model
mixes the orders 2, 1 and 0, each context weighted by how often and with how many
followers it was seen, so its order varies with the context.  Of the pages without a
rule those are allowed whose log-likelihood difference, divided by the number of
characters, reaches a cut; the cut is the one that separates the judged pages
of a fold kept out of the learning best.

Characters are mapped to a fixed alphabet, so a model has exactly ``len(ALPHABET)**3``
numbers however much it has seen, and goes into the plan as a constant.  Everything is
DataFrame functions; pages are not shuffled.

Rows: a null URL or one without ``://`` has an empty host and path and is judged by
the models (its end alone).  Other nulls pass; repeated pages are judged alike; without
pages there is no row; without judged pages of both kinds the difference is still
defined by the smoothing, and the cut is 0.  The input's columns are kept in ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The symbols of the models.  ``^`` begins a text, ``$`` ends it, ``?`` is any other.
ALPHABET = "^$?0./-_%abcdefghijklmnopqrstuvwxyz"
SIZE = len(ALPHABET)
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 100  # per unit of the score, which is cut to -10..10


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block``, for a host with its subdomains and a path's beginning."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _first_rule(rules: tuple[Rule, ...], host: Column, path: Column, of) -> Column:
    longest = sorted(rules, key=lambda rule: (-len(rule.text), rule.text))
    return F.coalesce(
        *[F.when(rule.fits(host, path), F.lit(of(rule))) for rule in longest], F.lit(None).cast("string")
    )


def symbols(host: Column, path: Column) -> Column:
    """The codes of a URL's characters and its end, as an array of int."""
    text = F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0")
    text = F.concat(F.regexp_replace(text, r"[^0./\-_%a-z]", "?"), F.lit("$"))
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _trigrams(codes: Column) -> Column:
    """Each symbol with the two before it, as one number."""
    padded = F.concat(F.array(F.lit(0), F.lit(0)), codes)
    places = F.sequence(F.lit(0), F.size(codes) - 1)
    return F.transform(
        places,
        lambda i: (F.get(padded, i) * SIZE + F.get(padded, i + 1)) * SIZE + F.get(padded, i + 2),
    )


def learn(judged: DataFrame) -> list[float]:
    """For each trigram the log of its probability if accepted over that if rejected.

    ``judged`` has ``codes`` and ``verdict``.  Its trigrams are counted where they
    are; what is shuffled and returned has a fixed size.
    """
    grams = judged.select("verdict", F.explode(_trigrams(F.col("codes"))).alias("id"))
    counts = grams.groupBy("verdict", "id").agg(F.count(F.lit(1)).alias("n"))
    every = judged.sparkSession.range(SIZE**3).select(
        "id", F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("verdict")
    )
    a, b, c = F.floor(F.col("id") / SIZE**2), F.floor(F.col("id") / SIZE) % SIZE, F.col("id") % SIZE
    full = every.join(counts, ["verdict", "id"], "left").select(
        "verdict", "id", a.alias("a"), b.alias("b"), c.alias("c"), F.coalesce("n", F.lit(0)).alias("n")
    )

    def over(what: Column, *keys: str) -> Column:
        return F.sum(what).over(Window.partitionBy("verdict", *keys))

    seen = F.col("n")
    full = full.withColumns(
        {
            "n_ab": over(seen, "a", "b"),
            "t_ab": over((seen > 0).cast("int"), "a", "b"),
            "n_bc": over(seen, "b", "c"),
            "n_b": over(seen, "b"),
            "n_c": over(seen, "c"),
            "n_all": over(seen),
        }
    )
    full = full.withColumn("t_b", over((F.col("n_bc") > 0).cast("int"), "b") / SIZE)
    alone = (F.col("n_c") + 0.5) / (F.col("n_all") + 0.5 * SIZE)
    after_b = F.when(F.col("n_b") > 0, (F.col("n_bc") + F.col("t_b") * alone) / (F.col("n_b") + F.col("t_b")))
    after_b = F.coalesce(after_b, alone)
    after_ab = F.when(
        F.col("n_ab") > 0, (F.col("n") + F.col("t_ab") * after_b) / (F.col("n_ab") + F.col("t_ab"))
    )
    sign = F.when(F.col("verdict") == "allow", 1).otherwise(-1)
    ratio = F.sum(sign * F.log(F.coalesce(after_ab, after_b))).alias("ratio")
    return [row.ratio for row in full.groupBy("id").agg(ratio).orderBy("id").collect()]


def score(codes: Column, ratios: list[float]) -> Column:
    """The mean log ratio of a URL's symbols, in hundredths, rounded down."""
    model = F.split(F.lit(" ".join(map(repr, ratios))), " ").cast("array<double>")
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("sum"))

    def step(state: Column, c: Column) -> Column:
        at = (state["a"] * SIZE + state["b"]) * SIZE + c
        return F.struct(
            state["b"].alias("a"), c.alias("b"), (state["sum"] + F.get(model, at)).alias("sum")
        )

    mean = F.aggregate(codes, start, step, lambda state: state["sum"]) / F.size(codes)
    return F.floor(F.greatest(F.least(mean, F.lit(10.0)), F.lit(-10.0)) * BINS).cast("int")


def calibrate(scored: DataFrame) -> int:
    """The cut with the best mean share of right verdicts, ties to the smallest.

    It lies halfway between two scores that occur.
    """
    allow = (F.col("verdict") == "allow").cast("int")
    bins = scored.groupBy("score").agg(F.sum(allow).alias("allow"), F.sum(1 - allow).alias("block"))
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # at most 2,001 rows
    every = Window.partitionBy()

    def share(kind: str) -> Column:
        return F.try_divide(F.coalesce(F.sum(kind).over(below), F.lit(0)), F.sum(kind).over(every))

    before = F.coalesce(F.lag("score").over(Window.orderBy("score")), "score")
    found = bins.select(
        "score",
        F.floor((F.col("score") + before) / 2).cast("int").alias("cut"),
        F.round(share("block") - share("allow"), 9).alias("gain"),
    )
    best = found.where("gain IS NOT NULL").orderBy(F.desc("gain"), "score").limit(1).collect()
    return best[0].cut if best else 0


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (the input's columns), ``host``, ``path``, ``rule``, ``verdict`` and ``score``."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select(
        F.struct("*").alias("row"), F.col(url).alias("url"), host.alias("host"), path.alias("path")
    )
    at = F.col("host"), F.col("path")
    ruled = parsed.select(
        "row",
        *at,
        _first_rule(rules, *at, lambda rule: rule.text).alias("rule"),
        _first_rule(rules, *at, lambda rule: rule.verdict).alias("verdict"),
        symbols(*at).alias("codes"),
        (F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 8), 16, 10).cast("long") % FOLDS).alias(
            "fold"
        ),
    )
    judged = ruled.where("verdict IS NOT NULL").select("verdict", "codes", "fold")
    ratios = learn(judged.where("fold <> 0"))
    kept_out = judged.where("fold = 0").select("verdict", score(F.col("codes"), ratios).alias("score"))
    cut = calibrate(kept_out)
    scored = ruled.withColumn("score", score(F.col("codes"), ratios))
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select(
        "row", *at, "rule", F.coalesce("verdict", by_model).alias("verdict"), "score"
    )
