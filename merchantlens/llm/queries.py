"""The queries of this subpackage over the test tables, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from merchantlens.llm import (
    alignment,
    ann,
    bpe,
    jaccard,
    langid,
    licenses,
    lines,
    packing,
    quality,
    sharding,
    topk,
    urls,
    variants,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and the text decoded from them, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"), key="doc_id")
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("row.doc_id", "score", "p_text", "p_meta", "keep")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("row.page_id", "host", "path", "rule", "verdict")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langid.fit(docs)
    found = langid.predict(docs.select("doc_id", "text"), network)
    held_out = langid.held_out(F.col("row.doc_id")).alias("held_out")
    return found.select("row.doc_id", held_out, "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies line up in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license phrases and notices in every document."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("row.doc_id", *names)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, its form and the root of its forms."""
    return variants.group(variants.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Query]:
    found = (
        op1_bpe,
        op2_quality,
        op3_sharding,
        op4_nearest,
        op5_url_filter,
        op6_language,
        op7_line_dedup,
        op8_jaccard,
        op9_packing,
        op10_top_k,
        op11_alignment,
        op12_licenses,
        op13_spelling,
    )
    return {query.__name__: query for query in found}


def _sharding_sql() -> str:
    owner = sharding.fill(sharding.SHARDS)
    listed = ", ".join(map(str, owner))
    return f"""
    WITH placed AS (
        SELECT doc_id, ('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 15))::BIGINT
            % {len(owner)} AS slot
        FROM documents)
    SELECT doc_id, slot, printf('shard-%03d', [{listed}][slot + 1]) AS shard FROM placed
    """


_LINES_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents),
lines AS (
    SELECT n, doc_id, line, pos, translate(
        trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT n, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs)),
frequent AS (
    SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT n) >= 10),
marked AS (
    SELECT lines.*, frequent.key IS NOT NULL AS dropped FROM lines LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY n, doc_id
"""

_JACCARD_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
sets AS (
    SELECT d, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s
    FROM docs),
items AS (SELECT d, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT a.d AS a, b.d AS b FROM items a JOIN items b ON a.x = b.x AND a.d <> b.d
    GROUP BY a.d, b.d, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached(d, e) AS (SELECT d, d FROM sets UNION SELECT r.d, l.b FROM reached r JOIN links l ON l.a = r.e)
SELECT s.doc_id, len(any_value(s.s)) AS n_shingles, min(t.doc_id) AS component_id
FROM reached r JOIN sets s ON s.d = r.d JOIN sets t ON t.d = r.e GROUP BY s.d, s.doc_id
"""

_TOP_K_SQL = """
WITH fine AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
    FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
        vec_id, score
    FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _urls_sql() -> str:
    size, alphabet = urls.SIZE, urls.ALPHABET
    ordered = sorted(urls.RULES, key=lambda rule: (-len(rule.text), rule.text))

    def first(of) -> str:
        cases = [
            f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')"
            f" THEN '{of(r)}'"
            for r in ordered
        ]
        return f"CASE {' '.join(cases)} END"

    return f"""
    WITH rest AS (
        SELECT row_number() OVER () AS n, page_id, url, CASE WHEN instr(url, '://') > 0
            THEN substr(url, instr(url, '://') + 3) END AS rest
        FROM pages),
    parsed AS (
        SELECT n, page_id, url,
            coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
        FROM rest),
    ruled AS (
        SELECT *, {first(lambda r: r.text)} AS rule, {first(lambda r: r.verdict)} AS ruled,
            ('0x' || left(md5(coalesce(url, '')), 8))::BIGINT % {urls.FOLDS} AS fold,
            '^^' || regexp_replace(regexp_replace(lower(host || path), '[0-9]', '0', 'g'),
                '[^0./\\-_%a-z]', '?', 'g') || '$' AS s
        FROM parsed),
    grams AS (
        SELECT n, ruled, fold, p, instr('{alphabet}', s[p]) - 1 AS a,
            instr('{alphabet}', s[p + 1]) - 1 AS b, instr('{alphabet}', s[p + 2]) - 1 AS c
        FROM (SELECT *, unnest(range(1, length(s) - 1)) AS p FROM ruled)),
    counts AS (
        SELECT ruled AS verdict, a, b, c, count(*) AS n FROM grams
        WHERE ruled IS NOT NULL AND fold <> 0 GROUP BY ALL),
    symbols AS (SELECT range AS x FROM range({size})),
    whole AS (
        SELECT v.verdict, a.x AS a, b.x AS b, c.x AS c, coalesce(counts.n, 0) AS n
        FROM (VALUES ('allow'), ('block')) v(verdict), symbols a, symbols b, symbols c
        LEFT JOIN counts ON counts.verdict = v.verdict AND counts.a = a.x AND counts.b = b.x
            AND counts.c = c.x),
    sums AS (
        SELECT *, sum(n) OVER (PARTITION BY verdict, a, b) AS n_ab,
            sum((n > 0)::INT) OVER (PARTITION BY verdict, a, b) AS t_ab,
            sum(n) OVER (PARTITION BY verdict, b, c) AS n_bc,
            sum(n) OVER (PARTITION BY verdict, b) AS n_b,
            sum(n) OVER (PARTITION BY verdict, c) AS n_c, sum(n) OVER (PARTITION BY verdict) AS n_all
        FROM whole),
    followers AS (
        SELECT *, sum((n_bc > 0)::INT) OVER (PARTITION BY verdict, b) / {size}::DOUBLE AS t_b,
            (n_c + 0.5::DOUBLE) / (n_all + 0.5::DOUBLE * {size}) AS p1
        FROM sums),
    second AS (
        SELECT *, CASE WHEN n_b > 0 THEN (n_bc + t_b * p1) / (n_b + t_b) ELSE p1 END AS p2 FROM followers),
    ratios AS (
        SELECT a, b, c, sum(CASE verdict WHEN 'allow' THEN 1 ELSE -1 END
            * ln(CASE WHEN n_ab > 0 THEN (n + t_ab * p2) / (n_ab + t_ab) ELSE p2 END)) AS ratio
        FROM second GROUP BY ALL),
    scored AS (
        SELECT n, floor(greatest(least(sum(ratio ORDER BY p) / count(*), 10), -10) * {urls.BINS}) AS score
        FROM grams JOIN ratios USING (a, b, c) GROUP BY n),
    bins AS (
        SELECT score, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block
        FROM ruled JOIN scored USING (n) WHERE ruled IS NOT NULL AND fold = 0 GROUP BY score),
    gains AS (
        SELECT score, floor((score + coalesce(lag(score) OVER (ORDER BY score), score)) / 2) AS half,
            round(coalesce(sum(block) OVER below, 0)::DOUBLE / sum(block) OVER ()
            - coalesce(sum(allow) OVER below, 0)::DOUBLE / sum(allow) OVER (), 9) AS gain
        FROM bins WINDOW below AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    cut AS (
        SELECT coalesce((SELECT half FROM gains WHERE isfinite(gain) ORDER BY gain DESC, score LIMIT 1), 0)
            AS cut)
    SELECT page_id, host, path, rule,
        coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
    FROM ruled JOIN scored USING (n), cut
    """


def _licenses_sql() -> str:
    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{word}'" for word in words) + "]"

    phrases = ", ".join(f"({listed(phrase.split())}, '{label}')" for phrase, label in licenses.PHRASES)
    templates = ", ".join(f"({listed(t.tokens)}, '{t.label}')" for t in licenses.TEMPLATES)
    return f"""
    WITH docs AS (
        SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '{licenses.WORD}') AS w
        FROM documents),
    phrases(p, label) AS (VALUES {phrases}),
    templates(t, label) AS (VALUES {templates}),
    places AS (
        SELECT d, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS s
        FROM docs, phrases WHERE list_contains(w, p[1])),
    starts AS (SELECT d, w, unnest(range(0, len(w), {licenses.STRIDE})) AS s FROM docs),
    blocks AS (SELECT d, w[s + 1 : s + {2 * licenses.STRIDE}] AS b FROM starts),
    met AS (
        SELECT d, label, len(list_intersect(t, b)) AS shared, len(t) AS size FROM blocks, templates
        WHERE 100 * len(list_intersect(t, b)) >= {licenses.SHARE} * len(t)),
    base AS (
        SELECT d, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
        FROM places GROUP BY d),
    added AS (SELECT d, max(shared / size::DOUBLE) AS score FROM met GROUP BY d),
    every AS (
        SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM (SELECT d, label FROM places UNION SELECT d, label FROM met) GROUP BY d)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
    FROM docs LEFT JOIN base USING (d) LEFT JOIN every USING (d) LEFT JOIN added USING (d)
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": _sharding_sql(),
        "op5_url_filter": _urls_sql(),
        "op7_line_dedup": _LINES_SQL,
        "op8_jaccard": _JACCARD_SQL,
        "op10_top_k": _TOP_K_SQL,
        "op12_licenses": _licenses_sql(),
    }
