"""The registered queries of the training-data operators. Each is a thin layer over its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from voltide.llm import content_sort, fair_mix, filter_audit, html_density, jaccard_join, language_id, line_dedup, quality_pu, rule_ledger, sentence_pieces, source_divergence, token_counts, warc_fixity

#: Tokenizer model, and the tokens a training sequence holds.
PIECES, TOKEN_LIMIT = "piece_bpe_32k.model", 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(remainder: int, of: int) -> Column:
    """True for the documents whose crc32 of the id as text leaves ``remainder``: no label of theirs is learnt."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = documents(spark, sf_dir), held_out(2, 4)
    found = language_id.identify(docs, language_id.fit(docs.where(~apart)))
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of the page archives in which every 97th page has a byte changed, another is cut short and another lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.pmod("page_id", F.lit(97))
    stored = F.when(kind == 5, F.concat(F.lit("#"), F.substring("html", 2, 2**31 - 2))).when(kind == 11, F.substring("html", 1, 100)).otherwise(F.col("html"))
    # The replica is read at the offsets of the index, as an audit of stored files does: each record in the place of its own row.
    read = warc_fixity.archived(pages, stored=stored)
    index = read.drop("read")
    lost = F.coalesce(F.pmod("id", F.lit(97)) == 17, F.lit(False))
    replica = read.where(~lost).select("archive", "offset", "length", "id", F.col("read").alias("digest"))
    wrong = warc_fixity.audit(index, replica).select("archive", "offset", "found", "status")
    return index.join(wrong, ["archive", "offset"], "left").select(
        F.col("id").alias("page_id"), "archive", F.col("offset").alias("record_offset"), "length", "digest", "found", F.coalesce("status", F.lit("intact")).alias("status")
    )


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = documents(spark, sf_dir), held_out(1, 3)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~apart)
    model = quality_pu.fit(docs.where(~apart), labels)
    scored = quality_pu.score(docs, model)
    return scored.select("doc_id", apart.alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES), budgets=(TOKEN_LIMIT,))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.get("cuts", F.lit(0)).alias("fitting_chars"))


def op5_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = rule_ledger.POLICIES[-1]
    book = rule_ledger.verdicts(rule_ledger.ledger(documents(spark, sf_dir)), policy)
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")
    return book.select("doc_id", *measured, F.lit(policy.version).alias("policy"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = fair_mix.in_mix_order(fair_mix.fair_mix(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(documents(spark, sf_dir))


def op9_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_classes(documents(spark, sf_dir))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(documents(spark, sf_dir), min_chars=20, min_docs=3)
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir), min_docs=3, top_terms=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_quality_pu": op3_quality_pu,
    "op4_token_counts": op4_token_counts,
    "op5_html_density": op5_html_density,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_fair_mix": op7_fair_mix,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_content_sort": op9_content_sort,
    "op10_sentence_pieces": op10_sentence_pieces,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}

#: The same results as DuckDB SQL, where SQL states them.
ORACLE: dict[str, str] = {
    "op2_warc_fixity": """
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, page_id % 97 AS kind,
                   CASE page_id % 97 WHEN 5 THEN '#' || substr(coalesce(html, ''), 2) WHEN 11 THEN substr(coalesce(html, ''), 1, 100)
                                     ELSE coalesce(html, '') END AS stored
            FROM pages),
        r AS (
            SELECT page_id, kind,
                   E'WARC/1.0\\r\\nWARC-Type: response\\r\\nWARC-Record-ID: <urn:page:' || page_id || E'>\\r\\nWARC-Target-URI: ' || url
                   || E'\\r\\nContent-Type: text/html\\r\\nContent-Length: ' || strlen(html) || E'\\r\\n\\r\\n' || html || E'\\r\\n\\r\\n' AS record,
                   E'WARC/1.0\\r\\nWARC-Type: response\\r\\nWARC-Record-ID: <urn:page:' || page_id || E'>\\r\\nWARC-Target-URI: ' || url
                   || E'\\r\\nContent-Type: text/html\\r\\nContent-Length: ' || strlen(stored) || E'\\r\\n\\r\\n' || stored || E'\\r\\n\\r\\n' AS again
            FROM p),
        d AS (SELECT page_id, kind, (page_id // 1000)::VARCHAR AS archive, strlen(record) AS length, sha256(record) AS digest,
                     CASE WHEN kind <> 17 THEN sha256(again) END AS read FROM r)
        SELECT page_id, archive, (sum(length) OVER (PARTITION BY archive ORDER BY page_id) - length)::BIGINT AS record_offset, length, digest,
               CASE WHEN read <> digest THEN read END AS found,
               CASE WHEN read IS NULL THEN 'missing' WHEN read <> digest THEN 'altered' ELSE 'intact' END AS status
        FROM d
    """,
    "op6_rule_ledger": """
        WITH d AS (
            SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), E'\\n'), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM documents),
        t AS (SELECT doc_id, i, w[i:i + 2] AS tri FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
                  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM t) WHERE c > 1)
              GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                   len(lines) AS n_lines, len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS n_upper,
                   len(regexp_extract_all(coalesce(text, ''), '[a-z]')) AS n_lower,
                   len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS n_twin_words
            FROM d LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 40 * n_words
                    OR n_upper > n_lower OR 10 * n_twin_words > 3 * n_words) AS kept,
               ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
                + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 40 * n_words)::BIGINT
                + 64 * (n_upper > n_lower)::BIGINT + 128 * (10 * n_twin_words > 3 * n_words)::BIGINT)::BIGINT AS failed_bits, '2' AS policy
        FROM b
    """,
    "op7_fair_mix": """
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS key
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight,
                     2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
        l AS (SELECT *, most / weight AS level,
                     (budget - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
                     row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS rank FROM w),
        c AS (SELECT arg_min(share, rank) FILTER (share <= level) AS common FROM l),
        t AS (SELECT source, source_size, least(most, weight * common) AS target FROM l, c),
        p AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS sent
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(size, floor(target)::BIGINT - sent))
                + greatest(0, least(size, floor(target)::BIGINT - sent - source_size)))::BIGINT AS taken
        FROM p
    """,
    "op9_content_sort": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\\n'), 1) AS place
            FROM documents),
        k AS (SELECT *, translate(trim(line, E' \\t\\n\\x0b\\x0c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (SELECT key, max(doc_id) AS best FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        d AS (SELECT k.*, best IS NOT NULL AND doc_id <> best AS gone FROM k LEFT JOIN s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, E'\\n' ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id
    """,
    "op12_filter_audit": """
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
        b AS (SELECT doc_id FROM labels WHERE quality = 1), x AS (SELECT doc_id FROM labels WHERE toxic = 1),
        d AS (
            SELECT part, doc_id IN (FROM b) AS good, doc_id IN (FROM x) AS toxic,
                   {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
                    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f
            FROM w),
        c AS (SELECT part, good, toxic, f, count(*) AS n FROM d GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
        m AS (SELECT *, map_from_entries([('A', f.A), ('B', f.B), ('C', f.C), ('D', f.D), ('E', f.E)]) AS g FROM c),
        r AS (
            SELECT part, o, step, o[step] AS x, good, toxic, n, g[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda y: g[y])) > 0 AS earlier,
                   len(list_filter(o, lambda y: g[y])) = 1 AS single
            FROM m, s),
        a AS (
            SELECT part, o, step, x, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (fails AND single), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (fails AND NOT earlier AND good), 0)::BIGINT AS good_lost,
                   coalesce(sum(n) FILTER (fails AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
            FROM r GROUP BY part, o, step, x)
        SELECT part, array_to_string(o, '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
        FROM a
    """,
    "op13_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (
            SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
                                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
        f AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (
            SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
                   1 + (1000000000::HUGEINT * (lang_n + 1)) // (total + v) AS q
            FROM f JOIN v USING (lang)),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
    """,
}
