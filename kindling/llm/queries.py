"""Registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.cluster import new_folder, ship, spread
from kindling.llm import byte_bpe, html_text, line_windows, phrase_graph, quality_rules, repeats, shingle_tree, string_tiling, surrogates, token_store, toxicity, vector_forest, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def op1_token_store(spark, sf_dir):
    """Every document's place, length and checksum, as read back from a coded store."""
    path = new_folder(spark, "tokens")
    token_store.write_store(documents(spark, sf_dir), WORD_BPE, path)
    return token_store.read_documents(spark, path)


def op2_byte_bpe(spark, sf_dir):
    """Digests of every text's ids and of the text decoded from them."""
    return byte_bpe.round_trip(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op3_line_dedup(spark, sf_dir):
    """Every document's text without repeated lines, as a digest."""
    out = line_windows.line_dedup(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity(spark, sf_dir):
    """Every document's score by a model of the labels that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_html_extraction(spark, sf_dir):
    """Main text of every page."""
    pages = html_text.extract_text(table(spark, sf_dir, "pages", "page_id").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_suffix_groups(spark, sf_dir):
    """Every document without the bytes of repeated strings, as a digest."""
    out = repeats.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_shingle_join(spark, sf_dir):
    """Every document's number of shingles and component of similar texts."""
    return shingle_tree.similar_texts(documents(spark, sf_dir))


def op8_surrogates(spark, sf_dir):
    """Every document's text with surrogates for its personal data."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.replace_personal_data(docs, "a key for the registered query only")


def op9_decontamination(spark, sf_dir):
    """Every document that covers a benchmark item, with the item and the words covered."""
    items = table(spark, sf_dir, "benchmark", "item_id")
    return string_tiling.find_leaks(documents(spark, sf_dir), items)


def op10_vector_forest(spark, sf_dir):
    """Every vector's links, component and whether it stays."""
    return vector_forest.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id"))


def op11_vector_whitening(spark, sf_dir):
    """Every vector's whitened components, one row for each."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    out = whitening.transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    return out.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_quality_rules(spark, sf_dir):
    """Every document's counts and whether it stays by the table of thresholds."""
    found = quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *(f"quality.{c}" for c in counts))


def op13_phrase_graph(spark, sf_dir):
    """Each language's best phrases."""
    return phrase_graph.collocations(documents(spark, sf_dir))


_QUERIES = [op1_token_store, op2_byte_bpe, op3_line_dedup, op4_toxicity, op5_html_extraction, op6_suffix_groups, op7_shingle_join, op8_surrogates, op9_decontamination, op10_vector_forest, op11_vector_whitening, op12_quality_rules, op13_phrase_graph]

# DuckDB's SQL for the queries that it can express.
_SQL: dict[str, str] = {
    "op3_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        p AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3),
        r AS (
            SELECT doc_id, pos,
                row_number() OVER (PARTITION BY ls[pos], ls[pos + 1], ls[pos + 2] ORDER BY doc_id, pos) AS rn
            FROM p
        ),
        g AS (SELECT DISTINCT doc_id, pos + k AS i FROM r, (VALUES (0), (1), (2)) t(k) WHERE rn > 1),
        e AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM d),
        k AS (
            SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS kept, count(*) AS n
            FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
        )
        SELECT d.doc_id, len(d.ls)::INT AS n_lines, (len(d.ls) - coalesce(k.n, 0))::INT AS n_removed,
            sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op12_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, lang, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ),
        w AS (SELECT doc_id, lang, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM d),
        s AS (
            SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o
                || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o AS g
            FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ),
        m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM s WHERE g IS NOT NULL),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, range(8) t(k) WHERE m.n > 1 GROUP BY doc_id),
        stops(lang, listed) AS (VALUES
            ('de', ['auch', 'auf', 'das', 'dem', 'den', 'der', 'des', 'die', 'ein', 'eine', 'für', 'im', 'in', 'ist', 'mit', 'nicht', 'sich', 'und', 'von', 'zu']),
            ('en', ['a', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'have', 'in', 'is', 'of', 'on', 'or', 'that', 'the', 'to', 'was', 'with']),
            ('es', ['al', 'con', 'de', 'del', 'el', 'en', 'es', 'la', 'las', 'los', 'no', 'para', 'por', 'que', 'se', 'su', 'un', 'una', 'y']),
            ('fr', ['au', 'avec', 'dans', 'de', 'des', 'du', 'en', 'est', 'et', 'la', 'le', 'les', 'par', 'pas', 'pour', 'que', 'qui', 'sur', 'un', 'une'])
        ),
        c AS (
            SELECT doc_id, count(*) AS n, sum(length(w)) AS chars, count_if(regexp_matches(w, '\p{L}')) AS letters,
                count_if(list_contains(listed, lower(rtrim(w, '.,;:!?')))) AS stop
            FROM w LEFT JOIN stops USING (lang) GROUP BY doc_id
        ),
        l AS (SELECT doc_id, unnest(ls) AS x FROM d),
        n AS (
            SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup,
                count_if(regexp_matches(x, '^[\x20\x09]*[-*•●▪‣◦][\x20\x09]')) AS bullets,
                count_if(regexp_matches(x, '(…|\.\.\.)[\x20\x09-\x0D]*\z')) AS dots
            FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ),
        f AS (
            SELECT d.doc_id, d.lang, coalesce(c.n, 0) AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars,
                len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS n_symbols, coalesce(n.dup, 0) AS n_dup_lines,
                coalesce(r.n, 0) AS n_repeat_words, coalesce(c.letters, 0) AS letters, coalesce(c.stop, 0) AS stop,
                coalesce(n.n, 0) AS lines, coalesce(n.bullets, 0) AS bullets, coalesce(n.dots, 0) AS dots
            FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words
                AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words AND 100 * n_symbols <= 10 * n_words
                AND 100 * letters >= 80 * n_words
                AND (lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr') OR 100 * stop >= 2 * n_words)
                AND 100 * n_dup_lines <= 30 * lines AND 100 * bullets <= 90 * lines AND 100 * dots <= 30 * lines AS kept
        FROM f
    """,
    "op13_phrase_graph": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang,
                string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
            FROM documents
        ),
        e AS (SELECT lang, unnest(ps) AS p FROM d),
        q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM e),
        s AS (SELECT lang, id, unnest(ws) AS w1, unnest(generate_series(1, len(ws))) AS i FROM q),
        g AS (
            SELECT lang, w1, w1 || ' ' || lead(w1, 1) OVER o AS w2, w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o AS w3,
                w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o || ' ' || lead(w1, 3) OVER o AS w4,
                w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o || ' ' || lead(w1, 3) OVER o || ' ' || lead(w1, 4) OVER o AS w5
            FROM s WINDOW o AS (PARTITION BY id ORDER BY i)
        ),
        f AS (
            SELECT lang, p, count(*) AS a
            FROM (SELECT lang, unnest([w1, w2, w3, w4, w5]) AS p FROM g) WHERE p IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
        ),
        t AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
        c AS (SELECT lang, p, a, string_split(p, ' ') AS ws FROM f WHERE contains(p, ' ')),
        inner_parts AS (
            SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS p, max(a) AS longer
            FROM c, range(1, 5) x(i), range(2, 5) y(k) WHERE k < len(ws) AND i + k - 1 <= len(ws) GROUP BY ALL
        ),
        kept AS (SELECT c.* FROM c LEFT JOIN inner_parts USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * a),
        cuts AS (
            SELECT kept.lang, kept.p, kept.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * kept.a * n) // (l.a::HUGEINT * r.a) AS score
            FROM kept, range(1, 5) x(k), f l, f r, t
            WHERE k < len(ws) AND l.lang = kept.lang AND l.p = array_to_string(ws[1:k], ' ')
                AND r.lang = kept.lang AND r.p = array_to_string(ws[k + 1:], ' ') AND t.lang = kept.lang
        ),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank, p AS phrase, a, l, r, n, score::BIGINT AS score
        FROM best QUALIFY rank <= 2000
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
