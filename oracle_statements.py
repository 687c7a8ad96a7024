"""The SQL each registered query must agree with, in the dialect of DuckDB."""

from __future__ import annotations

CHUNKS = """
chunks AS (
  SELECT doc_id, CAST(st // 280 AS INTEGER) AS chunk_idx, substr(text, st + 1, 300) AS text
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 280)) AS st FROM {source})
)"""

# Hashed bag of words over {source}(text, {ids}): emb(ids, text, v).
EMBED = """
slotted_{name} AS (
  SELECT {ids}, text,
    list_transform(
      list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''),
      lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64) AS slots
  FROM {source}
),
counted_{name} AS (
  SELECT {ids}, text, list_transform(range(0, 64), lambda i: len(list_filter(slots, lambda s: s = i))) AS c
  FROM slotted_{name}
),
{name} AS (
  SELECT {ids}, text,
    list_transform(c, lambda x: CASE WHEN n = 0 THEN CAST(0 AS FLOAT) ELSE CAST(x / n AS FLOAT) END) AS v
  FROM (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM counted_{name})
)"""

# Sentence units, their cumulative word counts, and the greedy packing.
SENTENCES = """
RECURSIVE units AS (
  SELECT doc_id, flatten(list_transform(
    string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_extract_all(s, '\\S+(?:\\s+\\S+){{0,279}}'))) AS u
  FROM {source}
),
sized AS (
  SELECT doc_id, u, list_transform(u, lambda s: len(regexp_extract_all(s, '\\S+'))) AS n FROM units WHERE len(u) > 0
),
ends AS (
  SELECT doc_id, u, list_transform(range(0, len(u) + 1), lambda i: CAST(coalesce(list_sum(n[1:i]), 0) AS BIGINT)) AS e FROM sized
),
packed AS (
  SELECT doc_id, 0 AS chunk_idx, 0 AS first, len(list_filter(e, lambda x: x <= 280)) - 1 AS stop FROM ends
  UNION ALL
  SELECT doc_id, chunk_idx + 1, nxt, len(list_filter(e, lambda x: x <= e[nxt + 1] + 280)) - 1
  FROM (
    SELECT p.doc_id, p.chunk_idx, d.e,
      len(list_filter(d.e, lambda x: x < greatest(d.e[p.stop + 1] - 30, d.e[p.stop + 2] - 280))) AS nxt
    FROM packed p JOIN ends d ON p.doc_id = d.doc_id
    WHERE p.stop < len(d.u)
  )
),
sentence_chunks AS (
  SELECT p.doc_id, CAST(p.chunk_idx AS INTEGER) AS chunk_idx, array_to_string(d.u[p.first + 1:p.stop], ' ') AS text
  FROM packed p JOIN ends d ON p.doc_id = d.doc_id
)"""

CENTRES = """
means AS (
  SELECT label, slot, avg(x) AS value
  FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS slot FROM embeddings)
  GROUP BY label, slot
),
centres AS (SELECT label, list(value ORDER BY slot) AS q FROM means GROUP BY label)"""

REL_PATH = "source || '/' || doc_id || '.log'"


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _sum(v: str, q: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({v}, {q}), lambda p: {term.format(x='p[1]::DOUBLE', y='p[2]::DOUBLE')}))"


def _metric(metric: str, v: str, q: str) -> str:
    if metric == "l2":
        return _sum(v, q, "({x} - {y}) * ({x} - {y})")
    if metric == "l1":
        return _sum(v, q, "abs({x} - {y})")
    if metric == "inner_product":
        return _sum(v, q, "{x} * {y}")
    lengths = f"(sqrt({_sum(v, v, '{x} * {y}')}) * sqrt({_sum(q, q, '{x} * {y}')}))"
    return f"{_sum(v, q, '{x} * {y}')} / nullif({lengths}, 0)"


def statements(embedder, rare: str, common: str, k: int, lsh) -> dict[str, str]:
    vector = {text: _list(embedder.one(text)) for text in (rare, common, "the and of the")}
    chunks = "WITH " + CHUNKS.format(source="documents")
    chunk_vectors = chunks + "," + EMBED.format(name="emb", ids="doc_id, chunk_idx", source="chunks")
    sentences = SENTENCES.format(source="documents")

    def nearest(metric: str, query: str, table: str = "embeddings", name: str = "distance") -> str:
        way = "DESC NULLS LAST" if metric in ("cosine", "inner_product") else "ASC"
        return f"""
            SELECT CAST(0 AS BIGINT) AS query_id, rank, vec_id, round(d, 6) AS {name}
            FROM (SELECT vec_id, d, CAST(row_number() OVER (ORDER BY d {way}, vec_id) AS INTEGER) AS rank
                  FROM (SELECT vec_id, {_metric(metric, "embedding", query)} AS d FROM {table}))
            WHERE rank <= {k}"""

    def hybrid(query: str, prefix: str = chunk_vectors) -> str:
        phrase = query.strip().lower()
        return f"""{prefix},
            scored AS (
              SELECT doc_id, chunk_idx, text, contains(lower(text), '{phrase}') AS hit,
                {_metric("l2", "v", vector[query])} AS d
              FROM emb
            ),
            hits AS (
              SELECT CAST(0 AS BIGINT) AS query_id,
                CAST(row_number() OVER (
                  ORDER BY hit DESC, CASE WHEN hit THEN NULL ELSE d END, doc_id, chunk_idx) AS INTEGER) AS rank,
                doc_id, chunk_idx, text, CASE WHEN hit THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score,
                round(d, 6) AS distance
              FROM scored QUALIFY rank <= {k}
            )"""

    def in_buckets(asked: str) -> str:
        own = "list_transform({directions}, lambda w: CAST(floor(list_dot_product({v}::DOUBLE[], w) / {length}) AS BIGINT))"
        directions = "[" + ", ".join(_list(w) for w in lsh.directions) + "]"
        buckets = lambda v: own.format(directions=directions, v=v, length=repr(float(lsh.bucket_length)))
        return f"""WITH {CENTRES},
            asked AS (SELECT query_id, q, {buckets("q")} AS b FROM {asked}),
            held AS (SELECT vec_id, embedding, {buckets("embedding")} AS b FROM embeddings),
            near AS (
              SELECT query_id, vec_id, {_metric("l2", "embedding", "q")} AS d FROM held, asked
              WHERE list_bool_or(list_transform(list_zip(held.b, asked.b), lambda p: p[1] = p[2]))
            )
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id,
              round(d, 6) AS distance
            FROM near QUALIFY rank <= {k}"""

    german = hybrid(
        rare,
        "WITH "
        + CHUNKS.format(source="(SELECT doc_id, text FROM documents WHERE lang = 'de')")
        + ","
        + EMBED.format(name="emb", ids="doc_id, chunk_idx", source="chunks"),
    )

    hits = "SELECT * FROM hits"
    to_centres = f"""WITH {CENTRES}
        SELECT query_id, rank, vec_id, round(d, 6) AS distance
        FROM (SELECT label AS query_id, vec_id, d,
                CAST(row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS INTEGER) AS rank
              FROM (SELECT c.label, e.vec_id, {_metric("l2", "e.embedding", "c.q")} AS d FROM embeddings e, centres c))
        WHERE rank <= {k}"""
    ledger = """
        known AS (
          SELECT 'doc-' || d.doc_id AS file_path,
            CASE WHEN quality = 0 THEN reverse(sha256(text)) ELSE sha256(text) END AS content_hash,
            CAST(strlen(text) AS BIGINT) AS file_size
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        ),
        pending AS (
          SELECT 'doc-' || doc_id AS file_path, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS file_size
          FROM documents d
          WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.file_path = 'doc-' || d.doc_id AND k.content_hash = sha256(d.text))
        )"""
    all_chunks_of_files = f"{chunks} SELECT {REL_PATH} AS rel_path, chunk_idx, c.text FROM chunks c JOIN documents d USING (doc_id)"
    upper = CHUNKS.replace("chunks AS", "changed AS").format(
        source="(SELECT doc_id, lower(text) AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"
    )
    kept = "SELECT doc_id, chunk_idx, text FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    slots = "len(list_filter(v, lambda x: x > 0))"
    docs_embedded = "WITH " + EMBED.format(name="emb", ids="doc_id", source="documents")

    return {
        "chunk_fixed": f"{chunks} SELECT * FROM chunks",
        "chunk_counts": "SELECT doc_id, CAST(ceil(length(text) / 280) AS BIGINT) AS n_chunks FROM documents",
        "chunks_per_document": f"{chunks} SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id",
        "chunk_batches": f"""{chunks}
            SELECT doc_id, CAST(chunk_idx // 32 AS INTEGER) AS batch_idx, count(*) AS n_rows,
              CAST(sum(length(text)) AS BIGINT) AS n_chars
            FROM chunks GROUP BY ALL""",
        "chunk_sentences": f"WITH {sentences} SELECT * FROM sentence_chunks",
        "chunk_large_files": all_chunks_of_files,
        "content_hash": "SELECT doc_id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS file_size FROM documents",
        "charset_decode": """
            SELECT doc_id, CASE lang WHEN 'fr' THEN 'utf-16-le' WHEN 'es' THEN 'utf-16-be' ELSE 'utf-8' END AS charset,
              sha256(text) AS text_hash FROM documents""",
        "charset_guess": """
            SELECT ['utf-8', 'utf-16-le', 'utf-16-be', 'cp1252', 'cp850', 'mac_roman'][doc_id % 6 + 1] AS encoding, count(*) AS n_files,
              CAST(sum(CASE doc_id % 6 WHEN 0 THEN strlen(text)
                WHEN 1 THEN 2 * (length(text) + length(regexp_replace(text, '[\\x00-\\x{FFFF}]', '', 'g')))
                WHEN 2 THEN 2 * (length(text) + length(regexp_replace(text, '[\\x00-\\x{FFFF}]', '', 'g'))) END) AS BIGINT) AS n_bytes,
              true AS mostly_right
            FROM documents WHERE length(text) >= 200 AND regexp_matches(text, '[^\\x00-\\x7f]') GROUP BY doc_id % 6""",
        "normalize_newlines": "SELECT doc_id, sha256(text) AS text_hash FROM documents",
        "render_document": """
            SELECT doc_id, 'Metadata: category=>log::author=>unknown' || chr(10) || '-----' || chr(10) || 'Content: ' || text AS rendered
            FROM documents""",
        "phrase_matches": f"{chunks} SELECT doc_id, chunk_idx FROM chunks WHERE contains(lower(text), '{rare}')",
        "phrase_by_index": f"""
            SELECT p.item_id, d.doc_id FROM documents d
            JOIN (SELECT item_id, text FROM benchmark UNION ALL VALUES (-1, '{rare}'), (-2, '{common}')) p
            ON contains(lower(d.text), lower(trim(p.text)))""",
        "phrase_topk": f"""{chunks}
            SELECT CAST(row_number() OVER (ORDER BY doc_id, chunk_idx) AS INTEGER) AS rank, doc_id, chunk_idx, text
            FROM chunks WHERE contains(lower(text), '{common.strip().lower()}') QUALIFY rank <= {k}""",
        "hybrid_search": f"{hybrid(rare)} {hits}",
        "hybrid_search_many_phrases": f"{hybrid(common)} {hits}",
        "hybrid_by_union": f"""{chunk_vectors},
            exact AS (
              SELECT doc_id, chunk_idx FROM chunks WHERE contains(lower(text), '{rare}') ORDER BY 1, 2 LIMIT {k}
            ),
            near AS (
              SELECT doc_id, chunk_idx FROM emb ORDER BY {_metric("l2", "v", vector[rare])}, doc_id, chunk_idx LIMIT {k}
            )
            SELECT doc_id, chunk_idx, CAST(1 AS DOUBLE) AS score FROM exact
            UNION ALL
            SELECT doc_id, chunk_idx, CAST(0.5 AS DOUBLE) FROM near
            WHERE (doc_id, chunk_idx) NOT IN (SELECT (doc_id, chunk_idx) FROM exact)""",
        "hybrid_batch": f"""{chunk_vectors},
            {EMBED.format(name="asked", ids="item_id", source=f"(SELECT item_id, text FROM benchmark UNION ALL SELECT -1, '{rare}' UNION ALL SELECT -2, '{common}')")},
            scored AS (
              SELECT item_id AS query_id, doc_id, chunk_idx, e.text, contains(lower(e.text), lower(trim(a.text))) AS hit,
                {_metric("l2", "e.v", "a.v")} AS d
              FROM emb e, asked a
            )
            SELECT query_id, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY hit DESC, CASE WHEN hit THEN NULL ELSE d END, doc_id, chunk_idx) AS INTEGER) AS rank,
              doc_id, chunk_idx, text, CASE WHEN hit THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score, round(d, 6) AS distance
            FROM scored QUALIFY rank <= {k}""",
        "filtered_search": f"{german} {hits}",
        "prompt_context": f"""{hybrid(rare)}
            SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id""",
        "hit_lines": f"{hybrid(rare)} SELECT query_id, rank, doc_id || ': ' || text AS line FROM hits",
        # Stored ids are paths, so positions order as strings.
        "search_store_by_index": f"""{chunk_vectors}
            SELECT {REL_PATH} AS rel_path, chunk_idx, CASE WHEN hit THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score,
              round(d, 6) AS distance
            FROM (SELECT doc_id, chunk_idx, contains(lower(text), '{rare}') AS hit, {_metric("l2", "v", vector[rare])} AS d FROM emb)
            JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
            ORDER BY hit DESC, CASE WHEN hit THEN NULL ELSE d END, rel_path, chunk_idx LIMIT {k}""",
        "search_store": f"""{chunk_vectors}
            SELECT {REL_PATH} AS rel_path, chunk_idx, CASE WHEN hit THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score,
              round(d, 6) AS distance
            FROM (SELECT doc_id, chunk_idx, contains(lower(text), '{rare}') AS hit, {_metric("l2", "v", vector[rare])} AS d FROM emb)
            JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
            ORDER BY hit DESC, CASE WHEN hit THEN NULL ELSE d END, rel_path, chunk_idx LIMIT {k}""",
        "hash_embed": f"""{docs_embedded}
            SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(CAST(weight AS DOUBLE), 6) AS weight
            FROM (SELECT doc_id, unnest(v) AS weight, unnest(range(0, 64)) AS slot FROM emb) WHERE weight > 0""",
        "embed_cache": f"""{docs_embedded}
            SELECT DISTINCT sha256(text) AS text_hash, CAST({slots} AS INTEGER) AS n_slots FROM emb
            WHERE text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""",
        "embed_cached": f"{docs_embedded} SELECT doc_id, CAST({slots} AS INTEGER) AS n_slots FROM emb",
        "mean_pool": f"WITH {CENTRES} SELECT label, CAST(slot AS INTEGER) AS slot, round(value, 6) AS value FROM means",
        "dim_check": """
            SELECT CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim,
              count(*) AS n_vectors FROM embeddings""",
        "unique_check": "SELECT sha256(text) AS text_hash, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1",
        "unique_chunks": f"""{chunks}
            SELECT doc_id, chunk_idx, CAST(2 AS BIGINT) AS n_rows FROM chunks
            WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
        "failed_embeddings": f"""{chunks}
            SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks,
              count(*) FILTER (WHERE contains(lower(text), 'license')) AS failed FROM chunks""",
        "masked_pool": """
            SELECT digit, CAST(slot AS INTEGER) AS slot, round(avg(x), 6) AS value
            FROM (SELECT vec_id % 10 AS digit, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS slot
                  FROM embeddings WHERE label % 2 <> 0)
            GROUP BY digit, slot""",
        "key_value_fields": """
            SELECT doc_id, CAST(doc_id AS VARCHAR) AS id_value, lang AS lang_value, CAST(n_chars AS VARCHAR) AS chars_value FROM documents""",
        "vm_lines": """
            SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS vm_id
            FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
        "regex_literal": f"{chunks} SELECT doc_id, chunk_idx FROM chunks WHERE contains(text, '.*** ')",
        "ingest_mixed_encodings": all_chunks_of_files,
        "ingest_mixed_encodings_split": all_chunks_of_files,
        "truncate_store": f"""{chunks}
            SELECT {REL_PATH} AS rel_path, chunk_idx, c.text FROM chunks c
            JOIN (SELECT doc_id, source FROM documents WHERE text <> ''
                  QUALIFY row_number() OVER (PARTITION BY source ORDER BY source || '/' || doc_id || '.log') = 1) USING (doc_id)""",
        "ingest_counts": f"""{chunks}
            SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(0 AS BIGINT) AS failed FROM chunks""",
        "vector_shapes": f"""
            SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(n, 6) AS norm, 80 AS padded_dim,
              round(n, 6) AS padded_norm, round(cut, 6) AS cut_norm
            FROM (SELECT vec_id, embedding, sqrt({_sum("embedding", "embedding", "{x} * {y}")}) AS n,
                    sqrt({_sum("embedding[1:16]", "embedding[1:16]", "{x} * {y}")}) AS cut
                  FROM embeddings)""",
        "knn_l2": nearest("l2", vector[rare]),
        "knn_metrics": " UNION ALL ".join(
            f"SELECT *, '{m}' AS metric FROM ({nearest(m, vector[rare])})" for m in ("cosine", "inner_product", "l1", "l2")
        ),
        "cosine_topk": nearest("cosine", vector[rare], name="similarity"),
        "knn_multi": to_centres,
        "knn_multi_blocked": to_centres,
        "knn_both_large": f"""
            SELECT query_id, rank, vec_id, round(d, 6) AS distance
            FROM (SELECT query_id, vec_id, d, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank
                  FROM (SELECT q.vec_id AS query_id, e.vec_id, {_metric("l2", "e.embedding", "q.embedding")} AS d FROM embeddings e, embeddings q))
            WHERE rank <= {k}""",
        "semantic_batch": f"""{chunk_vectors},
            {EMBED.format(name="asked", ids="item_id", source="benchmark")}
            SELECT query_id, rank, doc_id, chunk_idx, round(d, 6) AS distance
            FROM (SELECT item_id AS query_id, doc_id, chunk_idx, d,
                    CAST(row_number() OVER (PARTITION BY item_id ORDER BY d, doc_id, chunk_idx) AS INTEGER) AS rank
                  FROM (SELECT a.item_id, e.doc_id, e.chunk_idx, {_metric("l2", "e.v", "a.v")} AS d FROM emb e, asked a))
            WHERE rank <= 5""",
        "fetch_records": f"""
            SELECT rank, h.vec_id, label FROM ({nearest("l2", vector[rare])}) h JOIN embeddings e ON h.vec_id = e.vec_id""",
        "append_vectors": f"""WITH {CENTRES},
            more AS (
              SELECT vec_id, embedding FROM embeddings
              UNION ALL
              SELECT CAST(-1 - label AS BIGINT), CAST(q AS FLOAT[]) FROM centres
            )
            {nearest("l2", vector[rare], "more")}""",
        "ann_ivf_exhaustive": to_centres,
        "ann_ivf": f"""WITH {CENTRES},
            homes AS (
              SELECT vec_id, embedding, label AS cell
              FROM (SELECT e.vec_id, e.embedding, c.label, {_metric("l2", "e.embedding", "c.q")} AS d FROM embeddings e, centres c)
              QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) = 1
            ),
            probes AS (
              SELECT query_id, q, cell
              FROM (SELECT a.label AS query_id, a.q, b.label AS cell, {_metric("l2", "a.q", "b.q")} AS d FROM centres a, centres b)
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, cell) <= 4
            )
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id,
              round(d, 6) AS distance
            FROM (SELECT query_id, vec_id, {_metric("l2", "embedding", "q")} AS d FROM homes JOIN probes USING (cell))
            QUALIFY rank <= {k}""",
        "ann_lsh": in_buckets(f"(SELECT CAST(0 AS BIGINT) AS query_id, {vector[rare]} AS q)"),
        "ann_lsh_batch": in_buckets("(SELECT label AS query_id, q FROM centres)"),
        "incremental_files": f"WITH {ledger} SELECT * FROM pending",
        "ledger_upsert": f"""WITH {ledger}
            SELECT file_path, content_hash, file_size, CAST(86400 AS BIGINT) AS processed_sec, 'processed' AS status FROM pending
            UNION ALL
            SELECT file_path, content_hash, file_size, CAST(0 AS BIGINT), 'processed' FROM known
            WHERE file_path NOT IN (SELECT file_path FROM pending)""",
        "doc_upsert": f"{chunks}, {upper} {kept} UNION ALL SELECT * FROM changed",
        "doc_delete": f"{chunks} SELECT doc_id, count(*) AS n_chunks FROM ({kept}) GROUP BY doc_id",
        "scan_logs": f"""
            SELECT {REL_PATH} AS rel_path, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS content_hash,
              CAST(strlen(text) AS BIGINT) AS file_size, doc_id || '.log' AS file_name
            FROM documents WHERE text <> ''""",
        "first_per_directory": f"""
            SELECT rel_path, content_hash
            FROM (SELECT {REL_PATH} AS rel_path, sha256(text) AS content_hash, source FROM documents WHERE text <> '')
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY rel_path) = 1""",
        "visit_files": f"SELECT {REL_PATH} AS rel_path, sha256(text) AS content_hash FROM documents WHERE text <> ''",
        "ingest_logs": all_chunks_of_files,
        "ingest_ledger": f"""
            SELECT {REL_PATH} AS rel_path, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS file_size,
              'processed' AS status
            FROM documents WHERE text <> ''""",
        "ingest_directory": f"""WITH {sentences}
            SELECT {REL_PATH} AS rel_path, chunk_idx, c.text FROM sentence_chunks c JOIN documents d USING (doc_id)""",
        "add_texts": "WITH "
        + EMBED.format(name="emb", ids="id", source="(SELECT conv_id || '-' || turn AS id, text FROM conversations)")
        + f"""
            SELECT CAST(row_number() OVER (ORDER BY s DESC NULLS LAST, id, text) AS INTEGER) AS rank, id, text,
              round(s, 6) AS similarity
            FROM (SELECT id, text, {_metric("cosine", "v", vector["the and of the"])} AS s FROM emb)
            QUALIFY rank <= {k}""",
        "stream_ingest_logs": all_chunks_of_files,
        "event_fields": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
        "events_by_time_and_level": """
            SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, upper(event_type) AS level, count(*) AS n_lines
            FROM events GROUP BY ALL""",
    }
