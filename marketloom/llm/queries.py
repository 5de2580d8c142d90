"""The registered queries of this package: each operator over its whole table
with its production parameters, and their SQL forms where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketloom.llm import audit, decontaminate, embeddings, licenses, lines, minmax, mixing, pii, preference, ranked, secrets, shards, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    return preference.format_lists(preference.mismatched_pairs(_table(spark, folder, "conversations")), "conv_id")


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(_table(spark, folder, "documents"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_notices(_table(spark, folder, "documents"))


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, folder, "embeddings"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard(_table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(_table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.filter_audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.best_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    kept = lines.kept_texts(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_preference_format, op3_personal_data, op4_license_scan, op5_embedding_dedup, op6_sharding,
                            op7_toxicity, op8_minmax_dedup, op9_secret_scan, op10_mixing, op11_filter_audit, op12_ranked_search, op13_line_dedup)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op1_decontamination": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
        starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0),
        spans AS (SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[i:i + 12], ' ') AS s FROM starts),
        docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
        found AS (SELECT doc_id, i, s.l, item FROM places JOIN (SELECT DISTINCT l FROM spans) k ON i + k.l - 1 <= len(w)
                  JOIN spans s ON s.l = k.l AND s.s = array_to_string(w[i:i + k.l - 1], ' ')),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY 1),
        held AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
                 FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)""",
    "op2_preference_format": """
        WITH placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p
                        FROM conversations WHERE conv_id IS NOT NULL),
        ends AS (SELECT conv_id, max(p) AS p FROM placed WHERE role = 'assistant' GROUP BY 1),
        reply AS (SELECT conv_id, coalesce(text, '') AS t FROM placed JOIN ends USING (conv_id, p)),
        ids AS (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS nx, lag(conv_id) OVER (ORDER BY conv_id) AS pv
                FROM (SELECT DISTINCT conv_id FROM placed)),
        pair AS (SELECT r.conv_id, r.t AS own, CASE WHEN n.conv_id IS NOT NULL THEN n.t ELSE b.t END AS other
                 FROM reply r JOIN ids i ON i.conv_id = r.conv_id LEFT JOIN reply n ON n.conv_id = nx LEFT JOIN reply b ON b.conv_id = pv
                 WHERE n.conv_id IS NOT NULL OR b.conv_id IS NOT NULL),
        same AS (SELECT *, own = other AS alike FROM pair),
        head AS (SELECT s.conv_id, count(*) FILTER (WHERE x.p < e.p OR alike) AS n,
                 coalesce(string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY x.p)
                     FILTER (WHERE x.p < e.p OR alike), '') AS prompt
                 FROM same s JOIN ends e ON e.conv_id = s.conv_id JOIN placed x ON x.conv_id = s.conv_id AND x.p <= e.p GROUP BY 1)
        SELECT conv_id, CAST(n AS INTEGER) AS n_prompt_turns, prompt,
               CASE WHEN alike THEN '' ELSE '<|assistant|>' || chr(10) || own || '<|end|>' || chr(10) END AS chosen,
               CASE WHEN alike THEN '' ELSE '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) END AS rejected,
               CASE WHEN alike THEN '' ELSE '14:' || CAST(21 + length(own) AS VARCHAR) END AS chosen_mask,
               CASE WHEN alike THEN '' ELSE '14:' || CAST(21 + length(other) AS VARCHAR) END AS rejected_mask
        FROM same JOIN head USING (conv_id)""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
        low AS (SELECT x AS vec_id, min(y) AS low FROM reach GROUP BY 1),
        n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
               vec_id <= coalesce(low, vec_id) AS kept
        FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op8_minmax_dedup": f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
                 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
        least_id AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
               doc_id <= coalesce(low, doc_id) AS kept
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)""",
    "op10_mixing": """
        WITH RECURSIVE best AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1),
        docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                 -ln((CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
                 / CASE WHEN q > 0 THEN 2.0 WHEN q IS NULL THEN 1.0 ELSE 0.5 END AS k
                 FROM documents LEFT JOIN best USING (doc_id)),
        src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
                FROM docs GROUP BY 1),
        whole AS (SELECT sum(source_size) AS t FROM src),
        -- shares are dealt again until no source is above three times its size
        deal(turn, source, source_size, w, full_, target) AS (
            SELECT 0, source, source_size, w, false, CAST(0 AS DOUBLE) FROM src
            UNION ALL
            SELECT turn + 1, source, source_size, w, full_ OR share > 3 * source_size, least(share, 3.0 * source_size) FROM (
                SELECT *, CASE WHEN full_ THEN 3.0 * source_size ELSE
                    ((SELECT t FROM whole) - coalesce(sum(CASE WHEN full_ THEN 3.0 * source_size END) OVER (), 0)) * w
                    / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS share FROM deal) WHERE turn <= (SELECT count(*) FROM src)),
        goal AS (SELECT source, source_size, target FROM deal WHERE turn = (SELECT max(turn) FROM deal)),
        ordered AS (SELECT docs.doc_id, docs.size, g.source_size, g.target, sum(size) OVER (PARTITION BY docs.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
                    FROM docs JOIN goal g ON g.source IS NOT DISTINCT FROM docs.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) * size + greatest(0, least(size,
                   round(target - floor(target / source_size) * source_size) - before)) END AS BIGINT) AS taken
        FROM ordered""",
    "op11_filter_audit": r"""
        WITH known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
                       FROM labels GROUP BY 1),
        docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        flags AS (SELECT doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
                         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
                  FROM docs LEFT JOIN known USING (doc_id)),
        masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY 1, 2),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
                   WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
        met AS (SELECT part, filter_order, step, own, n, good, toxic, f, contains(f, own) AS fails,
                       len(translate(f, before, '')) = len(f) AS arrives FROM masks, steps),
        sums AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
                        CAST(coalesce(sum(n) FILTER (arrives AND NOT fails), 0) AS BIGINT) AS kept,
                        CAST(coalesce(sum(n) FILTER (arrives AND fails), 0) AS BIGINT) AS removed,
                        CAST(coalesce(sum(n) FILTER (NOT arrives AND fails), 0) AS BIGINT) AS redundant,
                        CAST(coalesce(sum(n) FILTER (f = own), 0) AS BIGINT) AS unique_fails,
                        CAST(coalesce(sum(good) FILTER (arrives AND fails), 0) AS BIGINT) AS good_lost,
                        CAST(coalesce(sum(toxic) FILTER (arrives AND fails), 0) AS BIGINT) AS toxic_lost
                 FROM met GROUP BY 1, 2, 3, 4)
        SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums""",
    "op12_ranked_search": rf"""
        WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        sized AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM docs),
        whole AS (SELECT count(*) FILTER (n > 0) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
        q AS (SELECT DISTINCT item_id, unnest({_ALNUM}) AS t FROM benchmark),
        tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t, nn),
        m AS (SELECT doc_id, 10 + (90 * n * nn) // ll AS m FROM sized, whole WHERE n > 0),
        s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
              FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
                   FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        placed AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS p FROM split),
        keyed AS (SELECT doc_id, line, p, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM placed),
        shared AS (SELECT k FROM keyed WHERE k <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(s.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (s.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN shared s ON s.k = keyed.k GROUP BY 1""",
}
