"""DuckDB forms of the corpus queries that SQL can express."""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """op11's rounds one after the other: a (assignments) and b (codebooks) of each."""
    steps = [f"""
        WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS v FROM k, range({parts}) AS r(p)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}),
        b0 AS MATERIALIZED (SELECT p, e, v AS b FROM f JOIN v USING (vec_id))"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := list_sum(list_transform(list_zip(v, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS m
              FROM v JOIN b{i} USING (p) GROUP BY vec_id, p)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (SELECT p, e, i, sum(x) AS s, count(*) AS c FROM (SELECT p, m.e AS e, unnest(range(len(v))) AS i, unnest(v) AS x FROM a{i} JOIN v USING (vec_id, p)) GROUP BY p, e, i),
        m{i} AS (SELECT p, e, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS n FROM s{i} GROUP BY p, e),
        b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(n, b) AS b FROM b{i} LEFT JOIN m{i} USING (p, e))""")
    steps.append(f"""
        c AS (SELECT vec_id, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h""")
    return ",".join(steps[:-1]) + "," + steps[-1]


ORACLE = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op7_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said,
                          struct_pack(r := role, t := text) AS part FROM conversations),
        c AS (SELECT conv_id, list(part ORDER BY turn) AS parts, string_agg(said, '' ORDER BY turn) AS rendered, count(*) AS n_turns FROM t GROUP BY conv_id),
        p AS (SELECT DISTINCT parts[1:i] AS parts FROM (SELECT parts, unnest(generate_series(1, n_turns - 1)) AS i FROM c)),
        m AS (SELECT * FROM c ANTI JOIN p USING (parts))
        SELECT min(conv_id) AS conv_id, CAST(any_value(n_turns) AS BIGINT) AS n_turns, count(*) AS n_equal, any_value(rendered) AS rendered FROM m GROUP BY parts""",
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
                          coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
        s AS (SELECT key, sum(size) AS source_size FROM d GROUP BY key),
        w AS (SELECT *, 1 + (row_number() OVER (ORDER BY encode(key)) - 1) % 3 AS weight FROM s),
        o AS (SELECT *, sum(source_size) OVER () AS total,
                     coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                     sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
        x AS (SELECT *, (total - caps)::DOUBLE * weight / free::DOUBLE < 3 * source_size AS fits FROM o),
        l AS (SELECT first(total - caps ORDER BY source_size::DOUBLE / weight, key) AS lft, first(free ORDER BY source_size::DOUBLE / weight, key) AS share FROM x WHERE fits),
        t AS (SELECT key, source_size, least(lft::DOUBLE * weight / share::DOUBLE, (3 * source_size)::DOUBLE) AS target,
                     ('0x' || substr(md5('mix:7:' || key), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM w, l),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size, md5(doc_id::VARCHAR), doc_id) AS rank FROM d)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST(least(floor(u + target / source_size * rank) - floor(u + target / source_size * (rank - 1)), 3) * size AS BIGINT) AS taken
        FROM r JOIN t USING (key)""",
    "op11_vector_codes": _codes(),
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [('0x' || k[8 * i - 7 : 8 * i])::BIGINT FOR i IN [1, 2, 3, 4]] AS h FROM d),
        c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                          WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        s AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM s""",
}
