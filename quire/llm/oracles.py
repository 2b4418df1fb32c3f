"""DuckDB SQL of those queries of this package that SQL can express."""

from __future__ import annotations

from quire.llm.licenses import EQUIVALENT, known_licenses


def _url_tree_sql(levels: int) -> str:
    """CTEs level_1 to level_n, each from the one before."""
    out = []
    for n in range(1, levels + 1):
        out.append(f"""
        branch_{n} AS (
            SELECT host, template, parts[{n}] AS segment, sum(pages) AS pages, sum(labelled) AS labelled, sum(good) AS good
            FROM level_{n - 1} WHERE len(parts) >= {n} GROUP BY ALL),
        kept_{n} AS (
            SELECT host, template, segment FROM (
                SELECT *, sum(labelled) OVER w AS all_labelled, sum(good) OVER w AS all_good
                FROM branch_{n} WINDOW w AS (PARTITION BY host, template))
            WHERE pages >= 8 AND labelled >= 8 AND segment <> '#' AND all_labelled > labelled
              AND (good::DOUBLE / labelled - (all_good - good)::DOUBLE / (all_labelled - labelled))
                  * (good::DOUBLE / labelled - (all_good - good)::DOUBLE / (all_labelled - labelled))
                  > 2.576::DOUBLE * 2.576::DOUBLE * ((all_good::DOUBLE / all_labelled) * (1 - all_good::DOUBLE / all_labelled)
                    * (1::DOUBLE / labelled + 1::DOUBLE / (all_labelled - labelled)))),
        level_{n} AS (
            SELECT l.host, l.shape, l.parts, l.pages, l.labelled, l.good,
                   l.template || CASE WHEN len(l.parts) < {n} THEN '' WHEN k.segment IS NOT NULL THEN '/' || k.segment ELSE '/*' END AS template
            FROM level_{n - 1} l LEFT JOIN kept_{n} k ON l.host = k.host AND l.template = k.template AND l.parts[{n}] = k.segment),""")
    return "".join(out)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_lines_sql(text: str) -> str:
    form = f"lower(coalesce({text}, ''))"
    for variant, common in EQUIVALENT:
        form = f"replace({form}, {_quoted(variant)}, {_quoted(common)})"
    return f"""list_filter(list_transform(string_split(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(copyright )+((c )?[0-9]{{4}}( |$)|c )') AND x <> 'all rights reserved')"""


#: CRC-32 (reflected polynomial 0xEDB88320) of a string of ASCII characters.
_CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''),
        lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda crc, e: CASE WHEN e >= 0 THEN xor(crc, e) ELSE xor(crc >> 1, 3988292384::BIGINT * (crc & 1)) END), 4294967295::BIGINT)"""


ORACLES: dict[str, str] = {
    "op11_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id AS c, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS item,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words, turn
            FROM conversations WHERE conv_id IS NOT NULL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, item) AS pos FROM turns),
        own AS (SELECT c, max(pos) AS had, c - c % 20 AS base, """ + _CRC32_SQL.format("c::VARCHAR") + r""" % 4 AS h FROM placed GROUP BY c),
        members AS (SELECT o.c, o.base, o.h, least(o.h, coalesce(b.had, 0)) AS k, o.had FROM own o LEFT JOIN own b ON b.c = o.base),
        rebuilt AS (
            SELECT m.c, m.k + p.pos - m.h AS depth, p.item, p.words FROM members m JOIN placed p ON p.c = m.c AND p.pos > m.h
            UNION ALL SELECT m.c, p.pos, p.item, p.words FROM members m JOIN placed p ON p.c = m.base AND p.pos <= m.k),
        paths AS (
            SELECT c, depth, string_agg(item, ',') OVER (PARTITION BY c ORDER BY depth) AS name, words FROM rebuilt
            UNION ALL SELECT c, 0, '', 0 FROM members),
        ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM paths),
        nodes AS (
            SELECT name, min(c) AS conv_id, depth, count(*) AS n_convs, max(words) AS words,
                   coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended
            FROM ended GROUP BY name, depth),
        linked AS (
            SELECT n.*, p.name AS up, q.conv_id AS parent_conv_id
            FROM nodes n LEFT JOIN paths p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes q ON q.name = p.name AND q.depth = p.depth),
        counted AS (
            SELECT l.*, coalesce(k.n_children, 0) AS n_children
            FROM linked l LEFT JOIN (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL) k
                ON k.up = l.name AND k.depth = l.depth),
        sums AS (
            SELECT a.name, a.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens
            FROM counted u JOIN paths a ON a.c = u.conv_id AND a.depth <= u.depth GROUP BY a.name, a.depth)
        SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, sha256(c.ended) AS ends_sha256
        FROM counted c JOIN sums s USING (name, depth)""",
    "op4_license_scan": f"""
        WITH known AS (
            SELECT sha256(array_to_string(lines, ' ')) AS digest, min(license) AS license
            FROM (SELECT license, {_license_lines_sql('text')} AS lines
                  FROM (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in known_licenses())}) AS v(license, text))
            WHERE len(lines) > 0 GROUP BY 1),
        units AS (SELECT doc_id, {_license_lines_sql('text')} AS lines FROM documents),
        told AS (SELECT doc_id, lines, sha256(coalesce(array_to_string(lines, ' '), '')) AS text_digest FROM units),
        noted AS (
            SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
            FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM told) JOIN known USING (digest) GROUP BY doc_id)
        SELECT t.doc_id, t.text_digest, k.license AS text_license, coalesce(n.line_licenses, '') AS line_licenses
        FROM told t LEFT JOIN known k ON t.text_digest = k.digest LEFT JOIN noted n ON t.doc_id = n.doc_id""",
    "op8_url_filter": r"""
        WITH rated AS (
            SELECT doc_id, min(quality) - max(coalesce(toxic, 0)) > 0 AS good
            FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
        parsed AS (
            SELECT page_id, TRY_CAST(nullif(regexp_extract(regexp_extract(url, '^[^?#]*'), '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS doc_id,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        judged AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, r.good
            FROM parsed p LEFT JOIN rated r USING (doc_id)),
        paged AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM judged),
        level_0 AS (
            SELECT host, shape, list_filter(string_split(shape, '/'), lambda s: s <> '') AS parts, '' AS template,
                   count(*) AS pages, count(good) AS labelled, count(*) FILTER (good) AS good
            FROM paged GROUP BY host, shape),""" + _url_tree_sql(4) + r"""
        leaves AS (SELECT host, shape, labelled, good, template || CASE WHEN len(parts) > 4 THEN '/**' ELSE '' END AS template FROM level_4),
        overall AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good)::DOUBLE / sum(labelled) ELSE 0.5::DOUBLE END AS share FROM leaves),
        templates AS (SELECT host, template, sum(labelled)::DOUBLE AS labelled, sum(good)::DOUBLE AS good FROM leaves GROUP BY host, template),
        purities AS (
            SELECT host, template, (good + 10.0::DOUBLE * ((sum(good) OVER w + 10.0::DOUBLE * share) / (sum(labelled) OVER w + 10.0::DOUBLE)))
                   / (labelled + 10.0::DOUBLE) AS purity
            FROM templates, overall WINDOW w AS (PARTITION BY host)),
        rules(rule, rule_host, rule_path, action) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        fitting AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
            FROM paged, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, CASE WHEN u.purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
               u.template, u.purity
        FROM paged p JOIN leaves l USING (host, shape) JOIN purities u ON l.host = u.host AND l.template = u.template
        LEFT JOIN fitting f USING (page_id)""",
    "op6_source_mixing": r"""
        WITH rated AS (
            SELECT doc_id, 0.25::DOUBLE + 0.75::DOUBLE * avg(quality) AS weight
            FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
        docs AS (
            SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   -ln((('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5)
                       / 281474976710656.0::DOUBLE) / greatest(coalesce(r.weight, 0.5::DOUBLE), 1e-9::DOUBLE) AS key
            FROM documents d LEFT JOIN rated r USING (doc_id)),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
        placed AS (
            SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place, sum(source_size) OVER () AS total FROM sources),
        weighed AS (
            SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   3 * source_size AS cap FROM placed),
        levels AS (
            SELECT *, (total - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS own
            FROM weighed WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (SELECT source, source_size, least(cap::DOUBLE, max(own) OVER () * weight) AS target FROM levels),
        rests AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
        summed AS (
            SELECT d.*, r.source_size, r.target, r.epochs, round(r.target - r.epochs * r.source_size)::BIGINT AS rest,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
            FROM docs d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
        FROM summed""",
    "op9_embedding_near_dedup": r"""
        WITH RECURSIVE clean AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
        degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN degrees d ON e.vec_id = d.a LEFT JOIN least c ON e.vec_id = c.a""",
    "op10_warc": r"""
        WITH raw AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        hashed AS (
            SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM raw),
        bits AS (
            SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || hex[i])::INT), 4, '0')), 'string_agg', '') AS b FROM hashed),
        told AS (
            SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
                   list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                       1 + 16 * b[i * 5 + 1]::INT + 8 * b[i * 5 + 2]::INT + 4 * b[i * 5 + 3]::INT + 2 * b[i * 5 + 4]::INT + b[i * 5 + 5]::INT]),
                       'string_agg', '') AS payload_digest
            FROM bits)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM told""",
}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
