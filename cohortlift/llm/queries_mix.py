"""Registered queries of the operators that order, prove and mix a corpus."""

from __future__ import annotations

from cohortlift.llm.fim import middle_digest
from cohortlift.llm.merkle import tamper_report
from cohortlift.llm.mixing import mixing_report
from cohortlift.llm.registry import query, table


def part(h: str, i: int) -> str:
    return f"('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT"


@query(
    "op11_fill_in_middle",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    cuts AS (SELECT *, {part("h", 0)} % (n + 1) AS a, {part("h", 1)} % (n + 1) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {part("h", 2)} % 100 >= 90
        THEN 'plain' WHEN {part("h", 3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    pieces AS (SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, abs(a - b)) AS m,
      substr(t, greatest(a, b) + 1) AS s FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
    FROM pieces""",
)
def op11_fill_in_middle(spark, sf_dir):
    """Every document cut at two drawn code points, its middle moved behind its suffix."""
    return middle_digest(table(spark, sf_dir, "documents"))


def leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


def tree_sql(name: str, leaves: str) -> str:
    """CTEs over ``leaves`` (g, pos, n, node): every node of the trees, and every leaf's siblings."""
    return f"""{name} AS (SELECT g, 0 AS level, pos, n, node FROM {leaves} UNION ALL
      SELECT g, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {name}
      WHERE n > 1 GROUP BY g, level, pos // 2),
    {name}_proof AS MATERIALIZED (SELECT l.g, l.pos, string_agg(s.node, '' ORDER BY s.level) AS proof
      FROM {leaves} l JOIN {name} s ON s.g = l.g AND s.n > 1 AND s.pos // 2 = (l.pos >> (s.level + 1))
        AND s.pos <> (l.pos >> s.level) GROUP BY l.g, l.pos)"""


def fold_sql(name: str, tree: str, start: str) -> str:
    """CTE that folds every row of ``start`` (id, g, pos, n, node) up the tree."""
    return f"""{name} AS (SELECT id, g, 0 AS level, pos, n, node FROM {start} UNION ALL
      SELECT f.id, f.g, f.level + 1, f.pos // 2, (f.n + 1) // 2,
        sha256(CASE WHEN s.pos < f.pos THEN s.node ELSE '' END || f.node || CASE WHEN s.pos > f.pos THEN s.node ELSE '' END)
      FROM {name} f LEFT JOIN {tree} s ON s.g = f.g AND s.level = f.level AND s.pos = (CASE WHEN f.pos % 2 = 0 THEN f.pos + 1
        ELSE f.pos - 1 END) WHERE f.n > 1)"""


#: crc32 of a decimal id, bit by bit
CRC_SQL = """crc AS (SELECT id, key, 0 AS step, 4294967295::BIGINT AS c FROM rows WHERE key IS NOT NULL UNION ALL
      SELECT id, key, step + 1, list_reduce(list_prepend(xor(c, ascii(substr(key, step + 1, 1))::BIGINT), range(8)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
      FROM crc WHERE step < length(key))"""


@query(
    "op12_merkle_manifest",
    f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT *, row_number() OVER () AS id, doc_id::VARCHAR AS key,
        coalesce('=' || lang, '') AS g FROM documents),
    {CRC_SQL},
    hit AS (SELECT id FROM crc WHERE step = length(key) AND xor(c, 4294967295) % 7 = 0),
    hashed AS (SELECT id, doc_id, g, {leaf_sql("n_chars")} AS leaf, {leaf_sql("n_chars + 1")} AS changed FROM rows),
    leaves AS MATERIALIZED (SELECT id, doc_id, g, leaf AS node, changed, count(*) OVER (PARTITION BY g) AS n,
      row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos FROM hashed),
    {tree_sql("tree", "leaves")},
    groups AS MATERIALIZED (SELECT g AS own, '' AS g, node, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS pos
      FROM tree WHERE n = 1),
    {tree_sql("top", "groups")},
    start AS (SELECT id, g, pos, n, CASE WHEN id IN (SELECT id FROM hit) THEN changed ELSE node END AS node FROM leaves),
    {fold_sql("low", "tree", "start")},
    middle AS (SELECT low.id, groups.g, groups.pos, groups.n, low.node FROM low JOIN groups ON own = low.g WHERE low.n = 1),
    {fold_sql("high", "top", "middle")}
    SELECT l.doc_id, l.node AS leaf, groups.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root,
      sha256(coalesce(a.proof, '') || coalesce(b.proof, '')) AS proof_sha256, high.node AS folded_root,
      high.node = (SELECT node FROM top WHERE n = 1) AS verified
    FROM leaves l JOIN groups ON own = l.g JOIN high ON high.id = l.id AND high.n = 1
    LEFT JOIN tree_proof a ON a.g = l.g AND a.pos = l.pos LEFT JOIN top_proof b ON b.pos = groups.pos""",
)
def op12_merkle_manifest(spark, sf_dir):
    """Hash tree over every language's documents and over the languages, each row proved against it."""
    return tamper_report(table(spark, sf_dir, "documents"))


@query(
    "op13_source_mixing",
    r"""WITH d AS MATERIALIZED (SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS room FROM totals),
    placed AS (SELECT *, row_number() OVER (ORDER BY room / weight, source NULLS LAST) AS pos FROM weighed),
    shares AS MATERIALIZED (SELECT *, ((SELECT sum(source_size) FROM totals) - coalesce(sum(room) OVER earlier, 0))::HUGEINT AS rest,
      ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER earlier, 0))::HUGEINT AS heavy FROM placed
      WINDOW earlier AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    stop AS (SELECT * FROM shares WHERE room * heavy >= rest * weight ORDER BY pos LIMIT 1),
    rates AS (SELECT s.source, s.source_size, CASE WHEN s.pos < stop.pos THEN s.room::DOUBLE
      ELSE (stop.rest * s.weight)::DOUBLE / stop.heavy::DOUBLE END AS target FROM shares s, stop)
    SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN
      ('0x' || substr(md5('13:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate)
      THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM d JOIN rates ON rates.source IS NOT DISTINCT FROM d.source)""",
)
def op13_source_mixing(spark, sf_dir):
    """How many words of each document a mix takes whose sources stand in weights 1, 2, 3, ..."""
    return mixing_report(table(spark, sf_dir, "documents"))
