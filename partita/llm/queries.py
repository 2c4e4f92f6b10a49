"""The problems' queries and, where SQL can express them on whole tables, their SQL for DuckDB."""

from __future__ import annotations

from partita.llm import bpe, cutoff, mix, neardup, packing, ranking, reading, splits
from partita.plans.corpus import _sha
from partita.tables import clean_source_sql

QUERIES = {
    "p1_found": mix.p1_found, "p1_mix": mix.p1_mix, "p1_blocks": mix.p1_blocks,
    "p2_found": cutoff.p2_found, "p2_cutoffs": cutoff.p2_cutoffs, "p2_buckets": cutoff.p2_buckets,
    "p4_found": splits.p4_found, "p4_splits": splits.p4_splits,
    "p5_found": ranking.p5_found, "p5_ranking": ranking.p5_ranking,
    "p6_found": neardup.p6_found, "p6_groups": neardup.p6_groups,
    "p7_ids": bpe.p7_ids,
    "p8_found": packing.p8_found, "p8_packed": packing.p8_packed, "p8_fill": packing.p8_fill,
    "p9_found": reading.p9_found, "p9_levels": reading.p9_levels, "p9_profile": reading.p9_profile,
}

_SIZE = "CASE WHEN {c} IS NULL OR isnan({c}::DOUBLE) OR {c} < 0 OR {c}::DOUBLE = 'infinity'::DOUBLE THEN 0.0::DOUBLE ELSE {c}::DOUBLE END"

_FILES = f"""files AS (
  SELECT path, min({clean_source_sql()}) AS source, max({_SIZE.format(c="n_notes")}) AS n_notes, max({_SIZE.format(c="duration_seconds")}) AS duration_seconds
  FROM manifest WHERE path IS NOT NULL GROUP BY path)"""

_SCORED = f"""files AS (
  SELECT path, min({clean_source_sql()}) AS source, max(quality) AS quality, arg_max(q_bucket, quality) AS q_bucket
  FROM quality_scores WHERE path IS NOT NULL AND quality IS NOT NULL AND NOT isnan(quality) GROUP BY path),
t AS (SELECT {clean_source_sql("source", "''")} AS source, max(keep_fraction) AS keep_fraction FROM keep_targets GROUP BY 1),
w AS (SELECT path, source, quality, q_bucket, keep_fraction, count(*) OVER (PARTITION BY source) AS n,
        count(*) OVER (PARTITION BY source ORDER BY quality DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above
      FROM files JOIN t USING (source)),
c AS (SELECT source, keep_fraction, n, max(quality) AS cutoff FROM w WHERE above >= keep_fraction * n GROUP BY ALL),
kept AS (SELECT w.* FROM w JOIN c USING (source) WHERE quality >= cutoff)"""

_PIECES = r"""WITH RECURSIVE m AS (SELECT pair_id, unnest([prompt_path, part_path]) AS path FROM pair_meta WHERE pair_id <> ''),
      e AS (SELECT DISTINCT pair_id, CASE WHEN regexp_extract(lower(path), '/raw/([^/]+)/', 1) <> '' THEN regexp_extract(lower(path), '/raw/([^/]+)/', 1) || '/' || regexp_extract(regexp_extract(lower(path), '([^/]*)$', 1), '^([\p{L}\p{N}]*)', 1) ELSE '=' || lower(path) END AS piece
            FROM m WHERE path IS NOT NULL),
      star AS (SELECT pair_id, min(pair_id) OVER (PARTITION BY piece) AS low FROM e),
      link AS (SELECT pair_id AS a, low AS b FROM star UNION SELECT low, pair_id FROM star),
      reach AS (SELECT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
      voted AS (SELECT DISTINCT pair_id FROM labels WHERE pair_id <> '')"""

ORACLE = {
    "p1_found": f"""WITH {_FILES},
      long AS (SELECT source, 'n_notes' AS size_unit, n_notes AS size FROM files UNION ALL SELECT source, 'duration_seconds', duration_seconds FROM files),
      tot AS (SELECT size_unit, sum(size) AS total FROM long GROUP BY 1), src AS (SELECT size_unit, source, sum(size) AS size FROM long GROUP BY 1, 2)
      SELECT mix_id, t.source FROM mix_targets t JOIN tot USING (size_unit) LEFT JOIN src ON src.size_unit = t.size_unit AND src.source = lower(trim(t.source))
      WHERE target_share * size_ratio * total > max_repeats * coalesce(size, 0)""",
    "p2_found": f"WITH {_SCORED} SELECT path FROM kept",
    "p2_cutoffs": f"WITH {_SCORED} SELECT source, keep_fraction, n, cutoff, (SELECT count(*) FROM kept WHERE kept.source = c.source) AS kept FROM c",
    "p2_buckets": f"WITH {_SCORED} SELECT source, q_bucket, count(*) AS kept FROM kept GROUP BY 1, 2",
    "p4_found": f"""{_PIECES}
      SELECT a AS pair_id, min(b) AS first_pair_id FROM reach WHERE a IN (SELECT pair_id FROM voted) AND b IN (SELECT pair_id FROM voted)
      GROUP BY a HAVING count(DISTINCT b) > 1""",
    "p4_splits": f"""{_PIECES}, co AS (SELECT a AS pair_id, min(b) AS component FROM reach GROUP BY a),
      x AS (SELECT 'pair' AS kind, pair_id AS id, coalesce(component, pair_id) AS component FROM voted LEFT JOIN co USING (pair_id)
        UNION ALL SELECT 'file', path, min(component) FROM m JOIN co USING (pair_id) WHERE path IS NOT NULL GROUP BY path)
      SELECT kind, id, component, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.9 + 0.05 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, {_sha("component || ':7'")} / 1e6::DOUBLE AS u FROM x)""",
    "p6_found": """WITH f AS (SELECT path, pitches FROM (SELECT path, list_filter(pitches, lambda p: p IS NOT NULL) AS pitches FROM file_notes WHERE path IS NOT NULL) WHERE len(pitches) > 6),
      s AS (SELECT path, list_transform(range(1, len(pitches)), lambda i: pitches[i + 1] - pitches[i]) AS s FROM f),
      g AS (SELECT DISTINCT path, unnest(list_transform(range(1, len(s) - 4), lambda i: s[i:i + 5])) AS r FROM s),
      n AS (SELECT path, count(*) AS n FROM g GROUP BY path HAVING count(*) >= 64),
      h AS (SELECT g.path, g.r, n.n FROM g JOIN n USING (path))
      SELECT a.path AS path_1, b.path AS path_2 FROM h a JOIN h b ON a.r = b.r AND a.path < b.path
      GROUP BY a.path, b.path, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.65""",
    "p6_groups": """WITH RECURSIVE f AS (SELECT DISTINCT path, pitches FROM (SELECT path, list_filter(pitches, lambda p: p IS NOT NULL) AS pitches FROM file_notes WHERE path IS NOT NULL) WHERE len(pitches) > 6),
      s AS (SELECT path, list_transform(range(1, len(pitches)), lambda i: pitches[i + 1] - pitches[i]) AS s FROM f),
      g AS (SELECT path, r, count(*) AS c FROM (SELECT path, unnest(list_transform(range(1, len(s) - 4), lambda i: s[i:i + 5])) AS r FROM s) GROUP BY path, r),
      n AS (SELECT path, sum(c)::BIGINT AS w, list({'r': r, 'c': c} ORDER BY r) AS runs FROM g GROUP BY path HAVING count(*) >= 64),
      cls AS (SELECT path, w, min(path) OVER (PARTITION BY runs) AS class_id FROM n),
      h AS (SELECT path AS k, r, c, w FROM g JOIN cls USING (path) WHERE path = class_id),
      link AS (SELECT a.k AS a, b.k AS b FROM h a JOIN h b ON a.r = b.r AND a.k <> b.k GROUP BY a.k, b.k, a.w, b.w HAVING sum(least(a.c, b.c)) / (a.w + b.w - sum(least(a.c, b.c))) >= 0.65),
      reach AS (SELECT DISTINCT class_id AS a, class_id AS b FROM cls UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
      low AS (SELECT a, min(b) AS "group" FROM reach GROUP BY a), deg AS (SELECT a, count(*)::INTEGER AS links FROM link GROUP BY a)
      SELECT path, class_id, coalesce(links, 0)::BIGINT AS links, "group" FROM cls JOIN low ON low.a = class_id LEFT JOIN deg ON deg.a = class_id""",
}
