"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from tessera.functions.composition import COUNT_BITS, DIGITS, ELEMENTS, FULL_WIDTH, SUBSCRIPTS

_SYMBOLS = "".join(s for s, _ in ELEMENTS)
_PLAIN = f"regexp_extract(upper(regexp_replace(translate(formula, '{SUBSCRIPTS}{FULL_WIDTH}', '{DIGITS}{DIGITS}'), '[^\\p{{L}}\\p{{Nd}}()\\[\\]+.*]', '', 'g')), '^((?:[{_SYMBOLS}]\\d{{0,3}})+)$', 1)"
_OF_FORMULA = f"""CASE WHEN {_PLAIN} <> '' THEN list_sum(list_transform(regexp_extract_all({_PLAIN}, '[{_SYMBOLS}]\\d*'),
 lambda p: (CASE WHEN len(p) = 1 THEN 1 ELSE substr(p, 2, 3)::BIGINT END) << ({COUNT_BITS} * (instr('{_SYMBOLS}', p[1]) - 1))))::BIGINT END"""
_OF_NUMBERS = " + ".join(f"(len(list_filter(z, lambda x: x = {n}))::BIGINT << {COUNT_BITS * k})" for k, (_, n) in enumerate(ELEMENTS))

#: Common tables: compositions of molecules, builds, stored members with their composition, fill orders.
_BASE = f"""k AS (SELECT id, max(comp) AS comp FROM (SELECT id, CASE WHEN z IS NOT NULL THEN {_OF_NUMBERS} END AS comp FROM molecules WHERE id IS NOT NULL) GROUP BY id),
 b AS (SELECT * FROM split_build WHERE build_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY written_at) = 1),
 s AS (SELECT build_id, set_name, s.id, coalesce(any_value(k.comp), max({_OF_FORMULA.replace("formula", "s.formula")})) AS comp FROM split_set s LEFT JOIN k USING (id)
  WHERE build_id IS NOT NULL AND set_name IS NOT NULL AND s.id IS NOT NULL GROUP BY ALL),
 o AS (SELECT build_id, revision, seed, id, min(pos) AS pos FROM train_order WHERE build_id IS NOT NULL AND revision IS NOT NULL AND seed IS NOT NULL AND id IS NOT NULL AND pos IS NOT NULL GROUP BY ALL)"""
_QUOTAS = f"""{_BASE}, q AS (SELECT DISTINCT ON (quota_id) quota_id, quota.build_id, replace(set_name, '_q', '') AS set_name, {_OF_FORMULA} AS comp,
  greatest(coalesce(min_count, 0), coalesce(floor(target_share * CASE set_name WHEN 'test_unseen_q' THEN n_test_unseen_q WHEN 'test_familiar_q' THEN n_test_familiar_q END + 0.5), 0))::BIGINT AS wanted
  FROM quota LEFT JOIN b USING (build_id)),
 r AS (SELECT quota_id, build_id, wanted, (SELECT count(*) FROM s WHERE s.build_id = q.build_id AND s.set_name = q.set_name AND s.comp = q.comp) AS available FROM q)"""
_HELD = "SELECT build_id, {rank} AS r, {key} AS comp FROM (SELECT build_id, unnest({column}) AS formula FROM b)"

SQL = {
    "p1_found": f"WITH {_QUOTAS} SELECT quota_id FROM r WHERE wanted > available",
    "p1_report": f"WITH {_QUOTAS} SELECT quota_id, build_id, wanted, available, least(wanted, available) AS taken, wanted - least(wanted, available) AS deficit FROM r",
    "p2_found": f"""WITH {_BASE} SELECT DISTINCT a.build_id, a.revision, a.seed, t.n AS n_train, a.id FROM o a JOIN o p ON a.build_id = p.build_id AND a.seed = p.seed AND a.id = p.id AND p.revision = a.revision - 1
 JOIN (SELECT build_id, unnest(train_sizes) AS n FROM b) t ON t.build_id = a.build_id WHERE p.pos < t.n AND a.pos >= t.n""",
    "p3_found": f"""WITH {_BASE}, h AS (SELECT build_id, comp, max(r) AS r FROM ({_HELD.format(rank=1, key=_OF_FORMULA, column="dev_unseen_formulas")} UNION ALL {_HELD.format(rank=2, key=_OF_FORMULA, column="unseen_formulas")}) WHERE comp IS NOT NULL GROUP BY ALL),
 p AS (SELECT build_id, set_name, id, comp FROM s UNION ALL SELECT DISTINCT build_id, 'train_order', id, k.comp FROM o LEFT JOIN k USING (id)),
 m AS (SELECT build_id, id, max(comp) AS comp FROM p GROUP BY ALL)
 SELECT DISTINCT p.build_id, p.id FROM p JOIN m USING (build_id, id) LEFT JOIN h ON h.build_id = p.build_id AND h.comp = m.comp
 WHERE CASE h.r WHEN 2 THEN set_name NOT IN ('test_unseen', 'test_unseen_q') WHEN 1 THEN set_name <> 'dev_unseen' ELSE set_name NOT IN ('pool', 'dev', 'test_familiar', 'test_familiar_q', 'train_order') END""",
}
