"""SQL of the contract queries that another engine can answer on whole tables."""

from __future__ import annotations

import re

from .mixing import CAP, BLOCK, SEED, SHARD_ROWS, SHARD_WORDS, WEIGHTS
from .packing import BUCKETS, BUDGET, SHARD
from .packing import SEED as PACKING_SEED
from .secrets import BASE, LEAST, RULES

_SIZE = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)"


def _digits(key: str, at: int) -> str:
    """15 hexadecimal digits of ``key`` as a number."""
    return f"CAST('0x' || substr({key}, {at}, 15) AS BIGINT)"


#: Every 50-byte string of every text, its smallest document, and the runs of what is not first.
REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  -- pieces of 1024 starts each
  SELECT r, doc_id, n, base, substr(h, 2 * base + 1, 2146) AS part
  FROM (SELECT *, length(h) // 2 AS n, unnest(range(0, length(h) // 2, 1024)) AS base FROM d)
), p AS (
  SELECT r, doc_id, base + o AS pos, substr(part, 2 * o + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, least(1024, n - 49 - base))) AS o FROM c)
), f AS (
  SELECT s, min(doc_id) AS first FROM p GROUP BY s
), hit AS (
  SELECT r, pos, pos > lag(pos) OVER (PARTITION BY r ORDER BY pos) + 50 AS apart
  FROM p JOIN f USING (s) WHERE doc_id > first
), run AS (
  SELECT r, min(pos) AS a, max(pos) + 50 AS z
  FROM (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS g FROM hit)
  GROUP BY r, g
), gap AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM run
  UNION ALL
  SELECT d.r, coalesce(max(run.z), 0), any_value(length(h) // 2) FROM d LEFT JOIN run USING (r) GROUP BY d.r
), kept AS (
  SELECT gap.r, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS k
  FROM gap JOIN d USING (r) GROUP BY gap.r
), lost AS (
  SELECT r, sum(z - a) AS n, count(*) AS runs FROM run GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN lost USING (r)
"""

#: Least padding by recursion over the number of buckets; batches in the order of md5 keys.
PACKING = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_SIZE} AS n_tokens, {_digits(f"md5('{PACKING_SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, ''))", 1)} AS k
  FROM documents
), h AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY n_tokens) - 1 AS j, n_tokens AS top,
    sum(count(*)) OVER w AS c, sum(count(*) * n_tokens) OVER w AS s
  FROM d GROUP BY n_tokens WINDOW w AS (ORDER BY n_tokens ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT -1, 0, 0, 0
), b AS (
  SELECT 1 AS used, j, c, s, top * c - s AS cost, -1 AS before FROM h
  UNION ALL
  SELECT used + 1, j, c, s, least.cost, least.before FROM (
    SELECT b.used, h.j, h.c, h.s,
      min({{'cost': b.cost + h.top * (h.c - b.c) - (h.s - b.s), 'before': b.j}}) AS least
    FROM b JOIN h ON b.j < h.j OR (h.j = -1 AND b.j = -1)
    WHERE b.used < least({BUCKETS}, (SELECT max(j) + 1 FROM h))
    GROUP BY b.used, h.j, h.c, h.s)
), path AS (
  SELECT used, j, before FROM b
  WHERE j = (SELECT max(j) FROM h) AND used = (SELECT max(used) FROM b) AND j >= 0
  UNION ALL
  SELECT b.used, b.j, b.before FROM path JOIN b ON b.used = path.used - 1 AND b.j = path.before AND path.before >= 0
), top AS (
  SELECT row_number() OVER (ORDER BY top) - 1 AS bucket, top, coalesce(lag(top) OVER (ORDER BY top), -1) AS under
  FROM path JOIN h USING (j)
), placed AS (
  SELECT *, count(*) OVER (PARTITION BY bucket) AS held FROM d JOIN top ON n_tokens > under AND n_tokens <= top
), sharded AS (
  SELECT *, k % greatest(1, CAST(ceil(held / {SHARD}.0) AS BIGINT)) AS shard, greatest(1, {BUDGET} // greatest(1, top)) AS size FROM placed
), turned AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY k, n_tokens) - 1 AS turn FROM sharded
)
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(top AS BIGINT) AS padded_to,
  CAST(top - n_tokens AS BIGINT) AS padding, bucket || '-' || shard || '-' || (turn // size) AS batch_id, CAST(turn % size AS INTEGER) AS slot
FROM turned
"""

#: Targets by capped shares in the order of size by weight, seats by sorted quotients, arcs by md5 keys.
MIXING = f"""
WITH d AS (
  SELECT doc_id, source, {_SIZE} AS size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid, sum(size) AS size, count(*) AS n FROM d GROUP BY source
), w AS (
  SELECT *, list_extract({list(WEIGHTS)}, CAST(sid % {len(WEIGHTS)} AS INTEGER) + 1) AS weight FROM s
), o AS (
  SELECT *, sum(weight) OVER later AS weights,
    sum(size) OVER () - {CAP} * coalesce(sum(size) OVER earlier, 0) AS left_
  FROM w WINDOW later AS (ORDER BY size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    earlier AS (ORDER BY size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT *, sum(CASE WHEN left_ * weight / weights > {CAP} * size THEN 0 ELSE 1 END) OVER (ORDER BY size / weight, sid ROWS UNBOUNDED PRECEDING) = 0 AS full_ FROM o
), g AS (
  SELECT *, CASE WHEN full_ THEN {CAP} * size ELSE max(CASE WHEN full_ THEN NULL ELSE left_ END) OVER () * weight / max(CASE WHEN full_ THEN NULL ELSE weights END) OVER () END AS target FROM e
), seat AS (
  SELECT sid, row_number() OVER (ORDER BY target / (2 * a + 1) DESC, sid, a) AS place, round_even(sum_ / {BLOCK}, 0) AS total
  FROM (SELECT sid, target, sum(target) OVER () AS sum_, unnest(range(0, CAST(floor({CAP} * size / {BLOCK}) AS BIGINT))) AS a FROM g) q
), seats AS (
  SELECT sid, count(*) AS seats FROM seat WHERE place <= total GROUP BY sid
), plan AS (
  SELECT g.*, coalesce(seats, 0) AS seats, greatest(1, CAST(ceil(size / {SHARD_WORDS}.0) AS BIGINT), CAST(ceil(n / {SHARD_ROWS}.0) AS BIGINT)) AS shards
  FROM g LEFT JOIN seats USING (sid)
), dealt AS (
  SELECT d.doc_id, d.size, d.key, plan.sid, plan.size AS source_size, plan.target, plan.seats, {_digits("key", 1)} % plan.shards AS shard
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), sums AS (
  SELECT sid, shard, sum(size) AS shard_size, any_value(seats) AS seats FROM dealt GROUP BY sid, shard
), place AS (
  SELECT sid, shard, seats, row_number() OVER (PARTITION BY sid ORDER BY shard_size / (2 * a + 1) DESC, shard, a) AS place
  FROM (SELECT *, unnest(range(0, CAST(floor({CAP} * shard_size / {BLOCK}) AS BIGINT))) AS a FROM sums) q
), quota AS (
  SELECT sums.sid, sums.shard, shard_size, greatest(shard_size, 1) AS ring, {BLOCK} * count(place) AS quota,
    {_digits(f"md5('{SEED}|' || sums.sid || '|' || sums.shard)", 1)} % greatest(shard_size, 1) AS arc
  FROM sums LEFT JOIN place ON sums.sid = place.sid AND sums.shard = place.shard AND place.place <= place.seats
  GROUP BY sums.sid, sums.shard, shard_size
), laid AS (
  SELECT *, quota % ring AS rest, sum(size) OVER (PARTITION BY sid, shard ORDER BY {_digits("key", 16)}, doc_id, size ROWS UNBOUNDED PRECEDING) AS till
  FROM dealt JOIN quota USING (sid, shard)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST((quota // ring) * size + greatest(least(least(arc + rest, ring), till) - greatest(arc, till - size), 0)
    + greatest(least(greatest(arc + rest - ring, 0), till) - (till - size), 0) AS BIGINT) AS taken
FROM laid
"""


#: Every inner product in double precision; of a repeated id the smallest vector.
NEAREST = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
  GROUP BY vec_id
), size AS (
  SELECT len(e) AS d FROM v GROUP BY len(e) ORDER BY count(*) DESC, d LIMIT 1
), w AS (
  SELECT v.* FROM v JOIN size ON len(e) = d
), scored AS (
  SELECT q.vec_id AS query_id, w.vec_id, list_inner_product(q.e, w.e) AS score
  FROM w q JOIN w ON q.vec_id % 20 = 0 AND q.vec_id <> w.vec_id
)
SELECT query_id, CAST(row_number() OVER by_score AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW by_score AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER by_score <= 20
"""


def _pattern(rule) -> str:
    """Letters of a rule in either case are written out: case folding would also match letters outside ASCII."""
    if not rule.any_case:
        return rule.pattern
    names, rest = re.fullmatch(r"(\(.*?\))(.*)", rule.pattern).groups()
    return re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", names) + rest


def _scan() -> str:
    """Matches are put between marks; what stands before a piece gives its place."""
    rules = []
    for i, rule in enumerate(RULES):
        pattern = _pattern(rule).replace("'", "''")
        held = f"length(regexp_extract(piece, '{pattern}', 2)) >= 12" if rule.any_case else f"length(piece) >= {LEAST[rule.kind]}"
        rules.append(f"""SELECT r, '{rule.kind}' AS kind, {i} AS rule, a, a + length(piece) AS z FROM (
    SELECT r, piece, i, coalesce(sum(length(piece)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
    FROM (SELECT r, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
      FROM (SELECT r, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS pieces FROM d))
  ) WHERE i % 2 = 0 AND {held}""")
    base = f"kind IN {BASE}"
    union = "\n  UNION ALL\n  ".join(rules)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents
), hit AS (
  {union}
), line AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rule) FILTER ({base}) AS base,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rule, z) AS spans
  FROM (SELECT r, kind, rule, CAST(a AS BIGINT) AS a, CAST(z AS BIGINT) AS z FROM hit) GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN line USING (r)
"""


SQL = {"op3_repeats": REPEATS, "op4_nearest": NEAREST, "op5_packing": PACKING, "op7_secrets": _scan(), "op9_mixing": MIXING}
