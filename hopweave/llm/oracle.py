"""SQL for those operators that SQL can say, for a database that runs it over the same tables."""

from __future__ import annotations

from hopweave.llm.common import WORD
from hopweave.llm.mixing import MOST
from hopweave.llm.quality import POLICIES, RULES, SYMBOLS, mask_of

_LENGTH = "length(d.t) - length(regexp_replace(d.t, '[{}]', '', 'g'))"
_FAILED = " + ".join(f"CASE WHEN {fails} THEN {1 << bit}::BIGINT ELSE 0 END" for bit, (_, fails) in enumerate(RULES))

OP1 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) x(k) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY r),
m AS (SELECT d.doc_id, len(d.w) AS n_words, length(regexp_replace(d.t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  {_LENGTH.format(SYMBOLS)} AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines,
  {_LENGTH.format("A-Z")} AS n_capitals, {_LENGTH.format("!")} AS n_exclamations, {_LENGTH.format("A-Za-z")} AS n_letters
  FROM d LEFT JOIN ln ON ln.r = d.r LEFT JOIN cov ON cov.r = d.r),
f AS (SELECT *, {_FAILED} AS failed FROM m)
SELECT *, (failed & {mask_of(POLICIES["v1"])}) <> 0 AS base_failed, (failed & {mask_of(tuple({*POLICIES["v1"], *POLICIES["v2"]}))}) = 0 AS kept, 'v2' AS policy FROM f
"""

OP4 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
  (('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w FROM s),
r AS (SELECT *, sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER q, 0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS left_w, row_number() OVER (ORDER BY source_size / w, source IS NULL, source) AS place FROM w
  WINDOW q AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, min(place) FILTER (left_::DOUBLE * w / left_w <= {MOST} * source_size) OVER () AS first_ FROM r),
h AS (SELECT *, max(CASE WHEN place = first_ THEN left_::DOUBLE / left_w END) OVER () AS share FROM o),
t AS (SELECT source, source_size, CASE WHEN first_ IS NULL OR place < first_ THEN {MOST}.0::DOUBLE * source_size ELSE share * w END AS target FROM h),
z AS (SELECT d.source, d.size, floor(sqrt(d.size::DOUBLE) * 1024)::BIGINT AS r, any_value(t.target) AS target, sum(d.size)::BIGINT AS words, (count(*) * floor(sqrt(d.size::DOUBLE) * 1024)::BIGINT)::BIGINT AS roots FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source WHERE d.size > 0 GROUP BY d.source, d.size),
zc AS (SELECT *, (target - {MOST} * coalesce(sum(words) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / (sum(roots) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS c FROM z),
k AS (SELECT source, min_by(c, size) AS c FROM zc WHERE c * r <= {MOST} * size GROUP BY source),
e AS (SELECT row_number() OVER () AS id, d.*, t.source_size, t.target, CASE WHEN d.size > 0 THEN least({MOST}.0::DOUBLE, coalesce(k.c, 'infinity'::DOUBLE) * floor(sqrt(d.size::DOUBLE) * 1024)::BIGINT / d.size) ELSE 0.0::DOUBLE END AS copies FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source),
f AS (SELECT *, floor(copies + 1e-9::DOUBLE)::BIGINT AS whole, greatest(0.0::DOUBLE, copies - floor(copies + 1e-9::DOUBLE)) AS p, greatest(0.0::DOUBLE, target - sum(floor(copies + 1e-9::DOUBLE)::BIGINT * size) OVER (PARTITION BY source)) AS rest FROM e),
g AS (SELECT source, u, size, any_value(rest) AS rest, (u / (1 - u)) / (any_value(p) / (1 - any_value(p))) AS rank, sum(size)::BIGINT AS words FROM f WHERE size > 0 AND p > 1e-9::DOUBLE AND rest > 0 GROUP BY source, u, size),
n AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank, u ROWS UNBOUNDED PRECEDING) AS upto FROM g),
got AS (SELECT source, any_value(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS missing FROM n GROUP BY source),
l AS (SELECT n.source, arg_min({{'u': u, 'size': size}}, {{'a': abs(words - missing), 'b': rank, 'c': u}}) AS last_ FROM n JOIN got ON got.source IS NOT DISTINCT FROM n.source WHERE upto > rest AND abs(words - missing) < missing GROUP BY n.source)
SELECT f.doc_id, f.size, f.source_size, f.target, (f.size * (f.whole + CASE WHEN n.upto <= n.rest OR (l.last_.u = f.u AND l.last_.size = f.size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM f LEFT JOIN n ON n.source IS NOT DISTINCT FROM f.source AND n.u = f.u AND n.size = f.size AND f.p > 1e-9::DOUBLE LEFT JOIN l ON l.source IS NOT DISTINCT FROM f.source AND n.u IS NOT NULL
"""
