"""DuckDB SQL with the results of the queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = r"[\x20\x09-\x0D]"

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 16, 15))::BIGINT AS h2 FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
k AS (SELECT *, weight * (CASE WHEN row_number() OVER (ORDER BY source NULLS LAST) % 2 = 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END) AS k0 FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM c),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT (SELECT level FROM l WHERE level * weight <= cap ORDER BY k LIMIT 1) AS level),
t AS (SELECT source, source_size, weight, k0, least(cap, coalesce(f.level * weight, cap))::DOUBLE AS target FROM l, f),
p AS (SELECT doc_id, size, source_size, target, weight, k0, 2 * weight - k0 AS k2,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, h2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken,
             start / target * 2 * weight AS wanted, (k0 + weight) / 2 AS half FROM p),
v AS (SELECT *, least(wanted, half) AS a, greatest(wanted - half, 0) AS b FROM u)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round((2 * a / (k0 + sqrt(greatest(k0 * k0 + 2 * (weight - k0) * a, 0))) + 2 * b / (weight + sqrt(greatest(weight * weight + 2 * (k2 - weight) * b, 0)))) / 2, 9) END AS position FROM v
"""

ORACLES["op2_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN k ON k.a = w.doc_id
"""

ORACLES["op6_line_dedup"] = rf"""
WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{_SPACES}+', ''), '{_SPACES}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""

ORACLES["op7_chat"] = r"""
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS LAST, role, text) AS turns FROM conversations GROUP BY conv_id),
d AS (SELECT turns, min(conv_id) AS conv_id, count(*)::BIGINT AS copies FROM c GROUP BY turns),
m AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.turns[1] = d.turns[1] AND len(b.turns) > len(d.turns) AND b.turns[1:len(d.turns)] = d.turns))
SELECT conv_id, len(turns)::BIGINT AS n_turns, copies,
       list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>'), 'string_agg', chr(10)) AS rendered FROM m
"""

_RATES = {"symbols": "(1000 * n_symbols) // greatest(word_chars, 1)", "dup_lines": "(1000 * n_dup_lines) // greatest(n_words, 1)", "repeats": "(1000 * n_repeat_words) // greatest(n_words, 1)"}
_TOLD = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS rate FROM rated WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)" for r in _RATES)
_CUTS = ", ".join(f"min(rate) FILTER (WHERE rule = '{r}') AS max_{r}" for r in _RATES)
_OVER = " OR ".join(f"{r} > max_{r}" for r in _RATES)

ORACLES["op10_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY doc_id),
counted AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACES}+', '', 'g'))::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                    - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
                   coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                  CASE WHEN n_words < 200 THEN 0 WHEN n_words < 1000 THEN 1 ELSE 2 END AS stratum FROM counted),
rated AS (SELECT *, {', '.join(f'{e} AS {r}' for r, e in _RATES.items())} FROM judged WHERE NOT base_failed),
hist AS (SELECT stratum, rule, rate, count(*) AS n FROM ({_TOLD}) GROUP BY ALL),
placed AS (SELECT *, sum(n) OVER (PARTITION BY stratum, rule ORDER BY rate DESC) - n AS above, sum(n) OVER (PARTITION BY stratum, rule) AS total FROM hist),
levels AS (SELECT stratum, level, {_CUTS} FROM placed, (SELECT unnest([1, 2, 5, 10, 20, 50, 100, 200]) AS level) WHERE above * 1000 <= level * total GROUP BY ALL),
seen AS (SELECT l.*, count(*)::BIGINT AS n, count_if({_OVER})::BIGINT AS k FROM rated r JOIN levels l USING (stratum) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
safe AS (SELECT * FROM seen WHERE k < n * 0.01::DOUBLE AND 0.05::DOUBLE / 24 >=
         list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01::DOUBLE) + (n - i) * ln(0.99::DOUBLE))))),
cuts AS (SELECT * FROM safe QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY level DESC) = 1)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed, NOT j.base_failed AND NOT coalesce({_OVER}, false) AS kept
FROM (SELECT *, {', '.join(f'{e} AS {r}' for r, e in _RATES.items())} FROM judged) j LEFT JOIN cuts USING (stratum)
"""


def _lloyd(r: int) -> str:
    """Codebooks after one more round: b{r} from b{r - 1}, each part with its nearest entry in a{r}."""
    return f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := {_APART.format(a='p.v', b='b.v')}, e := b.e)) AS best FROM p JOIN b{r - 1} b USING (part) GROUP BY vec_id, part),
s{r} AS (SELECT part, e, k, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT p.part, a.best.e AS e, unnest(range(1, len(p.v) + 1)) AS k, unnest(p.v) AS x FROM p JOIN a{r} a USING (vec_id, part)) GROUP BY 1, 2, 3),
b{r} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.v, b.v) AS v FROM b{r - 1} b LEFT JOIN (SELECT part, e, list(x ORDER BY k) AS v FROM s{r} GROUP BY 1, 2) n ON n.part = b.part AND n.e = b.e)"""


_APART = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
ORACLES["op11_vector_codes"] = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS v FROM k, range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{_lloyd(1)}, {_lloyd(2)},
a3 AS (SELECT vec_id, part, min(struct_pack(d := {_APART.format(a='p.v', b='b.v')}, e := b.e)) AS best FROM p JOIN b2 b USING (part) GROUP BY vec_id, part),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a3 GROUP BY vec_id)
SELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, i)) FROM (SELECT part, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM b2)) AS codebooks_sha256
FROM k JOIN coded ON coded.vec_id = k.vec_id
"""
