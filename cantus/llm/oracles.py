"""DuckDB SQL of the operators that SQL can express; it runs over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS x FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS r FROM n UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.a),
c AS (SELECT a AS doc_id, min(r) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""

COLLAPSE = """WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS x
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text) ROWS UNBOUNDED PRECEDING)),
w AS (SELECT n, x, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY 1, 2)
SELECT conv_id, n AS n_turns, x AS rendered FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.x = w.x)"""


LINKS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
u AS (SELECT vec_id, list_transform(x, lambda y: y / n) AS x FROM v WHERE n > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.a),
c AS (SELECT a AS vec_id, min(r) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)"""

REPEATS = """WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS i FROM w WHERE len(h) >= 400), k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS x FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM k) WHERE n > 1),
b AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM d),
s AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b) GROUP BY doc_id, span),
p AS (SELECT w.doc_id, w.h, coalesce(list(s.s ORDER BY s.s) FILTER (s.s IS NOT NULL), []) AS a, coalesce(list(s.e ORDER BY s.s) FILTER (s.s IS NOT NULL), []) AS z FROM w LEFT JOIN s USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(list_sum(z), 0)::BIGINT - coalesce(list_sum(a), 0)::BIGINT AS n_removed, len(a)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(len(a) + 1), lambda j: substr(h, 2 * CASE WHEN j = 0 THEN 0 ELSE z[j] END + 1, 2 * (CASE WHEN j = len(a) THEN len(h) // 2 ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE z[j] END))), ''))) AS kept_sha256 FROM p"""


def _strength(n: str, bad: str) -> str:
    rate, count = f"(sum({bad}) / sum({n}))", "count(*)"
    within = f"({rate} * (1 - {rate}))"
    rho = f"((sum({bad} * {bad} / {n}) - sum({bad}) * {rate} - {within} * ({count} - 1)) / nullif({within} * (sum({n}) - sum({n} * {n}) / sum({n}) - ({count} - 1)), 0))"
    return f"coalesce(greatest(1.0, CASE WHEN {rho} > 0 THEN least(1000.0, (1 - {rho}) / {rho}) ELSE 1000.0 END), 1000.0)"


def hosts(rules: list[tuple[str, str]], suffixes: tuple[str, ...], worse: float, z: float = 1.645) -> str:
    def case(value: int) -> str:
        whens = []
        for rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
            name, slash, rest = rule[1].partition("/")
            whens.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN '{rule[value]}'")
        return f"CASE {' '.join(whens)} END"

    two = ", ".join(f"'{s}'" for s in suffixes)
    return f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT p.host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic = 0 AND quality = 1 THEN 0 END AS bad FROM (SELECT DISTINCT page_id, host FROM p) p LEFT JOIN labels ON doc_id = page_id),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b, string_split(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS s FROM o GROUP BY host),
h AS (SELECT host, n, b, CASE WHEN array_to_string(s[-2:], '.') IN ({two}) THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[-2:], '.') END AS domain, CASE WHEN array_to_string(s[-2:], '.') IN ({two}) THEN array_to_string(s[-2:], '.') ELSE s[-1] END AS suffix FROM h0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM h GROUP BY 1, 2), f AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY 1),
ks AS (SELECT sum(b) / sum(n) AS rate, {_strength('n', 'b')} AS k FROM f WHERE n > 0), kd AS (SELECT {_strength('n', 'b')} AS k FROM d WHERE n > 0), kh AS (SELECT {_strength('n', 'b')} AS k FROM h WHERE n > 0),
fr AS (SELECT suffix, (f.b + ks.k * ks.rate) / (f.n + ks.k) AS r FROM f, ks), dr AS (SELECT domain, suffix, (d.b + kd.k * fr.r) / (d.n + kd.k) AS r FROM d JOIN fr USING (suffix), kd),
ab AS (SELECT host, h.b + kh.k * dr.r AS a, h.n - h.b + kh.k * (1 - dr.r) AS b FROM h JOIN dr USING (domain, suffix), kh),
m AS (SELECT host, a / (a + b) AS mean, a + b AS n FROM ab),
v AS (SELECT host, mean, greatest(0, mean - {z} * sqrt(mean * (1 - mean) / (n + 1))) AS bound FROM m)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN bound > {worse} * (SELECT rate FROM ks) THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_rate FROM p LEFT JOIN v USING (host)"""


SUPERKMER = f"""WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20), k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM g),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS q FROM k) WHERE q > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
a AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), kept AS (SELECT a.* FROM a ANTI JOIN gone USING (doc_id, i)),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM kept GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)"""


_UNIT = "'[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'"
MIDDLE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, {_UNIT}) AS u, list_transform(range(4), lambda k: CAST('0x' || substr(x, 8 * k + 1, 8) AS BIGINT)) AS h FROM t),
f AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


SEARCH = f"""WITH d AS (SELECT doc_id, unnest({_terms('text')}) AS t FROM documents), tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY 1, 2),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t, docs),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_terms('text')}) AS t FROM benchmark)),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN l USING (doc_id), g GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
