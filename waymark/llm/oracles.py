"""DuckDB SQL for the operators that SQL can express; built from the operators' own parameters."""

from __future__ import annotations

from waymark.llm import merkle, mixing, ngram_join, suffix_dedup, url_filter


def _weight(level: str, column: str) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in mixing.WEIGHTS[level].items())
    return f"CASE {whens} ELSE {mixing.DEFAULT_WEIGHT} END"


def _filled(name: str, source: str, parents: str) -> str:
    over = f"PARTITION BY {parents}" if parents else ""
    before = f"{over} ORDER BY cap // w, (cap % w) * 1000000 // w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""{name}0 AS (SELECT *, budget - coalesce(sum(cap) OVER ({before}), 0) AS lft, sum(w) OVER ({over}) - coalesce(sum(w) OVER ({before}), 0) AS wl FROM {source}),
{name}1 AS (SELECT *, CAST(cap AS HUGEINT) * wl <= CAST(lft AS HUGEINT) * w AS is_full FROM {name}0),
{name}2 AS (SELECT *, max(CASE WHEN NOT is_full THEN wl END) OVER ({over}) AS owl FROM {name}1),
{name}3 AS (SELECT *, max(CASE WHEN NOT is_full AND wl = owl THEN lft END) OVER ({over}) AS olft FROM {name}2),
{name} AS (SELECT *, CAST(CASE WHEN is_full THEN cap ELSE least(CAST(olft AS HUGEINT) * w // owl, cap) END AS BIGINT) AS granted FROM {name}3)"""


NUMBER = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
MIXING = f"""
WITH p AS (
  SELECT doc_id, lang, source, coalesce(lang, '-') AS l, coalesce(source, '-') AS s,
    'd' || CAST(CASE WHEN {NUMBER} = '' THEN 0 ELSE CAST({NUMBER} AS INTEGER) % 4 END AS VARCHAR) AS d,
    greatest(len(string_split_regex(trim(coalesce(text, '')), '[ \\t\\n\\r]+')), 1) AS n, md5(coalesce(text, '')) AS digest
  FROM documents
),
leaf AS (SELECT d, l, s, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * {mixing.EPOCHS} AS BIGINT) AS cap FROM p GROUP BY ALL),
total AS (SELECT CAST(least(floor(CAST(sum(tokens) AS DOUBLE) * {mixing.SHARE}), sum(cap)) AS BIGINT) AS b FROM leaf),
a AS (SELECT d, d AS name, CAST(sum(cap) AS BIGINT) AS cap, {_weight("domain", "d")} AS w, (SELECT b FROM total) AS budget FROM leaf GROUP BY d),
{_filled("dom", "a", "")},
b AS (SELECT x.d, l, l AS name, CAST(sum(x.cap) AS BIGINT) AS cap, {_weight("lang", "l")} AS w, any_value(dom.granted) AS budget FROM leaf x JOIN dom USING (d) GROUP BY x.d, l),
{_filled("lng", "b", "d")},
c AS (SELECT x.d, x.l, s, s AS name, x.cap, x.tokens, {_weight("source", "s")} AS w, lng.granted AS budget FROM leaf x JOIN lng ON lng.d = x.d AND lng.l = x.l),
{_filled("src", "c", "d, l")},
plan AS (SELECT d, l, s, granted // tokens AS e, granted % tokens AS rest FROM src),
keyed AS (SELECT p.*, e, rest, md5('{mixing.SEED}:' || CAST(e AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || digest) AS key FROM p JOIN plan USING (d, l, s)),
ranked AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY d, l, s ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM keyed)
SELECT doc_id, d AS domain, lang, source, n AS n_tokens, CAST(e + CASE WHEN so_far < rest THEN 1 ELSE 0 END AS BIGINT) AS n_copies FROM ranked
"""


def _rules() -> tuple[str, str]:
    order = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in order]
    return tuple("CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END" for i in (1, 0))


def _model() -> str:
    """CTEs m0 .. of probabilities by order, the last with the ratio of every slot."""
    n, top = url_filter.SYMBOLS, url_filter.ORDER
    parts = [f"grid AS (SELECT CAST(range AS BIGINT) AS slot, coalesce(g, 0) AS g, coalesce(b, 0) AS b, {1.0 / n}::DOUBLE AS gp, {1.0 / n}::DOUBLE AS bp FROM range({n ** (top + 1)}) LEFT JOIN counts ON slot = range)"]
    source = "grid"
    for k in range(top + 1):
        parts.append(f"e{k} AS (SELECT *, slot % {n ** (k + 1)} AS event, (slot // {n}) % {n**k} AS context FROM {source})")
        parts.append(f"f{k} AS (SELECT *, sum(g) OVER (PARTITION BY context, event) AS ge, sum(b) OVER (PARTITION BY context, event) AS be FROM e{k})")
        kinds = ", ".join(f"sum(CASE WHEN slot < {n ** (k + 1)} AND {c}e > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY context) AS {c}t, sum({c}) OVER (PARTITION BY context) AS {c}n" for c in "gb")
        parts.append(f"h{k} AS (SELECT *, {kinds} FROM f{k})")
        smooth = ", ".join(f"CASE WHEN {c}n > 0 THEN (CAST({c}e AS DOUBLE) + CAST({c}t AS DOUBLE) * {c}p) / CAST({c}n + {c}t AS DOUBLE) ELSE {c}p END AS {c}p" for c in "gb")
        parts.append(f"m{k} AS (SELECT slot, g, b, {smooth} FROM h{k})")
        source = f"m{k}"
    return ",\n".join([*parts, f"ratios AS (SELECT slot, round(ln(gp) - ln(bp), 9) AS ratio FROM m{top})"])


RULE, VERDICT = _rules()
FOLDED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(rest), '[^\\x00-\\x7F]', '~', 'g'), '[0-9]', '0', 'g'), '[?&=#]', '=', 'g'), '[^a-z0/.=]', '~', 'g')"
URL_FILTER = f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_transform(string_split({FOLDED}, ''), lambda c: strpos('abcdefghijklmnopqrstuvwxyz0/.=~', c)) AS raw FROM u),
w AS (SELECT *, CASE WHEN rest = '' THEN [] ELSE raw END AS signs, {RULE} AS rule, {VERDICT} AS rule_verdict FROM v),
x AS (SELECT *, list_transform(range(1, len(signs) + 1), lambda i: signs[i] {' '.join(f"+ CASE WHEN i > {k} THEN signs[i - {k}] ELSE 0 END * {url_filter.SYMBOLS**k}" for k in range(1, url_filter.ORDER + 1))}) AS slots,
  CAST('0x' || substr(md5(url), 1, 6) AS BIGINT) % {url_filter.HOLD_OUT} = 0 AS held FROM w),
counts AS (SELECT slot, count(*) FILTER (WHERE rule_verdict = 'allow') AS g, count(*) FILTER (WHERE rule_verdict <> 'allow') AS b FROM (SELECT unnest(slots) AS slot, rule_verdict FROM x WHERE rule IS NOT NULL AND NOT held) GROUP BY slot),
{_model()},
one AS (SELECT page_id, i, ratio FROM (SELECT page_id, unnest(slots) AS slot, unnest(range(1, len(slots) + 1)) AS i FROM x) JOIN ratios USING (slot)),
sums AS (SELECT page_id, list_sum(list(ratio ORDER BY i)) / count(*) AS mean FROM one GROUP BY page_id),
scored AS (SELECT x.*, round(greatest(least(coalesce(mean, 0), {url_filter.CLIP}), -{url_filter.CLIP}), 6) AS score FROM x LEFT JOIN sums USING (page_id)),
bins AS (SELECT CAST(floor(score / {url_filter.BIN}) AS BIGINT) AS bin, count(*) FILTER (WHERE rule_verdict = 'allow') AS g, count(*) FILTER (WHERE rule_verdict <> 'allow') AS b FROM scored WHERE rule IS NOT NULL AND held GROUP BY 1),
rated AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS lower, sum(g) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kept, coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped, sum(g) OVER () AS all_g, sum(b) OVER () AS all_b FROM bins),
best AS (SELECT (bin + coalesce(lower + 1, bin)) * {url_filter.BIN / 2} AS least FROM rated WHERE all_g > 0 AND all_b > 0 ORDER BY round(CAST(kept AS DOUBLE) / CAST(all_g AS DOUBLE) + CAST(stopped AS DOUBLE) / CAST(all_b AS DOUBLE), 9) DESC, abs(bin), bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN score >= coalesce((SELECT least FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict FROM scored
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w
  FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {ngram_join.WORDS - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {ngram_join.WORDS - 1}, least(len(w), 1)) + 1)) AS i FROM d)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {ngram_join.DENOMINATOR} * c >= {ngram_join.NUMERATOR} * (a.n + b.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least.y, d.doc_id)) AS component_id, CAST(coalesce(own.c, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.x = d.doc_id LEFT JOIN (SELECT x, count(*) AS c FROM links GROUP BY x) own ON own.x = d.doc_id
"""

LENGTH = suffix_dedup.LENGTH
SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH})),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w),
later AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM f WHERE r > 1),
runs AS (SELECT doc_id, min(i) AS low, max(i) + {LENGTH} AS high FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM later) GROUP BY doc_id, g),
ends AS (SELECT doc_id, low, high FROM runs UNION ALL SELECT doc_id, n, n FROM d),
kept AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low, high), 0) AS a, low AS b, high - low AS gone FROM ends)
SELECT d.doc_id, CAST(any_value(n) AS BIGINT) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (WHERE gone > 0) AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b))) AS kept_sha256
FROM d JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


def _leaves(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{merkle.PIECES}'), lambda p: md5(p))"


def _tree(leaves: str) -> str:
    marked = f"array_to_string(list_transform({leaves}, lambda d: d || CASE WHEN d[1] = '{merkle.SECTION_END}' THEN '|' ELSE ',' END), '')"
    bodies = f"CASE WHEN len({leaves}) = 0 THEN [] ELSE string_split({marked}[:-2], '|') END"
    return f"list_transform({bodies}, lambda b: [md5(b), b])"


def _names(sections: str) -> str:
    return f"list_transform({sections}, lambda s: s[1])"


def _fingerprint(names: str, branches: str) -> str:
    """The root over the sections' digests, then the branches."""
    tags = f"array_to_string(list_transform({branches}, lambda n: n[1:16]), ',')"
    return f"md5(array_to_string({names}, ',')) || CASE WHEN len({branches}) > 0 THEN '|' || {tags} ELSE '' END"


def _fewer(level: str, column: str) -> str:
    """Groups of branches where these are more than 16."""
    return f"CASE WHEN len({level}) > 16 THEN {_names(_tree(level))} ELSE {level} END AS {column}"


def _likeness(other: str) -> str:
    return f"""SELECT doc_id, sum(least(a.c, b.c)) AS both FROM (SELECT doc_id, leaf, count(*) AS c FROM (SELECT doc_id, unnest(l) AS leaf FROM le) GROUP BY ALL) a
  JOIN (SELECT doc_id, leaf, count(*) AS c FROM (SELECT doc_id, unnest({other}) AS leaf FROM le) GROUP BY ALL) b USING (doc_id, leaf) GROUP BY doc_id"""


def _near(text: str, leaves: str, both: str) -> str:
    return f"CASE WHEN x = {text} THEN 1.0::DOUBLE WHEN len(l) = 0 OR len({leaves}) = 0 THEN 0.0::DOUBLE ELSE CAST(2 * coalesce({both}, 0) AS DOUBLE) / CAST(len(l) + len({leaves}) AS DOUBLE) END"


MERKLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x, lead(doc_id) OVER (ORDER BY doc_id DESC) AS next_id FROM documents),
e AS MATERIALIZED (SELECT d.doc_id, d.x, f.x AS y, substr(d.x, 1, length(d.x) - length(d.x) // 2) || substr(f.x, 1, length(d.x) // 2) AS z FROM d JOIN d f ON f.doc_id = coalesce(d.next_id, (SELECT max(doc_id) FROM d))),
le AS MATERIALIZED (SELECT *, {_leaves("x")} AS l, {_leaves("y")} AS m, {_leaves("z")} AS o FROM e),
trees AS MATERIALIZED (SELECT doc_id, {_names(_tree("l"))} AS t, {_names(_tree("o"))} AS v FROM le),
t2 AS MATERIALIZED (SELECT *, {_fewer("t", "t2")}, {_fewer("v", "v2")} FROM trees),
t3 AS MATERIALIZED (SELECT *, {_fewer("t2", "t3")}, {_fewer("v2", "v3")} FROM t2),
t4 AS MATERIALIZED (SELECT *, {_fewer("t3", "t4")}, {_fewer("v3", "v4")} FROM t3),
p AS MATERIALIZED ({_likeness("o")}), q AS MATERIALIZED ({_likeness("m")})
SELECT le.doc_id, CAST(length(x) AS BIGINT) AS n_chars, sha256(z) AS edited_sha256, {_fingerprint("t", "t4")} AS fingerprint, {_fingerprint("v", "v4")} AS edited_fingerprint,
  {_near("z", "o", "p.both")} AS near_edited, {_near("y", "m", "q.both")} AS near_next
FROM le JOIN t4 USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""


#: Words, pieces and counts of phrases as the contract has them.
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
PHRASES = f"""
WITH pieces AS (SELECT lang, s, row_number() OVER () AS pid FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLDED}, '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents)),
lists AS (SELECT lang, pid, list_filter(string_split_regex(s, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
words AS (SELECT lang, pid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM lists),
rows5 AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM words WINDOW o AS (PARTITION BY pid ORDER BY i)),
f AS (
  SELECT lang, w1 AS phrase, 1 AS k, count(*) AS a FROM rows5 GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM rows5 WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM rows5 WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4, count(*) FROM rows5 WHERE w4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, 5, count(*) FROM rows5 WHERE w5 IS NOT NULL GROUP BY ALL
),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cand AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 100),
spans AS (SELECT lang, ws, k, a, i, unnest(range(i + 1, least(k, i + k - 2) + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM cand WHERE k >= 3)),
inside AS (SELECT lang, array_to_string(list_slice(ws, i, j), ' ') AS phrase, max(a) AS longer FROM spans WHERE j - i + 1 < k GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT lang, phrase, a, c, array_to_string(list_slice(ws, 1, c), ' ') AS head, array_to_string(list_slice(ws, c + 1, k), ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, n, CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail JOIN total ON total.lang = cuts.lang
),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least_cut)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def _vector_codes() -> str:
    near = lambda books: f"SELECT x.rid, x.p, min(((x.c1 - b.c1) * (x.c1 - b.c1) + (x.c2 - b.c2) * (x.c2 - b.c2) + (x.c3 - b.c3) * (x.c3 - b.c3) + (x.c4 - b.c4) * (x.c4 - b.c4)) * 64 + b.e) AS k FROM parts x JOIN {books} b ON b.p = x.p GROUP BY x.rid, x.p"
    down = lambda c: f"coalesce((m.s{c} - ((m.s{c} % m.n) + m.n) % m.n) // m.n, b.c{c}) AS c{c}"
    ctes = []
    for i in (1, 2):
        ctes.append(f"near{i} AS ({near(f'book{i - 1}')})")
        ctes.append(f"mean{i} AS (SELECT p, k % 64 AS e, count(*) AS n, {', '.join(f'CAST(sum(c{c}) AS BIGINT) AS s{c}' for c in (1, 2, 3, 4))} FROM near{i} JOIN parts USING (rid, p) GROUP BY p, k % 64)")
        ctes.append(f"book{i} AS (SELECT b.p, b.e, {', '.join(map(down, (1, 2, 3, 4)))} FROM book{i - 1} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e)")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
parts AS (SELECT rid, vec_id, p, z[4 * p + 1] AS c1, z[4 * p + 2] AS c2, z[4 * p + 3] AS c3, z[4 * p + 4] AS c4 FROM v, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, e, c1, c2, c3, c4 FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64),
{", ".join(ctes)},
last AS ({near("book2")}),
coded AS (SELECT rid, string_agg(printf('%02x', k % 64), '' ORDER BY p) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM last GROUP BY rid),
labels_ AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN v USING (rid) GROUP BY label),
digest AS (SELECT sha256(string_agg(CAST(c1 AS VARCHAR) || ',' || CAST(c2 AS VARCHAR) || ',' || CAST(c3 AS VARCHAR) || ',' || CAST(c4 AS VARCHAR), ',' ORDER BY p, e)) AS d FROM book2)
SELECT vec_id, code, error, label_error, (SELECT d FROM digest) AS codebooks_sha256 FROM coded JOIN v USING (rid) JOIN labels_ ON labels_.label IS NOT DISTINCT FROM v.label
"""


VECTOR_CODES = _vector_codes()
_LISTED = f"list_filter(string_split_regex({_FOLDED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_LISTED} AS ws FROM documents),
items AS (SELECT item_id, {_LISTED} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + 9), ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
words AS (SELECT rid, len(ws) AS total, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
ten AS (SELECT rid, total, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o, lead(w, 8) OVER o, lead(w, 9) OVER o] AS t FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
sized AS (SELECT rid, i, n, array_to_string(list_slice(t, 1, n), ' ') AS g FROM ten, (SELECT DISTINCT n FROM wins) WHERE i + n - 1 <= total),
hits AS (SELECT DISTINCT rid, i, n, item_id FROM sized JOIN wins USING (n, g)),
counted AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counted USING (rid) LEFT JOIN named USING (rid)
"""
