"""The contracts of the queries that SQL can express, as DuckDB SQL written from the contract alone.

Each takes the direct way (all windows, all pairs that share a shingle, all 100-byte strings) and is meant for small tables.
"""

from __future__ import annotations

from tidemark.llm import reputation, secrets

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every text as a word list, so that a match is an equality; for small tables.
_OP1_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[s:s + least(10, len(w)) - 1] AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, w[s:s + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, bw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Base32 of a SHA-1: each five hex digits are four letters.
_OP4_SQL = f"""WITH s AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM s GROUP BY 1)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('{_ALPHABET}', CAST((CAST('0x' || substr(d, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s JOIN f USING (d)"""

#: Texts as hex digits, cut into overlapping pieces first, as a substring far into a long text is slow.
_OP5_SQL = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
pieces AS (SELECT doc_id, n, o, substr(x, 2 * o + 1, 2198) AS y FROM (SELECT *, unnest(range(0, n, 1000)) AS o FROM t)),
strings AS (SELECT doc_id, o + i AS s, substr(y, 2 * i + 1, 200) AS h FROM (SELECT *, unnest(range(0, greatest(least(1000, n - o - 99), 0))) AS i FROM pieces)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM strings) WHERE k > 1),
opened AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS o FROM again),
numbered AS (SELECT doc_id, s, sum(o) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM opened),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, n, n FROM t),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM ends),
g AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b) AS kept FROM gaps JOIN t USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN g USING (doc_id)"""

_OP6_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)"""


def _op7() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(reputation.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h + p)}'" for v, h, p in longest) + " END"
    bare = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
    last = lambda k: f"array_to_string(list_slice(string_split({bare}, '.'), -{k}, -1), '.')"
    number = f"regexp_matches({bare}, '^([0-9]+\\.){{3}}[0-9]+$|^\\[')"
    long = f"regexp_matches({last(2)}, '^(ac|co|com|edu|gob|gov|go|gouv|ltd|me|mil|ne|net|nom|or|org|plc|sch)\\.[a-z]{{2}}$')"
    levels = f"CASE WHEN {number} THEN {bare} WHEN {long} THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {number} THEN '' WHEN {long} THEN {last(2)} ELSE {last(1)} END AS suffix"
    parts, above = [], "corpus"
    for level, up in (("suffix", "''"), ("domain", "suffix"), ("host", "domain")):
        parts.append(f"""c_{level} AS (SELECT c.*, alpha / (alpha + beta) AS m FROM (SELECT {level} AS name, {up} AS up, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2) c JOIN {above} a ON a.name = c.up),
k_{level} AS (SELECT coalesce(greatest(1.0, least(1000.0, (1 - rho) / nullif(greatest(rho, 0.0), 0))), 1000.0) AS k FROM (SELECT (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM c_{level})),
{level}_p AS (SELECT name, k * m + bad AS alpha, k * (1 - m) + n - bad AS beta FROM c_{level}, k_{level})""")
        above = f"{level}_p"
    bound = lambda p: f"(SELECT name, alpha / (alpha + beta) - {reputation.DEVIATIONS} * sqrt(alpha / (alpha + beta) * (1 - alpha / (alpha + beta)) / (alpha + beta + 1)) AS bound FROM {p})"
    joins = " ".join(f"LEFT JOIN {bound(p)} {key[0]}b ON {key[0]}b.name = {key}" for key, p in (("host", "host_p"), ("domain", "domain_p"), ("suffix", "suffix_p")))
    return f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
l AS (SELECT *, {levels} FROM u),
hosts AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(quality = 0 OR toxic = 1 AS INTEGER)) AS DOUBLE) AS bad FROM l JOIN labels ON doc_id = page_id WHERE host <> '' AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1, 2, 3),
corpus AS (SELECT '' AS name, coalesce(sum(bad), 0) + 0.5 AS alpha, coalesce(sum(n - bad), 0) + 1.0 AS beta FROM hosts),
{", ".join(parts)},
j AS (SELECT l.*, coalesce(hb.bound, db.bound, sb.bound, c.bound) AS bound FROM l {joins} CROSS JOIN {bound("corpus")} c)
SELECT page_id, host, path, {case(lambda v, r: r)} AS rule, coalesce({case(lambda v, r: v)}, CASE WHEN bound > {reputation.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bound FROM j"""


def _op9() -> str:
    anycase = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    assign = "(" + "|".join(map(anycase, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    base = (("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    rules = (*base, *secrets.EXTRA_RULES)
    found = " UNION ALL ".join(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS held FROM d" for rank, (kind, p, group, least) in enumerate(rules))
    upto = lambda column, to: f"coalesce(list_sum(list_transform({column}[1:{to}], lambda x: length(x))), 0)"
    joined = lambda condition: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE {condition}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({found})),
s AS (SELECT doc_id, rank, kind, CAST({upto("gaps", "i")} + {upto("hits", "i - 1")} AS BIGINT) AS a, CAST({upto("gaps", "i")} + {upto("hits", "i")} AS BIGINT) AS b FROM m WHERE length(held[i]) >= least)
SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in base)}, sha256({joined("rank < 3")}) AS base_sha256, {joined("rank IS NOT NULL")} AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


SQL = {"op1_decontamination": _OP1_SQL, "op4_warc": _OP4_SQL, "op5_repeats": _OP5_SQL, "op6_minhash": _OP6_SQL, "op7_urls": _op7(), "op9_secrets": _op9()}
