"""DuckDB SQL of the queries that SQL can express. Training and file formats it cannot."""

from __future__ import annotations

from depweave.llm import mixing, quality_rules, secrets, urls

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets() -> str:
    keys = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"({keys})" + r"[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [("assign", assign, 2, 6), *secrets.KINDS[1:], ("lone", secrets.LONE, 0, 20)]
    found = " UNION ALL ".join(
        f"""SELECT rid, owner, repo, {i} AS k, '{kind}' AS kind, {least} AS least,
            unnest(range(1, len(regexp_extract_all(t, '{rx}')) + 1)) AS i,
            unnest(regexp_extract_all(t, '{rx}')) AS m, unnest(regexp_extract_all(t, '{rx}', {group})) AS value,
            unnest(list_slice(regexp_split_to_array(t, '{rx}'), 1, len(regexp_extract_all(t, '{rx}')))) AS gap
            FROM d WHERE regexp_matches(t, '{rx}')"""
        for i, (kind, rx, group, least) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source AS owner,
                  concat_ws('/', source, lang) AS repo FROM documents),
f AS ({found}),
s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, k ORDER BY i) AS stop FROM f),
good AS (SELECT rid, owner, repo, k, kind, value, stop - length(m) AS start, stop FROM s WHERE length(value) >= least),
base AS (SELECT * FROM good WHERE k < 3),
lone AS (SELECT * FROM good g WHERE k = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]')
         AND regexp_matches(value, '[A-Z]') AND NOT EXISTS (
             SELECT 1 FROM base b WHERE b.rid = g.rid AND b.start < g.stop AND g.start < b.stop)),
every AS (FROM base UNION ALL FROM lone),
spread AS (SELECT value, count(DISTINCT coalesce(owner, chr(1))) AS owners FROM every GROUP BY value),
judged AS (SELECT e.*, owners < {secrets.COPIED_OWNERS} AS live FROM every e JOIN spread USING (value)),
told AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
         string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, k) FILTER (k < 3) AS base,
         string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, k) FILTER (k < 3 OR live) AS spans
         FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN told USING (rid)"""


SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT rid, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM p),
earliest AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT rid, i FROM win JOIN earliest USING (h) WHERE doc_id > lo),
gone AS (SELECT DISTINCT rid, i + j AS pos FROM hit, range(0, 50) r(j)),
word AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM word ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""


DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
item AS (SELECT item_id, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
pattern AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s FROM item),
sizes AS (SELECT DISTINCT size FROM pattern),
place AS (SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, sizes WHERE len(w) >= size),
found AS (SELECT a.rid, a.i, a.size, p.item_id FROM place a JOIN pattern p
          ON p.size = a.size AND p.s = array_to_string(list_slice(a.w, a.i, a.i + a.size - 1), ' ')),
hit AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM found, range(0, 10) r(j) WHERE j < size GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM
          (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""


MIXING = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD})) AS size,
           md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS rank FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             list_value({", ".join(map(str, mixing.WEIGHTS))})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight
      FROM d GROUP BY source),
total AS (SELECT sum(source_size) * {mixing.SHARE}::DOUBLE AS budget FROM s),
level(round, lam, capped) AS (
    SELECT 0, (SELECT budget FROM total) / (SELECT sum(weight) FROM s), -1::BIGINT
    UNION ALL
    SELECT round + 1,
           (SELECT (any_value(budget) - coalesce(sum(source_size * 2) FILTER (weight * lam > source_size * 2), 0))
                   / sum(weight) FILTER (weight * lam <= source_size * 2) FROM s, total),
           (SELECT count(*) FILTER (weight * lam > source_size * 2) FROM s)
    FROM level WHERE capped <> (SELECT count(*) FILTER (weight * lam > source_size * 2) FROM s) AND round < 10000),
final AS (SELECT arg_max(lam, round) AS lam FROM level),
target AS (SELECT source, source_size, least(weight * lam, source_size * 2::DOUBLE) AS target FROM s, final),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
queued AS (SELECT *, (upto + source_size * c) / target AS finish FROM q, range(0, 2) r(c) WHERE size > 0),
spent AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
          FROM queued),
taken AS (SELECT rid, sum(size)::BIGINT AS taken FROM spent, total WHERE used <= budget GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN taken USING (rid)"""


def _urls() -> str:
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [
        (f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules
    ]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    return rf"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {UPPER}, {LOWER}), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
c AS (SELECT *, CASE WHEN regexp_replace(host, '^(www|m)\.', '') <> '' THEN
             regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/$', '') END AS form FROM u),
listed AS (SELECT DISTINCT form FROM c WHERE regexp_matches(url, '[?&]ref=') AND form IS NOT NULL)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN l.form IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, l.form IS NOT NULL AS listed
FROM c LEFT JOIN listed l ON c.form = l.form"""


CHAT = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n,
                  count(*) OVER (PARTITION BY conv_id) AS length FROM conversations),
h AS (SELECT conv_id, n, length, md5(string_agg(md5(concat_ws('/', coalesce(turn::VARCHAR, 'none'), coalesce(role, 'none'),
             md5(coalesce(text, chr(1))))), '') OVER (PARTITION BY conv_id ORDER BY n)) AS prefix FROM t),
whole AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_logs FROM h WHERE n = length GROUP BY prefix, n),
kept AS (SELECT * FROM whole ANTI JOIN (SELECT prefix, n FROM h WHERE n < length) USING (prefix, n))
SELECT k.conv_id, k.n AS n_turns, k.n_logs,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.n) AS rendered
FROM kept k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL"""


def _rules() -> str:
    steps = {
        "symbols": "least(floor(n_symbols * 1000 / greatest(word_chars, 1)), 1000)",
        "dup_lines": "least(floor(n_dup_lines * 1000 / greatest(n_lines, 1)), 1000)",
        "repeats": "least(floor(n_repeat_words * 1000 / greatest(n_words, 1)), 1000)",
        "word_length": "least(floor(word_chars * 10 / greatest(n_words, 1)), 1000)",
    }
    each = " UNION ALL ".join(
        f"SELECT rid, lang, source, '{m}' AS metric, ({s})::BIGINT AS step FROM m WHERE n_words > 0" for m, s in steps.items()
    )

    qs = quality_rules.QUANTILES

    def quantiles(keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        picks = ", ".join(f"min(step) FILTER (100 * upto >= {p} * total) AS {q}" for q, p in qs.items())
        return (
            f"SELECT {by}, {picks}, max(total) AS total FROM "
            f"(SELECT {by}, step, sum(count(*)) OVER (PARTITION BY {by} ORDER BY step) AS upto, sum(count(*)) OVER (PARTITION BY {by}) AS total "
            f"FROM e GROUP BY {by}, step) GROUP BY {by}"
        )

    prior, reach = quality_rules.PRIOR, quality_rules.REACH

    def drawn(table: str, wider: str) -> str:
        return ", ".join(f"(({table}.{q} * {table}.total + {prior} * {wider}.{q}) // ({table}.total + {prior}))::BIGINT AS {q}" for q in qs)

    slack = " ".join(f"WHEN '{m}' THEN {x[0]}" for m, x in quality_rules.METRICS.items())
    low = ", ".join(f"'{m}'" for m, x in quality_rules.METRICS.items() if x[1])
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines FROM d),
win AS (SELECT rid, i, list_slice(w, i, i + 7) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(0, 8) r(j) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM d JOIN l USING (rid) LEFT JOIN rep USING (rid)),
e AS ({each}),
own AS ({quantiles("lang, source")}), tongue AS ({quantiles("lang")}), whole AS ({quantiles("")}),
bylang AS (SELECT tongue.lang, tongue.metric, {drawn("tongue", "whole")} FROM tongue JOIN whole USING (metric)),
used AS (SELECT own.lang, own.source, own.metric, CASE own.metric {slack} END AS slack, {drawn("own", "bylang")}
         FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.metric = bylang.metric),
bad AS (SELECT DISTINCT e.rid FROM e JOIN used u ON e.lang IS NOT DISTINCT FROM u.lang AND e.source IS NOT DISTINCT FROM u.source AND e.metric = u.metric
        WHERE e.step > hi + greatest({reach} * (hi - mid), slack)
           OR (e.metric IN ({low}) AND e.step < lo - greatest({reach} * (mid - lo), slack)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.rid IS NULL AS kept
FROM m LEFT JOIN bad USING (rid)"""


JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {WORD}) AS w FROM documents),
p AS (SELECT rid, doc_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT rid, doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM p),
size AS (SELECT rid, doc_id, count(*) AS n FROM sh GROUP BY ALL),
pair AS (SELECT a.rid AS ra, b.rid AS rb, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM pair JOIN size x ON ra = x.rid JOIN size y ON rb = y.rid WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN coalesce(component_id, doc_id) ELSE doc_id END AS component_id
FROM d LEFT JOIN size USING (rid, doc_id) LEFT JOIN comp USING (doc_id)"""


INFILL = """
WITH d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || id) AS key FROM d),
h AS (SELECT *, len(u) AS n, ('0x' || key[1:8])::BIGINT AS h1, ('0x' || key[9:16])::BIGINT AS h2,
      ('0x' || key[17:24])::BIGINT AS h3, ('0x' || key[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS x FROM p),
i AS (SELECT *, instr(x, '<P>') AS ip, instr(x, '<S>') AS js, instr(x, '<M>') AS km FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(x) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN x
              WHEN 'psm' THEN x[ip + 3:js - 1] || x[km + 3:] || x[js + 3:km - 1]
              ELSE x[ip + 3:km - 1] || x[km + 3:] || x[js + 3:ip - 1] END) AS restored_sha256
FROM i"""


# crc32 is a fold over bytes with a table of 256 values, each eight steps of the reflected polynomial.
# Runs have only letters up to U+00FF: a letter above ASCII is the bytes 195 and its code less 64.
SPELLING = f"""
WITH RECURSIVE bits AS (SELECT i AS x, 0 AS k, i::BIGINT AS v FROM range(256) r(i)
  UNION ALL SELECT x, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY x) AS tab FROM bits WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
many AS (SELECT id, run, count(*) AS c FROM runs GROUP BY ALL),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))),
        lambda s, b: xor(s >> 8, tab[xor(s & 255, b) + 1]))) AS h FROM many, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || run[h % length(run) + 2:] ELSE run END AS word, sum(c)::BIGINT AS n
      FROM h GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
gap AS (SELECT word, n, i, left(word, i - 1) || '_' || word[i + 1:] AS hole, left(word, i - 1) || word[i + 1:] AS less FROM k),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM gap a JOIN gap b ON a.hole = b.hole AND a.word <> b.word
         UNION SELECT g.word, w.word, w.n FROM gap g JOIN w ON g.less = w.word
         UNION SELECT w.word, g.word, g.n FROM gap g JOIN w ON g.less = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form,
      CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
up AS (SELECT word, word AS top, 0 AS steps FROM f UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN f ON up.top = f.word WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(top, steps) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": _secrets(),
        "op2_substring_dedup": SUBSTRING,
        "op4_decontamination": DECONTAMINATION,
        "op5_source_mixing": MIXING,
        "op6_url_filter": _urls(),
        "op7_chat_formatting": CHAT,
        "op8_quality_rules": _rules(),
        "op9_ngram_jaccard_join": JOIN,
        "op11_fill_in_middle": INFILL,
        "op13_spelling_variants": SPELLING,
    }
