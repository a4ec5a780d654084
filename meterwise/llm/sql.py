"""DuckDB SQL with the rows of the queries it can express.

Not here: language-model and toxicity scores, token counts, leaks within an edit budget. Those are
tested against brute force, the tokenizer library or held-out rows.
"""

from __future__ import annotations

from meterwise.llm import choices, lines, mixing, quality, repeats, urls

_BLANK = r"[\x09-\x0D\x20]+"
_WORD = r"[^\x09-\x0D\x20]"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '')"


def _quality() -> str:
    failures = []
    for rule in quality.RULES:
        bounds = [f"({rule.ratio}) < {rule.low}"] * (rule.low is not None) + [f"({rule.ratio}) > {rule.high}"] * (rule.high is not None)
        failures.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{rule.name}' END")
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS body, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents
), windows AS (
  SELECT rn, words, unnest(range(len(words) - {quality.WINDOW - 1})) AS i FROM base WHERE len(words) >= {quality.WINDOW}
), repeated AS (
  SELECT rn, i FROM (
    SELECT rn, i, count(*) OVER (PARTITION BY rn, words[i + 1 : i + {quality.WINDOW}]) AS n FROM windows
  ) WHERE n > 1
), covered AS (
  SELECT rn, CAST(sum(gap) AS BIGINT) AS n FROM (
    SELECT rn, least({quality.WINDOW}, coalesce(lead(i) OVER (PARTITION BY rn ORDER BY i) - i, {quality.WINDOW})) AS gap FROM repeated
  ) GROUP BY rn
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '{quality.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         len(list_filter(words, lambda x: list_contains([{stops}], lower(x)))) AS n_stop_words,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*([-*•|>]|[0-9]+[.)])'))) AS n_list_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered USING (rn)
), judged AS (
  SELECT *, n_words < {quality.BASE_MIN_WORDS} OR 100 * n_repeat_words > {quality.BASE_MAX_REPEATED_PERCENT} * n_words AS base_failed,
         concat_ws(',', {', '.join(failures)}) AS failed_rules
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged"""


def _mixing() -> str:
    m, seed = choices.MIX, choices.MIX["seed"]
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    weights = ", ".join(f"({quoted(d)}, {quoted(lang)}, {quoted(s)}, {w})" for d, lang, s, w in choices.MIX_WEIGHTS)
    tree, ctes = list(mixing.TREE), []
    for k in range(len(tree)):
        path, above = tree[: k + 1], tree[:k]
        on = " AND ".join([f"w.{c} = l.{c}" for c in path] + [f"w.{c} IS NULL" for c in tree[k + 1 :]])
        group = ", ".join(f"l.{c}" for c in path)
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        order = f"({part} ORDER BY most / weight NULLS LAST, {tree[k]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        budget = f"share{k - 1}.share" if k else "budget.budget"
        source = f"JOIN share{k - 1} USING ({', '.join(above)})" if k else "CROSS JOIN budget"
        ctes.append(f"""own{k} AS (
  SELECT {group}, CAST(sum(l.tokens) AS BIGINT) * {m['max_epochs']} AS most, coalesce(max(w.weight), 1) AS weight
  FROM leaves l LEFT JOIN weights w ON {on} GROUP BY {group}
), node{k} AS (SELECT own{k}.*, CAST({budget} AS BIGINT) AS budget FROM own{k} {source}
), full{k} AS (
  SELECT *, CASE WHEN weight > 0 AND most * (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER {order}, 0))
                      <= weight * (budget - coalesce(sum(most) OVER {order}, 0)) THEN 1 ELSE 0 END AS filled
  FROM node{k}
), share{k} AS (
  SELECT {', '.join(path)}, CAST(CASE WHEN filled = 1 THEN most ELSE coalesce(
           (weight * (budget - sum(filled * most) OVER ({part}))) // nullif(sum((1 - filled) * weight) OVER ({part}), 0), 0) END AS BIGINT) AS share
  FROM full{k}
)""")
    return f"""
WITH weights(domain, language, source, weight) AS (VALUES {weights}
), rows AS (
  SELECT doc_id, coalesce('d' || (TRY_CAST(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS BIGINT) // 5), '') AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS source, CAST(len({_WORDS}) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows GROUP BY ALL
), budget AS (SELECT CAST(sum(tokens) * {m['budget_percent']} // 100 AS BIGINT) AS budget FROM leaves
), {', '.join(ctes)}, plan AS (
  SELECT domain, language, source, coalesce(share // nullif(tokens, 0), 0) AS whole, coalesce(share % nullif(tokens, 0), 0) AS rest
  FROM leaves JOIN share2 USING (domain, language, source)
), drawn AS (SELECT * FROM rows JOIN plan USING (domain, language, source)
), partial AS (
  SELECT *, sum(n_tokens) OVER (
    PARTITION BY domain, language, source ORDER BY md5(concat_ws(':', '{seed}', whole, coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM drawn WHERE rest > 0
)
SELECT doc_id, domain, language, source, n_tokens, unnest(range(whole)) AS epoch FROM drawn WHERE whole > 0
UNION ALL
SELECT doc_id, domain, language, source, n_tokens, whole AS epoch FROM partial WHERE upto <= rest"""


def _lines() -> str:
    span = lines.SPAN
    later = ", ".join(f"lead(line, {k}) OVER (PARTITION BY rn ORDER BY place) AS line{k}" for k in range(1, span))
    names = ", ".join(["line", *(f"line{k}" for k in range(1, span))])
    return f"""
WITH base AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents
), parts AS (
  SELECT rn, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM base WHERE text IS NOT NULL
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY rn ORDER BY place) - 1 AS pos FROM parts WHERE regexp_matches(line, '{_WORD}')
), windows AS (SELECT rn, doc_id, pos, line, {later} FROM worded WHERE doc_id IS NOT NULL
), later AS (
  SELECT rn, pos FROM (
    SELECT rn, pos, row_number() OVER (PARTITION BY {names} ORDER BY doc_id, pos) AS nth FROM windows WHERE line{span - 1} IS NOT NULL
  ) WHERE nth > 1
), removed AS (SELECT DISTINCT rn, unnest(range(pos, pos + {span})) AS pos FROM later
), gone AS (SELECT worded.rn, worded.place FROM worded JOIN removed USING (rn, pos)
), left_over AS (
  SELECT rn, string_agg(line, chr(10) ORDER BY place) AS kept FROM parts ANTI JOIN gone USING (rn, place) GROUP BY rn
), counts AS (SELECT rn, count(*) AS n FROM worded GROUP BY rn
), losses AS (SELECT rn, count(*) AS n FROM gone GROUP BY rn
)
SELECT doc_id, coalesce(counts.n, 0) AS n_lines, coalesce(losses.n, 0) AS n_removed,
       CASE WHEN losses.n IS NULL THEN text ELSE coalesce(kept, '') END AS text
FROM base LEFT JOIN counts USING (rn) LEFT JOIN losses USING (rn) LEFT JOIN left_over USING (rn)"""


def _urls() -> str:
    levels = [f"s{k}" for k in range(1, urls.LEVELS + 1)]
    names = [f"t{k}" for k in range(1, urls.LEVELS + 1)]
    shape = []
    for k, name in enumerate(levels, 1):
        cut = rf"regexp_replace(regexp_replace(coalesce(segments[{k}], ''), '[0-9a-fA-F]{{{{16,}}}}', '{{{{x}}}}', 'g'), '[0-9]+', '{{{{n}}}}', 'g')".replace("{{", "{").replace("}}", "}")
        shape.append(f"CASE WHEN len(segments) > {urls.LEVELS} THEN '**' ELSE {cut} END AS {name}" if k == urls.LEVELS else f"{cut} AS {name}")
    ctes = [f"tree0 AS (SELECT host, {', '.join(levels)}, n, labelled, bad FROM counted)"]
    for k, name in enumerate(levels, 1):
        above = ", ".join(["host", *names[: k - 1]])
        gap = "(CAST(b AS DOUBLE) * (CAST(al AS DOUBLE) - l) - (CAST(ab AS DOUBLE) - b) * l)"
        ctes.append(f"""branch{k} AS (
  SELECT {above}, {name}, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM tree{k - 1} GROUP BY ALL
), fold{k} AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY {above}) > {urls.WIDE} AND n * {urls.RARE} < sum(n) OVER (PARTITION BY {above})
                      AND NOT contains({name}, '{{') THEN '*' ELSE {name} END AS t
  FROM branch{k}
), grown{k} AS (
  SELECT {above}, t, sum(labelled) AS l, sum(bad) AS b FROM fold{k} GROUP BY ALL
), named{k} AS (
  SELECT {above}, t, CASE WHEN t = '' OR {gap} * {gap} * CAST(al AS DOUBLE) > {urls.ALIKE}::DOUBLE * l * (CAST(al AS DOUBLE) - l) * ab * (CAST(al AS DOUBLE) - ab)
                          THEN t ELSE '~' END AS {names[k - 1]}
  FROM (SELECT *, sum(l) OVER (PARTITION BY {above}) AS al, sum(b) OVER (PARTITION BY {above}) AS ab FROM grown{k})
), tree{k} AS (
  SELECT tree{k - 1}.*, {names[k - 1]} FROM tree{k - 1} JOIN fold{k} USING ({above}, {name}) JOIN named{k} USING ({above}, t)
)""")
    rule, action = "NULL", "NULL"
    for what, site, start in sorted(urls.RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{start}')"
        rule = f"CASE WHEN {fits} THEN '{site}{start}' ELSE {rule} END"
        action = f"CASE WHEN {fits} THEN '{what}' ELSE {action} END"
    text = " || ".join(f"CASE WHEN {t} = '' THEN '' ELSE '/' || {t} END" for t in names)
    located = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH places AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{located}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '{located}', 2) AS path
  FROM pages
), cut AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM places
), shaped AS (SELECT page_id, host, path, {', '.join(shape)} FROM cut
), known AS (
  SELECT doc_id AS key, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), counted AS (
  SELECT host, {', '.join(levels)}, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad
  FROM shaped LEFT JOIN known ON key = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(\\.html)?/?$', 1) AS BIGINT) GROUP BY ALL
), {', '.join(ctes)}, pure AS (
  SELECT host, {', '.join(names)}, CAST(sum(labelled) - sum(bad) + {urls.GOOD_PRIOR} AS DOUBLE) / (sum(labelled) + {urls.GOOD_PRIOR + urls.BAD_PRIOR}) AS purity
  FROM tree{len(levels)} GROUP BY ALL
), found AS (
  SELECT host, {', '.join(levels)}, {text} AS template, purity FROM tree{len(levels)} JOIN pure USING (host, {', '.join(names)})
)
SELECT page_id, host, path, {rule} AS rule, template, purity,
       coalesce({action}, CASE WHEN purity < {urls.MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict
FROM shaped JOIN found USING (host, {', '.join(levels)})"""


def _near_copies() -> str:
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _BLANK + "'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE worded AS (SELECT doc_id, {words} AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 3], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(greatest(1, len(words) - 2))) AS i FROM worded WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (SELECT x, y FROM sides UNION SELECT reach.x, sides.y FROM reach JOIN sides ON reach.y = sides.x
), least AS (SELECT x, min(y) AS y FROM reach GROUP BY 1
)
SELECT worded.doc_id, coalesce(n, 0) AS n_shingles, least(worded.doc_id, coalesce(y, worded.doc_id)) AS component_id,
       worded.doc_id <= coalesce(y, worded.doc_id) AS kept
FROM worded LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.x = worded.doc_id"""


def _repeats() -> str:
    span = repeats.SPAN
    return f"""
WITH base AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, {2 * span}) AS w FROM (SELECT doc_id, h, unnest(range(n - {span - 1})) AS p FROM base WHERE n >= {span})
), later AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < doc_id
), marked AS (
  SELECT *, CASE WHEN p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -{2 * span}) > {span} THEN 1 ELSE 0 END AS opens FROM later
), numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), spans AS (SELECT doc_id, run, min(p) AS a, max(p) + {span} AS b FROM numbered GROUP BY ALL
), gaps AS (
  SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM spans
), ends AS (SELECT doc_id, max(b) AS b, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY 1
), pieces AS (
  SELECT gaps.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) AS body FROM gaps JOIN base USING (doc_id) GROUP BY 1
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(ends.b, 0) + 1))) AS kept_sha256
FROM base LEFT JOIN ends USING (doc_id) LEFT JOIN pieces USING (doc_id)"""


def _prefixes() -> str:
    # crc32 bit by bit: a byte goes in before the first of eight shifts
    bits = "flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"""list_reduce(list_prepend(4294967295::BIGINT, {bits}),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1)))"""
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role,
         sha256(encode(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS hash,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '')) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), places AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, hash) AS place, hash, words FROM said
), plans AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor({crc}, 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM said)
), heads AS (SELECT plans.conv_id, place, hash, words FROM plans JOIN places ON places.conv_id = base WHERE place <= h
), taken AS (SELECT plans.conv_id, h, count(heads.place) AS n FROM plans LEFT JOIN heads USING (conv_id) GROUP BY 1, 2
), turns AS (
  SELECT * FROM heads UNION ALL SELECT conv_id, place - h + n, hash, words FROM places JOIN taken USING (conv_id) WHERE place > h
), paths AS (
  SELECT conv_id, place AS depth, words, md5(array_to_string(list(hash) OVER (PARTITION BY conv_id ORDER BY place), ',')) AS prefix FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM plans
), named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS name, max(depth) OVER (PARTITION BY conv_id) AS length FROM paths
), nodes AS (
  SELECT name, depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth) AS ends
  FROM named GROUP BY 1, 2
), placed AS (
  SELECT nodes.*, up.name AS parent FROM nodes LEFT JOIN named up ON up.conv_id = nodes.name AND up.depth = nodes.depth - 1
), children AS (SELECT parent AS name, depth - 1 AS depth, count(*) AS n FROM placed WHERE depth > 0 GROUP BY 1, 2
), totals AS (
  SELECT top.name, top.depth, sum(u.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes u LEFT JOIN children c ON c.name = u.name AND c.depth = u.depth
  JOIN named top ON top.conv_id = u.name AND top.depth <= u.depth
  GROUP BY 1, 2
)
SELECT p.name AS conv_id, CAST(p.depth AS BIGINT) AS depth, p.parent AS parent_conv_id, p.n_convs, coalesce(c.n, 0) AS n_children,
       t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM placed p JOIN totals t USING (name, depth) LEFT JOIN children c ON c.name = p.name AND c.depth = p.depth"""


SQL: dict[str, str] = {
    "op2_mix": _mixing(),
    "op3_quality_rules": _quality(),
    "op6_byte_repeats": _repeats(),
    "op8_url_filter": _urls(),
    "op9_near_copies": _near_copies(),
    "op10_line_dedup": _lines(),
    "op12_prefix_trie": _prefixes(),
}
