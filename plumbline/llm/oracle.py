"""SQL for another engine with the results of the operators that SQL can express."""

from __future__ import annotations

from . import line_dedup as lines
from . import quality_rules as rules
from . import variants

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _line_dedup() -> str:
    fields = range(lines.FIELDS)
    tail = f"greatest(n - {lines.DEPTH}, 0)"
    cut = lambda i: f"CAST(floor({tail} * {i} / {lines.FIELDS}) AS INTEGER)"
    size = lambda i: f"({cut(i + 1)} - {cut(i)})"
    field = lambda i: f"array_to_string(tokens[{lines.DEPTH + 1} + {cut(i)}:{lines.DEPTH} + {cut(i + 1)}], ' ')"
    bit = lambda i: f"mask & {1 << i} <> 0"
    agreed = " + ".join(f"CASE WHEN {bit(i)} THEN {size(i)} ELSE 0 END" for i in fields)
    enough = f"least(n, {lines.DEPTH}) + agreed >= {lines.SIMILAR} * n AND 2 * agreed > {tail}"
    values = ", ".join(f"CASE WHEN {bit(i)} THEN f{i} END AS k{i}" for i in fields)
    keys = ", ".join(f"k{i}" for i in fields)
    return rf"""
WITH cut AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents),
token AS (
  SELECT doc_id, line, line_no,
         list_transform({_WORDS.format("line")},
           lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{lines.VARIABLE}' ELSE t END) AS tokens
  FROM cut),
keyed AS MATERIALIZED (
  SELECT doc_id, line_no, len(tokens) AS n, len(tokens) || ' ' || array_to_string(tokens[1:{lines.DEPTH}], ' ') AS leaf,
         array_to_string(tokens, ' ') AS masked, tokens
  FROM token WHERE len(tokens) > 0),
several AS (SELECT leaf FROM keyed GROUP BY leaf HAVING min(masked) <> max(masked)),
line AS MATERIALIZED (
  SELECT *, {", ".join(f"{field(i)} AS f{i}" for i in fields)} FROM (
    SELECT leaf, masked, first(doc_id ORDER BY doc_id, line_no) AS doc, first(line_no ORDER BY doc_id, line_no) AS line_no,
           any_value(n) AS n, any_value(tokens) AS tokens
    FROM keyed JOIN several USING (leaf) GROUP BY leaf, masked)),
sets AS MATERIALIZED (
  SELECT n, mask FROM (SELECT n, mask, {agreed} AS agreed FROM (SELECT DISTINCT n FROM line), (SELECT range AS mask FROM range({2**lines.FIELDS})))
  WHERE {enough}),
grouped AS (SELECT leaf, masked, doc, mask, {values} FROM line JOIN sets USING (n)),
by_fields AS (
  SELECT leaf, masked, doc, min(doc) OVER (PARTITION BY leaf, mask, {keys}) AS target FROM grouped),
by_tokens AS (
  SELECT leaf, masked, target FROM (
    SELECT x.leaf, x.masked, h.doc AS target, x.n,
           len(list_filter(list_zip(x.tokens, h.tokens), lambda p: p[1] = p[2])) - least(x.n, {lines.DEPTH}) AS agreed
    FROM line x JOIN line h ON x.leaf = h.leaf AND h.doc < x.doc)
  WHERE {enough}),
near AS (
  SELECT leaf, masked, min(target) AS target FROM (
    SELECT leaf, masked, target FROM by_fields WHERE target < doc UNION ALL SELECT * FROM by_tokens) GROUP BY leaf, masked),
exact AS (SELECT leaf, masked, min(doc_id) AS target FROM keyed GROUP BY leaf, masked),
dropped AS (
  SELECT DISTINCT doc_id, line_no FROM keyed JOIN exact e USING (leaf, masked) LEFT JOIN near r USING (leaf, masked)
  WHERE doc_id <> coalesce(r.target, e.target))
SELECT c.doc_id, coalesce(string_agg(c.line, chr(10) ORDER BY c.line_no) FILTER (WHERE d.doc_id IS NULL), '') AS text,
       count(*) AS n_lines, count(d.doc_id) AS n_dropped
FROM cut c LEFT JOIN dropped d ON c.doc_id = d.doc_id AND c.line_no = d.line_no
GROUP BY c.doc_id
"""


def _chat_format() -> str:
    return r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10)
         || regexp_replace(text, '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g') || '<|im_end|>' || chr(10)))::BIGINT
         AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _quality_rules() -> str:
    names = [r[0] for r in rules.RULES]
    start = rules.start()

    def vote(rule: tuple) -> str:
        name, measure, bad_below, good_from, good_to, bad_above = rule
        top, bottom = measure.split(" / ")
        value = f"({top}::DOUBLE / nullif({bottom}, 0)::DOUBLE)"
        cases = [f"WHEN {value} IS NULL THEN 0"]
        if bad_below is not None:
            cases.append(f"WHEN {value} < {bad_below}::DOUBLE THEN -1")
        if bad_above is not None:
            cases.append(f"WHEN {value} > {bad_above}::DOUBLE THEN -1")
        cases.append(f"WHEN {value} >= {good_from}::DOUBLE AND {value} <= {good_to}::DOUBLE THEN 1")
        return f"CASE {' '.join(cases)} ELSE 0 END AS v_{name}"

    odds = "ln(m.good) - ln(1 - m.good)" + "".join(
        f" + CASE v_{n} WHEN 1 THEN ln(m.g_{n}) - ln(1 - m.b_{n}) WHEN -1 THEN ln(1 - m.g_{n}) - ln(m.b_{n}) ELSE 0 END"
        for n in names
    )
    share = lambda r, a, prior: f"(coalesce(sum({r}), 0) + {prior[0]}) / (coalesce(sum({a}), 0) + {sum(prior)})"
    learn = ", ".join(
        f"{share(f'CASE v_{n} WHEN 1 THEN g END', f'CASE WHEN v_{n} <> 0 THEN g END', rules.ON_GOOD)} AS g_{n}, "
        f"{share(f'CASE v_{n} WHEN -1 THEN b END', f'CASE WHEN v_{n} <> 0 THEN b END', rules.ON_BAD)} AS b_{n}"
        for n in names
    )
    first = ", ".join(f"{g}::DOUBLE AS g_{n}, {b}::DOUBLE AS b_{n}" for n, g, b in zip(names, start.right_good, start.right_bad))
    steps = [f"m0 AS MATERIALIZED (SELECT {start.good}::DOUBLE AS good, {first})"]
    total = rules.PRIOR_GOOD + rules.PRIOR_BAD
    for i in range(rules.ITERATIONS):
        steps.append(f"""m{i + 1} AS MATERIALIZED (
  SELECT (coalesce(sum(g), 0) + {rules.PRIOR_GOOD}) / (coalesce(sum(g + b), 0) + {total}) AS good, {learn}
  FROM (SELECT *, n * p AS g, n - n * p AS b FROM (SELECT v.*, 1 / (1 + exp(-({odds}))) AS p FROM patterns v, m{i} m)))""")
    votes = ", ".join(f"v_{n}" for n in names)
    return rf"""
WITH word AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
window_hit AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times
  FROM (SELECT doc_id, i, words[i:i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM word))),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM window_hit, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS n_alnum,
         length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
         length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_shouts,
         length(text) - length(replace(text, '.', '')) AS n_ends, len(list_distinct(words)) AS n_distinct_words
  FROM word LEFT JOIN repeated USING (doc_id)),
voted AS MATERIALIZED (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         {", ".join(vote(r) for r in rules.RULES)} FROM measured),
patterns AS MATERIALIZED (SELECT {votes}, count(*) AS n FROM voted GROUP BY {votes}),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM voted, m{rules.ITERATIONS} m
"""


def _warc() -> str:
    return """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS stored FROM pages)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          (('0x' || substr(sha1(html), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)) & 31)::INTEGER + 1, 1), '' ORDER BY i)
        FROM range(32) t(i)) AS payload_digest,
       CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM page
"""


def _checksum(strings: str) -> str:
    """Steps of a recursive query that end in ``checksum`` (s, h): the CRC-32 of every s of ``strings``."""
    return f"""
bits(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS of FROM bits WHERE k = 8),
string AS MATERIALIZED (SELECT DISTINCT s, hex(encode(s)) AS bytes FROM ({strings})),
state(s, bytes, i, c) AS (
  SELECT s, bytes, 0, 4294967295 FROM string
  UNION ALL
  SELECT s, bytes, i + 1, xor(c >> 8, of[(xor(c, ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT) & 255) + 1])
  FROM state, crc WHERE 2 * i < length(bytes)),
checksum AS MATERIALIZED (SELECT s, xor(c, 4294967295) AS h FROM state WHERE 2 * i = length(bytes))"""


def _spelling_variants() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE run AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w
    FROM documents) GROUP BY doc_id, w),
{_checksum("SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM run")},
altered AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word
  FROM run JOIN checksum ON s = coalesce(doc_id::VARCHAR, '') || ':' || w),
vocabulary AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= {variants.LEAST_LETTERS}
  GROUP BY word HAVING sum(n) >= {variants.LEAST_TIMES}),
less AS MATERIALIZED (
  SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS k FROM vocabulary)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN vocabulary b ON a.rest = b.word),
best AS MATERIALIZED (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT v.word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= {variants.MORE} * n THEN other END AS form,
         CASE WHEN other_n >= {variants.MORE} * n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word),
chain(word, top) AS (
  SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.top = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.top AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.top WHERE e.form IS NULL
"""


def _periodic_runs() -> str:
    return rf"""
WITH RECURSIVE {_checksum("SELECT doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL")},
word AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
sized AS (
  SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS changed, h // 10 AS g
  FROM word LEFT JOIN checksum ON s = doc_id::VARCHAR),
placed AS (
  SELECT *, CASE WHEN changed THEN g % n ELSE n END AS a, CASE WHEN changed THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM sized),
pos AS MATERIALIZED (
  SELECT doc_id, n, i, words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
match AS (
  SELECT y.doc_id, y.i, y.i - x.i AS lag
  FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i AND 4 * (y.i - x.i) <= y.n),
stretch AS (
  SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS part FROM match)
  GROUP BY doc_id, lag, part HAVING count(*) + lag >= greatest(6, 4 * lag)),
run AS MATERIALIZED (
  SELECT doc_id, start, length, lag AS period FROM stretch a WHERE NOT EXISTS (
    SELECT 1 FROM stretch b WHERE b.doc_id = a.doc_id AND b.lag < a.lag
       AND b.start <= a.start AND b.start + b.length >= a.start + a.length)),
dropped AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM run)),
kept AS (
  SELECT p.doc_id, string_agg(w, ' ' ORDER BY p.i) AS collapsed
  FROM pos p LEFT JOIN dropped d ON p.doc_id = d.doc_id AND p.i = d.i WHERE d.i IS NULL GROUP BY p.doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id),
best AS (
  SELECT a.* FROM run a WHERE NOT EXISTS (
    SELECT 1 FROM run b WHERE b.doc_id = a.doc_id
       AND (b.length * a.period > a.length * b.period
         OR b.length * a.period = a.length * b.period AND (b.start < a.start OR b.start = a.start AND b.period < a.period))))
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def all_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": _line_dedup(),
        "op4_chat_format": _chat_format(),
        "op5_quality_rules": _quality_rules(),
        "op8_warc": _warc(),
        "op11_spelling_variants": _spelling_variants(),
        "op13_periodic_runs": _periodic_runs(),
    }
