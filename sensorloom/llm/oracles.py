"""SQL for the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

from sensorloom.llm import mixing

_LOWER = (
    "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_SPACED = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
WHERE r <= 10
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_PLAIN}') AS w FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 13) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_PLAIN}') AS w FROM benchmark)
  WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',')) AS s
  FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""

CHAT_TREE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, 20 + 2 * length(role) + 2 * length(text) - length(regexp_replace(role, '[<\[\\]', '', 'g'))
            - length(regexp_replace(text, '[<\[\\]', '', 'g')) AS chars
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
         sum(chars) AS chars
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars,
       sha256(l) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

_SEATS = """
  SELECT {keys}, count(*) FILTER (place <= house) AS seats
  FROM (SELECT *, row_number() OVER ({group} ORDER BY votes / (2 * k + 1) DESC, {ties}) AS place
        FROM (SELECT {keys}, {house} AS house, {votes} AS votes, unnest(range(0, {most})) AS k
              FROM {table} WHERE {votes} > 0))
  GROUP BY {keys}"""

MIXTURE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size,
         md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, greatest(1, ceil(count(*) / {mixing.SHARD_ROWS}.0)) AS shards,
         row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][(r - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM s),
lv AS (
  SELECT *, sum(words) OVER () AS total,
         CAST(sum(words) OVER () - coalesce(sum(3 * words) OVER (ORDER BY 3 * words / weight, r
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY 3 * words / weight, r
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
t AS (SELECT *, least(CAST(3 * words AS DOUBLE), weight * max(level) OVER ()) AS target FROM lv),
p AS (
  SELECT d.*, t.r, t.words, t.target, t.total,
         CAST('0x' || substr(o, 1, 8) AS BIGINT) % CAST(shards AS BIGINT) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
sh AS (
  SELECT r, shard, CAST(sum(size) AS BIGINT) AS words,
         CAST(ceil(sum(size) / {mixing.BLOCK_WORDS}.0) AS BIGINT) AS blocks
  FROM p GROUP BY r, shard),
party AS (
  SELECT r, t.target, CAST(floor(t.total / {mixing.BLOCK_WORDS}.0 + 0.5) AS BIGINT) AS house, m.most
  FROM t JOIN (SELECT r, CAST(sum(3 * blocks) AS BIGINT) AS most FROM sh GROUP BY r) AS m USING (r)),
q AS ({_SEATS.format(keys='r', house='house', votes='target', most='most', table='party', group='', ties='r')}),
shq AS (SELECT sh.*, coalesce(q.seats, 0) AS quota FROM sh LEFT JOIN q USING (r)),
z AS ({_SEATS.format(keys='r, shard', house='quota', votes='words', most='3 * blocks', table='shq',
                     group='PARTITION BY r', ties='shard')}),
plan AS (
  SELECT sh.r, sh.shard, CASE WHEN blocks > 0 THEN coalesce(seats, 0) // blocks ELSE 0 END AS passes,
         CASE WHEN blocks > 0 THEN coalesce(seats, 0) % blocks ELSE 0 END * {mixing.BLOCK_WORDS} AS rest
  FROM sh LEFT JOIN z ON sh.r = z.r AND sh.shard = z.shard),
u AS (
  SELECT p.*, passes, rest, CAST(sum(size) OVER (PARTITION BY p.r, p.shard ORDER BY o, doc_id, size
           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until
  FROM p JOIN plan ON p.r = plan.r AND p.shard = plan.shard)
SELECT doc_id, size, words AS source_size, target,
       CAST(passes * size + greatest(0, least(until, rest) - (until - size)) AS BIGINT) AS taken
FROM u
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_SPACED}') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g
  FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS r ON s.doc_id = r.a
"""


def _turn_repair() -> str:
    """SQL for op11: the dynamic program backwards, one turn of every conversation in each step."""
    never, following = 1 << 40, (2, 2, 3, 2)
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    emitted = {2: "'user:'", 3: "'assistant:'"}

    def option(state: str, cost: str, letter: str, line: str | None = None) -> str:
        lines = f"{state}.r" if line is None else f"list_prepend({line}, {state}.r)"
        return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 'r': {lines}}}"

    def inserted(names: str) -> str:
        """Two rounds of insertions over states ``names`` 0 to 3."""
        first = [f"list_min([{names}{q}, {option(f'{names}{n}', '3', 'I', emitted[n])}])" for q, n in enumerate(following)]
        return ", ".join(f"{e} AS {names}{q}" for q, e in enumerate(first))

    def turn(q: int) -> str:
        late = "CASE WHEN t.kind = 3 THEN 3 ELSE 0 END"
        n = following[q]
        free = f"CASE WHEN t.kind IN (1, 2) THEN {never} ELSE {late} END"
        options = [option(f"p.x{q}", "4", "D"), option(f"p.x{n}", f"3 + {free}", "R", f"{emitted[n]} || t.text")]
        for (state, initial), after in kept.items():
            if state == q:
                options.append(
                    option(f"p.x{after}", f"CASE WHEN t.initial = '{initial}' THEN {free} ELSE {never} END", "K",
                           "t.role || ':' || t.text")
                )
        return f"list_min([{', '.join(options)}]) AS x{q}"

    def done(cost: int, letters: str, lines: str) -> str:
        return f"{{'c': CAST({cost} AS BIGINT), 'a': '{letters}', 'r': CAST({lines} AS VARCHAR[])}}"

    ends = (done(0, "", "[]"), done(6, "II", "['user:', 'assistant:']"), done(3, "I", "['assistant:']"), done(0, "", "[]"))
    crc = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      range(1, length(k) + 1), lambda i: [CAST(ord(substr(k, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
    return f"""
WITH RECURSIVE k AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
f AS (SELECT *, {crc} % 20 AS fate FROM k),
d AS (
  SELECT g, conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM f),
o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
         count(*) OVER (PARTITION BY g) AS n, substr(role, 1, 1) AS initial FROM d),
t AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_SPACED}') THEN 1
              WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS kind,
         lag(initial) OVER (PARTITION BY g ORDER BY i) AS earlier
  FROM o),
p AS (
  SELECT g, n AS i, {', '.join(f'{e} AS x{q}' for q, e in enumerate(ends))} FROM (SELECT DISTINCT g, n FROM t)
  UNION ALL
  SELECT g, i, {', '.join(f'x{q}' for q in range(4))} FROM (
    SELECT g, i, {inserted('x')} FROM (
      SELECT g, i, {inserted('x')} FROM (
        SELECT p.g, p.i - 1 AS i, {', '.join(turn(q) for q in range(4))}
        FROM p JOIN t ON t.g = p.g AND t.i = p.i)))),
c AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (kind = 1) AS blank, count(*) FILTER (kind = 2) AS duplicate,
         count(*) FILTER (kind = 3) AS truncated,
         count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM t GROUP BY g)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(x0.c, 0) AS cost, coalesce(x0.a, '') AS audit,
       sha256(coalesce(array_to_string(x0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM k) AS a LEFT JOIN c ON a.g = c.g LEFT JOIN p ON a.g = p.g AND p.i = 0
"""


TURN_REPAIR = _turn_repair()

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE r <= 10
"""
