"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

from tessera.llm.chat import CONTROL, END, MARK, START
from tessera.llm.mixing import MOST_USES, SHARE, WEIGHTS
from tessera.llm.quality import MAX_DUP_PERCENT, MAX_HOST_RATE, MAX_REPEAT_PERCENT, MIN_WORDS

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(x: str) -> str:
    return "".join("\\" + c if c in r"\.[]|<>/*+?(){}^$" else "\\n" if c == "\n" else c for c in x)


def _marks(*more: str) -> str:
    return "'" + "|".join(_quoted(x) for x in (MARK, *more, *CONTROL)) + "'"


CHATS = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
  CAST(sum({len(START) + len(END) + 2} + length(role) + len(regexp_extract_all(role, {_marks(chr(10))})) + length(text) + len(regexp_extract_all(text, {_marks()}))) AS BIGINT) AS formatted_chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS l FROM documents UNION SELECT ways.b, r.l FROM r JOIN ways ON ways.a = r.doc_id),
c AS (SELECT doc_id, min(l) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""

MIX_TARGETS = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD})) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY 1),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(no - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, source_size * {float(MOST_USES)} AS stop FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {SHARE} - coalesce(sum(stop) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY stop / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, max(CASE WHEN stop > level * weight THEN level END) OVER () AS last FROM l)
SELECT doc_id, size, source_size, round(CASE WHEN stop <= level * weight THEN stop ELSE last * weight END, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))


def _spans() -> str:
    """Matches alternate with the pieces between them, so the pieces and matches before one tell where it begins."""
    out = []
    for no, (kind, pattern, group, least) in enumerate(BASE):
        out.append(f"""SELECT k, {no} AS no, '{kind}' AS kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v FROM d)) WHERE length(v[i]) >= {least}""")
    return " UNION ALL ".join(out)


SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), f AS ({_spans()}),
g AS (SELECT k, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, no) AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (k)"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines FROM documents),
g AS (SELECT k, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS times FROM g) CROSS JOIN (VALUES (0), (1), (2)) AS v(j) WHERE times > 1 GROUP BY 1),
m AS (SELECT k, doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - list_unique(lines) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > {MAX_DUP_PERCENT} * n_lines AS any_failed FROM b),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (any_failed) AS failed FROM f GROUP BY 1),
p AS (SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v, avg(1 / docs) AS inv FROM h),
q AS (SELECT m, least(greatest(coalesce(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-6) - 1, 1), 1), 1000) AS n FROM p),
r AS (SELECT source, (failed + m * n) / (docs + n) AS rate FROM h CROSS JOIN q)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= {MAX_HOST_RATE} AS kept, round(rate, 6) AS host_rate FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source"""



def _clusters(rounds: int = 3, k: int = 16) -> str:
    """Every round is a step of its own: assign all vectors to all centroids, then average by component."""
    finite = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {finite})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS w FROM kept ORDER BY sha256('1:' || vec_id), v LIMIT {k})",
    ]
    for i in range(rounds + 1):
        d = "CAST(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT k, vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM (SELECT k, vec_id, v, c, {d} AS d FROM kept CROSS JOIN c{i}) GROUP BY ALL)")
        if i < rounds:
            mean = "(s - (s % n + n) % n) // n"
            steps.append(f"m{i} AS (SELECT c, list({mean} ORDER BY j) AS w FROM (SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, 65) AS r(j) GROUP BY 1, 2) GROUP BY 1)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = best.c"""


def _nibble(i: int) -> int:
    """CRC-32 (reflected polynomial EDB88320) of four bits."""
    for _ in range(4):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


NIBBLES = "[" + ", ".join(str(_nibble(i)) for i in range(16)) + "]"
VARIANTS = f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2),
b AS (SELECT run, n, list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(xor(xor(c, x) >> 4, {NIBBLES}[(xor(c, x) & 15) + 1]) >> 4, {NIBBLES}[(xor(xor(c, x) >> 4, {NIBBLES}[(xor(c, x) & 15) + 1]) & 15) + 1])), 4294967295) AS h FROM b),
m AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
x AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM x WHERE rest IN (SELECT word FROM w) UNION SELECT rest, word FROM x WHERE rest IN (SELECT word FROM w)),
g AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(n := -w.n, other := b)) AS best FROM p JOIN w ON w.word = b GROUP BY 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * n THEN best.other END AS form, CASE WHEN -best.n >= 2 * n THEN -best.n END AS form_n FROM w LEFT JOIN g USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word WHERE root IN (SELECT word FROM f WHERE form IS NULL)"""

SQL = {"op2_chat_formatting": CHATS, "op3_near_dedup": NEAR, "op10_quality_rules": QUALITY, "mix_targets": MIX_TARGETS, "secret_base_spans": SECRETS, "op12_centroid_clustering": _clusters(), "op13_spelling_variants": VARIANTS}
