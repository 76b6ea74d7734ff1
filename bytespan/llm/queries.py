"""Registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, decontaminate, licenses, minhash, packing, phrases, pii, repeats, spotsigs, tokens, topk, toxicity
from .common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


@query("op1_token_counts")
def op1(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

SQL_NEAR = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.m = p.a),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON d.doc_id = c.doc_id
"""


@query("op2_minhash_near_duplicates", SQL_NEAR)
def op2(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_personal_data")
def op4(spark, sf_dir):
    return pii.digest(pii.entities(table(spark, sf_dir, "documents")))


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


@query("op6_repeated_strings")
def op6(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("rest")


SQL_LEAKS = f"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT item_id, text, least(5, len(w)) AS k, unnest([0, 1]) AS part, unnest(CASE WHEN len(w) >= 10
        THEN [w[1:(len(w) + 1) // 2], w[(len(w) + 1) // 2 + 1:]] ELSE [w, w] END) AS x FROM i WHERE len(w) > 0),
s AS (SELECT item_id, text, k, part, list_distinct(list_transform(range(1, len(x) - k + 2), lambda j: array_to_string(x[j:j + k - 1], ' '))) AS g FROM p),
t AS (SELECT item_id, text, k, part, len(g) AS n, unnest(g) AS h FROM s),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
e AS (SELECT DISTINCT doc_id, r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS h
      FROM d, (SELECT DISTINCT k FROM t)),
m AS (SELECT doc_id, r, item_id, text, part, n, count(*) AS c FROM e JOIN t USING (k, h) GROUP BY ALL HAVING 100 * count(*) >= 75 * n)
SELECT q.doc_id, q.item_id, CAST(q.c AS BIGINT) AS n_question, CAST(q.n AS BIGINT) AS question,
       CAST(a.c AS BIGINT) AS n_answer, CAST(a.n AS BIGINT) AS answer
FROM m q JOIN m a ON q.r = a.r AND q.item_id = a.item_id AND q.text = a.text AND q.part = 0 AND a.part = 1
"""


@query("op7_benchmark_decontamination", SQL_LEAKS)
def op7(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_question", "question", "n_answer", "answer")


def _sql_licenses() -> str:
    norm = r"regexp_extract_all({}, '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[n])
    return f"""
WITH t AS (SELECT name, {pairs.format('w')} AS g FROM (SELECT name, {norm.format(low.format('body'))} AS w FROM (VALUES {rows}) v(name, body))),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, r, unnest(l) AS u, CAST(unnest(range(0, len(l))) AS BIGINT) AS line FROM d),
c AS (SELECT *, sum((u = '')::INT) OVER (PARTITION BY r ORDER BY line) AS gap FROM l),
b AS (SELECT doc_id, r, 'line' AS unit, line, u FROM c WHERE u <> ''
      UNION ALL SELECT doc_id, r, 'block', min(line), string_agg(u, chr(10) ORDER BY line) FROM c WHERE u <> '' GROUP BY doc_id, r, gap HAVING count(*) > 1),
n AS (SELECT doc_id, r, unit, line, {pairs.format('w')} AS g FROM (SELECT *, {norm.format(low.format('u'))} AS w FROM b)),
m AS (SELECT doc_id, r, unit, line, name, CAST(len(list_intersect(n.g, t.g)) AS BIGINT) AS common, CAST(len(n.g) + len(t.g) AS BIGINT) AS bigrams
      FROM n JOIN t ON 200 * least(len(n.g), len(t.g)) >= {licenses.PERCENT} * (len(n.g) + len(t.g)) AND len(n.g) > 0
      WHERE 200 * len(list_intersect(n.g, t.g)) >= {licenses.PERCENT} * (len(n.g) + len(t.g)))
SELECT doc_id, unit, line, name AS license, common, bigrams FROM m
QUALIFY row_number() OVER (PARTITION BY r, unit, line ORDER BY common / bigrams DESC, name, bigrams) = 1
"""


@query("op8_license_scan", _sql_licenses())
def op8(spark, sf_dir):
    return licenses.license_units(table(spark, sf_dir, "documents"))


SQL_CHAT = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT conv_id, perspective, turn, speaker, speaker = perspective AS target,
        CASE WHEN speaker = 'system' THEN '<|im_start|>system' WHEN speaker = perspective THEN '<|im_start|>assistant'
             ELSE '<|im_start|>user name=' || speaker END || chr(10) || text || '<|im_end|>' || chr(10) AS segment
      FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end" FROM s)
SELECT conv_id, perspective, turn, speaker, segment, target, "end" - length(segment) AS start, "end" FROM o
"""


@query("op9_chat_perspectives", SQL_CHAT)
def op9(spark, sf_dir):
    return chat.perspectives(table(spark, sf_dir, "conversations"))


SQL_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op10_exact_top_k", SQL_TOPK)
def op10(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def _sql_fingerprints() -> str:
    anchors = ", ".join(f"'{w}'" for w in sorted(set(spotsigs.ANCHORS)))
    chain = [f"LEFT JOIN k k{i} ON k{i}.r = s.r AND k{i}.kind = s.kind AND k{i}.c = s.c + {i}" for i in range(1, spotsigs.CHAIN + 1)]
    words = "concat_ws(' ', " + ", ".join(f"k{i}.w" for i in range(1, spotsigs.CHAIN + 1)) + ")"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r FROM documents),
u AS (SELECT *, length(text) AS n, length(text) // 4 AS k, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS next FROM t),
e AS (SELECT *, left(text, n - k) || left(next, k) AS edited FROM u),
x AS (SELECT r, 0 AS kind, text AS body FROM e UNION ALL SELECT r, 1, edited FROM e),
l AS (SELECT r, kind, list_filter(string_split_regex(lower(body), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '') AS w FROM x),
i AS (SELECT r, kind, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM l),
a AS (SELECT *, w IN ({anchors}) AS anchor FROM i),
c AS (SELECT *, sum((NOT anchor)::INT) OVER (PARTITION BY r, kind ORDER BY i) AS c FROM a),
k AS (SELECT r, kind, c, w FROM c WHERE NOT anchor),
s AS (SELECT r, kind, c, w FROM c WHERE anchor UNION ALL SELECT r, kind, 0, '^' FROM x),
g AS (SELECT DISTINCT s.r, s.kind, left(md5(s.w || ' ' || {words}), {spotsigs.DIGITS}) AS g FROM s {" ".join(chain)} WHERE k1.w IS NOT NULL),
f AS (SELECT x.r, x.kind, list_filter(list(g ORDER BY g), lambda z: z IS NOT NULL) AS f FROM x LEFT JOIN g ON x.r = g.r AND x.kind = g.kind GROUP BY x.r, x.kind),
p AS (SELECT a.r, a.f AS a, b.f AS b, coalesce(lead(a.f) OVER (ORDER BY a.r), first_value(a.f) OVER (ORDER BY a.r)) AS c
      FROM f a JOIN f b ON a.r = b.r AND a.kind = 0 AND b.kind = 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(a, ' ') AS fingerprint, array_to_string(b, ' ') AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next
FROM e JOIN p USING (r)
"""


@query("op11_document_fingerprints", _sql_fingerprints())
def op11(spark, sf_dir):
    return spotsigs.edits(table(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def op13(spark, sf_dir):
    return align.aligned(table(spark, sf_dir, "documents"))


SQL_PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS phrase FROM g)
      GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= {phrases.LEAST}),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT *, array_to_string(string_split(phrase, ' ')[:cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS tail FROM x),
s AS (SELECT y.lang, y.k, y.phrase, a, cut, h.f AS l, t.f AS r, 2000000::HUGEINT * a // (h.f + t.f) AS score
      FROM y JOIN f h ON h.lang = y.lang AND h.k = cut AND h.phrase = head JOIN f t ON t.lang = y.lang AND t.k = y.k - cut AND t.phrase = tail
      QUALIFY row_number() OVER (PARTITION BY y.lang, y.phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = s.lang AND c.k > s.k AND 100 * c.a >= {phrases.COVERED} * s.a
      AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) QUALIFY rank <= {phrases.TOP}
"""


@query("op12_phrase_collocations", SQL_PHRASES)
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
