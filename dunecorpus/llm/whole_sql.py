"""SQL of the operators that SQL can express whole: importance resampling, spelling variants, exact top-k."""

from __future__ import annotations

from dunecorpus.llm import importance, topk, variants
from dunecorpus.llm.licenses import LOWER, UPPER

_HEX = "'0123456789ABCDEF'"
#: The 256 values of the reflected CRC-32 polynomial.
_TABLE = "tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"


def _crc(s: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes; ``tab`` has to be joined."""
    byte = f"(strpos({_HEX}, hex(encode({s}))[2 * j + 1]) - 1) * 16 + strpos({_HEX}, hex(encode({s}))[2 * j + 2]) - 1"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({s})), lambda j: {byte})), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)"


def _features(table: str, row: str) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM (SELECT {row} AS row, {words} AS w FROM {table})"


B = importance.BUCKETS
IMPORTANCE = rf"""WITH {_TABLE}, docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
    f AS MATERIALIZED (SELECT row, f, count(*) AS n FROM ({_features("docs", "row")}) GROUP BY row, f),
    g AS MATERIALIZED (SELECT f, count(*) AS n FROM ({_features("benchmark", "0")}) GROUP BY f),
    b AS MATERIALIZED (SELECT f, {_crc("f")} % {B} AS b FROM (SELECT f FROM f UNION SELECT f FROM g), tab),
    s AS (SELECT b, sum(n) AS s FROM f JOIN b USING (f) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM g JOIN b USING (f) GROUP BY b),
    c AS (SELECT b, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t FROM (SELECT unnest(range({B})) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
    gain AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {B}) / ((s + 1) * (sum(t) OVER () + {B})))) AS BIGINT) AS gain FROM c),
    w AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN gain USING (b) GROUP BY row),
    x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, sha256('{importance.SEED}:' || doc_id) AS sha FROM docs LEFT JOIN w USING (row)),
    h AS (SELECT *, list_sum(list_transform(range(8), lambda j: (strpos('0123456789abcdef', sha[j + 1]) - 1) * CAST(16 ** (7 - j) AS BIGINT))) AS h FROM x),
    scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, n_features >= {importance.ORDER * importance.LEAST_WORDS - 1} AND doc_id IS NOT NULL AS own FROM h),
    ranked AS (SELECT *, CASE WHEN own THEN row_number() OVER (PARTITION BY own ORDER BY score DESC, doc_id, n_features, weight) END AS r FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT {importance.PERCENT} * count(*) // 100 FROM scored WHERE own) THEN r END AS rank FROM ranked"""

VARIANTS = rf"""WITH RECURSIVE {_TABLE}, runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
    counted AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= {variants.SHORTEST} GROUP BY doc_id, w),
    hashed AS (SELECT w, n, CASE WHEN doc_id IS NOT NULL THEN {_crc("(doc_id || ':' || w)")} END AS h FROM counted, tab),
    spoilt AS (SELECT n, CASE WHEN h % {variants.SPOILT} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
    words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= {variants.SHORTEST} GROUP BY word HAVING sum(n) >= {variants.LEAST}),
    less AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    pairs AS (SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT less.word, words.word, words.n FROM less JOIN words ON words.word = rest UNION SELECT words.word, less.word, less.n FROM less JOIN words ON words.word = rest),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM pairs GROUP BY word),
    known AS MATERIALIZED (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {variants.TIMES} * words.n THEN form END AS form, CASE WHEN form_n >= {variants.TIMES} * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
    chain AS (SELECT word, form AS root, 1 AS steps FROM known WHERE form IS NOT NULL UNION ALL SELECT chain.word, known.form, steps + 1 FROM chain JOIN known ON known.word = root WHERE known.form IS NOT NULL),
    ends AS (SELECT word, last(root ORDER BY steps) AS root FROM chain GROUP BY word)
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)"""

TOPK = f"""WITH e AS MATERIALIZED (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""

SQL = {"op11_importance": IMPORTANCE, "op12_variants": VARIANTS, "op13_topk": TOPK}
