"""What SQL can say of the training-data operators: their base columns, held against DuckDB.

A query here selects columns of the operator's own result; the methods' own
finds, scores and fingerprints have no SQL and are held by the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from dunecorpus.llm import licenses, url_reputation

DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
UPPER, LOWER = licenses.UPPER, licenses.LOWER


def _matches(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Rows (doc_id, kind, rank, s, e) of a kind's matches ``found`` that ``keep`` passes, with places in code points."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s, s + length(found) AS e FROM (
        SELECT doc_id, m[i] AS found, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM d))
    ) WHERE {keep}"""


_D = "regexp_replace(found, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_D})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({_D}[length({_D}) - i] AS INT) ELSE 2 * CAST({_D}[length({_D}) - i] AS INT) - CASE WHEN CAST({_D}[length({_D}) - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"

# The contract's patterns.
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(found, '.'), lambda x: CAST(x AS HUGEINT) <= 255))"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_D}) BETWEEN 16 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 8 AND 15"),
)
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = (
    ("assign", _ASSIGN, "length(regexp_extract(found, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 12"),
    ("access", r"AKIA[A-Z0-9]+", "length(found) >= 18"),
    ("hex", r"[0-9a-f]{16,}", "true"),
)


def _spans_sql(kinds, order: str) -> str:
    spans = " UNION ALL ".join(_matches(k, i, p, keep) for i, (k, p, keep) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in kinds)
    return f"""WITH {DOCS}, spans AS ({spans}), joined AS (SELECT doc_id, {counts}, sha256(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order})) AS base_sha256 FROM spans GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in kinds)}, coalesce(base_sha256, sha256('')) AS base_sha256 FROM d LEFT JOIN joined USING (doc_id)"""


def _url_sql() -> str:
    def case(value) -> str:
        fits = [(r, f"(host = '{r[1]}' OR suffix(host, '.{r[1]}')) AND prefix(path, '{r[2]}')") for r in sorted(url_reputation.RULES, key=lambda r: -len(r[1] + r[2]))]
        return "CASE " + " ".join(f"WHEN {test} THEN '{value(r)}'" for r, test in fits) + " END"

    return f"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
        SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS rule_verdict FROM h"""


def _licenses_sql() -> str:
    def at(phrase: str) -> str:
        fits = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split()))
        return f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {fits}), lambda i: i - 1)"

    places = [at(phrase) for phrase, _ in licenses.PHRASES]
    labels = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for p, (_, label) in zip(places, licenses.PHRASES, strict=True))
    return rf"""WITH {DOCS}, t AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
        p AS (SELECT doc_id, len(w) AS n_words, list_concat({", ".join(places)}) AS every, [{labels}] AS labels FROM t)
        SELECT doc_id, n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
            array_to_string(list_sort(list_distinct(list_filter(labels, lambda x: x IS NOT NULL))), ',') AS base_labels FROM p"""


NEAR_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL),
    k AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN chr(30) || text ELSE array_to_string(w, chr(31)) END AS key FROM t),
    reps AS (SELECT key, min(doc_id) AS rep, count(*) AS copies, any_value(w) AS w FROM k GROUP BY key),
    grams AS (SELECT DISTINCT rep, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS gram FROM reps WHERE len(w) > 0),
    size AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
    both_ AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY a.rep, b.rep),
    links AS (SELECT a, b FROM both_ JOIN size x ON x.rep = a JOIN size y ON y.rep = b WHERE both_.n * 10 >= 8 * (x.n + y.n - both_.n)),
    reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
    degree AS (SELECT links.a AS rep, sum(copies) AS n FROM links JOIN reps ON reps.rep = links.b GROUP BY links.a)
    SELECT doc_id, class_id, CAST(copies - 1 + coalesce(degree.n, 0) AS BIGINT) AS n_links, copies
    FROM k JOIN reps USING (key) JOIN class USING (rep) LEFT JOIN degree USING (rep)"""

EDITED_SQL = f"""WITH {DOCS}, n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM d WINDOW w AS (ORDER BY doc_id DESC))
    SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(following, length(text) // 2)) AS edited_sha256 FROM n"""


def base_queries(own: dict[str, Callable]) -> dict[str, tuple[Callable, str]]:
    """name -> (query, SQL) for the base columns of the registered operators."""

    def of(name: str, *columns) -> Callable[..., DataFrame]:
        return lambda spark, sf_dir: own[name](spark, sf_dir).selectExpr(*columns)

    return {
        "op1_pii_base": (of("op1_pii", "doc_id", *[f"n_{k}" for k, _, _ in PERSONAL], "base_sha256"), _spans_sql(PERSONAL, "rank, s")),
        "op5_url_filter_base": (of("op5_url_filter", "page_id", "host", "path", "rule", "CASE WHEN rule IS NOT NULL THEN verdict END AS rule_verdict"), _url_sql()),
        "op6_licenses_base": (of("op6_licenses", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), _licenses_sql()),
        "op8_secrets_base": (of("op8_secrets", "doc_id", *[f"n_{k}" for k, _, _ in SECRETS], "base_sha256"), _spans_sql(SECRETS, "s, rank")),
        "op10_simhash_base": (of("op10_simhash", "doc_id", "n_chars", "edited_sha256"), EDITED_SQL),
    }
