"""DuckDB SQL for the queries that SQL can express: the same results, stated without the methods."""

from __future__ import annotations

from armwise.llm.decontamination import AGREE, EXACT, LEAST, MOST, SEPARATORS
from armwise.llm.secret_scan import EXAMPLE_OWNERS
from armwise.llm.url_filter import TRACKING

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SUBSTRING_DEDUP = rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
    p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w),
    k AS (SELECT doc_id, pos, words[pos] AS word, CASE WHEN pos + 19 <= len(words) THEN array_to_string(words[pos:pos + 19], ' ') END AS win FROM p),
    l AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS later FROM k),
    c AS (SELECT *, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM l),
    d AS (
        SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
        FROM c GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN d USING (doc_id)
"""


def _either(word: str) -> str:
    """A pattern for ``word`` in which ASCII letters stand for both cases."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_PATTERNS = {
    "assign": rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "owned": "[A-Za-z0-9+/_=-]{20,}",
}
_HITS = "\n        UNION ALL ".join(
    f"SELECT doc_id, source, {k} AS rank, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM t"
    for k, (kind, p) in enumerate(_PATTERNS.items())
)

_SECRET_SCAN = rf"""
    WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    m AS (
        {_HITS}
    ),
    i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
    h AS (
        SELECT doc_id, source, rank, kind, hits[i] AS hit,
            (list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0))::BIGINT AS start
        FROM i
    ),
    s AS (
        SELECT *, start + length(hit) AS stop, CASE WHEN rank = 0 THEN regexp_extract(hit, '{_PATTERNS["assign"]}', 2) ELSE hit END AS value FROM h
    ),
    base AS (SELECT * FROM s WHERE rank IN (1, 2) OR rank = 0 AND length(value) >= 6),
    opaque AS (
        SELECT * FROM s WHERE rank = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
            AND len(list_distinct(string_split(value, ''))) >= 8
            AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)
    ),
    e AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
    r AS (SELECT DISTINCT value, source IS NULL AS nobody, split_part(coalesce(source, ''), '/', 1) AS owner, coalesce(source, '') AS repository FROM e),
    o AS (SELECT value, count(DISTINCT (owner, nobody)) AS owners, count(*) AS repositories FROM r GROUP BY value),
    j AS (SELECT * FROM e JOIN o USING (value) WHERE rank < 3 OR owners = 1),
    g AS (
        SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base,
            count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
            count(*) FILTER (rank = 3) AS n_owned, count(*) FILTER (owners = 1) AS n_live,
            count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_examples, max(repositories) AS most
        FROM j GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
        coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples, coalesce(most, 0)::BIGINT AS most_repositories
    FROM documents LEFT JOIN g USING (doc_id)
"""

_JACCARD_JOIN = rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM documents
    ),
    p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS pos FROM w),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS gram FROM p),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS MATERIALIZED (
        SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)
    ),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other
    ),
    c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""


_PLAIN_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[^{}]+')".format(SEPARATORS.replace("'", "''").replace('\\"', '"'))

# Without seeds: all alignments in which enough words agree, and all windows in them.
_DECONTAMINATION = rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN_WORDS} AS ours FROM documents),
    b AS MATERIALIZED (
        SELECT item_id, theirs, len(theirs) AS length, least({LEAST}, len(theirs)) AS least
        FROM (SELECT item_id, {_PLAIN_WORDS} AS theirs FROM benchmark) WHERE len(theirs) > 0
    ),
    dw AS (SELECT doc_id, unnest(ours) AS word, unnest(range(1, len(ours) + 1)) AS p FROM d),
    bw AS (SELECT item_id, unnest(theirs) AS word, unnest(range(1, len(theirs) + 1)) AS q FROM b),
    a AS (
        SELECT doc_id, item_id, p - q AS shift FROM dw JOIN bw USING (word) JOIN b USING (item_id)
        GROUP BY doc_id, item_id, shift HAVING 100 * count(*) >= {AGREE} * any_value(least)
    ),
    k AS (
        SELECT doc_id, item_id, shift, length, least, ours, theirs,
            unnest(range(greatest(1, 1 - shift), least(length, len(ours) - shift) + 1)) AS q
        FROM a JOIN d USING (doc_id) JOIN b USING (item_id)
    ),
    s AS (
        SELECT doc_id, item_id, shift, q, length, least,
            sum((ours[q + shift] = theirs[q])::INTEGER) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS upto,
            (ours[q + shift] = theirs[q])::INTEGER AS same
        FROM k
    ),
    v AS (
        SELECT x.doc_id, x.item_id, y.q - x.q + 1 AS compared, y.upto - x.upto + x.same AS agreeing
        FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.shift = y.shift
            AND y.q BETWEEN x.q + x.least - 1 AND x.q + {MOST} - 1
        WHERE 100 * (y.upto - x.upto + x.same) >= (CASE WHEN x.length < {EXACT} THEN 100 ELSE {AGREE} END) * (y.q - x.q + 1)
    ),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, compared) AS place FROM v)
    SELECT doc_id, item_id, compared::BIGINT AS compared, agreeing::BIGINT AS agreeing FROM o WHERE place = 1
"""

_EXACT_DEDUP = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT doc_id, length(text) AS size, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS norm FROM t),
    g AS (SELECT norm, arg_min(doc_id, (-size, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""

_URL_FILTER = rf"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM u
    ),
    q AS (
        SELECT page_id, host, path, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')), '&') AS asked FROM p
    ),
    c AS (
        SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN asked = '' THEN '' ELSE '?' || asked END AS canonical FROM q
    ),
    l AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split_regex(host, '[.:-]'), ['casino', 'pills', 'bets', 'adult', 'spam', 'ads'])),
    r(own, start, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    b AS (
        SELECT page_id, arg_max(own || start, length(own || start)) AS rule, arg_max(says, length(own || start)) AS says
        FROM c JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(says, CASE WHEN host <> '' AND l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
        host <> '' AND l.canonical IS NOT NULL AS listed
    FROM c LEFT JOIN b USING (page_id) LEFT JOIN l USING (canonical)
"""

_CRC_STEPS = "list_reduce([({}), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {_CRC_STEPS.format('xor(c, b)')}), 4294967295)"

# Prefixes as joined digests of the turns; a subtree is the pairs of prefixes of one conversation.
_PREFIX_TRIE = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    d AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS d, length(text)::BIGINT AS n FROM t),
    c AS (SELECT conv_id, list({{'d': d, 'n': n}} ORDER BY turn NULLS FIRST, d, n) AS turns, {_CRC} % 6 AS h FROM d GROUP BY conv_id),
    f AS (SELECT c.conv_id, coalesce(b.turns[:c.h], []) || c.turns[c.h + 1:] AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
    p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM f),
    k AS MATERIALIZED (SELECT conv_id, depth, depth = len(turns) AS ends, md5(array_to_string(list_transform(turns[:depth], lambda x: x.d), '')) AS key, coalesce(turns[depth].n, 0) AS n FROM p),
    o AS MATERIALIZED (
        SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM k GROUP BY depth, key
    ),
    e AS MATERIALIZED (SELECT DISTINCT x.depth AS up, x.key AS top, y.depth, y.key FROM k x JOIN k y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
    s AS (SELECT up, top, count(*) FILTER (e.depth = up + 1) AS n_children FROM e GROUP BY up, top),
    v AS (SELECT o.*, n_children FROM o JOIN s ON s.up = o.depth AND s.top = o.key),
    w AS (
        SELECT e.up, e.top, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.n)::BIGINT AS saved_tokens
        FROM e JOIN v ON v.depth = e.depth AND v.key = e.key GROUP BY e.up, e.top
    )
    SELECT v.conv_id, v.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, w.n_leaves, w.saved_tokens, v.ends_sha256
    FROM v JOIN w ON w.up = v.depth AND w.top = v.key
    LEFT JOIN (SELECT e.depth, e.key, o.conv_id FROM e JOIN o ON o.depth = e.up AND o.key = e.top WHERE e.up = e.depth - 1) a ON a.depth = v.depth AND a.key = v.key
"""

ORACLES = {
    "op1_substring_dedup": _SUBSTRING_DEDUP,
    "op2_secret_scan": _SECRET_SCAN,
    "op3_jaccard_join": _JACCARD_JOIN,
    "op7_decontamination": _DECONTAMINATION,
    "op8_exact_dedup": _EXACT_DEDUP,
    "op11_url_filter": _URL_FILTER,
    "op12_prefix_trie": _PREFIX_TRIE,
}
