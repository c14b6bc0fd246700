"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from skarn.llm.license_rules import LEAD, RULES, SENTENCES, SPLIT, UNDER

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DEDUP = r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
        FROM documents
    ), k AS (
        SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size
        FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""

LICENSES = f"""
    WITH known(sentence, id) AS (VALUES {', '.join(f'({_text(s)}, {_text(i)})' for s, i in SENTENCES.items())}),
    rules(i, name, run) AS (VALUES {', '.join(f"({i}, {_text(n)}, {_text(' ' + ' '.join(ids) + ' ')})" for i, (n, ids) in enumerate(RULES))}),
    l AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {_text(SPLIT)}), lambda x: length(x) > 0) AS xs FROM documents),
    s AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM l),
    n AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), {_text(LEAD)}, '') AS p FROM s),
    h AS (
        SELECT doc_id, pos, coalesce(a.id, b.id) AS id FROM n
        LEFT JOIN known a ON a.sentence = p
        LEFT JOIN known b ON b.sentence = regexp_replace(p, {_text(UNDER)}, 'licensed under ')
        WHERE coalesce(a.id, b.id) IS NOT NULL
    ), g AS (
        SELECT *, CASE WHEN pos = coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1) + 1 THEN '' ELSE '| ' END AS bar FROM h
    ), d AS (
        SELECT doc_id, count(*) AS n, string_agg(pos || ':' || id, ',' ORDER BY pos) AS ids, ' ' || string_agg(bar || id || ' ', '' ORDER BY pos) AS line
        FROM g GROUP BY doc_id
    ), f AS (
        SELECT doc_id, name, min(instr(line, run) * 1000 + i) AS place FROM d, rules WHERE instr(line, run) > 0 GROUP BY ALL
    ), named AS (SELECT doc_id, string_agg(name, ',' ORDER BY place) AS licenses FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_license_sentences, coalesce(ids, '') AS license_ids, coalesce(licenses, '') AS licenses
    FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _cased(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join([*map(_cased, ("password", "passwd", "secret", "token")), _cased("api") + "_?" + _cased("key")])
_SECRETS = [
    ("assign", f"""({_KEYWORD})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
]


def _kind(k: int, name: str, pattern: str, group: int, least: int) -> str:
    return f"""
        SELECT doc_id, {k} AS k, '{name}' AS kind, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS a, length(whole[i]) AS n
        FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
            SELECT doc_id, string_split_regex(t, '{pattern}') AS gap, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS val FROM t))
        WHERE length(val[i]) >= {least}"""


SECRETS = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({' UNION ALL '.join(_kind(k, *rule) for k, rule in enumerate(_SECRETS))}),
    g AS (
        SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
               string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) AS spans
        FROM s GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN g USING (doc_id)
"""

LINES = rf"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {WORDS.format('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY doc_id),
    l AS (SELECT doc_id, host, t, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS p, len({WORDS.format('x')}) AS n FROM (SELECT doc_id, host, t, unnest(ls) AS x FROM w)),
    often AS (
        SELECT host, p FROM l GROUP BY host, p HAVING count(DISTINCT doc_id) > 20
    ), gone AS (SELECT doc_id, sum(n) AS removed FROM l JOIN often USING (host, p) GROUP BY doc_id),
    f AS (
        SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
               coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_words
        FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
    ), v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.3 * n_words)) AS kept,
           n_removed_words
    FROM v
"""


def _jumps(shards: int, name: str) -> str:
    """Column `name`: the shard of seed k among `shards`, from `shards` jumps unrolled (each moves ahead by one at least)."""
    q = "SELECT *, CAST(k AS HUGEINT) AS j_key, CAST(0 AS HUGEINT) AS j_at, CAST(0 AS HUGEINT) AS j_ahead FROM s"
    for _ in range(shards):
        q = f"""SELECT * EXCLUDE (n_key) REPLACE (CASE WHEN j_ahead < {shards} THEN j_ahead ELSE j_at END AS j_at, CASE WHEN j_ahead < {shards} THEN n_key ELSE j_key END AS j_key,
            CASE WHEN j_ahead < {shards} THEN CAST(floor((j_ahead + 1) * (2147483648.0::DOUBLE / CAST((n_key // 8589934592) + 1 AS DOUBLE))) AS HUGEINT) ELSE j_ahead END AS j_ahead)
            FROM (SELECT *, ((j_key % 4294967296) * 2862933555777941757 + ((((j_key // 4294967296) * 2862933555777941757) % 4294967296) * 4294967296) + 1) % 18446744073709551616 AS n_key FROM ({q}))"""
    return f"SELECT n, CAST(j_at AS INTEGER) AS {name} FROM ({q})"


def _crc_table() -> str:
    """The 256 remainders of a byte under the reversed CRC-32 polynomial, as a list."""
    rest = list(range(256))
    for _ in range(8):
        rest = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in rest]
    return str(rest)


_CRC = "list_reduce(list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(tab[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8), CAST(4294967295 AS BIGINT))"

SHARDS = f"""
    WITH s AS (
        SELECT row_number() OVER () AS n, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS t,
               CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 15) AS BIGINT) AS k
        FROM documents
    ), c AS (SELECT n, xor({_CRC.format('t')}, 4294967295) AS text_crc32 FROM s, (SELECT CAST({_crc_table()} AS BIGINT[]) AS tab)),
    a AS ({_jumps(8, 'shard')}), b AS ({_jumps(9, 'grown_shard')})
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
    FROM s JOIN c USING (n) JOIN a USING (n) JOIN b USING (n)
"""

_TURN = "sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)"  # equal for equal (role, text) alone

TRIE = f"""
    WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_TURN}) AS i FROM raw
    ), hs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor({_CRC.format('CAST(conv_id AS VARCHAR)')}, 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM raw), (SELECT CAST({_crc_table()} AS BIGINT[]) AS tab)),
    own AS (
        SELECT hs.conv_id, 0 AS part, i, role, text FROM hs JOIN t ON t.conv_id = hs.base AND i <= h
        UNION ALL SELECT hs.conv_id, 1, i, role, text FROM hs JOIN t ON t.conv_id = hs.conv_id AND i > h
    ), p AS (
        SELECT conv_id, row_number() OVER w AS d, length(text) AS len, list({_TURN}) OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
    ), q AS (SELECT conv_id, 0 AS d, 0 AS len, CAST([] AS VARCHAR[]) AS path FROM hs UNION ALL SELECT conv_id, d, len, path FROM p),
    n AS (SELECT path, any_value(d) AS d, any_value(len) AS len, min(conv_id) AS conv_id, count(*) AS n FROM q GROUP BY path),
    e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM (SELECT * FROM q QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY path),
    k AS (SELECT path[:d - 1] AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
    s AS (SELECT n.*, coalesce(kids, 0) AS kids, (n - 1) * len AS saves FROM n LEFT JOIN k USING (path)),
    u AS (SELECT up AS path, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(saves) AS saved FROM (SELECT kids, saves, path[:unnest(range(0, d + 1))] AS up FROM s) GROUP BY up)
    SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, s.n AS n_convs, s.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
           CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
    FROM s JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN n AS parent ON s.d > 0 AND parent.path = s.path[:s.d - 1]
"""
