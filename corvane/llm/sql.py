"""SQL twins of the operators that SQL can express, over the same whole tables: mixing, quality rules, url rules, sharding."""

from __future__ import annotations

from corvane.llm import quality, sharding, urlfilter

WORD = r"[^\x20\x09-\x0D]+"
TEXT_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mixing(shards: int = 8, seed: int = 7, limit: int = 3, most_block: int = 16, least_blocks: int = 1 << 16) -> str:
    """Targets by the level at which the capped sources are left out, every seat listed and ranked, and each shard's part of the seeded stream."""
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len({TEXT_WORDS}) AS BIGINT) AS size FROM documents),
keyed AS (SELECT *, md5(concat_ws('|', '{seed}', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))) AS o FROM sized),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM keyed),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, {limit}.0::DOUBLE * source_size AS cap FROM r),
q AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
 / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT source, source_size, rank, least(cap, weight * coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1), 'inf'::DOUBLE)) AS target FROM l),
b AS (SELECT *, greatest(1, least({most_block}, CAST(floor(sum(target) OVER () / {least_blocks}) AS BIGINT))) AS block, sum(target) OVER () AS total FROM t),
seats AS (SELECT source, target, block, rank, total, unnest(range(1, CAST(ceil(target / block) AS BIGINT) + 3)) AS k FROM b WHERE target > 0),
won AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank, k) AS seat FROM seats),
ends AS (SELECT e AS shard, rank, block * count(*) FILTER (seat <= CAST(floor(CAST(round(total / block) AS BIGINT) * e / {shards}) AS BIGINT)) AS stream
 FROM won, (SELECT unnest(range(1, {shards + 1})) AS e) GROUP BY e, rank, block),
upto AS (SELECT d.doc_id, d.size, d.start, d.o, b.source_size, b.target, e.shard, least(coalesce(e.stream, 0), {limit} * b.source_size) AS x
 FROM placed d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN ends e ON e.rank = b.rank),
counted AS (SELECT *, CASE WHEN source_size > 0 THEN (x // source_size) * size + greatest(0, least(size, x - (x // source_size) * source_size - start)) ELSE 0 END AS n FROM upto)
SELECT doc_id, size, source_size, target, CAST(max(n) AS BIGINT) AS taken FROM counted GROUP BY doc_id, size, start, o, source_size, target"""


def quality_rules(most_lost: float = 0.4, least_words: int = 20, most_repeated: int = 30, window: int = 8) -> str:
    """Windows of words are compared as words; lines are judged one by one."""
    n = lambda pattern, of="line": f"len(regexp_extract_all({of}, {quoted(pattern)}))"
    notices = " OR ".join(f"contains(lower(line), {quoted(p)})" for words in quality.NOTICES.values() for p in words)
    actions = " OR ".join(f"starts_with(regexp_replace(lower(line), '^\\P{{L}}+', ''), {quoted(p)})" for words in quality.ACTIONS.values() for p in words)
    fails = f"""5 * {n(quality.MARKS)} >= n OR 5 * {n(quality.NAVIGATION)} >= n OR (n >= 5 AND {n(r'\p{Lu}{2}')} > 4 * {n(r'\p{Ll}{2}')})
 OR (n >= 20 AND NOT regexp_matches(line, {quoted(quality.PUNCTUATION)})) OR 3 * {n(quality.ADDRESS)} >= n OR (n <= 30 AND ({notices}))
 OR (n <= 6 AND ({actions})) OR (n >= 10 AND 4 * len(list_distinct(regexp_extract_all(lower(line), '{WORD}'))) < n)"""
    repeat = f"""SELECT uid, count(DISTINCT i + k) AS repeated FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, shingle) AS times
  FROM (SELECT uid, i, n, string_agg(word, ' ') OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS shingle
   FROM (SELECT uid, len(words) AS n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d)) WHERE i <= n - {window - 1}),
  (SELECT unnest(range({window})) AS k) WHERE times > 1 GROUP BY uid"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, {TEXT_WORDS} AS words FROM documents),
repeats AS ({repeat}),
lines AS (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d),
spoken AS (SELECT uid, line, {n(WORD)} AS n, count(*) AS times FROM lines GROUP BY uid, line),
judged AS (SELECT uid, sum(times) FILTER (n > 0) - count(*) FILTER (n > 0) AS dups, sum(CASE WHEN n > 0 AND NOT ({fails}) THEN n ELSE 0 END) AS stay FROM spoken GROUP BY uid),
counts AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST({n(quality.SYMBOLS, 'text')} AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words,
 CAST(len(words) - coalesce(stay, 0) AS BIGINT) AS n_lost FROM d LEFT JOIN judged USING (uid) LEFT JOIN repeats USING (uid)),
failed AS (SELECT *, n_words < {least_words} OR 100 * n_repeat_words > {most_repeated} * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND n_lost <= {most_lost} * n_words AS kept FROM failed"""


def url_rules() -> str:
    """Each rule and each unwanted host against every url by comparing strings; the longest rule wins."""
    def split(key: str) -> tuple[str, str]:
        host, _, path = key.partition("/")
        return host, "/" + path

    rules = [(k, *split(k), verdict) for verdict, keys in urlfilter.RULES.items() for k in keys]
    table = ", ".join(f"({', '.join(map(quoted, r))})" for r in rules)
    unwanted = ", ".join(quoted(f"{n}.{z}") for n in urlfilter.UNWANTED for z in urlfilter.ZONES)
    fits = lambda host, path: f"(u.host = {host} OR ends_with(u.host, '.' || {host})) AND starts_with(u.path, {path})"
    return f"""
WITH u AS (SELECT row_number() OVER () AS uid, page_id,
 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES {table}) AS t(rule, rhost, rpath, verdict)),
best AS (SELECT u.uid, rule, verdict FROM u JOIN rules ON {fits('rhost', 'rpath')} QUALIFY row_number() OVER (PARTITION BY u.uid ORDER BY length(rule) DESC, rule DESC) = 1),
bad AS (SELECT DISTINCT u.uid FROM u, (SELECT unnest([{unwanted}]) AS bhost) WHERE {fits('bhost', "'/'")})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.uid IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM u LEFT JOIN best USING (uid) LEFT JOIN bad USING (uid)"""


def crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes: DuckDB has none, so it is folded over the bytes with the table of its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1]))"
    return f"xor({fold}, 4294967295::BIGINT)"


def curve_shards(shards: int = 8) -> str:
    """Levels of source, language and size, the cell's place on the curve from its table, and ranks by one sort."""
    curve = [sharding.hilbert_index((a, b, c), sharding.BITS) for a in range(8) for b in range(8) for c in range(8)]

    def levels(c: str) -> str:
        return f"""SELECT {c}, CAST(least(7, floor(8 * (sum(n) OVER (ORDER BY {c} NULLS FIRST) - n / 2.0) / sum(n) OVER ())) AS INTEGER) AS level
 FROM (SELECT {c}, count(*) AS n FROM documents GROUP BY 1)"""

    return f"""
WITH sl AS ({levels('source')}), ll AS ({levels('lang')}),
x AS (SELECT doc_id, source, lang, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
c AS (SELECT doc_id, size, text_crc32, CAST({curve}[sl.level * 64 + ll.level * 8 + CAST(least(7, greatest(0, floor(ln(size) / ln(2) / 2) - 3)) AS INTEGER) + 1] AS INTEGER) AS cell,
 substr(md5(concat_ws('|', CAST(text_crc32 AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 2) AS bucket
 FROM x JOIN sl ON x.source IS NOT DISTINCT FROM sl.source JOIN ll ON x.lang IS NOT DISTINCT FROM ll.lang),
r AS (SELECT *, row_number() OVER (ORDER BY cell, bucket, text_crc32, doc_id, size) - 1 AS rank, count(*) OVER () AS n FROM c),
s AS (SELECT *, CAST(rank * {shards} // n AS INTEGER) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(rank - (shard * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, cell FROM s"""


def spelling(slips: int = 199, least_length: int = 6, least_count: int = 5, times: int = 5) -> str:
    """Near words are pairs that agree with a place masked or left out; roots by recursion."""
    return f"""
WITH RECURSIVE runs AS (SELECT doc, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
 unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) GROUP BY doc, run),
hashed AS (SELECT *, {crc32("doc || ':' || run")} AS h, length(run) AS l FROM runs),
slipped AS (SELECT CASE WHEN h % {slips} = 0 THEN substr(run, 1, CAST(h % l AS BIGINT)) || substr(run, CAST(h % l AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped GROUP BY word HAVING length(word) >= {least_length} AND sum(n) >= {least_count}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
less AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM places),
masked AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS key FROM places),
pairs AS (SELECT a.word, b.word AS near, b.n FROM masked a JOIN masked b ON a.key = b.key AND a.word <> b.word
 UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.key = b.word UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.key = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, near := near)) AS b FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= {times} * w.n THEN b.near END AS form, CASE WHEN -b.m >= {times} * w.n THEN -b.m END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN ends USING (word)"""


def archives(least_bytes: int = 0) -> str:
    """Digests in base 32 by their hexadecimal digits, five of which make four; the smallest page of equal payloads by a window."""
    value = lambda i: f"CAST('0x' || substr(x, {5 * i + 1}, 5) AS BIGINT)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({value(i)} >> {s}) & 31 AS BIGINT), 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, {letters} AS payload_digest, row_number() OVER (PARTITION BY x ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY x ORDER BY page_id NULLS LAST) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 OR payload_bytes < {least_bytes} THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN k > 1 AND payload_bytes >= {least_bytes} THEN original END AS refers_to FROM r"""


def clusters(clusters: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, scale: int = 1024) -> str:
    """A round after the other: every vector against every centroid, sums of components, floors of means."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, c := c)) AS b FROM (SELECT rid, c,
 list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} m) GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN (SELECT c, list({floor} ORDER BY i) AS x FROM
 (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.b.c AS c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM a{i} a JOIN v USING (rid)) GROUP BY c, i) GROUP BY c) m USING (c))""")
    body = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT x, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v) QUALIFY c < {clusters}),
{body},
r AS (SELECT v.vec_id, a.b.c AS c, CAST(a.b.d AS BIGINT) AS d FROM a{rounds} a JOIN v USING (rid))
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
 FROM r JOIN c{rounds} m USING (c)"""


ORACLES: dict[str, str] = {
    "op11_spelling": spelling(), "op12_warc": archives(), "op13_centroids": clusters(),
    "op1_mixing": mixing(), "op4_quality": quality_rules(), "op6_urls": url_rules(), "op10_sharding": curve_shards(),
}
