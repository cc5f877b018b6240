"""Queries of the operators of this subpackage, with DuckDB statements where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ragchew.llm import (decontam, filter_audit, line_chunks, merkle, mixing, near_dups, pii, revisits, secrets, sharding, suffix_index, topk,
                         toxicity)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive_records(pages: DataFrame) -> DataFrame:
    """Archive records in the shape of the revisit job, from the pages: addresses keep their form, with
    the last digit of their number; each third record is a revisit, some responses are errors."""
    n = F.col("page_id")
    tag = F.concat(F.lit('"e'), (n * 31 % 3).cast("string"), F.lit('"'))
    date = F.concat(F.lit("day "), (n % 28).cast("string"))
    changed = F.concat(F.lit("day "), (n % 2).cast("string"))
    revisit = n % 3 == 1
    headers = F.map_filter(F.create_map(
        F.lit("etag"), F.when(n % 4 != 0, F.when(revisit, F.concat(F.lit("W/"), tag)).otherwise(tag)),
        F.lit("last-modified"), changed, F.lit("date"), date,
        F.lit("cache-control"), F.when(n % 5 == 0, F.lit("no-cache")),
        F.lit("content-type"), F.when(revisit, F.lit("none")).otherwise(F.lit("text/html")),
    ), lambda _, v: v.isNotNull())
    return pages.select(
        n.alias("record_id"), F.regexp_replace("url", "/[0-9]*([0-9])", "/$1").alias("url"),
        F.timestamp_seconds(F.lit(1700000000) + n * 7919 % 1000003).alias("fetched"),
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, 304).when(n % 17 == 5, 404).otherwise(200).alias("status"),
        headers.alias("headers"), F.md5("html").alias("digest"))


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the records with its response, outcome and merged header."""
    found = revisits.resolve_revisits(archive_records(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical", "resolved_id", "outcome",
                        revisits.header_text(F.col("headers")).alias("headers"))


OP1_SQL = r"""
WITH base AS (
  SELECT page_id AS n, regexp_replace(url, '/[0-9]*([0-9])', '/\1') AS url, html FROM pages
), cut AS (
  SELECT n, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM base
), split AS (
  SELECT n, html,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''),
                                  ':(80|443)$', ''), '^(www|m)\.', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS path,
    list_sort([f for f in string_split(regexp_extract(u, '\?(.*)$', 1), '&')
      if f <> '' AND NOT regexp_matches(f, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')]) AS fields
  FROM cut
), rec AS (
  SELECT n, md5(html) AS digest, n % 3 = 1 AS revisit,
    CASE WHEN host <> '' THEN host || path ||
      CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical,
    (1700000000 + n * 7919 % 1000003) * 1000000000::HUGEINT + n AS at,
    CASE WHEN n % 4 <> 0 THEN '"e' || (n * 31 % 3) || '"' END AS tag,
    'day ' || (n % 2) AS changed, 'day ' || (n % 28) AS dat,
    CASE WHEN n % 5 = 0 THEN 'no-cache' END AS cache,
    CASE WHEN n % 3 = 1 THEN 304 WHEN n % 17 = 5 THEN 404 ELSE 200 END AS status
  FROM split
), found AS (
  SELECT v.n, v.canonical, r.n AS to_n,
    CASE WHEN r.n IS NULL THEN 'no_response'
         WHEN v.tag IS NOT NULL AND v.tag = r.tag THEN 'resolved'
         WHEN v.tag IS NULL AND v.changed = r.changed THEN 'resolved'
         ELSE 'validator_mismatch' END AS outcome,
    coalesce(v.cache, r.cache) AS cache, v.dat AS dat,
    coalesce('W/' || v.tag, r.tag) AS tag, v.changed AS changed
  FROM (SELECT * FROM rec WHERE revisit) v
  ASOF LEFT JOIN (SELECT * FROM rec WHERE status = 200) r ON v.canonical = r.canonical AND v.at > r.at
)
SELECT n AS record_id, canonical, CASE WHEN outcome = 'resolved' THEN to_n END AS resolved_id, outcome,
  CASE WHEN outcome = 'resolved' THEN
    coalesce('cache-control: ' || cache || chr(10), '') || 'content-type: text/html' || chr(10) || 'date: ' || dat
    || coalesce(chr(10) || 'etag: ' || tag, '') || chr(10) || 'last-modified: ' || changed END AS headers
FROM found
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes from each document."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op4_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from each document as parts of 200-byte strings that occur elsewhere."""
    return suffix_index.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by integer inner product for each hundredth vector."""
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its place there."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and chunks removed from each document, and the digest of what stays."""
    kept = line_chunks.dedupe_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_chunks", "n_removed", "n_removed_lines",
                       F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, u.i AS i, u.l AS line,
         ('0x' || substr(md5(u.l), 1, 7))::BIGINT AS h
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '') d,
       UNNEST(list_zip(range(len(ls)), ls)) AS z(s), LATERAL (SELECT s[1] AS i, s[2] AS l) u
), rolled AS (
  SELECT doc_id, i, line, max(i) OVER (PARTITION BY doc_id) AS last,
    ((coalesce(lag(h, 2) OVER w, 0) * 31 + coalesce(lag(h, 1) OVER w, 0)) % 2147483647 * 31 + h) % 2147483647 % 4 = 0
    OR coalesce(h = lag(h, 1) OVER w AND h = lag(h, 2) OVER w, false) AS cut
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), rows_of_cuts AS (
  SELECT *, min(i) OVER (PARTITION BY doc_id, cut, nth) AS begin FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, cut ORDER BY i) AS nth FROM rolled)
), ended AS (
  SELECT *, i = last OR (cut AND i < last - 1 AND (i - begin) % 2 = (begin = 0)::INT) AS ends FROM rows_of_cuts
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM ended
), chunks AS (
  SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY ALL
), marked AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n ORDER BY doc_id, chunk) > 1 AS gone FROM chunks
), done AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
    coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
    coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN done USING (doc_id)
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that each document leaks."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.secret_rows(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH patterns(nr, kind, pattern, part, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', '[A-Za-z0-9+/_.=-]+$', 6),
  (1, 'access', 'AKIA[A-Z0-9]+', '.*', 20), (2, 'hex', '[0-9a-f]+', '.*', 24), (3, 'run', '[A-Za-z0-9+/_-]{16,}', '.*', 16)
), texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT r, nr, kind, least, part, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS hits
  FROM texts, patterns WHERE regexp_matches(t, pattern)
), pieces AS (
  SELECT r, nr, kind, least, part, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS v, unnest(gaps[1:len(hits)]) AS g FROM cut
), placed AS (
  SELECT r, nr, kind, v, sum(length(g) + length(v)) OVER (PARTITION BY r, nr ORDER BY i)::BIGINT AS e,
    CASE WHEN nr = 0 THEN length(regexp_extract(regexp_replace(v, '^[^:=]*[:=]\x20*["'']?', ''), part)) ELSE length(v) END >= least AS ok
  FROM pieces
), base AS (
  SELECT r, nr, kind, e - length(v) AS s, e FROM placed WHERE ok AND nr < 3
), runs AS (
  SELECT r, e - length(v) AS s, v, CASE WHEN regexp_matches(v, '^[0-9A-Fa-f]+$') THEN 3
      WHEN regexp_matches(v, '^[A-Za-z0-9]+$') THEN 4 ELSE 5 END AS nr
  FROM placed WHERE nr = 3 AND regexp_matches(v, '[0-9][A-Za-z]')
    AND NOT regexp_matches(v, '^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|0123456789|abcdefgh|ABCDEFGH|EXAMPLE|[Ee]xample|[Xx]{6}')
), classed AS (
  SELECT *, CASE WHEN nr = 3 THEN lower(v) ELSE v END AS f, CASE WHEN nr = 3 THEN 16 ELSE 20 END AS w,
    CASE nr WHEN 3 THEN 2.75 WHEN 4 THEN 3.6 ELSE 3.8 END AS bits FROM runs
), slid AS (
  SELECT r, nr, s, w, bits, unnest(range(0, length(v) - w + 1)) AS o, f FROM classed
), rated AS (
  SELECT r, nr, s, w, o, list_sum(list_transform(map_values(list_aggregate(string_split(f[o + 1:o + w], ''), 'histogram')),
      lambda c: round(c * log2(c) * 1048576)::BIGINT)) <= floor(w * (log2(w) - bits) * 1048576) AS high FROM slid
), grouped AS (
  SELECT *, sum(CASE WHEN before IS NULL OR before + w < o THEN 1 ELSE 0 END) OVER (PARTITION BY r, s ORDER BY o) AS g FROM (
    SELECT *, lag(o) OVER (PARTITION BY r, s ORDER BY o) AS before FROM rated WHERE high)
), added AS (
  SELECT r, nr, ['entropy_hex', 'entropy_alnum', 'entropy_base64'][nr - 2] AS kind, s + min(o) AS s, s + max(o) + any_value(w) AS e
  FROM grouped GROUP BY r, nr, s, g
), every AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.s <= a.s AND b.e >= a.e)
), joined AS (
  SELECT r, count(*) FILTER (nr = 0) AS n_assign, count(*) FILTER (nr = 1) AS n_access, count(*) FILTER (nr = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nr) FILTER (nr < 3) AS b,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nr) AS spans FROM every GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (r)
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and proofs of all documents."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE bytes AS (
  SELECT *, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT) AS b FROM documents
), crc AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
      list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                  lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 5 = 0 AS hit
  FROM bytes
), texts AS (
  SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM crc
), leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS src,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(text2)) || ':' || text2, '-')) AS altered FROM texts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY src) AS n FROM leaves
), up AS (
  SELECT src, 0 AS lvl, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT src, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY src, lvl, n, pos // 16
), subs AS (
  SELECT src, d, row_number() OVER (ORDER BY encode(src)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lvl, pos, n, d FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1
  GROUP BY lvl, n, pos // 16
), runs AS (
  SELECT src, 0 AS tree, lvl, pos // 16 AS run, list(d ORDER BY pos) AS ds FROM up WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT lvl, pos // 16 AS run, list(d ORDER BY pos) AS ds FROM top WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.src, p.pos, 0 AS tree, lvl, p.pos // (16 ** lvl)::BIGINT % 16 AS slot, ds FROM placed p JOIN runs r
    ON p.src = r.src AND p.pos // (16 ** (lvl + 1))::BIGINT = r.run
  UNION ALL
  SELECT p.src, p.pos, 1, lvl, s.pos // (16 ** lvl)::BIGINT % 16, ds FROM placed p JOIN subs s ON p.src = s.src JOIN top_runs r
    ON s.pos // (16 ** (lvl + 1))::BIGINT = r.run
), paths AS (
  SELECT src, pos, list(array_to_string(ds[1:slot], '') || '|' || array_to_string(ds[slot + 2:], '') ORDER BY tree, lvl) AS path
  FROM steps GROUP BY ALL
), done AS (
  SELECT doc_id, leaf, subs.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root,
    sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(altered, coalesce(path, [])),
                lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM placed LEFT JOIN paths USING (src, pos) JOIN subs USING (src)
)
SELECT *, folded_root = root AS verified FROM done
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of five filters in all 120 orders, by language."""
    return filter_audit.audit_filters(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t
), marks AS (
  SELECT doc_id, part,
    len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e
  FROM texts JOIN firsts USING (t)
), known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map(['A','B','C','D','E'], [a,b,c,d,e]) AS m,
    a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails
  FROM marks LEFT JOIN known USING (doc_id)
), one AS (SELECT unnest(['A','B','C','D','E']) AS f),
orders AS (
  SELECT [v.f, w.f, x.f, y.f, z.f] AS o FROM one v, one w, one x, one y, one z
  WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5
), steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
groups AS (
  SELECT part, m, n_fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM docs GROUP BY ALL
), cells AS (
  SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, o[step] AS f,
    sum(n) FILTER (len([k FOR k IN o[1:step] IF m[k]]) = 0) AS kept,
    sum(n) FILTER (m[o[step]] AND len([k FOR k IN o[1:step - 1] IF m[k]]) = 0) AS removed,
    sum(n) FILTER (m[o[step]] AND len([k FOR k IN o[1:step - 1] IF m[k]]) > 0) AS redundant,
    sum(n) FILTER (m[o[step]] AND n_fails = 1) AS unique_fails,
    sum(g) FILTER (m[o[step]] AND len([k FOR k IN o[1:step - 1] IF m[k]]) = 0) AS good_lost,
    sum(x) FILTER (m[o[step]] AND len([k FOR k IN o[1:step - 1] IF m[k]]) = 0) AS toxic_lost
  FROM groups, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM cells
"""


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, coalesce(list_sum([p[1] * p[2] for p in list_zip(q.v, r.v)]), 0)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 100 = 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10
"""


def queries() -> dict[str, Query]:
    return {
        "op1_revisits": op1_revisits,
        "op2_toxicity": op2_toxicity,
        "op3_mixing": op3_mixing,
        "op4_suffix_index": op4_suffix_index,
        "op5_pii": op5_pii,
        "op6_topk": op6_topk,
        "op7_sharding": op7_sharding,
        "op8_near_dups": op8_near_dups,
        "op9_line_chunks": op9_line_chunks,
        "op10_decontamination": op10_decontamination,
        "op11_secrets": op11_secrets,
        "op12_merkle": op12_merkle,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_revisits": OP1_SQL, "op6_topk": OP6_SQL, "op9_line_chunks": OP9_SQL, "op11_secrets": OP11_SQL, "op12_merkle": OP12_SQL,
            "op13_filter_audit": OP13_SQL}
