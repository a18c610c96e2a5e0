"""One query per operator over its whole table, with production parameters, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, decontaminate, fill_middle, heap_clusters, language_id, line_dedup, mixing, repetition, seed_extend, simhash_anchor, suffix_dedup, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "finish")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("keep")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchor.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text)
    return chat_windows.read_back(chat_windows.windows(turns.unionByName(more)))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (fill_middle.restore(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.seed_extend_dedup(table(spark, sf_dir, "documents"))


def op13_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_clusters.heap_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_mixing": op3_mixing,
    "op4_repetition": op4_repetition,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_chat_windows": op10_chat_windows,
    "op11_fill_middle": op11_fill_middle,
    "op12_seed_extend": op12_seed_extend,
    "op13_heap_clusters": op13_heap_clusters,
}

def _repetition_sql() -> str:
    """Words, lines and windows as rows; a window found twice in its document covers its words."""
    sizes = ", ".join(f"({n})" for n in repetition.MAX_COVERAGE)
    shares = ", ".join(f"CAST(coalesce(c{n}, 0) AS DOUBLE) / greatest(word_chars, 1) AS coverage_{n}" for n in repetition.MAX_COVERAGE)
    limits = " AND ".join(
        f"coverage_{n} <= CASE WHEN n_repeat_runs >= {repetition.MANY_RUNS} THEN {repetition.MANY_COVERAGE[n]} ELSE {most} END" for n, most in repetition.MAX_COVERAGE.items()
    )
    sums = ", ".join(f"sum(chars) FILTER (size = {n}) AS c{n}" for n in repetition.MAX_COVERAGE)
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
sizes(size) AS (VALUES {sizes}),
windows AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS p FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS k FROM docs, sizes)),
repeated AS (SELECT doc_id, size, p FROM windows GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, size, unnest(range(k, k + size)) AS i FROM windows JOIN repeated USING (doc_id, size, p)),
covered AS (SELECT doc_id, {sums}, count(*) FILTER (size = 5) AS n_repeat_words FROM (SELECT doc_id, size, length(word) AS chars FROM hit JOIN words USING (doc_id, i)) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) AS runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS previous FROM hit WHERE size = 5) WHERE previous IS NULL OR previous < i - 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)),
marked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS line_chars FROM marked WHERE again GROUP BY doc_id),
base AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM docs),
joined AS (
    SELECT base.*, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, {shares},
        CAST(coalesce(line_chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS line_coverage, CAST(coalesce(runs, 0) AS BIGINT) AS n_repeat_runs
    FROM base LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN runs USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND line_coverage <= {repetition.MAX_LINE_COVERAGE} AND {limits} AS kept
FROM joined"""


def _clusters_sql() -> str:
    """Every round written out: nearest centroid by (distance, number), then floor means of non-empty clusters."""
    k, rounds, width, scale, seed = heap_clusters.K, heap_clusters.ROUNDS, heap_clusters.DIMENSIONS, heap_clusters.SCALE, heap_clusters.SEED

    def assigned(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (
    SELECT r, arg_min(j, [d, j]) AS j, CAST(min(d) AS BIGINT) AS d
    FROM (SELECT r, j, list_sum(list_transform(range(1, {width} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM kept, c{r}) GROUP BY r)"""

    def moved(r: int) -> str:
        return f"""
c{r + 1} AS MATERIALIZED (
    SELECT c{r}.j, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
        SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m
        FROM (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM kept JOIN a{r} USING (r), range(1, {width} + 1) AS p(i) GROUP BY j, i) GROUP BY j) AS means ON c{r}.j = means.j)"""

    steps = ",".join(assigned(r) + "," + moved(r) for r in range(rounds))
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
kept AS MATERIALIZED (
    SELECT r, vec_id, list_transform(x, lambda e: CAST(floor({scale} * e) AS HUGEINT)) AS v FROM rows
    WHERE len(x) = {width} AND len(list_filter(x, lambda e: isfinite(e))) = {width}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT v, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept) ORDER BY h, v LIMIT {k}),{steps},{assigned(rounds)},
per AS (SELECT j, sum(d) AS s FROM a{rounds} GROUP BY j)
SELECT vec_id, CAST(a{rounds}.j AS INTEGER) AS cluster, d AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM per) AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN per ON per.j = a{rounds}.j JOIN c{rounds} ON c{rounds}.j = a{rounds}.j"""


ORACLES: dict[str, str] = {
    "op1_suffix_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT r, unnest(range(0, greatest(length(x) // 2 - 399, 0))) AS p, x FROM docs),
short_windows AS (SELECT r, p, md5(substr(x, 2 * p + 1, 512)) AS m FROM (SELECT r, unnest(range(0, greatest(length(x) // 2 - 255, 0))) AS p, x FROM docs)),
short_starts AS (SELECT r, p FROM short_windows JOIN (SELECT m FROM short_windows GROUP BY m HAVING count(*) > 1) USING (m)),
short AS (SELECT r, CAST(sum(least(256, q - p)) AS BIGINT) AS again FROM (SELECT r, p, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p), p + 256) AS q FROM short_starts) GROUP BY r),
windows AS (SELECT r, p, md5(substr(x, 2 * p + 1, 800)) AS m FROM places),
twice AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
starts AS (SELECT r, p FROM windows JOIN twice USING (m)),
heads AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS head FROM starts),
runs AS (SELECT r, p, sum(head) OVER (PARTITION BY r ORDER BY p) AS run FROM heads),
spans AS (SELECT r, run, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY r, run),
gone AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY r),
kept AS (
    SELECT docs.r, doc_id, x, coalesce(n, 0) AS n, coalesce(k, 0) AS k,
        CASE WHEN k IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda i: substr(x, 2 * CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END + 1,
            2 * (CASE WHEN i > len(a) THEN length(x) // 2 ELSE a[i] END - CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END))), '') END AS rest
    FROM docs LEFT JOIN gone USING (r))
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS n_removed, CAST(k AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256,
    coalesce(again, 0) AS n_repeated
FROM kept LEFT JOIN short USING (r)""",
    "op2_decontaminate": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS k FROM items)),
places AS (
    SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS p
    FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS k FROM words, (SELECT DISTINCT size FROM patterns))),
found AS (SELECT doc_id, item_id, k, size FROM places JOIN patterns USING (size, p)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS i FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_mixing": r"""
WITH sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sizes GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM per),
limits AS (SELECT *, CAST(3 * s AS DOUBLE) / w AS full_at FROM ranked),
levels AS (
    SELECT *, row_number() OVER o AS place,
        (CAST(sum(s) OVER () AS DOUBLE) - CAST(coalesce(sum(3 * s) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM limits WINDOW o AS (ORDER BY full_at, source NULLS LAST)),
opens AS (SELECT min_by(level, place) AS lvl FROM levels WHERE level <= full_at),
targets AS (SELECT source, s, CASE WHEN lvl IS NULL OR full_at <= lvl THEN CAST(3 * s AS DOUBLE) ELSE lvl * w END AS target FROM levels CROSS JOIN opens),
placed AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sizes)
SELECT doc_id, size, s AS source_size, target,
    CAST(greatest(0, least(size, floor(target) - b)) + greatest(0, least(size, floor(target) - b - s)) + greatest(0, least(size, floor(target) - b - 2 * s)) AS BIGINT) AS taken,
    CASE WHEN target > 0 THEN CAST(b + size AS DOUBLE) / target END AS finish
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source""",
    "op4_repetition": _repetition_sql(),
    "op5_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < keeper) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id""",
    "op6_url_filter": r"""
WITH cut AS (SELECT page_id, url, position('://' IN url) AS p FROM pages),
rest AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS r FROM cut),
parts AS (
    SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
    SELECT page_id, arg_max(rh || rp, length(rh) * 10000 + length(rp)) AS rule, arg_max(verdict, length(rh) * 10000 + length(rp)) AS verdict
    FROM parts JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
    "op10_chat_windows": r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
    SELECT *, 1 + CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
        23 + length(regexp_replace(role, '<([|~])', '<~\1', 'g')) + length(regexp_replace(text, '<([|~])', '<~\1', 'g')) AS chars FROM given),
placed AS (
    SELECT *, row_number() OVER o AS idx, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS after
    FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
systems AS (SELECT conv_id, min(idx) AS s_idx, arg_min(tokens, idx) AS s_tokens, arg_min(chars, idx) AS s_chars FROM placed WHERE role = 'system' GROUP BY conv_id),
cut AS (
    SELECT p.*, after - tokens AS before, s_idx, s_chars, greatest(1024 - 256 - coalesce(s_tokens, 0), 256) AS step
    FROM placed p LEFT JOIN systems s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
marked AS (
    SELECT *, coalesce((before // step) <> lag(before // step) OVER w OR ((after - 1) // step) <> lag((after - 1) // step) OVER w, true) AS starts,
        min(idx) OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN 256 PRECEDING AND CURRENT ROW) AS lo
    FROM cut WINDOW w AS (PARTITION BY conv_id ORDER BY before)),
framed AS (
    SELECT m.conv_id, m.idx, 17 + any_value(CASE WHEN m.s_idx < m.lo THEN m.s_chars ELSE 0 END) + coalesce(sum(h.chars), 0) AS extra
    FROM marked m LEFT JOIN marked h ON m.conv_id IS NOT DISTINCT FROM h.conv_id AND h.idx >= m.lo AND h.idx < m.idx WHERE m.starts GROUP BY m.conv_id, m.idx),
extras AS (SELECT conv_id, sum(extra) AS extra FROM framed GROUP BY conv_id)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) + any_value(extra) AS BIGINT) AS formatted_chars
FROM placed p JOIN extras e ON p.conv_id IS NOT DISTINCT FROM e.conv_id GROUP BY p.conv_id""",
    "op11_fill_middle": r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
    SELECT *, len(l) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM docs),
cut AS (
    SELECT *, array_to_string(l[1 : least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1 : n], '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM cut""",
    "op12_seed_extend": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT r, doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS m FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 19, 0) + 1)) AS k FROM docs)),
ranked AS (SELECT r, k, row_number() OVER (PARTITION BY m ORDER BY doc_id, k) AS place FROM windows),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 20)) AS i FROM ranked WHERE place > 1),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)""",
    "op13_heap_clusters": _clusters_sql(),
}
