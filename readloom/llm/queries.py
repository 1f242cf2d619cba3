"""Registered queries of the text operators and the SQL that gives their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontam, htmltext, langid, licenses, linededup, neardup, ngramlm, packing, quality, tokenfile, turnrepair, vectorcodes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.quality_rules(docs, labels)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "threshold"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's licences: their names, the best match and its Dice coefficient."""
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"))))
    return out.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licenses"),
        F.concat_ws(",", F.transform("matches", lambda m: m["license"])).alias("licenses"),
        best["license"].alias("best_license"),
        F.coalesce(best["dice"], F.lit(0.0)).alias("best_dice"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    out = decontam.decontaminate(docs, items)
    listed = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcodes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return found.rows.select("vec_id", "code", "error", "label_error", F.lit(found.sha256).alias("codebooks_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turnrepair.damage(table(spark, sf_dir, "conversations"))
    return turnrepair.repair_conversations(damaged).summary.select(turnrepair.COLUMNS)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenfile.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_license_scan,
        op3_html_extraction,
        op4_line_dedup,
        op5_decontamination,
        op6_warc,
        op7_lm_scoring,
        op8_language_id,
        op9_packing,
        op10_near_duplicates,
        op11_vector_codes,
        op12_turn_repair,
        op13_token_files,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, n, line, trim({_LOWER.format("line")}, {_SPACE}) AS k
  FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n
    FROM documents)),
heavy AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last IS NOT NULL AND last <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN heavy USING (k) GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))

OP5_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS t, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM iw WHERE len(w) > 0)),
cut AS (
  SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s
  FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (
  SELECT doc_id, s, n, item_id
  FROM (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS t FROM cut) JOIN windows USING (n, t)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS i
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(i, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM m
"""

_D = "CAST(list_sum(list_transform(range(1, len(n.x) + 1), lambda i: (n.x[i] - b.e[i]) * (n.x[i] - b.e[i]))) AS BIGINT)"


def _near(k: int) -> str:
    return f"SELECT v, p, any_value(x) AS x, min((d, k)) AS best FROM (SELECT n.v, n.p, n.x, b.k, {_D} AS d FROM parts n JOIN b{k} b USING (p)) GROUP BY v, p"


def _round(k: int) -> str:
    """Codebooks b<k+1> of a round over codebooks b<k>."""
    return f"""a{k} AS MATERIALIZED ({_near(k)}),
s{k} AS (SELECT p, k, i, CAST(sum(c) AS HUGEINT) AS s, count(*) AS n FROM (
  SELECT p, best[2] AS k, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM a{k}) GROUP BY p, k, i),
m{k} AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{k} GROUP BY p, k),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.e, b.e) AS e FROM b{k} b LEFT JOIN m{k} m USING (p, k)),"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS v, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT v, p, z[p * len(z) // 4 + 1 : (p + 1) * len(z) // 4] AS x FROM kept, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, v - 1 AS k, x AS e FROM parts WHERE v <= 256),
{"".join(_round(k) for k in range(4))}
final AS ({_near(4)}),
coded AS (SELECT v, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM final GROUP BY v),
book AS (SELECT sha256(string_agg(c, ',' ORDER BY p, k, i)) AS codebooks_sha256
         FROM (SELECT p, k, unnest(range(len(e))) AS i, CAST(unnest(e) AS VARCHAR) AS c FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (v), book
"""


def _edit(state: str, cost: str, letter: str, line: str = "") -> str:
    """A state (cost, audit, repaired lines) after an edit."""
    return f"{{'c': {state}.c + {cost}, 'w': {state}.w || '{letter}', 'r': {f'list_append({state}.r, {line})' if line else f'{state}.r'}}}"


_NEVER = "{'c': 1000000000000, 'w': '', 'r': CAST(NULL AS VARCHAR[])}"


def _into(state: str, initial: str, role: str) -> str:
    kept, made = _edit(state, "more", "K", "role || ':' || text"), _edit(state, "more + 3", "R", f"'{role}:' || text")
    return f"CASE WHEN stays AND i = '{initial}' THEN {kept} WHEN stays THEN {made} ELSE {_NEVER} END"


def _insert(state: str, role: str) -> str:
    return _edit(state, "3", "I", f"'{role}:'")


OP12_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) x(b))),
told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
             lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM told)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n, substr(role, 1, 1) AS i, trim(text, {_SPACE}) AS bare
  FROM damaged),
turns AS MATERIALIZED (
  SELECT conv_id, n, turn, role, text, i, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS i0,
         CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM numbered),
counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i0 || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id),
fold AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'w': '', 'r': CAST([] AS VARCHAR[])}} AS e, {_NEVER} AS s,
         {{'c': CAST(3 AS BIGINT), 'w': 'I', 'r': ['user:']}} AS u, {{'c': CAST(6 AS BIGINT), 'w': 'II', 'r': ['user:', 'assistant:']}} AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, n, e, s, u, least(a, {_insert("u", "assistant")}) FROM (
    SELECT conv_id, n, e, s, least(u, {_insert("e", "user")}, {_insert("s", "user")}, {_insert("a", "user")}) AS u, a FROM (
      SELECT conv_id, n, {_edit("e", "4", "D")} AS e,
             least({_edit("s", "4", "D")}, CASE WHEN stays AND i = 's' THEN {_edit("e", "more", "K", "role || ':' || text")} ELSE {_NEVER} END) AS s,
             least({_edit("u", "4", "D")}, {_into("b", "u", "user")}) AS u, least({_edit("a", "4", "D")}, {_into("u", "a", "assistant")}) AS a
      FROM (SELECT f.conv_id, t.n, e, s, u, a, least(e, s, a) AS b, t.i, t.role, t.text,
                   coalesce(t.fault NOT IN ('blank', 'duplicate'), true) AS stays, CASE WHEN t.fault = 'truncated' THEN 3 ELSE 0 END AS more
            FROM fold f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.n = f.n + 1)))),
best AS (
  SELECT f.conv_id, gaps, blank, duplicate, truncated, illegal, least(e, a) AS x
  FROM fold f LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM f.conv_id WHERE f.n = coalesce(c.n, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, x.c AS cost, x.w AS audit, sha256(array_to_string(x.r, chr(10))) AS repaired_sha256
FROM best
"""

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_turn_repair": OP12_SQL,
}
