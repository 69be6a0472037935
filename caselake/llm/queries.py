"""The registered queries of the text operators; each applies one to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.llm import bpe, html_text, infill, line_dedup, matroska, mixing, quality, secret_scan, simhash, simple8b, topk, toxicity, whitening
from caselake.llm.common import shared_folder, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def held_out(folds: int, fold: int):
    """Rows whose id's CRC-32, as text, leaves ``fold`` divided by ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds == fold


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, public_tokenizers.PATTERN)
    return token_digest(bpe.decode(encoded.select("doc_id", "ids"), BYTE_BPE, public_tokenizers.PATTERN)).drop("ids", "decoded")


def token_digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", "ids", "decoded",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    simple8b.write_ids(table(spark, sf_dir, "documents"), folder, WORD_BPE, END_ID)
    tokens = simple8b.add_crc32(simple8b.read_ids(spark, folder))
    return tokens.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = matroska.store_text(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media")
    read = matroska.packet_table(stored)
    payload, packets = F.col("demuxed.payload"), F.col("demuxed.packets")
    feature = F.concat_ws(
        ";", F.concat(F.lit("packets="), F.size(packets)), F.concat(F.lit("clusters="), F.col("demuxed.clusters")), F.concat(F.lit("laced="), F.col("demuxed.laced_blocks")),
        F.concat(F.lit("cues="), F.size("demuxed.cues")), F.concat(F.lit("last_ns="), F.array_max(F.transform(packets, lambda p: p["timestamp_ns"]))), F.concat(F.lit("first_byte="), packets[0]["offset"]),
    )
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.classify(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["rank"] == secret_scan.RANKS[kind])).cast("long")
    n = [count(k).alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select(F.col("id").alias("doc_id"), *n, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    each = rows.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return each.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(3, 1))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), held_out(5, 0))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restore(cut.select("doc_id", "infilled"), F.col("infilled.output"), F.col("infilled.form"))
    columns = ["n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return back.select("doc_id", *(f"infilled.{c}" for c in columns), F.col("restored.sha256").alias("restored_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "deduped.n_lines", "deduped.n_dropped", F.sha2("deduped.text", 256).alias("kept_sha256"))


def _spans_sql(kind: str) -> str:
    """Spans of one kind: the text is split at the matches, and lengths add up to positions."""
    pattern, least = secret_scan.KINDS[kind]
    quoted = pattern.replace("'", "''")
    return f"""SELECT row, doc_id, owner, {secret_scan.RANKS[kind]} AS rank, i,
        CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS e, length(m[i]) AS n, length(h[i]) AS head, substr(m[i], length(h[i]) + 1) AS value
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT row, doc_id, owner, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', 1) AS h, string_split_regex(t, '{quoted}') AS g FROM d)) WHERE length(m[i]) - length(h[i]) >= {least}"""


SECRETS_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(map(_spans_sql, secret_scan.KINDS))}),
    o AS (SELECT value, count(DISTINCT owner) AS named, count(DISTINCT owner) + max(CAST(owner IS NULL AS INTEGER)) AS owners, count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) AS repositories FROM s GROUP BY value),
    c AS (SELECT *, list_transform(string_split(value, ''), lambda x: ascii(x)) AS codes FROM o),
    f AS (SELECT *, len(list_distinct(codes)) >= {secret_scan.DISTINCT_SHARE} * least(length(value), 16) AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AS random,
        2 * len(list_filter(range(2, len(codes) + 1), lambda i: codes[i] - codes[i - 1] = 1)) >= length(value) AS up FROM c),
    v AS (SELECT value, CASE WHEN owners > 1 AND (named >= {secret_scan.EXAMPLE_OWNERS} AND repositories >= {secret_scan.EXAMPLE_REPOSITORIES} OR NOT random OR up) THEN {secret_scan.RANKS["example"]} WHEN random THEN {secret_scan.RANKS["live"]} END AS rank FROM f),
    a AS (SELECT row, rank, e - n AS b, e FROM s UNION SELECT row, v.rank, e - n + head, e FROM s JOIN v USING (value) WHERE v.rank IS NOT NULL),
    k AS (SELECT *, {list(secret_scan.RANKS)}[rank + 1] || ':' || b || ':' || e AS x FROM a),
    g AS (SELECT row, count_if(rank = 0) AS n_assign, count_if(rank = 1) AS n_access, count_if(rank = 2) AS n_hex, string_agg(x, ',' ORDER BY b, rank, e) FILTER (WHERE rank < 3) AS base, string_agg(x, ',' ORDER BY b, rank, e) AS spans FROM k GROUP BY row)
    SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)
"""

MIXING_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
    n AS (SELECT row, doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(t)) AS h FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
    w AS (SELECT *, {list(mixing.WEIGHTS)}[CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1 AS INTEGER)] AS weight, {mixing.ROUNDS} * source_size AS most FROM s),
    f AS (SELECT sum(most) OVER o AS full_words, sum(weight) OVER o AS full_weight, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights FROM w WINDOW o AS (ORDER BY most / weight, source)),
    l AS (SELECT CAST(greatest(max({mixing.BUDGET} * words / weights), coalesce(max(({mixing.BUDGET} * words - full_words) / (weights - full_weight)) FILTER (WHERE weights > full_weight), 0)) AS DOUBLE) AS level FROM f),
    p AS (SELECT doc_id, size, source_size, CAST(least(most, weight * level) AS DOUBLE) AS target, floor(weight * level) AS reached, sum(size) OVER (PARTITION BY n.source ORDER BY h, row ROWS UNBOUNDED PRECEDING) - size AS start FROM n JOIN w ON n.source IS NOT DISTINCT FROM w.source, l)
    SELECT doc_id, size, source_size, target, CAST({" + ".join(f"greatest(0, least(size, reached - start - {r} * source_size))" for r in range(mixing.ROUNDS))} AS BIGINT) AS taken FROM p
"""

def _draw_sql(i: int) -> str:
    return f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)"


INFILL_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
    c AS (SELECT *, len(u) AS n, {_draw_sql(0)} % (len(u) + 1) AS a, {_draw_sql(1)} % (len(u) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_draw_sql(2)} % 100 >= {infill.PLAIN_FROM} THEN 'plain'
             WHEN {_draw_sql(3)} % 100 < {infill.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT doc_id, n, form, t, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
        array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
    FROM p
"""

LINES_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {line_dedup.LEAST_CHARS} GROUP BY key
        HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) >= {line_dedup.LEAST_DOCUMENTS}),
    j AS (SELECT row, k.doc_id, line, i, keeper IS NULL OR k.doc_id IS NOT DISTINCT FROM keeper AS stays FROM k LEFT JOIN s USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
    FROM j GROUP BY row
"""

ORACLE_SQL = {
    "op12_fill_in_middle": INFILL_SQL,
    "op13_line_dedup": LINES_SQL,
    "op6_secret_scan": SECRETS_SQL,
    "op8_mixing": MIXING_SQL,
    "op7_exact_topk": """
        WITH v AS (
            SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, q.v AS query, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}


def queries() -> dict:
    found = [op1_html_extraction, op2_simhash, op3_byte_bpe, op4_token_files, op5_matroska, op6_secret_scan, op7_exact_topk, op8_mixing, op9_quality, op10_toxicity, op11_whitening, op12_fill_in_middle, op13_line_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
