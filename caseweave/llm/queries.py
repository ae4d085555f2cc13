"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, language, linededup, media, mixing, periodic, pieces, pii, secrets, sharding, simhash, suffixdedup
from .common import scratch, table


def op1_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.where("is_secret").select("doc_id", "source", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 4).alias("probability"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return media.read_back(media.store(texts).drop("text"))


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.assign_shards(crc, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[pii.listed(k) for k in pii.KINDS])
    more = F.transform("_added", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items, "contaminated")


def op8_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op9_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages by address, markup and text, and plain documents by source, declared language and text."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    plain = docs.select(F.col("doc_id").cast("long"), none.alias("page_id"), *[c.alias(k) for k, c in language.plain_evidence(F.col("source"), F.col("lang"), F.col("text")).items()])
    web = pages.select(none.alias("doc_id"), F.col("page_id").cast("long"), *[c.alias(k) for k, c in language.web_evidence(F.col("url"), F.col("html")).items()])
    scores = scratch(language.score(plain.unionByName(web), language.train(docs)).withColumn("declared", F.col("_declared")).withColumn("host", F.col("_host")), "language-scores")
    found = language.fuse(scores, language.evidence(scores))
    return found.select("doc_id", "page_id", "host", "declared", "language", F.round("probability", 6).alias("probability"), "accepted")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a periodic end in every tenth text, told by the CRC-32 of its id: from word a on, words of
    period p repeat. Null ids and texts without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_a", F.when(n > 0, F.pmod(g, n).cast("int"))).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    end = F.transform(F.sequence(F.lit(0), n - F.col("_a") - 1), lambda i: F.get("_w", F.col("_a") + i % F.col("_p")))
    text = F.when(n > 0, F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), end), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_h", "_w", "_a", "_p")


def op11_partition_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs)
    # The longest run; of equal ones the first, then the one of the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("_best", best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.failed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return audit.interactions(found, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def _audit_sql() -> str:
    """op13: counts by the set of failed filters, then every order over the 32 sets."""
    bit = lambda k: f"CASE WHEN {k} THEN 1 ELSE 0 END"
    return f"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), least AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
        ), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), m AS (
            SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
                   {bit("len(w) < 200")} + 2 * {bit("100 * len(list_distinct(w)) < 50 * len(w)")}
                   + 4 * {bit("100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t)")} + 8 * {bit("regexp_matches(t, '[#$%&*|]')")}
                   + 16 * {bit("first_id IS NOT NULL AND d.doc_id IS DISTINCT FROM first_id")} AS mask
            FROM d JOIN least USING (t) LEFT JOIN l ON l.doc_id = d.doc_id
        ), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask
        ), f(name, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
        ), o AS (
            SELECT [a.b, b.b, c.b, d.b, e.b] AS bits, a.name || b.name || c.name || d.name || e.name AS filter_order
            FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31
        ), s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM o, range(1, 6) AS r(step)
        ), x AS (
            SELECT part, filter_order, step, own, CAST(sum(n) FILTER (mask & (earlier + own) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0) AS BIGINT) AS removed,
                   CAST(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (mask = own) AS BIGINT) AS unique_fails,
                   CAST(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0) AS BIGINT) AS toxic_lost
            FROM c, s GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
               coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM x
    """


def _mix_sql(rounds: int = 12) -> str:
    """op8 as running sums in hash order. Each round takes what fits a source's rest, and goes on behind what doesn't; the
    operator goes on until nothing is open, SQL spells the rounds out."""
    parts = [
        """
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
        ), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s
        ), v AS (
            SELECT *, cap / w AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
            FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), f AS (SELECT arg_min(level, ratio) FILTER (cap > level * w) AS level FROM v
        ), t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * w) END AS target FROM v, f
        ), st0 AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base, target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS rest,
                   CAST(-1 AS BIGINT) AS frm, true AS open FROM t
        )"""
    ]
    for r in range(rounds):
        parts.append(f"""
        , fit{r} AS (
            SELECT st.source, d.h, rest, sum(d.size) AS n FROM d JOIN st{r} st ON d.source IS NOT DISTINCT FROM st.source AND st.open AND d.h > st.frm AND d.size <= st.rest GROUP BY st.source, d.h, rest
        ), run{r} AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM fit{r}
        ), x{r} AS (SELECT source, min(h) FILTER (upto > rest) AS hx, min_by(upto - n, h) FILTER (upto > rest) AS before, min_by(n, h) FILTER (upto > rest) AS nx FROM run{r} GROUP BY source
        ), y{r} AS (
            SELECT st.*, hx, before, coalesce((rest - before) * 2 >= nx, false) AS take FROM st{r} st LEFT JOIN x{r} x ON x.source IS NOT DISTINCT FROM st.source
        ), sp{r} AS (SELECT source, frm AS lo, CASE WHEN hx IS NULL THEN 1152921504606846976 ELSE hx + CAST(take AS INT) END AS hi, rest AS most FROM y{r} WHERE open
        ), st{r + 1} AS (
            SELECT source, source_size, target, base, CASE WHEN open AND hx IS NOT NULL THEN rest - before ELSE rest END AS rest, coalesce(hx, frm) AS frm,
                   open AND hx IS NOT NULL AND NOT take AND rest - before > {mixing.NEAR} * target AS open FROM y{r}
        )""")
    spans = " UNION ALL ".join(f"SELECT * FROM sp{r}" for r in range(rounds))
    return (
        "".join(parts)
        + f"""
        , spans AS ({spans})
        SELECT doc_id, d.size, source_size, target,
               CAST(d.size * least(3, base + CAST(EXISTS (SELECT 1 FROM spans WHERE spans.source IS NOT DISTINCT FROM d.source AND d.h > lo AND d.h < hi AND d.size <= most) AS INT)) AS BIGINT) AS taken
        FROM d JOIN st0 ON st0.source IS NOT DISTINCT FROM d.source
    """
    )


QUERIES = {f.__name__: f for f in (op1_simhash_trie, op2_secret_forest, op3_progressive_jpeg, op4_sampled_splitters, op5_bloom_lines, op6_weak_supervision, op7_suffix_arrays, op8_hash_threshold_mix, op9_bucket_pointers, op10_language_id, op11_partition_refinement, op12_merge_rounds, op13_filter_audit)}
SQL: dict[str, str] = {
    "op8_hash_threshold_mix": _mix_sql(),
    "op13_filter_audit": _audit_sql(),
    "op7_suffix_arrays": """
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT m FROM bw
        ), dw AS (
            SELECT i, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g
            FROM (SELECT i, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes)
        ), hits AS (SELECT dw.i, dw.p, dw.m, bw.item_id FROM dw JOIN bw USING (m, g)
        ), covered AS (
            SELECT i, count(DISTINCT q) AS n_hit FROM (SELECT i, unnest(range(p, p + m)) AS q FROM hits) GROUP BY i
        ), items AS (
            SELECT i, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT i, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY i
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (i) LEFT JOIN items USING (i)
    """,
    "op5_bloom_lines": """
        WITH lines AS (
            SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS id, i, unnest(l) AS line, unnest(range(len(l))) AS pos
            FROM (SELECT doc_id, row_number() OVER () AS i, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
        ), gone AS (
            SELECT k, max(id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT id) >= 3
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM (SELECT keyed.*, gone.k IS NOT NULL AND id <> keeper AS lost FROM keyed LEFT JOIN gone USING (k))
        GROUP BY doc_id, i
    """,
}
