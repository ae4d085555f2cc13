"""All registered queries of the library and the SQL that gives the same rows.

The reference's tables (cases, claims, facts, nodes) are not among the driver's, so each operator runs on the table
of the closest shape; which one is said beside it. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.functions import sequence as S
from caseweave.functions import text as T
from caseweave.operators import claims as claims_op
from caseweave.operators import evidence, graph, matrix, privacy, retrieval, workflow
from caseweave.sources import files, portable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return _t(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


_DISTANCE = "round(greatest(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0), 6)"


# ---------------------------------------------------------------- retrieval


@query(f"SELECT vec_id, {_DISTANCE} AS distance, CASE WHEN {_DISTANCE} <= 0.28 THEN 'alta' WHEN {_DISTANCE} <= 0.38 THEN 'media' ELSE 'bassa' END AS band FROM embeddings ORDER BY 2, 1 LIMIT 8")
def semantic_topk(spark, d):
    """Nearest vectors to vector 0 (vectors stand for corpus fragments), with relevance bands."""
    top = retrieval.nearest(_t(spark, d, "embeddings"), _first_vector(spark, d), 8)
    return top.select("vec_id", "distance", T.relevance_band(F.col("distance")).alias("band"))


@query(f"SELECT vec_id, label, {_DISTANCE} AS distance FROM embeddings WHERE label = 0 ORDER BY 3, 1 LIMIT 20")
def semantic_topk_scoped(spark, d):
    """Top k among the vectors that a user may see; the label stands for the owner."""
    top = retrieval.nearest(retrieval.visible(_t(spark, d, "embeddings"), "label", 0), _first_vector(spark, d), 50)
    return top.select("vec_id", "label", "distance")


@query(f"WITH t AS (SELECT vec_id, {_DISTANCE} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 8) SELECT * FROM t WHERE distance <= 0.65")
def topk_then_cut_off(spark, d):
    """The cut-off applies to the top k, not before it."""
    return retrieval.nearest(_t(spark, d, "embeddings"), _first_vector(spark, d), 8, cut_off=0.65).select("vec_id", "distance")


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    f"""
    WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10) || chr(10)), 1) AS i FROM documents),
    q AS (SELECT doc_id, i, {_TRIM.format("raw")} AS b FROM p),
    r AS (SELECT doc_id, i, j, substr(b, CAST(j AS INT) + 1, 800) AS chunk FROM (SELECT *, unnest(range(0, length(b), 800)) AS j FROM q WHERE b <> '')),
    e AS (SELECT doc_id, 0 AS i, 0 AS j, '' AS chunk FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INT) AS ord, chunk FROM (SELECT * FROM r UNION ALL SELECT * FROM e)
    """
)
def chunk_documents(spark, d):
    return retrieval.chunk_documents(_t(spark, d, "documents"))


@query("SELECT conv_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), 1, 16000) AS context FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def compose_context(spark, d):
    """Documents of a case in order, capped; conversations stand for cases."""
    return retrieval.compose(_t(spark, d, "conversations"), "conv_id", ["turn"], "text")


_FLAT = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@query(
    f"""
    SELECT doc_id, substr(text, 1, 240) AS snippet, CASE WHEN length({_FLAT}) <= 320 THEN {_FLAT} ELSE regexp_replace(substr({_FLAT}, 1, 317), '^\\s+|\\s+$', '', 'g') || '...' END AS opening,
           CASE WHEN source IS NULL THEN 'globale' WHEN lang = 'en' THEN 'caso' ELSE 'corpus' END AS origin FROM documents
    """
)
def snippet_projection(spark, d):
    docs = _t(spark, d, "documents")
    origin = F.when(F.col("source").isNull(), F.lit("globale")).when(F.col("lang") == "en", F.lit("caso")).otherwise(F.lit("corpus"))
    return docs.select("doc_id", F.substring("text", 1, 240).alias("snippet"), T.opening_text(F.col("text")).alias("opening"), origin.alias("origin"))


# ---------------------------------------------------------------- text and privacy


@query(
    r"""
    SELECT doc_id, unnest(l) AS value, CAST(generate_subscripts(l, 1) - 1 AS INT) AS ord
    FROM (SELECT doc_id, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS l FROM documents)
    """
)
def email_entities(spark, d):
    found = F.regexp_extract_all("text", F.lit(C.PII["EMAIL"]), F.lit(0))
    return _t(spark, d, "documents").select("doc_id", F.posexplode(found).alias("ord", "value"))


@query(
    r"""
    SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\b\d{1,3}(?:[.\s]\d{3})+(?:,\d+)?\b|\b\d+/\d{2,4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b'),
           lambda x: regexp_replace(x, '[€\s]', '', 'g')))) AS number FROM documents
    """
)
def number_entities(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(T.sensitive_numbers(F.col("text"))).alias("number"))


@query(
    r"""
    WITH e AS (SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS l FROM documents))
    SELECT doc_id, '[EMAIL_' || n || ']' AS placeholder, value, max(n) OVER (PARTITION BY doc_id) AS last FROM e
    """
)
def placeholder_numbering(spark, d):
    rows = email_entities(spark, d).withColumn("n", (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).cast("long"))
    named = rows.withColumn("placeholder", F.concat(F.lit("[EMAIL_"), F.col("n").cast("string"), F.lit("]")))
    last = privacy.placeholder_counters(named.withColumnRenamed("doc_id", "case_id")).select(F.col("case_id").alias("doc_id"), F.col("last").cast("long").alias("last"))
    return named.join(last, "doc_id").select("doc_id", "placeholder", "value", "last")


@query(
    r"""
    SELECT doc_id, regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g') AS masked, true AS restored
    FROM documents WHERE regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')
    """
)
def mask_and_restore(spark, d):
    """Numbered placeholders for emails and back; numbers are taken off for the comparison."""
    docs = _t(spark, d, "documents").select("doc_id", "text").where(F.rlike("text", F.lit(C.PII["EMAIL"])))
    spans = F.filter(privacy.pattern_spans(F.col("text")), lambda s: s["group"] == "EMAIL")
    done = privacy.number_placeholders(docs.withColumn("spans", spans))
    back = F.aggregate("entities", F.col("masked"), lambda s, e: F.replace(s, e["ph"], e["value"]))
    return done.select("doc_id", F.regexp_replace("masked", r"\[EMAIL_\d+\]", "[EMAIL]").alias("masked"), (back == F.col("text")).alias("restored"))


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß'']+'), lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ('chiede','domanda','parte','attore','convenuto','rigetto','accertare','contratto','euro')))"


@query(f"SELECT item_id, len({_TOKENS.format('text')}) AS n_tokens, list_sort({_TOKENS.format('text')})[1] AS first_token FROM benchmark")
def relevance_tokens(spark, d):
    rows = _t(spark, d, "benchmark").select("item_id", F.array_sort(T.relevance_tokens(F.col("text"))).alias("t"))
    return rows.select("item_id", F.size("t").cast("long").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"))


@query(
    f"""
    WITH c AS (SELECT item_id AS claim_id, {_TOKENS.format("text")} AS t FROM benchmark), cx AS (SELECT claim_id, len(t) AS n, unnest(t) AS token FROM c),
    s AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents),
    h AS (SELECT claim_id, n, doc_id, count(*) AS common FROM s JOIN cx USING (token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY common DESC, doc_id) AS rank FROM h)
    SELECT claim_id, doc_id, common, round(common / n, 6) AS overlap, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5
    """
)
def evidence_overlap_topk(spark, d):
    """Benchmark items stand for claims, documents for evidence."""
    return evidence.overlap_trace(_t(spark, d, "benchmark").withColumnRenamed("item_id", "claim_id"), _t(spark, d, "documents"))


@query(
    r"""
    WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
    SELECT doc_id, CAST(s AS INT) AS start, CAST(least(90, n - s) AS INT) AS n_words FROM (SELECT doc_id, n, unnest(CASE WHEN n = 0 THEN [] WHEN n <= 90 THEN [0] ELSE range(0, n, 70) END) AS s FROM w)
    """
)
def ocr_segments(spark, d):
    """Windows of 90 words, 70 apart, over whole documents."""
    return _t(spark, d, "documents").select("doc_id", F.explode(T.word_windows(F.col("text"))).alias("w")).select("doc_id", "w.*")


@query("SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id")
def duplicate_first_seen(spark, d):
    """The text stands for the file name."""
    return workflow.first_seen(_t(spark, d, "documents"), F.sha2("text", 256), ["doc_id"], "doc_id")


@query(
    r"""
    WITH m AS (SELECT p_partkey AS doc_id, p_name AS label, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, p_type AS summary FROM part WHERE trim(p_name) <> '')
    SELECT key, 'concetto' AS kind, min_by(label, doc_id) AS label, min_by(summary, doc_id) AS summary, min(doc_id) AS doc_id FROM m WHERE key <> '' GROUP BY key
    """
)
def entity_key_merge(spark, d):
    """Part names stand for concept labels."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("seq"), F.lit("concetto").alias("kind"), F.col("p_name").alias("label"), F.col("p_type").alias("summary"))
    return graph.merge_nodes(part).select("key", "kind", "label", "summary", "doc_id")


# ---------------------------------------------------------------- workflow


def _order_documents(spark, d):
    """Orders as documents of a customer: status F accepted, P to verify, others processing."""
    o = _t(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") != "O").alias("pseudonymised"),
        F.when(F.col("o_orderstatus") == "F", "verificato").otherwise("da_verificare").alias("acceptance"), F.when(F.col("o_orderstatus") == "O", "in_corso").otherwise("completata").alias("extraction_state"),
        F.lit("completata").alias("anonymisation_state"), F.col("o_orderpriority").alias("file_name"), F.col("o_orderkey").alias("ord"),
    )


@query(
    """
    SELECT o_custkey AS case_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS processing, count(*) FILTER (o_orderstatus <> 'O') AS pseudonymised,
           count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS to_verify FROM orders GROUP BY o_custkey
    """
)
def workflow_counts(spark, d):
    return workflow.document_counts(_order_documents(spark, d))


@query("SELECT case_id, doc_id, name, first_id FROM (SELECT o_custkey AS case_id, o_orderkey AS doc_id, lower(o_orderpriority) AS name, min(o_orderkey) OVER (PARTITION BY o_custkey, lower(o_orderpriority)) AS first_id FROM orders) WHERE doc_id <> first_id")
def duplicate_names(spark, d):
    return workflow.duplicate_names(_order_documents(spark, d))


@query("SELECT o_orderkey AS doc_id, o_custkey AS case_id FROM orders WHERE o_orderstatus = 'F'")
def usable_documents(spark, d):
    return workflow.usable(_order_documents(spark, d)).select("doc_id", "case_id")


@query(
    """
    WITH e AS (SELECT event_id, user_id, event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, user_id, before, after FROM e WHERE before IS NOT NULL AND NOT (before = 'view' AND after = 'click') AND NOT (before = 'click' AND after = 'purchase') AND NOT (before = after)
    """
)
def transition_violations(spark, d):
    """Events of a user stand for states of a case; the table of legal transitions is the events' own."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("after"), F.lag("event_type").over(w).alias("before")).where("before IS NOT NULL")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in (("view", "click"), ("click", "purchase"))]))
    legal = spark.range(1).select(steps.alias("s")).select("s.*")
    return workflow.illegal_transitions(e.where("before <> after"), legal).select("event_id", "user_id", "before", "after")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_rows_anti(spark, d):
    """Customers without orders stand for claims without a fact row."""
    return workflow.missing_rows(_t(spark, d, "customer"), _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def ledger_latest(spark, d):
    return workflow.latest(_t(spark, d, "events"), 40).select("event_id", "user_id", "event_type", "value")


@query(
    """
    WITH e AS (SELECT event_id, user_id, event_type, props, lag(event_id) OVER w AS p, lag(event_type) OVER w AS t, lag(props) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, concat_ws(',', CASE WHEN event_type IS DISTINCT FROM t THEN 'event_type' END, CASE WHEN props IS DISTINCT FROM q THEN 'props' END) AS fields
    FROM e WHERE p IS NOT NULL AND (event_type IS DISTINCT FROM t OR props IS DISTINCT FROM q)
    """
)
def change_capture(spark, d):
    """Names of the fields in which an event differs from its user's last one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    now = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("props"), F.col("props"))
    rows = _t(spark, d, "events").select("event_id", "user_id", now.alias("after"), F.lag(now).over(w).alias("before")).where("before IS NOT NULL")
    fields = F.array_join(F.array_sort(F.map_keys(workflow.changed_fields(F.col("before"), F.col("after")))), ",")
    return rows.select("event_id", "user_id", fields.alias("fields")).where("fields <> ''")


# ---------------------------------------------------------------- matrix


def _order_rows(spark, d, *more):
    """Orders as claims of a customer, their line items as traced sources, with ``more`` columns of orders.

    Score: discount times ten; section by return flag (A the claimant's, R the opponent's, N common); an urgent order
    is marked proven, one without priority has an open question, and a finished one has its reasoning.
    """
    o, items = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    section = F.when(F.col("l_returnflag") == "A", "attore").when(F.col("l_returnflag") == "R", "convenuto").otherwise("generici")
    score = F.col("l_discount") * 10
    source = F.struct(F.col("l_partkey").alias("doc_id"), section.alias("section"), score.alias("score"), T.reliability(score).alias("reliability"), F.when(F.col("l_linestatus") == "O", "decisiva").alias("rating"), F.lit("").alias("anchor"))
    sources = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(source)).alias("sources"))
    some = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    return o.join(sources, "o_orderkey", "left").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("fact_id"), F.lit("attore").alias("party"),
        F.when(F.col("o_totalprice") > 250000, "onere").otherwise("").alias("burden"), F.when(F.col("o_orderstatus") == "F", "motivo").otherwise("").alias("reasoning"),
        some(F.col("o_orderpriority") == "4-NOT SPECIFIED", "quesito").alias("open_questions"), some(F.col("o_orderpriority") == "5-LOW", "pacifico").alias("not_contested"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "provato").when(F.col("o_orderpriority") == "2-HIGH", "insufficiente").otherwise("da_verificare").alias("proof_state"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "silente").when(F.col("o_orderpriority") == "5-LOW", "non_contestato").otherwise("da_decidere").alias("adversarial_state"),
        F.lit("").alias("adversarial_note"), "sources", F.when(F.col("o_totalprice") < 50000, 0.5).otherwise(0.8).alias("confidence"), *more,
    )


def _drafts(spark, d):
    """A customer with an even nation has an operative part."""
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_nationkey") < 12, "dispositivo").otherwise("").alias("operative_part"))


_ROWS = """
    s AS (SELECT l_orderkey, count(*) AS n, max(l_discount * 10) AS mx, count(*) FILTER (l_returnflag <> 'R') AS sup, count(*) FILTER (l_returnflag = 'R') AS opp,
                 count(*) FILTER (l_discount * 10 < 0.45) AS weak, count(*) FILTER (l_linestatus = 'O') AS decisive FROM lineitem GROUP BY 1),
    m AS (SELECT o_custkey AS case_id, o_orderkey AS claim_id, o_orderpriority AS p, o_orderstatus AS st, o_totalprice AS price, coalesce(n, 0) AS n, coalesce(mx, 0) AS mx, coalesce(sup, 0) AS sup,
                 coalesce(opp, 0) AS opp, coalesce(weak, 0) AS weak, coalesce(decisive, 0) AS decisive, o_orderpriority = '4-NOT SPECIFIED' AS q, o_orderpriority = '5-LOW' AS nc FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
    x AS (SELECT *, CASE WHEN sup > 0 AND opp > 0 THEN 'contestato' WHEN opp > 0 THEN 'controprovato' WHEN sup > 0 AND nc THEN 'non_contestato' WHEN sup > 0 THEN 'silente' ELSE 'da_decidere' END AS adv,
                 CASE WHEN n = 0 OR mx < 0.45 THEN 'insufficiente' WHEN q THEN 'da_decidere' ELSE 'da_verificare' END AS proof FROM m)
"""
_ISSUES = f"""
    WITH {_ROWS}, d AS (SELECT c_custkey AS case_id, c_nationkey < 12 AS part FROM customer),
    i AS (
        SELECT case_id, claim_id, 'R1' AS rule, 'alta' AS severity FROM x WHERE n = 0
        UNION ALL SELECT case_id, claim_id, 'R2', 'media' FROM x WHERE n > 0 AND mx < 0.45
        UNION ALL SELECT case_id, claim_id, 'R3', 'alta' FROM x WHERE p = '1-URGENT' AND proof = 'insufficiente'
        UNION ALL SELECT case_id, claim_id, 'R4', 'media' FROM x WHERE p = '1-URGENT' AND q
        UNION ALL SELECT case_id, claim_id, 'R5', 'bassa' FROM x WHERE p = '3-MEDIUM'
        UNION ALL SELECT case_id, claim_id, 'R6', 'alta' FROM x WHERE opp > 0 AND nc
        UNION ALL SELECT case_id, claim_id, 'R7', 'media' FROM x WHERE st <> 'F'
        UNION ALL SELECT case_id, claim_id, 'R8', 'alta' FROM x WHERE st = 'F' AND p = '2-HIGH'
        UNION ALL SELECT case_id, NULL, CASE WHEN coalesce(part, false) THEN 'R10' ELSE 'R9' END, 'alta' FROM (SELECT case_id, max(CASE WHEN st <> 'F' THEN 1 ELSE 0 END) AS miss FROM x GROUP BY 1) FULL JOIN d USING (case_id)
            WHERE NOT coalesce(part, false) OR miss = 1
    )
"""


@query(
    f"""WITH {_ROWS} SELECT claim_id, CAST(n AS INT) AS n_sources, round(mx, 6) AS max_score, CASE WHEN n = 0 THEN 'assente' WHEN mx >= 0.68 THEN 'alta' WHEN mx >= 0.38 THEN 'media' ELSE 'bassa' END AS max_reliability,
           CAST(sup AS INT) AS n_support, CAST(opp AS INT) AS n_opponent, adv AS suggested_adversarial, proof AS suggested_proof FROM x"""
)
def evidence_matrix(spark, d):
    m = matrix.matrix(_order_rows(spark, d))
    return m.select("claim_id", "n_sources", F.round("max_score", 6).alias("max_score"), "max_reliability", "n_support", "n_opponent", "suggested_adversarial", "suggested_proof")


@query(
    f"""
    WITH {_ROWS} SELECT claim_id, concat_ws(',', CASE WHEN price <= 250000 THEN 'burden' END, CASE WHEN n = 0 THEN 'no_source' END, CASE WHEN n > 0 AND mx < 0.45 THEN 'weak_source' END, CASE WHEN q THEN 'open_questions' END,
        CASE WHEN sup > 0 AND opp = 0 AND NOT nc THEN 'no_opponent_source' END, CASE WHEN adv = 'controprovato' THEN 'opponent_only' END, CASE WHEN adv = 'da_decidere' AND sup = 0 THEN 'unreadable' END, CASE WHEN st <> 'F' THEN 'reasoning' END) AS gaps FROM x
    """
)
def gap_list(spark, d):
    return matrix.matrix(_order_rows(spark, d)).select("claim_id", F.array_join("gaps", ",").alias("gaps"))


@query(f"{_ISSUES} SELECT case_id, coalesce(claim_id, -1) AS claim_id, rule, severity FROM i")
def rule_issues(spark, d):
    """Issues of the whole case have claim -1."""
    issues = matrix.red_team(_order_rows(spark, d), _drafts(spark, d))
    return issues.select("case_id", F.coalesce("claim_id", F.lit(-1)).alias("claim_id"), "rule", "severity")


@query(f"{_ISSUES} SELECT case_id, count(*) AS total, count(*) FILTER (severity = 'alta') AS alta, count(*) FILTER (severity = 'media') AS media, count(*) FILTER (severity = 'bassa') AS bassa FROM i GROUP BY case_id")
def severity_counts(spark, d):
    return matrix.severity_counts(matrix.red_team(_order_rows(spark, d), _drafts(spark, d)))


# ---------------------------------------------------------------- cascades, web and JSON


@query(
    """
    SELECT item_id, CASE WHEN contains(l, 'riconvenzional') THEN 'riconvenzionale' WHEN contains(l, 'contest') OR contains(l, 'rigett') THEN 'difesa_eccezione' WHEN contains(l, 'prova') OR contains(l, 'ctu') THEN
           (CASE WHEN contains(l, 'penale') OR contains(l, 'condann') OR contains(l, 'pagamento') OR contains(l, 'risarc') OR contains(l, 'accert') OR contains(l, 'applicare') THEN 'domanda' ELSE 'istruttoria' END) ELSE 'domanda' END AS kind
    FROM (SELECT item_id, lower(text) AS l FROM benchmark)
    """
)
def class_cascade(spark, d):
    return _t(spark, d, "benchmark").select("item_id", T.claim_kind(F.col("text"), F.lit("attore")).alias("kind"))


@query(
    r"""
    SELECT page_id, host, CASE WHEN url = '' THEN 'non_indicata' WHEN contains(host, 'studio') OR contains(host, 'blog') THEN 'bassa' ELSE 'media' END AS trust
    FROM (SELECT page_id, coalesce(url, '') AS url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages)
    """
)
def url_trust(spark, d):
    return _t(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.url_trust(F.col("url")).alias("trust"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def html_results(spark, d):
    return _t(spark, d, "pages").select("page_id", files.plain_text(F.col("html")).alias("body"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object(T.json_object(F.col("props")), "$.k").try_cast("long").alias("k"))


_LINKS = r"""l AS (SELECT page_id, regexp_replace(url, '^[a-z]+://([^/?#]*).*$', '\1') AS host, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="([^"]*)"', 1)) AS href FROM pages)"""


@query(rf"WITH {_LINKS}, e AS (SELECT DISTINCT 'p' || page_id AS a, href AS b FROM l) SELECT node, count(*) AS degree, round(4 + 2.2 * sqrt(count(*)), 6) AS size FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node")
def link_graph_degree(spark, d):
    return graph.degrees(_link_edges(spark, d))


def _link_edges(spark, d):
    links = files.links(_t(spark, d, "pages"))
    return links.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("from_key"), F.col("href").alias("to_key"), F.lit("cita").alias("kind"))


@query(rf"WITH {_LINKS} SELECT DISTINCT 'p' || page_id AS other FROM l WHERE href = '/the'")
def neighbours(spark, d):
    return graph.neighbours(_link_edges(spark, d), "/the")


@query(rf"WITH {_LINKS}, k AS (SELECT 'p' || page_id AS key FROM pages WHERE page_id % 2 = 0 UNION SELECT href FROM l WHERE length(href) <= 6) SELECT DISTINCT 'p' || page_id AS from_key, href AS to_key FROM l WHERE 'p' || page_id IN (SELECT key FROM k) AND href IN (SELECT key FROM k)")
def visible_edges(spark, d):
    """A user sees even pages and short targets."""
    e = _link_edges(spark, d).distinct()
    even = _t(spark, d, "pages").where("page_id % 2 = 0").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"))
    keys = even.unionByName(e.where(F.length("to_key") <= 6).select(F.col("to_key").alias("key"))).distinct()
    return graph.visible_edges(e, keys).select("from_key", "to_key")


@query("SELECT o_custkey AS case_id, o_orderkey AS old_id, count(l_partkey) AS n_attachments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def id_remap_roundtrip(spark, d):
    """Customers as cases: exported to JSON with their orders (claims) and parts (documents), imported with new ids."""
    o, items = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    joined = items.join(o, items["l_orderkey"] == o["o_orderkey"])
    cases = _t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title"))
    none = F.lit(None).cast("string")
    docs = joined.select(F.col("o_custkey").alias("case_id"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").alias("doc_id"), F.lit("generici").alias("section"), none.alias("file_name"), none.alias("text")).distinct()
    own = joined.groupBy("o_orderkey").agg(F.collect_list(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")).alias("attachments"))
    claims = o.join(own, "o_orderkey", "left").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("claim_id"), F.lit("attore").alias("party"), F.col("o_orderkey").cast("string").alias("text"), F.lit("domanda").alias("kind"), "attachments")
    _, back, attached = portable.import_cases(portable.export_cases(cases, docs, claims))
    n = attached.groupBy("claim_id").agg(F.count("*").alias("n"))
    return back.join(n, "claim_id", "left").select("case_id", F.col("text").cast("long").alias("old_id"), F.coalesce("n", F.lit(0)).alias("n_attachments"))


# ---------------------------------------------------------------- smaller operators


@query("SELECT o_custkey AS case_id, l_orderkey AS claim_id, l_partkey AS doc_id, round(l_discount * 10, 6) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey ORDER BY l_discount DESC, l_orderkey, l_partkey, l_linenumber LIMIT 5")
def key_evidence(spark, d):
    """The five best sources over all claims."""
    items, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    rows = items.join(o, items["l_orderkey"] == o["o_orderkey"]).orderBy(F.desc("l_discount"), "l_orderkey", "l_partkey", "l_linenumber").limit(5)
    return rows.select(F.col("o_custkey").alias("case_id"), F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("doc_id"), F.round(F.col("l_discount") * 10, 6).alias("score"))


@query("SELECT o_custkey AS case_id, string_agg(n || '. ' || o_orderpriority, chr(10) ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def operative_skeleton(spark, d):
    o = _t(spark, d, "orders")
    return workflow.operative_skeleton(o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("text")))


@query(
    """
    WITH dc AS (SELECT o_custkey AS case_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS proc, count(*) FILTER (o_orderstatus = 'F') AS acc, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS ver,
                       count(*) FILTER (o_orderpriority = '1-URGENT') AS deep, count(*) FILTER (o_totalprice > 250000) AS reasoned FROM orders GROUP BY 1)
    SELECT c_custkey AS case_id, coalesce(total, 0) AS documents, coalesce(acc, 0) AS ready, coalesce(ver, 0) AS to_verify, coalesce(proc, 0) AS processing, coalesce(acc > 0 AND proc = 0, false) AS can_start,
           coalesce(acc > 0 AND ver > 0, false) AS can_start_in_part, c_mktsegment = 'BUILDING' AS analysed, coalesce(total, 0) AS claims, coalesce(deep, 0) AS deepened, coalesce(reasoned, 0) AS reasoned, c_nationkey < 12 AS operative_part
    FROM customer LEFT JOIN dc ON case_id = c_custkey
    """
)
def case_checklist(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_mktsegment") == "BUILDING", "completata").otherwise("in_attesa").alias("analysis_state"))
    own = o.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "approfondita").otherwise("estratta").alias("state"), F.when(F.col("o_totalprice") > 250000, "x").otherwise("").alias("reasoning"))
    return workflow.checklist(cases, _order_documents(spark, d), own, _drafts(spark, d))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus <> 'O' THEN 'accettato_senza_verifica' ELSE 'da_verificare' END AS acceptance FROM orders")
def bulk_accept(spark, d):
    """Documents verified before are set back as well."""
    return workflow.bulk_accept(_order_documents(spark, d)).select("doc_id", "acceptance")


@query(
    r"""
    SELECT doc_id, lang || '/' || CASE WHEN n = 1 THEN b ELSE regexp_extract(b, '^(.*?)(\.[^.]*)?$', 1) || '_' || n || regexp_extract(b, '^(.*?)(\.[^.]*)?$', 2) END AS entry
    FROM (SELECT doc_id, lang, source || '.txt' AS b, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)
    """
)
def archive_names(spark, d):
    """Entry names of an archive: a section (language) and a file name (source), later ones numbered."""
    docs = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("section"), F.concat("source", F.lit(".txt")).alias("file_name"))
    return files.safe_names(docs).select("doc_id", "entry")


@query("SELECT doc_id, length(replace(replace(coalesce(text, ''), ' ', ''), chr(10), '')) / greatest(n_chars // 2000, 1) >= 20 AS native, length(trim(coalesce(text, ''))) < 3 AS doubtful, lang = 'fr' OR n_chars < 100 AS low FROM documents")
def extraction_flags(spark, d):
    """Native-text test (2,000 characters a page), doubtful text, and low confidence."""
    docs = _t(spark, d, "documents")
    unsure = F.when(F.col("lang") == "fr", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return docs.select(
        "doc_id", files.native_pdf(F.col("text"), F.expr("n_chars div 2000")).alias("native"), files.doubtful_page(F.col("text")).alias("doubtful"), files.low_confidence(unsure, F.when(F.col("n_chars") < 100, 0.5).otherwise(0.9)).alias("low")
    )


@query(
    """
    SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'insufficiente' WHEN page_id % 5 = 0 THEN 'media' WHEN contains(host, 'studio') OR contains(host, 'blog') THEN 'bassa' ELSE 'media' END AS reliability,
           CASE WHEN contains(l, 'normattiva') OR contains(l, 'gazzettaufficiale') OR contains(l, 'art.') OR contains(l, 'codice') OR contains(l, 'd.lgs') OR contains(l, 'legge') THEN 'norma'
                WHEN contains(l, 'cassazione') OR contains(l, 'tribunale') OR contains(l, 'corte') OR contains(l, 'sentenza') OR contains(l, 'ordinanza') THEN 'giurisprudenza'
                WHEN contains(l, 'massima') OR contains(l, 'principio di diritto') THEN 'massima' WHEN contains(l, 'rivista') OR contains(l, 'commento') OR contains(l, 'dottrina') OR contains(l, 'autore') THEN 'dottrina'
                WHEN page_id % 5 = 0 THEN 'materiale manuale' ELSE 'fonte web' END AS kind
    FROM (SELECT page_id, lower(html) AS l, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages)
    """
)
def research_leads(spark, d):
    """Pages as leads: every seventh insufficient, every fifth manual without an address."""
    p = _t(spark, d, "pages")
    manual = F.col("page_id") % 5 == 0
    url = F.when(manual, F.lit("")).otherwise(F.col("url"))
    return p.select("page_id", T.lead_reliability(url, F.col("page_id") % 7 == 0, manual).alias("reliability"), T.source_kind(F.col("html"), manual).alias("kind"))


@query("SELECT event_id, coalesce(greatest(0, least(1, value / 20)), 0.65) AS confidence, CAST(round_even(greatest(0, least(1, value / 50)) * 100, 0) AS INT) AS percent FROM events WHERE value IS NOT NULL")
def confidence_and_progress(spark, d):
    e = _t(spark, d, "events").where("value IS NOT NULL")
    return e.select("event_id", T.confidence((F.col("value") / 20).cast("string")).alias("confidence"), T.percent(F.col("value"), F.lit(50)).alias("percent"))


@query("SELECT c_custkey AS key, CASE WHEN c_nationkey % 3 = 0 THEN 'caso' WHEN c_nationkey % 3 = 1 THEN 'corpus' ELSE 'globale' END AS origin FROM customer WHERE (c_nationkey % 3 = 0 AND c_nationkey = 3) OR (c_nationkey % 3 = 1 AND c_nationkey IN (1, 4)) OR c_nationkey % 3 = 2")
def visible_nodes(spark, d):
    """Customers as nodes: a third belong to a case (nation 3 is the user's), a third to a document (1 is global, 4 the user's)."""
    n = F.col("c_nationkey")
    nodes = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("concetto").alias("kind"), F.col("c_name").alias("label"), F.lit("").alias("summary"), F.when(n % 3 == 1, n).alias("doc_id"), F.when(n % 3 == 0, n).alias("case_id"))
    nation = _t(spark, d, "nation")
    docs = nation.select(F.col("n_nationkey").alias("doc_id"), F.when(F.col("n_nationkey") != 1, F.col("n_nationkey")).alias("creator_id"))
    docs = docs.withColumn("creator_id", F.when(F.col("doc_id") == 4, F.lit(3)).otherwise(F.col("creator_id") + F.when(F.col("doc_id") == 3, 100).otherwise(0)))
    cases = nation.select(F.col("n_nationkey").alias("case_id"), F.col("n_nationkey").alias("owner_id"))
    return graph.project(graph.visible_nodes(nodes, docs, cases, 3)).select("key", "origin")


@query("SELECT p_partkey AS key, p_name AS label FROM part WHERE contains(lower(p_name || ' ' || p_partkey || ' ' || p_type || ' ' || p_brand), 'ring') ORDER BY p_partkey LIMIT 8")
def node_search(spark, d):
    nodes = _t(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("kind"), F.col("p_name").alias("label"), F.col("p_brand").alias("summary"))
    return graph.search(nodes, "RING").select("key", "label")


@query("SELECT DISTINCT lower(replace(c_name, '#', ' ')) AS from_key, lower(o_orderpriority[3:]) AS to_key, CASE o_orderstatus WHEN 'F' THEN 'cita' ELSE 'correlato' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def merged_edges(spark, d):
    """Customer to priority, with unknown kinds as ``correlato``."""
    o, c = _t(spark, d, "orders").where("o_orderpriority <> '4-NOT SPECIFIED'"), _t(spark, d, "customer")
    e = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("seq"), F.col("c_name").alias("from_label"), F.substring("o_orderpriority", 3, 20).alias("to_label"), F.when(F.col("o_orderstatus") == "F", "cita").otherwise("x").alias("kind"))
    return graph.merge_edges(e).select("from_key", "to_key", "kind")


@query()
def rag_context(spark, d):
    """Vectors with their document's text; the label stands for the owner."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = _t(spark, d, "embeddings").join(docs, "vec_id").withColumnRenamed("label", "owner")
    return retrieval.rag_context(rows, _first_vector(spark, d), 0)


# ---------------------------------------------------------------- no SQL equivalent


@query()
def evidence_trace(spark, d):
    """Full trace, sequence ratio included: every benchmark item as a claim against all documents, as those of one case.

    Parties, kinds and attachments go by the item's number, sections by language.
    """
    docs, n = _t(spark, d, "documents"), F.col("item_id")
    section = F.when(F.col("lang") == "en", "attore").when(F.col("lang") == "de", "convenuto").otherwise("generici")
    evidence_docs = docs.select("doc_id", F.lit(1).alias("case_id"), section.alias("section"), "text")
    kind = F.when(n % 3 == 0, "istruttoria").when(n % 3 == 1, "riconvenzionale").otherwise("domanda")
    claims = _t(spark, d, "benchmark").select(n.alias("claim_id"), F.lit(1).alias("case_id"), F.when(n % 2 == 0, "attore").otherwise("convenuto").alias("party"), kind.alias("kind"), "text", F.array(n, n * 3).alias("attachments"))
    return evidence.trace(claims, evidence_docs).select("claim_id", "doc_id", "pos", "score", "reliability", "rank", "anchor", F.array_join("terms", " ").alias("terms"), F.array_join("numbers", " ").alias("numbers"))


@query()
def registry(spark, d):
    """All documents of a source as a case: pattern spans, numbered placeholders, and one registry a case."""
    docs = _t(spark, d, "documents")
    done = privacy.pseudonymise(docs.select("doc_id", F.xxhash64("source").alias("case_id"), F.col("doc_id").alias("ord"), "text"))
    return privacy.case_registry(done, counts=True).select("case_id", "doc_id", "n_entities", F.length("text").alias("n_chars"))


@query()
def claim_dedup(spark, d):
    """Conversation turns and benchmark items as the claims of one case, a role a party."""
    items = _t(spark, d, "benchmark").select(F.lit(1).alias("case_id"), F.col("item_id").alias("seq"), F.lit("attore").alias("party"), "text")
    turns = _t(spark, d, "conversations").select(F.lit(2).alias("case_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("role").alias("party"), "text")
    return claims_op.drop_near_duplicates(items.unionByName(turns)).select("case_id", "seq", "party")


@query()
def communities(spark, d):
    return graph.communities(_link_edges(spark, d))


@query()
def entity_keys(spark, d):
    """Normal forms of customer names."""
    return _t(spark, d, "customer").select("c_custkey", S.entity_key(F.col("c_name")).alias("key"))
