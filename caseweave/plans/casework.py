"""More registered queries: scoping, drafting, privacy texts, searches of every hundredth row. See catalog.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.functions import text as T
from caseweave.operators import claims as claims_op
from caseweave.operators import drafting, graph, matrix, privacy, retrieval, scoping, workflow

from .catalog import _ROWS, _drafts, _order_documents, _order_rows, _t, query

# ---------------------------------------------------------------- searches


def _hundredths(spark, d) -> tuple[DataFrame, DataFrame]:
    vectors = _t(spark, d, "embeddings")
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), vectors


_NEAR = """
    WITH q AS (SELECT vec_id AS query_id, label AS owner, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, owner, vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS raw FROM embeddings, q),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw, vec_id) AS r FROM s)
"""


@query(f"{_NEAR}, u AS (SELECT query_id, vec_id, round(greatest(raw, 0), 6) AS distance FROM t WHERE r <= 8) SELECT *, CASE WHEN distance <= 0.28 THEN 'alta' WHEN distance <= 0.38 THEN 'media' ELSE 'bassa' END AS band FROM u")
def semantic_topk_all(spark, d):
    """Every vector whose id is divisible by 100 against all vectors, with relevance bands."""
    near = retrieval.nearest_all(*_hundredths(spark, d), 8)
    return near.withColumn("band", T.relevance_band(F.col("distance")))


@query(f"{_NEAR} SELECT query_id, vec_id, round(greatest(raw, 0), 6) AS distance FROM t WHERE r <= 8 AND round(greatest(raw, 0), 6) <= 0.65")
def topk_then_cut_off_all(spark, d):
    """The cut-off applies to each top k, not before it."""
    return retrieval.nearest_all(*_hundredths(spark, d), 8).where("distance <= 0.65")


# ---------------------------------------------------------------- scoping


def _nodes(spark, d):
    """The nodes, documents and cases of visible_nodes."""
    n, nation = F.col("c_nationkey"), _t(spark, d, "nation")
    nodes = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("concetto").alias("kind"), F.col("c_name").alias("label"), F.lit("").alias("summary"), F.when(n % 3 == 1, n).alias("doc_id"), F.when(n % 3 == 0, n).alias("case_id"))
    docs = nation.select(F.col("n_nationkey").alias("doc_id"), F.when(F.col("n_nationkey") == 4, 3).when(F.col("n_nationkey") == 1, None).otherwise(F.col("n_nationkey") + 100).cast("int").alias("creator_id"))
    return nodes, docs, nation.select(F.col("n_nationkey").alias("case_id"), F.col("n_nationkey").alias("owner_id"))


def _chain(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("key").alias("from_key"), (F.col("key") + 1).alias("to_key"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def owned_rows(spark, d):
    """Customers of nation 3 are the user's; nation 0 stands for no owner."""
    return scoping.owned(_t(spark, d, "customer").withColumn("owner", F.expr("nullif(c_nationkey, 0)")), "owner", 3).select("c_custkey")


@query("SELECT o_orderkey AS fragment_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3")
def deletable_fragments(spark, d):
    """Orders as fragments of customers, which nation 3 made."""
    docs = _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr("nullif(c_nationkey, 0)").alias("creator_id"))
    fragments = _t(spark, d, "orders").select(F.col("o_orderkey").alias("fragment_id"), F.col("o_custkey").alias("doc_id"))
    return scoping.deletable_fragments(fragments, docs, 3).select("fragment_id")


_DELETABLE = "SELECT c_custkey AS key FROM customer WHERE c_nationkey IN (3, 4)"


@query(_DELETABLE)
def deletable_nodes(spark, d):
    return scoping.deletable_nodes(*_nodes(spark, d), 3).select("key")


@query(f"WITH k AS ({_DELETABLE}) SELECT a.key AS from_key, b.key AS to_key FROM k a JOIN k b ON b.key = a.key + 1")
def deletable_edges(spark, d):
    nodes, docs, cases = _nodes(spark, d)
    return scoping.deletable_edges(_chain(nodes), nodes, docs, cases, 3)


_SEEN = "SELECT c_custkey AS key FROM customer WHERE c_nationkey = 3 OR c_nationkey IN (1, 4) OR c_nationkey % 3 = 2"


@query(f"WITH k AS ({_SEEN}) SELECT (SELECT count(*) FROM k) AS n_nodes, (SELECT count(*) FROM k a JOIN k b ON b.key = a.key + 1) AS n_edges")
def graph_counts(spark, d):
    nodes, docs, cases = _nodes(spark, d)
    return scoping.graph_counts(nodes, _chain(nodes), docs, cases, 3)


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' UNION ALL SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring')")
def category_and_title(spark, d):
    part = _t(spark, d, "part")
    return scoping.in_category(part, "Brand#12", "p_brand").unionByName(scoping.containing(part, "p_name", " RING ")).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 3")
def editor_events(spark, d):
    """Clicks and purchases stand for changes of drafts and reasonings."""
    kind = F.when(F.col("event_type") == "click", C.EDITOR_EVENTS[0]).when(F.col("event_type") == "purchase", C.EDITOR_EVENTS[1]).otherwise("altro")
    return scoping.editor_events(_t(spark, d, "events").withColumn("kind", kind)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'purchase' OR event_type IS NULL")
def open_comments(spark, d):
    """Events as comments; a purchase settles one."""
    return scoping.open_comments(_t(spark, d, "events").withColumn("resolved", F.col("event_type") == "purchase")).select("event_id")


@query(
    """
    WITH n AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS acc, count(*) FILTER (o_orderstatus = 'P') AS ver FROM orders GROUP BY 1)
    SELECT c_custkey AS case_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'running' WHEN coalesce(acc, 0) = 0 THEN 'no_documents' WHEN coalesce(ver, 0) > 0 AND c_acctbal < 0 THEN 'confirm_partial' ELSE 'start' END AS decision,
           CASE WHEN c_acctbal < 5000 THEN 'local' WHEN c_mktsegment = 'BUILDING' THEN 'external' ELSE 'refused' END AS model FROM customer LEFT JOIN n ON o_custkey = c_custkey
    """
)
def start_decisions(spark, d):
    counts = workflow.document_counts(_order_documents(spark, d))
    rows = _t(spark, d, "customer").withColumnRenamed("c_custkey", "case_id").join(counts, "case_id", "left")
    phase = F.when(F.col("c_mktsegment") == "MACHINERY", "in_corso").otherwise("completata")
    return rows.select("case_id", scoping.start_decision(phase, F.col("accepted"), F.col("to_verify"), F.col("c_acctbal") >= 0).alias("decision"), scoping.model_choice(F.col("c_acctbal") >= 5000, F.col("c_mktsegment") == "BUILDING").alias("model"))


@query("SELECT c_custkey AS doc_id, count(o_orderkey) AS n_fragments FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def fragment_counts(spark, d):
    return scoping.fragment_counts(_t(spark, d, "customer").withColumnRenamed("c_custkey", "doc_id"), _t(spark, d, "orders").withColumnRenamed("o_custkey", "doc_id"))


@query(
    """SELECT 'corpus' AS origin, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (0, 3)
       UNION ALL SELECT 'caso', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 3"""
)
def build_worklist(spark, d):
    corpus = _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_mktsegment") == "BUILDING", "completato").alias("state"), F.expr("nullif(c_nationkey, 0)").alias("creator_id"))
    cases = _t(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") == "F", "completata").alias("analysis_state"))
    return scoping.worklist(corpus, cases, "tutto", 3)


# ---------------------------------------------------------------- drafting


@query("SELECT o_orderkey AS fact_id, o_custkey AS case_id, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)), '') AS attachments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def fact_attachments(spark, d):
    o = _t(spark, d, "orders")
    claims = o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("case_id"))
    items = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").cast("string").alias("doc_id"))
    return drafting.facts_with_attachments(o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("claim_id")), claims, items).select("fact_id", "case_id", F.array_join("attachments", ",").alias("attachments"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_partkey <> 7 THEN l_partkey END, CASE WHEN l_suppkey NOT IN (l_partkey, 7) THEN l_suppkey END) AS ids, CASE l_returnflag WHEN 'A' THEN 'attore' WHEN 'R' THEN 'convenuto' ELSE l_returnflag END AS side FROM lineitem")
def attachment_ids_and_labels(spark, d):
    """Ids as text, a word and a repeat among them, against documents that lack number 7."""
    i = _t(spark, d, "lineitem")
    ids = drafting.valid_attachments(F.array(F.col("l_partkey").cast("string"), F.lit("x"), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")), F.filter(F.array(F.col("l_suppkey").cast("long"), F.col("l_partkey").cast("long")), lambda x: x != 7))
    return i.select("l_orderkey", "l_linenumber", F.array_join(ids.cast("array<string>"), ",").alias("ids"), drafting.label(F.col("l_returnflag"), {"A": "attore", "R": "convenuto"}).alias("side"))


@query(f"WITH {_ROWS} SELECT case_id, count(*) AS rows, count(*) FILTER (price <= 250000 OR n = 0 OR mx < 0.45 OR q OR (sup > 0 AND opp = 0 AND NOT nc) OR adv = 'controprovato' OR (adv = 'da_decidere' AND sup = 0) OR st <> 'F') AS rows_with_gaps, CAST(sum(n) AS BIGINT) AS sources FROM x GROUP BY 1")
def matrix_totals(spark, d):
    return drafting.matrix_totals(matrix.matrix(_order_rows(spark, d)))


@query(f"WITH {_ROWS} SELECT case_id, count(*) AS claims, count(*) FILTER (st = 'F') AS deepened, CAST(sum(CASE WHEN price > 250000 THEN 2 ELSE 0 END) AS BIGINT) AS attachments, CAST(sum(n) AS BIGINT) AS sources, count(*) FILTER (q) AS questions FROM x GROUP BY 1")
def claim_totals(spark, d):
    rows = _order_rows(spark, d).withColumn("state", F.when(F.col("reasoning") != "", "approfondita")).withColumn("attachments", F.when(F.col("burden") != "", F.array(F.lit(1), F.lit(2))))
    return drafting.claim_totals(rows)


@query(f"WITH {_ROWS} SELECT case_id, CAST(count(*) AS INT) AS n, string_agg(claim_id || ':' || CASE WHEN price > 250000 THEN 'onere' ELSE '' END || ':' || CASE WHEN q THEN 1 ELSE 0 END, ',' ORDER BY CAST(claim_id AS VARCHAR)) AS contents FROM x GROUP BY 1")
def claim_map(spark, d):
    rows = _order_rows(spark, d).withColumns({"ord": F.col("claim_id"), "kind": F.lit("domanda"), "text": F.lit("testo")})
    entry = lambda e: F.concat_ws(":", e["key"], e["value"]["burden"], F.size(e["value"]["open_questions"]).cast("string"))
    return drafting.claim_map(rows).select("case_id", F.size("contents").alias("n"), F.array_join(F.transform(F.map_entries("contents"), entry), ",").alias("contents"))


@query(
    """
    WITH l AS (SELECT o_custkey AS case_id, string_agg(o_orderpriority || CASE WHEN o_totalprice > 250000 THEN chr(10) || 'onere' ELSE '' END || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN chr(10) || 'quesito' ELSE '' END, chr(10) ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)
    SELECT c_custkey AS case_id, concat_ws(chr(10), CASE WHEN c_nationkey < 12 THEN c_name END, t) AS text FROM customer LEFT JOIN l ON case_id = c_custkey
    """
)
def graph_case_text(spark, d):
    drafts = _t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_nationkey") < 12, F.col("c_name")).otherwise("").alias("in_fact"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("text"))
    return drafting.case_text(drafts, _order_rows(spark, d).withColumn("ord", F.col("claim_id")).join(o, "claim_id"))


@query("SELECT c_custkey, c_nationkey % 4 IN (0, 3) AS stale FROM customer")
def stale_skeleton(spark, d):
    """Generated parts, blank ones, and two kinds that were worked on."""
    whole = " ".join(C.SKELETON_MARKS)
    n = F.col("c_nationkey") % 4
    part = F.when(n == 0, F.concat(F.lit("P.Q.M. "), F.lit(whole))).when(n == 1, F.lit(whole.replace("[DA DECIDERE]", "accoglie"))).when(n == 2, F.lit("rigetta")).otherwise(F.lit(" \n"))
    return _t(spark, d, "customer").select("c_custkey", drafting.skeleton_is_stale(part).alias("stale"))


@query(
    f"""
    WITH k AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'istruttoria' WHEN 'O' THEN 'difesa_eccezione' ELSE '' END AS kind FROM orders)
    SELECT o_orderkey, '{C.FALLBACK_START[0]}attore{C.FALLBACK_START[1]}' || o_orderpriority || '.' || CASE kind WHEN 'istruttoria' THEN '{C.FALLBACK_MIDDLE["istruttoria"].replace("'", "''")}' WHEN 'difesa_eccezione' THEN '{C.FALLBACK_MIDDLE["difesa_eccezione"].replace("'", "''")}'
           ELSE '{C.FALLBACK_MIDDLE[""].replace("'", "''")}' END || CASE WHEN o_totalprice > 250000 THEN ' onere' ELSE '' END || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '{C.FALLBACK_END}' ELSE '' END AS reasoning FROM k
    """
)
def fallback_reasoning(spark, d):
    o = _t(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "istruttoria").when(F.col("o_orderstatus") == "O", "difesa_eccezione").otherwise("")
    questions = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.array(F.lit("quesito"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", drafting.fallback_reasoning(F.lit("attore"), kind, F.col("o_orderpriority"), F.when(F.col("o_totalprice") > 250000, "onere").otherwise(""), questions).alias("reasoning"))


@query(
    """
    SELECT n_nationkey, CASE WHEN n_nationkey % 5 < 4 THEN 'Dai risultati incollati emerge ' || n_name ELSE n_name || ' La ricerca suggerisce' END AS lead,
           CASE WHEN n_nationkey % 3 = 0 THEN 'model_unreachable' WHEN n_nationkey % 3 = 1 THEN n_name ELSE '' END AS error FROM nation
    """
)
def lead_and_error_texts(spark, d):
    n = F.col("n_nationkey")
    opening = F.element_at(F.array(*[F.lit(x) for x in C.SEARCH_OPENINGS]), (F.least(n % 5, F.lit(3)) + 1).cast("int"))
    text = F.when(n % 5 < 4, F.concat(opening, F.lit(" "), F.col("n_name"))).otherwise(F.concat(F.col("n_name"), F.lit(" La ricerca suggerisce")))
    error = F.when(n % 3 == 0, F.concat(F.col("n_name"), F.lit(": Connection REFUSED (111)"))).when(n % 3 == 1, F.col("n_name"))
    return _t(spark, d, "nation").select("n_nationkey", drafting.manual_lead(text).alias("lead"), drafting.error_kind(error).alias("error"))


@query("SELECT n_regionkey AS case_id, string_agg('- ' || n_name || ': ' || n_nationkey || ' [' || CASE WHEN n_nationkey % 2 = 0 THEN 'fonte' ELSE '' END || ']', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def lead_lines(spark, d):
    rows = _t(spark, d, "nation").select(F.col("n_regionkey").alias("case_id"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("string").alias("summary"), F.when(F.col("n_nationkey") % 2 == 0, "fonte").alias("source"))
    return drafting.lead_lines(rows)


@query("SELECT o_custkey AS case_id, o_orderkey AS doc_id, o_orderpriority AS name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderdate, o_orderkey) AS INT) AS place FROM orders")
def chronology(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("ord"), F.col("o_orderdate").alias("created"), F.concat(F.lit("docs/"), F.col("o_orderpriority")).alias("file_name"))
    return drafting.chronology(rows)


@query(
    """
    WITH s AS (SELECT o_custkey AS case_id, o_orderkey AS claim_id, l_partkey AS doc_id, l_discount * 10 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT case_id, CAST(place AS INT) AS place, claim_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, claim_id, doc_id) AS place FROM s) WHERE place <= 5
    """
)
def key_evidence_by_case(spark, d):
    return drafting.key_evidence(_order_rows(spark, d)).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- texts


@query("SELECT doc_id, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '\\[[A-Z_]+_[0-9]+\\]', ' ', 'g')), '[^0-9a-zA-Z_\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}\\p{L}\\p{N}\\p{M}]+', ' ', 'g'), ' ') AS norm FROM documents")
def claim_norms(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.normalise_claim(F.col("text")).alias("norm"))


@query("SELECT doc_id, CASE WHEN contains(lower(coalesce(text, '')), 'appalto') THEN 'appalto' ELSE '' END AS tag, coalesce(len(text), 0) > 0 AND false AS foreign FROM documents WHERE NOT regexp_matches(lower(coalesce(text, '')), 'condomin|locazion|responsabil|inademp|risoluzion|pagamento')")
def case_tags(spark, d):
    """Documents without another tag's stem, and numbers that none of them can lack against itself."""
    rows = _t(spark, d, "documents").select("doc_id", T.case_tag(F.col("text")).alias("tag"), (F.size(T.foreign_numbers(F.col("text"), F.col("text"))) > 0).alias("foreign"))
    return rows.where(F.col("tag").isin("", "appalto"))


@query("SELECT o_orderkey AS claim_id, 'caso:' || o_custkey AS from_key, 'art ' || (o_orderkey % 50) || ' cc' AS to_key FROM orders WHERE o_orderstatus = 'F'")
def case_graph_edges(spark, d):
    """Orders cite an article that their text bears out when they are finished."""
    o = _t(spark, d, "orders").withColumn("label", F.concat(F.lit("Art. "), F.col("o_orderkey") % 50, F.lit(" CC")))
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("visto l'"), F.col("label"))).otherwise("niente").alias("text"))
    edges = graph.case_edges(cases, o.select(F.col("o_orderkey").alias("case_id"), "label"))
    back = o.select(F.concat(F.lit("caso:"), F.col("o_orderkey")).alias("from_key"), F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("caso:"), F.col("o_custkey")).alias("case_key"))
    return edges.join(back, "from_key").select("claim_id", F.col("case_key").alias("from_key"), "to_key")


@query("SELECT o_orderkey, l_partkey, CASE WHEN l_linenumber = 1 THEN 'decisiva' ELSE 'debole' END AS rating FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def rated_sources(spark, d):
    """The rating of each order's first line item is set."""
    item = F.struct(F.col("l_linenumber").cast("string").alias("anchor"), F.col("l_partkey").alias("doc_id"), F.lit("debole").alias("rating"))
    lists = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(item).alias("sources"))
    rated = lists.select("o_orderkey", F.explode(workflow.rate_source(F.col("sources"), F.lit("1"), F.lit("decisiva"))).alias("s"))
    return rated.join(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("s.doc_id").alias("l_partkey"), F.col("s.rating").alias("rating"))


@query("SELECT o_orderkey, 'Il signor [PRIVATE_PERSON_1] paga ' || o_orderpriority || ' a [PRIVATE_PERSON_1].' AS masked, o_orderstatus = 'F' AS ok FROM orders")
def masked_texts(spark, d):
    """Names put back as placeholders, and a report on the masked text; finished orders leave nothing else."""
    o = _t(spark, d, "orders")
    known = F.array(F.struct(F.lit("[PRIVATE_PERSON_1]").alias("ph"), F.lit("Mario Rossi").alias("value")))
    masked = privacy.mask_residuals(F.concat(F.lit("Il signor Mario Rossi paga "), F.col("o_orderpriority"), F.lit(" a  ROSSI .")), known)
    tail = F.when(F.col("o_orderstatus") == "F", "").otherwise(" rossi [NIENTE]")
    report = privacy.privacy_report(F.concat(F.lit("Il signor [PRIVATE_PERSON_1] paga"), tail), known, F.array().cast("array<string>"))
    return o.select("o_orderkey", masked.alias("masked"), report["ok"].alias("ok"))


@query("SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus = 'F' THEN 'penale_ritardo' WHEN o_orderstatus = 'P' THEN 'detto' ELSE 'domanda:attore' END AS burden FROM orders")
def burdens(spark, d):
    """A generated burden is kept, put right for late delivery, or replaced where it brings in a foreign number."""
    s = F.col("o_orderstatus")
    claim = F.when(s == "F", "penale per ritardo").otherwise("pagamento")
    said = F.when(s == "F", "prova non imputabile").when(s == "P", "detto").otherwise("paga 1.000,00 entro il 3/4/2024")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), claims_op.burden(F.lit("domanda"), F.lit("attore"), claim, said).alias("burden"))


@query("SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus = 'F' THEN o_custkey || '' ELSE '' END AS attachments, CASE WHEN o_orderstatus = 'O' THEN 'motivo' ELSE '' END AS reasoning FROM orders")
def deepened_claims(spark, d):
    """Answers on claims: attachments of other cases fall away; reasonings that the model gave stay."""
    o, none = _t(spark, d, "orders"), F.array().cast("array<string>")
    claims = o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("case_id"), F.lit("attore").alias("party"), F.lit("domanda").alias("kind"), F.lit("pagamento").alias("text"),
        F.array(F.lit("x"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-1 - F.col("o_custkey")).cast("string")).alias("attachments"), F.lit("").alias("burden"),
        F.when(F.col("o_orderstatus") == "O", "motivo").alias("reasoning"), none.alias("not_contested"), none.alias("open_questions"))
    docs = _t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_custkey").cast("long").alias("doc_id"), F.lit("attore").alias("section"), F.lit("").alias("text"))
    out = drafting.deepen(claims, docs)
    return out.select("claim_id", F.array_join(F.col("attachments").cast("array<string>"), ",").alias("attachments"), F.when(F.startswith("reasoning", F.lit("La richiesta")), "").otherwise(F.col("reasoning")).alias("reasoning"))


@query("SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus = 'O' THEN 'scritto' ELSE 'calcolato' END AS kept FROM orders")
def stored_or_computed(spark, d):
    o = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "claim_id")
    claims = o.select("claim_id", F.when(F.col("o_orderstatus") == "O", F.array(F.lit("scritto"))).otherwise(F.array().cast("array<string>")).alias("sources"))
    return drafting.stored_or_computed(claims, o.select("claim_id", F.array(F.lit("calcolato")).alias("sources"))).select("claim_id", F.element_at("sources", 1).alias("kept"))
