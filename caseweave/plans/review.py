"""Queries of the review of a case: actions on issues, readiness, dashboards, contexts and edits. See catalog.py.

Orders stand for claims of a customer's case, their line items for traced sources. Each claim has a fact, every second one
two, the later of which stands first; claims are ordered by their number's last two digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.functions import text as T
from caseweave.operators import drafting, matrix, retrieval, workflow

from .catalog import _ROWS, _drafts, _order_documents, _order_rows, _t, query


def _claims(spark, d, *more) -> DataFrame:
    return _order_rows(spark, d, *more).withColumns({"claim_ord": F.col("claim_id") % 100, "ord": F.col("claim_id") % 100})


def _facts(spark, d) -> DataFrame:
    """Matrix rows: the fact of _order_rows, and for odd claims another one before it."""
    rows = _claims(spark, d, F.col("o_totalprice").alias("_price")).drop("fact_id", "ord")
    first = F.struct((2 * F.col("claim_id")).alias("fact_id"), F.lit(1).alias("fact_ord"), F.col("proof_state"), F.col("adversarial_state"))
    other = F.struct((2 * F.col("claim_id") + 1).alias("fact_id"), F.lit(0).alias("fact_ord"), F.when(F.col("_price") < 150000, "insufficiente").otherwise("provato").alias("proof_state"), F.lit("pacifico").alias("adversarial_state"))
    facts = F.explode(F.when(F.col("claim_id") % 2 == 1, F.array(first, other)).otherwise(F.array(first)))
    return rows.withColumn("_f", facts).drop("proof_state", "adversarial_state", "_price").select("*", "_f.*").drop("_f")


_FACT_ROWS = f"""
    {_ROWS},
    f AS (
        SELECT x.*, claim_id % 100 AS co, 2 * claim_id AS fact_id, 1 AS fo, CASE p WHEN '1-URGENT' THEN 'provato' WHEN '2-HIGH' THEN 'insufficiente' ELSE 'da_verificare' END AS state,
               CASE p WHEN '3-MEDIUM' THEN 'silente' WHEN '5-LOW' THEN 'non_contestato' ELSE 'da_decidere' END AS contra FROM x
        UNION ALL SELECT x.*, claim_id % 100, 2 * claim_id + 1, 0, CASE WHEN price < 150000 THEN 'insufficiente' ELSE 'provato' END, 'pacifico' FROM x WHERE claim_id % 2 = 1
    ), d AS (SELECT c_custkey AS case_id, c_nationkey < 12 AS part FROM customer),
    i AS (
        SELECT case_id, claim_id, fact_id, co, fo, 1 AS seq, 'R1' AS rule, 'alta' AS severity FROM f WHERE n = 0
        UNION ALL SELECT case_id, claim_id, fact_id, co, fo, 2, 'R2', 'media' FROM f WHERE n > 0 AND mx < 0.45
        UNION ALL SELECT case_id, claim_id, fact_id, co, fo, 3, 'R3', 'alta' FROM f WHERE state = 'provato' AND proof = 'insufficiente'
        UNION ALL SELECT case_id, claim_id, fact_id, co, fo, 4, 'R4', 'media' FROM f WHERE state = 'provato' AND q
        UNION ALL SELECT case_id, claim_id, fact_id, co, fo, 5, 'R5', 'bassa' FROM f WHERE contra = 'silente'
        UNION ALL SELECT case_id, claim_id, fact_id, co, fo, 6, 'R6', 'alta' FROM f WHERE opp > 0 AND contra IN ('non_contestato', 'pacifico')
        UNION ALL SELECT case_id, claim_id, fact_id, co, fo, 7, 'R7', 'media' FROM f WHERE st <> 'F'
        UNION ALL SELECT case_id, claim_id, fact_id, co, fo, 8, 'R8', 'alta' FROM f WHERE st = 'F' AND state IN ('non_provato', 'insufficiente')
        UNION ALL SELECT case_id, NULL, NULL, NULL, NULL, 99, CASE WHEN coalesce(part, false) THEN 'R10' ELSE 'R9' END, 'alta' FROM (SELECT case_id, max(CASE WHEN st <> 'F' THEN 1 ELSE 0 END) AS miss FROM x GROUP BY 1) FULL JOIN d USING (case_id)
            WHERE NOT coalesce(part, false) OR miss = 1
    )"""
# What the review proposes for an issue, by the words of its area and message.
_PROPOSED = """
    p(rule, k, action) AS (VALUES ('R1', 0, 'cerca_fascicolo'), ('R1', 1, 'segna_insufficiente'), ('R1', 2, 'crea_quesito'), ('R2', 0, 'verifica_fonti'), ('R2', 1, 'segna_da_verificare'),
        ('R3', 0, 'crea_quesito'), ('R4', 0, 'crea_quesito'), ('R5', 0, 'crea_quesito'), ('R6', 0, 'crea_quesito'), ('R7', 0, 'integra_motivazione'), ('R8', 0, 'integra_motivazione'),
        ('R9', 0, 'compila_pqm'), ('R10', 0, 'integra_motivazione'), ('R10', 1, 'compila_pqm')),
    a AS (
        SELECT *, row_number() OVER (PARTITION BY case_id, action, fact_id, claim_id ORDER BY co NULLS LAST, fo, issue_fact, seq, k) AS r FROM (
            SELECT case_id, co, fo, fact_id AS issue_fact, seq, k, rule, severity, action, CASE WHEN action <> 'compila_pqm' THEN fact_id END AS fact_id, CASE WHEN action <> 'compila_pqm' THEN claim_id END AS claim_id FROM i JOIN p USING (rule)))"""


def _issues(spark, d) -> DataFrame:
    return matrix.red_team(_facts(spark, d), _drafts(spark, d))


@query(f"WITH {_FACT_ROWS} SELECT case_id, coalesce(claim_id, -1) AS claim_id, coalesce(fact_id, -1) AS fact_id, rule, severity FROM i")
def fact_issues(spark, d):
    """Issues of facts of which a claim may have two; issues of the whole case have claim and fact -1."""
    return _issues(spark, d).select("case_id", F.coalesce("claim_id", F.lit(-1)).alias("claim_id"), F.coalesce("fact_id", F.lit(-1)).alias("fact_id"), "rule", "severity")


@query(f"WITH {_FACT_ROWS}, {_PROPOSED} SELECT case_id, claim_id, fact_id, action, severity, rule FROM a WHERE r = 1")
def issue_actions(spark, d):
    """Actions of all issues; those of one fact that several issues propose come once, as the first proposes them."""
    return matrix.actions(_issues(spark, d)).drop("at")


@query(f"WITH {_FACT_ROWS}, {_PROPOSED} SELECT action, rule, severity, count(*) AS n FROM a WHERE r = 1 GROUP BY ALL")
def rule_actions(spark, d):
    """How many actions each rule ends up with."""
    return matrix.actions(_issues(spark, d)).groupBy("action", "rule", "severity").agg(F.count("*").alias("n"))


@query(
    f"""
    WITH {_FACT_ROWS}, dc AS (SELECT o_custkey AS case_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS proc, count(*) FILTER (o_orderstatus = 'F') AS acc, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS ver FROM orders GROUP BY 1),
    sc AS (SELECT o_custkey AS case_id, count(DISTINCT l_partkey) FILTER (l_partkey <> 0) AS cited, count(l_partkey) AS sources, count(*) FILTER (l_discount * 10 < 0.45) AS weak, count(*) FILTER (l_linestatus = 'O') AS decisive FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    cc AS (SELECT case_id, count(*) AS claims, count(*) FILTER (price < 50000) AS low, count(*) FILTER (q) AS questions, count(*) FILTER (st <> 'F') AS nor FROM x GROUP BY 1),
    fc AS (SELECT case_id, count(*) FILTER (n = 0) AS uncovered, count(*) FILTER (st = 'F' AND state IN ('non_provato', 'insufficiente')) AS contra FROM f GROUP BY 1),
    ic AS (SELECT case_id, count(*) FILTER (severity = 'alta') AS severe FROM i GROUP BY 1),
    du AS (SELECT o_custkey AS case_id, count(*) - count(DISTINCT lower(o_orderpriority)) AS dup FROM orders GROUP BY 1),
    a AS (SELECT c_custkey AS case_id, c_mktsegment = 'BUILDING' AS done, c_nationkey < 12 AS part, coalesce(total, 0) AS total, coalesce(proc, 0) AS proc, coalesce(acc, 0) AS acc, coalesce(ver, 0) AS ver, coalesce(cited, 0) AS cited, coalesce(sources, 0) AS sources,
                 coalesce(weak, 0) AS weak, coalesce(decisive, 0) AS decisive, coalesce(claims, 0) AS claims, coalesce(low, 0) AS low, coalesce(questions, 0) AS questions, coalesce(uncovered, 0) AS uncovered, coalesce(nor, 0) AS nor, coalesce(contra, 0) AS contra,
                 coalesce(severe, 0) AS severe, coalesce(dup, 0) AS dup, c_acctbal >= 0 AS ok
          FROM customer LEFT JOIN dc ON dc.case_id = c_custkey LEFT JOIN sc ON sc.case_id = c_custkey LEFT JOIN cc ON cc.case_id = c_custkey LEFT JOIN fc ON fc.case_id = c_custkey LEFT JOIN ic ON ic.case_id = c_custkey LEFT JOIN du ON du.case_id = c_custkey),
    b AS (SELECT *, (total = 0)::INT + (proc > 0)::INT + (ver > 0)::INT + (acc = 0)::INT + (NOT done)::INT + (claims = 0 AND done)::INT + (NOT part)::INT + (nor > 0)::INT + (NOT ok)::INT + (severe > 0)::INT AS blocks,
                 (weak > 0)::INT + (questions > 0)::INT + (dup > 0)::INT + (low > 0)::INT AS warnings FROM a)
    SELECT case_id, blocks AS n_blocks, warnings AS n_warnings, greatest(0, least(100, 100 - 12 * blocks - 4 * warnings)) AS score, cited AS cited_documents, acc AS usable_documents, CAST(round_even(cited / greatest(acc, 1) * 100, 0) AS BIGINT) AS coverage_percent,
           claims, low AS low_confidence, sources, weak AS weak_sources, uncovered AS uncovered_rows, decisive AS decisive_sources, questions AS open_questions, contra AS contradictions FROM b
    """
)
def readiness_score(spark, d):
    """Sources, questions and confidence count once a claim, gaps and contradictions once a fact."""
    out = _ready(spark, d)
    return out.withColumns({"n_blocks": F.size("blocks"), "n_warnings": F.size("warnings")}).drop("blocks", "warnings")


def _ready(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_mktsegment") == "BUILDING", "completata").otherwise("in_attesa").alias("analysis_state"))
    clean = c.select(F.col("c_custkey").alias("case_id"), (F.col("c_acctbal") >= 0).alias("ok"))
    return matrix.readiness(cases, _order_documents(spark, d), _claims(spark, d), _facts(spark, d), _drafts(spark, d), clean)


@query(
    f"""
    WITH {_FACT_ROWS}, dc AS (SELECT o_custkey AS case_id, count(*) FILTER (o_orderstatus = 'O') AS proc, count(*) FILTER (o_orderstatus = 'F') AS acc, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS ver FROM orders GROUP BY 1),
    cc AS (SELECT case_id, count(*) AS claims, count(*) FILTER (q) AS questions, CAST(sum(weak) AS BIGINT) AS weak FROM x GROUP BY 1), fc AS (SELECT case_id, count(*) FILTER (n = 0) AS uncovered FROM f GROUP BY 1),
    ic AS (SELECT case_id, count(*) FILTER (severity = 'alta') AS severe FROM i GROUP BY 1)
    SELECT c_custkey AS case_id, coalesce(acc, 0) > 0 AND coalesce(ver, 0) = 0 AND coalesce(proc, 0) = 0 AS documents, coalesce(claims, 0) > 0 AND c_mktsegment = 'BUILDING' AS claims_extracted, coalesce(uncovered, 0) = 0 AND coalesce(weak, 0) = 0 AS sources_compared,
           coalesce(questions, 0) = 0 AS questions_settled, c_nationkey < 12 AS operative_part, c_acctbal >= 0 AS privacy_clean, coalesce(severe, 0) = 0 AS no_severe_issues
    FROM customer LEFT JOIN dc ON dc.case_id = c_custkey LEFT JOIN cc ON cc.case_id = c_custkey LEFT JOIN fc ON fc.case_id = c_custkey LEFT JOIN ic ON ic.case_id = c_custkey
    """
)
def export_checklist(spark, d):
    """The seven items of each case."""
    return drafting.export_checklist(_ready(spark, d)).drop("ready")


def _listed(c: str, *fields: str):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), ",")


@query(
    f"""
    WITH {_FACT_ROWS}, {_PROPOSED},
    ph AS (SELECT case_id, string_agg(v, ',' ORDER BY v) AS placeholders FROM (SELECT case_id, '[P_' || claim_id || ']' AS v, row_number() OVER (PARTITION BY case_id ORDER BY '[P_' || claim_id || ']') AS r FROM x) WHERE r <= 12 GROUP BY 1),
    cl AS (SELECT case_id, string_agg(claim_id, ',' ORDER BY r) AS claims FROM (SELECT case_id, claim_id, row_number() OVER (PARTITION BY case_id ORDER BY claim_id % 100, claim_id) AS r FROM x) WHERE r <= 12 GROUP BY 1),
    ev AS (SELECT case_id, string_agg(claim_id || ':' || doc_id, ',' ORDER BY r) AS key_evidence FROM (
        SELECT o_custkey AS case_id, o_orderkey AS claim_id, l_partkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_discount DESC, o_orderkey % 100, o_orderkey, l_partkey) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE r <= 5 GROUP BY 1),
    gl AS (SELECT case_id, co, fo, fact_id, unnest(l) AS g, generate_subscripts(l, 1) AS k FROM (SELECT *, list_filter([CASE WHEN price <= 250000 THEN 'burden' END, CASE WHEN n = 0 THEN 'no_source' END, CASE WHEN n > 0 AND mx < 0.45 THEN 'weak_source' END,
        CASE WHEN q THEN 'open_questions' END, CASE WHEN sup > 0 AND opp = 0 AND NOT nc THEN 'no_opponent_source' END, CASE WHEN adv = 'controprovato' THEN 'opponent_only' END, CASE WHEN adv = 'da_decidere' AND sup = 0 THEN 'unreadable' END,
        CASE WHEN st <> 'F' THEN 'reasoning' END], lambda z: z IS NOT NULL) AS l FROM f)),
    ga AS (SELECT case_id, string_agg(fact_id || ':' || g, ',' ORDER BY r) AS gaps FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY co, fo, fact_id, k) AS r FROM gl) WHERE r <= 10 GROUP BY 1),
    ri AS (SELECT case_id, string_agg(rule || ':' || coalesce(CAST(fact_id AS VARCHAR), '-') || ':' || severity, ',' ORDER BY r) AS risks FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY co NULLS LAST, fo, fact_id, seq) AS r FROM i) WHERE r <= 8 GROUP BY 1),
    ac AS (SELECT case_id, string_agg(action || ':' || coalesce(CAST(fact_id AS VARCHAR), '-') || ':' || severity, ',' ORDER BY t) AS actions
           FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY co NULLS LAST, fo, issue_fact, seq, k) AS t FROM a WHERE r = 1) WHERE t <= 8 GROUP BY 1)
    SELECT c_custkey AS case_id, coalesce(placeholders, '') AS placeholders, coalesce(claims, '') AS claims, coalesce(key_evidence, '') AS key_evidence, coalesce(gaps, '') AS gaps, coalesce(risks, '') AS risks, coalesce(actions, '') AS actions
    FROM customer LEFT JOIN ph ON ph.case_id = c_custkey LEFT JOIN cl ON cl.case_id = c_custkey LEFT JOIN ev ON ev.case_id = c_custkey LEFT JOIN ga ON ga.case_id = c_custkey LEFT JOIN ri ON ri.case_id = c_custkey LEFT JOIN ac ON ac.case_id = c_custkey
    """
)
def dashboard_lists(spark, d):
    """All lists of the dashboard, entry by entry."""
    rows, claims = _facts(spark, d), _claims(spark, d)
    cases = _t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"))
    names = claims.select("case_id", F.concat(F.lit("[P_"), F.col("claim_id"), F.lit("]")).alias("placeholder"))
    out = drafting.dashboard(cases, names, claims, rows, _drafts(spark, d))
    return out.select(
        "case_id", F.array_join("placeholders", ",").alias("placeholders"), F.array_join(F.transform("claims", lambda x: x.cast("string")), ",").alias("claims"), _listed("key_evidence", "claim_id", "doc_id").alias("key_evidence"),
        _listed("gaps", "fact_id", "gap").alias("gaps"), _listed("risks", "rule", "fact_id", "severity").alias("risks"), _listed("actions", "action", "fact_id", "severity").alias("actions"),
    )


# ---------------------------------------------------------------- applying actions

_NAMES = ("cerca_fascicolo", "segna_insufficiente", "crea_quesito", "verifica_fonti", "segna_da_verificare", "integra_motivazione", "compila_pqm", "chiedi_ctu", "cambia_stato")


def _applied(spark, d) -> workflow.Applied:
    """Line items as actions on their order's fact: several a fact, one name unknown, some on the claim only (line 3), some in another case (line 4)."""
    o = _t(spark, d, "orders")
    facts = o.select((2 * F.col("o_orderkey")).alias("fact_id"), F.col("o_orderkey").alias("claim_id"), F.lit("provato").alias("proof_state"), F.when(F.col("o_orderstatus") == "F", "nota").otherwise("").alias("operator_note"), F.lit("").alias("question"))
    claims = o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("parte 1"))).otherwise(F.array().cast("array<string>")).alias("open_questions"))
    i = _t(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    action = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), ((F.col("l_partkey") + F.col("l_suppkey")) % 9 + 1).cast("int"))
    seq = F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")
    todo = i.select(
        F.when(F.col("l_linenumber") == 4, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("case_id"), seq.alias("seq"), action.alias("action"), F.when(F.col("l_linenumber") != 3, 2 * F.col("l_orderkey")).alias("fact_id"),
        F.when(F.col("l_linenumber") == 3, F.col("l_orderkey")).alias("claim_id"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("parte "), F.col("l_partkey") % 5)).alias("text"), F.lit("u").alias("actor"),
    )
    return workflow.apply_actions(facts, claims, todo)


_TODO = f"""
    t AS (
        SELECT l_orderkey AS claim_id, o_custkey AS case_id, l_linenumber AS ln, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, [{", ".join(f"'{x}'" for x in _NAMES)}][CAST((l_partkey + l_suppkey) % 9 + 1 AS INT)] AS action,
               CASE WHEN l_partkey % 2 = 0 THEN 'parte ' || (l_partkey % 5) END AS text, o_orderstatus AS st FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    ), v AS (SELECT * FROM t WHERE ln <> 4 AND action <> 'cambia_stato' AND NOT (ln = 3 AND action IN ('segna_insufficiente', 'segna_da_verificare', 'crea_quesito'))
    ), qs AS (SELECT *, coalesce(text, 'Verificare manualmente se la richiesta e'' sorretta da fonti interne sufficienti.') AS q FROM v WHERE action = 'crea_quesito')"""


@query(
    f"""
    WITH {_TODO}, g AS (
        SELECT claim_id, arg_max(CASE action WHEN 'segna_insufficiente' THEN 'insufficiente' ELSE 'da_verificare' END, seq) FILTER (action IN ('segna_insufficiente', 'segna_da_verificare')) AS state, bool_or(action = 'segna_insufficiente') AS noted FROM v GROUP BY 1
    ), h AS (SELECT claim_id, arg_max(q, seq) AS q FROM qs GROUP BY 1)
    SELECT 2 * o_orderkey AS fact_id, coalesce(state, 'provato') AS proof_state, coalesce(h.q, '') AS question,
           CASE WHEN o_orderstatus = 'F' THEN 'nota' WHEN noted THEN 'Marcata insufficiente dalla revisione guidata: mancano fonti interne adeguate.' ELSE '' END AS operator_note
    FROM orders LEFT JOIN g ON g.claim_id = o_orderkey LEFT JOIN h ON h.claim_id = o_orderkey
    """
)
def applied_actions(spark, d):
    """Facts after all actions on them, one row a fact."""
    return _applied(spark, d).facts.select("fact_id", "proof_state", "question", "operator_note")


@query(
    f"""
    WITH {_TODO}, n AS (SELECT claim_id, q, min(seq) AS s FROM qs WHERE NOT (st = 'F' AND q = 'parte 1') GROUP BY 1, 2), l AS (SELECT claim_id, string_agg(q, '|' ORDER BY s) AS qs FROM n GROUP BY 1)
    SELECT o_orderkey AS claim_id, concat_ws('|', CASE WHEN o_orderstatus = 'F' THEN 'parte 1' END, l.qs) AS questions FROM orders LEFT JOIN l ON l.claim_id = o_orderkey
    """
)
def applied_questions(spark, d):
    """Open questions of all claims after the actions."""
    return _applied(spark, d).claims.select("claim_id", F.array_join("open_questions", "|").alias("questions"))


_COMMENTS = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in C.COMMENT_TEXTS.items())


@query(
    f"""
    WITH {_TODO}, c(action, usual) AS (VALUES {_COMMENTS})
    SELECT case_id, seq, claim_id AS ref_id, CASE action WHEN 'compila_pqm' THEN 'pqm' ELSE 'in_diritto' END AS section, coalesce(text, usual) AS text FROM v JOIN c USING (action)
    """
)
def applied_comments(spark, d):
    return _applied(spark, d).comments.select("case_id", "seq", "ref_id", "section", "text")


@query(
    f"""
    WITH {_TODO}, r AS (SELECT case_id + CAST(ln = 4 AS INT) AS case_id, seq, action, CAST(NULL AS VARCHAR) AS after FROM t WHERE ln = 4 OR action = 'cambia_stato' OR (ln = 3 AND action IN ('segna_insufficiente', 'segna_da_verificare', 'crea_quesito')))
    SELECT case_id, seq, action, '{{"tipo":"' || action || '"}}' AS after FROM v UNION ALL SELECT * FROM r
    """
)
def applied_ledger(spark, d):
    """A ledger row of every action; refused ones have no value."""
    return _applied(spark, d).outcomes.select("case_id", "seq", "action", "after")


# ---------------------------------------------------------------- matrix rows, contexts and edits


@query(
    f"""
    WITH b AS (SELECT c_custkey AS claim_id, trim(c_name) AS t, CASE WHEN c_nationkey % 3 = 0 THEN [' ', ' ' || c_mktsegment, 'x'] WHEN c_nationkey % 3 = 1 THEN ['  '] END AS q, CASE WHEN c_acctbal > 0 THEN 'onere' ELSE ' ' END AS o FROM customer)
    SELECT claim_id, t AS text, CASE WHEN len(list_filter(q, lambda z: trim(z) <> '')) > 0 THEN trim(list_filter(q, lambda z: trim(z) <> '')[1]) WHEN trim(o) = '' THEN '{C.FIRST_QUESTION}' ELSE '' END AS question, 0 AS ord
    FROM b WHERE claim_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    """
)
def first_matrix_rows(spark, d):
    """Customers without a finished order as claims without a fact."""
    n = F.col("c_nationkey") % 3
    questions = F.when(n == 0, F.array(F.lit(" "), F.concat(F.lit(" "), "c_mktsegment"), F.lit("x"))).when(n == 1, F.array(F.lit("  ")))
    claims = _t(spark, d, "customer").select(F.col("c_custkey").alias("claim_id"), F.col("c_name").alias("text"), questions.alias("open_questions"), F.when(F.col("c_acctbal") > 0, "onere").otherwise(" ").alias("burden"))
    return workflow.first_rows(claims, _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("claim_id")))


_LABEL = "CASE lang WHEN 'en' THEN 'FASCICOLO DELL''ATTORE' WHEN 'de' THEN 'FASCICOLO DEL CONVENUTO/RICORRENTE' WHEN 'fr' THEN 'DOCUMENTI GENERICI' ELSE upper(lang) END"


@query(
    rf"""
    SELECT source AS case_id, substr(string_agg('### Documento ' || doc_id || ' — ' || {_LABEL} || chr(10) || substr(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), 1, 16000), chr(10) || chr(10) ORDER BY n_chars, doc_id), 1, 16000) AS context
    FROM documents GROUP BY 1
    """
)
def compose_with_headers(spark, d):
    """All documents of a source as a case, by length, each under its section's header with its id."""
    section = F.when(F.col("lang") == "en", "attore").when(F.col("lang") == "de", "convenuto").when(F.col("lang") == "fr", "generici").otherwise(F.col("lang"))
    docs = _t(spark, d, "documents").select(F.col("source").alias("case_id"), "doc_id", section.alias("section"), F.col("n_chars").alias("ord"), "text")
    return retrieval.compose_documents(docs, with_ids=True)


@query(
    """
    WITH l AS (
        SELECT c_custkey AS case_id, 0 AS part, 0 AS ord, 0 AS id, 'In fatto: ' || c_name AS line FROM customer WHERE c_nationkey < 12
        UNION ALL SELECT o_custkey, 1, o_orderkey % 100, o_orderkey, 'Richiesta (' || CASE WHEN o_orderkey % 2 = 0 THEN 'attore' ELSE 'convenuto' END || '): ' || o_orderpriority || ' ' || o_orderdate FROM orders
    ) SELECT case_id, substr(string_agg(line, chr(10) ORDER BY part, ord, id), 1, 8000) AS context FROM l GROUP BY 1
    """
)
def case_contexts(spark, d):
    drafts = _t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_nationkey") < 12, F.col("c_name")).alias("in_fact"))
    text = F.concat_ws(" ", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    claims = _t(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") % 100).alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, "attore").otherwise("convenuto").alias("party"), text.alias("text"))
    return retrieval.case_context(drafts, claims)


@query(
    """
    WITH e AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, CASE l_returnflag WHEN 'A' THEN repeat('n' || l_partkey || ' ', 60) END AS name,
                      CASE WHEN l_returnflag <> 'A' THEN CASE l_suppkey % 3 WHEN 0 THEN '-' || l_partkey WHEN 1 THEN CAST(l_partkey AS VARCHAR) ELSE 'primo' END END AS ord, CASE WHEN l_linenumber = 2 THEN repeat('k' || l_suppkey, 40) END AS kind FROM lineitem),
    g AS (SELECT * FROM e WHERE ord IS NULL OR ord <> 'primo'),
    x AS (SELECT doc_id, arg_max(substr(name, 1, 255), seq) FILTER (name IS NOT NULL) AS name, arg_max(greatest(0, CAST(ord AS INT)), seq) FILTER (ord IS NOT NULL) AS ord, arg_max(substr(kind, 1, 64), seq) FILTER (kind IS NOT NULL) AS kind FROM g GROUP BY 1)
    SELECT o_orderkey AS doc_id, coalesce(name, o_orderpriority) AS display_name, coalesce(ord, 0) AS ord, coalesce(kind, o_orderstatus) AS kind FROM orders LEFT JOIN x ON x.doc_id = o_orderkey
    """
)
def edited_metadata(spark, d):
    """Line items as edits of their order's name, place and kind; some places are no number."""
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("display_name"), F.lit(0).alias("ord"), F.col("o_orderstatus").alias("kind"))
    part, a = F.col("l_partkey").cast("string"), F.col("l_returnflag") == "A"
    place = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("-"), part)).when(F.col("l_suppkey") % 3 == 1, part).otherwise(F.lit("primo"))
    seq = F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")
    edits = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), seq.alias("seq"), F.when(a, F.repeat(F.concat(F.lit("n"), part, F.lit(" ")), F.lit(60))).alias("display_name"), F.when(~a, place).alias("ord"), F.when(F.col("l_linenumber") == 2, F.repeat(F.concat(F.lit("k"), F.col("l_suppkey")), F.lit(40))).alias("kind"),
    )
    return workflow.edit_metadata(docs, edits)[0]


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@query(
    rf"""
    WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.cortedicassazione.it/' || page_id WHEN 1 THEN 'https://news.altalex.com/' || page_id WHEN 2 THEN 'https://studio' || page_id || '.it/' WHEN 3 THEN '' ELSE url END AS url FROM pages),
    h AS (SELECT page_id, url, {_HOST} AS host FROM p),
    r AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN 'insufficiente' WHEN url = '' AND page_id % 5 = 0 THEN 'media' WHEN url = '' THEN 'non_indicata' WHEN ends_with(host, 'cortedicassazione.it') THEN 'alta' WHEN ends_with(host, 'altalex.com') THEN 'media'
                          WHEN contains(host, 'studio') OR contains(host, 'blog') THEN 'bassa' ELSE 'media' END AS reliability FROM h)
    SELECT page_id, reliability, CASE WHEN page_id % 7 = 0 THEN 'Ricerca insufficiente' WHEN url = '' AND page_id % 5 = 0 THEN 'Materiale manuale da verificare' WHEN url = '' THEN 'Fonte non indicata' WHEN ends_with(host, 'cortedicassazione.it') THEN 'Fonte istituzionale'
               WHEN ends_with(host, 'altalex.com') THEN 'Banca dati o rivista giuridica' WHEN contains(host, 'studio') OR contains(host, 'blog') THEN 'Fonte da verificare con cautela' ELSE 'Fonte da verificare' END AS label,
           CASE reliability WHEN 'insufficiente' THEN 'La ricerca non ha restituito fonti sufficientemente verificabili.' WHEN 'alta' THEN 'Fonte istituzionale o primaria: usare comunque previa verifica del testo vigente.'
               WHEN 'media' THEN 'Fonte utile per orientarsi, da confrontare con norma o provvedimento originale.' WHEN 'bassa' THEN 'Fonte potenzialmente fragile: non citarla senza riscontro autonomo.'
               ELSE 'Fonte non indicata: trattala come appunto interno, non come citazione.' END AS reason FROM r
    """
)
def lead_labels(spark, d):
    """Pages as leads of all trust classes: some with an official, an editorial or a doubtful address, some without one."""
    n, page = F.col("page_id") % 6, F.col("page_id").cast("string")
    url = F.when(n == 0, F.concat(F.lit("https://www.cortedicassazione.it/"), page)).when(n == 1, F.concat(F.lit("https://news.altalex.com/"), page)).when(n == 2, F.concat(F.lit("https://studio"), page, F.lit(".it/"))).when(n == 3, "").otherwise(F.col("url"))
    rows = _t(spark, d, "pages").select("page_id", url.alias("url"))
    args = F.col("url"), F.col("page_id") % 7 == 0, F.col("page_id") % 5 == 0
    rows = rows.select("page_id", T.lead_reliability(*args).alias("reliability"), T.lead_label(*args).alias("label"))
    return rows.withColumn("reason", T.lead_reason(F.col("reliability")))
