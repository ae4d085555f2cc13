"""Evidence matrix, gaps, red-team rules, actions and readiness: columns computed once, then projected.

A matrix row has claim_id, fact_id, case_id, party, burden, reasoning, open_questions, not_contested (arrays), proof_state,
adversarial_state, adversarial_note and sources (array<struct<doc_id, section, score, reliability, rating, anchor>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.scratch import scratch


def _blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def best_reliability(sources: Column) -> Column:
    """Highest of alta, media, bassa; ``assente`` without sources."""
    has = lambda v: F.exists(sources, lambda s: s["reliability"] == v)
    return F.when(F.size(sources) == 0, F.lit("assente")).when(has("alta"), F.lit("alta")).when(has("media"), F.lit("media")).otherwise(F.lit("bassa"))


def matrix(rows: DataFrame) -> DataFrame:
    """Derived columns of each row: counts, best score, sides, suggested states and gaps (codes, in order)."""
    other = F.when(F.col("party") == "attore", F.lit("convenuto")).otherwise(F.lit("attore"))
    side = lambda pick: F.size(F.filter("sources", pick))
    rows = rows.withColumn("sources", F.coalesce("sources", F.array().cast(rows.schema["sources"].dataType)))
    rows = rows.withColumns(
        {
            "n_sources": F.size("sources"),
            "max_score": F.coalesce(F.array_max(F.transform("sources", lambda s: s["score"])), F.lit(0.0)),
            "max_reliability": best_reliability(F.col("sources")),
            "n_support": side(lambda s: (s["section"] == F.col("party")) | (s["section"] == "generici")),
            "n_opponent": side(lambda s: s["section"] == other),
            "n_questions": F.size(F.coalesce("open_questions", F.array().cast("array<string>"))),
            "n_uncontested": F.size(F.coalesce("not_contested", F.array().cast("array<string>"))),
        }
    )
    support, opponent = F.col("n_support") > 0, F.col("n_opponent") > 0
    adversarial = (
        F.when(support & opponent, F.lit("contestato"))
        .when(opponent, F.lit("controprovato"))
        .when(support & (F.col("n_uncontested") > 0), F.lit("non_contestato"))
        .when(support, F.lit("silente"))
        .otherwise(F.lit("da_decidere"))
    )
    weak = (F.col("n_sources") == 0) | (F.col("max_score") < C.WEAK_SCORE)
    proof = F.when(weak, F.lit("insufficiente")).when(F.col("n_questions") > 0, F.lit("da_decidere")).otherwise(F.lit("da_verificare"))
    rows = rows.withColumns({"suggested_adversarial": adversarial, "suggested_proof": proof})
    state = F.col("suggested_adversarial")
    gaps = (
        ("burden", _blank("burden")),
        ("no_source", F.col("n_sources") == 0),
        ("weak_source", (F.col("n_sources") > 0) & (F.col("max_score") < C.WEAK_SCORE)),
        ("open_questions", F.col("n_questions") > 0),
        ("no_opponent_source", support & ~opponent & (F.col("n_uncontested") == 0)),
        ("opponent_only", state == "controprovato"),
        ("unreadable", (state == "da_decidere") & ~support),
        ("reasoning", _blank("reasoning")),
    )
    found = F.array(*[F.when(test, F.lit(code)) for code, test in gaps])
    return rows.withColumn("gaps", F.filter(found, lambda g: g.isNotNull()))


def red_team(rows: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row an issue: case_id, claim_id, fact_id, rule, severity, area, seq, claim_ord, fact_ord. drafts: (case_id, operative_part).

    Eight rules look at matrix rows, two at the case: no operative part, or one while a claim's reasoning is missing.
    Rows without claim_ord and fact_ord are ordered by their ids; issue_order() is the order in which issues are shown.
    """
    m = rows if "suggested_proof" in rows.columns else matrix(rows)
    m = m.withColumns({f"{k}_ord": F.col(f"{k}_id") for k in ("claim", "fact") if f"{k}_ord" not in m.columns})
    proven, questions = F.col("proof_state") == "provato", F.col("n_questions") > 0
    rules = (
        ("R1", "alta", "prove", F.col("n_sources") == 0),
        ("R2", "media", "prove", (F.col("n_sources") > 0) & (F.col("max_score") < C.WEAK_SCORE)),
        ("R3", "alta", "stato prova", proven & (F.col("suggested_proof") == "insufficiente")),
        ("R4", "media", "decisione umana", proven & questions),
        ("R5", "bassa", "contraddittorio", (F.col("adversarial_state") == "silente") & (F.coalesce("adversarial_note", F.lit("")) == "")),
        ("R6", "alta", "contraddittorio", (F.col("n_opponent") > 0) & F.col("adversarial_state").isin("non_contestato", "pacifico")),
        ("R7", "media", "motivazione", _blank("reasoning")),
        ("R8", "alta", "motivazione/prova", (F.coalesce("reasoning", F.lit("")) != "") & F.col("proof_state").isin("non_provato", "insufficiente")),
    )
    issue = lambda rule, severity, area: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(area).alias("area"))
    hits = F.filter(F.array(*[F.when(test, issue(r, s, a)) for r, s, a, test in rules]), lambda x: x.isNotNull())
    numbered = F.transform(hits, lambda x: F.struct(x["rule"].alias("rule"), x["severity"].alias("severity"), x["area"].alias("area"), F.substring(x["rule"], 2, 1).cast("int").alias("seq")))
    place = ("claim_ord", "fact_ord")
    per_row = m.select("case_id", "claim_id", "fact_id", *place, F.explode(numbered).alias("i")).select("case_id", "claim_id", "fact_id", "i.*", *place)
    cases = m.groupBy("case_id").agg(F.max(_blank("reasoning").cast("int")).alias("missing")).join(drafts.select("case_id", "operative_part"), "case_id", "full")
    no_part = _blank("operative_part")
    whole = F.when(no_part, issue("R9", "alta", "PQM")).when(F.col("missing") == 1, issue("R10", "alta", "PQM/motivazione"))
    none = F.lit(None).cast("long")
    per_case = cases.select("case_id", none.alias("claim_id"), none.alias("fact_id"), whole.alias("i")).where("i IS NOT NULL")
    return per_row.unionByName(per_case.select("case_id", "claim_id", "fact_id", "i.*", F.lit(99).alias("seq")), allowMissingColumns=True)


def issue_order() -> Column:
    """Issues in the order of their rows, rule after rule in a row; those of the whole case last."""
    return F.struct(F.col("claim_id").isNull(), "claim_ord", "fact_ord", "fact_id", "seq")


def severity_counts(issues: DataFrame, key: str = "case_id") -> DataFrame:
    of = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return issues.groupBy(key).agg(F.count("*").alias("total"), of("alta"), of("media"), of("bassa"))


# Actions that each rule proposes, in order; those that name no row.
ACTIONS = {
    "R1": ("cerca_fascicolo", "segna_insufficiente", "crea_quesito"), "R2": ("verifica_fonti", "segna_da_verificare"), "R3": ("crea_quesito",), "R4": ("crea_quesito",), "R5": ("crea_quesito",),
    "R6": ("crea_quesito",), "R7": ("integra_motivazione",), "R8": ("integra_motivazione",), "R9": ("compila_pqm",), "R10": ("integra_motivazione", "compila_pqm"),
}
WHOLE_CASE_ACTIONS = ("compila_pqm",)


def actions(issues: DataFrame) -> DataFrame:
    """Actions of all issues, the first of each (case, action, fact, claim) in issue order, with its place ``at``.

    A grouped minimum finds the first, so a case's actions are never gathered.
    """
    of = F.create_map(*[x for rule, names in ACTIONS.items() for x in (F.lit(rule), F.array(*[F.lit(n) for n in names]))])
    rows = issues.select("*", F.posexplode(F.element_at(of, F.col("rule"))).alias("k", "action"))
    target = lambda c: F.when(~F.col("action").isin(*WHOLE_CASE_ACTIONS), F.col(c)).alias(c)
    rows = rows.select("case_id", target("claim_id"), target("fact_id"), "action", F.struct(F.struct(issue_order().alias("issue"), "k").alias("at"), "severity", "rule").alias("x"))
    found = rows.groupBy("case_id", "claim_id", "fact_id", "action").agg(F.min("x").alias("x"))
    return found.select("case_id", "claim_id", "fact_id", "action", "x.severity", "x.rule", "x.at")


def quality_score(blocks: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - C.BLOCK_COST * blocks - C.WARNING_COST * warnings))


def readiness(cases: DataFrame, documents: DataFrame, claims: DataFrame, rows: DataFrame, drafts: DataFrame, privacy: DataFrame) -> DataFrame:
    """One row a case: blocks and warnings (codes), score, coverage and counts.

    cases (case_id, analysis_state), documents (case_id, doc_id, file_name, pseudonymised, acceptance, extraction_state,
    anonymisation_state, ord), claims (case_id, claim_id, confidence, open_questions, reasoning, sources), rows as above,
    one a fact, drafts (case_id, operative_part), privacy (case_id, ok). Sources, questions and confidence count once
    a claim, however many facts it has. The matrix is computed once and written to the shared folder.
    """
    from .workflow import document_counts, duplicate_names

    made = matrix(rows)
    m = scratch(made.drop("sources", "open_questions", "not_contested", "gaps"), "matrix")
    issues = severity_counts(red_team(m, drafts))
    # Row-wise folds of each claim's sources before the grouping: only sums and cited ids are shuffled.
    sources = F.coalesce("sources", F.array().cast(claims.schema["sources"].dataType))
    count = lambda test: F.size(F.filter(sources, test))
    cited = claims.select("case_id", F.explode(F.array_distinct(F.transform(sources, lambda s: s["doc_id"]))).alias("doc_id"))
    cited = cited.where("doc_id <> 0").groupBy("case_id").agg(F.count_distinct("doc_id").alias("cited"))
    per_claim = claims.groupBy("case_id").agg(
        F.count("*").alias("claims"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < C.LOW_CONFIDENCE).alias("low_confidence"), F.sum(F.size(F.coalesce("open_questions", F.array().cast("array<string>")))).alias("questions"),
        F.count_if(_blank("reasoning")).alias("no_reasoning"), F.sum(F.size(sources)).alias("sources"), F.sum(count(lambda s: F.coalesce(s["score"], F.lit(0.0)) < C.WEAK_SCORE)).alias("weak"),
        F.sum(count(lambda s: s["rating"] == "decisiva")).alias("decisive"),
    )
    written = F.coalesce("reasoning", F.lit("")) != ""
    per_row = m.groupBy("case_id").agg(F.count_if(F.col("n_sources") == 0).alias("uncovered"), F.count_if(written & F.col("proof_state").isin("non_provato", "insufficiente")).alias("contradictions"))
    twice = duplicate_names(documents).groupBy("case_id").agg(F.count("*").alias("duplicates"))
    out = cases
    for part in (document_counts(documents), cited, per_claim, per_row, issues.select("case_id", F.col("alta").alias("severe")), drafts.select("case_id", "operative_part", F.lit(True).alias("drafted")), privacy.select("case_id", F.col("ok").alias("privacy_ok")), twice):
        out = out.join(part, "case_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    done = F.col("analysis_state") == "completata"
    blocks = (
        ("no_documents", n("total") == 0), ("processing", n("processing") > 0), ("to_verify", n("to_verify") > 0), ("none_usable", n("accepted") == 0), ("analysis_open", ~F.coalesce(done, F.lit(False))),
        ("no_claims", (n("claims") == 0) & done), ("no_draft", F.col("drafted").isNull()), ("no_operative_part", F.col("drafted").isNotNull() & _blank("operative_part")),
        ("reasoning_missing", n("no_reasoning") > 0), ("privacy", ~F.coalesce("privacy_ok", F.lit(True))), ("severe_issues", n("severe") > 0),
    )
    warnings = (("weak_sources", n("weak") > 0), ("open_questions", n("questions") > 0), ("duplicates", n("duplicates") > 0), ("low_confidence", n("low_confidence") > 0))
    codes = lambda tests: F.filter(F.array(*[F.when(t, F.lit(c)) for c, t in tests]), lambda x: x.isNotNull())
    out = out.withColumns({"blocks": codes(blocks), "warnings": codes(warnings)})
    return out.select(
        "case_id", "blocks", "warnings", quality_score(F.size("blocks"), F.size("warnings")).alias("score"), n("cited").alias("cited_documents"), n("accepted").alias("usable_documents"),
        F.bround(n("cited") / F.greatest(n("accepted"), F.lit(1)) * 100, 0).cast("long").alias("coverage_percent"), n("claims").alias("claims"), n("low_confidence").alias("low_confidence"),
        n("sources").alias("sources"), n("weak").alias("weak_sources"), n("uncovered").alias("uncovered_rows"), n("decisive").alias("decisive_sources"), n("questions").alias("open_questions"), n("contradictions").alias("contradictions"),
    )
