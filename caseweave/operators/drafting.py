"""What a draft, a dashboard and a report of a case are put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.functions import text as T
from caseweave.scratch import scratch

from .claims import burden, undisputed
from .matrix import actions, issue_order, matrix, red_team


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _list(c: str, kind: str = "array<string>") -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def valid_attachments(ids: Column, documents: Column) -> Column:
    """Ids (as text) that are numbers and among the case's documents, each once, in order."""
    return F.array_intersect(F.array_distinct(F.filter(F.transform(ids, lambda x: x.try_cast("long")), lambda x: x.isNotNull())), documents)


def label(code: Column, names: dict[str, str]) -> Column:
    """A code's name; a code without one stands for itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code), code)


def facts_with_attachments(facts: DataFrame, claims: DataFrame, attachments: DataFrame) -> DataFrame:
    """facts (fact_id, claim_id) with their claim's case, and its attached documents in order; those without keep an empty list.

    claims (claim_id, case_id), attachments (claim_id, doc_id), both of any size: grouped before the join.
    """
    lists = attachments.groupBy("claim_id").agg(F.array_sort(F.collect_set("doc_id")).alias("attachments"))
    rows = facts.join(claims.select("claim_id", "case_id"), "claim_id").join(lists, "claim_id", "left")
    return rows.withColumn("attachments", F.coalesce("attachments", F.array().cast(lists.schema["attachments"].dataType)))


def stored_or_computed(claims: DataFrame, computed: DataFrame) -> DataFrame:
    """claims (claim_id, sources) with the stored sources, or where there are none the computed ones (claim_id, sources)."""
    fresh = computed.select("claim_id", F.col("sources").alias("_computed"))
    kept = F.when(F.size(F.col("sources")) > 0, F.col("sources")).otherwise(F.col("_computed"))
    return claims.join(fresh, "claim_id", "left").withColumn("sources", F.coalesce(kept, F.array().cast(claims.schema["sources"].dataType))).drop("_computed")


def matrix_totals(m: DataFrame) -> DataFrame:
    """Rows, rows with gaps and sources of each case; ``m`` is matrix.matrix()."""
    return m.groupBy("case_id").agg(F.count("*").alias("rows"), F.count_if(F.size("gaps") > 0).alias("rows_with_gaps"), F.sum("n_sources").alias("sources"))


def claim_totals(claims: DataFrame) -> DataFrame:
    """Claims of each case: all, deepened ones, and their attachments, traced sources and open questions."""
    size = lambda c: F.sum(F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)))
    return claims.groupBy("case_id").agg(
        F.count("*").alias("claims"), F.count_if(F.col("state") == "approfondita").alias("deepened"), size("attachments").alias("attachments"), size("sources").alias("sources"), size("open_questions").alias("questions"),
    )


def claim_map(claims: DataFrame) -> DataFrame:
    """(case_id, contents): what a draft keeps of each claim of a case, by claim id. A case's claims are one map."""
    kept = F.struct("ord", "party", "kind", "text", "burden", "reasoning", _list("not_contested").alias("not_contested"), _list("open_questions").alias("open_questions"))
    return claims.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("claim_id").cast("string").alias("id"), kept.alias("content"))))).alias("contents"))


def case_text(drafts: DataFrame, claims: DataFrame) -> DataFrame:
    """(case_id, text) from which a case's graph is built: facts, then each claim's text, burden and questions, line by line."""
    lines = F.concat(F.filter(F.array(_text("text"), _text("burden")), lambda x: x != ""), _list("open_questions"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "claim_id", lines.alias("lines"))))
    by_case = claims.groupBy("case_id").agg(F.flatten(F.transform(rows, lambda r: r["lines"])).alias("lines"))
    both = drafts.select("case_id", "in_fact").join(by_case, "case_id", "full")
    head = F.filter(F.array(_text("in_fact")), lambda x: x != "")
    return both.select("case_id", F.array_join(F.concat(head, _list("lines")), "\n").alias("text"))


def skeleton_is_stale(operative: Column) -> Column:
    """Whether an operative part is blank or still the generated one, so that it may be written anew."""
    body = T.trimmed(_text(operative))
    marks = F.lit(True)
    for mark in C.SKELETON_MARKS:
        marks = marks & F.contains(body, F.lit(mark))
    return (body == "") | marks


def fallback_reasoning(party: Column, kind: Column, text: Column, burden: Column, questions: Column) -> Column:
    """Reasoning for a claim that a model left without one."""
    named = F.when(_text(kind) != "", kind).otherwise(T.claim_kind(text, party))
    middle = F.lit(C.FALLBACK_MIDDLE[""])
    for name in ("difesa_eccezione", "istruttoria"):
        middle = F.when(named == name, F.lit(C.FALLBACK_MIDDLE[name])).otherwise(middle)
    tail = F.concat(F.when(_text(burden) != "", F.concat(F.lit(" "), burden)).otherwise(F.lit("")), F.when(F.size(questions) > 0, F.lit(C.FALLBACK_END)).otherwise(F.lit("")))
    return F.trim(F.concat(F.lit(C.FALLBACK_START[0]), party, F.lit(C.FALLBACK_START[1]), T.trimmed(text), F.lit("."), middle, tail))


def manual_lead(text: Column) -> Column:
    """A lead from pasted results doesn't open as if it came from a web search."""
    out = text
    for opening in reversed(C.SEARCH_OPENINGS):
        out = F.when(F.startswith(text, F.lit(opening)), F.concat(F.lit(C.PASTED_OPENING), F.substring(text, len(opening) + 1, 1 << 30))).otherwise(out)
    return out


def error_kind(message: Column) -> Column:
    """``model_unreachable`` for a failed connection to the model's server, else the message itself."""
    low, lost = F.lower(_text(message)), F.lit(False)
    for sign in C.UNREACHABLE:
        lost = lost | F.contains(low, F.lit(sign))
    return F.when(lost, F.lit("model_unreachable")).otherwise(_text(message))


def lead_lines(results: DataFrame, key: str = "case_id") -> DataFrame:
    """results (key, ord, title, summary, source) as one text a key: a line a result, in order."""
    line = F.concat(F.lit("- "), _text("title"), F.lit(": "), _text("summary"), F.lit(" ["), _text("source"), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return results.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def chronology(docs: DataFrame) -> DataFrame:
    """Documents of each case with their place by order and date."""
    w = Window.partitionBy("case_id").orderBy("ord", "created", "doc_id")
    name = F.regexp_extract(_text("file_name"), r"([^/]*)$", 1)
    return docs.select("case_id", "doc_id", name.alias("name"), F.row_number().over(w).alias("place"))


def key_evidence(claims: DataFrame, n: int = 5) -> DataFrame:
    """The best sources over all claims of a case: (case_id, place, claim_id, doc_id, score); ties by claim, then place in its list.

    claims: case_id, claim_id, sources and, if claims have an order of their own, ord. Kept as a bounded heap a case.
    """
    order = F.col("ord") if "ord" in claims.columns else F.col("claim_id")
    found = claims.select("case_id", "claim_id", order.alias("_ord"), F.posexplode("sources").alias("_pos", "s"))
    found = found.select("case_id", F.struct((-F.coalesce("s.score", F.lit(0.0))).alias("k"), "_ord", "claim_id", "_pos", F.col("s.doc_id").alias("doc_id")).alias("x"))
    w = Window.partitionBy("case_id").orderBy("x")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("case_id", "place", "x.claim_id", "x.doc_id", (-F.col("x.k")).alias("score"))


def _first(df: DataFrame, order: list, n: int, what: Column, name: str) -> DataFrame:
    """The first ``n`` rows of a case as an ordered array; a window limit, so no case is gathered whole."""
    w = Window.partitionBy("case_id").orderBy(*order)
    rows = df.select("case_id", F.row_number().over(w).alias("_r"), what.alias("_x")).where(F.col("_r") <= n)
    return rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_x"))), lambda x: x["_x"]).alias(name))


def dashboard(cases: DataFrame, registry: DataFrame, claims: DataFrame, rows: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row a case: its first placeholders, claims, best sources, gaps, issues and actions, each list capped.

    cases (case_id), registry (case_id, placeholder), claims (case_id, claim_id, ord, sources), rows as in matrix.matrix(),
    with claim_ord and fact_ord where their order isn't that of the ids. Issues and actions come row by row and rule by
    rule in a row, those of the whole case last. The matrix is computed once and written to the shared folder.
    """
    m = matrix(rows).drop("sources", "open_questions", "not_contested")
    m = scratch(m.withColumns({f"{k}_ord": F.col(f"{k}_id") for k in ("claim", "fact") if f"{k}_ord" not in m.columns}), "matrix")
    issues = red_team(m, drafts)
    parts = (
        _first(registry.select("case_id", "placeholder").distinct(), ["placeholder"], C.DASHBOARD["placeholders"], F.col("placeholder"), "placeholders"),
        _first(claims, ["ord", "claim_id"], C.DASHBOARD["claims"], F.col("claim_id"), "claims"),
        _first(key_evidence(claims), ["place"], 5, F.struct("claim_id", "doc_id", "score"), "key_evidence"),
        _first(m.select("case_id", "claim_ord", "fact_ord", "fact_id", F.posexplode("gaps").alias("p", "gap")), ["claim_ord", "fact_ord", "fact_id", "p"], C.DASHBOARD["gaps"], F.struct("fact_id", "gap"), "gaps"),
        _first(issues, [issue_order()], C.DASHBOARD["risks"], F.struct("rule", "claim_id", "fact_id", "severity"), "risks"),
        _first(actions(issues), ["at"], C.DASHBOARD["actions"], F.struct("action", "claim_id", "fact_id", "severity"), "actions"),
    )
    out = cases.select("case_id")
    for part in parts:
        name = part.columns[-1]
        out = out.join(part, "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def assisted_privacy(entities: DataFrame, reports: DataFrame) -> DataFrame:
    """The privacy part of a readiness report, one row a case: ok, its registry by placeholder, and what looks wrong.

    entities (case_id, placeholder, value), reports (case_id, report), the report as of privacy.privacy_report(). ``residues``
    are the leaks, then the unknown names.
    """
    names = entities.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("placeholder", "value"))).alias("entities"))
    residues = F.concat(F.transform("report.leaks", lambda x: x["token"]), F.transform("report.unknown", lambda x: x["token"]))
    rows = reports.join(names, "case_id", "left")
    return rows.select("case_id", F.col("report.ok").alias("ok"), F.coalesce("entities", F.array().cast(names.schema["entities"].dataType)).alias("entities"), F.col("report.malformed").alias("malformed"), residues.alias("residues"))


def export_checklist(ready: DataFrame) -> DataFrame:
    """The seven items to tick before a case is exported, from a row of matrix.readiness() joined with its counts.

    ready: blocks, warnings and counts of readiness().
    """
    blocked = lambda *codes: F.arrays_overlap("blocks", F.array(*[F.lit(c) for c in codes]))
    warned = lambda code: F.array_contains("warnings", code)
    return ready.select(
        "case_id", (~blocked("none_usable", "to_verify", "processing")).alias("documents"), ((F.col("claims") > 0) & ~blocked("analysis_open")).alias("claims_extracted"), ((F.col("uncovered_rows") == 0) & ~warned("weak_sources")).alias("sources_compared"),
        (F.col("open_questions") == 0).alias("questions_settled"), (~blocked("no_draft", "no_operative_part")).alias("operative_part"), (~blocked("privacy")).alias("privacy_clean"), (~blocked("severe_issues")).alias("no_severe_issues"), (F.size("blocks") == 0).alias("ready"),
    )


def deepen(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """A model's answers on claims as they are kept.

    claims: claim_id, case_id, party, kind, text, and the answer's attachments (as text), burden, reasoning,
    not_contested, open_questions; docs: case_id, doc_id, section, text. Attachments that aren't the case's documents go.
    Facts called uncontested that the documents don't bear out become questions; the burden of proof is put right; a
    missing reasoning is made up from the rest.
    """
    named = claims.select("claim_id", "case_id", F.posexplode(F.array_distinct(F.transform(_list("attachments"), lambda x: x.try_cast("long")))).alias("pos", "doc_id"))
    there = named.join(docs.select("case_id", "doc_id").distinct(), ["case_id", "doc_id"], "left_semi")
    in_order = lambda what: F.transform(F.array_sort(F.collect_list(F.struct("pos", what))), lambda x: x[what])
    kept = there.groupBy("claim_id").agg(in_order("doc_id").alias("_attachments"))
    said = claims.select("claim_id", "case_id", F.posexplode(F.filter(_list("not_contested"), lambda x: _text(x) != "")).alias("pos", "text"))
    judged = undisputed(said, docs).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "supported"))).alias("_said"))
    rows = claims.join(kept, "claim_id", "left").join(judged, "claim_id", "left")
    pick = lambda test: F.transform(F.filter("_said", test), lambda x: x["text"])
    backed, doubted = pick(lambda x: x["supported"]), F.transform(pick(lambda x: ~x["supported"]), lambda x: F.concat(F.lit(C.UNCONTESTED_DOUBT), x))
    none = F.array().cast("array<string>")
    questions = F.concat(F.filter(_list("open_questions"), lambda x: _text(x) != ""), F.coalesce(doubted, none))
    rows = rows.withColumns({"attachments": F.coalesce("_attachments", F.array().cast("array<bigint>")), "not_contested": F.coalesce(backed, none), "open_questions": questions, "burden": burden(F.col("kind"), F.col("party"), F.col("text"), T.trimmed(_text("burden")))})
    reasoning = T.trimmed(_text("reasoning"))
    made_up = fallback_reasoning(F.col("party"), F.col("kind"), F.col("text"), F.col("burden"), F.col("open_questions"))
    return rows.withColumn("reasoning", F.when(reasoning != "", reasoning).otherwise(made_up)).drop("_attachments", "_said")
