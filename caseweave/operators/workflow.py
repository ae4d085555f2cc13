"""Scoping, workflow counts, legal transitions, change capture and the ledger."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.functions import text as T

ACCEPTED = ("verificato", "accettato_senza_verifica")


def usable(docs: DataFrame) -> DataFrame:
    """Pseudonymised and accepted documents."""
    return docs.where(F.col("pseudonymised") & F.col("acceptance").isin(*ACCEPTED))


def awaiting_verification(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("pseudonymised") & (F.col("acceptance") == "da_verificare"))


def _processing() -> Column:
    return F.col("extraction_state").isin("in_attesa", "in_corso") | (F.col("anonymisation_state") == "in_corso")


def document_counts(docs: DataFrame, key: str = "case_id") -> DataFrame:
    """Documents of each case by stage."""
    ready = F.col("pseudonymised") & F.col("acceptance").isin(*ACCEPTED)
    waiting = F.col("pseudonymised") & (F.col("acceptance") == "da_verificare")
    return docs.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(_processing()).alias("processing"), F.count_if("pseudonymised").alias("pseudonymised"),
        F.count_if(ready).alias("accepted"), F.count_if(waiting).alias("to_verify"),
    )


def checklist(cases: DataFrame, docs: DataFrame, claims: DataFrame, drafts: DataFrame) -> DataFrame:
    """A case's counts and whether analysis can start, can start in part, or is done."""
    by_claim = claims.groupBy("case_id").agg(F.count("*").alias("claims"), F.count_if(F.col("state") == "approfondita").alias("deepened"), F.count_if(F.coalesce("reasoning", F.lit("")) != "").alias("reasoned"))
    out = cases.join(document_counts(docs), "case_id", "left").join(by_claim, "case_id", "left").join(drafts.select("case_id", "operative_part"), "case_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "case_id", n("total").alias("documents"), n("accepted").alias("ready"), n("to_verify").alias("to_verify"), n("processing").alias("processing"),
        ((n("accepted") > 0) & (n("processing") == 0)).alias("can_start"), ((n("accepted") > 0) & (n("to_verify") > 0)).alias("can_start_in_part"),
        F.coalesce(F.col("analysis_state") == "completata", F.lit(False)).alias("analysed"), n("claims").alias("claims"), n("deepened").alias("deepened"), n("reasoned").alias("reasoned"),
        (F.trim(F.coalesce("operative_part", F.lit(""))) != "").alias("operative_part"),
    )


def duplicate_names(docs: DataFrame) -> DataFrame:
    """Documents of a case whose base name, case folded, came before: case_id, doc_id, name, first_id."""
    name = F.lower(F.regexp_extract(F.coalesce("file_name", F.lit("")), r"([^/]*)$", 1))
    w = Window.partitionBy("case_id", "name").orderBy("ord", "doc_id")
    rows = docs.select("case_id", "doc_id", "ord", name.alias("name")).withColumns({"first_id": F.first("doc_id").over(w), "r": F.row_number().over(w)})
    return rows.where("r > 1").select("case_id", "doc_id", "name", "first_id")


def first_seen(df: DataFrame, key: Column, order: list[str], id_col: str) -> DataFrame:
    """Each repeated row with the id of the first row of its key: a grouped minimum and a join, so hot keys split."""
    rows = df.select(id_col, F.struct(*order).alias("_o"), key.alias("_k"))
    first = rows.groupBy("_k").agg(F.min_by(F.col(id_col), F.col("_o")).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "_k").where(F.col(id_col) != F.col("first_id")).select(id_col, "first_id")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.TRANSITIONS, "before string, after string")


def illegal_transitions(changes: DataFrame, legal: DataFrame) -> DataFrame:
    """Changes (before, after) that the table of legal ones lacks."""
    return changes.join(F.broadcast(legal), ["before", "after"], "left_anti")


def missing_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def changed_fields(before: Column, after: Column) -> Column:
    """Map of the changed fields to (before, after); both are map<string, string>."""
    both = F.map_zip_with(before, after, lambda k, a, b: F.struct(a.alias("before"), b.alias("after")))
    return F.map_filter(both, lambda k, v: ~v["before"].eqNullSafe(v["after"]))


class Applied(NamedTuple):
    """What applying actions gives: changed facts and claims, and rows to append; refused actions change nothing.

    ``outcomes`` are events and refused actions in one pass: (case_id, seq, action, actor, valid, after).
    """

    facts: DataFrame
    claims: DataFrame
    comments: DataFrame
    events: DataFrame
    refused: DataFrame
    outcomes: DataFrame


def apply_actions(facts: DataFrame, claims: DataFrame, actions: DataFrame, now: Column | None = None) -> Applied:
    """Applies actions in the order of ``seq``, as if one after the other.

    facts (fact_id, claim_id, proof_state, operator_note, question), claims (claim_id, case_id, open_questions), actions
    (case_id, seq, action, fact_id, claim_id, text, actor); further columns of facts and claims stay. An action's target is
    its fact, which must belong to a claim of its case, else its claim, if it names one. ``segna_insufficiente`` and
    ``segna_da_verificare`` set a fact's state (the former fills an empty note), ``crea_quesito`` its question and adds it to
    the claim's open questions, others write a comment, with a standard text where they bring none. An action that needs a
    fact and has none, has an unknown target or name, is refused. Each fact and claim comes back once.
    """
    when = now if now is not None else F.current_timestamp()
    # Facts and claims are one table of targets, told apart by a mark, so that the actions are dealt out once.
    known = claims.select(F.col("claim_id").alias("_claim"), F.col("case_id").alias("_case"))
    own = facts.select(F.col("fact_id").alias("_fact"), F.col("claim_id").alias("_claim")).join(known, "_claim")
    targets = own.select(F.lit(True).alias("_by_fact"), F.col("_fact").alias("_target"), "_case", "_fact", "_claim")
    targets = targets.unionByName(known.select(F.lit(False).alias("_by_fact"), F.col("_claim").alias("_target"), "_case", F.lit(None).cast(facts.schema["fact_id"].dataType).alias("_fact"), "_claim"))
    rows = actions.withColumns({"_fact_named": F.col("fact_id").isNotNull(), "_wanted": F.coalesce("fact_id", "claim_id")})
    rows = rows.join(targets, (F.col("_wanted") == F.col("_target")) & (F.col("case_id") == F.col("_case")) & (F.col("_fact_named") == F.col("_by_fact")), "left")
    named = F.col("fact_id").isNotNull() | F.col("claim_id").isNotNull()
    found = ~named | (F.col("_claim").isNotNull() & (F.col("fact_id").isNull() | F.col("_fact").isNotNull()))
    on_fact = F.col("action").isin(*C.FACT_ACTIONS) & F.col("_fact").isNotNull()
    valid = F.coalesce(found & (on_fact | F.col("action").isin(*C.COMMENT_TEXTS)), F.lit(False))
    said = F.when(F.coalesce("text", F.lit("")) != "", F.col("text"))
    usual = F.try_element_at(F.create_map(*[F.lit(x) for pair in C.COMMENT_TEXTS.items() for x in pair]), F.col("action"))
    judged = rows.select(
        "case_id", "seq", "action", "actor", F.col("_fact").alias("fact_id"), F.col("_claim").alias("claim_id"), valid.alias("valid"), F.coalesce(said, F.when(F.col("action") == "crea_quesito", F.lit(C.QUESTION_TEXT)), usual).alias("text"), usual.alias("usual"),
    )
    done = judged.where("valid")
    state = F.when(F.col("action") == "segna_insufficiente", F.lit("insufficiente")).when(F.col("action") == "segna_da_verificare", F.lit("da_verificare"))
    asked = F.col("action") == "crea_quesito"
    by_fact = done.where(F.col("action").isin(*C.FACT_ACTIONS)).groupBy("fact_id").agg(
        F.max_by(state, F.when(state.isNotNull(), F.col("seq"))).alias("_state"), F.max_by("text", F.when(asked, F.col("seq"))).alias("_question"), F.bool_or(F.col("action") == "segna_insufficiente").alias("_noted")
    )
    note = F.when(F.col("_noted") & (F.coalesce("operator_note", F.lit("")) == ""), F.lit(C.INSUFFICIENT_NOTE)).otherwise(F.col("operator_note"))
    new_facts = facts.join(by_fact, "fact_id", "left").withColumns({"proof_state": F.coalesce("_state", "proof_state"), "question": F.coalesce("_question", "question"), "operator_note": note})
    # A question that a claim has already isn't added again; each new one comes once, in the order of its first asking.
    first = done.where(asked).groupBy("claim_id", "text").agg(F.min("seq").alias("seq"))
    by_claim = first.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("_asked"))
    old = F.coalesce("open_questions", F.array().cast("array<string>"))
    added = F.concat(old, F.filter("_asked", lambda q: ~F.array_contains(old, q)))
    new_claims = claims.join(by_claim, "claim_id", "left").withColumn("open_questions", F.when(F.col("_asked").isNotNull(), added).otherwise(F.col("open_questions")))
    notes = done.where(F.col("action").isin(*C.COMMENT_TEXTS))
    section = F.when(F.col("action") == "compila_pqm", F.lit("pqm")).otherwise(F.lit("in_diritto"))
    comments = notes.select("case_id", "seq", "actor", section.alias("section"), F.col("claim_id").alias("ref_id"), "text", F.lit(False).alias("resolved"))
    events = done.select("case_id", "seq", "actor", "claim_id", "fact_id", F.lit("azione_lacuna").alias("kind"), F.col("action").alias("field"), F.lit(None).cast("string").alias("before"), F.to_json(F.struct(F.col("action").alias("tipo"))).alias("after"), when.alias("ts"))
    outcomes = judged.select("case_id", "seq", "action", "actor", "valid", F.when(F.col("valid"), F.to_json(F.struct(F.col("action").alias("tipo")))).alias("after"))
    return Applied(new_facts.select(facts.columns), new_claims.select(claims.columns), comments, events, judged.where("NOT valid").select("case_id", "seq", "action", "actor"), outcomes)


def first_rows(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """A first matrix row (claim_id, text, question, ord) for each claim that has none: its opening text and question.

    claims: claim_id, text, open_questions, burden. facts: claim_id.
    """
    bare = missing_rows(claims, facts, "claim_id")
    return bare.select("claim_id", T.opening_text(F.col("text")).alias("text"), T.opening_question(F.col("open_questions"), F.col("burden")).alias("question"), F.lit(0).alias("ord"))


def edit_metadata(docs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with edited display name, place and kind, and the refused edits.

    docs: doc_id, display_name, ord, kind, and any other columns. edits (doc_id, seq, display_name, ord, kind): null leaves a
    field as it is; names are cut at 255 characters and kinds at 64, places are at least 0. An edit whose place (text) is no
    whole number is refused whole. Of several edits of a document each field's last one holds.
    """
    place = F.when(F.trim("ord") == "", F.lit(0)).otherwise(F.trim("ord").try_cast("int"))
    rows = edits.withColumn("_place", place)
    bad = F.col("ord").isNotNull() & F.col("_place").isNull()
    last = lambda c, v: F.max_by(v, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    by_doc = rows.where(~bad).groupBy("doc_id").agg(last("display_name", F.substring("display_name", 1, 255)), last("ord", F.greatest(F.lit(0), F.col("_place"))), last("kind", F.substring("kind", 1, 64)))
    out = docs.join(by_doc, "doc_id", "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("display_name", "ord", "kind")})
    return out.select(docs.columns), rows.where(bad).drop("_place")


def rate_source(sources: Column, anchor: Column, rating: Column) -> Column:
    """The rating of the source with exactly this anchor."""
    return F.transform(sources, lambda s: s.withField("rating", F.when(s["anchor"] == anchor, rating).otherwise(s["rating"])))


def bulk_accept(docs: DataFrame) -> DataFrame:
    """All pseudonymised documents as accepted without verification, those verified before included."""
    return docs.withColumn("acceptance", F.when(F.col("pseudonymised"), F.lit("accettato_senza_verifica")).otherwise(F.col("acceptance")))


def latest(events: DataFrame, n: int, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    return events.orderBy(F.desc(ts), F.desc(id_col)).limit(n)


def operative_skeleton(claims: DataFrame) -> DataFrame:
    """Numbered lines of a case's claims in order: (case_id, text)."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "claim_id", F.col("text").alias("t"))))
    lines = F.transform(rows, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["t"]))
    return claims.groupBy("case_id").agg(F.array_join(lines, "\n").alias("text"))


def report_lines(rows: DataFrame, events: DataFrame) -> DataFrame:
    """An audit report as ordered lines (case_id, ord, style, text): matrix rows, their five best sources, 40 latest events.

    rows: case_id, claim_id, text, sources. events: case_id, event_id, kind, ts.
    """
    claims = rows.select("case_id", F.col("claim_id").alias("a"), F.lit(0).alias("b"), F.lit("claim").alias("style"), F.col("text"))
    top = F.slice(F.array_sort(F.col("sources"), lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(0)), 1, 5)
    cited = rows.select("case_id", F.col("claim_id").alias("a"), F.posexplode(top).alias("b", "s")).select("case_id", "a", (F.col("b") + 1).alias("b"), F.lit("source").alias("style"), F.concat(F.col("s.anchor"), F.lit(" "), F.format_number("s.score", 2)).alias("text"))
    w = Window.partitionBy("case_id").orderBy(F.desc("ts"), F.desc("event_id"))
    log = events.withColumn("b", F.row_number().over(w)).where("b <= 40").select("case_id", F.lit(2**62).alias("a"), "b", F.lit("event").alias("style"), F.concat(F.date_format("ts", "dd/MM/yyyy HH:mm"), F.lit(" "), F.col("kind")).alias("text"))
    lines = claims.unionByName(cited).unionByName(log)
    return lines.select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy("a", "b")).alias("ord"), "style", "text")
