"""Who may see, change or start what, and the counts over what they see. A null owner is nobody's, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions import constants as C

from .graph import visible_edges, visible_nodes


def _mine(owner: str, user: int) -> Column:
    return F.col(owner).eqNullSafe(F.lit(user))


def owned(df: DataFrame, owner: str, user: int, staff: bool = False) -> DataFrame:
    """One's own rows; staff take all."""
    return df if staff else df.where(_mine(owner, user))


def deletable_documents(docs: DataFrame, user: int, staff: bool = False) -> DataFrame:
    """Corpus documents that a user may delete: those they made. Global ones (no creator) are staff's."""
    return owned(docs, "creator_id", user, staff)


def deletable_fragments(fragments: DataFrame, docs: DataFrame, user: int, staff: bool = False) -> DataFrame:
    """Fragments (doc_id) of documents that the user may delete."""
    return fragments if staff else fragments.join(deletable_documents(docs, user).select("doc_id"), "doc_id", "left_semi").select(fragments.columns)


def deletable_nodes(nodes: DataFrame, docs: DataFrame, cases: DataFrame, user: int, staff: bool = False) -> DataFrame:
    """A case's node is its owner's to delete, else a document's its maker's; nodes of neither are staff's."""
    if staff:
        return nodes
    makers = docs.select("doc_id", F.col("creator_id").alias("_maker"))
    owners = cases.select("case_id", F.col("owner_id").alias("_owner"))
    decides = F.when(F.col("case_id").isNotNull(), F.col("_owner")).when(F.col("doc_id").isNotNull(), F.col("_maker"))
    rows = nodes.join(makers, "doc_id", "left").join(owners, "case_id", "left")
    return rows.where(decides.eqNullSafe(F.lit(user))).select(nodes.columns)


def deletable_edges(edges: DataFrame, nodes: DataFrame, docs: DataFrame, cases: DataFrame, user: int, staff: bool = False) -> DataFrame:
    """Edges both of whose ends the user may delete."""
    return edges if staff else visible_edges(edges, deletable_nodes(nodes, docs, cases, user)).select(edges.columns)


def in_category(df: DataFrame, category: str | None, column: str = "category") -> DataFrame:
    """Rows of one category; no category given, all rows."""
    return df.where(F.col(column) == category) if category else df


def containing(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column holds the query, in any case; a blank query holds everywhere."""
    wanted = query.strip().lower()
    return df.where(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(wanted))) if wanted else df


def open_comments(comments: DataFrame) -> DataFrame:
    return comments.where(~F.coalesce("resolved", F.lit(False)))


def editor_events(events: DataFrame, n: int = 3) -> DataFrame:
    """The latest ``n`` events by which a draft or a reasoning changed."""
    return events.where(F.col("kind").isin(*C.EDITOR_EVENTS)).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def model_choice(wants_external: Column, configured: Column) -> Column:
    """Which model a request may use: the local one unless the external one is asked for; refused where that isn't set up."""
    return F.when(~F.coalesce(wants_external, F.lit(False)), F.lit("local")).when(configured, F.lit("external")).otherwise(F.lit("refused"))


def start_decision(phase_state: Column, usable: Column, awaiting: Column, confirmed: Column) -> Column:
    """Whether analysis may start: running, no_documents, confirm_partial, or start."""
    return (
        F.when(phase_state == "in_corso", F.lit("running"))
        .when(F.coalesce(usable, F.lit(0)) == 0, F.lit("no_documents"))
        .when((F.coalesce(awaiting, F.lit(0)) > 0) & ~F.coalesce(confirmed, F.lit(False)), F.lit("confirm_partial"))
        .otherwise(F.lit("start"))
    )


def fragment_counts(docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc_id, n_fragments) for every document."""
    counts = fragments.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_fragments"))


def graph_counts(nodes: DataFrame, edges: DataFrame, docs: DataFrame, cases: DataFrame, user: int, staff: bool = False) -> DataFrame:
    """One row: nodes that a user sees, and edges between them."""
    seen = visible_nodes(nodes, docs, cases, user, staff)
    both = visible_edges(edges, seen)
    return seen.agg(F.count("*").alias("n_nodes")).crossJoin(both.agg(F.count("*").alias("n_edges")))  # one row each


def worklist(corpus: DataFrame, cases: DataFrame, scope: str, user: int | None = None, staff: bool = False, case_id: int | None = None) -> DataFrame:
    """(origin, id) of what a graph is built from: finished corpus documents and a user's analysed cases, as the scope says."""
    docs = corpus.where("state = 'completato'")
    if scope not in ("tutto", "corpus"):
        docs = docs.limit(0)
    elif user is not None and not staff:
        docs = docs.where(F.col("creator_id").isNull() | _mine("creator_id", user))
    own = cases.where(F.lit(user is not None and scope in ("tutto", "fascicoli", "lavoro")) & (F.col("owner_id") == F.lit(user)) & (F.col("analysis_state") == "completata"))
    if scope == "lavoro" and case_id is not None:
        own = own.where(F.col("case_id") == case_id)
    return docs.select(F.lit("corpus").alias("origin"), F.col("doc_id").alias("id")).unionByName(own.select(F.lit("caso").alias("origin"), F.col("case_id").alias("id")))
