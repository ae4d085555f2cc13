"""Knowledge graph: merge by key, visibility, neighbours, degrees and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.functions import text as T
from caseweave.scratch import discard, scratch


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """mentions (doc_id, seq, kind, label, summary) to one node a key, by grouped minima (hot keys pre-aggregate).

    Label, kind and document come from the first mention, the summary from the first that has one. Blank labels and
    empty keys are skipped; an unknown kind is a concept.
    """
    label = F.trim(F.coalesce("label", F.lit("")))
    rows = mentions.select("doc_id", "seq", F.when(F.col("kind") == "riferimento", F.lit("riferimento")).otherwise(F.lit("concetto")).alias("kind"), label.alias("label"), F.nullif(F.trim(F.coalesce("summary", F.lit(""))), F.lit("")).alias("summary"), T.graph_key(label).alias("key")).where("key <> ''")
    at = F.struct("doc_id", "seq", "label")
    first = lambda c: F.min_by(F.col(c), at).alias(c)
    summary = F.min_by(F.col("summary"), F.when(F.col("summary").isNotNull(), at))
    return rows.groupBy("key").agg(first("kind"), first("label"), F.coalesce(summary, F.lit("")).alias("summary"), first("doc_id"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """edges (doc_id, seq, from_label, to_label, kind) to distinct (from_key, to_key, kind, weight); no self loops."""
    kind = F.when(F.col("kind").isin(*C.EDGE_KINDS), F.col("kind")).otherwise(F.lit("correlato"))
    rows = edges.select(T.graph_key(F.col("from_label")).alias("from_key"), T.graph_key(F.col("to_label")).alias("to_key"), kind.alias("kind"))
    return rows.where("from_key <> '' AND to_key <> '' AND from_key <> to_key").distinct().withColumn("weight", F.lit(1.0))


def materialise(mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, those that only edges name included, and edges."""
    ends = [edges.select("doc_id", (F.col("seq") + F.lit(10**9)).alias("seq"), F.lit("concetto").alias("kind"), F.col(c).alias("label"), F.lit("").alias("summary")) for c in ("from_label", "to_label")]
    named = mentions.select("doc_id", F.col("seq").cast("long").alias("seq"), "kind", "label", "summary")
    return merge_nodes(named.unionByName(ends[0]).unionByName(ends[1])), merge_edges(edges)


def upsert_cases(nodes: DataFrame, cases: DataFrame) -> DataFrame:
    """Case nodes (key ``caso:<id>``) take the newest label and summary; cases (case_id, label, summary)."""
    new = cases.select(F.concat(F.lit("caso:"), F.col("case_id").cast("string")).alias("key"), F.lit("caso").alias("kind"), "label", "summary", F.lit(None).cast("long").alias("doc_id"))
    return nodes.join(new.select("key"), "key", "left_anti").unionByName(new)


def case_edges(cases: DataFrame, references: DataFrame) -> DataFrame:
    """``applica`` edges from cases (case_id, text) to references (case_id, label) that the case's text bears out."""
    rows = references.join(cases.select("case_id", "text"), "case_id").where(T.reference_present(F.col("label"), F.col("text")))
    return rows.select(F.concat(F.lit("caso:"), F.col("case_id").cast("string")).alias("from_key"), T.graph_key(F.col("label")).alias("to_key"), F.lit("applica").alias("kind")).where("to_key <> ''").distinct()


def visible_nodes(nodes: DataFrame, documents: DataFrame, cases: DataFrame, user: int, staff: bool = False) -> DataFrame:
    """Nodes of one's own cases, and those without a case whose document is absent, global or one's own."""
    if staff:
        return nodes
    rows = nodes.join(documents.select("doc_id", F.col("creator_id").alias("_creator")), "doc_id", "left").join(cases.select("case_id", F.col("owner_id").alias("_owner")), "case_id", "left")
    free = F.col("case_id").isNull()
    seen = (F.col("_owner") == user) | (free & (F.col("doc_id").isNull() | F.col("_creator").isNull() | (F.col("_creator") == user)))
    return rows.where(F.coalesce(seen, F.lit(False))).select(nodes.columns)


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (key)."""
    keys = nodes.select("key")
    return edges.join(keys.withColumnRenamed("key", "from_key"), "from_key", "left_semi").join(keys.withColumnRenamed("key", "to_key"), "to_key", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other) in both directions, one row a pair of ends."""
    back = edges.select(F.col("to_key").alias("node"), F.col("from_key").alias("other"))
    return edges.select(F.col("from_key").alias("node"), F.col("to_key").alias("other")).unionByName(back).distinct()


def neighbours(edges: DataFrame, key) -> DataFrame:
    return undirected(edges).where(F.col("node") == key).select("other")


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of each node over edges collapsed to one an ordered pair, and its drawn size."""
    pairs = edges.select("from_key", "to_key").distinct()
    ends = pairs.select(F.explode(F.array("from_key", "to_key")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).withColumn("size", F.round(4 + 2.2 * F.sqrt("degree"), 6))


def _wishes(links: DataFrame, at: DataFrame, total: float) -> DataFrame:
    """(node, k, community, to, gain): for every node that gains by a move, the community around it where it gains most.

    ``gain`` is the change of modularity times half of ``total``, the others staying where they are.
    """
    sizes = at.groupBy("community").agg(F.sum("k").alias("size"))
    around = links.where("node <> other").join(at.select(F.col("node").alias("other"), F.col("community").alias("near")), "other").groupBy("node", "near").agg(F.sum("w").alias("w"))
    rows = around.join(at, "node").join(sizes.withColumnRenamed("community", "near"), "near")
    score = F.when(F.col("near") != F.col("community"), F.struct((F.col("k") * F.col("size") / total - F.col("w")).alias("s"), F.col("near").alias("to")))
    best = rows.groupBy("node", "k", "community").agg(F.min(score).alias("best"), F.coalesce(F.max(F.when(F.col("near") == F.col("community"), F.col("w"))), F.lit(0.0)).alias("own"))
    gain = -F.col("best.s") - F.col("own") + F.col("k") * (F.col("size") - F.col("k")) / total
    return best.where("best IS NOT NULL").join(sizes, "community").select("node", "k", "community", "best.to", gain.alias("gain")).where(F.col("gain") > 1e-9)


def _together(wishes: DataFrame, total: float, turn: int) -> DataFrame:
    """Those of the moves that raise modularity when made at once.

    A community either gives or takes, by its best move. Two nodes that leave or enter one community spoil each other's
    gain by k k' / total at most; moves that bear their share of all of these are made, and where a community has none
    such, the move that is the best of both its communities.
    """
    most = lambda c, name: wishes.groupBy(F.col(c).alias("c")).agg(F.max("gain").alias(name))
    drawn = (F.col("enters") == F.col("leaves")) & (F.xxhash64("c", F.lit(turn)) % 2 == 0)
    roles = most("to", "enters").join(most("community", "leaves"), "c", "full").na.fill(0.0).select("c", ((F.col("enters") > F.col("leaves")) | drawn).alias("takes"))
    role = lambda c, takes: roles.where(F.col("takes") == takes).select(F.col("c").alias(c))
    both = scratch(wishes.join(role("to", True), "to", "left_semi").join(role("community", False), "community", "left_semi"), "moves", tidy=True)
    size = lambda c: both.groupBy(c).agg(F.sum("k").alias(f"{c}_k"))
    share = F.col("k") * (F.col("to_k") + F.col("community_k") - 2 * F.col("k")) / (2 * total)
    sized = scratch(both.join(size("to"), "to").join(size("community"), "community").withColumn("free", F.col("gain") > share), "moves", tidy=True)
    best = lambda c: sized.groupBy(c).agg(F.max("free").alias(f"{c}_free"), F.min(F.struct(-F.col("gain"), "node"))["node"].alias(f"{c}_best"))
    alone = ~F.col("to_free") & ~F.col("community_free") & (F.col("node") == F.col("to_best")) & (F.col("node") == F.col("community_best"))
    made = scratch(sized.join(best("to"), "to").join(best("community"), "community").where(F.col("free") | alone).select("node", "to"), "moves", tidy=True)
    discard(both)
    discard(sized)
    return made


def _settle(links: DataFrame, total: float, rounds: int) -> DataFrame:
    """(node, k, community) after rounds of moves, each node alone at first; ends when no move gains or a twentieth of the nodes or fewer move."""
    at = scratch(links.groupBy("node").agg(F.sum("w").alias("k")).withColumn("community", F.col("node")), "places", tidy=True)
    nodes = at.count()
    for turn in range(rounds):
        wishes = scratch(_wishes(links, at, total), "wishes", tidy=True)
        moves = _together(wishes, total, turn)
        made = moves.count()
        last, at = at, scratch(at.join(moves, "node", "left").select("node", "k", F.coalesce("to", "community").alias("community")), "places", tidy=True)
        done = wishes.isEmpty() or (made > 0 and made * 20 < nodes)
        for spent in (wishes, moves, last):
            discard(spent)
        if done:
            break
    return at


def communities(edges: DataFrame, rounds: int = 12, levels: int = 10) -> DataFrame:
    """(node, community): multi-level search for the greatest modularity; a community is named by its smallest node.

    Gains of moves are grouped sums over links, moves that can be made at once are chosen by grouped maxima, and each
    level's communities are the nodes of the next, smaller graph, until none merge. No step lowers modularity, and a
    re-run gives the same. An ordered pair of ends counts once, loops not at all; a node without links is alone. Null
    ends make no link.
    """
    ends = edges.select(F.explode(F.array("from_key", "to_key")).alias("node")).where("node IS NOT NULL").distinct()
    place = scratch(ends.withColumn("community", F.col("node")), "members", tidy=True)
    pairs = edges.select(F.col("from_key").alias("node"), F.col("to_key").alias("other")).where("node <> other").distinct()
    links = scratch(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).groupBy("node", "other").agg(F.count("*").cast("double").alias("w")), "links", tidy=True)
    total = links.agg(F.sum("w")).first()[0]
    for _ in range(levels if total else 0):
        own = _settle(links, total, rounds).select("node", "community")
        if own.where("node <> community").isEmpty():
            break
        up = own.select(F.col("node").alias("community"), F.col("community").alias("_up"))
        last, place = place, scratch(place.join(up, "community", "left").select("node", F.coalesce("_up", "community").alias("community")), "members", tidy=True)
        discard(last)
        far = own.select(F.col("node").alias("other"), F.col("community").alias("_far"))
        last, links = links, scratch(links.join(own, "node").join(far, "other").groupBy(F.col("community").alias("node"), F.col("_far").alias("other")).agg(F.sum("w").alias("w")), "links", tidy=True)
        discard(last)
        discard(own)
    names = place.groupBy("community").agg(F.min("node").alias("name"))
    return place.join(names, "community").select("node", F.col("name").alias("community"))


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """Modularity of members (node, community) over edges as communities() counts them; 0 without links."""
    pairs = edges.select("from_key", "to_key").where("from_key <> to_key").distinct()
    side = lambda n, c: members.select(F.col("node").alias(n), F.col("community").alias(c))
    rows = scratch(pairs.join(side("from_key", "a"), "from_key").join(side("to_key", "b"), "to_key").select("a", "b"), "ends", tidy=True)
    inside, all_ = rows.agg(F.coalesce(F.avg((F.col("a") == F.col("b")).cast("double")), F.lit(0.0)), F.count("*")).first()
    sizes = rows.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    return inside - (sizes.agg(F.sum((F.col("k") / (2.0 * all_)) ** 2)).first()[0] if all_ else 0.0)


def search(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 8) -> DataFrame:
    """Nodes whose label, key, kind or summary holds the query, in any case; the first ``limit`` by key."""
    text = F.lower(F.concat_ws(" ", "label", "key", "kind", "summary"))
    rows = nodes.where(F.contains(text, F.lit(query.lower())))
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("key").limit(limit)


def project(nodes: DataFrame) -> DataFrame:
    """Where a node comes from and a summary of 240 characters."""
    origin = F.when(F.col("case_id").isNotNull(), F.lit("caso")).when(F.col("doc_id").isNotNull(), F.lit("corpus")).otherwise(F.lit("globale"))
    return nodes.select("key", "kind", "label", F.substring("summary", 1, 240).alias("snippet"), origin.alias("origin"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Order of nodes inside their community, by key."""
    return nodes.withColumn("position", F.row_number().over(Window.partitionBy("community").orderBy("node")))
