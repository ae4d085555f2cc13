"""Claims from model answers and from the texts' own conclusions, without near duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseweave.functions import constants as C
from caseweave.functions import text as T
from caseweave.functions.ratio import GRAM as GRAM_SHARED
from caseweave.functions.ratio import LONG, different, gram_bits, least_hashes, letter_counts, ratios, starters, stretch_hashes
from caseweave.scratch import scratch

ANSWER = "claims array<struct<party:string,text:string,confidence:string,flags:array<string>,open_questions:array<string>>>"


def parse_answers(answers: DataFrame) -> DataFrame:
    """answers (case_id, raw) to one row a claim. An answer that is no JSON gives none and fails nothing."""
    parsed = F.from_json(T.json_object(F.col("raw")), ANSWER)
    return answers.select("case_id", F.posexplode(parsed["claims"]).alias("seq", "c")).select("case_id", "seq", "c.*", F.lit(False).alias("heuristic"))


def conclusions(docs: DataFrame) -> DataFrame:
    """docs (case_id, doc_id, section, ord, text) to one row a numbered item under a "conclusions" heading.

    The party is the heading's or the section's; from a counterclaim on, the rest of its block is the defendant's.
    """
    heads = T.all_matches(F.col("text"), C.CONCLUSIONS, 0)
    bodies = T.all_matches(F.col("text"), C.CONCLUSIONS, 1)
    blocks = docs.select("case_id", "doc_id", "section", "ord", F.posexplode(F.arrays_zip(heads.alias("head"), bodies.alias("body"))).alias("block", "b"))
    default = F.when(F.col("section") == "convenuto", F.lit("convenuto")).otherwise(F.lit("attore"))
    named = F.contains(F.lower(F.substring_index("b.head", ":", 1)), F.lit("convenuto"))
    rows = blocks.withColumn("party0", F.when(named, F.lit("convenuto")).otherwise(default))
    items = F.slice(F.split(F.concat(F.lit("\n"), F.col("b.body")), r"(?m)^\s*\d+[.)]\s+"), 2, 1 << 20)
    tidy = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^[ ;.]+|[ ;.]+$", ""))
    start = F.struct(F.col("party0").alias("party"), F.array().cast("array<struct<party:string,kind:string,text:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        kind = T.claim_kind(x, s["party"])
        party = F.when(kind == "riconvenzionale", F.lit("convenuto")).otherwise(s["party"])
        return F.struct(party.alias("party"), F.concat(s["out"], F.array(F.struct(party.alias("party"), kind.alias("kind"), x.alias("text")))).alias("out"))

    found = F.aggregate(F.filter(tidy, lambda x: x != ""), start, step, lambda s: s["out"])
    return rows.select("case_id", "doc_id", "ord", "block", F.posexplode(found).alias("item", "c")).select("case_id", "doc_id", "ord", "block", "item", "c.*")


def normalise(claims: DataFrame) -> DataFrame:
    """Party, kind, confidence and flags of raw claims (case_id, seq, party, text, confidence, flags, heuristic).

    A counterclaim is always the defendant's, and the kind always comes from the text.
    """
    none = F.array().cast("array<string>")
    low = F.lower(F.trim("text"))
    said = F.lower(F.coalesce("party", F.lit("")))
    party = F.when(F.contains(said, F.lit("conven")) | F.contains(said, F.lit("ricorr")) | F.contains(low, F.lit("riconvenzional")), F.lit("convenuto")).otherwise(F.lit("attore"))
    rows = claims.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumns({"text": F.trim("text"), "party": party})
    rows = rows.withColumn("kind", T.claim_kind(F.col("text"), F.col("party")))
    mixed = F.contains(F.lower("text"), F.lit("rigett")) & F.contains(F.lower("text"), F.lit("riconvenzional"))
    extra = F.filter(F.array(F.when(mixed, F.lit("mixed_defence_and_counterclaim")), F.when(F.col("heuristic"), F.lit("from_conclusions"))), lambda x: x.isNotNull())
    return rows.withColumns(
        {
            "party": F.when(F.col("kind") == "riconvenzionale", F.lit("convenuto")).otherwise(F.col("party")),
            "confidence": T.confidence(F.col("confidence")), "flags": F.array_distinct(F.concat(F.coalesce("flags", none), extra)),
        }
    )


#: Two claims are similar if one's normal form holds the other's, they share so much of their words, or are so much alike.
SHARED, ALIKE = 0.72, 0.82
#: Common words that two texts must meet by before their words are compared.
MET = 3
#: Characters of the parts that containment is looked up by, neighbouring parts of which the least one counts, bits of the filter of short texts.
GRAM, WINDOW, SLOTS = 8, 24, 1 << 27
#: Texts compared at once; texts and characters of a unit of work's side, sides of a band at most, and tasks at most.
BLOCK, UNIT_TEXTS, UNIT_CHARS, SIDES, TASKS = 512, 1 << 14, 1 << 23, 32, 4096


def _parts(of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each text and each of the hashes that ``of`` gives for it, in place of its ``norm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                small = batch.slice(k, 64)
                part, row = of(small.column("norm").to_pylist())
                rows = small.drop_columns(["norm"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(part.view(np.int64))], [*rows.schema.names, "part"])

    return run


def _least_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    (_, part, row), = stretch_hashes(texts, {GRAM})
    return least_hashes(part, row, WINDOW)


def _whole_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each text as a whole."""
    size, found = np.array([len(t) for t in texts]), np.zeros(len(texts), np.uint64)
    for n, part, row in stretch_hashes(texts, {*size.tolist()}):
        own = size[row] == n
        found[row[own]] = part[own]
    return found, np.arange(len(texts))


def _held_parts(sizes: set[int], slots: Broadcast) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """The stretches of a text that have one of the sizes, and, for all that a filter of hashes can tell, are such a text."""

    def of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bits, found = slots.value, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for _, part, row in stretch_hashes(texts, sizes):
            slot = part % np.uint64(SLOTS)
            held = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
            found.append((part[held], row[held]))
        return different(*map(np.concatenate, zip(*found, strict=True)))

    return of


def _slots(keys: DataFrame) -> np.ndarray:
    """A bit for each place that the hash of a key has: SLOTS bits, however many keys there are."""
    slot = F.col("part").bitwiseAND(SLOTS - 1) + 1
    held = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(SLOTS >> 3, np.uint8)
    for r in held.collect():
        some = np.frombuffer(r["bits"], np.uint8)
        out[(r["at"] - 1) * len(some) : r["at"] * len(some)] = some
    return out


def _contained(texts: DataFrame) -> DataFrame:
    """Links (x, y): the text of x stands in that of y.

    What stands in a text has its windows, and so their least parts: a text is looked up by the rarest of its own. One without a
    window is looked up by itself, in the stretches of others that a filter of such texts lets pass. Hashes propose, the texts
    themselves decide.
    """
    rows = texts.select("_g", "id", "norm", F.length("norm").alias("n"))
    small = F.col("n") < GRAM + WINDOW - 1
    own = lambda df, of: df.select("_g", "id", "n", "norm").mapInArrow(_parts(of), StructType([*df.select("_g", "id", "n").schema.fields, *StructType.fromDDL("part long").fields]))
    parts = scratch(own(rows.where(~small), _least_parts), "claim-parts")
    often = parts.groupBy("_g", "part").agg(F.count("*").alias("often"))
    keys = parts.join(often, ["_g", "part"]).groupBy("_g", "id").agg(F.min(F.struct("often", "part"))["part"].alias("part"))
    sizes = {r["n"] for r in rows.where(small).select("n").distinct().collect()}  # fewer than a window's characters
    if sizes:
        short = scratch(own(rows.where(small), _whole_parts), "claim-short")
        slots = texts.sparkSession.sparkContext.broadcast(_slots(short))
        keys = keys.unionByName(short.select("_g", "id", "part"))
        parts = parts.unionByName(scratch(own(rows, _held_parts(sizes, slots)), "claim-held"))
        slots.destroy()
    mine = keys.join(rows, ["_g", "id"]).select("_g", "part", F.col("id").alias("x"), F.col("norm").alias("inner"), F.col("n").alias("n_x"))
    met = parts.join(mine, ["_g", "part"]).where("n > n_x").select("x", F.col("id").alias("y"), "inner")
    whole = rows.select(F.col("id").alias("y"), F.col("norm").alias("outer"))
    return met.join(whole, "y").where(F.contains("outer", F.col("inner"))).select("x", "y")


def _sharing(texts: DataFrame) -> DataFrame:
    """Links (x, y) by common words: of two such texts, the rarest words of both have MET in common, or all that they need
    (prefix filter), and behind each of these both have as many words as they still need to share."""
    words = texts.select("_g", "id", F.array_distinct(F.split("norm", " ")).alias("words")).withColumn("n", F.size("words"))
    each = words.select("_g", "id", "n", F.explode("words").alias("word"))
    often = each.groupBy("_g", "word").agg(F.count("*").alias("often")).where("often > 1")
    order = F.array_sort(F.collect_list(F.struct("often", "word")))
    rows = each.join(often, ["_g", "word"]).groupBy("_g", "id", "n").agg(order.alias("s"))
    alone = F.col("n") - F.size("s")  # words that no other text has come first
    least = lambda n: F.least(F.ceil(n * SHARED - 1e-9), F.lit(MET))  # noqa: E731  so many of the words that two texts need stand in both their prefixes
    first = F.col("n") - F.ceil(F.col("n") * SHARED - 1e-9) + least(F.col("n")) - alone
    keys = rows.where(first > 0).select("_g", "id", "n", alone.alias("alone"), F.posexplode(F.transform(F.slice("s", F.lit(1), F.greatest(first, F.lit(1)).cast("int")), lambda x: x["word"])).alias("pos", "word"))
    side = lambda name: keys.select("_g", "word", F.col("id").alias(name), F.col("n").alias(f"n_{name}"), (F.col("n") - F.col("alone") - F.col("pos")).alias(f"rest_{name}"))
    fits = (F.col("x") < F.col("y")) & (F.least("n_x", "n_y") >= SHARED * F.greatest("n_x", "n_y") - 1e-9) & (F.least("rest_x", "rest_y") + MET - 1 >= SHARED / (1 + SHARED) * (F.col("n_x") + F.col("n_y")) - 1e-9)
    asked = side("x").join(side("y"), ["_g", "word"]).where(fits).groupBy("x", "y", least(F.least("n_x", "n_y")).alias("needed")).count().where("count >= needed").select("x", "y")
    sets = lambda name: words.select(F.col("id").alias(name), F.col("words").alias(f"w_{name}"))
    both = F.size(F.array_intersect("w_x", "w_y"))
    return asked.join(sets("y"), "y").join(sets("x"), "x").where(both >= SHARED * (F.size("w_x") + F.size("w_y") - both)).select("x", "y")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (x, y) of the texts of each unit that are alike: those of its first side with those of its second, or with each other.

    Sides are compared block by block, by length, and blocks whose lengths can't be alike aren't."""

    def settle(sides: tuple[list, list], same: bool) -> Iterator[pa.RecordBatch]:
        ordered = [sorted(side, key=lambda x: len(x[1])) for side in sides]
        blocks = [[side[k : k + BLOCK] for k in range(0, len(side), BLOCK)] for side in ordered]
        most = max(len(side[-1][1]) for side in ordered if side)
        bits = [[stretches(block, most) for block in side] for side in blocks] if most >= LONG else [[(None, None)] * len(side) for side in blocks]
        other = 0 if same else 1
        for j, left in enumerate(blocks[0]):
            for k, right in enumerate(blocks[other]):
                (a, b), (c, d) = ((len(x[0][1]), len(x[-1][1])) for x in (left, right))
                if not (same and k < j) and 2 * min(b, d) >= ALIKE * (min(b, d) + max(a, c)) - 1e-9:
                    yield compare(left, right, same and j == k, bits[0][j], bits[other][k])

    def stretches(block: list, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a block's texts, eight to a byte, and how many of their stretches fell on another's place."""
        bits, loose = gram_bits([t for _, t in block], 1 << int(4 * most - 1).bit_length())
        return np.packbits(bits > 0, axis=1), loose

    def compare(one: list, other: list, same: bool, mine_in: tuple, theirs_in: tuple) -> pa.RecordBatch:
        (ids, left), (others, right) = (([i for i, _ in s], [t for _, t in s]) for s in (one, other))
        found = []
        size, counts, number = np.array([len(t) for t in left + right]), letter_counts(left + right), np.array(others)
        mine, theirs, here, there, seeds = counts[: len(left)], counts[len(left) :], size[: len(left)], size[len(left) :], starters(counts, size)
        first, total = np.array(ids)[:, None] < number, here[:, None] + there
        could = 2 * np.minimum(here[:, None], there) >= ALIKE * total - 1e-9
        if same:
            could &= first
        long = size >= LONG
        if long.any():
            # Each stretch but one holds a character that may begin it, so there are few and long ones, whose parts both texts have.
            own, far = (np.unpackbits(packed, axis=1).astype(np.float32) for packed, _ in (mine_in, theirs_in))
            shared = own @ far.T + np.minimum(mine_in[1][:, None], theirs_in[1])
            long, begin = np.where(first, long[: len(left), None], long[len(left) :]), (counts * seeds).sum(axis=1)
            needed = np.ceil(ALIKE * total / 2 - 1e-9)
            could &= (shared >= needed - (GRAM_SHARED - 1) * (np.where(first, begin[: len(left), None], begin[len(left) :]) + 1)) | ~long
        for k in np.flatnonzero(could.any(axis=1)).tolist():
            some = np.flatnonzero(could[k])
            both = np.minimum(mine[k], theirs[some])
            near = 2 * both.sum(axis=1) >= ALIKE * total[k, some] - 1e-9
            if size.max() >= LONG:
                many = np.where(first[k, some], both @ seeds[k], (both * seeds[len(left) :][some]).sum(axis=1)) + 1
                near &= (shared[k, some] >= needed[k, some] - (GRAM_SHARED - 1) * many) | ~long[k, some]
            found += [(ids[k], others[j], left[k], right[j]) for j in some[near].tolist()]
        # The later claim is the first text of a comparison, as their order can matter to the ratio.
        later = [x[3] if x[0] < x[1] else x[2] for x in found]
        earlier = [x[2] if x[0] < x[1] else x[3] for x in found]
        alike = ratios(later, earlier, np.full(len(found), ALIKE))
        kept = [x for x, r in zip(found, alike.tolist(), strict=True) if r >= ALIKE]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64())], ["x", "y"])

    unit, sides = None, ([], [])
    for batch in batches:
        for u, same, side, i, t in zip(*(batch.column(c).to_pylist() for c in ("unit", "same", "side", "id", "norm")), strict=True):
            if unit != (u, same):
                if unit is not None:
                    yield from settle(sides, unit[1])
                unit, sides = (u, same), ([], [])
            sides[side].append((i, t))
    if unit is not None:
        yield from settle(sides, unit[1])


def _alike(texts: DataFrame) -> DataFrame:
    """Links (x, y) by the ratio. Only lengths of one band or two neighbouring ones can be alike; a band's texts are dealt to sides,
    and each unit of work compares two of them, so no task reads a large band and only links leave it. A text is written once for
    each of its units: twice the SIDES at most."""
    n = F.length("norm")
    rows = texts.select("_g", "id", "norm", F.floor(F.log(n) / float(np.log((2 - ALIKE) / ALIKE)) + 1e-12).alias("band"))
    sizes = rows.groupBy("_g", "band").agg(F.least(F.lit(SIDES), F.greatest(F.ceil(F.count("*") / UNIT_TEXTS), F.ceil(F.sum(F.length("norm")) / UNIT_CHARS))).cast("int").alias("blocks"))
    next_ = sizes.select("_g", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    last = sizes.select("_g", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    plan = scratch(sizes.join(next_, ["_g", "band"], "left").join(last, ["_g", "band"], "left"), "claim-bands")
    rows = rows.join(plan, ["_g", "band"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    unit = lambda band, x, y, same, side: F.struct(F.xxhash64("_g", band, x, y, F.lit(same)).alias("unit"), F.lit(same).alias("same"), F.lit(side).alias("side"))
    count = lambda c: F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(0)) - 1)
    own, band, none = F.col("own").cast("int"), F.col("band"), F.array().cast("array<struct<unit:bigint,same:boolean,side:int>>")
    some = lambda c, make: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.transform(count(c), make)).otherwise(none)
    inside = F.transform(count("blocks"), lambda k: F.when(k == own, unit(band, own, own, True, 0)).when(k > own, unit(band, own, k, False, 0)).otherwise(unit(band, k, own, False, 1)))
    across = F.concat(some("above", lambda k: unit(band, own + 1, -k - 2, False, 0)), some("below", lambda k: unit(band - 1, k + 1, -own - 2, False, 1)))
    units = rows.select("id", "norm", F.explode(F.concat(inside, across)).alias("u")).select("u.*", "id", "norm")
    # A number of tasks by the units of work: they are some MB each and long, so by size Spark would put many into one.
    many = plan.agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2 + F.col("blocks").cast("long") * F.coalesce("above", F.lit(0)))).first()[0] or 1
    return units.repartition(int(min(many, TASKS)), "unit").sortWithinPartitions("unit", "same", "side").mapInArrow(_compare, "x long, y long")


def similar_claims(texts: DataFrame) -> DataFrame:
    """Links (x, y), each once with x < y, between ids of similar texts: texts (_g, id, norm), a norm at most once in each group ``_g``.

    By containment, common words or the ratio; each kind has its own exact candidates, and no group is gathered.
    """
    found = _contained(texts).unionByName(_sharing(texts)).unionByName(_alike(texts))
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def first_independent(links: DataFrame) -> DataFrame:
    """Of the ids in ``links`` (x, y; x < y), those that greedy choice in the order of ids drops (``id``): linked to a smaller one that stays.

    All undecided ids without a smaller undecided one beside them stay at once, and those beside them go; so a round
    decides many, and rounds go with the longest rising path of links, not with the ids.
    """
    links, gone, turn = scratch(links, "claim-links"), None, 0
    while not links.isEmpty():
        waiting = links.select(F.col("y").alias("id")).distinct()
        stays = links.select(F.col("x").alias("id")).distinct().join(waiting, "id", "left_anti")
        out = scratch(links.join(stays.withColumnRenamed("id", "x"), "x", "left_semi").select(F.col("y").alias("id")).distinct(), f"claims-gone-{turn}")
        gone = out if gone is None else gone.unionByName(out)
        rest = links.join(stays.withColumnRenamed("id", "x"), "x", "left_anti")
        for end in ("x", "y"):
            rest = rest.join(out.withColumnRenamed("id", end), end, "left_anti")
        links, turn = scratch(rest.select("x", "y"), "claim-links"), turn + 1
    return gone if gone is not None else links.select(F.col("x").alias("id"))


def drop_near_duplicates(claims: DataFrame, group: str = "case_id", order: str = "seq", text: str = "text", party: str = "party") -> DataFrame:
    """The claims, in order, of which none kept before in the same group and party is similar.

    Claims of one normal form are decided by the first of them; those without a word are the same only if their texts are,
    in any case. Ties of the order go by the text. Null texts count as empty, null groups and parties are one of their own;
    repeated rows are copies of each other, further columns stay. An empty table gives an empty one.
    """
    names = claims.columns
    packed = claims.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.struct(F.col(group).alias("g"), F.col(party).alias("p")).alias("_g"), F.col(order).alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    norm = T.normalise_claim(F.col("_t"))
    # A text of its own stands behind a mark that no normal form has.
    rows = scratch(packed.withColumn("_k", F.when(norm != "", norm).otherwise(F.concat(F.lit("\n"), F.lower("_t")))).withColumn("_n", F.monotonically_increasing_id()), "claim-rows")
    firsts = rows.groupBy("_g", "_k").agg(F.min(F.struct("_o", "_t", "_n")).alias("first"))
    # Ids in the order of the claims: sorted by range, so no task numbers them all.
    ranked = scratch(firsts.repartitionByRange("first").sortWithinPartitions("first").withColumn("id", F.monotonically_increasing_id()), "claim-texts")
    texts = ranked.where(~F.startswith("_k", F.lit("\n"))).select("_g", "id", F.col("_k").alias("norm"))
    gone = first_independent(similar_claims(texts))
    kept = ranked.join(gone, "id", "left_anti").select(F.col("first._n").alias("_n"))
    return rows.join(kept, "_n", "left_semi").select("_row.*")


def extract(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims of the model's answers, then those of the conclusions, normalised and without near duplicates."""
    said = parse_answers(answers).withColumn("seq", F.col("seq").cast("long"))
    found = conclusions(docs).select(
        "case_id", (F.lit(10**9) + F.col("ord").cast("long") * 10**6 + F.col("block") * 10**3 + F.col("item")).alias("seq"), "party", "text", F.lit("0.9").alias("confidence"),
        F.array().cast("array<string>").alias("flags"), F.array().cast("array<string>").alias("open_questions"), F.lit(True).alias("heuristic"),
    )
    return drop_near_duplicates(normalise(said.unionByName(found)))


def burden_fallback(kind: Column, party: Column) -> Column:
    """Which standard burden-of-proof clause fits: code by kind, with the party it falls on."""
    side = F.when(party == "convenuto", F.lit("convenuto")).otherwise(F.lit("attore"))
    code = F.when(kind.isin("istruttoria", "difesa_eccezione", "riconvenzionale"), kind).otherwise(F.lit("domanda"))
    return F.concat_ws(":", code, side)


def burden(kind: Column, party: Column, claim: Column, generated: Column) -> Column:
    """The generated burden of proof, or the standard clause where it brings in foreign numbers or topics."""
    text, said = F.lower(F.coalesce(claim, F.lit(""))), F.lower(F.coalesce(generated, F.lit("")))
    has = lambda c, s: F.contains(c, F.lit(s))
    late = has(text, "penale") & has(text, "ritard")
    wrong = (has(said, "non imputabil") & ~has(said, "controparte")) | ~(has(said, "penale") & has(said, "ritard"))
    foreign = F.size(F.array_except(T.sensitive_numbers(generated), T.sensitive_numbers(claim))) > 0
    strange = F.lit(False)
    for stem in ("penale", "ritard", "fattur"):
        strange = strange | (has(said, stem) & ~has(text, stem))
    vague = (kind == "istruttoria") & ~(has(said, "ammiss") | has(said, "rilevan") | has(said, "pertinen") | has(said, "necess"))
    fallback = burden_fallback(kind, party)
    return F.when(said == "", fallback).when(late & wrong, F.lit("penale_ritardo")).when(foreign | strange | vague, fallback).otherwise(generated)


def undisputed(statements: DataFrame, docs: DataFrame) -> DataFrame:
    """statements (case_id, text) with ``supported``: worded as undisputed, and borne out by the case's documents.

    docs (case_id, section, text). Either a document says so in such words, or the statement is about a contract's
    existence and both parties' documents mention it.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    says = F.lit(False)
    for stem in C.UNDISPUTED:
        says = says | F.contains(low, F.lit(stem))
    contract = F.contains(low, F.lit("contratto")) | F.contains(low, F.lit("appalto"))
    about = F.contains(low, F.lit("esistenza")) | F.contains(low, F.lit("stipula")) | F.contains(low, F.lit("sottoscrizione"))
    per_case = docs.groupBy("case_id").agg(
        F.bool_or(says).alias("said"), F.bool_or(contract & (F.col("section") == "attore")).alias("one"), F.bool_or(contract & (F.col("section") == "convenuto")).alias("other")
    )
    rows = statements.withColumns({"_says": says, "_contract": contract & about}).join(per_case, "case_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumn("supported", F.col("_says") & (no("said") | (F.col("_contract") & no("one") & no("other")))).drop("_says", "_contract", "said", "one", "other")
