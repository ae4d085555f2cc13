"""Personal data by weak-supervision aggregation, with DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Beyond them, wider patterns propose
candidate spans, and labelers vote on each: its shape by pattern, its checksum and numbering plan, cue words before it
from a gazetteer, and the context it stands in. Expectation-maximisation over the table of vote patterns (one row a pattern, not a span)
estimates how reliable each labeler is without any labels, and gives every pattern a probability. These are the soft
labels of the final span classifier, a naive Bayes model over features of the span itself, counted by grouped
aggregation over all candidates. Spans it accepts are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.text import match_spans

from .common import scratch

KINDS = ("email", "ip", "card", "phone")
# Matches start at the end of the last one or where a run of the first class begins; quantifiers are possessive where
# what follows lies outside the class. So each pattern scans a text once and finds the same spans.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can hold no span of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Kinds of candidates beyond the base, by their pattern.
CANDIDATES = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Sr|Sra)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
}
# The gazetteer of cue words by kind, in four languages, looked for in the CONTEXT code points before a candidate.
GAZETTEER = {
    "iban": ("iban", "account", "bank", "transfer", "konto", "kontonummer", "bankverbindung", "compte", "banque", "virement", "cuenta", "banco"),
    "ssn": ("ssn", "social", "security", "id", "passport", "ausweis", "sozialversicherung", "steuer", "passeport", "carte", "seguridad", "pasaporte"),
    "local_phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "anruf", "handy", "telephone", "appelez", "llame"),
    "name": ("dear", "name", "contact", "from", "signed", "patient", "lieber", "liebe", "gezeichnet", "cher", "nom", "nombre"),
}
CONTEXT = 40
LABELERS, FEATURES = ("l1", "l2", "l3", "l4"), ("f1", "f2", "f3", "f4")
#: Code points of a stretch, as a power of two.
STRETCH = 6
#: Words that make a number an order, a version or a sum rather than a person's.
COUNTER_CUES = ("order", "version", "invoice", "total", "isbn", "serial", "page", "item")
#: Rounds of expectation-maximisation; prior share of true candidates; least probability of an added span.
ROUNDS, PRIOR, ACCEPT = 25, 0.5, 0.5


_SPAN = "array<struct<start:int,end:int,value:string,before:string>>"


def guarded_spans(text: Column, pattern: str, need: str | None = None) -> Column:
    """match_spans() with CONTEXT code points before each, computed only for texts that hold a match."""
    hit = F.rlike(text, F.lit(pattern))
    if need is not None:
        hit = F.contains(text, F.lit(need)) & hit
    return F.when(hit, match_spans(text, pattern, CONTEXT)).otherwise(F.array().cast(_SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The base's test of a match."""
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
    n = F.length(digits(value))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: valid(kind, s["value"])


def base_spans(df: DataFrame, text: str = "_text") -> DataFrame:
    """``df`` with one array of checked spans a kind."""
    df = df.withColumns({f"_raw_{k}": guarded_spans(F.col(text), PATTERNS[k], NEEDS[k]) for k in KINDS})
    return df.withColumns({f"_{k}": F.filter(f"_raw_{k}", _check(k)) for k in KINDS}).drop(*[f"_raw_{k}" for k in KINDS])


def proposed(text: Column) -> Column:
    """Candidates of every kind beyond the base, as array<struct<kind, start, end, value, before>>."""
    of = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "value", "before")])
    return F.concat(*[F.transform(guarded_spans(text, p), of(k)) for k, p in CANDIDATES.items()])


def candidates(found: DataFrame) -> DataFrame:
    """One row a candidate that overlaps no base span: ``_row``, kind, start, end, value, before.

    ``found`` has the base arrays and ``_c`` of proposed(). Candidates and base spans meet by document and stretch of
    STRETCH code points, so a text full of both is no quadratic case, and no group is gathered.
    """
    stretches = lambda s: F.explode(F.sequence(F.shiftright(s["start"], STRETCH), F.shiftright(s["end"] - 1, STRETCH))).alias("at")
    rows = found.where(F.size("_c") > 0).dropDuplicates(["_row"])  # repeated rows count once
    free = rows.select("_row", F.explode("_c").alias("c"))
    base = rows.select("_row", F.explode(F.concat(*[F.transform(f"_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])).alias("b"))
    met = free.select("_row", "c", stretches(F.col("c"))).join(base.select("_row", "b", stretches(F.col("b"))), ["_row", "at"]).where((F.col("b.start") < F.col("c.end")) & (F.col("c.start") < F.col("b.end")))
    taken = met.select("_row", F.struct("c.kind", "c.start", "c.end").alias("k")).distinct()
    return free.withColumn("k", F.struct("c.kind", "c.start", "c.end")).join(taken, ["_row", "k"], "left_anti").select("_row", "c.*")


def checksum(kind: Column, value: Column) -> Column:
    """A labeler by arithmetic and numbering plans: IBAN modulo 97, ranges of the other numbers; 0 for names."""
    plain = F.upper(F.regexp_replace(value, " ", ""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(F.rlike(c, F.lit("^[A-Z]$")), (s * 100 + F.ascii(c) - 55) % 97).when(c == "", s).otherwise((s * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97))
    number = digits(value)
    return (
        F.when(kind == "iban", F.when(rest == 1, 1).otherwise(-1))
        .when(kind == "ssn", F.when(F.substring(number, 1, 3).between("001", "899") & (F.substring(number, 1, 3) != "666"), 1).otherwise(-1))
        .when(kind == "local_phone", F.when(F.rlike(number, F.lit("^[2-9][0-8][0-9][2-9]")), 1).otherwise(0))
        .otherwise(0)
    )


def votes(rows: DataFrame) -> DataFrame:
    """Four labelers: 1 for personal data, -1 against, 0 for none. Features of the final classifier come along."""
    v, before = F.col("value"), F.col("before")
    number = digits(v)
    distinct = F.size(F.array_distinct(F.split(number, "")))
    shape = (
        F.when(F.col("kind") == "iban", F.when(F.length(F.regexp_replace(v, " ", "")).between(15, 34), 1).otherwise(-1))
        .when(F.col("kind") == "ssn", F.when(F.rlike(v, F.lit("^(?:000|666|9[0-9]{2})|-00-|-0000$")), -1).otherwise(1))
        .when(F.col("kind") == "local_phone", F.when(F.rlike(v, F.lit("^\\(?[01]")), -1).otherwise(1))
        .otherwise(F.when(F.length(v) >= 7, 1).otherwise(0))
    )
    gazetteer = F.lit(0)
    for kind, cues in GAZETTEER.items():
        gazetteer = F.when((F.col("kind") == kind) & F.rlike(before, F.lit(rf"(?:^|[^a-z])(?:{'|'.join(cues)})[^a-z]*(?:[a-z]+[^a-z]+){{0,2}}$")), 1).otherwise(gazetteer)
    context = F.when(F.rlike(before, F.lit(rf"(?:^|[^a-z])(?:{'|'.join(COUNTER_CUES)})")), -1).when(F.rlike(before, F.lit("[:=#]\\s*$")), 1).otherwise(0)
    variety = F.when(F.length(number) == 0, F.lit("none")).when(distinct <= 2, F.lit("few")).otherwise(F.lit("many"))
    length = F.least(F.lit(8), F.floor(F.length(v) / 4)).cast("string")
    return rows.withColumns({"l1": shape, "l2": gazetteer, "l3": context, "l4": checksum(F.col("kind"), v), "f1": F.col("kind"), "f2": length, "f3": variety, "f4": F.rlike(before, F.lit("[a-z]\\s*$")).cast("string")})


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern, by expectation-maximisation over pattern counts (two classes)."""
    if not patterns:
        return {}
    labelers = range(len(patterns[0][0]))
    # Starts from a majority vote; a labeler is described by its rate of each vote in each class.
    p = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in patterns}
    for _ in range(ROUNDS):
        total = sum(n for _, n in patterns)
        yes = sum(p[v] * n for v, n in patterns)
        share = (yes + PRIOR) / (total + 1.0)
        rate = {}
        for k in labelers:
            for vote in (-1, 0, 1):
                own = [(p[v], n) for v, n in patterns if v[k] == vote]
                rate[k, vote] = ((sum(q * n for q, n in own) + (1.0 if vote > 0 else 0.5)) / (yes + 2.0), (sum((1 - q) * n for q, n in own) + (1.0 if vote < 0 else 0.5)) / (total - yes + 2.0))
        for v, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(rate[k, v[k]][0] / rate[k, v[k]][1]) for k in labelers)
            p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return p


def classify(rows: DataFrame) -> DataFrame:
    """Candidates that the final classifier accepts."""
    counted = rows.groupBy(*LABELERS).count().collect()  # 81 rows at most
    soft = reliabilities(sorted((tuple(r[m] for m in LABELERS), r["count"]) for r in counted))
    pattern = F.concat_ws(",", *[F.col(m).cast("string") for m in LABELERS])
    p = F.lit(PRIOR)
    if soft:
        p = F.create_map(*[F.lit(x) for v, q in soft.items() for x in (",".join(map(str, v)), q)])[pattern]
    rows = rows.withColumn("p", p)
    total = rows.agg(F.coalesce(F.sum("p"), F.lit(0.0)), F.count("*")).first()
    yes, no = total[0] + 1.0, total[1] - total[0] + 1.0
    logit = F.log(F.col("p") / (1 - F.col("p")))
    for f in FEATURES:
        # A few values each: kind, length class, variety, context.
        for value, a, b in rows.groupBy(f).agg(F.sum("p"), F.sum(1 - F.col("p"))).collect():
            weight = math.log((a + 1.0) / (yes + 1.0)) - math.log((b + 1.0) / (no + 1.0))
            logit = logit + F.when(F.col(f) == value, F.lit(0.5 * weight)).otherwise(F.lit(0.0))
    return rows.where(1 / (1 + F.exp(-logit)) >= ACCEPT)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, base arrays ``_email`` ... ``_phone`` and ``_added`` (array of kind, start, end) for every row of ``df``.

    Null text counts as empty; rows with equal ids are kept apart by their texts, and equal rows get equal spans. Null
    ids are allowed. An empty table gives an empty result. Added spans overlap no base span. Texts are read once.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col, F.octet_length(F.col(text_col))).alias("h"))
    rows = df.select(F.col(id_col).alias("id"), key.alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = base_spans(rows.withColumn("_c", proposed(F.col("_text")))).drop("_text")
    found = scratch(found.withColumns({f"_{k}": F.transform(f"_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))) for k in KINDS}), "pii-found")
    voted = scratch(votes(candidates(found)).drop("value", "before"), "pii-candidates")
    added = classify(voted).groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("_added"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.drop("_c").join(added, "_row", "left").withColumn("_added", F.coalesce("_added", none)).drop("_row")


def listed(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
