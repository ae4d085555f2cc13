"""Text functions as Column expressions. Null counts as empty text throughout."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: inside lambdas, an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any_in(c: Column, stems: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for stem in stems:
        found = found | F.contains(c, F.lit(stem))
    return found


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_text(c), F.lit("(?U)" + pattern), F.lit(group))


_SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
#: Matches whose places are added up together.
BLOCK = 64


def match_spans(c: Column, pattern: str, context: int = 0) -> Column:
    """All leftmost, non-overlapping matches as array<struct<start, end, value, before>>, in code points, end exclusive.

    Matches and the pieces between them take turns, so a match begins where the lengths before it add up to. They are
    added up in blocks, and the blocks' places before them, so long texts of matches stay cheap. ``before`` is the end of
    what stands between the match and the one before it, that one included, in lower case.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    last = F.concat(F.array(F.lit("")), found)
    around = lambda p: F.lower(F.substring(F.concat(p["last"], p["gap"]), -context, context)) if context else F.lit("")
    pairs = F.zip_with(F.arrays_zip(F.split(c, pattern, -1).alias("gap"), last.alias("last")), found, lambda p, hit: F.struct(F.length(p["gap"]).alias("gap"), hit.alias("hit"), around(p).alias("before")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    width = lambda p: p["gap"] + F.length(p["hit"])

    def add(state: Column, p: Column) -> Column:
        start, end = state["at"] + p["gap"], state["at"] + width(p)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("value"), p["before"].alias("before")))
        return F.struct(end.alias("at"), F.concat(state["out"], one).alias("out"))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + width(p)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, none, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda s: s["out"])))

    def blocks(p: Column) -> Column:
        n = F.ceil(F.size(p) / BLOCK).cast("int")
        return F.when(n == 0, F.array().cast(_SPAN)).otherwise(_let(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(p, (k - 1) * BLOCK + 1, F.lit(BLOCK))), placed))

    return _let(pairs, blocks)


def normalise_claim(c: Column) -> Column:
    """Placeholders out, lower case, anything but letters and digits to single spaces."""
    bare = F.lower(F.regexp_replace(_text(c), C.PLACEHOLDER, " "))
    return trimmed(F.regexp_replace(bare, r"(?U)[^\wÀ-ÖØ-öø-ÿ]+", " "))


def relevance_tokens(c: Column) -> Column:
    """Distinct lower-case words of four letters or more that are neither numbers nor stop words."""
    stop = F.array(*[F.lit(w) for w in C.RELEVANCE_STOP])
    words = all_matches(F.lower(_text(c)), C.WORD)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~F.rlike(w, F.lit(r"(?U)^\d+$")) & ~F.array_contains(stop, w)))


def sensitive_numbers(c: Column) -> Column:
    """Distinct grouped amounts, n/yyyy and dates, without euro sign and spaces."""
    return F.array_distinct(F.transform(all_matches(c, C.NUMBER), lambda n: F.regexp_replace(n, r"(?U)[€\s]", "")))


def foreign_numbers(generated: Column, source: Column) -> Column:
    """Up to five numbers of the generated text that the source lacks; none where the source has no number."""
    own = sensitive_numbers(source)
    none = F.array().cast("array<string>")
    return F.when(F.size(own) > 0, F.slice(F.array_sort(F.array_except(sensitive_numbers(generated), own)), 1, 5)).otherwise(none)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def chunks(c: Column, size: int = C.CHUNK_CHARS) -> Column:
    """Blank-line paragraphs, trimmed, in slices of ``size``; a text without any is one empty chunk."""
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(p, i + 1, F.lit(size)))
    parts = F.filter(F.transform(F.split(_text(c), "\n\n"), trimmed), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.flatten(F.transform(parts, cut))).otherwise(F.array(F.lit("")))


def segments(c: Column) -> Column:
    """Paragraphs and sentences; longer ones as windows of WINDOW_WORDS words every WINDOW_STEP."""
    tidy = trimmed(F.regexp_replace(F.regexp_replace(_text(c), "[ \t]+", " "), "\n{3,}", "\n\n"))
    parts = F.filter(F.transform(F.split(tidy, "(?U)" + C.SENTENCE_END), trimmed), lambda p: p != "")

    def windows(p: Column) -> Column:
        def cut(words: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(C.WINDOW_STEP))
            return F.when(F.size(words) <= C.WINDOW_WORDS, F.array(p)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, C.WINDOW_WORDS), " ")))

        return _let(F.split(p, r"(?U)\s+"), cut)

    return F.flatten(F.transform(parts, windows))


def word_windows(c: Column, size: int = C.WINDOW_WORDS, step: int = C.WINDOW_STEP) -> Column:
    """Windows of words over a whole text, as array<struct<start, n_words>>."""

    def cut(n: Column) -> Column:
        starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)))
        return F.when(n > 0, F.transform(starts, lambda i: F.struct(i.alias("start"), F.least(F.lit(size), n - i).alias("n_words"))))

    return _let(F.size(F.filter(F.split(_text(c), r"\s+"), lambda w: w != "")), cut)


def snippet(c: Column, terms: Column, numbers: Column, limit: int = C.SNIPPET_CHARS) -> Column:
    """At most ``limit`` characters with the earliest hit a third in, and dots where text is cut off."""

    def cut(t: Column) -> Column:
        flat, low = t["flat"], t["low"]
        places = F.concat(F.transform(terms, lambda w: F.instr(low, w) - 1), F.transform(numbers, lambda n: F.instr(flat, n) - 1))
        hit = F.coalesce(F.array_min(F.filter(places, lambda p: p >= 0)), F.lit(0))
        end = F.least(F.length(flat), F.greatest(F.lit(0), hit - limit // 3) + limit)
        start = F.greatest(F.lit(0), end - limit)
        body = trimmed(F.substring(flat, start + 1, end - start))
        dots = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(end < F.length(flat), F.lit("...")).otherwise(F.lit("")))
        return F.when(F.length(flat) <= limit, flat).otherwise(dots)

    flat = trimmed(F.regexp_replace(_text(c), r"(?U)\s+", " "))
    return _let(F.struct(flat.alias("flat"), F.lower(flat).alias("low")), cut)


def reliability(score: Column) -> Column:
    return F.when(score >= C.STRONG, F.lit("alta")).when(score >= C.USEFUL, F.lit("media")).otherwise(F.lit("bassa"))


def relevance_band(distance: Column) -> Column:
    return F.when(distance <= C.NEAR, F.lit("alta")).when(distance <= C.USABLE, F.lit("media")).otherwise(F.lit("bassa"))


def claim_kind(c: Column, party: Column) -> Column:
    low = F.lower(_text(c))
    return (
        F.when(_any_in(low, C.CLAIM_COUNTER), F.lit("riconvenzionale"))
        .when(_any_in(low, C.CLAIM_DEFENCE), F.lit("difesa_eccezione"))
        .when((party == "convenuto") & _any_in(low, C.CLAIM_BY_DEFENDANT), F.lit("riconvenzionale"))
        .when(_any_in(low, C.CLAIM_DEMAND), F.lit("domanda"))
        .when(_any_in(low, C.CLAIM_EVIDENCE), F.lit("istruttoria"))
        .otherwise(F.lit("domanda"))
    )


def confidence(raw: Column) -> Column:
    """A number forced into [0, 1]; DEFAULT_CONFIDENCE where it is none."""
    number = raw.try_cast("double")
    return F.when(number.isNull(), F.lit(C.DEFAULT_CONFIDENCE)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def url_host(url: Column) -> Column:
    """Host of an address without www., or the address itself where it has none."""
    host = F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.when(host == "", _text(url)).otherwise(host)), r"^www\.", "")


def _trust(url: Column, none: str, official: str, journal: str, doubtful: str, other: str) -> Column:
    host = url_host(url)
    ends = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.endswith(host, n))
    return (
        F.when(_text(url) == "", F.lit(none))
        .when(ends(C.INSTITUTIONAL_HOSTS), F.lit(official))
        .when(ends(C.EDITORIAL_HOSTS), F.lit(journal))
        .when(_any_in(host, ("studio", "blog")), F.lit(doubtful))
        .otherwise(F.lit(other))
    )


def url_trust(url: Column) -> Column:
    """Trust class of an address, by plain suffix of its host."""
    return _trust(url, "non_indicata", "alta", "media", "bassa", "media")


def source_kind(c: Column, manual: Column) -> Column:
    low, kind = F.lower(_text(c)), F.when(manual, F.lit("materiale manuale")).otherwise(F.lit("fonte web"))
    for name, stems in reversed(C.SOURCE_KINDS):
        kind = F.when(_any_in(low, stems), F.lit(name)).otherwise(kind)
    return kind


def lead_reliability(url: Column, insufficient: Column, manual: Column) -> Column:
    return F.when(insufficient, F.lit("insufficiente")).when(manual & (_text(url) == ""), F.lit("media")).otherwise(url_trust(url))


def lead_label(url: Column, insufficient: Column, manual: Column) -> Column:
    """What a lead's source is called."""
    names = [C.LEAD_LABELS[k] for k in ("non_indicata", "istituzionale", "editoriale", "bassa", "media")]
    return F.when(insufficient, F.lit(C.LEAD_LABELS["insufficiente"])).when(manual & (_text(url) == ""), F.lit(C.LEAD_LABELS["manuale"])).otherwise(_trust(url, *names))


def lead_reason(reliability: Column) -> Column:
    """Why a lead is as reliable as lead_reliability() says."""
    named = F.create_map(*[F.lit(x) for k in ("insufficiente", "alta", "media", "bassa") for x in (k, C.LEAD_REASONS[k])])
    return F.coalesce(F.try_element_at(named, reliability), F.lit(C.LEAD_REASONS[""]))


def case_tag(c: Column) -> Column:
    """First tag whose stem the text holds, or none."""
    low, tag = F.lower(_text(c)), F.lit("")
    for stem, name in reversed(C.CASE_TAGS):
        tag = F.when(F.contains(low, F.lit(stem)), F.lit(name)).otherwise(tag)
    return tag


def _ascii_forms() -> tuple[str, str, dict[str, str]]:
    """Characters with an ASCII part in their compatibility decomposition: those of one letter, their letters, and the others."""
    forms = {chr(k): "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if x < "\x80") for k in range(0x80, 0x20000) if not 0xD800 <= k < 0xE000}
    single = {c: f for c, f in forms.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in forms.items() if len(f) > 1}


_FROM, _TO, _LIGATURES = _ascii_forms()


def ascii_letters(c: Column) -> Column:
    """Decomposed, and what isn't ASCII left out. Texts in ASCII pass by; ligatures and the like go letter by letter."""
    wide = F.map_from_arrays(F.array(*[F.lit(x) for x in _LIGATURES]), F.array(*[F.lit(x) for x in _LIGATURES.values()]))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(wide, x), x)), "")
    whole = F.when(F.rlike(c, F.lit("[" + "".join(_LIGATURES) + "]")), spelled).otherwise(c)
    return F.when(F.rlike(c, F.lit(r"^[\x00-\x7F]*$")), c).otherwise(F.regexp_replace(F.translate(whole, _FROM, _TO), r"[^\x00-\x7F]", ""))


def graph_key(c: Column) -> Column:
    """Letters and digits without accents, lower case, other characters to single spaces, at most 255 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(ascii_letters(_text(c))), "[^a-z0-9]+", " ")), 1, 255)


def reference_present(label: Column, text: Column) -> Column:
    """A legal reference counts as present if its first two telling key parts stand in the text; other labels always do."""
    parts = F.filter(F.split(graph_key(label), " "), lambda p: ~p.isin("", "art", "cc", "cpc", "cost"))
    body = graph_key(text)
    there = (F.size(parts) > 0) & F.forall(F.slice(parts, 1, 2), lambda p: F.contains(body, p))
    return F.when(F.rlike(label, F.lit("(?i)" + C.LEGAL_REFERENCE)), there).otherwise(F.lit(True))


def tidy_placeholders(c: Column) -> Column:
    """Single spaces around placeholders, repeats of one merged, none before punctuation."""
    for pattern, to in C.SPACING:
        c = F.regexp_replace(c, "(?U)" + pattern, to)
    return c


def placeholder_group(c: Column) -> Column:
    return F.regexp_extract(_text(c), r"^\[([A-Z_]+)_\d+\]$", 1)


def placeholder_valid(token: Column, known: Column) -> Column:
    """An allowed marker, or a well-formed placeholder that is mapped or of a known group."""
    return F.rlike(token, F.lit(f"^(?:{C.KNOWN_FORM})$")) | (F.rlike(token, F.lit(f"^{C.PLACEHOLDER}$")) & F.array_contains(known, token))


def restore(c: Column, entities: Column) -> Column:
    """Placeholders back to their values, longest placeholder first. ``entities``: array<struct<ph, value>>."""
    order = F.array_sort(entities, lambda a, b: F.when(F.length(a["ph"]) != F.length(b["ph"]), F.length(b["ph"]) - F.length(a["ph"])).when(a["ph"] < b["ph"], -1).when(a["ph"] > b["ph"], 1).otherwise(0))
    return tidy_placeholders(F.aggregate(order, _text(c), lambda s, e: F.replace(s, e["ph"], e["value"])))


def json_object(c: Column) -> Column:
    """The JSON object in a model's answer: reasoning tags out, then the text from the first brace to the last."""
    bare = F.regexp_replace(_text(c), r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def salvage_field(c: Column, name: str) -> Column:
    """A text field of a JSON answer, even of one that breaks off inside it."""
    whole = F.get_json_object(json_object(c), f"$.{name}")
    part = F.regexp_extract(_text(c), rf'(?s)"{name}"\s*:\s*"((?:[^"\\]|\\.)*+)', 1)
    plain = F.replace(F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.coalesce(whole, plain)


def clean_value(c: Column) -> Column:
    """The last line of an entity value that isn't blank, in single spaces."""
    lines = F.filter(F.transform(F.split(_text(c), "\n"), lambda x: F.regexp_replace(x, r"^[ \t:-]+|[ \t:-]+$", "")), lambda x: trimmed(x) != "")
    return trimmed(F.regexp_replace(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")), r"(?U)\s+", " "))


def opening_text(c: Column, limit: int = 320) -> Column:
    tidy = trimmed(_text(c))
    return F.when(F.length(tidy) <= limit, tidy).otherwise(F.concat(trimmed(F.substring(tidy, 1, limit - 3)), F.lit("...")))


def opening_question(questions: Column, burden: Column) -> Column:
    """The first open question that isn't blank; without one, a standard question where the burden of proof is blank too."""
    said = F.filter(F.transform(F.coalesce(questions, F.array().cast("array<string>")), lambda q: trimmed(_text(q))), lambda q: q != "")
    return F.when(F.size(said) > 0, F.get(said, F.lit(0))).when(trimmed(_text(burden)) == "", F.lit(C.FIRST_QUESTION)).otherwise(F.lit(""))


def percent(done: Column, total: Column) -> Column:
    """Progress in whole percent, 0 to 100, halves to even."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / F.greatest(total, F.lit(1))))
    return F.bround(share * 100, 0).cast("int")
