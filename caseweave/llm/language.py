"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from letter trigrams, counted on a bounded sample of labelled rows. What
a declared markup language and an address suffix say is learned by grouped aggregation over all rows: how often each
value goes with each language, by the text alone. The prior of a host is its own such counts, smoothed towards its
domain's, and these towards all rows'. The posterior is the product of the four.

A text may be in none of the languages. That class, ``und``, has a background of bytes: trigrams as likely as their bytes
are in the sample, mixed with all trigrams alike. What it beats is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, scratch, text_bytes

#: Languages told apart.
LANGUAGES = ("de", "en", "es", "fr")
#: Labelled rows of each language that the trigram model is fitted on, at most about.
SAMPLE_PER_LANGUAGE = 3000
TABLE_BITS = 16
#: Exponent of the text likelihood: neighbouring trigrams are far from independent.
TEMPER = 0.25
#: Weights of the domain in a host's prior and of all rows in a domain's; smoothing of declared values and suffixes.
HOST_WEIGHT, DOMAIN_WEIGHT, VALUE_WEIGHT = 5.0, 20.0, 1.0
#: Least posterior of an accepted row; prior of a text in none of the languages.
ACCEPT, OTHER = 0.5, 0.02

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around each byte of a letter, text after text, and where in them each text ends."""
    data = _FOLD[np.frombuffer(b"\0\0".join(texts) + b"\0\0\0", np.uint8)]
    wide = data.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    at = np.flatnonzero(data[1:-1] != 32)
    code = (code[at] * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    return code, np.searchsorted(at, ends - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, letters = np.zeros((len(LANGUAGES), 1 << TABLE_BITS), np.int64), np.zeros(256, np.int64)
    for small in (s for batch in batches for s in bounded(batch, "text")):
        texts = text_bytes(small.column("text"))
        letters += np.bincount(_FOLD[np.frombuffer(b" ".join(texts), np.uint8)], minlength=256)
        codes, ends = trigrams(texts)
        for k, name in enumerate(small.column("lang").to_pylist()):
            own = codes[ends[k - 1] if k else 0 : ends[k]]
            np.add.at(counts[LANGUAGES.index(name)], own, 1)
    lang, code = np.nonzero(counts)
    byte = np.flatnonzero(letters)
    lang, code, n = np.append(lang, np.full(len(byte), len(LANGUAGES))), np.append(code, byte), np.append(counts[lang, code], letters[byte])
    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(code, pa.int32()), pa.array(n)], ["lang", "code", "n"])


def _background(letters: np.ndarray) -> np.ndarray:
    """Log probability of each hashed trigram if its bytes were drawn one by one, mixed half and half with all alike."""
    some = np.flatnonzero(letters)
    p = letters[some] / max(1, letters.sum())
    table = np.zeros(1 << TABLE_BITS)
    for a, share in zip(some.tolist(), p.tolist(), strict=True):
        code = (np.uint32(a << 16) | (some[:, None].astype(np.uint32) << 8) | some[None, :].astype(np.uint32)) * np.uint32(2654435761) >> np.uint32(32 - TABLE_BITS)
        np.add.at(table, code.reshape(-1), (share * p[:, None] * p[None, :]).reshape(-1))
    return np.log(0.5 * table + 0.5 / (1 << TABLE_BITS))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> np.ndarray:
    """Log probability of each trigram in each language, from about ``per_language`` rows of each, drawn by hash, and last the background.

    Rows with a null text or label, or another label, are left out; repeated rows count as often as they are drawn. A
    language without rows, as all of an empty table, has all trigrams alike.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang")).where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    there = dict(rows.groupBy("lang").count().collect())
    share = F.lit(0.0)
    for name, n in there.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30))
    counts, letters = np.full((len(LANGUAGES), 1 << TABLE_BITS), 0.5), np.zeros(256)
    for lang, code, n in drawn.mapInArrow(_count, "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n")).collect():
        if lang < len(LANGUAGES):
            counts[lang, code] += n
        else:
            letters[code] += n
    known = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.concatenate([known, _background(letters)[None]]).astype(np.float32)


def text_log_likelihoods(texts: list[bytes], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tempered log likelihoods by text and language, the best being 0, that of the background, and the number of trigrams."""
    codes, ends = trigrams(texts)
    n = np.diff(np.concatenate([[0], ends]))
    out = np.zeros((len(texts), len(model)))
    some = np.flatnonzero(n)
    if len(some):
        for k, row in enumerate(model):
            out[some, k] = np.add.reduceat(row[codes], (ends - n)[some], dtype=np.float64)
    out *= TEMPER
    best = out[:, :-1].max(axis=1)
    return out[:, :-1] - best[:, None], out[:, -1] - best, n


def _score(shared, clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markup = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
        for small in (s for batch in batches for s in bounded(batch, "_text")):
            texts = text_bytes(small.column("_text"))
            if clean:
                texts = [markup.sub(b" ", t) if m else t for t, m in zip(texts, small.column("_markup").to_pylist(), strict=True)]
            log, other, n = text_log_likelihoods(texts, shared.value)
            rest = [name for name in small.schema.names if name not in ("_text", "_markup")]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, log.size + 1, log.shape[1]), pa.int32()), pa.array(log.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[small.column(c) for c in rest], lists, pa.array(other), pa.array(n, pa.int64())], [*rest, "_log", "_other", "_letters"])

    return run


def score(df: DataFrame, model: np.ndarray) -> DataFrame:
    """``df`` without its column ``_text`` but with text evidence: ``_log`` by language, ``_other`` of the
    background, and ``_letters`` (trigrams).

    ``_text`` may be null or empty, which is no evidence; every row gives one row. Where a boolean ``_markup`` is there and true, tags, comments, scripts and styles go first.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema if f.name not in ("_text", "_markup")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_log array<double>", "_other double", "_letters long"])
    return df.mapInArrow(_score(shared, "_markup" in df.columns), schema)


def _softmax(log: Column) -> Column:
    top = F.array_max(log)
    raised = F.transform(log, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def _sums(p: str = "_p") -> Column:
    return F.array(*[F.sum(F.get(p, F.lit(k))) for k in range(len(LANGUAGES))])


def _per(left: Column, right: Column, f) -> Column:
    return F.zip_with(left, right, f)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)


def evidence(scores: DataFrame) -> dict[str, DataFrame]:
    """Log weight of each language by declared value, by address suffix and by host, from all scored rows.

    Rows without a letter count nowhere. Each table has one row a value.
    """
    rows = scores.where("_letters > 0").withColumn("_p", _softmax(F.col("_log")))
    hosts = rows.groupBy("_domain", "_host").agg(_sums().alias("h"))
    domains = hosts.groupBy("_domain").agg(_sums("h").alias("d"))
    everything = F.array(*[F.lit(x or 0.0) for x in rows.agg(_sums().alias("g")).first()[0]])  # a number a language
    smooth = lambda own, up, weight: _per(own, up, lambda x, p: (x + weight * p) / (_total(own) + weight))
    shares = lambda g: F.transform(g, lambda x: (x + 1.0) / (_total(g) + float(len(LANGUAGES))))
    prior = (
        hosts.join(domains, "_domain")
        .withColumn("up", smooth(F.col("d"), shares(everything), DOMAIN_WEIGHT))
        .select("_domain", "_host", F.transform(smooth(F.col("h"), F.col("up"), HOST_WEIGHT), lambda x: F.log(x)).alias("_by_host"))
    )

    def value(name: str) -> DataFrame:
        per = rows.groupBy(name).agg(_sums().alias("c"))
        return per.select(name, _per(F.col("c"), everything, lambda c, g: F.log((c + VALUE_WEIGHT) / (g + VALUE_WEIGHT * len(LANGUAGES)))).alias(f"_by{name}"))

    # Written out, a small table has a known size, and the join with the texts needs no shuffle of them.
    return {"host": scratch(prior, "language-hosts"), "declared": scratch(value("_declared"), "language-declared"), "suffix": scratch(value("_suffix"), "language-suffixes")}


def fuse(scores: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """``scores`` with ``language``, ``probability`` and ``accepted`` in place of the working columns.

    A value that ``known`` lacks says nothing. A row without a letter is ``und`` and rejected, as is one for which the
    background wins (its probability is then that of being in none of the languages); a row whose best posterior is
    under ACCEPT is rejected too. Ties go to the language that comes first. An empty table gives an empty result.
    """
    out = scores.join(known["host"], ["_domain", "_host"], "left").join(known["declared"], "_declared", "left").join(known["suffix"], "_suffix", "left")
    log = F.col("_log")
    for name in ("_by_host", "_by_declared", "_by_suffix"):
        log = F.when(F.col(name).isNull(), log).otherwise(_per(log, F.col(name), lambda a, b: a + b))
    values = F.coalesce(F.array_max("_by_declared"), F.lit(0.0)) + F.coalesce(F.array_max("_by_suffix"), F.lit(0.0))
    out = out.withColumn("_post", F.concat(log, F.array(F.col("_other") + math.log(OTHER) + values)))
    out = out.withColumn("_post", _softmax(F.col("_post")))
    best = F.array_max("_post")
    name = F.get(F.array(*[F.lit(x) for x in (*LANGUAGES, "und")]), (F.array_position("_post", best) - 1).cast("int"))
    name = F.when(F.col("_letters") > 0, name).otherwise(F.lit("und"))
    known = name != "und"
    out = out.withColumns({"language": name, "probability": F.when(F.col("_letters") > 0, best).otherwise(F.lit(0.0)), "accepted": known & (best >= ACCEPT)})
    return out.drop("_log", "_other", "_letters", "_post", "_host", "_domain", "_declared", "_suffix", "_by_host", "_by_declared", "_by_suffix")


def web_evidence(url: Column, html: Column) -> dict[str, Column]:
    """Working columns of a web page: host, domain (its last two labels), suffix and declared markup language."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return {
        "_host": host, "_domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "_suffix": F.regexp_extract(host, r"\.([^.]+)$", 1),
        "_declared": F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)), "_markup": F.lit(True), "_text": html,
    }


def plain_evidence(source: Column, declared: Column, text: Column) -> dict[str, Column]:
    """Working columns of a plain document: its source stands for the host, its declared language for the markup's."""
    blank = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return {"_host": blank(source), "_domain": F.lit(""), "_suffix": F.lit(""), "_declared": blank(declared), "_markup": F.lit(False), "_text": text}
