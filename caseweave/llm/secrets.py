"""Secret scanning with a random forest that removes false positives.

Patterns propose candidates. Each is described by its length, its character transitions, how much of it dictionary
words cover, its path, and the words beside it; a random forest (Spark ML), fitted on labelled findings, scores it.
The dictionary and the letter transitions come from the words of all texts, by grouped counts. Where no labels are
given, rules that look at a finding's form alone label those of the texts themselves that are plain, LABELLED of each kind
at most, and drawn findings stand for kinds that the texts may lack.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, scratch, text_bytes

#: Words of the dictionary, the most frequent ones; where no labels are given, drawn findings, and labelled ones of the texts of each kind at most (about).
DICTIONARY_WORDS, LABELLED = 4000, 3000
TREES, DEPTH, SEED, ACCEPT = 30, 8, 7, 0.5
#: Bytes of context on either side.
CONTEXT = 48

# What proposes a candidate. Runs have no upper bound: each is read once, from its first byte to its last.
TOKEN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
ASSIGNED = re.compile(rb"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth|credential)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"'<>{}$]{8,})")
# Words beside a candidate, and parts of its path.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api", "auth", "credential", "bearer", "private", "access")
HARMLESS_WORDS = ("sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "commit", "revision", "uuid", "etag", "integrity", "example", "placeholder", "file", "path", "id")
HARMLESS_PATHS = ("test", "example", "sample", "fixture", "mock", "doc", "lock", "vendor", "readme")
# Forms by which a finding is plainly a secret or plainly none.
PLAIN_SECRET = re.compile(r"(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})")
PLAIN_KEY = re.compile(r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|credential)[\"']?\s{0,3}[:=]\s{0,3}([\"'])$")
PLAIN_HARMLESS = re.compile(r"(?i)[0-9]+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|.*(?:x{4}|0{6}|example|placeholder|changeme|your[_-]).*")
PLAIN_DIGEST = re.compile(r"(?i)(?:sha-?1|sha-?256|md5|commit|checksum|digest|revision|etag|integrity)\W{0,3}$")
FEATURES = ("length", "switches", "letter_fit", "digit_share", "hex", "repeats", "coverage", "path_harmless", "path_config", "word_secret", "word_harmless", "assigned", "quoted")

Lexicon = tuple[frozenset, dict]


def lexicon(docs: DataFrame, text_col: str = "text") -> Lexicon:
    """The DICTIONARY_WORDS most frequent words of all texts, and log probabilities of letter pairs in all their words.

    Words are counted within tasks before the shuffle. Only the dictionary and at most 26 * 26 pairs reach the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]{4,20}"), F.lit(0))).alias("w"))
    counts = scratch(words.groupBy("w").count(), "secret-words")
    top = counts.orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS).collect()
    at = F.sequence(F.lit(1), F.length("w") - 1)
    pairs = counts.select("count", F.explode(F.transform(at, lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("pair"))
    n = {r[0]: r[1] for r in pairs.groupBy("pair").agg(F.sum("count")).collect()}
    total = sum(n.values()) or 1
    return frozenset(r[0] for r in top), {k: math.log(v / total) for k, v in n.items()}


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str, path: str, words: Lexicon) -> list[float]:
    """FEATURES of one candidate."""
    dictionary, pairs = words
    low, n = value.lower(), len(value)
    kinds = [_kind(c) for c in value]
    letters = [low[i : i + 2] for i in range(n - 1) if kinds[i] < 2 and kinds[i + 1] < 2]
    covered = 0
    for run in re.findall("[a-z]{4,}", low):
        at = 0
        while at < len(run):
            size = next((k for k in range(min(20, len(run) - at), 3, -1) if run[at : at + k] in dictionary), 0)
            covered += size
            at += size or 1
    near = re.findall("[a-z0-9]+", before.lower())[-3:]
    beside = {*near, *re.findall("[a-z0-9]+", after.lower())[:1]}
    parts = {p for w in near for p in re.split("[0-9]+", w)} | beside
    path = path.lower()
    return [
        float(min(n, 200)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(pairs.get(x, -14.0) for x in letters) / len(letters) if letters else -14.0,
        kinds.count(2) / n,
        float(re.fullmatch("[0-9a-f-]+", low) is not None),
        len(set(low)) / min(n, 40),
        covered / n,
        float(any(p in path for p in HARMLESS_PATHS)),
        float(re.search(r"\.(env|cfg|conf|ini|ya?ml|properties|pem|json)$", path) is not None),
        float(any(w in parts for w in SECRET_WORDS)),
        float(any(w in parts for w in HARMLESS_WORDS)),
        float(re.search(r"[:=]\s*[\"']?$", before) is not None),
        float(before[-1:] in "\"'" and before[-1:] != ""),
    ]


def rule_label(value: str, before: str, after: str) -> int | None:
    """1 for a finding that is a secret by its form, 0 for one that is none, None for all others."""
    if PLAIN_HARMLESS.fullmatch(value) or PLAIN_DIGEST.search(before) or len(set(value)) <= 4:
        return 0
    quoted = PLAIN_KEY.search(before)
    if PLAIN_SECRET.fullmatch(value) or quoted and after[:1] == quoted[1] and re.fullmatch(r"(?=.*[0-9])[A-Za-z0-9+/_=-]{20,}", value):
        return 1
    return None


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of candidates: assigned values, and long tokens with a digit; of overlapping ones the first stays."""
    found = [m.span(1) for m in ASSIGNED.finditer(text)]
    found += [m.span() for m in TOKEN.finditer(text) if any(48 <= c <= 57 for c in m.group())]
    out, end = [], 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append((a, b))
            end = b
    return out


def _describe(words: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for small in (s for batch in batches for s in bounded(batch, "_text", 16 << 20)):
            rows, starts, ends, values, rules, columns = [], [], [], [], [], []
            for i, (text, path) in enumerate(zip(text_bytes(small.column("_text")), small.column("_path").to_pylist(), strict=True)):
                byte, point = 0, 0
                for a, b in candidates(text):
                    value = text[a:b].decode("utf-8", "replace")
                    before, after = text[max(0, a - CONTEXT) : a].decode("utf-8", "replace"), text[b : b + CONTEXT].decode("utf-8", "replace")
                    point += len(text[byte:a].decode("utf-8", "replace"))
                    starts.append(point)
                    byte, point = b, point + len(value)
                    ends.append(point)
                    rows.append(i)
                    values.append(value)
                    rules.append(rule_label(value, before, after))
                    columns.append(features(value, before, after, path or "", words))
            kept = pa.array(rows, pa.int64())
            own = small.column("_carry").take(kept)
            each = [pa.array([c[k] for c in columns], pa.float64()) for k in range(len(FEATURES))]
            found = [pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(values, pa.string()), pa.array(rules, pa.int32())]
            yield pa.RecordBatch.from_arrays([own, *found, *each], ["_carry", "start", "end", "value", "_rule", *FEATURES])

    return run


def describe(df: DataFrame, words: Lexicon, text_col: str, path_col: str) -> DataFrame:
    """One row a candidate: the other columns of ``df`` as ``_carry``, ``start``, ``end`` (code points), ``value``, ``_rule`` (rule_label) and FEATURES."""
    carry = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("_carry")
    rows = df.select(carry, F.col(text_col).alias("_text"), F.col(path_col).cast("string").alias("_path"))
    schema = f"_carry {rows.schema['_carry'].dataType.simpleString()}, start long, end long, value string, _rule int, " + ", ".join(f"{f} double" for f in FEATURES)
    return rows.mapInArrow(_describe(words), schema)


def labelled_findings(words: Lexicon, n: int = LABELLED, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(path, text, label) of drawn findings: one secret or one look-alike a text. Stands in where no labels are given."""
    rng = random.Random(seed)
    common = sorted(words[0])[:2000] or ["text"]
    plain = lambda k: " ".join(rng.choices(common, k=k))
    draw = lambda chars, k: "".join(rng.choices(chars, k=k))
    hexes, base = "0123456789abcdef", string.ascii_letters + string.digits
    secrets = [lambda: draw(hexes, rng.choice((32, 40, 64))), lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + draw(base, 36), lambda: draw(base + "+/", rng.randint(24, 60)) + "==", lambda: draw(base + "!#%&*", rng.randint(10, 20)), lambda: draw(base + "-_", rng.randint(20, 48))]
    names = ("token", "secret", "password", "api_key", "access_key", "auth_token", "private_key", "TOKEN", "Password", "client_secret")
    harmless = (
        lambda: ("commit " if rng.random() < 0.5 else "sha1: ") + draw(hexes, 40), lambda: "sha256:" + draw(hexes, 64), lambda: "md5 checksum " + draw(hexes, 32),
        lambda: "uuid " + "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(rng.choices(common, k=4)) + "/" + draw(string.digits, 3), lambda: "_".join(rng.choices(common, k=4)) + draw(string.digits, 2),
        lambda: rng.choice(names) + ' = "' + rng.choice(("xxxxxxxxxxxxxxxx1", "your_api_key_here_1", "changeme12345678", "00000000000000000000", "placeholder_value_1")) + '"', lambda: "id=" + draw(string.digits, 20),
        lambda: rng.choice(names) + ": " + "-".join(rng.choices(common, k=3)) + draw(string.digits, 1),
    )
    out = []
    for _ in range(n):
        label = int(rng.random() < 0.5)
        if label:
            body = rng.choice(names) + rng.choice((" = ", "=", ": ", '": ')) + rng.choice(('"', "'", "")) + rng.choice(secrets)() + '"'
        else:
            body = rng.choice(harmless)()
        path = rng.choice(("src/app.py", "conf/settings.env", "deploy/prod.yaml", "src3", "notes.txt", "") if label or rng.random() < 0.5 else ("tests/test_app.py", "docs/example.md", "package.lock", "src7", "README.md"))
        out.append((path, f"{plain(rng.randint(0, 6))} {body} {plain(rng.randint(0, 6))}", label))
    return out


def _forest(rows: DataFrame) -> PipelineModel:
    """A forest fitted on described findings with a ``label``."""
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="_features", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), forest]).fit(rows.select(F.col("label").cast("double").alias("label"), *FEATURES))


def fit(spark: SparkSession, findings: list[tuple[str, str, int]] | DataFrame, words: Lexicon) -> PipelineModel:
    """A forest fitted on labelled findings: (path, text, label), each text holding one finding. A bounded set."""
    rows = findings if isinstance(findings, DataFrame) else spark.createDataFrame(findings, "path string, text string, label int")
    return _forest(describe(rows, words, "text", "path").withColumn("label", F.col("_carry.label")))


def plain_findings(described: DataFrame, most: int = LABELLED) -> DataFrame:
    """Described findings that rules can label, about ``most`` of each label, drawn by the hash of their value."""
    ruled = described.where(F.col("_rule").isNotNull()).withColumn("label", F.col("_rule"))
    share = F.lit(0.0)
    for label, n in ruled.groupBy("label").count().collect():  # two rows
        share = F.when(F.col("label") == label, F.lit(min(1.0, most / n))).otherwise(share)
    return ruled.where(F.pmod(F.xxhash64("value"), F.lit(1 << 30)) < share * (1 << 30))


def scan(df: DataFrame, text_col: str = "text", path_col: str = "source", findings: list[tuple[str, str, int]] | DataFrame | None = None) -> DataFrame:
    """One row a candidate of ``df``: its other columns, ``start``, ``end``, ``value``, ``probability``, ``is_secret``.

    Null or empty texts hold none; a null path says nothing; a run of any length is one value. Columns of ``df`` with
    those names are replaced; no other name can clash. Repeated rows give repeated findings. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    made = ("start", "end", "value", "probability", "is_secret")
    kept = [c for c in df.columns if c not in made and c != text_col]
    words = lexicon(df, text_col)
    described = scratch(describe(df.drop(*[c for c in made if c not in (text_col, path_col)]), words, text_col, path_col), "secret-candidates")
    if findings is None:
        drawn = describe(spark.createDataFrame(labelled_findings(words), "path string, text string, label int"), words, "text", "path")
        columns = ["label", *FEATURES]
        model = _forest(drawn.withColumn("label", F.col("_carry.label")).select(columns).unionByName(plain_findings(described).select(columns)))
    else:
        model = fit(spark, findings, words)
    scored = model.transform(described).withColumn("probability", vector_to_array("_probability")[1])
    return scored.select(*[F.col("_carry")[c].alias(c) for c in kept], "start", "end", "value", "probability", (F.col("probability") >= ACCEPT).alias("is_secret"))
