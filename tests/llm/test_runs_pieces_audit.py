"""Periodic runs, SentencePiece and the filter audit against brute force, the library, and SQL."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from caseweave.llm import audit, periodic, pieces, queries

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
words = lambda text: (text or "").encode().split()


def brute_runs(w, least=12):
    """Every stretch in which words q apart are equal, as far as it goes, for each q that is its smallest period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and not any(all(w[x] == w[x + r] for x in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_runs_of_small_alphabets_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(0, 6)):
            n, k = rng.choice([0, 1, 2, 5, 30, 60]), rng.randint(1, 4)
            w = [rng.randint(0, k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // 3 + 1)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        least = rng.choice([2, 12])
        got = periodic.runs(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts], np.int64), least)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t, least)]


def run_rows(rows):
    out = []
    for doc_id, text in rows:
        w = planted(doc_id, words(text))
        runs = brute_runs(w)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((doc_id, len(runs), *head, sha(listed), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()))
    return sorted(out, key=repr)


def test_op11_equals_brute_force(spark, write_docs, odd_rows):
    rng = random.Random(2)
    ids = [i for i in range(1, 4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    more = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 150))), "s") for i in rng.sample(ids, 60)]
    more += [(5000 + i, " ".join(rng.choice(["la", "ba"]) for _ in range(rng.randint(1, 80))), "s") for i in range(40)]
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000] + more
    got = queries.op11_partition_refinement(spark, write_docs(rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=repr) == run_rows([r[:2] for r in rows])


def test_runs_keep_columns_and_take_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 40, "x", "y")], "doc_id long, text string, n_words string, `odd.name` string")
    row = periodic.find_runs(df).first()
    assert row["odd.name"] == "y" and row["n_words"] == 40 and [tuple(r) for r in row["runs"]] == [(0, 40, 1)] and row["collapsed"] == "a"
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_a_long_text_of_one_word(spark):
    runs = periodic.runs(np.zeros(30_000, np.int64), np.array([30_000]))
    assert runs.tolist() == [[0, 0, 30_000, 1]]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.load(MODEL)


def some_texts(odd_rows):
    rng = random.Random(3)
    bits = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "é", "\U0001f600", "in", "ing", "1", "=", "-", "你", "́", "he", "the", "er", "<0x0A>", "<s>", "\0"]
    texts = [t for _, t, _ in odd_rows] + [" ", "  a", "a  ", " " * 1000, "a" + " " * 517 + "b  c", "=" * 700, "x" * 3000, "the " * 300, "日本語テキスト", "<unk></s>"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 200))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF)])) for _ in range(300)) for _ in range(100)]
    return texts + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)) for _ in range(3)]


def test_pieces_equal_the_library(model, library, odd_rows):
    texts = some_texts(odd_rows)
    ids, counts = pieces.encode(texts, model)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode(text or ""), text[:80]
        assert pieces.decode(own.astype(int), model) == library.decode(own.tolist())


def test_decoding_any_numbers_equals_the_library(model, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 2), rng.randint(3, 258), rng.randint(259, 31_999), 259, 29871]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(np.array(ids, int), model) == library.decode(ids), ids


def test_pieces_without_the_cut_of_long_runs_are_the_same(model):
    whole = {**model, "long": 0}
    for text in (" " * 600, "a" + " " * 333 + "the", " " * 31 + "x", " " * 32, " " * 33):
        assert pieces.encode([text], whole)[0].tolist() == pieces.encode([text], model)[0].tolist()


def test_op12_equals_the_library(spark, write_docs, odd_rows, library):
    rows = [*odd_rows, *[(100 + i, t, "s") for i, t in enumerate(some_texts([])[:60])]]
    got = queries.op12_merge_rounds(spark, write_docs(rows))
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "string", "string"]
    assert queries.op12_merge_rounds(spark, write_docs([])).count() == 0
    docs = spark.createDataFrame(odd_rows[:8], "doc_id long, text string, `odd.name` string")
    back = pieces.decode_ids(pieces.encode_texts(docs, MODEL), MODEL).collect()
    assert [r["decoded"] for r in back] == [t or "" for _, t, _ in odd_rows[:8]] and back[3]["odd.name"] == "a"


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x0a\x05\x0a\x03abc")
    with pytest.raises(ValueError):
        pieces.load(str(tmp_path / "m"))


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(key(i), least.get(t or "", key(i)))
    marks = {}
    for i, q, x in labels:
        a, b = marks.get(i, (0, 0))
        marks[i] = (max(a, q == 1), max(b, x == 1))
    docs = []
    for i, t, lang in rows:
        t, w = t or "", words(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), key(i) > least[t]]
        docs.append((lang or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = []
    for part in {d[0] for d in docs}:
        mine, share, lines = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                share[f] += len(gone)
                fails = [d for d in mine if f in d[1]]
                lines.append((part, "".join(order), k + 1, len(left), len(gone), len(fails) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*line, share[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def audit_tables(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "2 AS mask", "'x' AS part", "0 AS quality").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_op13_equals_brute_force(spark, tmp_path, odd_rows, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["uno", "Due", "TRE", "#x", *map(str, range(300))]) for _ in range(rng.randint(1, 400))) for _ in range(12)]
    rows = [(i, t, rng.choice(["it", "en", "", None])) for i, t, _ in odd_rows] + [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["it", "en", "de"])) for _ in range(150)]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in [*range(30), 3, 4, 5, None]]
    sf = audit_tables(spark, tmp_path, rows, labels)
    want = brute_audit(rows, labels)
    got = queries.op13_filter_audit(spark, sf)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == want and len(want) == 600 * 4
    # Equal fingerprints of different texts, and tasks that hold one text at a time, change nothing.
    plain = audit.F.xxhash64
    monkeypatch.setattr(audit.F, "xxhash64", lambda c: plain(c) % 2)
    monkeypatch.setattr(audit, "HELD_BYTES", 1)
    assert sorted(map(tuple, queries.op13_filter_audit(spark, sf).collect())) == want
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", (True, 0)), (i is None, i or 0))
    late = sorted(repr(i) for i, t, _ in rows if (i is None, i or 0) > first[t or ""])
    assert sorted(repr(r[0]) for r in audit.copies(spark.read.parquet(f"{sf}/documents.parquet")).collect()) == late


def test_op13_of_no_documents(spark, tmp_path):
    assert queries.op13_filter_audit(spark, audit_tables(spark, tmp_path, [], [])).count() == 0


def test_op13_agrees_with_sql(spark, tmp_path, odd_rows):
    rng = random.Random(6)
    rows = [(i, t, rng.choice(["it", None])) for i, t, _ in odd_rows]
    for sf in (SF, audit_tables(spark, tmp_path, rows, [(4, 1, 0), (5, 0, 1)])):
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'' if sf == SF else '/*.parquet'}'")
        got = queries.op13_filter_audit(spark, sf)
        columns = ", ".join(got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {columns} FROM ({queries.SQL['op13_filter_audit']})").fetchall())
