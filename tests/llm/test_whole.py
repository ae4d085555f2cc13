"""Operators on what lies beyond a former bound."""

import os
import random
import shutil
import string
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from caseweave.llm import decontaminate, secrets, simhash

ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.mark.parametrize("n", [513, 5000])
def test_secret_runs_are_read_whole(n):
    draw = random.Random(n)
    late = "".join(draw.choices(string.ascii_letters, k=n - 1)) + "7"  # its only digit is its last byte
    for before, run in (("a blob ", late + "=="), ('password = "', late), ("token: ", "!" * n)):
        text = f"{before}{run} and more".encode()
        assert [text[a:b].decode() for a, b in secrets.candidates(text)] == [run]
    assert secrets.features(late, "", "", "", (frozenset(), {}))[0] == 200.0


def test_near_copies_leave_the_corpus(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8)))
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    texts = []
    for n in [30, 60, 120, 300] * 10:
        texts.append([word() for _ in range(n)])
        for _ in range(3):  # a copy with some words changed, on both sides of the limit
            copy = list(texts[-1])
            for i in rng.sample(range(n), rng.randint(1, 1 + n // 40)):
                copy[i] = word()
            texts.append(copy)
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    found, root = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similar(found[i], found[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want, got = set(root), {r["doc_id"] for r in simhash.keep_similar_one(df).collect()}
    plain = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    print(len(texts), len(want), len(got), len(got - want), len(want - got), len(plain))
    assert not want - got and len(want) < 0.8 * len(texts)
    assert len(got - want) <= 0.01 * (len(texts) - len(want))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == got


def test_a_passage_in_many_texts_takes_few_turns(spark, monkeypatch):
    """Texts that share most of a passage but aren't similar; some have near copies. None is left out, none taken for another's copy."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    passage, tags = [word() for _ in range(120)], []
    texts = [passage + [word() for _ in range(60)] for _ in range(300)]
    texts += [[*t[:-2], word(), word()] for t in texts[:20]]
    plain = simhash.scratch
    monkeypatch.setattr(simhash, "scratch", lambda df, tag: (tags.append(tag), plain(df, tag))[1])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_similar_one(df).collect()} == set(range(300))
    assert tags.count("similar-near") <= 12


@pytest.mark.parametrize("block_words", [1 << 20, 8])
def test_benchmark_items_without_an_id_hit_words(spark, block_words):
    words = [f"word{i}" for i in range(40)]
    bench = spark.createDataFrame([(None, " ".join(words[:20])), (7, " ".join(words[25:40]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words))], "doc_id long, text string")
    found = decontaminate.find_matches(docs, bench, block_words=block_words)
    got = {r[0]: r[1:] for r in found.select("doc_id", decontaminate.hit_words(found["hits"]), decontaminate.item_ids(found["matches"])).collect()}
    assert got == {1: (20, [None]), 2: (35, ["7", None])}


def test_repetitive_text_against_repetitive_item_stays_small():
    """Every place of the text matches many places of the item; what comes out grows with the text alone."""
    import tracemalloc

    bench = decontaminate.windows([(1, "la la ba " * 170), (2, "altro testo " * 20)])
    text = ("la la ba " * 17_000).encode()
    tracemalloc.start()
    counts, hits, found = decontaminate.matches([text, b"", b"la la ba altro"], bench)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert counts.tolist() == [51_000, 0, 4] and hits.tolist() == [[0, 0, 51_000]] and found.tolist() == [[0, 0, 0, 0, 510]]


def test_a_template_of_many_items_stays_small():
    """2,000 places of one passage that 10,000 items share: one match an item, and memory that doesn't go with their product."""
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(i, f"{passage} item{i} " + " ".join(f"x{i}y{k}" for k in range(12))) for i in range(10_000)]
    text = " qui ".join([passage] * 2000).encode()
    tracemalloc.start()
    bench = decontaminate.windows(items)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    block = sum(v.nbytes for v in bench.values() if hasattr(v, "nbytes"))
    assert block < 48 * bench["count"].sum()
    tracemalloc.reset_peak()
    counts, hits, found = decontaminate.matches([text, b"altro", passage.encode()], bench)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert len(hits) == 2001 and len(found) == 20_000 and (found[:, 4] == 20).all() and set(found[:, 0]) == {0, 2}
    assert (found[:10_000, 2] == 0).all()


def test_matches_in_small_steps_are_the_same(spark, monkeypatch):
    rng = random.Random(8)
    item = lambda: " ".join(rng.choice("abcde") for _ in range(rng.choice([3, 13, 20, 40])))
    items = [(i, item()) for i in range(60)]
    texts = [" zz ".join(rng.choice(items)[1] for _ in range(rng.randint(0, 6))).encode() for _ in range(40)]
    bench = decontaminate.windows(items)
    whole = [x.tolist() for x in decontaminate.matches(texts, bench)]
    docs, table = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r["doc_id"], sorted(map(tuple, r["matches"])), sorted(map(tuple, r["hits"]))) for r in decontaminate.find_matches(docs, table).collect())
    first = rows()
    monkeypatch.setattr(decontaminate, "ROWS", 7)
    monkeypatch.setattr(decontaminate, "SEARCHED", 5)
    assert [x.tolist() for x in decontaminate.matches(texts, bench)] == whole and rows() == first


def test_words_with_equal_hashes_are_told_apart():
    """Letters decide: a vocabulary in which every hash is the same still matches nothing but its own words."""
    bench = decontaminate.windows([(1, " ".join(f"w{i}" for i in range(20)))])
    hashes, counts, letters, first, sizes = decontaminate.words([b"x0 x1 x2"])
    same = decontaminate._equal(letters, first, bench["letters"], bench["first"][:3], np.array([2, 2, 2]))
    assert not same.any() and len(hashes) == 3 and counts.tolist() == [3] and sizes.tolist() == [2, 2, 2]


def test_workers_that_cannot_import_the_package(tmp_path):
    """All operators' queries run from another folder, where neither driver path nor worker path holds the repository.

    In a process and a session of its own, of little memory, as the tests' own session stays open beside it.
    """
    names = ("op1_simhash_trie", "op2_secret_forest", "op5_bloom_lines", "op7_suffix_arrays", "op9_bucket_pointers", "op10_language_id", "op11_partition_refinement", "op12_merge_rounds", "op13_filter_audit", "pipeline")
    code = (
        f"import sys\nsys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\nq = e.queries()\nsys.path.pop(0)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local-cluster[1,1,1024]').config('spark.executor.memory', '1g').config('spark.ui.enabled', 'false')"
        f".config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', {str(tmp_path / 'shared')!r}).getOrCreate()\n"
        f"for n in {names}:\n    print(n, q[n](s, {str(tmp_path / 'sf')!r}).count() >= 0, flush=True)\n"
    )
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.split() == [x for n in names for x in (n, "True")], done.stderr[-3000:]


def test_variants_of_one_text_on_both_sides_of_the_limit(spark, monkeypatch):
    """Copies of one text, most of them less similar to each other than the limit: the groups are those of brute force."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    base, tags = [word() for _ in range(120)], []
    texts = []
    for k in range(250):
        copy = list(base)
        for i in rng.sample(range(120), 2 + k % 7):
            copy[i] = word()
        texts.append(copy)
    found, root = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(found[i] & found[j]) >= 0.8 * len(found[i] | found[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    plain = simhash.scratch
    monkeypatch.setattr(simhash, "scratch", lambda df, tag: (tags.append(tag), plain(df, tag))[1])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_similar_one(df).collect()}
    print(len(set(root)), len(got), len(got - set(root)), tags.count("similar-near"))
    assert got == set(root)
    assert tags.count("similar-near") <= 14


def test_near_copies_are_joined_by_tries(spark, monkeypatch):
    """With no band's key shared, what the fingerprints' tries propose is still found, and checked; op1's links are its proposals."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    texts = []
    for _ in range(40):
        texts.append([word() for _ in range(300)])
        for at in (299, 150):  # the last word, then one in the middle
            copy = list(texts[-1])
            copy[at] = word()
            texts.append(copy)
    texts += [list("abc") * 60, list("abc") * 60 + ["abd"] * 3 + list("bca")]  # one set of shingles in other numbers, and more
    prints = [int(x) for x in simhash.fingerprints([" ".join(t).encode() for t in texts])]
    sets, root = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts], list(range(len(texts)))
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 3
            if near and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                linked += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    monkeypatch.setattr(simhash, "_shared", lambda rows: rows.limit(0))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert linked >= 20 and {r["doc_id"] for r in simhash.keep_similar_one(df).collect()} == set(root)


def test_links_of_a_spanning_forest_are_links():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (200, 400), (300, 5000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        kept = simhash.spanning(a, b, n)
        whole = simhash.forest(a, b, n)
        assert np.array_equal(simhash.forest(a[kept], b[kept], n), whole) and len(kept) == n - len(np.unique(whole))
