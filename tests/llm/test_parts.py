"""The operators' parts: the trie walk, the JPEG reader, the language model, refinement, and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseweave.llm import language, media, secrets, simhash, suffixdedup
from caseweave.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("leaves", [1 << 15, 4])
def test_trie_join_finds_all_components(spark, leaves):
    rng, seen = random.Random(3), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            seen.add(x)
    keys = sorted(x - 2**64 if x >= 2**63 else x for x in seen)
    df = spark.createDataFrame([(k,) for k in keys], "fp long")
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df, node_leaves=leaves)).collect()}
    assert all(got.get(k, k) == find(k) for k in keys)


def test_refine_equals_brute_force():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 76))) for _ in range(40)]
    texts += [texts[3], texts[7][:60] + b"x" * 10, b"y" * 76, b"y" * 70]
    ids = np.array([rng.randint(0, 30) for _ in texts])
    first = {}
    for i, t in zip(ids.tolist(), texts, strict=True):
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    want = {(c, k) for c, t in enumerate(texts) for k in range(len(t) - 49) if first[t[k : k + 50]] < ids[c]}
    a, b = suffixdedup.refine(b"".join(texts), np.array([len(t) for t in texts]), ids)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and want


def scalar_jpeg(planes, sampling, size, restart, scans):
    """A plain progressive encoder, block by block, for any coefficients: planes[i] is (rows, columns, 64) in zigzag order."""
    table_dc, table_ac = media.DC_TABLE, media.AC_TABLE
    (dc, dn), (ac, an) = media._codes(table_dc), media._codes(table_ac)
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes(range(1, 65))), media._segment(0xC4, bytes([0, *table_dc[0], *table_dc[1]])), media._segment(0xC4, bytes([16, *table_ac[0], *table_ac[1]]))]
    if restart:
        out.append(media._segment(0xDD, restart.to_bytes(2, "big")))
    parts = b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(sampling))
    out.append(media._segment(0xC2, bytes([8]) + size[1].to_bytes(2, "big") + size[0].to_bytes(2, "big") + bytes([len(planes)]) + parts))
    mx, my = max(x for x, _ in sampling), max(y for _, y in sampling)
    mcu = (-(-size[0] // (8 * mx)), -(-size[1] // (8 * my)))
    cut = lambda v, al: int(abs(v)) >> al if v >= 0 else -(int(abs(v)) >> al)
    for ids, ss, se, ah, al in scans:
        if len(ids) > 1 or len(planes) == 1:
            units = [[(i, my_ * sampling[i][1] + j // sampling[i][0], mx_ * sampling[i][0] + j % sampling[i][0]) for i in ids for j in range(sampling[i][0] * sampling[i][1])] for my_ in range(mcu[1]) for mx_ in range(mcu[0])]
        else:
            i = ids[0]
            w, h = -(-(-(-size[0] * sampling[i][0] // mx)) // 8), -(-(-(-size[1] * sampling[i][1] // my)) // 8)
            units = [[(i, r, c)] for r in range(h) for c in range(w)]
        body, n_rst = b"", 0
        for at in range(0, len(units), restart or len(units)):
            bits, pred, run, tail = [], Counter(), 0, []

            def flush():
                nonlocal run, tail
                if run:
                    e = run.bit_length() - 1
                    bits.append((int(ac[e << 4]), int(an[e << 4])))
                    if e:
                        bits.append((run - (1 << e), e))
                    bits.extend(tail)
                run, tail = 0, []

            for unit in units[at : at + (restart or len(units))]:
                for i, r, c in unit:
                    z = planes[i][r, c]
                    if ss == 0 and ah == 0:
                        v = int(z[0]) >> al
                        d = v - pred[i]
                        pred[i] = v
                        s = abs(d).bit_length()
                        bits += [(int(dc[s]), int(dn[s])), (d if d > 0 else d + (1 << s) - 1, s)]
                    elif ss == 0:
                        bits.append((int(z[0]) >> al & 1, 1))
                    elif ah == 0:
                        zeros = 0
                        for k in range(ss, se + 1):
                            v = cut(z[k], al)
                            if v == 0:
                                zeros += 1
                                continue
                            flush()
                            while zeros > 15:
                                bits.append((int(ac[0xF0]), int(an[0xF0])))
                                zeros -= 16
                            s = abs(v).bit_length()
                            bits += [(int(ac[zeros << 4 | s]), int(an[zeros << 4 | s])), (v if v > 0 else v + (1 << s) - 1, s)]
                            zeros = 0
                        if zeros:
                            run += 1
                    else:
                        last = max([k for k in range(ss, se + 1) if abs(cut(z[k], al)) == 1], default=ss - 1)
                        zeros, corrections = 0, []
                        for k in range(ss, se + 1):
                            v = cut(z[k], al)
                            if v == 0:
                                zeros += 1
                                continue
                            while zeros > 15 and k <= last:
                                flush()
                                bits.append((int(ac[0xF0]), int(an[0xF0])))
                                bits += corrections
                                zeros, corrections = zeros - 16, []
                            if abs(v) > 1:
                                corrections.append((abs(v) & 1, 1))
                                continue
                            flush()
                            bits += [(int(ac[zeros << 4 | 1]), int(an[zeros << 4 | 1])), (int(v > 0), 1), *corrections]
                            zeros, corrections = 0, []
                        if zeros or corrections:
                            run += 1
                            tail += corrections
            flush()
            stream = "".join(format(v, f"0{n}b") for v, n in bits if n)
            stream += "1" * (-len(stream) % 8)
            data = bytes(int(stream[k : k + 8], 2) for k in range(0, len(stream), 8)).replace(b"\xff", b"\xff\x00")
            if at:
                body += bytes([0xFF, 0xD0 + n_rst % 8])
                n_rst += 1
            body += data
        out += [media._sos([i + 1 for i in ids], ss, se, ah, al), body]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize(("sampling", "size"), [([(2, 2), (1, 1), (1, 1)], (37, 21)), ([(1, 1)], (17, 9)), ([(2, 1), (1, 1), (1, 1)], (40, 8))])
def test_reader_takes_general_progressive_files(restart, sampling, size):
    rng = np.random.default_rng(7)
    mx, my = max(x for x, _ in sampling), max(y for _, y in sampling)
    mcu = (-(-size[0] // (8 * mx)), -(-size[1] // (8 * my)))
    planes = []
    for x, y in sampling:
        z = rng.integers(-60, 60, (mcu[1] * y, mcu[0] * x, 64)) * (rng.random((mcu[1] * y, mcu[0] * x, 64)) < 0.15)
        z[:, :, 1::9] = rng.integers(-1, 2, z[:, :, 1::9].shape)
        # blocks outside a plane's own grid appear only in interleaved scans
        w, h = -(-(-(-size[0] * x // mx)) // 8), -(-(-(-size[1] * y // my)) // 8)
        z[h:, :, 1:] = 0
        z[:, w:, 1:] = 0
        planes.append(z)
    every = list(range(len(planes)))
    scans = [(every, 0, 0, 0, 1)] + [([i], 1, 5, 0, 2) for i in every] + [([i], 6, 63, 0, 2) for i in every] + [([i], 1, 63, 2, 1) for i in every] + [(every, 0, 0, 1, 0)] + [([i], 1, 63, 1, 0) for i in every]
    file = scalar_jpeg(planes, sampling, size, restart, scans)
    other, _ = media.write([b"altro file nella stessa lettura" * 5])
    images, coefs = media.read([other[0], file])
    for (x, y, w, h, first, q, _), z in zip(images[1].planes, planes, strict=True):
        assert np.array_equal(coefs[first : first + w * h].reshape(h, w, 64), z)
        assert q.tolist() == list(range(1, 65))
    assert media.tensors(images, coefs)[1].shape == (size[1], size[0], 3)


def test_jpeg_tensor_is_the_inverse_transform():
    images, coefs = media.read(media.write([bytes(range(64))])[0])
    coefs[:] = 0
    coefs[:, 0] = 80
    flat = media.tensors(images, coefs)[0]
    cb = cr = 80 / 8
    y = 128 + 80 / 8
    assert np.allclose(flat, [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], atol=1)
    with pytest.raises(ValueError, match="not a JPEG"):
        media.read([b"no picture"])


def test_tensor_column(spark):
    df = media.load_tensors(media.store(spark.createDataFrame([(1, "x" * 500), (2, None)], "doc_id long, text string")).drop("text"))
    assert all(len(r["rgb"]) == r["width"] * r["height"] * 3 for r in df.collect())


def test_language_model_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    model = language.train(docs.where("doc_id % 2 = 0"))
    held = [(r["text"], r["lang"]) for r in docs.where("doc_id % 2 = 1").collect()]
    log, _, _ = language.text_log_likelihoods([t.encode() for t, _ in held], model)
    right = [language.LANGUAGES[k] == lang for k, (_, lang) in zip(log.argmax(axis=1).tolist(), held, strict=True)]
    assert sum(right) >= 0.97 * len(right)


def test_language_evidence_decides_short_texts(spark):
    docs = table(spark, SF, "documents")
    pages = spark.createDataFrame([(k, f"http://a.example.fr/{k}", '<html lang="fr"><body>Le café est à côté de la forêt près du château où elle était</body></html>') for k in range(30)] + [(99, 'http://a.example.fr/1', '<html lang="fr"><body>de la</body></html>')], "page_id long, url string, html string")
    from pyspark.sql import functions as F

    rows = pages.select("page_id", *[c.alias(k) for k, c in language.web_evidence(F.col("url"), F.col("html")).items()])
    scores = language.score(rows, language.train(docs))
    got = {r["page_id"]: r for r in language.fuse(scores, language.evidence(scores)).collect()}
    assert got[99]["language"] == "fr" and got[99]["accepted"]


def test_secret_forest_on_held_out_findings(spark):
    words = secrets.lexicon(table(spark, SF, "documents"))
    model = secrets.fit(spark, secrets.labelled_findings(words, 1500), words)
    held = spark.createDataFrame(secrets.labelled_findings(words, 600, seed=91), "path string, text string, label int")
    rows = model.transform(secrets.describe(held, words, "text", "path")).select("_carry.label", "_prediction").collect()
    assert sum(r["label"] == r["_prediction"] for r in rows) >= 0.95 * len(rows)


def test_secret_candidates_and_places_by_brute_force(spark):
    """Tokens letter by letter, places in code points, runs of any length, many findings in one text."""
    rng = random.Random(5)
    inside = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    texts = [None, "", "a" * 600 + "1", ("x" * 1199) + "2 é " + ("y" * 99_999) + "3", "\u00e9 \U0001f600 " * 50 + "k9" * 40]
    for _ in range(60):
        texts.append("".join(rng.choice(["é", " ", "\n", '"', "ab", "Z9", "k" * 15, "0" * 17, "+/", "=", "ñ", "q1w2e3r4t5y6u7i8"]) for _ in range(rng.randint(1, 300))))

    def brute(t):
        out, at = [], 0
        while at < len(t):
            if t[at] not in inside or at and t[at - 1] in inside:
                at += 1
                continue
            end = at
            while end < len(t) and t[end] in inside:
                end += 1
            if end - at >= 16:
                stop = end
                while stop < min(len(t), end + 2) and t[stop] == "=":
                    stop += 1
                if any(c.isdigit() for c in t[at:stop]):
                    out.append((at, stop, t[at:stop]))
            at = end
        return out

    df = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, _rule string")
    got = {}
    for r in secrets.scan(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["value"]))
        assert 0 <= r["probability"] <= 1 and r["_rule"] == "x"
    assert {i: sorted(v) for i, v in got.items()} == {i: brute(t) for i, t in enumerate(texts) if t and brute(t)}
    log = " ".join(f"token={i:032x} é" for i in range(20_000))  # places are counted on, not from the start each time
    batch = spark.createDataFrame([(1, log, "s")], "doc_id long, text string, source string")
    last = secrets.describe(batch, (frozenset(), {}), "text", "source").orderBy("start").tail(1)[0]
    assert log[last["start"] : last["end"]] == last["value"] == f"{19_999:032x}"


def test_secret_features_by_hand():
    words = (frozenset({"word", "words", "house"}), {"wo": -1.0, "or": -3.0})
    got = dict(zip(secrets.FEATURES, secrets.features("wordhouseX12", 'the api_key = "', '" end', "conf/app.env", words), strict=True))
    assert got["length"] == 12 and got["switches"] == 2 / 12 and got["coverage"] == 9 / 12 and got["digit_share"] == 2 / 12
    assert got["letter_fit"] == (-1.0 - 3.0 - 14.0 * 7) / 9 and got["repeats"] == len(set("wordhousex12")) / 12
    assert (got["hex"], got["path_harmless"], got["path_config"], got["word_secret"], got["word_harmless"], got["assigned"], got["quoted"]) == (0, 0, 1, 1, 0, 1, 1)


def test_secrets_of_the_tables(spark):
    """Precision and recall on findings of the tables that rules can label, fitted on one half of them, held out the other."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    words = secrets.lexicon(docs)
    described = secrets.describe(docs.select("doc_id", "text", "source"), words, "text", "source").where("_rule IS NOT NULL").withColumn("label", F.col("_rule")).cache()
    odd = F.pmod(F.xxhash64("value"), F.lit(2)) == 1
    drawn = secrets.describe(spark.createDataFrame(secrets.labelled_findings(words), "path string, text string, label int"), words, "text", "path").withColumn("label", F.col("_carry.label"))
    columns = ["label", *secrets.FEATURES]
    model = secrets._forest(drawn.select(columns).unionByName(described.where(odd).select(columns)))
    rows = model.transform(described.where(~odd)).select("label", "_prediction").collect()
    hit = sum(r["label"] == 1 == r["_prediction"] for r in rows)
    print("precision", hit, sum(r["_prediction"] for r in rows), "recall", hit, sum(r["label"] for r in rows), "of", len(rows))
    assert hit >= 0.95 * sum(r["label"] for r in rows) and hit >= 0.95 * sum(r["_prediction"] for r in rows) and hit > 0


def test_language_recall_with_the_declared_language_hidden(spark):
    """Each language by text and source alone, on the half of the rows that the model isn't fitted on; other languages and junk are und."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    model = language.train(docs.where(half))
    others = ["Szybki brązowy lis przeskakuje nad leniwym psem każdego ranka i wraca do domu", "Быстрая коричневая лиса прыгает через ленивую собаку", "敏捷的棕色狐狸跳过懒狗", "xqzj kvwp zzzq jjkx wqpv zxcv qqqq wwww kkkk " * 3]
    rows = docs.where(~half).select("doc_id", "source", "text", "lang").unionByName(spark.createDataFrame([(-1 - i, "web", t, "none") for i, t in enumerate(others)], "doc_id long, source string, text string, lang string"))
    scores = language.score(rows.select("doc_id", "lang", *[c.alias(k) for k, c in language.plain_evidence(F.col("source"), F.lit(None).cast("string"), F.col("text")).items()]), model).cache()
    found = language.fuse(scores, language.evidence(scores)).where("lang IN ('de', 'en', 'es', 'fr', 'none')").select("lang", "language", "accepted").collect()
    for name in ("de", "en", "es", "fr"):
        own = [r for r in found if r["lang"] == name]
        right = sum(r["language"] == name for r in own)
        print(name, right, len(own))
        assert right >= 0.95 * len(own) > 10
    assert not any(r["accepted"] for r in found if r["lang"] == "none")


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.scratch(stage(spark, docs, SF), "test-stage")
        if name != "sharding":
            assert out.columns == columns
        if name != "mixing sources":
            assert out.count() <= seen
        if name == "SimHash near-dedup":
            assert out.select("text").distinct().count() == out.count()
        docs, seen = out, out.count()
    assert docs.where("shard < 0 OR shard > 39").isEmpty()


def test_pipeline_takes_odd_rows(spark, write_docs, odd_rows):
    folder = write_docs(odd_rows, [(1, "uno due")])
    got = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in got.collect()}
    assert not ids & {1, 2, 3, 7, 8, 5} and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["_id"] for r in got.collect()} == {"y"}  # a column of theirs, not the operator's
    assert corpus_pipeline.run(spark, write_docs([])).count() == 0
