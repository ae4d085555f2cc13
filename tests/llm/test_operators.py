"""Every contract against a brute-force version, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from caseweave.llm import queries as q

LAST = 2**63 - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(write_docs, odd_rows):
    return write_docs(odd_rows, [(1, " ".join(f"parola{i % 37} testo{i}" for i in range(40, 60))), (2, "uno DUE"), (3, None), (4, ""), (5, "mai visto qui")])


@pytest.fixture(scope="module")
def empty(write_docs):
    return write_docs([])


def rows(spark, folder, name):
    return [r.asDict() for r in q.QUERIES[name](spark, folder).collect()]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_op1(spark, folder, odd_rows):
    def fp(t):
        w = WORD.findall((t or "").encode().lower())
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
        return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))

    docs = [(LAST if i is None else i, fp(t)) for i, t, _ in odd_rows]
    group = list(range(len(docs)))
    for _ in docs:
        group = [min([group[j] for j in range(len(docs)) if (docs[i][1] ^ docs[j][1]).bit_count() <= 3]) for i in range(len(docs))]
    want = Counter()
    for k, (i, f) in enumerate(docs):
        c = min(docs[j][0] for j in range(len(docs)) if group[j] == group[k])
        want[(None if i == LAST else i, f"{f:016x}", None if c == LAST else c)] += 1
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, folder, "op1_simhash_trie")) == want


def test_op2_scan_keeps_context_apart(spark, write_docs):
    key, sha1 = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    text = f'testo normale token = "{key}" e poi altro; commit {sha1} del ramo'
    got = rows(spark, write_docs([(1, text, "src/a.py"), (2, None, None), (3, "parola", "x")] * 2), "op2_secret_forest")
    assert {(r["doc_id"], r["start"], r["value_sha256"]) for r in got} == {(1, text.index(key), sha(key))}


def test_op3(spark, folder, odd_rows):
    got = rows(spark, folder, "op3_progressive_jpeg")
    want = Counter()
    for i, t, _ in odd_rows:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")
        want[(i, len(b), len(p), sha(p), zlib.crc32(p[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want


def test_op4(spark, folder, odd_rows):
    got = rows(spark, folder, "op4_sampled_splitters")
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < 40


def test_op4_sizes_with_a_hot_text(spark, write_docs):
    docs = [(i, "copia " * 20 if i % 3 == 0 else f"testo {i} " * (1 + i % 9), "a") for i in range(6000)]
    got = rows(spark, write_docs(docs), "op4_sampled_splitters")
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    total, largest = sum(sizes.values()), max(r["size"] for r in got)
    assert len(sizes) == 40 and all(abs(s - total / 40) <= largest for s in sizes.values())


def test_op5(spark, folder, odd_rows):
    blank = " \t\n\x0b\x0c\r"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(blank).translate(low)
    holders = defaultdict(set)
    for i, t, _ in odd_rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(LAST if i is None else i)
    want = Counter()
    for i, t, _ in odd_rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == (LAST if i is None else i)]
        want[(i, len(lines), len(lines) - len(kept), sha("\n".join(kept)))] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in rows(spark, folder, "op5_bloom_lines")) == want
    assert sum(n for (_, _, d, _), n in want.items() if d) >= 2


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c_d@e.f x@y.z.w.1 +1 (555) 123-4567 1.2.3.4.5 256.1.1.1 010.0.0.007", "4111 1111 1111 1111 4111-1111-1111-1112 \U0001f600 me@x.org", ".1.2.3.4 +49 (0)30-1234567-89. ++1 23 +12345678",
        "a." * 3000 + "@b.c", "1" * 2000 + ".1.1.1", None, "", "@@ a@b a@b. +12 +1()2 1..2.3.4 0-0-0-0-0-0-0-0-0-0-0-0-0-0", "x@y.z@w.v 1.2.3.4@a.b +1234567890+1234567890",
    ],
)
def test_op6_base(spark, write_docs, text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    spans = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    r = rows(spark, write_docs([(1, text, "a")]), "op6_weak_supervision")[0]
    assert r["base_sha256"] == sha(",".join(spans)) and r["spans"].startswith(",".join(spans))
    assert [r[f"n_{k}"] for k in patterns] == [sum(s.startswith(k) for s in spans) for k in patterns]


def test_op6_added_spans(spark, write_docs):
    docs = [(i, f"Her SSN: 123-45-67{i:02d}, call (555) 123-45{i:02d} now", "a") for i in range(60)] + [(100 + i, f"order 123-45-67{i:02d} page", "a") for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in rows(spark, write_docs(docs), "op6_weak_supervision")}
    assert all("ssn:9:20" in got[i] and "local_phone" in got[i] for i in range(60))
    assert not any("ssn" in got[100 + i] for i in range(60))


def test_op6_added_spans_by_brute_force(spark, write_docs):
    """Expectation-maximisation and the classifier once more, span by span in plain Python, from patterns and votes of its own."""
    import math
    import random

    from caseweave.llm import pii

    rng = random.Random(4)
    cues, odd = ["SSN: ", "social ", "order ", "version ", "call ", "tel ", "page ", "", "x y ", "account "], ["DE89 3704 0044 0532 0130 00", "GB00 1234 5678 9012 3456 00", "Dr Anna Weber", "Ms Li"]
    number = lambda: rng.choice([f"{rng.randint(1, 999):03d}-{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}", f"({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(0, 9999):04d}", rng.choice(odd)])
    docs = [(i, "".join(f"{rng.choice(cues)}{number()}, aé {rng.choice(['', '10.0.0.7 ', '+49 30 1234567 '])}" for _ in range(rng.randint(0, 6))), "a") for i in range(150)]
    docs += docs[:5] + [(None, docs[7][1], "a")] * 3

    def luhn97(v):
        v = v.replace(" ", "").upper()
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1

    def base(t):
        out = []
        for k in ("ip", "phone", "card"):
            for m in re.finditer({"ip": r"[0-9]+(?:\.[0-9]+){3}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "card": r"[0-9](?:[\x20-]?[0-9])+"}[k], t):
                d = re.sub("[^0-9]", "", m[0])
                if k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "phone" and 9 <= len(d) <= 15 or k == "card" and 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0:
                    out.append(m.span())
        return out

    spans = []
    for i, t in sorted({(d[0], d[1]) for d in docs}, key=str):
        taken = base(t)
        for kind, p in pii.CANDIDATES.items():
            end, last = 0, ""
            for m in re.finditer(p, t):
                before, (v, a, b) = (last + t[end : m.start()])[-pii.CONTEXT :].lower(), (m[0], *m.span())
                end, last = b, v
                if any(x < b and a < y for x, y in taken):
                    continue
                d = re.sub("[^0-9]", "", v)
                shape = {"iban": 1 if 15 <= len(v.replace(" ", "")) <= 34 else -1, "ssn": -1 if re.search("^(?:000|666|9[0-9]{2})|-00-|-0000$", v) else 1, "local_phone": -1 if re.search(r"^\(?[01]", v) else 1, "name": int(len(v) >= 7)}[kind]
                gazetteer = int(re.search(rf"(?:^|[^a-z])(?:{'|'.join(pii.GAZETTEER[kind])})[^a-z]*(?:[a-z]+[^a-z]+){{0,2}}$", before) is not None)
                context = -1 if re.search(rf"(?:^|[^a-z])(?:{'|'.join(pii.COUNTER_CUES)})", before) else int(re.search(r"[:=#]\s*$", before) is not None)
                check = {"iban": lambda v=v: 1 if luhn97(v) else -1, "ssn": lambda d=d: 1 if "001" <= d[:3] <= "899" and d[:3] != "666" else -1, "local_phone": lambda d=d: int(re.match("[2-9][0-8][0-9][2-9]", d) is not None), "name": lambda: 0}[kind]()
                variety = "none" if not d else "few" if len(set(d)) <= 2 else "many"
                spans.append(((i, t), kind, a, b, (shape, gazetteer, context, check), (kind, str(min(8, len(v) // 4)), variety, str(re.search(r"[a-z]\s*$", before) is not None).lower())))
    p = [min(0.95, max(0.05, 0.5 + 0.2 * sum(s[4]))) for s in spans]
    for _ in range(pii.ROUNDS):
        yes, n = sum(p), len(p)
        share = (yes + pii.PRIOR) / (n + 1)
        rate = {}
        for k in range(4):
            for vote in (-1, 0, 1):
                own = [q for q, s in zip(p, spans, strict=True) if s[4][k] == vote]
                rate[k, vote] = (sum(own) + (1 if vote > 0 else 0.5)) / (yes + 2), (len(own) - sum(own) + (1 if vote < 0 else 0.5)) / (n - yes + 2)
        odds = [math.log(share / (1 - share)) + sum(math.log(rate[k, s[4][k]][0] / rate[k, s[4][k]][1]) for k in range(4)) for s in spans]
        p = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
    yes, no = sum(p) + 1, len(p) - sum(p) + 1
    weight = {}
    for k in range(4):
        for value in {s[5][k] for s in spans}:
            own = [q for q, s in zip(p, spans, strict=True) if s[5][k] == value]
            weight[k, value] = math.log((sum(own) + 1) / (yes + 1)) - math.log((len(own) - sum(own) + 1) / (no + 1))
    want = {}
    for q, s in zip(p, spans, strict=True):
        if 1 / (1 + math.exp(-(math.log(q / (1 - q)) + sum(0.5 * weight[k, s[5][k]] for k in range(4))))) >= pii.ACCEPT:
            want.setdefault(s[0], []).append((s[1], s[2], s[3]))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = pii.find_pii(df.select("doc_id", "text")).join(df.withColumnRenamed("doc_id", "id").groupBy("id").agg({"text": "first"}).toDF("id", "t"), "id").collect()
    assert len(spans) > len([x for v in want.values() for x in v]) > 50
    for r in got:
        assert sorted(tuple(x) for x in r["_added"]) == sorted(want.get((r["id"], r["t"]), [])), r["t"]


def test_op6_long_text_of_numbers(spark, write_docs):
    import time

    text = ", ".join(f"+49 30 {i:07d}" for i in range(16_000))
    began = time.time()
    (r,) = rows(spark, write_docs([(1, text, "a")]), "op6_weak_supervision")
    assert r["n_phone"] == 16_000 and r["spans"].split(",")[-1] == f"phone:{len(text) - 14}:{len(text)}" and time.time() - began < 20


def brute_matches(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = low(text), set(), set()
    for item, t in items:
        v = low(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_op7(spark, folder, odd_rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in rows(spark, folder, "op7_suffix_arrays"))
    assert got == Counter((i, *brute_matches(t, items)) for i, t, _ in odd_rows)
    assert any(x[5] for x in got)


def test_op7_in_blocks_and_longest_matches(spark, folder, odd_rows):
    from caseweave.llm import decontaminate

    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    judge = lambda df: sorted((str(r["doc_id"]), r["n_words"], sorted((m["item_id"], m["doc_word"], m["item_word"], m["n_words"]) for m in r["matches"])) for r in df.collect())
    whole = judge(decontaminate.find_matches(docs, bench))
    assert whole == judge(decontaminate.find_matches(docs, bench, block_words=30))
    assert (1, 80, 0, 40) in dict((i, m) for i, _, m in whole)["4"]


def test_op8(spark, folder, odd_rows):
    got = rows(spark, folder, "op8_hash_threshold_mix")
    size = lambda t: len(WORD.findall((t or "").encode()))
    by = Counter()
    for _, t, s in odd_rows:
        by[s] += size(t)
    order = sorted((s for s in by if s is not None), key=str.encode) + [None]
    weight, total = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(by.values())
    target, left, free = {}, float(total), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * by[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * by[s]
            left -= target[s]
        free -= over
    of = {}
    for i, _, s in odd_rows:
        of.setdefault(i, set()).add(s)
    taken = Counter()
    for r in got:
        (s,) = of[r["doc_id"]]
        assert r["source_size"] == by[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in odd_rows)
    again = rows(spark, folder, "op8_hash_threshold_mix")
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_op8_comes_near_its_targets(spark, write_docs):
    docs = [(i, "w " * (1 + i * 7919 % 97), f"s{i % 5}" if i % 3 else "hot") for i in range(5000)]
    got = rows(spark, write_docs(docs), "op8_hash_threshold_mix")
    source = {i: s for i, _, s in docs}
    taken = Counter()
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
    for r in got:
        assert abs(taken[source[r["doc_id"]]] - r["target"]) <= max(97, 0.005 * r["target"])


def test_op8_passes_over_any_number_of_large_records(spark, write_docs):
    """Most of a source's first records are too large for its rest; small ones behind them still fill it."""
    docs = [(i, "w " * (4000 if i % 20 else 1 + i % 7), "big" if i % 2 else "small") for i in range(400)]
    docs += [(1000 + i, "w " * 3, s) for i in range(700) for s in ("big", "small")[i % 2 : i % 2 + 1]]
    got, source = rows(spark, write_docs(docs), "op8_hash_threshold_mix"), {i: s for i, _, s in docs}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= max(4, 0.005 * t) for s, t in target.items()), (taken, target)


@pytest.mark.parametrize(("hot", "chunk", "slice_bytes"), [(50_000, 200_000, 4 << 20), (2, 50, 4000)])
def test_op9(spark, write_docs, odd_rows, monkeypatch, hot, chunk, slice_bytes):
    from pyspark.sql import functions as F

    from caseweave.llm import suffixdedup

    monkeypatch.setattr(suffixdedup, "CHUNK", chunk)
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", slice_bytes)
    passage = "questo passaggio lungo piu di cinquanta byte si ripete in molti documenti diversi"
    docs = [*odd_rows, *[(100 + i, f"inizio {i * i} {passage}{i} fine {passage}", "a") for i in range(12)]]
    # A passage between other words in a third of the rows, null ids with texts of their own and with one text, long periodic texts.
    docs += [(1000 + i % 90, f"{sha(str(i))} {passage} {sha(str(-i))}", "a") for i in range(120)]
    docs += [(None, f"{sha(str(i // 2))}{passage}{i % 7}{sha(str(i % 5))}", "a") for i in range(120)]
    docs += [(2000 + i, ("ab" * (30_000 + i)) + sha(str(i)), "a") for i in range(3)] + [(2100, passage, "b")] * 40
    first = {}
    for i, t in sorted(((LAST if i is None else i, (t or "").encode()) for i, t, _ in docs), key=lambda x: x[0]):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = Counter()
    for i, t, _ in docs:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (LAST if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        want[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))] += 1
    df = spark.read.parquet(f"{write_docs(docs)}/documents.parquet")
    got = suffixdedup.dedup_bytes(df, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("k"))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(r[2] > 0 for r in want) > 12


def test_op10(spark, folder, odd_rows):
    got = rows(spark, folder, "op10_language_id")
    assert len(got) == len(odd_rows)
    for r in got:
        assert r["accepted"] == (r["language"] != "und" and r["probability"] >= 0.5)
    und = {r["doc_id"] for r in got if r["language"] == "und"}
    assert und == {1, 2, 3}


@pytest.mark.parametrize("name", [n for n in q.QUERIES])
def test_empty_table(spark, empty, name):
    assert rows(spark, empty, name) == []


@pytest.mark.parametrize("name", ["op4_sampled_splitters", "op6_weak_supervision", "op8_hash_threshold_mix"])
def test_native_operators_run_no_python(spark, folder, name):
    plan = q.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", list(q.SQL))
def test_sql_gives_the_same_rows(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rel = con.sql(q.SQL[name])
    columns = sorted(rel.columns)
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    want = Counter(tuple(near(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())
    assert Counter(tuple(near(r[c]) for c in columns) for r in rows(spark, folder, name)) == want
