import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.operators import claims, evidence, graph, matrix, retrieval, workflow
from caseweave.sources import files, portable
from caseweave.streaming import registry as streams


def test_nearest_clamps_k_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in retrieval.nearest(df, [1.0, 0.0], -3).collect()] == [1]
    assert [r["vec_id"] for r in retrieval.nearest(df, [1.0, 0.0], 99).collect()] == [1, 5, 2]
    assert [r["vec_id"] for r in retrieval.nearest(df, [1.0, 0.0], 20, cut_off=0.38).collect()] == [1, 5]


def test_evidence_trace(spark):
    text = "Pagare il saldo di euro 12.450 della fornitura"
    c = spark.createDataFrame([(1, 1, "attore", "domanda", text, [])], "claim_id long, case_id long, party string, kind string, text string, attachments array<long>")
    d = spark.createDataFrame(
        [(1, 1, "attore", "La fornitura venne consegnata e resta il saldo di euro 12.450."), (2, 1, "convenuto", "Il fornitore contesta ogni addebito."), (3, 1, "generici", "Verbale del 3/4/2024."), (4, 2, "attore", text)],
        "doc_id long, case_id long, section string, text string",
    )
    got = evidence.trace(c, d).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 2), r["reliability"]) for r in got] == [(1, 0.57, "media"), (2, 0.2, "bassa")]
    assert got[0]["numbers"] == ["12.450"] and got[0]["terms"] == ["fornitura", "saldo"] and got[0]["anchor"] == "doc-1-snippet-0"


SOURCE = "array<struct<doc_id:bigint,section:string,score:double,reliability:string,rating:string,anchor:string>>"
ROW = f"case_id long, claim_id long, fact_id long, party string, burden string, reasoning string, open_questions array<string>, not_contested array<string>, proof_state string, adversarial_state string, adversarial_note string, sources {SOURCE}, confidence double"


def test_matrix_row(spark):
    rows = spark.createDataFrame([(1, 1, 1, "attore", "x", "y", [], [], "da_verificare", "da_decidere", "", [(1, "attore", 0.78, "alta", None, "a")], 0.9)], ROW)
    r = matrix.matrix(rows).first()
    assert (r["suggested_adversarial"], r["suggested_proof"], r["gaps"]) == ("silente", "da_verificare", ["no_opponent_source"])


def test_red_team_rules(spark):
    rows = spark.createDataFrame([(1, 1, 1, "attore", "x", "", None, None, "provato", "da_decidere", "", None, 0.9)], ROW)
    drafts = spark.createDataFrame([], "case_id long, operative_part string")
    issues = matrix.red_team(rows, drafts)
    assert {r["rule"] for r in issues.collect()} == {"R1", "R3", "R7", "R9"}
    assert tuple(matrix.severity_counts(issues).first()) == (1, 4, 3, 1, 0)
    got = {(r["action"], r["rule"]) for r in matrix.actions(issues).collect()}
    assert got == {("cerca_fascicolo", "R1"), ("segna_insufficiente", "R1"), ("crea_quesito", "R1"), ("integra_motivazione", "R7"), ("compila_pqm", "R9")}


def test_actions_are_applied_in_order_once_a_fact(spark):
    facts = spark.createDataFrame([(1, 1, "provato", "", ""), (2, 1, "provato", "nota", "")], "fact_id long, claim_id long, proof_state string, operator_note string, question string")
    own = spark.createDataFrame([(1, 9, ["a"])], "claim_id long, case_id long, open_questions array<string>")
    todo = [
        (9, 1, "segna_insufficiente", 1, None, None), (9, 2, "segna_da_verificare", 1, None, None), (9, 3, "crea_quesito", 1, None, "b"), (9, 4, "crea_quesito", 2, None, "a"), (9, 5, "crea_quesito", 2, None, "b"), (9, 6, "chiedi_ctu", None, 1, ""),
        (9, 7, "compila_pqm", None, None, "testo"), (9, 8, "segna_insufficiente", None, 1, None), (9, 9, "cambia_stato", 1, None, None), (8, 10, "crea_quesito", 1, None, None), (9, 11, "chiedi_ctu", 77, None, None), (9, 12, "segna_insufficiente", 2, None, None),
    ]
    got = workflow.apply_actions(facts, own, spark.createDataFrame([(*t, "u") for t in todo], "case_id long, seq long, action string, fact_id long, claim_id long, text string, actor string"))
    assert [tuple(r) for r in got.facts.orderBy("fact_id").collect()] == [(1, 1, "da_verificare", C.INSUFFICIENT_NOTE, "b"), (2, 1, "insufficiente", "nota", "b")]
    assert got.claims.first()["open_questions"] == ["a", "b"]
    assert [(r["section"], r["ref_id"], r["text"]) for r in got.comments.orderBy("seq").collect()] == [("in_diritto", 1, C.COMMENT_TEXTS["chiedi_ctu"]), ("pqm", None, "testo")]
    assert [r["seq"] for r in got.refused.orderBy("seq").collect()] == [8, 9, 10, 11] and got.events.count() == 8


def test_metadata_edits(spark):
    docs = spark.createDataFrame([(1, "n", 3, "k", "x"), (2, "m", 1, "", "y")], "doc_id long, display_name string, ord int, kind string, other string")
    edits = spark.createDataFrame([(1, 1, "a" * 300, None, None), (1, 2, None, "-4", "b"), (1, 3, "z", "due", "c"), (2, 1, "", "", None)], "doc_id long, seq int, display_name string, ord string, kind string")
    out, refused = workflow.edit_metadata(docs, edits)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "a" * 255, 0, "b", "x"), (2, "", 0, "", "y")] and [r["seq"] for r in refused.collect()] == [3]


def test_usable_and_counts(spark):
    rows = [(1, 1, False, "accettato_senza_verifica"), (1, 2, True, "da_verificare"), (1, 3, True, "verificato"), (1, 4, True, "accettato_senza_verifica")]
    docs = spark.createDataFrame([(*r, "completata", "completata", "a/X.pdf", r[1]) for r in rows], "case_id long, doc_id long, pseudonymised boolean, acceptance string, extraction_state string, anonymisation_state string, file_name string, ord long")
    assert [r["doc_id"] for r in workflow.usable(docs).orderBy("doc_id").collect()] == [3, 4]
    assert tuple(workflow.document_counts(docs).first()) == (1, 4, 0, 3, 2, 1)
    assert [(r["doc_id"], r["first_id"]) for r in workflow.duplicate_names(docs).orderBy("doc_id").collect()] == [(2, 1), (3, 1), (4, 1)]
    assert {r["acceptance"] for r in workflow.bulk_accept(docs).where("pseudonymised").collect()} == {"accettato_senza_verifica"}


def test_transitions(spark):
    legal = workflow.transitions(spark)
    changes = spark.createDataFrame([("bozza_in_corso", "analizzato"), ("completato", "analizzato")], "before string, after string")
    assert [r["before"] for r in workflow.illegal_transitions(changes, legal).collect()] == ["completato"]


def test_changed_fields(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": None})], "x map<string,string>, y map<string,string>")
    assert list(df.select(workflow.changed_fields(F.col("x"), F.col("y")).alias("z")).first()["z"]) == ["b"]


def test_claim_extraction(spark):
    answers = spark.createDataFrame([(1, 'ecco: {"claims": [{"party": "attore", "text": "Pagamento della fattura 12", "confidence": "2"}, {"party": "attore", "text": "pagamento della fattura 12!"}]}'), (2, "niente")], "case_id long, raw string")
    docs = spark.createDataFrame([(1, 1, "convenuto", 0, "Conclusioni del convenuto: \n1) Rigettare la domanda\n2) In via riconvenzionale, condannare l'attrice\n### fine")], "case_id long, doc_id long, section string, ord int, text string")
    got = claims.extract(answers, docs).orderBy("seq").collect()
    assert [(r["party"], r["kind"], r["confidence"]) for r in got] == [("attore", "domanda", 1.0), ("convenuto", "difesa_eccezione", 0.9), ("convenuto", "riconvenzionale", 0.9)]


def test_party_stays_after_counterclaim(spark):
    docs = spark.createDataFrame([(1, 1, "attore", 0, "conclusioni attore: \n1) riconvenzionale\n2) pagamento")], "case_id long, doc_id long, section string, ord int, text string")
    assert [r["party"] for r in claims.conclusions(docs).orderBy("item").collect()] == ["convenuto", "convenuto"]


def test_graph_merge_is_idempotent(spark):
    nodes = spark.createDataFrame([(1, 0, "concetto", "Art. 2043 c.c.", ""), (2, 0, "riferimento", " ART 2043  C.C ", "danno"), (2, 1, "x", " ", "")], "doc_id long, seq int, kind string, label string, summary string")
    edges = spark.createDataFrame([(1, 0, "Art. 2043 c.c.", "Danno", "strano"), (1, 1, "Danno", "danno", "cita"), (2, 0, "art 2043 c c", "DANNO", "strano")], "doc_id long, seq int, from_label string, to_label string, kind string")
    n, e = graph.materialise(nodes, edges)
    assert {(r["key"], r["kind"], r["summary"], r["doc_id"]) for r in n.collect()} == {("art 2043 c c", "concetto", "danno", 1), ("danno", "concetto", "", 1)}
    assert [tuple(r) for r in e.collect()] == [("art 2043 c c", "danno", "correlato", 1.0)]


def test_visibility_neighbours_communities(spark):
    nodes = spark.createDataFrame([("a", None, None), ("b", 1, None), ("c", None, 7), ("d", 2, None)], "key string, doc_id long, case_id long")
    docs = spark.createDataFrame([(1, None), (2, 9)], "doc_id long, creator_id long")
    cases = spark.createDataFrame([(7, 9)], "case_id long, owner_id long")
    assert {r["key"] for r in graph.visible_nodes(nodes, docs, cases, 5).collect()} == {"a", "b"}
    assert graph.visible_nodes(nodes, docs, cases, 9).count() == 4
    edges = spark.createDataFrame([("a", "b", "cita"), ("b", "c", "cita"), ("a", "c", "cita"), ("x", "y", "cita"), ("a", "a", "cita")], "from_key string, to_key string, kind string")
    assert {r["other"] for r in graph.neighbours(edges, "a").collect()} == {"a", "b", "c"}
    found = {r["node"]: r["community"] for r in graph.communities(edges).collect()}
    assert found["a"] == found["b"] == found["c"] != found["x"] == found["y"]


def test_portable_round_trip_drops_unknown_attachments(spark):
    cases = spark.createDataFrame([(1, "t")], "case_id long, title string")
    docs = spark.createDataFrame([(1, 10, None, "f", "testo", bytearray(b"\x00\xff"))], "case_id long, doc_id long, section string, file_name string, text string, content binary")
    own = spark.createDataFrame([(1, 5, None, "c", None, [10, 99])], "case_id long, claim_id long, party string, text string, kind string, attachments array<long>")
    d, c, a = portable.import_cases(portable.export_cases(cases, docs, own))
    doc, claim, link = d.first(), c.first(), a.collect()
    assert (doc["section"], doc["content"], claim["party"], claim["kind"]) == ("generici", bytearray(b"\x00\xff"), "attore", "domanda")
    assert [(x["claim_id"], x["doc_id"]) for x in link] == [(claim["claim_id"], doc["doc_id"])]


def test_pages_and_search(spark):
    pages = spark.createDataFrame([(1, 2, "seconda pagina", 0.9, []), (1, 1, "prima", 0.5, ["x"]), (2, 1, "```\n```", 0.9, None)], "doc_id long, page int, text string, confidence double, uncertain array<string>")
    got = {r["doc_id"]: r for r in files.join_pages(pages).collect()}
    assert got[1]["text"] == "prima\n\nseconda pagina" and got[1]["uncertain"] == ["x"] and got[1]["low_confidence"] and got[2]["low_confidence"]
    html = '<a class="result__a" href="//r?uddg=https%3A%2F%2Fx.it%2F&amp;a=1">Uno &amp; <b>due</b></a><a class="result__snippet" href="#">testo</a>'
    r = files.search_results(spark.createDataFrame([(1, html)], "query_id long, html string")).first()
    assert (r["title"], r["snippet"], r["url"]) == ("Uno & due", "testo", "https://x.it/")
    route = spark.createDataFrame([("a.pdf", "x" * 40, 2), ("b.pdf", " ", 1), ("c.png", "", 1), ("d.exe", "", 1)], "p string, t string, n int").select(files.route(F.col("p"), F.col("t"), F.col("n")).alias("r"))
    assert [x["r"] for x in route.collect()] == ["native", "ocr", "ocr", "error"]


def test_binary_files(spark, tmp_path):
    (tmp_path / "uno.txt").write_bytes(b"ciao \xff mondo")
    (tmp_path / "due.exe").write_bytes(b"x")
    assert [(r["title"], r["text"]) for r in files.corpus_texts(spark, str(tmp_path)).collect()] == [("uno", "ciao  mondo")]


def test_readiness(spark):
    cases = spark.createDataFrame([(1, "in_attesa")], "case_id long, analysis_state string")
    docs = spark.createDataFrame([], "case_id long, doc_id long, pseudonymised boolean, acceptance string, extraction_state string, anonymisation_state string, file_name string, ord long")
    r = matrix.readiness(cases, docs, spark.createDataFrame([], ROW), spark.createDataFrame([], ROW), spark.createDataFrame([], "case_id long, operative_part string"), spark.createDataFrame([(1, True)], "case_id long, ok boolean")).first()
    assert set(r["blocks"]) == {"no_documents", "none_usable", "analysis_open", "no_draft"} and r["score"] == 52


@pytest.mark.parametrize("batches", [1, 2])
def test_stream_registry(spark, tmp_path, batches):
    ent = "array<struct<ph:string,value:string>>"
    schema = f"case_id long, doc_id long, ord int, masked string, entities {ent}"
    rows = [(1, 1, 0, "[PRIVATE_PERSON_1]", [("[PRIVATE_PERSON_1]", "Anna Bianchi")]), (1, 2, 1, "[PRIVATE_PERSON_7]", [("[PRIVATE_PERSON_7]", "Anna Bianchi")])]
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_registry(stream).writeStream.format("memory").queryName(f"reg{batches}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["text"] for r in spark.table(f"reg{batches}").collect()} == {"[PRIVATE_PERSON_1]"}


def test_stream_counts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t0, "a"), (t0 + dt.timedelta(minutes=5), "a"), (t0 + dt.timedelta(hours=5), "b")], "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    q = streams.stream_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["event_type"], r["n"]) for r in spark.table("counts").collect()] == [("a", 2)]


def test_relevant_attachments(spark):
    docs = spark.createDataFrame([(1, "fornitura saldo"), (2, "fornitura"), (3, "altro ancora"), (4, "saldo fornitura ritardo")], "doc_id long, text string")
    tokens = spark.createDataFrame([(1, ["fornitura", "saldo", "ritardo"]), (2, ["mancante"]), (3, [])], "claim_id long, tokens array<string>")
    wanted = spark.createDataFrame([(c, doc, k) for c in (1, 2, 3) for k, doc in enumerate((3, 2, 1, 4))], "claim_id long, doc_id long, ord int")
    got = {}
    for r in evidence.relevant_attachments(tokens, wanted, docs).orderBy("claim_id", "rank").collect():
        got.setdefault(r["claim_id"], []).append(r["doc_id"])
    assert got == {1: [4, 1, 2], 2: [3], 3: [3, 2, 1]}


def test_rag_context_is_scoped_and_never_fails(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a" * 400, None), (2, [0.9, 0.1], "b", 7), (3, [1.0, 0.0], "c", 8)], "vec_id long, embedding array<float>, text string, owner long")
    assert retrieval.rag_context(rows, [1.0, 0.0], 7).first()["context"] == "a" * 300 + "\n\nb"
    assert retrieval.rag_context(rows.where("vec_id < 0"), [1.0, 0.0], 7).first()["context"] == ""


def test_outgoing_queries_are_masked(spark):
    from caseweave.operators import privacy

    rows = spark.createDataFrame([(1, 1, ["danni a Mario Rossi", " ", "x", "quarta"], [("[PRIVATE_PERSON_1]", "Mario Rossi")])], "case_id long, claim_id long, queries array<string>, entities array<struct<ph:string,value:string>>")
    assert [r["query"] for r in privacy.research_queries(rows).orderBy("pos").collect()] == ["danni a [PRIVATE_PERSON_1]", "x"]


def test_report_lines_and_burden(spark):
    source = "array<struct<anchor:string,score:double>>"
    rows = spark.createDataFrame([(1, 1, "domanda", [(f"a{k}", k / 10) for k in range(7)])], f"case_id long, claim_id long, text string, sources {source}")
    events = spark.createDataFrame([(1, k, "nota", dt.datetime(2024, 1, 1, 10, k)) for k in range(45)], "case_id long, event_id long, kind string, ts timestamp")
    lines = workflow.report_lines(rows, events).orderBy("ord").collect()
    assert [r["style"] for r in lines] == ["claim"] + ["source"] * 5 + ["event"] * 40 and lines[1]["text"] == "a6 0.60" and lines[6]["text"] == "01/01/2024 10:44 nota"
    one = lambda k, t, g: spark.range(1).select(claims.burden(F.lit(k), F.lit("attore"), F.lit(t), F.lit(g)).alias("b")).first()["b"]
    assert one("domanda", "pagare 12.450", "prova di 12.450") == "prova di 12.450"
    assert one("domanda", "pagare 12.450", "prova di 99.000") == "domanda:attore"
    assert one("domanda", "penale per ritardo", "prova del danno") == "penale_ritardo"
    assert one("istruttoria", "ctu", "prova del fatto") == "istruttoria:attore"


def test_undisputed(spark):
    says = spark.createDataFrame([(1, "l'esistenza del contratto è pacifica"), (1, "il danno"), (2, "l'esistenza del contratto è pacifica")], "case_id long, text string")
    docs = spark.createDataFrame([(1, "attore", "il contratto"), (1, "convenuto", "contratto d'appalto"), (2, "attore", "il contratto")], "case_id long, section string, text string")
    assert [r["supported"] for r in claims.undisputed(says, docs).orderBy("case_id", "text").collect()] == [False, True, False]
