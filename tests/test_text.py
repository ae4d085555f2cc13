import pytest
from pyspark.sql import functions as F

from caseweave.functions import sequence as S
from caseweave.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_chunks(spark):
    got = one(spark, "x" * 1700 + "\n\n" + "y" * 800 + "\n\n   \n\nz", T.chunks)
    assert [len(c) for c in got] == [800, 800, 100, 800, 1]
    assert one(spark, "   ", T.chunks) == [""] and one(spark, None, T.chunks) == [""]


def test_numbers(spark):
    got = one(spark, "saldo € 12.450 e 1 000,50; fattura 77/2024 del 03-04-2024; 12450; 5,20", T.sensitive_numbers)
    assert set(got) == {"12.450", "1000,50", "77/2024", "03-04-2024"}


def test_windows(spark):
    got = one(spark, " ".join(["w"] * 200), T.word_windows)
    assert [(w["start"], w["n_words"]) for w in got] == [(0, 90), (70, 90), (140, 60)]
    assert one(spark, "", T.word_windows) is None


def test_segments_split_sentences_and_long_parts(spark):
    assert one(spark, "Primo punto. Secondo punto; [ORG_1] chiede\n\nTerzo", T.segments) == ["Primo punto.", "Secondo punto;", "[ORG_1] chiede", "Terzo"]
    assert [len(s.split()) for s in one(spark, " ".join(["w"] * 200), T.segments)] == [90, 90, 60]


@pytest.mark.parametrize(
    ("text", "party", "kind"),
    [
        ("domanda riconvenzionale", "attore", "riconvenzionale"), ("si contesta tutto", "attore", "difesa_eccezione"), ("eccezione di prescrizione", "attore", "difesa_eccezione"),
        ("condannare al pagamento", "convenuto", "riconvenzionale"), ("condannare al pagamento", "attore", "domanda"), ("ammettere CTU", "attore", "istruttoria"), ("altro", "attore", "domanda"),
    ],
)
def test_claim_kind(spark, text, party, kind):
    assert one(spark, text, lambda c: T.claim_kind(c, F.lit(party))) == kind


@pytest.mark.parametrize(("label", "key"), [("Art. 2043 c.c.", "art 2043 c c"), ("  ART 2043  C.C ", "art 2043 c c"), ("Responsabilità  civile", "responsabilita civile"), ("Straße", "strae")])
def test_graph_key(spark, label, key):
    assert one(spark, label, T.graph_key) == key


@pytest.mark.parametrize(
    ("url", "trust"),
    [("https://www.giustizia.it/x", "alta"), ("http://notgiustizia.it", "alta"), ("https://www.altalex.com/a", "media"), ("https://studiorossi.it", "bassa"), ("https://example.org", "media"), ("", "non_indicata"), (None, "non_indicata")],
)
def test_url_trust(spark, url, trust):
    assert one(spark, url, T.url_trust) == trust


def test_snippet(spark):
    text = "a" * 300 + " bersaglio " + "b" * 600
    got = one(spark, text, lambda c: T.snippet(c, F.array(F.lit("bersaglio")), F.array().cast("array<string>")))
    assert got.startswith("...") and got.endswith("...") and "bersaglio" in got and len(got) <= 426
    assert one(spark, " corto  testo ", lambda c: T.snippet(c, F.array(F.lit("x")), F.array().cast("array<string>"))) == "corto testo"


def test_placeholders(spark):
    assert one(spark, "parola[ORG_1]altro ( [ORG_2] [ORG_2] ) .", T.tidy_placeholders) == "parola [ORG_1] altro ([ORG_2])."
    known = F.array(F.lit("[CUSTOM_1]"))
    for token, ok in (("[DA DECIDERE]", True), ("[CUSTOM_1]", True), ("[CUSTOM_2]", False), ("[PERSON_9]", True), ("[Persona_1]", False)):
        assert one(spark, token, lambda c: T.placeholder_valid(c, known)) is ok


def test_json_answers(spark):
    assert one(spark, '<think>x</think> ecco {"a": 1} fine', T.json_object) == '{"a": 1}'
    assert one(spark, "niente", T.json_object) is None
    assert one(spark, '{"in_fatto": "riga\\nuna \\"due', lambda c: T.salvage_field(c, "in_fatto")) == 'riga\nuna "due'
    assert one(spark, '{"in_fatto": "intero"}', lambda c: T.salvage_field(c, "in_fatto")) == "intero"


def test_confidence_and_percent(spark):
    for raw, want in (("0.4", 0.4), ("7", 1.0), ("-1", 0.0), ("boh", 0.65), (None, 0.65)):
        assert one(spark, raw, T.confidence) == want
    assert one(spark, None, lambda c: T.percent(F.lit(1), F.lit(8))) == 12


def test_reference_present(spark):
    assert one(spark, "Art. 2043 c.c.", lambda c: T.reference_present(c, F.lit("ai sensi dell'art. 2043 c.c."))) is True
    assert one(spark, "Art. 1218 c.c.", lambda c: T.reference_present(c, F.lit("ai sensi dell'art. 2043"))) is False
    assert one(spark, "Buona fede", lambda c: T.reference_present(c, F.lit(""))) is True


def test_entity_key_and_ratio(spark):
    assert one(spark, "Società Àlfa S.r.l.", S.entity_key) == "alfa"
    assert one(spark, "abcd", lambda c: S.sequence_ratio(c, F.lit("bcde"))) == 0.75
    got = one(spark, None, lambda c: S.matching_terms(F.array(F.lit("fornitura"), F.lit("saldo"), F.lit("ritardo")), F.array(F.lit("fornitore"), F.lit("saldi"), F.lit("ritardi"))))
    assert got == ["fornitura", "ritardo"]


def test_clean_value(spark):
    assert one(spark, "Intestazione:\n  - Mario   Rossi -\n\n", T.clean_value) == "Mario Rossi"
