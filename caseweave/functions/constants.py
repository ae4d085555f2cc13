"""Word lists, patterns and thresholds that results depend on."""

# Relevance stop words.
RELEVANCE_STOP = ("chiede", "domanda", "parte", "attore", "convenuto", "rigetto", "accertare", "contratto", "euro")

# Tokens that never count as a leak.
STOP_TOKENS = (
    "alla", "alle", "allo", "art", "appalto", "atto", "atti", "audit", "avv", "causa", "civile", "cod", "codice",
    "complesso", "comparsa", "conclusionale", "condominio", "contro", "convenuto", "convenuta", "citazione", "del",
    "dell", "della", "delle", "dello", "euro", "fattura", "fascicolo", "gennaio", "febbraio", "marzo", "aprile",
    "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre", "pec", "penale", "presso",
    "registro", "ricorso", "sentenza", "sig", "sigra", "societa", "srl", "spa", "tribunale", "truffa", "ufficio", "via",
    "viale",
)

# Phrases that never count as unknown personal data.
STOP_PHRASES = (
    "corte appello", "codice civile", "codice procedura", "comparsa costituzione", "in diritto", "in fatto", "p q m",
    "registro generale", "repubblica italiana", "tribunale ordinario", "ufficio processo",
)

# Placeholder groups known without a map; groups whose single words are masked; groups matched loosely.
PLACEHOLDER_GROUPS = (
    "ADDRESS", "DATE", "EMAIL", "GPE", "IBAN", "LOCATION", "LOC", "MONEY", "ORG", "ORGANIZATION", "ORGANIZZAZIONE",
    "PERSON", "PHONE", "PHONE_NUMBER", "PRIVATE_ADDRESS", "PRIVATE_DATE", "PRIVATE_PERSON", "TAX_CODE", "VAT",
)
WORD_GROUPS = ("PERSON", "PRIVATE_PERSON", "ORG", "ORGANIZATION", "ORGANIZZAZIONE")
LOOSE_GROUPS = ("ORG", "ORGANIZATION", "PERSON", "PRIVATE_PERSON")
ADDRESS_GROUPS, DATE_GROUPS = ("PRIVATE_ADDRESS", "ADDRESS"), ("PRIVATE_DATE", "DATE")
ORG_CUES = ("associazione", "azienda", "condominio", "cooperativa", "ditta", "ente", "fondazione", "impresa", "istituto", "societa", "srl", "spa", "snc", "sas")
STREET_WORDS = ("via", "viale", "piazza", "corso", "largo")

# Patterns, as Java and Python both read them.
PLACEHOLDER = r"\[[A-Z_]+_\d+\]"
BRACKETED = r"\[[^\]\n]{3,}\]"
NUMBER = r"(?:€\s*)?\b\d{1,3}(?:[.\s]\d{3})+(?:,\d+)?\b|\b\d+/\d{2,4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
WORD = r"[\wÀ-ÖØ-öø-ÿ']+"
SENTENCE_END = r"\n{2,}|(?<=[.;:!?])\s+(?=(?:\[[A-Z_]+_\d+\]|[A-ZÀ-Ö]))"
COMPANY_SUFFIX = r"\b(s\.?\s*r\.?\s*l\.?|s\.?\s*p\.?\s*a\.?|s\.?\s*n\.?\s*c\.?|s\.?\s*a\.?\s*s\.?|societa|societa'|cooperativa|coop|impresa|ditta)\b"
# Forms that need no map: allowed markers, and placeholders of a known group.
KNOWN_FORM = rf"\[DA DECIDERE\]|\[(?:{'|'.join(PLACEHOLDER_GROUPS)})_\d+\]"
# Spacing around placeholders, rule after rule; $1 is the first group.
SPACING = (
    (rf"(?<=[\wÀ-ÖØ-öø-ÿ])({PLACEHOLDER})", " $1"), (rf"(?<=[.;:!?])(?={PLACEHOLDER})", " "), (rf"({PLACEHOLDER})(?=[\wÀ-ÖØ-öø-ÿ])", "$1 "),
    (rf"({PLACEHOLDER})(?={PLACEHOLDER})", "$1 "), (rf"({PLACEHOLDER})(?:\s+\1)+", "$1"), (r"\s+([,.;:!?])", "$1"), (r"([(\[])\s+", "$1"), (r"\s+([)\]])", "$1"), (r"[ \t]{2,}", " "),
)
PII = {
    "CODICE_FISCALE": r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "PARTITA_IVA": r"\b\d{11}\b",
    "ORGANIZZAZIONE": r"\b[A-ZÀ-Ù][\wÀ-ù'&.\-]*(?:\s+[A-ZÀ-Ù][\wÀ-ù'&.\-]*){0,3}?\s+(?:S\.?r\.?l\.?s?|S\.?p\.?[Aa]|S\.?n\.?c|S\.?a\.?s|S\.?c\.?[Aa]\.?r\.?l)\.?",
}
ROLE_NAME = r"\b(?:avv|ing|geom|dott|dott\.ssa|ctu|ctp|perito|teste|sig|sig\.ra)\.?\s+([A-ZÀ-Ö][a-zà-öø-ÿ']{3,})\b"
COMPANY_NAME = r"(?i)\b([A-ZÀ-Ö][\wÀ-ÖØ-öø-ÿ'&-]*(?:\s+[A-ZÀ-Ö][\wÀ-ÖØ-öø-ÿ'&-]*){0,5}\s+(?:S\.?\s*r\.?\s*l\.?|S\.?\s*p\.?\s*A\.?|S\.?\s*n\.?\s*c\.?|S\.?\s*a\.?\s*s\.?|Società|Cooperativa|Impresa|Ditta))\b"
# What every match of COMPANY_NAME ends with.
COMPANY_END = r"(?i)\s" + COMPANY_NAME[COMPANY_NAME.index("(?:S\\.?") :].removesuffix(r")\b") + r"\b"
CAPITALISED_RUN = r"\b([A-ZÀ-Ö][a-zà-öø-ÿ']{2,}(?:\s+[A-ZÀ-Ö][a-zà-öø-ÿ']{2,}){1,3})\b"
CAPITALISED = r"\b[A-ZÀ-Ö][\wÀ-ÖØ-öø-ÿ']{3,}\b"
LEGAL_REFERENCE = r"\bart\.?\b|c\.?c\.?|c\.?p\.?c\.?|cost"
CONCLUSIONS = r"(?is)conclusioni\s+(?:dell['’]attrice|dell['’]attore|attrice|attore|del\s+convenuto|convenuto)\s*:\s*(.*?)(?=\n\s*###|\Z)"

# Cue stems of the cascades; the first that holds decides.
CLAIM_COUNTER = ("riconvenzional",)
CLAIM_DEFENCE = ("rigett", "eccepis", "eccezion", "contest", "inammiss", "improced", "resping")
CLAIM_BY_DEFENDANT = ("condann", "risarc", "costi di ripristino", "ripristino")
CLAIM_DEMAND = ("penale", "condann", "pagamento", "risarc", "accert", "applicare")
CLAIM_EVIDENCE = ("ctu", "testimon", "prova", "esibizion", "interrogatorio")
UNDISPUTED = ("non contest", "pacific", "concord", "ammess", "riconosciut")
SOURCE_KINDS = (
    ("norma", ("normattiva", "gazzettaufficiale", "art.", "codice", "d.lgs", "legge")),
    ("giurisprudenza", ("cassazione", "tribunale", "corte", "sentenza", "ordinanza")),
    ("massima", ("massima", "principio di diritto")),
    ("dottrina", ("rivista", "commento", "dottrina", "autore")),
)
CASE_TAGS = (
    ("appalto", "appalto"), ("condomin", "condominio"), ("locazion", "locazione"), ("responsabil", "responsabilità"),
    ("inademp", "inadempimento"), ("risoluzion", "risoluzione"), ("pagamento", "pagamento"),
)
INSTITUTIONAL_HOSTS = ("cortedicassazione.it", "cortecostituzionale.it", "giustizia.it", "gazzettaufficiale.it", "normattiva.it", "eur-lex.europa.eu")
EDITORIAL_HOSTS = ("altalex.com", "brocardi.it", "dejure.it", "ilcaso.it", "ius.giuffrefl.it", "onelegale.wolterskluwer.com", "pluris-cedam.utetgiuridica.it")
EDGE_KINDS = ("cita", "correlato", "in_contrasto", "applica")
TRANSITIONS = (
    ("bozza_in_corso", "analizzato"), ("analizzato", "bozza_generata"), ("analizzato", "bozza_in_corso"),
    ("bozza_generata", "in_revisione"), ("bozza_generata", "analizzato"), ("in_revisione", "completato"),
    ("in_revisione", "bozza_generata"),
)

# Thresholds.
REPAIR_RATIO, NEEDLE_CHARS, STREET_CHARS = 0.78, 4, 32
CHUNK_CHARS, CONTEXT_CHARS, CASE_CHARS, SNIPPET_CHARS = 800, 16_000, 8_000, 420
WINDOW_WORDS, WINDOW_STEP = 90, 70
TRACE_KEEP, WEAK_SCORE, STRONG, USEFUL = 0.18, 0.45, 0.68, 0.38
NEAR, USABLE = 0.28, 0.38
LOW_CONFIDENCE, DEFAULT_CONFIDENCE = 0.55, 0.65
BLOCK_COST, WARNING_COST = 12, 4

# Words of a passage that speak for a claim of a kind.
CUES = {"istruttoria": ("ctu", "testimon", "prova"), "riconvenzionale": ("riconvenzional",)}

# Events of the editor; lengths of a dashboard's lists.
EDITOR_EVENTS = ("bozza_aggiornata", "motivazione_aggiornata")
DASHBOARD = {"placeholders": 12, "claims": 12, "gaps": 10, "risks": 8, "actions": 8}
# Marks of a generated operative part; openings of search leads and what pasted ones open with; signs of a lost model server.
SKELETON_MARKS = ("Convenuto/ricorrente", "[DA DECIDERE]", "Spese di lite:", "Il Giudice, ogni diversa domanda")
SEARCH_OPENINGS = ("La ricerca web suggerisce", "La ricerca suggerisce", "Dalla ricerca web emerge", "Dalla ricerca emerge")
PASTED_OPENING = "Dai risultati incollati emerge"
UNREACHABLE = ("host.docker.internal", "11434", "network is unreachable", "connection refused", "connecterror")
# Sentences of a reasoning that no model wrote.
FALLBACK_START = ("La richiesta di parte ", " riguarda: ")
FALLBACK_MIDDLE = {
    "istruttoria": " La valutazione deve concentrarsi su rilevanza, ammissibilita' e utilita' del mezzo istruttorio rispetto ai fatti controversi.",
    "difesa_eccezione": " La decisione richiede di verificare se le contestazioni e le eccezioni risultano specifiche e supportate dagli atti.",
    "": " La decisione richiede di verificare prova del fatto costitutivo, eventuali fatti impeditivi o estintivi e coerenza degli importi indicati.",
}
FALLBACK_END = " Restano da sciogliere i quesiti aperti indicati nella scheda."
UNCONTESTED_DOUBT = "Verifica se il fatto è davvero non contestato: "
# Actions on a fact; what an action writes where it brings no text of its own; a matrix row's first question.
FACT_ACTIONS = ("segna_insufficiente", "segna_da_verificare", "crea_quesito")
COMMENT_TEXTS = {
    "integra_motivazione": "Integrare la motivazione prima dell'export.",
    "compila_pqm": "Compilare o riallineare il P.Q.M. rispetto alle motivazioni.",
    "chiedi_ctu": "Valutare se formulare un quesito tecnico/CTU sui fatti controversi.",
    "verifica_fonti": "Verificare manualmente pertinenza e affidabilita' degli snippet.",
    "cerca_fascicolo": "Cercare nel fascicolo una fonte interna non ancora agganciata.",
}
QUESTION_TEXT = "Verificare manualmente se la richiesta e' sorretta da fonti interne sufficienti."
INSUFFICIENT_NOTE = "Marcata insufficiente dalla revisione guidata: mancano fonti interne adeguate."
FIRST_QUESTION = "Quali fatti costitutivi/impeditivi e quali prove sorreggono questa richiesta?"
# Labels of a lead's source, and why it is as reliable as it is.
LEAD_LABELS = {
    "insufficiente": "Ricerca insufficiente", "manuale": "Materiale manuale da verificare", "non_indicata": "Fonte non indicata", "istituzionale": "Fonte istituzionale",
    "editoriale": "Banca dati o rivista giuridica", "bassa": "Fonte da verificare con cautela", "media": "Fonte da verificare",
}
LEAD_REASONS = {
    "insufficiente": "La ricerca non ha restituito fonti sufficientemente verificabili.",
    "alta": "Fonte istituzionale o primaria: usare comunque previa verifica del testo vigente.",
    "media": "Fonte utile per orientarsi, da confrontare con norma o provvedimento originale.",
    "bassa": "Fonte potenzialmente fragile: non citarla senza riscontro autonomo.",
    "": "Fonte non indicata: trattala come appunto interno, non come citazione.",
}
# Headers of documents in a composed context, and the longest change log.
SECTION_LABELS = {"generici": "DOCUMENTI GENERICI", "attore": "FASCICOLO DELL'ATTORE", "convenuto": "FASCICOLO DEL CONVENUTO/RICORRENTE"}
CHANGE_LOG = 100
