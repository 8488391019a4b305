"""Lists, patterns, thresholds and wordings that results depend on.

Everything here is data, kept in one place; the logic that uses it lives in
``functions`` and ``operators``.
"""

# --- Words ------------------------------------------------------------------

# Application stop list: words dropped from queries and from document tokens.
STOP_WORDS = (
    "a au aux avec ce ces c cette dans de des du d en et est faire fait il ils elle elles je la le les l leur "
    "lui mais me mes mon ne nos nous on ou par pas pour pourquoi qu que quel quelle quels quelles qui quoi sa se "
    "ses son sont sur t ta te tes tout tous tu un une vos votre vous y plus comme comment peut peux peuvent etre "
    "avoir ai information informations dit dire sait savoir pouvez concernant question reponse merci moi donne donner"
).split()

# Stop list of the index: the usual French list without its accented entries
# (the index is built on accent-free text).
INDEX_STOP_WORDS = (
    "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me mes moi mon ne nos notre "
    "nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous suis es est "
    "sommes sont serai seras sera serons serez seront serais serait serions seriez seraient fus fut furent sois "
    "soit soyons soyez soient fusse fusses fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai "
    "as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait "
    "avions aviez avaient eut eurent aie aies ait ayons ayez aient eusse eusses eussions eussiez eussent"
).split()

# Words too general to be searched for.
QUERY_GENERIC_WORDS = "mesure action prevu prevoit realisee effectivement informe".split()

# Words that do not show a hit is about the query (relevance filter).
FILTER_GENERIC_WORDS = (
    "mesure action prevu prevoit realisee effectivement informe selon ministerielle ministre deputee proposition "
    "reprendre sans ete ont cas forte fort"
).split()

# Query expansion: pattern looked for in the folded query, words added to it.
SYNONYM_RULES = (
    (r"\b(chaud|chaleurs?|canicule)\b", " chaleur canicule climatisation conditionné"),
    (r"\b(bus|trams?|metros?)\b", " STIB transports"),
    (r"\b(voter?|elections?)\b", " élections électoral inscription"),
)

MAX_QUERY_TERMS = 40
MAX_QUERY_CHARS = 2500

# --- Accent folding ---------------------------------------------------------

ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"
LIGATURES = (("œ", "oe"), ("æ", "ae"))

WORD_PATTERN = "[a-z0-9]{2,}"
DOTTED_WORD_PATTERN = "([a-z0-9])[.@](?=[a-z0-9])"
PATH_PATTERN = "/?[a-z0-9]+(?:/[a-z0-9]+)+|/[a-z0-9]+"

# --- Passages ---------------------------------------------------------------

SECTIONS = ("question", "reponse")
PASSAGE_CHARS = 2200
INDEX_FORMAT = "passages-1"
EMBEDDING_DIMENSIONS = 1536
NO_EMBEDDINGS = "sans-embeddings"

# --- Ranking ----------------------------------------------------------------

TITLE_WEIGHT = 3
RRF_OFFSET = 60
SIMILARITY_THRESHOLD = 0.35
RELEVANCE_SHARE = 0.6
MAX_RESULTS = 8
DEFAULT_RESULTS = 6
PASSAGES_PER_RECORD = 2
LINEAR_LEXICAL_WEIGHT = 3
# Rank given to one occurrence of a query word by the earlier linear ranker.
OCCURRENCE_WEIGHT = 0.1
SCORE_TIE_DECIMALS = 9

# --- Record rules -----------------------------------------------------------

NATURE_INCOMPETENCE = (
    "aucune des questions ne relève|ne relève(?:nt)? pas de (?:ma|la) compétence"
    "|adresser toutes vos questions à ma collègue"
)
NATURE_REFERRAL = "renvoie|réponse à la question"
NATURE_REFERRAL_CHARS = 600
NATURES = ("fond", "incompetence", "renvoi", "absente")
TITLE_PREFIX = "Question écrite concernant "
DEFAULT_LEGISLATURE = "2024-2029"
RECORD_LANGUAGE = "fr"
UNDATED_LABEL = "date non renseignée"
FRENCH_MONTHS = (
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
).split()

# --- Query input and conversations ------------------------------------------

MIN_QUESTION_CHARS = 3
MAX_QUESTION_CHARS = 1500
MAX_HISTORY = 4
FOLLOWUP_MAX_TOKENS = 5
NEW_TOPIC_PATTERN = r"\b(concernant|au sujet de|a propos de|sur le sujet de)\b"
SHORT_FOLLOWUP_PATTERN = r"^(et\b|pourquoi\b|combien\b|quand\b|cela\b|ca\b|ceux\b|celles\b)"
SOURCE_FOLLOWUP_PATTERN = (
    r"\b(selon|dans|d'apres) la reponse (ministerielle|du ministre|de la ministre|de la secretaire)\b"
    r"|\b(sans reprendre|sans inclure) les propositions\b"
    r"|\b(ces|lesdites) (actions|mesures|propositions)\b"
)

# --- Answers ----------------------------------------------------------------

EXTRACT_HITS = 3
EXCERPT_CHARS = 700
PIECE_CHARS = 250
CONTEXT_LIMIT = 12
CONTEXT_ROUNDS = 3
CONTEXT_BEST_RECORDS = 3
MAX_PARAGRAPHS = 8
MAX_PARAGRAPH_CHARS = 5000
ANSWER_MODES = ("extraits", "ia")
ANSWER_STATUSES = ("documente", "insuffisant")
INSUFFICIENT_TEXT = (
    "Je n’ai pas trouvé d’information suffisamment pertinente sur ce sujet dans le corpus de l’application. "
    "Cela ne signifie pas que le Parlement n’a pas traité ce sujet."
)
INSUFFICIENT_NOTICE = (
    "Le corpus disponible est limité ; cette recherche ne couvre pas toutes les publications du Parlement."
)
EXTRACT_NOTICE = (
    "Voici des extraits exacts des réponses parlementaires. Ils décrivent les informations publiées à leur date, "
    "pas nécessairement la situation actuelle."
)
GENERATED_NOTICE = "Synthèse assistée par IA. Consultez les sources et leurs dates."
INCOMPETENCE_TEXT = (
    "La réponse du %s indique une absence de compétence du destinataire. Elle n’apporte pas de réponse sur le fond."
)
PASSAGE_TEXT = "Passage de la réponse du %s :"
PASSAGES_TEXT = "Passages de la réponse du %s :"

# --- Refresh ----------------------------------------------------------------

UNANSWERED_DAYS = 240
RECENT_ANSWER_DAYS = 14
ROTATION_WEEKS = 4
# Days between 0001-01-01 (day 1) and 1970-01-01.
EPOCH_ORDINAL = 719163
CONSECUTIVE_FAILURES = 3
MAX_RECORDS = 15000
MAX_DOWNLOADS = 900
MAX_NETWORK_FAILURES = 10
MAX_EMPTY_TEXTS = 10
MAX_MISSING_FROM_INDEX = 30
MAX_ADDITIONS = 800
METHOD_SENTENCE_PATTERN = r"Législature (\d{4}-\d{4}) : [^.]*\."
METHOD_OPENING = "Questions écrites PRB. "
METHOD_CLOSING = (
    " Les fiches dont le texte de question n’est pas encore publié sont écartées. Français uniquement ; sans "
    "garantie d’exhaustivité."
)
WRITTEN_QUESTION_ASSEMBLY = "PRB"
WRITTEN_QUESTION_TYPE = "1"

# --- Fields of a record (fixed values: names and what each must hold) --------

RECORD_FIELDS = (
    ("id", "non-empty text"),
    ("moncode", "digits"),
    ("base", "integer"),
    ("assemblee", "text"),
    ("legislature", "text"),
    ("session", "text or null"),
    ("type", "text"),
    ("numero", "integer or null"),
    ("langue", "language"),
    ("titre", "non-empty text"),
    ("titre_nl", "text or missing"),
    ("auteur", "text"),
    ("destinataire", "text"),
    ("date_reception", "date"),
    ("date_publication", "date or null"),
    ("date_reponse", "date or null"),
    ("question", "non-empty text"),
    ("reponse", "text or null"),
    ("url_source", "url"),
)
LARGEST_INTEGER = 9007199254740991

# --- Import and retention ---------------------------------------------------

BATCH_MAX_INPUTS = 256
BATCH_MAX_BYTES = 200_000
BUDGET_MAX_CALLS = 25
BUDGET_MAX_BYTES = 250_000

# --- Quotas -----------------------------------------------------------------

SESSION_HOURLY_LIMIT = 20
SESSION_HOURLY_MAX = 100
IP_HOURLY_LIMIT = 100
DAILY_AI_LIMIT = 100
DAILY_AI_MAX = 10000
IP_DAILY_AI_LIMIT = 10
IP_DAILY_AI_MAX = 1000

# --- Evaluation -------------------------------------------------------------

DEFAULT_MAX_RANK = 3
SCORE_DECIMALS = 6
OFF_TOPIC = "hors_sujet"
REASON_OFF_TOPIC_RESULTS = "résultats pour une question hors corpus"
REASON_EXPECTED_MISSING = "fiche attendue absente"
REASON_OFF_TOPIC_SHOWN = "sources affichées pour une question hors corpus"
REASON_NOT_SHOWN = "fiche attendue retrouvée mais non affichée"
