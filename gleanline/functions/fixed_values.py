"""Fixed values.

Word lists, lookup tables, constants, patterns and formats that decide results. They are data, not
logic: changing an entry changes what a query returns.
"""

# ---------------------------------------------------------------------------------------------
# Enumerations and ranks
# ---------------------------------------------------------------------------------------------
WORK_MODES = ["on_site", "hybrid", "remote", "unknown"]
CONTRACT_TYPES = [
    "permanent", "fixed_term", "contract", "internship", "apprenticeship", "part_time", "unknown",
]
SENIORITY_RANK = {
    "intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4, "principal": 5, "unknown": -1,
}
SALARY_PERIODS = ["hourly", "daily", "monthly", "yearly"]
ATS_TYPES = [
    "greenhouse", "lever", "ashby", "workable", "recruitee", "smartrecruiters", "workday", "taleo",
    "other", "unknown",
]
DIRECT_ATS = ["greenhouse", "lever", "ashby", "workable"]
DECIDED_STATUSES = ["hidden", "applied"]
WAITING_STATUSES = ["submitted", "acknowledged", "interview"]
TERMINAL_STATUSES = ["rejected", "offer", "withdrawn", "failed"]
TRACKED_STATUSES = [
    "submitted", "acknowledged", "interview", "rejected", "offer", "withdrawn",
]
MEASURED_STATUSES = ["submitted", "acknowledged", "interview", "rejected", "offer"]
REPLIED_STATUSES = ["acknowledged", "interview", "rejected", "offer"]
OPEN_REQUEST_STATUSES = ["pending", "running"]
REPLY_STATUS = {"interview": "interview", "rejection": "rejected", "ack": "acknowledged"}
STATUS_RANK = {"submitted": 0, "acknowledged": 1, "interview": 2, "rejected": 3, "offer": 3}

# ---------------------------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------------------------
DROPPED_TAGS = ["script", "style", "noscript", "nav", "footer", "svg"]
BREAKING_TAGS = ["br", "p", "div", "h1", "h2", "h3", "h4", "tr"]
COMPANY_SUFFIXES = [
    "srl", "s r l", "spa", "s p a", "sas", "snc", "sapa",
    "gmbh", "ag", "ug", "kg", "ohg", "mbh",
    "bv", "nv", "sa", "sarl", "sl", "slu",
    "ltd", "limited", "llc", "inc", "incorporated", "corp", "corporation",
    "plc", "co", "company", "group", "holding", "holdings", "international",
    "italia", "italy", "deutschland", "germany", "europe", "emea",
]
GENDER_SUFFIX_PATTERN = r"\s*[-–|(]?\s*(?:m/w/d|w/m/d|m/f/d|f/m/d|m/f/x|d/f/m|h/f|m/f|m/w)\s*\)?\s*$"
FEED_DOMAIN_PATTERN = r"\.(com|it|de|nl|es|fr|co\.uk|org|io|jobs|careers)$"
FEED_LABELS = {
    "linkedin": "LinkedIn", "indeed": "Indeed", "glassdoor": "Glassdoor", "monster": "Monster",
    "ziprecruiter": "ZipRecruiter", "infojobs": "InfoJobs", "stepstone": "StepStone",
    "welcometothejungle": "Welcome to the Jungle", "adzuna": "Adzuna", "jooble": "Jooble",
    "jsearch": "Google Jobs", "arbeitnow": "Arbeitnow", "remotive": "Remotive",
    "remoteok": "RemoteOK", "greenhouse": "Greenhouse", "lever": "Lever", "ashby": "Ashby",
    "workable": "Workable",
}
ONGOING_WORDS = ["", "presente", "present", "current", "attuale", "oggi", "in corso", "n/a"]
TITLE_STOPWORDS = [
    "senior", "junior", "lead", "staff", "principal", "mid", "level", "entry",
    "and", "or", "the", "di", "de", "der", "und", "con", "per", "in", "at",
]
KEYWORD_SYNONYMS = {
    "software developer": "sviluppatore software",
    "backend developer": "sviluppatore backend",
    "frontend developer": "sviluppatore frontend",
    "fullstack developer": "sviluppatore full stack",
    "mobile developer": "sviluppatore mobile",
    "data engineer": "ingegnere dei dati",
}
UNDECLARED_COMPANY = "Azienda non dichiarata"
OUTPUT_LANGUAGES = ["it", "en", "de", "es", "fr"]
DEFAULT_OUTPUT_LANGUAGE = "en"

# ---------------------------------------------------------------------------------------------
# Rule patterns: order is meaning, the first hit wins
# ---------------------------------------------------------------------------------------------
HYBRID_PATTERN = r"\b(hybrid|ibrid[oa]|misto|part[- ]?remote)\b"
REMOTE_PATTERN = r"\b(remote|remoto|da remoto|smart[- ]working|telelavoro|work from home)\b"
ONSITE_PATTERN = r"\b(on[- ]?site|in sede|in presenza|presso la sede|office[- ]based)\b"
CONTRACT_RULES = [
    ("internship", r"\b(intern|internship|stage|tirocin\w*|praktikum)\b"),
    ("apprenticeship", r"\b(apprendistato|apprenticeship|ausbildung)\b"),
    ("contract", r"\b(freelance|contractor|partita iva|p\.? ?iva|b2b|contract)\b"),
    ("fixed_term", r"\b(fixed[- ]term|temporary|tempo determinato|befristet)\b"),
    ("part_time", r"\b(part[- ]?time|tempo parziale|teilzeit)\b"),
    ("permanent", r"\b(permanent|full[- ]?time|indeterminato|unbefristet|vollzeit)\b"),
]
SENIORITY_RULES = [
    ("intern", r"\b(intern|internship|stage|tirocin\w*|working student|werkstudent)\b"),
    ("principal", r"\b(principal|distinguished|architect|director|vp|head of)\b"),
    ("lead", r"\b(lead|staff|manager|team lead|tech lead|responsabile)\b"),
    ("senior", r"\b(senior|sr\.?|esperto|expert|mid[- ]senior)\b"),
    ("junior", r"\b(junior|jr\.?|entry[- ]level|graduate|neolaureat\w*|trainee)\b"),
    ("mid", r"\b(mid[- ]?level|intermediate|middle)\b"),
]
FAMILY_RULES = [
    ("Machine Learning Engineer", r"\b(machine learning|ml engineer|deep learning|nlp)\b"),
    ("Data Scientist", r"\b(data scientist|scienziat[oa] dei dati|statistician)\b"),
    ("Data Engineer", r"\b(data engineer|etl|data platform|analytics engineer)\b"),
    ("Data Analyst", r"\b(data analyst|business intelligence|bi analyst|analista dati)\b"),
    ("DevOps / SRE", r"\b(devops|sre|site reliability|platform engineer|cloud engineer)\b"),
    ("Security Engineer", r"\b(security|sicurezza informatica|appsec|cybersecurity)\b"),
    ("Mobile Developer", r"\b(mobile|android|ios|flutter|react native)\b"),
    ("Frontend Developer", r"\b(frontend|front[- ]end|react|angular|vue|ui engineer)\b"),
    ("Backend Developer", r"\b(backend|back[- ]end|server[- ]side|api engineer)\b"),
    ("Fullstack Developer", r"\b(full[- ]?stack)\b"),
    ("QA Engineer", r"\b(qa|quality assurance|test engineer|tester)\b"),
    ("Embedded Engineer", r"\b(embedded|firmware|rtos|plc)\b"),
    ("Product Manager", r"\b(product manager|product owner)\b"),
    ("Software Developer", r"\b(software|developer|engineer|sviluppator|programmier)"),
]

# ---------------------------------------------------------------------------------------------
# Places
# ---------------------------------------------------------------------------------------------
COUNTRY_NAMES = {
    "italia": "IT", "italy": "IT", "italie": "IT", "italien": "IT",
    "germania": "DE", "germany": "DE", "deutschland": "DE", "allemagne": "DE",
    "paesi bassi": "NL", "netherlands": "NL", "nederland": "NL", "holland": "NL",
    "spagna": "ES", "spain": "ES", "espana": "ES",
    "francia": "FR", "france": "FR", "frankreich": "FR",
    "regno unito": "GB", "united kingdom": "GB", "uk": "GB", "england": "GB",
    "irlanda": "IE", "ireland": "IE", "portogallo": "PT", "portugal": "PT",
    "austria": "AT", "osterreich": "AT",
    "belgio": "BE", "belgium": "BE", "belgique": "BE",
    "svizzera": "CH", "switzerland": "CH", "schweiz": "CH", "suisse": "CH",
    "polonia": "PL", "poland": "PL", "polska": "PL",
    "svezia": "SE", "sweden": "SE", "danimarca": "DK", "denmark": "DK",
    "norvegia": "NO", "norway": "NO", "finlandia": "FI", "finland": "FI",
    "grecia": "GR", "greece": "GR", "romania": "RO",
    "repubblica ceca": "CZ", "czech republic": "CZ", "czechia": "CZ",
    "ungheria": "HU", "hungary": "HU",
    "stati uniti": "US", "united states": "US", "usa": "US", "u s a": "US",
    "canada": "CA", "india": "IN", "australia": "AU", "brasile": "BR", "brazil": "BR",
}
NON_PLACES = [
    "remote", "remoto", "worldwide", "anywhere", "global", "europe", "emea",
    "eu", "europa", "multiple locations", "various", "n a", "unknown",
    "remote emea", "remote europe", "remote worldwide", "fully remote",
    "latam", "americas", "apac", "united states or canada",
]
DEFAULT_MARKETS = ["IT", "DE", "NL", "ES", "FR", "PT", "IE", "AT", "BE", "PL", "CH", "GB"]
AUTHORISED_STATES = ["citizen", "permanent_resident", "eu_eligible", "visa_holder"]

# ---------------------------------------------------------------------------------------------
# Salaries
# ---------------------------------------------------------------------------------------------
EUR_RATES = {
    "EUR": 1.0, "USD": 0.92, "GBP": 1.17, "CHF": 1.05, "PLN": 0.23, "SEK": 0.088,
    "NOK": 0.086, "DKK": 0.134, "CZK": 0.040, "CAD": 0.68, "AUD": 0.61,
}
HOURS_PER_YEAR = 1720
DAYS_PER_YEAR = 215
MIN_YEARLY = 10_000
MAX_HOURLY = 500
CURRENCY_SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "₣": "CHF"}
CURRENCY_CODE_PATTERN = r"\b(EUR|USD|GBP|CHF|PLN|SEK|NOK|DKK|CZK|CAD|AUD)\b"
AMOUNT_PATTERN = r"\d[\d.,]*\s*[kK]?"
PERIOD_RULES = [
    ("hourly", r"/\s*(?:h|hr|ora|hour)\b|\bhourly\b|\bper hour\b|\ball.ora\b"),
    ("daily", r"/\s*(?:d|day|giorno)\b|\bal giorno\b|\bper day\b|\bdaily\b"),
    ("monthly", r"/\s*(?:m|mese|month)\b|\bal mese\b|\bper month\b|\bmensil"),
    ("yearly", r"/\s*(?:y|yr|anno|year)\b|\bper year\b|\bannual|\bannuo\b|\bRAL\b"),
]
INSTALMENTS_PATTERN = r"\b(?:x\s*)?(1[2-6])\s*(?:ª\s*)?mensilit"
CURRENCY_BY_COUNTRY = {
    "IT": "EUR", "DE": "EUR", "NL": "EUR", "ES": "EUR", "FR": "EUR", "IE": "EUR",
    "PT": "EUR", "AT": "EUR", "BE": "EUR", "GR": "EUR", "FI": "EUR",
    "GB": "GBP", "CH": "CHF", "PL": "PLN", "SE": "SEK", "DK": "DKK", "NO": "NOK",
    "CZ": "CZK", "US": "USD", "CA": "CAD", "AU": "AUD",
}
DISPLAY_SYMBOLS = {"EUR": "€", "GBP": "£", "USD": "$", "CHF": "CHF", "PLN": "zł"}
DISPLAY_PERIODS = {"hourly": "/h", "daily": "/g", "monthly": "/mese", "yearly": ""}

# ---------------------------------------------------------------------------------------------
# Dates
# ---------------------------------------------------------------------------------------------
TIME_UNITS = [
    (["minut", "minuut", "minuto", "minute"], 1 / 1440),
    (["ora", "ore", "hour", "stund", "hora", "heure", "uur", "godzin"], 1 / 24),
    (["giorn", "day", "tag", "dia", "día", "jour", "dag", "dni", "dzie"], 1.0),
    (["settiman", "week", "woche", "semana", "semaine", "weken", "tydz", "tygod"], 7.0),
    (["mes", "month", "monat", "mois", "maand", "miesi"], 30.0),
]
TODAY_WORDS = ["oggi", "today", "heute", "hoy", "aujourd", "vandaag", "hoje", "dzisiaj", "dzis"]
YESTERDAY_WORDS = [
    "ieri", "yesterday", "gestern", "ayer", "hier", "gisteren", "ontem", "wczoraj",
]
ONE_WORDS = ["un", "una", "un'", "a", "an", "einem", "einer", "eine", "uma", "een"]

# ---------------------------------------------------------------------------------------------
# Experience, rubric, ranking
# ---------------------------------------------------------------------------------------------
SENIORITY_MONTHS = [(0, "intern"), (1, "junior"), (30, "mid"), (66, "senior"), (102, "lead")]
RUBRIC_WEIGHTS = {
    "must_have_coverage": 0.40,
    "nice_to_have_coverage": 0.10,
    "seniority_fit": 0.15,
    "domain_fit": 0.10,
    "location_fit": 0.15,
    "salary_fit": 0.10,
}
NEUTRAL_SCORE = 50
SEMANTIC_WEIGHT = 0.6
KEYWORD_WEIGHT = 0.4
TITLE_BOOST = 3
SKILL_WEIGHT = 1.0
ROLE_WEIGHT = 0.6
PROJECT_WEIGHT = 0.5
BM25_K1 = 1.5
BM25_B = 0.75
MAX_NGRAM = 3
TERM_PATTERN = r"[a-z0-9]+(?:[.+#/][a-z0-9]+)*[+#]*"
MAX_HAMMING = 10
MIN_FINGERPRINT_CHARS = 300

# ---------------------------------------------------------------------------------------------
# Numbers in words (Italian and English)
# ---------------------------------------------------------------------------------------------
NUMBER_MULTIPLIERS = {
    "k": 1_000, "mila": 1_000, "mil": 1_000, "thousand": 1_000,
    "m": 1_000_000, "mln": 1_000_000, "milione": 1_000_000, "milioni": 1_000_000,
    "million": 1_000_000, "millions": 1_000_000, "mn": 1_000_000,
}
ITALIAN_UNITS = {
    "zero": 0, "uno": 1, "una": 1, "due": 2, "tre": 3, "quattro": 4, "cinque": 5, "sei": 6,
    "sette": 7, "otto": 8, "nove": 9, "dieci": 10, "undici": 11, "dodici": 12, "tredici": 13,
    "quattordici": 14, "quindici": 15, "sedici": 16, "diciassette": 17, "diciotto": 18,
    "diciannove": 19,
}
ITALIAN_TENS = {
    "venti": 20, "trenta": 30, "quaranta": 40, "cinquanta": 50, "sessanta": 60, "settanta": 70,
    "ottanta": 80, "novanta": 90,
}
ENGLISH_UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
ENGLISH_TENS = {
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90,
}
HUNDREDS = {"cento": 100, "hundred": 100, "mille": 1000}
RATE_WORDS = ["cento", "mille", "cent"]
NUMBER_TOKEN_PATTERN = r"[a-zA-Zàèéìòù]+(?:-[a-zA-Z]+)?|\d[\d.,]*"

# ---------------------------------------------------------------------------------------------
# Extraction quality
# ---------------------------------------------------------------------------------------------
MIN_WORD_INTEGRITY = 0.90
MAX_PLAUSIBLE_WORD = 18
NUMERIC_TOKEN_PATTERN = r"\d(?:[\d.,]*\d)?%?"

# ---------------------------------------------------------------------------------------------
# Feeds, requests, settings
# ---------------------------------------------------------------------------------------------
MAX_EXTERNAL_ID = 300
FEED_PERIODS = {
    "HOUR": "hourly", "DAY": "daily", "WEEK": "monthly", "MONTH": "monthly", "YEAR": "yearly",
}
PREDICTED_FEED_CURRENCIES = {
    "at": "EUR", "be": "EUR", "de": "EUR", "es": "EUR", "fr": "EUR", "it": "EUR", "nl": "EUR",
    "gb": "GBP", "us": "USD", "ca": "CAD", "au": "AUD", "ch": "CHF", "pl": "PLN", "br": "BRL",
    "in": "INR", "mx": "MXN", "nz": "NZD", "sg": "SGD", "za": "ZAR",
}
# Limits that a caller may ask for; nothing is cut by default.
WORK_MODE_CHARS, CONTRACT_CHARS, LANGUAGE_CHARS = 1500, 800, 4000
EMBEDDED_CHARS, PROMPT_CHARS, REPLY_CHARS = 4000, 12_000, 4000
REASON_CHARS, PUBLISHER_CHARS, MAX_KEYWORDS = 200, 120, 6
# Bounds and patterns of list requests.
SCORE_RANGE, PAGE_SIZE_RANGE, PAGE_SIZE = (0, 100), (5, 100), 25
MENU_PUBLISHERS = 12
COUNTRY_CODE_PATTERN, FEED_CODE_PATTERN = "[A-Z]{2}", "[a-z0-9_-]{1,64}"
LIST_ORDERS = ["score", "recent", "salary"]
MAX_LISTED, MAX_PUBLISHER_CHARS = 20, 120
STALE_AFTER_MINUTES = 60
VISIBLE_MINUTES = {"done": 30, "failed": 24 * 60, "cancelled": 30}
FOLLOW_UP_DAYS_RANGE = (3, 60)
