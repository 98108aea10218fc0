"""The word lists, tables and phrases that results depend on. Nothing here is computed."""

# Words that keyword search leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on",
    "that", "the", "to", "was", "were", "will", "with", "this", "but", "they", "have", "had", "what", "when", "where",
    "who", "which", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "just", "should", "now", "i", "you", "your",
    "we", "our", "my", "me", "him", "her", "them", "their",
)

# Words that are no topics.
TOPIC_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those", "i", "you", "he", "she",
    "it", "we", "they", "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "just", "but", "and", "or", "if", "then", "else", "for", "of", "to", "from", "by", "on", "at", "in", "out", "up",
    "down", "with", "about", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again",
    "further", "once", "here", "there", "any", "hi", "hello", "thanks", "thank", "please", "yes", "ok",
)

# Words that do not count when events are compared.
EVENT_STOPWORDS = ("the", "a", "an", "is", "was", "were", "are", "been", "be", "to")

# Capitalised words that are no names.
NOT_NAMES = ("i", "the", "a", "an", "my", "your")

# Types of entities, facts, events and relations.
ENTITY_TYPES = ("person", "organization", "location", "project", "concept", "event", "product", "time", "quantity", "other")
FACT_TYPES = ("attribute", "relation", "action", "state", "preference", "belief", "intention", "experience", "possession", "membership", "other")
INVERSE_RELATIONS = {
    "before": "after", "after": "before", "causes": "caused_by", "caused_by": "causes", "entails": "entails",
    "elaborates": "summarizes", "summarizes": "elaborates",
}
RELATION_FAMILIES = {
    "temporal": ("before", "after", "during", "simultaneous"),
    "causal": ("causes", "caused_by", "enables", "prevents"),
    "logical": ("entails", "contradicts", "supports", "refutes"),
    "semantic": ("elaborates", "summarizes", "equivalent", "similar"),
}
RELATED_EVENTS = (("question", "answer"), ("error", "resolution"), ("request", "completion"), ("action", "state_change"))

# Importance of types.
ENTITY_WEIGHTS = {
    "person": 1.0, "organization": 0.9, "project": 0.85, "concept": 0.7, "location": 0.6, "product": 0.7, "event": 0.65,
    "time": 0.4, "quantity": 0.3, "other": 0.5,
}
FACT_WEIGHTS = {
    "attribute": 0.8, "relation": 0.85, "action": 0.7, "state": 0.6, "preference": 0.9, "belief": 0.85, "intention": 0.8,
    "experience": 0.75, "possession": 0.6, "membership": 0.7, "other": 0.5,
}
EVENT_WEIGHTS = {
    "action": 0.7, "state_change": 0.6, "decision": 0.9, "discovery": 0.85, "error": 0.7, "resolution": 0.95,
    "question": 0.5, "answer": 0.6, "request": 0.65, "completion": 0.8, "other": 0.5,
}

# Predicates that have one object at a time, those that contradict, those that conflict between memories.
FUNCTIONAL_PREDICATES = ("is", "has name", "lives in", "works at", "is located in", "has status", "has state")
CONTRADICTING_PREDICATES = ("is", "has name", "was born in", "lives in")
UNIQUE_PREDICATES = ("is", "has age", "was born", "lives in", "works at", "is married to", "has job", "has name", "is called")

# Groups of predicates that mean the same.
PREDICATE_SYNONYMS = (
    ("is", "are", "was", "were", "be"),
    ("works at", "works for", "employed at", "employed by"),
    ("likes", "enjoys", "loves", "prefers"),
    ("has", "owns", "possesses"),
    ("lives in", "resides in", "located in"),
)

# Ranges of scripts, the languages of scripts, words that mark a language.
SCRIPT_RANGES = {
    "latin": (0x0000, 0x024F), "cyrillic": (0x0400, 0x04FF), "arabic": (0x0600, 0x06FF), "devanagari": (0x0900, 0x097F),
    "thai": (0x0E00, 0x0E7F), "cjk": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF), "hiragana": (0x3040, 0x309F),
    "katakana": (0x30A0, 0x30FF),
}
SCRIPT_LANGUAGES = {
    "cyrillic": "ru", "arabic": "ar", "devanagari": "hi", "thai": "th", "cjk": "zh", "hangul": "ko", "hiragana": "ja", "katakana": "ja",
}
LANGUAGE_MARKERS = {
    "en": ("the", "is", "are", "and", "to", "of", "in", "that", "it", "for"),
    "es": ("el", "la", "de", "que", "en", "es", "los", "las", "del", "un"),
    "fr": ("le", "la", "de", "et", "les", "des", "en", "un", "une", "que"),
    "de": ("der", "die", "und", "in", "den", "von", "das", "ist", "zu", "mit"),
    "pt": ("de", "que", "em", "para", "com", "uma", "os", "da", "do", "ao"),
    "it": ("di", "che", "il", "la", "per", "un", "una", "con", "del", "della"),
    "nl": ("de", "het", "een", "en", "van", "in", "is", "dat", "op", "te"),
    "zh": ("的", "是", "在", "了", "和", "我", "有", "他", "这", "为"),
    "ja": ("の", "は", "が", "を", "に", "で", "と", "です", "ます", "た"),
    "ko": ("을", "를", "이", "가", "의", "에", "는", "은", "다", "고"),
}
LANGUAGES = ("en", "zh", "es", "fr", "de", "ja", "ko", "ru", "ar", "pt", "it", "nl", "hi", "th", "vi")

# Hiragana in Latin letters.
HIRAGANA = {
    "あ": "a", "い": "i", "う": "u", "え": "e", "お": "o", "か": "ka", "き": "ki", "く": "ku", "け": "ke", "こ": "ko",
    "さ": "sa", "し": "shi", "す": "su", "せ": "se", "そ": "so", "た": "ta", "ち": "chi", "つ": "tsu", "て": "te", "と": "to",
    "な": "na", "に": "ni", "ぬ": "nu", "ね": "ne", "の": "no", "は": "ha", "ひ": "hi", "ふ": "fu", "へ": "he", "ほ": "ho",
    "ま": "ma", "み": "mi", "む": "mu", "め": "me", "も": "mo", "や": "ya", "ゆ": "yu", "よ": "yo",
    "ら": "ra", "り": "ri", "る": "ru", "れ": "re", "ろ": "ro", "わ": "wa", "を": "wo", "ん": "n",
}

# Names of one place in several languages, and the name they stand for.
CROSS_LINGUAL_NAMES = {
    "北京": "beijing", "ペキン": "beijing", "베이징": "beijing", "上海": "shanghai", "シャンハイ": "shanghai",
    "東京": "tokyo", "东京": "tokyo", "巴黎": "paris", "パリ": "paris", "中国": "china", "中國": "china",
    "日本": "japan", "美国": "america", "アメリカ": "america",
}

# Words that tell what a query asks for, in the order they are tried.
QUERY_WORDS = (
    ("person", ("who", "name", "person")), ("temporal", ("when", "date", "time")),
    ("location", ("where", "location", "place")), ("factual", ("what", "how", "why")),
)

# Headers of rendered contexts.
STRUCTURED_HEADERS = {"entity": "Key People and Things", "fact": "Important Facts", "event": "Events", "summary": "Summary"}
MARKDOWN_HEADERS = {"entity": "### Key Entities", "fact": "### Facts", "event": "### Events", "summary": "### Summary"}
