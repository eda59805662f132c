"""Word lists, names and limits that results depend on."""

# --- Fixed values: sources and words used for scoring and routing -----------------

# name, url, priority (1..3), expected articles a day, enabled
SOURCES = [
    ("Tagesschau", "https://www.tagesschau.de/xml/rss2/", 1, 30, True),
    ("Süddeutsche Zeitung", "https://www.sueddeutsche.de/news/rss", 1, 25, True),
    ("Der Spiegel International", "https://www.spiegel.de/international/index.rss", 1, 15, True),
    ("Deutsche Welle World", "https://rss.dw.com/xml/rss-en-world", 1, 25, True),
    ("Handelsblatt Global", "https://www.handelsblatt.com/contentexport/feed/top-themen", 1, 20, True),
]

TRUSTED_SOURCES = [
    "Tagesschau",
    "Süddeutsche Zeitung",
    "Der Spiegel International",
    "Deutsche Welle World",
    "Handelsblatt Global",
    "Reuters",
    "BBC",
    "AP",
    "Guardian",
]

GERMAN_SOURCES = ["Tagesschau", "Süddeutsche Zeitung"]

SPAM_PHRASES = [
    "click here",
    "buy now",
    "limited offer",
    "act now",
    "free gift",
    "winner",
    "claim your",
    "unsubscribe",
]

TOPIC_WORDS = [
    "climate",
    "economy",
    "technology",
    "science",
    "policy",
    "election",
    "research",
    "energy",
    "innovation",
    "international",
    "trade",
    "education",
    "health",
]

# --- Fixed values: glossary terms that stay in English ---------------------------

PROPER_NOUNS = [
    "Germany", "United States", "USA", "Russia", "Ukraine", "Morocco", "Canada", "Egypt", "Argentina",
    "NATO", "UN", "EU", "European Union", "AfD", "NASA", "WHO",
    "Condor", "Google", "Microsoft", "Apple", "Tesla",
    "Trump", "Biden", "Putin", "Zelenskyy", "Selenskyj", "Chrupalla", "Nagelsmann", "Klopp",
]
TECHNICAL_TERMS = ["GDP", "API", "AI", "CEO", "COVID-19", "NATO", "IMF", "World Bank"]
SPORTS_TERMS = ["World Cup", "FIFA", "Olympics", "Champions League"]

# --- Fixed values: enumerations, limits and defaults -------------------------------

LANGUAGES = {
    "en": "English",
    "or": "Odia",
    "hi": "Hindi",
    "bn": "Bengali",
    "te": "Telugu",
    "kn": "Kannada",
    "ta": "Tamil",
}
SOURCE_TYPES = ["rss", "api"]
PUBLISH_STATUSES = ["pending", "sent", "failed"]
OPERATIONS = ["summarize", "translate"]

SUMMARY_WORDS = {"summary_30": 30, "summary_111": 111, "summary_250": 250}
SUMMARY_MAX_CHARS = {"summary_30": 300, "summary_111": 1000, "summary_250": 2500}
LENGTH_TOLERANCE_WORDS = 5

MIN_QUALITY = 0.7
TOP_STORIES = 5
STORIES_PER_PUBLICATION = 5
ARTICLE_RETENTION_DAYS = 7
BRIEF_RETENTION_DAYS = 30
PLACEHOLDER_QUALITY = 0.8
DEFAULT_CATEGORY = "General"
BRIEF_FEED_SOURCE = "Global News"
RAW_FEED_CATEGORY = "world"
RAW_FEED_NOTE = "Displaying raw articles (briefs not yet processed)"
TITLE_CHARS = 100
