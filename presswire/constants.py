"""Fixed values. Results depend on them, so they are stated once, here."""

# --- URL clean-up -----------------------------------------------------------
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ["fbclid", "gclid", "msclkid", "igshid", "mc_cid", "mc_eid"]
MAX_REDIRECT_HOPS = 5
SHORTENER_HOSTS = [
    "t.co", "bit.ly", "buff.ly", "ow.ly", "tinyurl.com", "goo.gl",
    "dlvr.it", "ift.tt", "trib.al", "lnkd.in", "shar.es",
    "feedproxy.google.com",
]
DISCUSSION_PAGE = "https://news.ycombinator.com/item?id="
RELEASE_PAGE = "https://fred.stlouisfed.org/release?rid="

# --- item text --------------------------------------------------------------
BODY_EXCERPT_CHARS = 1200
SUMMARY_SEED_CHARS = 500
EMBED_CHARS = 500
ID_CHARS = 32
SLUG_MAX_CHARS = 60

# --- enrichment -------------------------------------------------------------
ENRICH_MIN_CHARS = 600
ENRICH_MAX_BYTES = 2_000_000
ENRICH_SKIP_HOSTS = ["news.google.com", "blog.pypi.org"]
HTML_CONTENT_TYPES = ["text/html", "application/xhtml+xml"]
MIN_GROUNDING_CHARS = 400

# --- clustering and similarity ----------------------------------------------
CLUSTER_THRESHOLD = 0.82
HEADLINE_REPEAT_THRESHOLD = 0.80
PRIOR_MENTION_DAYS = 30
CONTINUING_COVERAGE_DAYS = 7

# --- topics and sections, in render order -----------------------------------
SECTION_NAMES = {
    "Tech": "Technology",
    "AI": "Artificial intelligence",
    "Business": "Business",
    "Finance": "Finance",
    "US Politics": "US politics",
    "World": "World",
    "Regulation": "Regulation",
    "Science": "Science",
    "Cyber": "Cybersecurity",
    "Sports": "Sports",
}
TOPICS = list(SECTION_NAMES)
SECTION_ORDER = list(SECTION_NAMES.values())
HOUSE_TOPIC = "norm"  # the key-point topic only quiet editions may use, once

MIN_STORIES_PER_SECTION = 2
MAX_STORIES_PER_SECTION = 4
MAX_STORIES = 20
KEY_POINTS = {"normal": (4, 6), "quiet": (3, 3)}
FALLBACK_STORIES = 10
MIN_CLUSTERS_NORMAL = 12
MIN_CLUSTERS_QUIET = 3
SHRINK_HELD = 3
EM_DASH = "—"
QUOTE_MAX_CHARS = 320
RATIONALE_MAX_CHARS = 200
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
SLUG_PATTERN = r"^[a-z0-9]+(-[a-z0-9]+)*$"

# --- prompt blocks ----------------------------------------------------------
EXCERPT_MEMBERS = 6
EXCERPT_CHARS = 700
CANDIDATE_EXCERPT_CHARS = 400
CANDIDATE_MENTION_CHARS = 200
SCORING_EXCERPT_CHARS = 400

# --- readability ------------------------------------------------------------
FK_WORDS = 0.39
FK_SYLLABLES = 11.8
FK_BASE = 15.59
MAX_GRADE = 9.0
SENTENCE_FLAG_GRADE = 12.0

# --- run log ----------------------------------------------------------------
JOBS = ["collector", "silver", "editor", "writer", "audio", "site", "archive"]
STATUSES = ["success", "partial", "failed"]
REASONS = [
    "editor_invalid_fallback", "assembly_fallback", "thin_day_fallback",
    "headline_repeat", "thin_grounding", "article_validation_failed",
    "readability_exceeded", "readability_raised", "adapters_failed",
    "no_items", "null_scores", "no_edition", "audio_missing",
    "write_failed", "run_failed",
]
DEGRADED_REASONS = ["editor_invalid_fallback", "assembly_fallback"]
EASTERN = "America/New_York"
DEADLINE_SECONDS = 6 * 3600  # 06:00:00, inclusive
WINDOW_OPEN_MINUTES = 5 * 60 + 30
SINCE_WINDOW_HOURS = 6
COLLECTOR_STALE_HOURS = 4

# --- prices, USD per million tokens; first matching model-id prefix wins -----
PRICES = [
    ("claude-sonnet-4-5", 3.00, 15.00),
    ("claude-haiku-4-5", 1.00, 5.00),
    ("claude-opus-4", 15.00, 75.00),
]
DEFAULT_PRICE = (3.00, 15.00)
CACHE_WRITE_MULTIPLIER = 1.25
CACHE_READ_MULTIPLIER = 0.10
SPEECH_PRICES = (0.50, 10.00)

# --- audio dialogue ---------------------------------------------------------
SPEAKERS = ["A", "B"]
MIN_TURNS = 4
DIALOGUE_WORDS = (1300, 1600)

# --- waiting list -----------------------------------------------------------
EMAIL_CHARS = (6, 254)
EMAIL_LOCAL_CHARS = 64

# --- per-reader allocation --------------------------------------------------
LENGTH_PRESETS = [5, 8, 11, 16, 20]
TOPUP_FLOOR = 6
TOPUP_MAX_SHARE = 0.5
LOOKBACK_DAILY_HOURS = 36
LOOKBACK_CATCHUP_DAYS = 7
RETENTION_MONTHS = {"stories": 12, "newsletters": 12, "seen": 12, "events": 13}
