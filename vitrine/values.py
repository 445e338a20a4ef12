"""They must equal what the stored data and its readers already use."""

# Media file extensions.
MEDIA_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif"]
POST_EXTENSIONS = [".jpg", ".png", ".gif", ".tiff", ".jpeg"]
POST_EXTENSIONS_WEBP = [".jpg", ".png", ".gif", ".tiff", ".jpeg", ".webp"]

# Item providers, the ranking label of each and the zone of its calendar dates.
PROVIDERS = ["pixiv", "danbooru", "gelbooru"]
ZONE = "Asia/Tokyo"

# Life cycle of an item.
PENDING, INFERRED, ERROR, DEDUPED = "pending", "inferred", "error", "deduped"

# Paths a caller may sort by.
INFERENCE_PATH = r"inferences\.[a-z0-9_-]+\.(score|not_bookmarked|bookmarked_public|bookmarked_private)"
TAG_PROB_PATH = r"importantTagProbs\.(deepdanbooru|pixai)\.[a-z0-9_()\[\] ]+"

# Columns never shown to callers.
PRIVATE_COLUMNS = ["localPath", "topTagProbs"]

# Page sizes.
PAGE_SIZE, PAGE_SIZE_MAX, TOP_ITEMS, SIMILAR_MAX = 50, 200, 30, 100

# Page URL templates, %s is the post id.
PAGE_URLS = {
    "pixiv": "https://www.pixiv.net/artworks/%s",
    "sankaku": "https://chan.sankakucomplex.com/ja/posts/%s",
    "twitter": "https://twitter.com/i/web/status/%s",
    "danbooru": "https://danbooru.donmai.us/posts/%s",
    "gelbooru": "https://gelbooru.com/index.php?page=post&s=view&id=%s",
}

# Rating codes of each provider and how they are labelled.
RATING_LABELS = {
    "danbooru": {"g": "General", "s": "Sensitive", "q": "Questionable", "e": "Explicit"},
    "gelbooru": {
        "general": "General",
        "sensitive": "Sensitive",
        "questionable": "Questionable",
        "explicit": "Explicit",
    },
    "sankaku": {"s": "Safe", "q": "Questionable", "e": "Explicit"},
}

# Upper bound and name of each rating band; the last has no bound.
RATING_BANDS = [(2, "Safe"), (4, "Slightly Suggestive"), (6, "Sensitive"), (8, "Adult"), (None, "Explicit")]

# Lower bound and colour of each score band; the last has no bound.
SCORE_BANDS = [(0.8, "purple"), (0.6, "blue"), (0.4, "green"), (0.2, "yellow"), (None, "gray")]

# Upper bound and colour of each rank band.
RANK_BANDS = [(0.2, "purple"), (0.4, "blue"), (0.6, "green"), (0.8, "yellow"), (None, "gray")]
RANK_POWER = 15
BUSY_DAY = 10000

# Sort presets, name to (path, direction).
SORT_PRESETS = {
    "joycaption-desc": ("moderations.joycaption.result", "desc"),
    "joycaption-asc": ("moderations.joycaption.result", "asc"),
    "minicpm-desc": ("moderations.minicpm.result", "desc"),
    "minicpm-asc": ("moderations.minicpm.result", "asc"),
    "joycaption-created-desc": ("captions.joycaption.metadata.createdAt", "desc"),
    "joycaption-created-asc": ("captions.joycaption.metadata.createdAt", "asc"),
    "minicpm-created-desc": ("captions.minicpm.metadata.createdAt", "desc"),
    "minicpm-created-asc": ("captions.minicpm.metadata.createdAt", "asc"),
}
DEFAULT_SORT = "minicpm-created-desc"

# Tag tiers, minimum probability per tag kind, and the least probability kept raw.
TIERS = ["high", "medium", "low"]
TIER_BOUNDS = {
    "feature": {"high": 0.35, "medium": 0.25, "low": 0.10},
    "character": {"high": 0.90, "medium": 0.80, "low": 0.50},
}
RAW_BOUNDS = {"feature": 0.05, "character": 0.20}
TAG_CATEGORY_ORDER = ["character", "ip", "feature"]
AXES = ["character", "situation", "style"]
SIMILARITY_AXES = ["eva02", "character", "situation", "style"]
TAG_TYPE_CODES = {"artist": 1, "copyright": 3, "character": 4, "general": 5}

# Names of features, labels and methods in a model key.
FEATURES = ["deepdanbooru", "eva02", "pixai"]
POSITIVE_LABELS = ["pixiv_public", "pixiv_private", "twitter"]
METHODS = ["elkan_noto", "biased_svm", "nnpu"]
UNLABELED, NEGATIVE, SKIP = "unlabeled", "not_bookmarked", "__skip__"
VALID_LABELS = ["pixiv_public", "pixiv_private", "not_bookmarked"]
RATABLE_LABELS = ["pixiv_public", "pixiv_private"]
CLASS_NAMES = ["not_bookmarked", "bookmarked_public", "bookmarked_private"]
LABEL_TO_CLASS = {"pixiv_public": 1, "pixiv_private": 2, "twitter": 1, "unlabeled": 0}
EVAL_LABEL_OF = {"twitter": "pixiv_public"}

# Split ratios (val, test); the rest is train.
POSITIVE_RATIOS, UNLABELED_RATIOS = (0.15, 0.15), (0.05, 0.05)

# Relevance and weight of a rating; an unrated positive counts as 2.
RATING_GAIN = {1: 1.0, 2: 2.0, 3: 4.0}
UNRATED_GAIN = 2.0
WEIGHTING_MODES = ["weighted", "unweighted", "r2plus"]

# Price per million tokens.
INPUT_PRICE, OUTPUT_PRICE = 0.20, 0.50

# Namespace of the item UUIDs (the OID namespace of RFC 4122).
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"

# Limits of the repetition check.
PHRASE_WORDS, PHRASE_CHARS, PHRASE_REPEATS = (3, 50), 10, 3
PATTERN_CHARS, PATTERN_REPEATS, CHAR_RUN = (2, 19), 6, 30

# Hidden layers of the network for each feature and for any other, and its dropout.
HIDDEN_LAYERS = {"deepdanbooru": [1024, 512, 128], "eva02": [512, 256, 128], "pixai": [2048, 512, 128]}
HIDDEN_OTHER, DROPOUT = [512, 128], 0.3
