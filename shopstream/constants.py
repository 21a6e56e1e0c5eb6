"""Defaults of the library.

Fixed values: these must equal the defaults of the system this library
re-implements, so that results match it.
"""

# --- fixed values (session building, vocabulary, sequences, split) ---
MIN_SESSION_LEN = 2
SESSION_LEN_PERCENTILE = 95
VOCAB_SIZE = 40_000
PAD_TOKEN = 0
UNK_TOKEN = 1
OTHER_TOKEN = 2
NUM_SPECIAL_TOKENS = 3
MAX_SEQ_LEN = 20
TEST_DAYS = 3
VAL_DAYS = 3
NUM_SAMPLED_NEGATIVES = 100
EARLY_STOPPING_PATIENCE = 2

# --- fixed values (storefront) ---
DEFAULT_PAGE_SIZE = 24
MAX_PAGE_SIZE = 100
MAX_SEARCH_LEN = 200
DEFAULT_TOP_K = 10
MAX_TOP_K = 50
OVERFETCH_FACTOR = 4
MAX_CART_ID_LEN = 36
RECENT_HISTORY = 10
HOME_CATEGORIES = 2
HOME_ROW_SIZE = 8
RELATED_FETCH = 9
RELATED_SIZE = 8

# --- fixed values (image pools: leaf pools hold 6 photos, category pools 8) ---
LEAF_POOL_SIZE = 6
CATEGORY_POOL_SIZE = 8
DEFAULT_LEAF_POOLS = {
    "electronics": ["clocks", "headphone", "smartphone", "tv"],
    "appliances": ["refrigerators", "hood", "oven", "vacuum"],
    "apparel": ["shoes", "keds", "underwear", "sandals"],
    "computers": ["notebook", "desktop", "mouse", "monitor"],
    "furniture": ["chair", "bed", "cabinet", "table"],
    "construction": ["drill", "faucet", "pump", "saw"],
    "kids": ["toys", "carriage", "dolls", "skates"],
    "accessories": ["bag", "wallet"],
    "sport": ["bicycle", "tennis", "ski", "snowboard"],
    "auto": ["player", "videoregister", "alarm"],
    "country_yard": ["lawn_mower", "cultivator"],
}
DEFAULT_CATEGORY_POOLS = [
    "electronics", "appliances", "apparel", "computers", "furniture",
    "construction", "kids", "accessories", "sport", "auto", "stationery",
    "country_yard", "medicine", "generic",
]
GENERIC_CATEGORY = "generic"
