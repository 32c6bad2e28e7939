"""Fixed values.

These constants must equal the published coding scheme of the register and the
published defaults of the analyses, or results would differ.
"""

# Codes that mean "missing" anywhere in the raw register, as value or as text.
MISSING_CODES = (-1, -2, -3, -4, -9, -99, "NA", "")
# Texts that mean "no identifier".
NULL_ID_TEXTS = ("nan", "None", "", "<NA>")
# Missing marker of the yearly price source.
PRICE_MISSING = -99.0

# SEX codes.
FEMALE = 1
MALE = 2
# MARITAL_STATUS code for married.
MARRIED = 2

# Calendar and cohort split (inclusive years).
MIN_YEAR = 1749
MAX_YEAR = 1909
TRAIN_END_YEAR = 1855
VAL_END_YEAR = 1879

# Relations of the temporal graph; 0 is the time of a static edge.
RELATIONS = ("r_hw", "r_fs", "r_fd", "r_ms", "r_md", "r_sib", "r_hh", "r_hc", "r_cb")
MATERNAL_RELATIONS = ("r_ms", "r_md")
STATIC_TIME = 0

# Identifier, numeric and text columns of the register.
ID_COLUMNS = (
    "PERSON_ID", "MOTHER_ID", "FATHER_ID", "GRANDFATHER_ID",
    "WIFE_1_ID", "WIFE_2_ID", "HUSBAND_ID", "HOUSEHOLD_ID",
)
NUMERIC_COLUMNS = (
    "YEAR", "SEX", "AGE_IN_SUI", "BIRTHYEAR", "MARITAL_STATUS", "GENERATION",
    "REGION", "DISTRICT", "UNIQUE_VILLAGE_ID", "POSITION", "TITLE", "SALARY",
    "FATHER_ID_IMPUTED", "PRESENT", "DIED", "MARRIED_OUT", "REMARRIED_OUT", "NEXT_MARRY",
)
OCCUPATION_COLUMNS = ("POSITION", "TITLE", "SALARY")

# Yearly covariates and reign boundaries (era id, first year).
MACRO_COLUMNS = (
    "cohort_year_z", "grain_price_z", "grain_price_yoy", "era_id", "disaster_flag",
)
REIGN_STARTS = ((0, 1736), (1, 1796), (2, 1821), (3, 1851), (4, 1862), (5, 1875), (6, 1909))
PRICE_COLUMNS = (
    "LOW_RICE", "LOW_HUSKED_MILLET", "LOW_UNHUSKED_MILLET",
    "LOW_SORGHUM", "LOW_WHEAT", "LOW_SOY",
    "HIGH_RICE", "HIGH_HUSKED_MILLET", "HIGH_UNHUSKED_MILLET",
    "HIGH_SORGHUM", "HIGH_WHEAT", "HIGH_SOY",
)

# Era buckets of the cohort report (name, first year, last year).
ERA_BUCKETS = (
    ("pre-1780", 1700, 1779),
    ("1780-1855", 1780, 1855),
    ("1856-1879", 1856, 1879),
    ("1882-1888", 1882, 1888),
    ("1903", 1903, 1903),
    ("1906-1909", 1906, 1909),
)
# Era tag of a cohort year; every other year is "regular".
CATCHUP_YEARS = (1903,)
LATE_YEARS = (1906, 1909)

# Ranking, sampling and evaluation defaults.
NEGATIVES_PER_POSITIVE = 4
HARD_NEGATIVES = 5
RECALL_AT = (1, 5, 10)
VOCAB_SIZE = 64
PROBABILITY_CLIP = 1e-7
STD_FLOOR = 1e-6
PAIR_BUDGET = 6000
REFERENCE_SAMPLE = 1000
BATCH_YEARS = 4
LINEAGE_BUCKETS = 1000
LINEAGE_MAX_STEPS = 64

# Two-sided rule scoring.
TOP_K_CANDIDATES = 8
REVERSE_THRESHOLD = 5
COMMIT_THRESHOLD = 6.5
COMMIT_LOGIT = 2.0
ONE_SIDED_FACTOR = 0.85
DEFAULT_SCORE = 5
MAX_REASON_CHARS = 500

# Rule weights and motif switches.
RULE_WEIGHTS = {
    "paternal_lineage": 1.0,
    "sibling_overlap": 1.0,
    "household_share": 1.0,
    "banner_match": 0.5,
    "macro_era": 0.8,
}
MOTIF_FLAGS = {
    "m1_father_brother": True,
    "m2_uncle_in_law": True,
    "m3_same_household": False,
    "m4_banner_endog": True,
}
# Raw sizes of the additive logit components.
BIAS = -1.0
PATERNAL_PER_PATH = 0.6
SIBLING_BONUS = 0.35
HOUSEHOLD_BONUS = 0.45
BANNER_BONUS = 0.3
ERA_BONUS = {"regular": 0.4, "catchup": 0.0, "late": 0.2}
ENDOGAMY_PENALTY = -2.0

# Hexagon layout and surface.
HEX_RADIUS = 0.04
HEX_CAPACITY = 12
RASTER_WIDTH = 120
RASTER_MIN_HEIGHT = 20
IDW_NEIGHBOURS = 12
IDW_EPS = 1e-6
SMOOTH_SIGMA = 1.5
LEVELS_MIN = 3
LEVELS_DEFAULT = 7
LEVELS_MAX = 11
LEVEL_LOW_PERCENTILE = 50.0
LEVEL_HIGH_PERCENTILE = 99.0
LEVEL_GAP = 1e-9
CHANNELS = ("confidence", "patrilineal", "endogamy")
