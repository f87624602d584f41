"""Numbers, names and patterns that results depend on."""

# --- fixed values: pings, speed and distance ---
MAX_ACCURACY_M = 150
MAX_KMH = 300
CHORD_RADIUS_M = 6378000.0
ARC_RADIUS_M = 6371009.0

# --- fixed values: stays ---
STAY_WINDOW = 18
STAY_DISTANCE_M = 25.0
STAY_SECONDS = 60

# --- fixed values: homes ---
MIN_NIGHT_STAY_S = 7200
HOME_ZONE = "EET"
HOME_STEP_DAYS = 30
HOME_HALF_DAYS = 21
MIN_NIGHTS = 4
HOME_EPS_KM = 0.05
HOME_RADIUS_KM = 6371.0
HOME_MIN_POINTS = 3
MIN_HOME_DISTANCE_M = 100
MAX_HOMES_PER_SPOT = 3

# --- fixed values: panel and events ---
LOCAL_ZONE = "Europe/Kyiv"
MAX_DAY_DISTANCE_M = 100000
ANCHOR_SECONDS = 86400
BASE_CELL = -1
FIRST_CELL_S = -600
MIN_MOVING_KMH = 0.3
MIN_SPREAD_KM = 50
MIN_EVENT_ROWS = 200
EXCLUDED_NAMES = ["Donetsk", "Luhansk"]

# --- fixed values: contact zone ---
ZONE_RADIUS_KM = 5.0

# --- fixed values: estimate tables ---
FALSE_RATE_THRESHOLD = 0.769
SHOP_MEAN_ROWS = 15
TRIM_IQR = 10

# --- fixed values: counterfactuals ---
MOVEMENT_COEF = -0.0000674
MOVEMENT_START = 1938.0
MOVEMENT_END = 421.85
MINIMAL_MOVEMENT = 421.8466
TREND_START = "2022-03-15"
TREND_END = "2022-09-30"
RESAMPLES = 10000
SUBSAMPLE_ROWS = 90

# --- fixed values: country table ---
NOT_A_COUNTRY = "Antarctica"
SYSTEM_LABEL = "National Alert System"
NO_SYSTEM_LABEL = "No System"

# --- fixed values: city layer ---
CITY_TYPES = ["Misto", "Mis'ka Rada"]
LEVEL1_CITIES = ["Kiev City", "Sevastopol'"]

# --- fixed values: region names ---
REGION_RENAMES = [("Kyiv oblast", "Kiev"), ("Kyiv", "Kiev City")]
REGION_SUFFIXES = [" oblast", " raion"]
REGION_FIXES = [
    ("Bakhmut", "Bakhmats'kyi"),
    ("Bila Tserkva", "Bilia?vs'kyi"),
    ("Dobropillia hromada", "Dobropil's'kyi"),
    ("Izium", "Iziums'ka"),
    ("Ivano-Frankivsk", "Ivano-Frankivs'k"),
    ("Kryvyi Rih", "KryvyiRig"),
    ("Lubny", "Lubens'ka"),
    ("Nikopol", "Nikopol's'ka"),
    ("Pershotravensk", "Pershotravnevyi"),
    ("Pokrovsk", "Pokrovs'kyi"),
    ("Polohiv", "Polohivs'kyi"),
    ("Starokostiantyniv", "Starokostiantynivs'kyi"),
    ("Uman hromada", "Umans'kyi"),
    ("Vasylkiv", "Vasylivs'kyi"),
    ("Zaporizhzhia", "Zaporiz'kyi"),
]
OPTION_PATTERN = r'<option[^>]*value="([^"]*)"[^>]*>([^<]*)</option>'
OPTION_JUNK = "${indent}"
