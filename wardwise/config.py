"""Fixed values of the scoring model (they must be as they are for right results)."""

# Layouts by smallest, largest and assumed size in square metres.
LAYOUTS = {
    "1R": (18, 25, 21),
    "1K": (20, 28, 24),
    "1DK": (25, 35, 30),
    "1LDK": (32, 45, 38),
    "2K_2DK": (35, 50, 43),
    "2LDK": (45, 65, 55),
    "3LDK": (60, 80, 70),
}
LOW_FACTOR, HIGH_FACTOR = 0.9, 1.1
MULTIPLIER_POWER, MULTIPLIER_MIN, MULTIPLIER_MAX = 0.25, 0.85, 1.15
MIN_LAND_POINTS = 3
FALLBACK_WARN_SHARE = 0.5
RECENT_YEARS, OLD_YEARS = 2, 5

CATCHMENT_M, LINE_BUFFER_M, MERGE_M = 800.0, 100.0, 300.0
ACCESS_WALK_MIN, TRANSFER_PENALTY_MIN = 8.0, 5.0
PEAK_WAIT_MIN, OFFPEAK_WAIT_MIN = 4.0, 6.0
PEAK_START_MIN, PEAK_END_MIN = 450.0, 600.0
SPEED_KMH = {"subway": 28.0, "local_rail": 28.0, "commuter_rail": 35.0, "monorail": 30.0}
WAIT_BOUNDS_MIN = (1.0, 15.0)
WALK_M_PER_MIN, DETOUR, MAX_WALK_M = 80.0, 1.3, 1500.0
SAMPLES, STATIONS_PER_SAMPLE = 9, 3

# Counts (or shares) at which a lifestyle axis is satisfied.
TARGETS = {"supermarkets": 4.0, "restaurants": 40.0, "konbini": 10.0, "cuisine_variety": 12.0, "late_night": 6.0, "health": 8.0, "green_space": 0.15}
NIGHTLIFE_TARGET = 6.0
AXES = ("supermarkets", "restaurants", "quietness", "konbini", "cuisine_variety", "green_space", "late_night", "health")
WEIGHTS = {"affordability": 0.3, "commute": 0.3, "lifestyle": 0.4}
IMPORTANCE = {"low": 1, "medium": 2, "high": 4, "essential": 8}
FULL_AFFORDABILITY_RATIO, FULL_COMMUTE_MIN = 0.8, 15.0
POSITIVE, NEGATIVE = 66.0, 34.0
QUIET_WEIGHTS = (0.5, 0.3, 0.2)
SHOP_WEIGHTS = {"supermarket": 1.0, "grocery": 0.5, "convenience": 0.25}
RESULTS, PLACES, STATIONS = 20, 10, 10
RENT_RANGE, FEE_RANGE = (1000.0, 20000.0), (0.0, 50000.0)
TSUBO_SQM = 3.3058
BOX = (35.5, 139.56, 35.82, 139.92)  # south, west, north, east
COUNTRY_BOX = (20.0, 122.0, 46.0, 154.0)
CONFIDENCE = ("low", "medium", "high")

# What map tags mean.
ROADS = ("motorway", "trunk", "primary")
GREEN = ("park", "garden")
SHOPS = {"supermarket": "supermarket", "convenience": "convenience", "greengrocer": "grocery", "butcher": "grocery", "bakery": "grocery", "grocery": "grocery"}
AMENITIES = {"restaurant": "restaurant", "cafe": "cafe", "bar": "bar", "pub": "bar", "nightclub": "bar", "clinic": "health", "doctors": "health", "pharmacy": "health", "hospital": "health", "university": "landmark", "college": "landmark", "school": "landmark"}
FOOD = ("restaurant", "cafe", "bar")

# English names of the city's wards by code.
WARD_NAMES = {
    "13101": "Chiyoda",
    "13102": "Chuo",
    "13103": "Minato",
    "13104": "Shinjuku",
    "13105": "Bunkyo",
    "13106": "Taito",
    "13107": "Sumida",
    "13108": "Koto",
    "13109": "Shinagawa",
    "13110": "Meguro",
    "13111": "Ota",
    "13112": "Setagaya",
    "13113": "Shibuya",
    "13114": "Nakano",
    "13115": "Suginami",
    "13116": "Toshima",
    "13117": "Kita",
    "13118": "Arakawa",
    "13119": "Itabashi",
    "13120": "Nerima",
    "13121": "Adachi",
    "13122": "Katsushika",
    "13123": "Edogawa",
}
FORBIDDEN_SOURCES = ("seed", "fixture")
MODES = tuple(SPEED_KMH)
