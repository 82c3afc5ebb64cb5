"""Word lists, weights and patterns of record linkage. All are fixed values: results depend on them."""

#: Separators of tokens: every ASCII character that is neither letter nor digit.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Accented letters by plain letter; ligatures become two letters.
ACCENTS = {
    "a": "ÀÁÂÃÄÅàáâãäå", "c": "Çç", "e": "ÈÉÊËèéêë", "i": "ÌÍÎÏìíîï", "n": "Ññ",
    "o": "ÒÓÔÕÖØòóôõöø", "u": "ÙÚÛÜùúûü", "y": "Ýýÿ",
}
LIGATURES = {"Æ": "ae", "æ": "ae", "Œ": "oe", "œ": "oe", "ß": "ss"}

#: Legal forms and noise that a core name leaves out.
CORE_STOP = [
    "llc", "inc", "incorporated", "pvt", "private", "ltd", "limited", "co", "company", "corp", "corporation", "lp", "llp", "plc", "the",
    "and", "www", "com", "org", "net", "http", "https", "sri", "shri", "smt", "sarl", "sas", "sa", "eurl",
]
#: Legal forms that the plain core name leaves out.
LEGAL = [
    "llc", "inc", "pvt", "private", "ltd", "limited", "co", "company", "corp", "corporation", "lp", "llp", "plc", "the",
]
#: Generic business nouns that the loose core leaves out.
GENERIC = [
    "enterprises", "enterprise", "center", "services", "service", "trading", "partners", "store",
]
#: Phonetic spellings of legal forms. Two hold a space and so match no token; they are kept as given.
PHONETIC_LEGAL = ["lmt d", "lmtd", "prvt", "prv t", "prv", "pvt", "ltd", "llk", "llp", "lk", "kp", "krp", "krprtn", "nkrprtd", "kmpn", "th", "nd", "plk"]

ADDRESS_STOP = [
    "no", "number", "door", "plot", "flat", "h", "house", "india", "usa",
]
#: Only the first occurrence of each phrase is replaced, in this order.
ADDRESS_PHRASES = {
    "west virginia": "wv", "north carolina": "nc", "south carolina": "sc", "north dakota": "nd", "south dakota": "sd", "new york": "ny",
    "new jersey": "nj", "new mexico": "nm", "new hampshire": "nh", "rhode island": "ri", "uttar pradesh": "up", "madhya pradesh": "mp",
    "tamil nadu": "tn", "andhra pradesh": "ap", "west bengal": "wb",
}
ADDRESS_ALIASES = {
    # street types and parts of addresses
    "road": "rd", "street": "st", "avenue": "ave", "drive": "dr", "boulevard": "blvd", "lane": "ln", "court": "ct", "circle": "cir",
    "place": "pl", "highway": "hwy", "parkway": "pkwy", "terrace": "ter", "apartment": "apt", "apartments": "apt", "appartment": "apt",
    "suite": "ste", "floor": "fl", "building": "bldg", "north": "n", "south": "s", "east": "e", "west": "w", "near": "nr",
    "opposite": "opp", "nagar": "ngr", "saint": "st",
    # states of India
    "maharashtra": "mh", "gujarat": "gj", "karnataka": "ka", "telangana": "ts", "rajasthan": "rj", "punjab": "pb", "haryana": "hr",
    "kerala": "kl", "महाराष्ट्र": "mh", "తెలంగాణ": "ts", "தமிழ்நாடு": "tn", "दिल्ली": "dl",
    # states of the US
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi",
    "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "ohio": "oh",
    "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
}

#: Weight of a block by key type; the score of a posting is weight * (1 + ln(1 + 800 / block size)).
BASE_WEIGHTS = {1: 1.2, 2: 1.0, 3: 3.0, 4: 2.0, 5: 1.6}
ENHANCED_WEIGHTS = {1: 1.2, 2: 1.0, 3: 3.0, 4: 2.0, 5: 1.6, 6: 4.0, 7: 4.0, 8: 2.0, 9: 1.0, 10: 3.0, 11: 4.0, 12: 1.2, 13: 3.5, 14: 1.0, 15: 1.8}
REVERSE_WEIGHTS = {6: 4.0, 7: 4.0, 10: 3.0, 4: 2.0, 9: 1.0, 12: 1.0}

#: Coefficients of the logistic baseline, in the order of the 20 legacy features, and its threshold.
LOGISTIC = [
    -10.5703, 4.12998, -1.6801, 2.84931, 2.50302, 7.01396, -3.55554, 2.29818, 0.60068, -0.827804,
    0.462846, 2.49133, 4.13074, -1.77798, 0.450983, 3.5541, -0.373096, -2.65823, 0.889852, 3.73866,
]
LOGISTIC_THRESHOLD = 0.83
