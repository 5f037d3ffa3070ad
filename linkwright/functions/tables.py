"""Fixed values of normalisation: results depend on every entry."""

from __future__ import annotations

# Trailing legal forms, in order of preference at one place.
LEGAL_FORMS = [r"pvt\s+ltd", r"private\s+limited", "ltd", "limited", "llp", "opc", r"co\s+operative", "coop", "incorporated", "inc", "corporation", "corp", "llc", "lp", "co", "company", "sarl", "sas", "sasu", "sa", "eurl", "snc", "sci"]

LEGAL_TOKENS = ["pvt", "private", "ltd", "limited", "llp", "opc", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "lp", "pllc", "plc", "pc", "pte", "pty", "sarl", "sas", "sasu", "sa", "eurl", "snc", "sci", "gmbh", "praivet", "piraivet", "praivat", "pryvet", "limitet", "limitad", "limittad", "limitted", "kampani", "kampni", "kampeni"]
FILLER_TOKENS = ["the", "and", "of", "dba", "aka", "ms", "com", "www", "net", "org", "in", "id", "null", "et", "de", "du", "des", "la", "le", "les"]
ADDRESS_STOPS = ["null", "number", "no", "h", "door", "nan", "none"]
LEET = ("0134578", "oieastb")

ADDRESS_GENERIC = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway", "ct": "court", "pl": "place", "pkwy": "parkway", "fl": "floor", "flr": "floor", "ste": "suite", "apt": "apartment", "rm": "room", "opp": "opposite", "nr": "near", "bldg": "building", "no": "number", "dist": "district",
}
ADDRESS_FRANCE = ADDRESS_GENERIC | {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "blvd": "boulevard", "st": "saint", "ste": "sainte", "all": "allee", "pl": "place", "imp": "impasse", "ch": "chemin", "chem": "chemin", "rte": "route", "fbg": "faubourg", "sq": "square", "crs": "cours", "res": "residence", "bat": "batiment", "apt": "appartement", "appt": "appartement", "n": "number", "no": "number", "num": "number", "numero": "number",
}

US_REGIONS = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "dc": "district of columbia", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "pr": "puerto rico",
}
INDIA_REGIONS = {
    "ap": ["andhra pradesh"], "ar": ["arunachal pradesh"], "as": ["assam"], "br": ["bihar"], "cg": ["chhattisgarh", "chattisgarh", "ct"], "ga": ["goa"], "gj": ["gujarat"], "hr": ["haryana", "hariyana"], "hp": ["himachal pradesh"], "jh": ["jharkhand"], "ka": ["karnataka"], "kl": ["kerala", "keralam"], "mp": ["madhya pradesh"], "mh": ["maharashtra"], "mn": ["manipur"], "ml": ["meghalaya"], "mz": ["mizoram"], "nl": ["nagaland"], "od": ["odisha", "orissa", "orisha", "or"], "pb": ["punjab", "panjab"], "rj": ["rajasthan"], "sk": ["sikkim"], "tn": ["tamil nadu", "tamilnadu", "tamizh nadu"], "tg": ["telangana", "ts"], "tr": ["tripura"], "up": ["uttar pradesh"], "uk": ["uttarakhand", "uttaranchal", "ut"], "wb": ["west bengal", "paschim banga", "pashchim bang"], "dl": ["delhi", "dilli", "nct of delhi"], "jk": ["jammu and kashmir", "jammu kashmir"], "la": ["ladakh"], "ch": ["chandigarh"], "py": ["puducherry", "pondicherry"], "an": ["andaman and nicobar islands"], "ld": ["lakshadweep"], "dn": ["dadra and nagar haveli and daman and diu", "dadra and nagar haveli", "daman and diu"],
}

DIGRAPHS = [("sch", "s"), ("ph", "f"), ("sh", "s"), ("ch", "s"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("dh", "d"), ("bh", "b"), ("jh", "j"), ("ck", "k"), ("qu", "k"), ("x", "ks")]
SOUND_CLASSES = ("bpfvwcgkqdtsz", "pppvvkkkkttss")
SOUND_VOWELS = "aeiouyh"

# Indic letters by offset in their script's block.
INDIC_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li", 0x72: "i", 0x73: "u"}
INDIC_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "ny", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "zh", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "q", 0x59: "kh", 0x5A: "gh", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
}
INDIC_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "li", 0x63: "li"}
INDIC_NUKTA = {"j": "z", "ph": "f", "k": "q", "d": "r", "dh": "rh", "g": "g", "kh": "kh"}
INDIC_SPECIAL = {0x09CE: "t", 0x09F0: "r", 0x09F1: "w", 0x0A70: "n", 0x0D54: "m", 0x0D55: "y", 0x0D56: "l", 0x0D7A: "n", 0x0D7B: "n", 0x0D7C: "r", 0x0D7D: "l", 0x0D7E: "l", 0x0D7F: "k"}
