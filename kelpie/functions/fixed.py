"""Word lists, tables and patterns that results depend on, in their natural order."""

# Rank words and the ranks they stand for.
RANK_WORDS = {
    "supergroup": "Supergroup", "group": "Group", "subgroup": "Subgroup", "formation": "Formation",
    "member": "Member", "bed": "Bed", "tongue": "Tongue", "lentil": "Lentil",
}

# Rock words that stand for a rank in unit names (an informal Formation).
LITH_AS_RANK = [
    "shale", "limestone", "sandstone", "chalk", "marl", "clay", "sand", "dolomite", "quartzite", "conglomerate", "gravel",
    "schist", "gneiss", "granite", "basalt", "tuff", "slate", "beds", "series", "silt", "till",
]

# Capitalised words that are no unit names.
STOP_NAMES = [
    "The", "This", "That", "These", "Those", "It", "In", "At", "Age", "Pg", "Report", "Named", "Type", "Gulf", "North", "South",
    "East", "West", "Upper", "Lower", "Middle", "Late", "Early", "Basal", "Top", "Base",
]

# A name is up to four capitalised words and an optional rank or rock word, alternatives by alphabet.
RANK_ALTERNATIVES = "|".join(sorted([*RANK_WORDS, *LITH_AS_RANK]))
NAME = rf"([A-Z][A-Za-z'\u2019\-]+(?:\s+[A-Z][A-Za-z'\u2019\-]+){{0,3}}(?:\s+(?i:{RANK_ALTERNATIVES})s?)?)"
THE = r"(?i:the\s+)?"

# Relation kinds and the phrases before the other unit's name, in order.
RELATION_PHRASES = [
    ("unconformable_on", r"(?i:unconformably\s+(?:overlies|rests\s+on))"),
    ("overlies", r"(?i:\boverlies)"),
    ("overlies", r"(?i:\brests\s+(?:conformably\s+)?(?:up)?on)"),
    ("overlies", r"(?i:\babove)"),
    ("underlies", r"(?i:\bunderlies)"),
    ("underlies", r"(?i:\bbelow)"),
    ("underlies", r"(?i:\boverlain\s+by)"),
    ("grades_into", r"(?i:\bgrades?\s+(?:laterally\s+|eastward\s+|westward\s+|northward\s+|southward\s+)?(?:in)?to)"),
    ("intertongues_with", r"(?i:\binter(?:tongues|fingers)\s+with)"),
    ("equivalent_to", r"(?i:\b(?:equivalent\s+to|correlated\s+with|correlative\s+(?:with|of)))"),
]

# Edge types of relation kinds: type, whether source and target change places, unconformable.
RELATION_EDGES = {
    "overlies": ("OVERLIES", False, False),
    "underlies": ("OVERLIES", True, False),
    "unconformable_on": ("OVERLIES", False, True),
    "grades_into": ("GRADES_INTO", False, False),
    "intertongues_with": ("INTERTONGUES_WITH", False, False),
    "equivalent_to": ("EQUIVALENT_TO", False, False),
}

# Lengths.
FEET_TO_METRES = 0.3048
NUMBER = r"(\d{1,5}(?:[.,]\d+)?)"
LENGTH_UNIT = r"(feet|foot|ft\.?|meters?|metres?|m\.?)\b"

# Interval ranks from small to large, and the one interval that the vocabulary lacks.
INTERVAL_RANKS = ["age", "epoch", "period", "era", "eon", "supereon"]
EXTRA_INTERVAL = ("Precambrian", "supereon", 538.8, 4600.0)

# Vocabulary filters.
CHRONO_RANKS = ["eon", "era", "period", "epoch", "age"]
NON_TERRESTRIAL = ["martian", "lunar", "mars", "moon"]

# States and their postal codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC", "puerto rico": "PR", "alaska peninsula": "AK",
}

# Fields of an extraction.
RANKS = ["Supergroup", "Group", "Subgroup", "Formation", "Member", "Bed", "Tongue", "Lentil", "Unknown"]
RELATIONS = ["overlies", "underlies", "grades_into", "intertongues_with", "unconformable_on", "equivalent_to"]
LIST_FIELDS = ["lithologies", "chronostrat", "minerals", "states"]
EXTRACTION_SCHEMA = (
    "struct<unit_name:string,rank:string,lithologies:array<string>,chronostrat:array<string>,minerals:array<string>,"
    "thickness:struct<min_m:double,max_m:double>,relations:array<struct<kind:string,unit:string>>,states:array<string>>"
)

# The prompt that training and inference share.
SYSTEM_PROMPT = (
    "You are a geoscience information-extraction engine. Read the passage from a geological lexicon and return ONLY a JSON object matching this schema:\n"
    "{\n"
    '  "unit_name": string|null, "rank": one of [Supergroup,Group,Subgroup,Formation,Member,Bed,Tongue,Lentil,Unknown],\n'
    '  "lithologies": [string], "chronostrat": [string], "minerals": [string],\n'
    '  "thickness": {"min_m": number|null, "max_m": number|null}|null,\n'
    '  "relations": [{"kind": one of [overlies,underlies,grades_into,intertongues_with,unconformable_on,equivalent_to], "unit": string}],\n'
    '  "states": [string]\n'
    "}\n"
    "Use the exact wording of the source for names. Omit nothing that is stated; invent nothing that is not. Sort every list alphabetically."
)
