"""Vocabularies, maps and patterns whose exact contents decide results. Plain data, in natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Trade shorthand, read as whole alphabetic tokens, by trade.
ABBREVIATIONS = {
    # fittings
    "cplg": "coupling", "cplgs": "coupling", "coup": "coupling", "elb": "elbow", "ell": "elbow", "el": "elbow", "nip": "nipple", "nippl": "nipple", "adpt": "adapter", "adap": "adapter",
    "adptr": "adapter", "bush": "bushing", "bushg": "bushing", "bshg": "bushing", "flg": "flange", "flng": "flange", "un": "union", "unn": "union", "redu": "reducer", "red": "reducer",
    "rdcr": "reducer", "tee": "tee", "crs": "cross", "plg": "plug", "cp": "cap", "nut": "nut", "wshr": "washer", "hex": "hexagon", "sq": "square", "str": "strainer", "swg": "swage",
    # valves
    "vlv": "valve", "vv": "valve", "bv": "ball valve", "gv": "gate valve", "ckv": "check valve", "chk": "check", "bfly": "butterfly", "bttrfly": "butterfly", "gl": "globe", "rlf": "relief",
    "prv": "pressure relief valve",
    # faucets and plumbing
    "fct": "faucet", "fcet": "faucet", "fauc": "faucet", "lav": "lavatory", "kit": "kitchen", "shwr": "shower", "sprd": "spread", "wdspr": "widespread", "ctrst": "centerset",
    "cart": "cartridge", "aer": "aerator", "sp": "spout", "hndl": "handle", "hdl": "handle", "trm": "trim", "dvtr": "diverter", "tub": "tub", "sink": "sink", "sply": "supply",
    "drn": "drain", "trp": "trap",
    # materials
    "brs": "brass", "br": "brass", "brz": "bronze", "sst": "stainless steel", "ss": "stainless steel", "galv": "galvanized", "gal": "galvanized", "ci": "cast iron", "di": "ductile iron",
    "mi": "malleable iron", "cu": "copper", "pvc": "pvc", "cpvc": "cpvc", "poly": "polyethylene", "chr": "chrome", "cp2": "chrome plated", "ni": "nickel", "pol": "polished",
    "brn": "brushed",
    # connections
    "thd": "threaded", "thrd": "threaded", "npt": "threaded npt", "fnpt": "female threaded", "mnpt": "male threaded", "swt": "sweat", "slip": "slip", "cmp": "compression", "grv": "grooved",
    "sw": "socket weld", "bw": "butt weld", "fem": "female", "mal": "male", "mxf": "male to female",
    # appliances and electrical
    "dshwshr": "dishwasher", "refrig": "refrigerator", "ref": "refrigerator", "wshm": "washing machine", "dryr": "dryer", "mtr": "motor", "pmp": "pump", "snsr": "sensor",
    "prox": "proximity", "photo": "photoelectric", "temp": "temperature", "pres": "pressure", "conn": "connector", "cbl": "cable", "recept": "receptacle", "sw2": "switch",
    "swtch": "switch", "rly": "relay", "xfmr": "transformer", "brkr": "breaker",
    # general
    "assy": "assembly", "kt": "kit", "repl": "replacement", "std": "standard", "hd": "heavy duty", "lt": "light", "dia": "diameter", "od": "outside diameter", "id": "inside diameter",
    "lg": "long", "sht": "short", "w": "with", "wo": "without",
}

# An abbreviation with two meanings, its reading, and the words that allow it.
AMBIGUOUS = {
    "dw": (
        "dishwasher",
        ["dishwasher", "cycle", "cycles", "rack", "detergent", "wash", "washing", "cabinet", "undercounter", "builtin", "built", "appliance", "tub", "portable", "door"],
    ),
}

ITEM_TYPES = [
    "Coupling", "Reducing Coupling", "Elbow", "Street Elbow", "Tee", "Reducing Tee", "Cross", "Nipple", "Adapter", "Bushing", "Union", "Reducer", "Cap", "Plug", "Flange", "Strainer",
    "Swage Nipple", "Close Nipple", "Hex Bushing", "Pipe Nipple", "Compression Fitting", "Grooved Coupling", "Faucet", "Kitchen Faucet", "Lavatory Faucet", "Bar Faucet", "Shower Faucet",
    "Tub Filler", "Widespread Faucet", "Centerset Faucet", "Faucet Cartridge", "Faucet Handle", "Faucet Aerator", "Faucet Spout", "Shower Head", "Shower Valve Trim", "Diverter",
    "Supply Line", "Drain", "P-Trap", "Sink", "Valve", "Ball Valve", "Gate Valve", "Check Valve", "Butterfly Valve", "Globe Valve", "Pressure Relief Valve", "Solenoid Valve", "Dishwasher",
    "Refrigerator", "Washing Machine", "Dryer", "Range", "Oven", "Water Heater", "Sensor", "Proximity Sensor", "Photoelectric Sensor", "Pressure Sensor", "Temperature Sensor", "Connector",
    "Circular Connector", "Cable Assembly", "Receptacle", "Switch", "Limit Switch", "Relay", "Motor", "Pump", "Transformer", "Circuit Breaker", "Encoder", "Actuator", "Transducer",
    "Controller", "Enclosure", "Terminal Block", "Contactor", "Sanding Belt", "Sanding Disc", "Flap Disc", "Grinding Wheel", "Cut-Off Wheel", "Abrasive Sheet",
]

STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "for", "with", "without", "to", "in", "on", "by", "from", "type", "series", "no", "new", "each", "per", "size", "assembly", "kit", "standard",
    "heavy", "duty", "light", "long", "short", "diameter", "outside", "inside", "female", "male", "left", "right",
]

PLACEHOLDERS = [
    "-- unbranded --", "unbranded", "-- no unilog brand --", "no unilog brand", "-- no dib brand --", "no dib brand", "n/a", "na", "none", "null", "-", "--", "unknown", "not applicable",
    "no brand", "generic",
]

CORPORATE_SUFFIXES = [
    "incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "llc", "lp", "llp", "plc", "gmbh", "ag", "sa", "nv", "bv", "pty", "pvt", "private", "holdings", "group",
    "international", "industries", "industrial", "manufacturing", "mfg", "products", "brands",
]

# Endings of company names that say nothing of who a company is, when a page is to name it.
COMPANY_ENDINGS = ["inc", "incorporated", "ltd", "limited", "llc", "corp", "corporation", "company", "co", "plc", "gmbh", "ag", "sa", "srl", "pvt", "private"]

# Unit variants (see functions.units.unit_key) by approved form.
UNITS = {
    "in": ["in", "inch", "inches", '"', "''"], "ft": ["ft", "foot", "feet", "'"], "mm": ["mm", "millimeter", "millimetre", "millimeters"], "cm": ["cm", "centimeter", "centimetre", "centimeters"],
    "m": ["m", "meter", "metre", "meters", "metres"], "yd": ["yd", "yard", "yards"],
    "V": ["v", "volt", "volts"], "V AC": ["vac"], "V DC": ["vdc"], "mV": ["mv"], "kV": ["kv"], "A": ["a", "amp", "amps", "ampere", "amperes", "amperage"], "mA": ["ma", "milliamp", "milliamps"],
    "W": ["w", "watt", "watts"], "kW": ["kw", "kilowatt"], "hp": ["hp", "horsepower"], "Hz": ["hz", "hertz"], "kHz": ["khz"], "MHz": ["mhz"], "ohm": ["ohm", "ohms"], "VA": ["va"], "kVA": ["kva"],
    "C": ["c", "celsius", "degc", "degreec", "degreescelsius"], "F": ["f", "fahrenheit", "degf", "degreef"],
    "lb": ["lb", "lbs", "pound", "pounds"], "oz": ["oz", "ounce", "ounces"], "kg": ["kg", "kilogram", "kilograms", "kilo"], "g": ["g", "gram", "grams"],
    "psi": ["psi"], "psig": ["psig"], "bar": ["bar"], "kPa": ["kpa"], "MPa": ["mpa"], "in HG": ["inhg"], "in WC": ["wc"],
    "gpm": ["gpm", "gallonsperminute"], "L/min": ["lpm", "lmin", "litersperminute"], "cfm": ["cfm", "cubicfeetperminute"], "rpm": ["rpm", "rpmmax"], "dB": ["db", "decibel"], "dBA": ["dba"],
    "gal": ["gal", "gallon", "gallons"], "L": ["l", "liter", "litre", "liters", "litres"], "qt": ["qt", "quart"], "pt": ["pt", "pint"], "BTU": ["btu"], "BTU/HR": ["btuh"],
    "pc": ["pc", "piece", "pieces"], "ea": ["ea", "each"], "pr": ["pr", "pair"], "pk": ["pk", "pack"], "bx": ["bx", "box"], "cs": ["cs", "case"], "ga": ["gauge", "ga"], "AWG": ["awg"],
    "NPS": ["nominalpipesize", "nps"], "mesh": ["mesh"], "micron": ["micron"],
}

# Phrases in a terse description and how they are shown, the most specific first.
MATERIALS = {
    "stainless steel 316l": "Stainless Steel 316L", "stainless steel 316": "Stainless Steel 316", "stainless steel 304": "Stainless Steel 304", "stainless steel": "Stainless Steel",
    "carbon steel": "Carbon Steel", "malleable iron": "Malleable Iron", "ductile iron": "Ductile Iron", "cast iron": "Cast Iron", "forged steel": "Forged Steel",
    "galvanized steel": "Galvanized Steel", "galvanized": "Galvanized", "polyethylene": "Polyethylene", "polypropylene": "Polypropylene", "aluminum": "Aluminum", "aluminium": "Aluminum",
    "brass": "Brass", "bronze": "Bronze", "copper": "Copper", "nylon": "Nylon", "cpvc": "CPVC", "pvc": "PVC", "pex": "PEX", "abs": "ABS", "zinc": "Zinc", "rubber": "Rubber",
    "ceramic": "Ceramic", "steel": "Steel", "iron": "Iron", "plastic": "Plastic",
}
FINISHES = {
    "polished chrome": "Polished Chrome", "brushed nickel": "Brushed Nickel", "satin nickel": "Satin Nickel", "oil rubbed bronze": "Oil Rubbed Bronze", "matte black": "Matte Black",
    "stainless finish": "Stainless", "chrome plated": "Chrome Plated", "nickel plated": "Nickel Plated", "chrome": "Chrome", "brushed": "Brushed", "polished": "Polished",
}
CONNECTIONS = {
    "male to female threaded": "Male x Female Threaded", "female threaded npt": "Female NPT", "male threaded npt": "Male NPT", "female threaded": "Female Threaded",
    "male threaded": "Male Threaded", "threaded npt": "NPT Threaded", "socket weld": "Socket Weld", "butt weld": "Butt Weld", "compression": "Compression",
    "push to connect": "Push To Connect", "threaded": "Threaded", "grooved": "Grooved", "flanged": "Flanged", "soldered": "Soldered", "sweat": "Sweat", "barbed": "Barbed", "slip": "Slip",
}

# Registrable names by kind of site, the first kind that lists a name wins.
DOMAINS = {
    "marketplace": [
        "amazon", "ebay", "alibaba", "aliexpress", "indiamart", "tradeindia", "made-in-china", "walmart", "flipkart", "etsy", "wish", "temu", "mercadolibre", "rakuten", "shopee", "lazada",
        "snapdeal", "olx", "exportersindia", "dhgate", "globalsources", "thomasnet",
    ],
    "distributor": [
        "grainger", "mscdirect", "fastenal", "zoro", "motionindustries", "applied", "wesco", "rexel", "graybar", "ferguson", "supplyhouse", "pexsupply", "plumbersstock", "webstaurantstore",
        "globalindustrial", "automationdirect", "galco", "statesupply", "buyheatpumps", "digikey", "mouser", "rs-online", "rsdelivers", "farnell", "newark", "arrow", "avnet", "alliedelec",
        "element14", "tme", "verical", "onlinecomponents", "sager", "heilind", "homedepot", "lowes", "menards", "acehardware", "harborfreight", "northerntool", "tractorsupply", "build",
        "wayfair", "overstock", "fergusonhome", "faucetdirect", "efaucets", "qualitybath",
    ],
    "encyclopedia": [
        "wikipedia", "wikimedia", "wiktionary", "britannica", "fandom", "everything2", "citizendium", "dbpedia", "wikiwand",
    ],
    "community": [
        "reddit", "quora", "stackexchange", "stackoverflow", "medium", "blogspot", "wordpress", "tumblr", "facebook", "twitter", "x", "instagram", "linkedin", "pinterest", "youtube",
        "tiktok", "eng-tips", "practicalmachinist", "plbg", "diychatroom",
    ],
    "manufacturer": [
        "turck", "banner-engineering", "bannerengineering", "omron", "keyence", "ifm", "pepperl-fuchs", "sick", "balluff", "festo", "smcworld", "smcusa", "parker", "siemens",
        "schneider-electric", "rockwellautomation", "abb", "phoenixcontact", "weidmueller", "harting", "lapp", "binder-connector", "amphenol", "te", "molex", "hirschmann", "belden",
        "eaton", "wago", "murrelektronik", "baumer", "wenglor", "leuze", "contrinex", "autonics", "anvilintl", "anvil-emea", "victaulic", "swagelok", "parkerhannifin", "nibco", "watts",
        "zurn", "viega", "uponor", "charlottepipe", "mueller-industries", "wardmfg", "smithcooper", "bonney-forge", "moen", "kohler", "delta", "deltafaucet", "grohe", "americanstandard",
        "americanstandard-us", "pfister", "hansgrohe", "toto", "elkay", "chicagofaucets", "symmons", "sloan", "gerberonline", "brizo", "frigidaire", "whirlpool", "electrolux", "ge",
        "geappliances", "bosch", "bosch-home", "lg", "samsung", "maytag", "kitchenaid", "rheem", "aosmith", "bradfordwhite", "navieninc", "rinnai",
    ],
}


def unit_rows() -> list[tuple[str, str]]:
    return [(variant, approved) for approved, variants in UNITS.items() for variant in variants]


def domain_rows() -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for kind, names in DOMAINS.items():
        for name in names:
            seen.setdefault(name, kind)
    return sorted(seen.items())


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(domain_rows(), "registrable string, category string")


def uom(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(unit_rows(), "variant string, approved string")
