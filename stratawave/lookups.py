"""Names, groups and marks that results depend on."""

# Explicit series names (raw name -> canonical name).
EXPLICIT_NAMES = {
    "CRUDE_WTI": "crude_wti", "NGAS_US": "ngas_us", "NGAS_EUR": "ngas_eur",
    "NGAS_JP": "ngas_jp", "iNATGAS": "i_natgas",
    "GOLD": "gold", "PLATINUM": "platinum", "SILVER": "silver",
    "COCOA": "cocoa", "COFFEE_ARABIC": "coffee_arabic", "MAIZE": "maize",
    "COTTON_A_INDX": "cotton_a_indx", "SOYBEANS": "soybeans",
    "SUGAR_WLD": "sugar_wld", "WHEAT_US_HRW": "wheat_us_hrw",
    "ALUMINUM": "aluminium", "COPPER": "copper", "LEAD": "lead",
    "NICKEL": "nickel", "Tin": "tin", "Zinc": "zinc",
    "TSP": "tsp", "DAP": "dap", "PHOSROCK": "phosrock",
    "UREA_EE_BULK": "urea_ee_bulk", "SOYBEAN_OIL": "soybean_oil",
    "SOYBEAN_MEAL": "soybean_meal", "RAPESEED_OIL": "rapeseed_oil",
    "SUNFLOWER_OIL": "sunflower_oil",
}

# Dictionary of the near-name match, in order of preference.
NEAR_NAMES = {
    "crude_oil_wti": "crude_wti", "natural_gas": "ngas_us", "gold": "gold",
    "silver": "silver", "platinum": "platinum", "cocoa": "cocoa",
    "coffee": "coffee_arabic", "corn": "maize", "cotton": "cotton_a_indx",
    "lumber": "lumber", "soybeans": "soybeans", "sugar": "sugar_wld",
    "wheat": "wheat_us_hrw", "aluminum": "aluminium", "copper": "copper",
    "lead": "lead", "nickel": "nickel", "tin": "tin", "zinc": "zinc",
}

# Spellings of the index names, after removal of other characters.
INDEX_NAMES = {
    "vix": "VIX", "vixindex": "VIX",
    "vxo": "VXO", "vxoindex": "VXO",
    "jln": "JLN", "jlnindex": "JLN", "jlnum1m": "JLN", "jlnum3m": "JLN", "jlnum12m": "JLN",
    "ciss": "CISS", "cissindex": "CISS", "cissindexecb": "CISS", "ecbciss": "CISS",
    "eueconomicpolicyuncertainty": "EPU", "epu": "EPU", "epueu": "EPU",
    "eupolicyuncertainty": "EPU",
}

# Fixed values: (date column, value column) of each index source.
INDEX_COLUMNS = {
    "vix": ("observation_date", "vixcls"),
    "vxo": ("observation_date", "vxocls"),
    "jln": ("observation_date", "jlnum12m"),
    "ciss": ("time_period", "ciss_value"),
}

# Column aliases tried when a source has other headings.
DATE_ALIASES = ("DATE", "date", "observation_date")
VALUE_ALIASES = {
    "vix": ("VIXCLS", "Close", "vix", "value"),
    "vxo": ("VXOCLS", "vxo", "value"),
    "jln": ("MU", "JLN", "JLN_Macro_Uncertainty", "value"),
}

# Groups by pattern; the first match wins.
GROUP_PATTERNS = (
    ("crude|wti|ngas|gas", "Energy"),
    ("gold|silver|platinum", "Precious"),
    ("aluminium|aluminum|copper|lead|nickel|tin|zinc", "Industrial"),
    ("cocoa|coffee|cotton|maize|soybean|soybeans|sugar|wheat", "Agriculture"),
)
GROUP_ORDER = ("Energy", "Industrial", "Precious", "Agriculture", "Other")

# The study set and its exact groups.
STUDY_GROUPS = {
    "Energy": ("crude_wti", "ngas_us"),
    "Precious": ("gold", "silver", "platinum"),
    "Industrial": ("aluminium", "copper", "lead", "nickel", "tin", "zinc"),
    "Agriculture": ("cocoa", "coffee_arabic", "cotton_a_indx", "maize",
                    "soybeans", "sugar_wld", "wheat_us_hrw"),
}
DISPLAY_NAMES = {
    "crude_wti": "Crude oil (WTI)", "ngas_us": "Natural gas (US)",
    "coffee_arabic": "Coffee (Arabica)", "cotton_a_indx": "Cotton A Index",
    "sugar_wld": "Sugar (World)", "wheat_us_hrw": "Wheat (US HRW)",
}

# Spellings folded into one label.
PROXY_SYNONYMS = {
    "volatility": "Volatility", "vxo_vix": "Volatility", "vix": "Volatility",
    "vxo": "Volatility", "jln": "JLN",
}

# Tokens that mean "no value" in raw number columns.
MISSING_NUMBER_PATTERN = r"(?i)^(\s*|\.|-|n/?a)$"
