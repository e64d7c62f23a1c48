"""Common names of companies that no register lists."""

# Names in questions and the tickers they stand for.
ALIASES = {
    "apple": "AAPL", "microsoft": "MSFT", "google": "GOOGL", "alphabet": "GOOGL", "amazon": "AMZN", "nvidia": "NVDA", "meta": "META", "tesla": "TSLA", "meta platforms": "META", "facebook": "META",
    "berkshire hathaway": "BRK.B", "berkshire hathaway a": "BRK.A", "bank of america": "BAC", "boa": "BAC", "boeing": "BA", "coca cola": "KO", "coca-cola": "KO", "cola": "KO", "coke": "KO",
    "johnson & johnson": "JNJ", "j&j": "JNJ", "johnson and johnson": "JNJ", "procter & gamble": "PG", "p&g": "PG", "procter and gamble": "PG", "walmart": "WMT", "wal-mart": "WMT", "wally world": "WMT",
    "united parcel service": "UPS", "ups": "UPS", "parcel service": "UPS", "general electric": "GE", "ge": "GE", "ibm": "IBM", "international business machines": "IBM", "american express": "AXP", "amex": "AXP",
    "home depot": "HD", "hd": "HD", "mcdonald's": "MCD", "mcdonalds": "MCD", "mcd": "MCD", "mickey d's": "MCD", "jpmorgan": "JPM", "jp morgan": "JPM", "jpm": "JPM", "wells fargo": "WFC", "citigroup": "C", "citi": "C",
    "goldman sachs": "GS", "morgan stanley": "MS", "charles schwab": "SCHW", "schwab": "SCHW", "blackrock": "BLK", "black rock": "BLK", "s&p global": "SPGI", "sandp global": "SPGI", "moody's": "MCO", "moodys": "MCO",
    "intercontinental exchange": "ICE", "walt disney": "DIS", "disney": "DIS", "disney co": "DIS", "comcast": "CMCSA", "netflix": "NFLX", "verizon": "VZ", "at&t": "T", "att": "T", "t-mobile": "TMUS", "tmobile": "TMUS",
    "charter": "CHTR", "fox": "FOXA", "news corp": "NWSA", "honeywell": "HON", "union pacific": "UNP", "3m": "MMM", "caterpillar": "CAT", "cat": "CAT", "lockheed martin": "LMT", "raytheon": "RTX",
    "northrop grumman": "NOC", "northrop": "NOC", "illinois tool works": "ITW", "deere": "DE", "john deere": "DE", "fedex": "FDX", "fed ex": "FDX", "pepsico": "PEP", "pepsi": "PEP", "costco": "COST",
    "mondelez": "MDLZ", "colgate-palmolive": "CL", "colgate": "CL", "kimberly-clark": "KMB", "general mills": "GIS", "kraft heinz": "KHC", "altria": "MO", "philip morris": "PM", "pm": "PM",
    "exxon mobil": "XOM", "exxon": "XOM", "mobil": "XOM", "chevron": "CVX", "conocophillips": "COP", "conoco": "COP", "schlumberger": "SLB", "halliburton": "HAL", "eog resources": "EOG",
    "marathon petroleum": "MPC", "marathon": "MPC", "phillips 66": "PSX", "valero": "VLO", "kinder morgan": "KMI", "williams companies": "WMB", "devon energy": "DVN", "nextera energy": "NEE", "duke energy": "DUK",
    "southern company": "SO", "dominion energy": "D", "american electric power": "AEP", "exelon": "EXC", "sempra": "SRE", "xcel energy": "XEL", "public service enterprise group": "PEG", "consolidated edison": "ED",
    "entergy": "ETR", "firstenergy": "FE", "american tower": "AMT", "prologis": "PLD", "crown castle": "CCI", "equinix": "EQIX", "public storage": "PSA", "simon property": "SPG", "digital realty": "DLR",
    "welltower": "WELL", "realty income": "O", "alexandria real estate": "ARE", "avalonbay": "AVB", "equity residential": "EQR", "linde": "LIN", "air products": "APD", "sherwin-williams": "SHW",
    "sherwin williams": "SHW", "dow": "DOW", "dupont": "DD", "newmont": "NEM", "freeport-mcmoran": "FCX", "freeport": "FCX", "international paper": "IP", "ball": "BALL", "albemarle": "ALB",
    "vision 2020": "V2020", "vision2020": "V2020", "v2020": "V2020",
}
