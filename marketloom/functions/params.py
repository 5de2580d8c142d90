"""Fixed parameter tables: word lists, thresholds, symbol and name maps.

Each block below holds fixed values that results depend on. Operators take
them as default arguments, so that a user can pass other ones.
"""

from __future__ import annotations

# Model panel columns.
TECHNICAL_FEATURES = ["rsi_14", "macd_hist", "volatility_20", "momentum_5", "momentum_21",
                      "momentum_63", "price_vs_sma20", "price_vs_sma50"]
SENTIMENT_FEATURES = ["sentiment_index", "sentiment_lag1", "sentiment_lag2", "news_count"]
VOLATILITY_FEATURES = ["log_vol_5", "log_vol_20", "log_vol_60", "vol_ratio_5_20",
                       "vol_ratio_20_60", "abs_ret_1", "abs_ret_5_mean", "range_20",
                       "neg_ret_share_20", "log_market_vol_20", "rel_vol_to_market"]
FUNDAMENTAL_FEATURES = ["revenue_growth_qoq", "eps_growth_qoq", "net_margin",
                        "margin_delta_qoq", "debt_to_equity", "pe_ratio"]

# Horizons in trading rows.
DIRECTION_HORIZONS = [1, 5, 21]
FUNDAMENTAL_HORIZONS = [63, 126, 252]
VOLATILITY_HORIZONS = [5, 21]

MIN_VOL = 1e-6
ANNUAL_DAYS = 252
Z_975 = 1.959963984540054

# Publishers accepted by the headline intake, lower case.
TRUSTED_PUBLISHERS = [
    "bloomberg", "reuters", "cnbc", "financial times", "wall street journal", "yahoo finance",
    "marketwatch", "marketbeat", "simply wall st", "seeking alpha", "investing.com",
    "the globe and mail", "barron", "msn", "business insider", "motley fool", "benzinga",
    "the street", "zacks", "coindesk", "cointelegraph", "meyka", "polymarket",
]
PLACEHOLDER_PUBLISHERS = ["news.google.com"]

# Publisher credibility on the 0..10 scale, first match wins.
CREDIBILITY_RULES = [
    (9.5, ["bloomberg", "reuters", "financial times", "wall street journal", "wsj", "ft"]),
    (8.5, ["cnbc", "marketwatch"]),
    (8.0, ["yahoo finance", "globe and mail", "the street", "thestreet", "investopedia"]),
    (7.0, ["investing.com"]),
    (6.5, ["seeking alpha"]),
    (6.0, ["motley fool", "coincentral", "fxleaders"]),
]
CREDIBILITY_DEFAULT = 5.0

# The one-off reclassification on the 0..100 scale (ILIKE patterns).
RECLASSIFY_RULES = [
    ("%Bloomberg%", 95), ("%Reuters%", 95), ("%Financial Times%", 95),
    ("%Wall Street Journal%", 95), ("%WSJ%", 95), ("%FT%", 95), ("%CNBC%", 85),
    ("%MarketWatch%", 85), ("%Yahoo%Finance%", 80), ("%Globe and Mail%", 80),
    ("%Motley Fool%", 60), ("%Investing.com%", 70), ("%Seeking Alpha%", 65),
    ("%CoinCentral%", 60),
]
RECLASSIFY_DEFAULT = 50

# Symbols by asset class; anything else is a stock.
CRYPTO_SYMBOLS = ["BTC-USD", "ETH-USD", "BNB-USD", "SOL-USD", "XRP-USD"]
FUTURES_SYMBOLS = ["GC=F", "CL=F", "SI=F", "NG=F", "NQ=F", "ES=F", "ZC=F", "ZW=F"]
FOREX_SYMBOLS = ["XAUUSD", "EURUSD", "GBPUSD", "USDJPY"]
FUND_SYMBOLS = ["SPY", "QQQ", "DIA", "IWM", "GLD", "SLV", "VTI"]

# Provider symbols; a null target has no series at that provider.
PROVIDER_SYMBOLS = {"GC=F": "XAUUSD", "BTC-USD": "BTCUSD", "EURUSD=X": "EURUSD"}
GAP_PROVIDER_SYMBOLS = {"GC=F": "xauusd", "BTC-USD": "btcusd", "EURUSD=X": "eurusd",
                        "THBUSD=X": None}

# Display names.
DISPLAY_NAMES = {
    "GC=F": "Gold", "CL=F": "Crude Oil", "EURUSD=X": "EUR/USD", "THBUSD=X": "THB/USD",
    "BTC-USD": "Bitcoin", "ETH-USD": "Ethereum", "^GSPC": "S&P 500", "^DJI": "Dow Jones",
    "^IXIC": "NASDAQ", "NVDA": "Nvidia", "GOOGL": "Google", "AMZN": "Amazon",
    "NFLX": "Netflix", "AMD": "AMD", "ORCL": "Oracle", "MSFT": "Microsoft",
    "AAPL": "Apple", "META": "Meta", "TSLA": "Tesla",
}

# News search terms per symbol.
SEARCH_TERMS = {
    "GC=F": "gold", "CL=F": "WTI crude", "EURUSD=X": "EUR USD", "THBUSD=X": "Thai baht",
    "BTC-USD": "Bitcoin", "ETH-USD": "ETH crypto", "EURUSD": "EUR USD", "^GSPC": "S&P 500",
    "^DJI": "Dow Jones", "^IXIC": "Nasdaq", "AAPL": "AAPL stock", "MSFT": "MSFT stock", "GOOGL": "GOOGL stock",
    "AMZN": "AMZN stock", "NVDA": "NVDA stock", "META": "META stock", "TSLA": "TSLA stock", "AMD": "AMD stock",
    "ORCL": "ORCL stock", "INTC": "INTC stock", "JPM": "JPM stock", "V": "V stock", "JNJ": "JNJ stock",
    "XOM": "XOM stock", "PG": "PG stock", "KO": "KO stock", "WMT": "WMT stock", "HD": "HD stock",
    "DIS": "DIS stock", "BA": "BA stock",
}

# Filing-fact tags per measure, highest priority first.
DURATION_TAGS = {
    "revenue": ["RevenuesNetOfInterestExpense",
                "RevenueFromContractWithCustomerExcludingAssessedTax",
                "RevenueFromContractWithCustomerIncludingAssessedTax",
                "SalesRevenueNet", "Revenues"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "gross_profit": ["GrossProfit"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"],
}
EPS_TAGS = {"eps_diluted": ["EarningsPerShareDiluted"]}
INSTANT_TAGS = {
    "stockholders_equity": ["StockholdersEquity",
                            "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "long_term_debt": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "short_term_debt": ["LongTermDebtCurrent", "ShortTermBorrowings", "DebtCurrent"],
}
QUARTER_DAYS = (80, 100)
ANNUAL_SPAN_DAYS = (340, 380)
SUBLINE_RATIO = 1.5
MISTAG_TOLERANCE = 0.05
RECONCILE_TOLERANCE = 0.005
SAME_QUARTER_DAYS = 5
REGISTRANT_OVERRIDES = {"XOM": "0000034088"}
FILING_FORMS = ["10-K", "10-Q", "8-K"]

# Rows whose non-positive close is a real market event.
ACCEPTED_ANOMALIES = [("non_positive_close_price", "CL=F", "2020-04-20",
                       "crude futures settled below zero that day")]

# Price lookback bounds in days.
LOOKBACK_FLOOR = 14
LOOKBACK_CEILING = 400
LOOKBACK_MARGIN = 5

# A small valence lexicon of this project's own, on a -4..4 scale.
LEXICON = {
    "gain": 2.0, "gains": 2.0, "surge": 2.3, "surges": 2.3, "rally": 2.2, "beat": 1.5,
    "beats": 1.5, "profit": 1.8, "profits": 1.8, "growth": 1.6, "strong": 2.0, "record": 1.2,
    "upgrade": 1.9, "outperform": 2.1, "win": 2.6, "good": 1.9, "great": 3.1, "best": 3.2,
    "happy": 2.7, "love": 3.2, "nice": 1.8, "safe": 1.6, "fine": 0.8, "clear": 1.2,
    "loss": -1.9, "losses": -1.9, "fall": -1.4, "falls": -1.4, "drop": -1.3, "drops": -1.3,
    "plunge": -2.5, "crash": -2.9, "miss": -1.4, "misses": -1.4, "weak": -1.9, "fraud": -3.0,
    "lawsuit": -1.8, "downgrade": -2.0, "risk": -1.1, "debt": -1.3, "bad": -2.5, "worst": -3.1,
    "hate": -2.7, "stupid": -2.4, "idiot": -2.3, "trash": -1.6, "worthless": -2.1, "ugly": -2.3,
    "error": -1.7, "fail": -2.5, "dumb": -2.3, "garbage": -1.9, "pathetic": -2.7, "moron": -2.6,
}
# Overrides a finance desk would apply on top: neutral accounting words.
FINANCE_OVERRIDES = {"debt": -0.4, "risk": -0.3, "Record": 1.6, "bullish": 2.4, "bearish": -2.4}
LEXICON_NORM = 15.0

# Published constants of rule-based valence scoring.
DEGREE_STEP = 0.293
DEGREE_BY_DISTANCE = (1.0, 0.95, 0.9)
CAPITALS_STEP = 0.733
NEGATION_FACTOR = -0.74
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION_STEP, EXCLAMATIONS = 0.292, 4
QUESTION_STEP, QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
# Words that strengthen, weaken or negate one of the next three words.
BOOSTERS = ["absolutely", "completely", "considerably", "deeply", "enormously", "especially", "exceptionally", "extremely", "greatly",
            "highly", "hugely", "incredibly", "intensely", "more", "most", "particularly", "remarkably", "sharply", "so", "strongly",
            "substantially", "thoroughly", "totally", "tremendously", "unusually", "utterly", "very", "really"]
DAMPENERS = ["almost", "barely", "hardly", "kind", "kinda", "less", "little", "marginally", "modestly", "occasionally", "partly",
             "scarcely", "slightly", "somewhat", "sort"]
NEGATIONS = ["aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt", "neither",
             "never", "no", "nobody", "none", "nope", "nor", "not", "nothing", "nowhere", "shouldnt", "wasnt", "werent", "without",
             "wont", "wouldnt"]
