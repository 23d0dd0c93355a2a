"""Vocabularies, weights and limits of the story engine. All are parameters of the operators that use them."""

from __future__ import annotations

# The query parameters that carry no identity, and the words that titles are compared without.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "referrer",
    "source", "cmp", "ito", "ns_campaign", "ns_mchannel", "smid", "smtyp", "partner", "ocid", "cid", "at_medium", "at_campaign",
)
STOPWORDS = tuple(
    "a an the and or but of in on at to for with by from as is are was were be been it its this that these those into over after before amid amidst up down out"
    " about than then will would could should has have had not no new says say said how what why when who more his her their our your may can us".split()
)
TITLE_STOPWORDS = tuple(
    "the and but for from with into over under about after before during amid among between against than then that this these those there here his her its their them"
    " they our your was were are has have had been being will would could should may might can not you who what when where why how new says said say told more most some"
    " any all one two following according".split()
)

CATEGORIES = ("politics", "business", "technology", "science", "health", "sports", "entertainment", "world", "climate", "general")
#: Words that speak for a category: (category, word, weight in the title, weight in the text).
CATEGORY_WORDS = {
    "politics": ("senate", "senator", "election", "minister", "parliament", "vote", "voter", "ballot", "campaign", "governor", "lawmaker", "cabinet", "referendum", "prime minister", "white house"),
    "business": ("market", "share", "profit", "bank", "merger", "earnings", "inflation", "tariff", "investor", "retailer", "layoff", "acquisition", "interest rate", "stock exchange"),
    "technology": ("software", "chip", "robot", "startup", "cloud", "smartphone", "cybersecurity", "algorithm", "browser", "semiconductor", "hacker", "artificial intelligence", "data centre"),
    "science": ("study", "telescope", "fossil", "quantum", "genome", "physicist", "astronomer", "spacecraft", "archaeologist", "neuron", "asteroid", "black hole"),
    "health": ("hospital", "vaccine", "patient", "virus", "clinic", "surgeon", "cancer", "diabetes", "outbreak", "nurse", "dementia", "public health", "mental health"),
    "sports": ("match", "league", "season", "coach", "goal", "playoff", "striker", "tournament", "championship", "quarterback", "olympics", "world cup", "grand slam"),
    "entertainment": ("film", "album", "festival", "actor", "actress", "singer", "sequel", "premiere", "streaming", "celebrity", "box office", "red carpet"),
    "world": ("summit", "border", "treaty", "embassy", "refugee", "ceasefire", "diplomat", "sanction", "airstrike", "peacekeeper", "united nations", "foreign ministry"),
    "climate": ("emission", "drought", "wildfire", "carbon", "flood", "glacier", "heatwave", "renewable", "deforestation", "sea level", "greenhouse gas"),
}
MONEY_WORDS = ("billion", "million", "profit", "shares", "revenue")
HUBS = {
    "energy": ("oil", "grid", "solar", "pipeline", "refinery", "electricity", "nuclear"),
    "space": ("orbit", "rocket", "moon", "satellite", "astronaut", "lander", "spacecraft"),
    "courts": ("judge", "trial", "appeal", "verdict", "lawsuit", "prosecutor", "jury"),
    "weather": ("storm", "rain", "heat", "hurricane", "tornado", "blizzard", "forecast"),
    "housing": ("rent", "mortgage", "tenant", "landlord", "eviction", "homeowner", "zoning"),
}
HUB_THRESHOLD = 2
GEO_STRONG = {
    "US": ("washington", "congress", "texas", "california", "florida", "chicago", "white house", "new york", "united states", "supreme court"),
    "CA": ("ottawa", "ontario", "quebec", "alberta", "toronto", "vancouver", "canada", "british columbia", "nova scotia", "house of commons"),
}
GEO_WEAK = {"US": ("american", "federal"), "CA": ("canadian", "provincial")}
GEO_NEAR = ("mexico", "north america")
PRESS_DOMAINS = ("wire.example.org", "release.example.net", "newswire.example.com")
OPINION = r"(?i)^(opinion|editorial|column)\b"
ANALYSIS = r"(?i)^(analysis|explainer)\b|\bwhat (it|this) means\b"
LIVE = r"(?i)\blive (updates|blog|coverage)\b"
RELEASE = r"(?i)\bpress release\b|\(business wire\)"

TIER_WEIGHT = {"A": 1.0, "B": 0.7, "C": 0.45}
RANKING_WEIGHTS = {"freshness": 35, "authority": 20, "coverage": 20, "geography": 10, "prominence": 10, "velocity": 5}
MAX_AGE_HOURS, FUTURE_MINUTES, ARTICLE_CAP = 72, 30, 950
PAIR_FLOOR, CROSS_CATEGORY, CONFLICT = 0.42, 0.05, 0.15
LEAD_FLOOR, HEADLINE_FLOOR, PRINT_FLOOR = 0.25, 0.1, 0.42
POSTING_CUTOFF, PAIR_HOURS = 50, 48
GROUP_OVERLAP = 0.6
#: Titles that report a death, in plain words.
DEATH = r"(?i)\b(?:die[ds]|dead|deaths?|passe[ds]\s+away|obituar(?:y|ies)|obit|remembered|mourn(?:s|ed|ing)?)\b"
#: Stems that relate events in time and never identify one.
WEAK_STEMS = tuple("monday tuesday wednesday thursday friday saturday sunday today yesterday tonight ago follow amid amidst".split())
RARE_FLOOR, RARE_SHARE = 4, 0.04
HISTORY_CAP, DISPLAY_CAP, CHURN_HOURS = 20, 6, 24
TOPIC_MIN_CLUSTERS, COLLECTION_MIN = 2, 3
#: Endings that tell the kind of a place and not which place it is.
PLACE_SUFFIXES = ("county", "province", "region", "district", "nature reserve", "national park", "conservation area")
ACTIONS = {
    "death": ("die", "died", "dead", "kill", "death"), "win": ("win", "beat", "defeat"), "launch": ("launch", "unveil", "debut"), "cut": ("cut", "slash", "reduce"),
    "rise": ("rise", "jump", "surge"), "arrest": ("arrest", "detain", "charge"),
}
