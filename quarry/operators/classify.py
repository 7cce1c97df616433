"""Business model and industry of a site: additive points in seven layers, native Columns only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, values

#: Categories, alphabetical (a tie goes to the first).
MODELS = "Agency Community Consulting Directory Ecommerce Education Marketplace Media Newsletter SaaS Tool".split()
INDUSTRIES = (
    "AI & ML|Beauty|Construction & Manufacturing|Data & Analytics|DevTools|Ecommerce & Retail|Education|Fashion|Fintech|Food & Beverage|General|HR & Recruiting|Healthcare|Home & Garden|"
    "Legal|Logistics|Marketing|Media & Entertainment|Productivity|Real Estate|Security|Travel"
).split("|")
LEAST_CONFIDENCE = 0.55

#: Technologies and apps, and the model points of each.
SHOP_TECH = "Shopify WooCommerce Magento BigCommerce PrestaShop Ecwid OpenCart Shift4Shop Volusion".split()
OTHER_TECH = {"Substack": ("Newsletter", 12), "Ghost": ("Media", 10), "Discourse": ("Community", 10), "Bubble": ("Tool", 5)}
SHOP_APPS = "Klaviyo Judge.me Afterpay Klarna Smile.io ReCharge Yotpo Privy Stamped.io Loox Oberlo DSers Spocket".split()
OTHER_APPS = {("LearnDash", "LifterLMS", "Sensei"): ("Education", 10), ("BuddyPress", "bbPress"): ("Community", 8), ("Easy Digital Downloads",): ("Ecommerce", 10)}

#: Schema.org type, model and its points, industry and its points (empty: none).
SCHEMA_TYPES = [
    ("SoftwareApplication", "SaaS", 10, "", 0),
    ("WebApplication", "SaaS", 10, "", 0),
    ("MobileApplication", "SaaS", 8, "", 0),
    ("Product", "Ecommerce", 8, "", 0),
    ("IndividualProduct", "Ecommerce", 9, "", 0),
    ("Dentist", "Consulting", 8, "Healthcare", 10),
    ("Physician", "Consulting", 8, "Healthcare", 10),
    ("Hospital", "Consulting", 6, "Healthcare", 10),
    ("Pharmacy", "Ecommerce", 6, "Healthcare", 9),
    ("MedicalClinic", "Consulting", 7, "Healthcare", 10),
    ("MedicalOrganization", "Consulting", 6, "Healthcare", 8),
    ("LegalService", "Consulting", 8, "Legal", 10),
    ("Attorney", "Consulting", 9, "Legal", 10),
    ("Notary", "Consulting", 7, "Legal", 8),
    ("Restaurant", "Consulting", 6, "Food & Beverage", 10),
    ("CafeOrCoffeeShop", "Consulting", 6, "Food & Beverage", 10),
    ("Bakery", "Ecommerce", 5, "Food & Beverage", 10),
    ("BarOrPub", "Consulting", 5, "Food & Beverage", 10),
    ("FastFoodRestaurant", "Consulting", 6, "Food & Beverage", 10),
    ("Brewery", "Consulting", 5, "Food & Beverage", 9),
    ("RealEstateAgent", "Consulting", 7, "Real Estate", 10),
    ("BankOrCreditUnion", "Consulting", 6, "Fintech", 10),
    ("InsuranceAgency", "Consulting", 7, "Fintech", 9),
    ("AccountingService", "Consulting", 8, "Fintech", 8),
    ("FinancialService", "Consulting", 6, "Fintech", 9),
    ("ClothingStore", "Ecommerce", 9, "Fashion", 10),
    ("ElectronicsStore", "Ecommerce", 9, "General", 6),
    ("JewelryStore", "Ecommerce", 9, "Fashion", 8),
    ("GroceryStore", "Ecommerce", 9, "Food & Beverage", 8),
    ("FurnitureStore", "Ecommerce", 9, "Home & Garden", 10),
    ("PetStore", "Ecommerce", 9, "General", 6),
    ("ShoeStore", "Ecommerce", 9, "Fashion", 9),
    ("SportingGoodsStore", "Ecommerce", 9, "General", 5),
    ("HardwareStore", "Ecommerce", 8, "Construction & Manufacturing", 6),
    ("HomeGoodsStore", "Ecommerce", 9, "Home & Garden", 9),
    ("Store", "Ecommerce", 6, "", 0),
    ("BeautySalon", "Consulting", 6, "Beauty", 10),
    ("HairSalon", "Consulting", 6, "Beauty", 10),
    ("NailSalon", "Consulting", 6, "Beauty", 10),
    ("DaySpa", "Consulting", 6, "Beauty", 10),
    ("Electrician", "Consulting", 7, "Construction & Manufacturing", 10),
    ("Plumber", "Consulting", 7, "Construction & Manufacturing", 10),
    ("RoofingContractor", "Consulting", 7, "Construction & Manufacturing", 10),
    ("GeneralContractor", "Consulting", 7, "Construction & Manufacturing", 10),
    ("HVACBusiness", "Consulting", 7, "Construction & Manufacturing", 10),
    ("TravelAgency", "Consulting", 7, "Travel", 10),
    ("Hotel", "Consulting", 6, "Travel", 10),
    ("LodgingBusiness", "Consulting", 6, "Travel", 9),
    ("EducationalOrganization", "Education", 9, "Education", 9),
    ("School", "Education", 9, "Education", 10),
    ("CollegeOrUniversity", "Education", 10, "Education", 10),
    ("Course", "Education", 8, "Education", 8),
    ("NewsMediaOrganization", "Media", 9, "Media & Entertainment", 9),
    ("LocalBusiness", "Consulting", 3, "", 0),
    ("ProfessionalService", "Consulting", 6, "", 0),
    ("Organization", "", 0, "", 0),
    ("WebSite", "", 0, "", 0),
]

#: What paths must hold (comma: any of; +: all; !: none), the category and its points.
PAGE_RULES = """
pricing + login,signin,sign-in + docs,documentation,api: SaaS 15
pricing + login,signin,sign-in + !docs,documentation,api: SaaS 10
pricing + free-trial,trial,demo: SaaS 9
cart,checkout: Ecommerce 10
shop,products,collections + !pricing: Ecommerce 7
portfolio,our-work,work + case-stud + !pricing: Agency 10
portfolio,our-work,work + !pricing + !cart,checkout: Agency 5
courses,lessons,classes + enroll,register: Education 10
properties,listings: Real Estate 7
directory + submit: Directory 9
"""
#: What navigation text must hold, the category and its points.
NAV_RULES = """
shop,products,collections: Ecommerce 6
pricing + docs,api,login: SaaS 7
portfolio,our work,case stud: Agency 6
courses,programs,learn,curriculum: Education 6
our menu,food menu,dinner,lunch,reservat: Food & Beverage 6
properties,homes,real estate,listings: Real Estate 6
practice areas,attorneys,legal: Legal 6
patient,appointment,dentist,doctor: Healthcare 5
"""
#: Suffix, industry, points.
TLD_POINTS = [
    ("edu", "Education", 12),
    ("gov", "General", 10),
    ("law", "Legal", 10),
    ("legal", "Legal", 9),
    ("attorney", "Legal", 9),
    ("dental", "Healthcare", 9),
    ("health", "Healthcare", 8),
    ("clinic", "Healthcare", 8),
    ("hospital", "Healthcare", 9),
    ("restaurant", "Food & Beverage", 9),
    ("cafe", "Food & Beverage", 8),
    ("bank", "Fintech", 12),
    ("insurance", "Fintech", 9),
    ("realty", "Real Estate", 9),
    ("homes", "Real Estate", 8),
    ("ai", "AI & ML", 6),
    ("dev", "DevTools", 5),
    ("travel", "Travel", 8),
    ("tours", "Travel", 8),
    ("construction", "Construction & Manufacturing", 9),
]
#: Keyword patterns; full points in title, heading or description, half of them (rounded down) in the body.
MODEL_PATTERNS = [
    (r"\bsaas\b|cloud[- ]based|cloud platform", "SaaS", 7),
    (r"free trial|start free|try free|try it free", "SaaS", 5),
    (r"web hosting|shared hosting|\bvps\b|dedicated server|managed hosting|cloud hosting", "SaaS", 6),
    (r"per user|per seat|per month|billed annually|billed monthly", "SaaS", 6),
    (r"request (?:a )?demo|book (?:a )?demo|schedule (?:a )?demo|get (?:a )?demo", "SaaS", 5),
    (r"sign up free|get started free|start your free", "SaaS", 4),
    (r"shop now|buy now|add to cart|order now|order online", "Ecommerce", 7),
    (r"free shipping|free delivery|fast shipping", "Ecommerce", 6),
    (r"our collection|new arrivals|best sellers|on sale|shop (?:our|the|all)", "Ecommerce", 5),
    (r"digital agency|marketing agency|creative agency|design agency|web agency|full[- ]service agency", "Agency", 8),
    (r"we (?:help|work with) (?:brands|clients|companies)", "Agency", 5),
    (r"our clients|client (?:results|success|stories)|case stud(?:y|ies)", "Agency", 4),
    (r"consulting firm|management consulting|strategy consulting", "Consulting", 7),
    (r"law firm|attorneys?\b|lawyers?\b|legal (?:services|practice|team)", "Consulting", 7),
    (r"newsletter|weekly digest|daily brief|subscribe to (?:our|the)", "Newsletter", 5),
    (r"\bmarketplace\b|buy and sell|connect buyers", "Marketplace", 6),
    (r"online course|bootcamp|online (?:learning|classes|school)", "Education", 5),
    (r"calculator|generator|converter|checker|(?:free )?tool\b", "Tool", 6),
    (r"\bcommunity forum\b|\bdiscussion board\b|\bforum topic|online community|members area", "Community", 4),
    (r"latest news|breaking news|editorial|journalism|reporting", "Media", 5),
    (r"directory|listing|submit your|find (?:a |local )", "Directory", 4),
]
INDUSTRY_PATTERNS = [
    (r"\bfintech\b|payment[s ]?(?:platform|gateway)|(?:payment processing)|banking|lending|mortgage|(?:invest|trading)\b|crypto(?:currency)?", "Fintech", 6),
    (r"\bhipaa\b|telemedicine|telehealth|\behr\b|clinical|patient[s ]?(?:care|portal)|medical|healthcare", "Healthcare", 7),
    (r"marketing (?:platform|software|tool|automation)|(?:\bseo\b|\bppc\b|\bcrm\b)|email marketing|lead gen", "Marketing", 6),
    (r"\bhr\b software|recruiting|payroll|onboarding|\bats\b|applicant tracking|talent (?:management|acquisition)", "HR & Recruiting", 6),
    (r"law firm|attorney|litigation|compliance|personal injury|legal (?:services|practice)", "Legal", 7),
    (r"real estate|homes for sale|\bmls\b|realtor|property (?:management|listings?)", "Real Estate", 7),
    (r"skincare|makeup|cosmetic[s]?|beauty|serum|moisturizer|salon", "Beauty", 6),
    (r"fashion|apparel|clothing|footwear|jewelry|designer|boutique", "Fashion", 6),
    (r"restaurant|bakery|coffee shop|gluten[- ]free|food (?:delivery|ordering)|catering|cuisine|brewery|winery|bistro|pizz", "Food & Beverage", 6),
    (r"\bai[- ]powered\b|machine learning|\bgpt\b|\bllm\b|generative ai|artificial intelligence|neural net", "AI & ML", 6),
    (r"developer[s ]?(?:tool|platform)|(?:\bsdk\b|\bapi\b|devops|ci\/cd)|kubernetes|docker|open[- ]?source", "DevTools", 6),
    (r"cybersecurity|infosec|threat (?:detection|intelligence)|vulnerability|penetration test|\bsiem\b", "Security", 7),
    (r"productivity|project management|task management|workflow|collaboration tool|team (?:management|communication)", "Productivity", 5),
    (r"logistics|supply chain|shipping (?:software|platform)|fleet management|warehouse", "Logistics", 6),
    (r"construction|contractor|building (?:materials|supplies)|manufacturing|industrial", "Construction & Manufacturing", 6),
    (r"garden|landscaping|home (?:improvement|decor|renovation)|furniture|interior design", "Home & Garden", 5),
    (r"data analytics|business intelligence|\bbi\b (?:tool|platform|solution)|data (?:visualization|warehouse|pipeline)", "Data & Analytics", 6),
    (r"online (?:learning|education|school|university)|e-?learning|\blms\b|student|academic|curriculum", "Education", 5),
    (r"hotel|travel (?:agency|booking)|tourism|vacation|flight|destination", "Travel", 6),
    (r"streaming|entertainment|gaming|music (?:label|platform|production)|podcast|media (?:company|production)|film (?:production|studio)|tv (?:show|series)", "Media & Entertainment", 5),
    (r"ecommerce|e-commerce|online (?:store|shop|retail)|retail (?:platform|solution)", "Ecommerce & Retail", 5),
]
#: What a TXT record holds, and the points of each.
TXT_POINTS = {"intercom": [("SaaS", 2)], "hubspot": [("Marketing", 2)], "shopify": [("Ecommerce", 2)], "atlassian": [("SaaS", 2), ("DevTools", 2)]}
#: Texts of parked and unopened pages (title parts; whole titles; body parts).
PARKED = (["domain for sale", "parked domain", "website coming soon"], ["storefront"], ["this domain is for sale", "buy this domain"])
UNOPENED = (
    ["Ecommerce Software by Shopify", "E-Commerce-Software von Shopify", "E-commercesoftware van Shopify", "E-Ticaret Yazılımı", "logiciel de commerce", "Software di ecommerce di Shopify"],
    ["My Store", "Opening Soon"],
    ["store is currently unavailable", "is currently unavailable", "store is coming soon", "Opening Soon"],
)

INPUTS = "http_tech http_apps http_title http_meta_description http_pages http_schema_type http_og_type ctl_tld dns_txt h1 body_text nav_links".split()
LAYERS = "tech schema pages nav tld keywords dns".split()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds_any(text: Column, needles: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(n)) for n in needles])


class Points:
    """Conditions with points, by layer; a category is a model if a model has its name and no industry is asked for."""

    def __init__(self):
        self.items: list[tuple[str, str, str, Column, Column]] = []

    def add(self, layer: str, side: str, category: str, when: Column, points: int | Column) -> None:
        self.items.append((layer, side, category, when, points if isinstance(points, Column) else F.lit(points)))

    def total(self, side: str, category: str) -> Column | None:
        found = [F.when(c, p).otherwise(0) for _, s, k, c, p in self.items if (s, k) == (side, category)]
        return reduce(lambda a, b: a + b, found) if found else None

    def fired(self, layer: str) -> Column:
        return F.coalesce(any_of([c for name, _, _, c, _ in self.items if name == layer]), F.lit(False))


def _side(category: str, only: str = "") -> str:
    return only or ("model" if category in MODELS else "industry")


def _rule_lines(points: Points, layer: str, text: Column, rules: str) -> None:
    for line in filter(None, map(str.strip, rules.splitlines())):
        condition, target = line.rsplit(":", 1)
        category, amount = target.strip().rsplit(" ", 1)
        parts = [~holds_any(text, p[1:].split(",")) if p.startswith("!") else holds_any(text, p.split(",")) for p in map(str.strip, condition.split(" + "))]
        points.add(layer, _side(category), category, reduce(lambda a, b: a & b, parts), int(amount))


def _count_of(items: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(items, lambda x: x.isin(wanted)))


def points_of(c: dict[str, Column]) -> Points:
    """All layers' points over the input columns."""
    points = Points()
    tech, apps = values(c["http_tech"]), values(c["http_apps"])
    shop_techs = _count_of(tech, SHOP_TECH)
    points.add("tech", "model", "Ecommerce", shop_techs > 0, shop_techs * 12)
    for name, (category, amount) in OTHER_TECH.items():
        count = _count_of(tech, [name])
        points.add("tech", "model", category, count > 0, count * amount)
    shop_apps = _count_of(apps, SHOP_APPS)
    points.add("tech", "model", "Ecommerce", shop_apps > 0, 4 + shop_apps * 2)
    for names, (category, amount) in OTHER_APPS.items():
        points.add("tech", "model", category, _count_of(apps, list(names)) > 0, amount)
    for kind, model, amount, industry, more in SCHEMA_TYPES:
        hit = c["http_schema_type"] == kind
        points.add("schema", "model", model, hit, amount)
        points.add("schema", "industry", industry, hit, more)
    points.add("schema", "model", "Ecommerce", c["http_og_type"] == "product", 6)
    points.add("schema", "model", "Media", c["http_og_type"] == "article", 4)
    _rule_lines(points, "pages", F.lower(c["http_pages"]), PAGE_RULES)
    _rule_lines(points, "nav", F.lower(c["nav_links"]), NAV_RULES)
    for suffix, industry, amount in TLD_POINTS:
        points.add("tld", "industry", industry, F.lower(c["ctl_tld"]) == suffix, amount)
    points.add("tld", "model", "Education", F.lower(c["ctl_tld"]) == "edu", 10)
    for side, patterns in (("model", MODEL_PATTERNS), ("industry", INDUSTRY_PATTERNS)):
        for i, (_, category, _) in enumerate(patterns):
            gained = F.get(c[f"hits_{side}"], F.lit(i))
            points.add("keywords", side, category, gained > 0, gained)
    for needle, gains in TXT_POINTS.items():
        for category, amount in gains:
            points.add("dns", _side(category), category, F.contains(F.lower(c["dns_txt"]), F.lit(needle)), amount)
    return points


def alternatives(pattern: str) -> tuple[list[str], str]:
    """The plain texts among a pattern's outermost alternatives, and the expression of the others."""
    parts, depth, now = [], 0, ""
    for ch in pattern:
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and not depth:
            parts, now = [*parts, now], ""
        else:
            now += ch
    parts.append(now)
    plain = [x for x in parts if not re.search(r"[\\\[\](){}?*+.^$]", x)]
    return plain, "|".join(x for x in parts if x not in plain)


def found(text: Column, pattern: str) -> Column:
    """Does a pattern occur?  Plain texts are searched as such, which costs a small part of an expression's scan."""
    plain, rest = alternatives(pattern)
    tests = [F.contains(text, F.lit(x)) for x in plain] + ([text.rlike(rest)] if rest else [])
    return reduce(lambda a, b: a | b, tests)


def keyword_hits(c: dict[str, Column], patterns: list[tuple[str, str, int]]) -> Column:
    """Points of each pattern, in order: full in title, heading or description, half in the body."""
    first, body = c["first"], c["body"]
    return F.array(*[F.when(found(first, p), n).when(found(body, p), n // 2).otherwise(0) for p, _, n in patterns])


def winner(scores: Column) -> Column:
    """The best of an array of (points, -place, name); null where none has points."""
    return F.array_max(F.filter(scores, lambda x: x["points"] > 0))


def confidence(model: Column, industry: Column, models: Column, industries: Column) -> Column:
    """Half the winner's share on its stronger side, half its points against 25; two places, below one."""
    a, b = F.coalesce(model, F.lit(0)), F.coalesce(industry, F.lit(0))
    share = F.when(a >= b, a / F.greatest(models, F.lit(1))).otherwise(b / F.greatest(industries, F.lit(1)))
    return F.round(F.least(share * 0.5 + F.least(F.greatest(a, b) / 25.0, F.lit(1.0)) * 0.5, F.lit(0.99)), 2)


def unclassifiable(title: Column, body: Column) -> Column:
    """Parked and unopened pages."""
    low_title, low_body = F.lower(title), F.lower(body)
    return holds_any(low_title, PARKED[0]) | low_title.isin(PARKED[1]) | holds_any(low_body, PARKED[2]) | holds_any(title, UNOPENED[0]) | title.isin(UNOPENED[1]) | holds_any(body, UNOPENED[2])


def classify(sites: DataFrame) -> DataFrame:
    """Add ``business_model, industry, classification_confidence, method``; inputs that are missing or null count as empty."""
    have = set(sites.columns)
    text = sites.withColumns({f"_i_{n}": filled(n) if n in have else F.lit("") for n in INPUTS})
    inputs = {n: F.col(f"_i_{n}") for n in INPUTS}
    text = text.withColumns({"_i_first": F.lower(F.concat_ws(" ", inputs["http_title"], inputs["h1"], inputs["http_meta_description"])), "_i_body": F.lower(inputs["body_text"])})
    inputs |= {"first": F.col("_i_first"), "body": F.col("_i_body")}
    # every expression is matched once; points and layers read the result
    text = text.withColumns({"_i_hits_model": keyword_hits(inputs, MODEL_PATTERNS), "_i_hits_industry": keyword_hits(inputs, INDUSTRY_PATTERNS)})
    points = points_of({n: F.col(f"_i_{n}") for n in (*INPUTS, "hits_model", "hits_industry")})
    scores = lambda side, names: F.array(*[F.struct(t.cast("int").alias("points"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(names) if (t := points.total(side, n)) is not None])
    scored = text.withColumns({"_m": scores("model", MODELS), "_n": scores("industry", INDUSTRIES), "_method": F.array_join(F.array_compact(F.array(*[F.when(points.fired(x), F.lit(x)) for x in LAYERS])), "+"), "_skip": unclassifiable(F.col("_i_http_title"), F.col("_i_body_text"))})
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["points"])
    won = scored.withColumns({"_wm": winner(F.col("_m")), "_wn": winner(F.col("_n"))})
    won = won.withColumn("_conf", confidence(F.col("_wm.points"), F.col("_wn.points"), total("_m"), total("_n")))
    sure = ~F.col("_skip") & (F.col("_conf") >= LEAST_CONFIDENCE)
    out = won.withColumns(
        {
            "business_model": F.when(sure, filled("_wm.name")).otherwise(""),
            "industry": F.when(sure, filled("_wn.name")).otherwise(""),
            "classification_confidence": F.when(sure, F.col("_conf")).otherwise(0.0),
            "method": F.when(sure, F.col("_method")).otherwise(""),
        }
    )
    return out.drop("_m", "_n", "_method", "_skip", "_wm", "_wn", "_conf", *[f"_i_{n}" for n in (*INPUTS, "first", "body", "hits_model", "hits_industry")])


def label_similarity(vectors: DataFrame, labels: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Add ``best_label`` and ``similarity``: the greatest dot product of unit vectors, ties to the smaller label.

    ``labels`` is a handful of (label, unit vector) rows, collected as literals
    would be: it is broadcast and met by every row.
    """
    size = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    gathered = labels.agg(F.collect_list(F.struct(F.col(label).alias("_l"), F.col("_lv"))).alias("_all"))
    scored = vectors.crossJoin(F.broadcast(gathered)).withColumn("_best", F.array_max(F.transform("_all", lambda x: F.struct((F.aggregate(F.zip_with(F.col(vector), x["_lv"], lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, y: s + y) / size).alias("s"), (-x["_l"]).alias("l")))))
    return scored.withColumn("best_label", -F.col("_best.l")).withColumn("similarity", F.col("_best.s")).drop("_all", "_best")


def centroids(vectors: DataFrame, vector: str = "embedding", label: str = "label", dim: int = 64) -> DataFrame:
    """``label, _lv``: the mean vector of each label, scaled to unit length; partial sums before the shuffle."""
    means = vectors.groupBy(label).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dim)])
    lv = F.array(*[f"m{i}" for i in range(dim)])
    return means.select(label, lv.alias("_v")).select(label, F.transform("_v", lambda x: x / F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, y: s + y * y))).alias("_lv"))


#: Similarities are confidences from LOW on, the whole of it SPAN above; least confidences for a model and an industry.
LOW, SPAN, LEAST_MODEL, LEAST_INDUSTRY = 0.15, 0.45, 0.40, 0.35


def similarity_confidence(similarity: Column) -> Column:
    """A cosine as a confidence between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - LOW) / SPAN))


def second_tier(model: Column, model_similarity: Column, industry: Column, industry_similarity: Column) -> Column:
    """``struct(business_model, industry, confidence, model_confidence, industry_confidence)`` of the best labels by similarity; unsure ones are empty."""
    a, b = similarity_confidence(model_similarity), similarity_confidence(industry_similarity)
    half_up = lambda c: F.floor(c * 100 + 0.5) / 100
    return F.struct(
        F.when(a >= LEAST_MODEL, model).otherwise("").alias("business_model"), F.when(b >= LEAST_INDUSTRY, industry).otherwise("").alias("industry"),
        half_up(F.greatest(a, b)).alias("confidence"), half_up(a).alias("model_confidence"), half_up(b).alias("industry_confidence"),
    )


def merge_tiers(rule_label: Column, rule_confidence: Column, model_label: Column, model_confidence: Column, text_bytes: Column) -> Column:
    """The second tier fills a blank, or overrules an unsure first tier where it is sure itself."""
    asked = (rule_confidence < LEAST_CONFIDENCE) & (text_bytes > 20)
    return F.when(asked & ((filled(rule_label) == "") | ((model_confidence >= 0.5) & (rule_confidence < 0.45))), filled(model_label)).otherwise(filled(rule_label))
