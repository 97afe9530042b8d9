"""Vocabularies of the rule tier."""

from __future__ import annotations

# Companies and the spellings they go by, as whole words.
BUILDERS: dict[str, tuple[str, ...]] = {
    "DLF": ("dlf",),
    "M3M": ("m3m",),
    "Godrej Properties": ("godrej",),
    "Sobha": ("sobha",),
    "Signature Global": ("signature global", "signatureglobal", "signature glbl"),
    "Emaar India": ("emaar",),
    "Tata Housing": ("tata housing", "tata realty"),
    "Adani Realty": ("adani realty", "adani housing"),
    "Puravankara": ("puravankara", "purva"),
    "Central Park": ("central park",),
    "Vatika": ("vatika",),
    "Ireo": ("ireo",),
    "Unitech": ("unitech",),
    "Ansal API": ("ansal",),
    "BPTP": ("bptp",),
    "Raheja Developers": ("raheja",),
    "Experion Developers": ("experion",),
    "Elan Group": ("elan group", "elan "),
    "Smartworld Developers": ("smartworld", "smart world"),
    "Whiteland": ("whiteland",),
    "Trevoc": ("trevoc",),
    "AIPL": ("aipl",),
    "Conscient": ("conscient",),
    "Silverglades": ("silverglades", "silver glades"),
    "Anant Raj": ("anant raj",),
    "Pioneer Urban": ("pioneer urban",),
    "Mahindra Lifespaces": ("mahindra lifespace", "mahindra life"),
    "Shapoorji Pallonji": ("shapoorji", "joyville"),
    "ATS Infrastructure": ("ats infra", "ats greens", "ats "),
    "Gaursons": ("gaursons", "gaur "),
    "Supertech": ("supertech",),
    "Amrapali": ("amrapali",),
    "Jaypee Group": ("jaypee", "jaiprakash"),
    "Prateek Group": ("prateek",),
    "Eldeco": ("eldeco",),
    "Nirala World": ("nirala",),
    "Migsun": ("migsun",),
    "Ajnara": ("ajnara",),
    "Paras Buildtech": ("paras buildtech", "paras "),
    "County Group": ("county group",),
    "Lodha": ("lodha",),
    "Max Estates": ("max estates",),
    "Bharti Realty": ("bharti realty",),
    "Krisumi": ("krisumi",),
    "Trump Towers / Tribeca": ("tribeca", "trump tower"),
    "Sushma Group": ("sushma",),
    "Omaxe": ("omaxe",),
    "Ambience Group": ("ambience",),
    "Bestech": ("bestech",),
    "Orris Infrastructure": ("orris",),
    "SS Group": ("ss group",),
    "Suncity Projects": ("suncity",),
    "Hines": ("hines",),
    "Birla Estates": ("birla estates",),
    "Prestige Group": ("prestige group", "prestige estates"),
    "Runwal": ("runwal",),
    "Rise Infraventures": ("rise infra",),
    "Aarize": ("aarize",),
    "Navraj": ("navraj",),
    "Indiabulls Real Estate": ("indiabulls",),
    "Assotech": ("assotech",),
    "Mapsko": ("mapsko",),
    "Ramprastha": ("ramprastha",),
    "Tulip Infratech": ("tulip infratech", "tulip violet", "tulip white"),
}

# Topics of discussion, in the order in which equally frequent ones rank.
TOPICS: dict[str, str] = {
    "buying": r"\bbuy(ing)?\b|\bpurchas\w+|\bshould i buy\b|\bbooking\b",
    "selling": r"\bsell(ing)?\b|\bexit\b|\boffload\b",
    "renting": r"\brent(al|ing)?\b|\btenant\b|\blandlord\b|\blease\b",
    "builder_reputation": r"builder\s*(reputation|track record|history|quality)|reliable builder",
    "builder_fraud": r"fraud|cheat(ed|ing)?|scam|duped|misappropriat\w+|siphon\w*|ponzi|fake (promise|commitment)|eow complaint",
    "project_review": r"project review|review of|worth (buying|investing)",
    "construction_delay": r"delay(ed|s)?\b|behind schedule|stalled|slow (construction|progress)|not completed",
    "possession_issue": r"possession\s*(delay|issue|pending|date)|no possession|handover",
    "maintenance_issue": r"maintenance\s*(charge|issue|cost|fee)|cam charges|society dues|rwa",
    "society_review": r"society\b|apartment complex|rwa|gated community",
    "broker_experience": r"\bbroker\b|\bagent\b|\bdealer\b|brokerage",
    "investment_advice": r"invest(ment|ing)?\b|appreciation|capital gain|good (buy|investment)",
    "sector_recommendation": r"which sector|best sector|sector \d+ (or|vs)|recommend.*(sector|area)",
    "roi": r"\broi\b|return on investment|returns\b",
    "rental_yield": r"rental yield|yield\b|rent to price",
    "legal_issue": r"legal\b|litigation|court case|nclt|stay order|dispute|title (issue|clear)",
    "rera": r"\brera\b|harera|uprera|regulatory authority",
    "home_loan": r"home ?loan|\bemi\b|interest rate|pre[- ]?payment|loan (approval|sanction)|lap\b",
    "hidden_charges": r"hidden charge|extra charge|\bedc\b|\bidc\b|plc\b|preferential location|club (charge|membership)|ifms",
    "registration": r"registr(y|ation)|conveyance deed|sale deed|mutation",
    "stamp_duty": r"stamp duty|circle rate",
    "property_tax": r"property tax|house tax|mcg tax",
    "infrastructure": r"infrastructure|road (work|widening)|sewage|water supply|power cut|flooding|waterlogging",
    "metro": r"\bmetro\b|rapid metro|rrts|namo bharat",
    "dwarka_expressway": r"dwarka expressway|\bnpr\b|northern peripheral",
    "spr_road": r"\bspr\b|southern peripheral",
    "golf_course_road": r"golf course (ext(ension)?\s*)?road|\bgcr\b",
    "new_gurgaon": r"new gurgaon|new gurugram",
    "sohna_road": r"sohna road|sohna\b",
    "noida_expressway": r"noida (greater noida )?expressway|yamuna expressway",
    "market_outlook": r"market (trend|outlook|crash|bubble|correction)|price (rise|drop|trend)|appreciat\w+|oversupply",
}

# Sentiment terms, matched as parts of words.
POSITIVE = (
    "excellent", "great", "good", "happy", "satisfied", "recommend", "smooth", "on time", "timely", "quality", "worth", "best", "love", "impressed",
    "transparent", "hassle free", "no issues", "delivered", "appreciat", "premium", "well maintained", "responsive",
)
NEGATIVE = (
    "fraud", "scam", "cheat", "worst", "terrible", "horrible", "avoid", "regret", "delay", "delayed", "poor", "bad", "issue", "problem", "leak", "seepage",
    "harass", "litigation", "stuck", "pathetic", "overpriced", "misleading", "never buy", "don't buy", "dont buy", "stay away", "unprofessional",
    "no response", "cracks", "substandard",
)
NEGATORS = r"\b(not|no|never|isn'?t|wasn'?t|aren'?t|don'?t|didn'?t)\b"

# Words that are no keywords, and keywords that count five times more.
STOPWORDS = """
a an the and or but if of in on at to for with without from by is are was were be been being have has had do does did will would shall should can
could may might must this that these those i you he she it we they my your his her its our their me him them as so than then there here what which
who whom how why when where all any both each few more most other some such only own same too very just also into over under about after before
again further once
""".split()
BOOSTED = (
    "possession", "builder", "rera", "maintenance", "resale", "carpet", "registry", "loan", "yield", "sector", "society", "broker", "delay", "expressway",
    "metro", "investment", "rental", "construction",
)
