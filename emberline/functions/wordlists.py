"""The word lists and limits that the operators' rules are stated with."""

GENERIC_TAILS = "adaptability application applications approach capabilities capability deployment design device devices enhancement framework frameworks implementation integration mechanism method methods module modules optimization paradigm paradigms pipeline platform platforms protocol protocols scheme solution solutions stack strategy structure suite technologies technology tile tiles toolkit".split()
GENERIC_HEADS = "capabilities capability certification certifications component components deployment deployments ecosystem ecosystems foundation foundations framework frameworks infrastructure infrastructures offering offerings platform platforms portfolio portfolios processing product products service services solution solutions stack stacks suite suites system systems technologies technology tool tools".split()
TITLE_STOPS = "a an and at based for from in of on the to with using study towards и в во для на о об по при с со из как почему пока не".split()
TOO_BROAD_NAMES = ["artificial intelligence", "machine learning", "deep learning", "generative ai", "big data", "cloud computing", "blockchain", "cybersecurity", "robotics", "edge computing", "edge ai", "internet of things", "digital transformation", "agentic ai", "ai agents", "autonomous agents", "autonomous ai agents", "physical ai", "reinforcement learning", "computer vision", "quantum computing", "deep learning model", "искусственный интеллект", "машинное обучение"]
BANNED_WORDS = "тренд тренды перспективный перспективные будущее прорыв trend trends future".split()
FUNCTION_WORDS = "a an and at by for from in into of on the to with using systems system applications application technologies technology в во и для из к на о об по при с со у системы система технологии технология применение".split()
TOO_BROAD_PHRASES = ["энергетика", "новые материалы", "ии в медицине", "роботы для склада", "edge computing", "edge ai", "искусственный интеллект", "машинное обучение", "artificial intelligence", "machine learning"]
KEY_STOPS = "for and the of in on with to from as by based using".split()
FRESH_TAILS = ["startup raises", "startup funding round", "startup emerges from stealth", "startup launches", "seed round", "startup unveils", "researchers develop", "pilot deployment"]
SELF_PUBLISHED_DOI = ["10.5281", "10.13140", "10.6084"]
SELF_PUBLISHED_HOSTS = ["zenodo.org", "researchgate.net", "figshare.com"]
TRUST_BY_TYPE = {"paper": "high", "patent": "high", "gov": "high", "preprint": "medium", "report": "medium", "news": "medium", "blog": "low", "social": "low", "press_release": "low", "other": "low"}
BIG_COMPANIES = ["google", "microsoft", "nvidia", "amazon", "meta", "apple", "samsung", "intel", "amd", "cisco", "ibm", "qualcomm", "hp", "palo alto", "siemens", "visa", "stripe", "coinbase", "j.p. morgan", "jpmorgan", "openai", "anthropic", "claude", "check point", "dell", "arm", "sony", "huawei", "bosch", "honda", "akamai", "cloudflare", "swift", "google cloud"]
STARTUP_NEWS = r"\b(raises?|raised|funding|seed|series [a-d]|pre-seed|emerges? from stealth|stealth|startup|start-up|launch(es|ed)?|unveils?|debuts?|introduces?|spin-?out|backed|investors?)\b"
STAGES = {"research": ["концепц", "исследован"], "prototype": ["прототип", "poc", "пилот"], "product": ["раннее внедрение", "ранние внедрения", "ранняя серия", "серийн"], "mass": ["массов"]}
PLACEHOLDER = r"\b(?:фраза|phrase|name|название)\s*\d"
ANALYTICAL_TYPES = ["report", "gov"]
# What a reader sees for each feature; {} is the feature's value as reason_text() words it.
REASON_TEXTS = {
    "log_total_pubs": "Всего публикаций: {}",
    "log_pubs_last_year": "Публикаций за последний год: {}",
    "growth_3y": "Публикации растут на {}% в год",
    "recent_share": "{}% публикаций — за последние 3 года",
    "age_years": "Первые публикации — {} г.",
    "log_news_total": "Упоминаний в техмедиа: {}",
    "log_news_recent": "Упоминаний в техмедиа за 3 года: {}",
    "news_to_science": "Медиа-упоминаний на одну научную работу: {}",
    "preprint_share": "{}% публикаций — препринты",
}
NO_DATA = "нет данных"
WIKIPEDIA_TEXTS = {True: "Есть статья в Википедии", False: "Нет статьи в Википедии"}
