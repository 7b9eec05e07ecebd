"""Fixed values that results depend on; policy, not logic."""

# Spellings of the state, and places that count with one of them.
STATE_SPELLINGS = ["ca", "calif", "california"]
CITIES = [
    "san francisco", "south san francisco", "daly city", "colma", "brisbane", "pacifica", "san bruno", "millbrae", "burlingame", "hillsborough",
    "san mateo", "foster city", "belmont", "san carlos", "redwood city", "atherton", "menlo park", "east palo alto", "palo alto", "woodside",
    "portola valley", "half moon bay", "mountain view", "los altos", "los altos hills", "sunnyvale", "cupertino", "santa clara", "san jose",
    "milpitas", "campbell", "los gatos", "saratoga", "oakland", "emeryville", "alameda", "berkeley", "albany", "el cerrito", "richmond", "san pablo",
    "pinole", "hercules", "piedmont", "san leandro", "castro valley", "hayward", "union city", "newark", "fremont", "orinda", "lafayette", "moraga",
    "walnut creek", "pleasant hill", "concord", "martinez", "dublin", "pleasanton", "san ramon", "danville", "sausalito", "mill valley", "tiburon",
    "belvedere", "corte madera", "larkspur", "ross", "san anselmo", "fairfax", "san rafael", "novato", "vallejo", "benicia",
]
PLACES = [*CITIES, "sf", "s f", "san fran", "south sf", "bay area", "silicon valley"]
QUALIFIERS = ["county", "hybrid", "remote", "onsite", "on site", "in office"]
REGIONS = ["san francisco bay area", "sf bay area", "s f bay area"]
OTHER_STATES = [
    "ak", "al", "ar", "az", "co", "ct", "dc", "de", "fl", "ga", "hi", "ia", "id", "il", "in", "ks", "ky", "la", "ma", "md", "me", "mi", "mn", "mo",
    "ms", "mt", "nc", "nd", "ne", "nh", "nj", "nm", "nv", "ny", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "va", "vt", "wa", "wi",
    "wv", "wy",
]
SCOPE_VERSION = "sf-bay-area-roughly-one-hour-v1"

# Hosts and query parameters of links.
AGGREGATORS = ["applyguy.ai", "simplify.jobs"]
TRACKING = ["fbclid", "gclid", "gh_src", "ref", "referrer", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
ALWAYS_TRACKING = ["fbclid", "gclid", "gh_src"]
PRESENTATION = ["ref", "referrer", "source", "embed"]
PRESENTATION_HOSTS = ["ashbyhq.com", "greenhouse.io", "lever.co", "myworkdayjobs.com", "rippling.com", "smartrecruiters.com", "icims.com", "amazon.jobs", "lifeattiktok.com", "jobs.bytedance.com"]
PROVIDER_HOSTS = {"greenhouse": "greenhouse.io", "ashby": "ashbyhq.com", "lever": "lever.co", "workday": "myworkdayjobs.com"}

# Titles that a feed without categories is filtered by, and eligible levels.
TITLE_TOKENS = ["software engineer", "software development", "software developer", "swe", "full stack", "full-stack", "frontend", "front end", "backend", "back end", "mobile engineer", "android engineer", "ios engineer", "site reliability", "sre"]
LEVELS = ["New Grad", "Entry Level"]

# Markers of the tables in Markdown feeds, by category.
TABLE_MARKERS = {
    "FAANG+": ("<!-- TABLE_FAANG_START -->", "<!-- TABLE_FAANG_END -->"),
    "Quant": ("<!-- TABLE_QUANT_START -->", "<!-- TABLE_QUANT_END -->"),
    "Other": ("<!-- TABLE_START -->", "<!-- TABLE_END -->"),
}

# Names of field types.
FIELD_TYPES = {
    "address": "address", "boolean": "boolean", "checkbox": "checkbox", "checkboxes": "multi_select", "date": "date", "datetime": "date",
    "email": "email", "file": "file", "input_file": "file", "input_text": "text", "long_text": "long_text", "multi_select": "multi_select",
    "multi_value_single_select": "single_select", "single_value_single_select": "single_select", "multi_value_multi_select": "multi_select",
    "single_value_multi_select": "multi_select", "multiselect": "multi_select", "number": "number", "phone": "phone", "radio": "radio",
    "select": "single_select", "single_select": "single_select", "tel": "phone", "text": "text", "textarea": "long_text", "url": "url",
}

# Terms of question categories; the first category with a term wins.
DEMOGRAPHIC = ["demographic", "eeo", "gender", "race", "ethnicity", "veteran", "disability", "self-identif"]
AUTHORIZATION = ["sponsor", "work authorization", "authorized to work", "right to work", "employment eligibility", "citizen", "citizenship", "visa", "immigration"]
LATER_CATEGORIES = {
    "resume_documents": ["resume", "curriculum vitae", "cv", "cover letter", "portfolio", "writing sample"],
    "education": ["university", "college", "school", "degree", "major", "minor", "graduat", "gpa", "education"],
    "experience": ["years of experience", "work experience", "previous internship", "programming language", "technical skill", "years' experience"],
    "location_logistics": ["relocat", "preferred office", "office location", "start date", "availability", "commute", "work location"],
    "profile": ["first name", "last name", "full name", "email", "phone", "linkedin", "github", "website", "address", "postal code", "zip code", "city", "state", "country"],
    "job_specific": ["why ", "tell us", "describe ", "project", "interested in", "motivat", "anything else", "additional information", "proud of"],
}

# Phrases of pages that can't be filled in.
CAPTCHA = ["captcha", "recaptcha", "hcaptcha", "cloudflare challenge", "verify you are human", "bot verification", "security check"]
CLOSED = ["job no longer available", "position has been filled", "application closed", "this job is no longer available", "job is no longer available"]
LOGIN = ["sign in", "log in", "create account", "create an account", "verification code"]
REASONS = {
    "closed": "Application appears to be closed.",
    "captcha": "Application page requires anti-bot verification.",
    "login_fields": "Additional application questions require authentication.",
    "login": "Application page requires authentication.",
    "steps": "Only the visible first step was inspected; later steps may contain more questions.",
    "fields": "Only publicly visible static fields were inspected; dynamic or conditional fields may remain.",
    "none": "No publicly accessible application form fields were detected.",
}

# Parts of metadata keys that mustn't be kept.
SENSITIVE = ["auth", "cookie", "csrf", "localstorage", "password", "secret", "session", "token"]
ALERT_RETENTION_DAYS, SCAN_ATTEMPTS = 21, 2
