"""The default scoring profile and word lists: fixed values that results depend on."""

from __future__ import annotations

# Fixed values.
ROLE_FAMILIES = [  # id, label, priority; equal priorities keep this order
    ("java_backend", "Java Backend", 100.0),
    ("java_react_fullstack", "Java + React Full Stack", 95.0),
    ("node_backend", "Node.js Backend", 85.0),
    ("node_react_fullstack", "Node.js + React Full Stack", 85.0),
    ("software_engineering_general", "General Software Engineering", 0.0),
]
PRIMARY_SKILLS = [  # name, aliases, weight
    ("Java", ["java"], 6.0),
    ("Spring / Spring Boot", ["spring boot", "spring framework", "spring"], 5.0),
    ("React", ["react.js", "reactjs", "react"], 4.0),
    ("Node.js", ["node.js", "nodejs", "node js"], 4.0),
    ("TypeScript", ["typescript"], 3.0),
    ("JavaScript", ["javascript", "ecmascript"], 3.0),
]
SUPPORTING_SKILLS = [
    ("SQL / PostgreSQL", ["postgresql", "postgres", "sql"], 2.0),
    ("AWS", ["amazon web services", "aws", "ec2", "s3", "lambda"], 3.0),
    ("Terraform", ["terraform", "infrastructure as code", "iac"], 1.5),
    ("Docker", ["docker", "containerization", "containers"], 2.0),
    ("CI/CD", ["ci/cd", "continuous integration", "continuous delivery", "circleci"], 2.0),
    ("JUnit / Testing", ["junit", "unit testing", "automated testing"], 1.0),
    ("Observability", ["opentelemetry", "otel", "grafana", "prometheus", "observability", "monitoring"], 1.5),
    ("Performance Engineering", ["performance optimization", "performance engineering", "latency", "performance regression"], 1.0),
    ("Large-scale Product Engineering", ["scalable", "large scale", "large-scale", "millions of users", "high scale"], 1.0),
]
DEMONSTRATED = ["TypeScript", "JavaScript", "AWS", "Terraform", "CI/CD", "Observability", "Performance Engineering", "Large-scale Product Engineering"]  # the others stand in the resume
TITLE_EXCLUSIONS = [
    "engineering manager", "software engineering manager", "director of engineering", "principal engineer", "principal software",
    "staff software engineer", "staff engineer", "ios engineer", "ios developer", "android engineer", "android developer",
    "data scientist", "machine learning engineer", "ml engineer", "research scientist", "qa engineer", "quality assurance", "sdet",
    "devops engineer", "site reliability engineer",
]
SIGNALS = {
    "java": ["java"],
    "spring": ["spring boot", "spring framework", "spring"],
    "backend": ["backend", "back-end", "server side", "server-side"],
    "rest_api": ["rest api", "restful", "api", "web services"],
    "microservices": ["microservices", "microservice"],
    "distributed_systems": ["distributed systems", "distributed system"],
    "sql": ["postgresql", "postgres", "sql", "mysql", "relational database"],
    "react": ["react", "reactjs", "react.js"],
    "node": ["node.js", "nodejs", "node js"],
    "typescript": ["typescript"],
    "javascript": ["javascript", "ecmascript"],
    "fullstack": ["full stack", "full-stack", "fullstack"],
}
REQUIRED_HEADINGS = ["required qualifications", "minimum qualifications", "required skills", "requirements", "what you need", "what youll need", "must have", "basic qualifications"]
PREFERRED_HEADINGS = ["preferred qualifications", "preferred skills", "nice to have", "good to have", "bonus", "desired qualifications"]
HIGH, GOOD, RELEVANT, LOW = 80.0, 65.0, 50.0, 35.0
YEARS, REJECT_YEARS = 5.0, 8.0
PRIMARY_CAP, SUPPORTING_CAP = 25.0, 15.0
NEAR_DUPLICATE = 0.90
RULESET = "location-rules-1"

# Coarse location groups, in order of precedence.
COARSE_LOCATIONS = [
    (["bengaluru", "bangalore"], "Bengaluru, India"),
    (["gurugram", "gurgaon"], "Gurugram, India"),
    (["noida"], "Noida, India"),
    (["hyderabad"], "Hyderabad, India"),
    (["pune"], "Pune, India"),
    (["chennai"], "Chennai, India"),
    (["mumbai"], "Mumbai, India"),
    (["delhi", "new delhi"], "Delhi, India"),
    (["india"], "India"),
]
FOREIGN_PLAIN = [
    "united states", "usa", "canada", "united kingdom", "uk", "singapore", "australia", "germany", "france", "ireland", "poland",
    "romania", "netherlands", "spain", "sweden", "switzerland", "japan", "korea", "brazil", "mexico",
]
FOREIGN_REMOTE = ["united states", " usa ", "canada", "united kingdom", "singapore", "australia", "germany", "france", "ireland", "poland", "romania"]
TITLE_REPLACEMENTS = [
    ("software development engineer", "software engineer"),
    ("sde ii", "software engineer 2"),
    ("sde 2", "software engineer 2"),
    ("software engineer ii", "software engineer 2"),
    ("software engineer - ii", "software engineer 2"),
    ("sr software engineer", "senior software engineer"),
]

# The quality gate's words.
ROLE_NOUNS = [
    "engineer", "developer", "manager", "analyst", "architect", "scientist", "designer", "consultant", "specialist", "director", "lead",
    "intern", "associate", "recruiter", "administrator", "coordinator", "executive", "officer", "principal", "staff", "head", "counsel",
    "attorney", "accountant", "controller", "researcher", "programmer", "technologist", "partner", "representative", "sre", "sdet",
    "devops", "qa",
]
AUTHORITATIVE = ["greenhouse", "lever", "ashby", "workday", "smartrecruiters", "amazon_json", "cohesity_json", "eightfold_pcsx"]
ACTION_ONLY = [
    "apply", "apply now", "learn more", "read more", "see details", "view details", "view role", "view job", "view jobs", "view all jobs",
    "browse jobs", "search jobs", "see jobs", "explore jobs", "explore opportunities", "see open positions",
]
NAVIGATION = [
    "jobs", "careers", "open roles", "open positions", "all jobs", "all teams", "engineering", "sales", "support", "customer support",
    "products", "product", "developers", "development", "marketing", "finance", "legal", "security", "operations", "design", "data",
    "software", "ai and machine learning", "candidate resources", "candidate resources hub", "career growth", "benefits and perks",
    "awards", "talent community", "life at navi", "jobs at navi", "teams at navi", "values at navi", "explore more", "contact sales",
    "contact support",
]
NAVIGATION_STARTS = ["contact ", "explore ", "browse ", "discover ", "view all ", "learn "]
NAVIGATION_PATTERN = (
    r"(?i)(?:\b(?:privacy|cookie|terms|policy|careers?)\b|\b(?:benefits?|perks?|awards?|resources?|"
    r"teams?|culture|values?|products?|solutions?|developers?)\b|\blife\s+at\b|"
    r"\bjobs?\s+at\b|\bteams?\s+at\b|\bvalues?\s+at\b|\bcandidate\s+resources?\b|"
    r"\bcareer\s+growth\b|\bask questions,?\s*report bugs\b)"
)
DETAIL_MARKERS = [
    "job", "jobs", "jobdetail", "requisition", "requisitions", "position", "positions", "opening", "openings", "vacancy", "vacancies",
    "details",
]
LISTING_TAILS = ["search", "search-results", "all", "open", "list", "listing", "categories", "category"]
JOB_QUERY_KEYS = [
    "jobid", "job_id", "jid", "gh_jid", "reqid", "req_id", "requisitionid", "requisition_id", "positionid", "position_id", "postingid",
    "posting_id",
]
TITLE_HINTS = [
    "engineer", "engineering", "developer", "manager", "analyst", "architect", "scientist", "designer", "consultant", "specialist",
    "director", "lead", "intern", "associate", "member", "technical", "product", "sales", "marketing", "finance", "legal", "recruiter",
    "operations", "support", "security", "qa", "sdet", "devops", "data", "software",
]
GENERIC_LABELS = ["jobs", "careers", "open roles", "open positions", "view jobs", "view all jobs", "see jobs", "search jobs", "explore jobs", "apply", "apply now", "learn more"]
