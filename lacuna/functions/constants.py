"""Fixed values of the domain: enumerations, weights, thresholds and vocabularies that results depend on."""

PRODUCT_TYPES = ["cross_section", "upper_limit", "efficiency_map", "likelihood", "covariance_matrix", "acceptance_table", "cutflow", "correlation_matrix", "other"]
GAP_STATUSES = ["published", "uncertain", "missing", "no_record"]
OPEN_STATUSES = ["missing", "uncertain", "no_record"]

#: How much a missing product of a type weighs; 1 for types not listed.
TYPE_WEIGHTS = {"likelihood": 3, "covariance_matrix": 3, "correlation_matrix": 3, "efficiency_map": 3, "acceptance_table": 3, "cutflow": 3, "upper_limit": 2, "cross_section": 2, "other": 1}
STRUCTURAL_TYPES = ["likelihood", "covariance_matrix", "correlation_matrix", "cutflow", "efficiency_map", "acceptance_table"]
STATUS_CREDIT = {"published": 1.0, "uncertain": 0.5, "missing": 0.0, "no_record": 0.0}

DUPLICATE_SIMILARITY = 0.90
PUBLISHED_OVERLAP = 0.60
PUBLISHED_SIMILARITY = 0.70
PUBLISHED_SCORE = 0.60
UNCERTAIN_SCORE = 0.42
STRUCTURAL_SIMILARITY = 0.50
TYPE_BONUS = 0.10
MIN_SPAN_CHARS = 20

#: Words of a part's name, description or resource type that fit a product type.
TYPE_PATTERNS = {
    "upper_limit": r"(?i)limit|exclu|contour",
    "likelihood": r"(?i)likelihood|histfactory|hs3|pyhf|\bnll\b",
    "covariance_matrix": r"(?i)covariance|correlation matri",
    "correlation_matrix": r"(?i)correlation",
    "efficiency_map": r"(?i)efficien|acceptance",
    "acceptance_table": r"(?i)acceptance|efficien",
    "cutflow": r"(?i)cut[\s-]*flow",
    "cross_section": r"(?i)cross[\s-]*section|xsec|sigma",
}

STOP_WORDS = "the a an of in for and to with is are as by on at from or this that be its their which these shown figure table".split()

DATA_STATEMENT_TITLE = r"(?i)data\s+availability|auxiliary\s+material|supplementa|hepdata|open\s+data|reinterpretation\s+material|additional\s+material"
RESULTS_TITLE = r"(?i)result|limit|interpretation|implication|conclusion|summary|combination|cross[\s-]*section|discussion|outlook|statistical"
SETUP_TITLE = r"(?i)introduction|detector|simulat|samples|monte\s+carlo|object|reconstruction|identification|acknowledg"
AVAILABILITY = (
    r"(?i)hepdata|rivet|pyhf|simpleanalysis|auxiliary\s+(material|figure|table)s?|supplementa|additional\s+(material|figure|table)s?"
    r"|\b(publicly|electronically|online)\s+available\b|\bavailable\s+(at|from|on|via|as)\s|\bprovided\s+(on|as|at)\s"
    r"|\bcan\s+be\s+found\s+(at|on|in\s+the\s+(auxiliary|supplementa|appendix))|https?://|\\url\b|\\href\b"
    r"|cut[\s-]*flows?|efficiency\s+maps?|covariance\s+matri|correlation\s+matri"
    r"|(full|public|statistical)\s+likelihoods?|likelihoods?\s+(is|are)\s+(published|released)"
)
PRODUCT_WORDS = (
    r"(?i)upper\s+limits?|exclusion\s+(limit|contour|region)s?|\b(are|is)\s+excluded\b"
    r"|(fiducial|differential|inclusive|total|production)\s+cross[\s-]*sections?|cross[\s-]*sections?\s+(is|are|was|were)\s+measured"
    r"|unfolded\s+(data|distributions?|cross[\s-]*sections?|results?)|likelihood\s+scan|acceptance\s*(times|\\times|×)?\s*efficienc"
)
#: Any match of the two holds one of these, in lower case.
AVAILABILITY_HINTS = ["hepdata", "rivet", "pyhf", "simpleanalysis", "auxiliary", "supplementa", "additional", "available", "provided", "found", "http", "\\url", "\\href", "flow", "efficiency", "covariance", "correlation", "likelihood"]
PRODUCT_HINTS = ["limit", "exclu", "section", "unfolded", "likelihood", "acceptance"]
CAPTION_DATA = (
    r"(?i)distribution|\bdata\b|observed|measured|yields?\b|limits?\b|cross[\s-]*sections?|efficienc|acceptance|likelihood"
    r"|covariance|correlation|cut[\s-]*flow|exclu|unfold|fiducial|best[\s-]*fit|uncertaint"
)
FEYNMAN = r"(?i)feynman"
DIAGRAM = r"(?i)diagram|schematic|illustrat|sketch"

#: What statuses, types and severities are called.
STATUS_LABELS = {"missing": "Missing from HEPData", "no_record": "No HEPData record", "uncertain": "Needs review", "published": "On HEPData"}
TYPE_LABELS = {
    "cross_section": "Cross-section", "upper_limit": "Upper limit", "efficiency_map": "Efficiency map", "likelihood": "Likelihood", "covariance_matrix": "Covariance matrix",
    "acceptance_table": "Acceptance table", "cutflow": "Cut-flow", "correlation_matrix": "Correlation matrix", "other": "Other result",
}
SEVERITY_LABELS = {0: "Not a gap", 1: "Low", 2: "Medium", 3: "High"}
