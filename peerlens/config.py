"""Fixed values of the domain and defaults of the operators."""

# Items of annual reports.
ITEMS_10K = {
    "1": "Business",
    "1A": "Risk Factors",
    "1B": "Unresolved Staff Comments",
    "1C": "Cybersecurity",
    "2": "Properties",
    "3": "Legal Proceedings",
    "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity",
    "6": "Selected Financial Data",
    "7": "Management's Discussion and Analysis",
    "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data",
    "9": "Changes in and Disagreements with Accountants",
    "9A": "Controls and Procedures",
    "9B": "Other Information",
    "9C": "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "10": "Directors, Executive Officers and Corporate Governance",
    "11": "Executive Compensation",
    "12": "Security Ownership of Certain Beneficial Owners and Management",
    "13": "Certain Relationships and Related Transactions",
    "14": "Principal Accounting Fees and Services",
    "15": "Exhibits, Financial Statement Schedules",
    "16": "Form 10-K Summary",
}
# Items of quarterly reports.
ITEMS_10Q = {
    "1": "Financial Statements",
    "2": "Management's Discussion and Analysis",
    "3": "Quantitative and Qualitative Disclosures About Market Risk",
    "4": "Controls and Procedures",
}
#: Items in scope by form; other forms keep all.
FORM_ITEMS = {"10-K": tuple(ITEMS_10K), "10-KA": tuple(ITEMS_10K), "10-Q": tuple(ITEMS_10Q), "10-QA": tuple(ITEMS_10Q)}
# Command-line codes of forms, as (form, folder).
FILING_CODES = {"6k": ("6-K", "6-K"), "8k": ("8-K", "8-K"), "10k": ("10-K", "10-K"), "10q": ("10-Q", "10-Q"), "20f": ("20-F", "20-F"), "40f": ("40-F", "40-F"), "10qa": ("10-Q/A", "10-QA"), "10ka": ("10-K/A", "10-KA")}
# Words of a chunk by item.
CHUNK_TOKENS = {
    "1": 400, "1A": 480, "1B": 160, "1C": 160, "2": 240, "3": 240, "4": 160, "5": 280, "6": 240, "7": 400, "7A": 240, "8": 480,
    "9": 160, "9A": 240, "9B": 160, "9C": 160, "10": 280, "11": 240, "12": 240, "13": 240, "14": 200, "15": 320, "16": 240,
}
DEFAULT_CHUNK_TOKENS = 280
# Input budgets by a part of the model's name, the first match counts.
MODEL_BUDGETS = (("8b", 6000), ("70b", 8000), ("3b", 3500))
DEFAULT_BUDGET = 4000
# Filings of a form in a year, for estimates.
FILINGS_A_YEAR = {"10-K": 4500, "10-Q": 13500}
OTHER_FILINGS_A_YEAR = 5000

Q_SHARE, TOP_SHARE = 0.10, 0.01
COSINE_WEIGHT, RERANK_WEIGHT = 0.3, 0.7
MAX_CHARS = 12_000
MIN_UNIT_TOKENS, MIN_UNITS = 80, 3
TARGET_WORDS, LOOKAHEAD = 1000, 12


def model_budget(name: str) -> int:
    """Words that a model takes at once."""
    return next((n for part, n in MODEL_BUDGETS if part in name.lower()), DEFAULT_BUDGET)
