"""Patterns that Spark expressions and the HTML parser share. They mean the same in Java and in Python."""

# Forms in which item numbers are written.
# two numbers: "Items 1 and 2"
PAIR = r"\bitems?\s+(\d{1,2}[a-z]?)\s*[.:]?\s+and\s+(\d{1,2}[a-z]?)\b"
# several numbers of a line, in lower case: "item 1a", "part ii 5.", "7a. quantitative"
SEVERAL = (
    r"item\s+(\d{1,2}[a-z]?)\b",
    r"part\s+[ivx]+\s*[.:-]?\s*(\d{1,2}[a-z]?)\s*[.:]",
    r"(?<!\d)(\d{1,2}[a-z]?)\s*[.:]\s*[a-z]",
)
# a single number, case ignored: "Item 1A", "1Business", "1. Business", "1 Business"
SINGLE = (
    r"item\s+(\d{1,2}[a-z]?)\b",
    r"\A\s*(\d{1,2}[a-z]?)(?=[a-z])",
    r"\A\s*(\d{1,2}[a-z]?)\s*[.:-]\s*[a-z]",
    r"\A\s*(\d{1,2}[a-z]?)\s+[a-z]",
)
#: The second of SINGLE without backtracking: a letter belongs to the number only if a capitalised word follows.
GLUED = r"\A\s*(\d{1,2}[A-Z]?)(?=[A-Z][a-z])"
