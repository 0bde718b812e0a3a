"""Text functions as Spark columns. White space is Unicode white space unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerlens.functions import forms

#: A white-space character and its opposite, alike in Java and RE2.
WS, NOT_WS = r"[\t\n\x0B\f\r \x85\p{Z}]", r"[^\t\n\x0B\f\r \x85\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "))


def canonical(c: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line, stripped."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def mask_numbers(c: Column) -> Column:
    """Percentages, negative numbers in brackets and other numbers as PCT, NEG_NUM and NUM."""
    number = r"\$?\d[\d,]*(?:\.\d+)?"
    c = F.regexp_replace(c, rf"{number}\s*%", "PCT")
    return F.regexp_replace(F.regexp_replace(c, rf"\({number}\)", "NEG_NUM"), number, "NUM")


def token_count(c: Column) -> Column:
    """Words between white space; the stand-in for a model's tokenizer."""
    return F.regexp_count(c, F.lit(f"{NOT_WS}+"))


def words(c: Column) -> Column:
    """The words between white space, as an array."""
    return F.regexp_extract_all(c, F.lit(f"({NOT_WS}+)"), F.lit(1))


def head_and_tail(c: Column, most: int) -> Column:
    """Collapsed text; if it is longer than `most`, its two ends around a line of dots."""
    t, head = collapse(c), most // 2
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(head)), F.lit("\n...\n"), F.right(t, F.lit(most - head)))).otherwise(t)


def first_words(c: Column, n: int) -> Column:
    """The text as it is if it has at most n words, else its first n words joined by spaces."""
    w = words(c)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(c)


def item_id(c: Column) -> Column:
    """An item id without white space, in capitals."""
    return F.regexp_replace(F.upper(c), f"{WS}+", "")


def item_sort_key(c: Column) -> Column:
    """(number, suffix) of an item id; ids without a number come last, as 9999."""
    number = F.regexp_extract(c, r"([0-9]+)", 1)
    return F.struct(F.when(number == "", F.lit(9999)).otherwise(number.cast("int")).alias("number"), F.regexp_extract(c, r"[0-9]+([A-Z]*)", 1).alias("suffix"))


def without_line_artifacts(c: Column) -> Column:
    """Lines stripped, without empty lines, page lines and headings of the table of contents."""
    lines = F.transform(F.split(c, "\r\n|\r|\n"), lambda x: strip(x))
    page = r"\Apage[ \t]+[0-9]{1,4}([ \t]+of[ \t]+[0-9]{1,4})?\z"
    kept = F.filter(lines, lambda x: (x != "") & (F.lower(x) != "table of contents") & ~F.rlike(F.lower(x), F.lit(page)))
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?i)\btable of contents\b", " ")


def clean_title(c: Column) -> Column:
    """A title without the page number at its end."""
    c = F.regexp_replace(c, r"\s+[0-9]+\s*\z", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"\.\s*[0-9]+\s*\z", "."), r"[0-9]+\s*\z", ""))


def item_numbers(c: Column) -> Column:
    """All item numbers of a heading, each once: "Items 1 and 2" first, then "item N", "part X N." and "N." forms."""
    low = F.lower(c)
    found = [F.filter(F.array(F.regexp_extract(low, forms.PAIR, 1), F.regexp_extract(low, forms.PAIR, 2)), lambda x: x != "")]
    for pattern in forms.SEVERAL:
        found.append(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))
    return F.transform(F.array_distinct(F.concat(*found)), lambda x: F.upper(x))


def item_number(c: Column) -> Column:
    """The item number of a heading, null if there is none: "item N", "part X - item N", "NBusiness", "N. Abc", "N Abc".
    A letter belongs to the number only if no lower-case letter follows it."""
    first, _, *others = (f"(?i){p}" for p in forms.SINGLE)
    patterns = (first, forms.GLUED, *others)
    return F.upper(F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns)))


def accession(c: Column) -> Column:
    """The accession number within a file name; empty if there is none."""
    return F.regexp_extract(c, r"([0-9]{10}-[0-9]{2}-[0-9]{6})", 1)


def cik(c: Column) -> Column:
    """A numeric firm id with ten digits; anything else stays null."""
    t = F.btrim(c.cast("string"))
    return F.when(F.rlike(t, F.lit(r"\A[0-9]{1,10}\z")), F.lpad(t, 10, "0"))


def any_date(c: Column) -> Column:
    """A date written as yyyy-MM-dd, MM/dd/yyyy or yyyyMMdd; null for anything else."""
    t = F.btrim(c)
    shapes = ((r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "yyyy-MM-dd"), (r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z", "MM/dd/yyyy"), (r"\A[0-9]{8}\z", "yyyyMMdd"))
    return F.coalesce(*(F.when(F.rlike(t, F.lit(s)), F.call_function("try_to_date", t, F.lit(f))) for s, f in shapes))


def ixbrl_tags(html: Column) -> Column:
    """Tags of an inline XBRL filing: fiscal year, period end, trading symbols (each once, in order, capitals).

    The fiscal year falls back to the year of the period end.
    """
    inner = lambda name: rf"(?is)<ix:[a-z]+[^>]*name\s*=\s*[\"']dei:{name}[\"'][^>]*>(.*?)</ix:"
    bare = lambda x: collapse(F.regexp_replace(x, "<[^>]+>", " "))
    year = F.regexp_extract(bare(F.regexp_extract(html, inner("DocumentFiscalYearFocus"), 1)), r"([12][0-9]{3})", 1)
    period = F.nullif(bare(F.regexp_extract(html, inner("DocumentPeriodEndDate"), 1)), F.lit(""))
    symbols = F.transform(F.regexp_extract_all(html, F.lit(inner("TradingSymbol")), F.lit(1)), lambda x: F.upper(bare(x)))
    fallback = F.regexp_extract(period, r"([12][0-9]{3})", 1)
    return F.struct(
        F.coalesce(F.nullif(year, F.lit("")), F.nullif(fallback, F.lit(""))).cast("int").alias("fiscal_year"),
        period.alias("period_of_report"),
        F.array_distinct(F.filter(symbols, lambda x: x != "")).alias("ticker_symbols"),
    )
