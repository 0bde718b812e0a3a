"""Filing-index records: parsing, windows, first and last records, lookups, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.config import FILINGS_A_YEAR, LOOKAHEAD, OTHER_FILINGS_A_YEAR
from peerlens.functions import text as X


def parse_index(files: DataFrame, form: str | None = None) -> DataFrame:
    """Records of company.idx files. files: path, value (the whole file).

    Rows begin after the first line that holds `---`. A line with four or more `|` is split there; any other needs 98
    characters and is cut at 62, 74, 86 and 98. `form` keeps one form, exactly. Columns: company_name, form_type, cik,
    cik_padded, date_filed, file_name, accession_number, path, line_no.
    """
    lines = files.select("path", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "line"))
    rule = F.min(F.when(F.contains("line", F.lit("---")), F.col("line_no"))).over(Window.partitionBy("path"))
    rows = lines.withColumn("rule", rule).where("line_no > rule AND trim(line) <> ''")
    parts, piped = F.split("line", r"\|"), F.size(F.split("line", r"\|")) >= 5
    cuts = ((1, 62), (63, 12), (75, 12), (87, 12), (99, 100_000))
    rows = rows.where(piped | (F.length("line") >= 98))
    field = lambda i: F.btrim(F.when(piped, F.try_element_at(parts, F.lit(i + 1))).otherwise(F.substring("line", *cuts[i])))
    rows = rows.select(field(0).alias("company_name"), field(1).alias("form_type"), field(2).alias("raw"), field(3).alias("date_filed"), field(4).alias("file_name"), "path", "line_no")
    if form is not None:
        rows = rows.where(F.col("form_type") == form)
    bare = F.regexp_replace("raw", r"\A0+", "")
    return rows.select("company_name", "form_type", bare.alias("cik"), F.lpad("raw", 10, "0").alias("cik_padded"), "date_filed", "file_name", X.accession(F.col("file_name")).alias("accession_number"), "path", "line_no")


def first_filings(records: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The first record of every (cik_padded, year filed) in the given order, with filed_year."""
    dated = records.withColumn("filed_year", F.year(X.any_date(F.col("date_filed"))))
    w = Window.partitionBy("cik_padded", "filed_year").orderBy(*order)
    return dated.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def of_firms(records: DataFrame, firms: DataFrame, cik: str = "cik") -> DataFrame:
    """Records of the firms named in a table, each once; ids in any spelling."""
    return records.join(firms.select(X.cik(F.col(cik)).alias("cik_padded")).distinct(), "cik_padded", "left_semi")


def cik_list(records: DataFrame) -> DataFrame:
    return records.select("cik_padded").where("cik_padded IS NOT NULL").distinct().orderBy("cik_padded")


def filing_estimate(form: str, years: int) -> dict[str, int]:
    """How many filings and quarterly files are to be expected."""
    return {"filings": FILINGS_A_YEAR.get(form, OTHER_FILINGS_A_YEAR) * years, "quarters": 4 * years}


def estimates(form: Column, years: Column) -> list[Column]:
    """filing_estimate as columns: filings and quarters."""
    a_year = reduce(lambda e, kv: e.when(form == kv[0], kv[1]), FILINGS_A_YEAR.items(), F.when(F.lit(False), 0)).otherwise(OTHER_FILINGS_A_YEAR)
    return [(a_year * years).cast("int").alias("filings"), (years * 4).cast("int").alias("quarters")]


def fiscal_windows(spark: SparkSession, years: Sequence[int], lookahead: int = LOOKAHEAD) -> DataFrame:
    """fiscal_year, first_day, last_day: from January of the year to the end of the month `lookahead` after December."""
    fy = spark.createDataFrame([(int(y),) for y in sorted(set(years))], "fiscal_year INT")
    return fy.select("fiscal_year", F.make_date("fiscal_year", F.lit(1), F.lit(1)).alias("first_day"), F.last_day(F.add_months(F.make_date("fiscal_year", F.lit(12), F.lit(1)), lookahead)).alias("last_day"))


def in_fiscal_windows(records: DataFrame, years: Sequence[int], lookahead: int = LOOKAHEAD) -> DataFrame:
    """Records with each fiscal year whose window holds their date; windows overlap, so one record may count twice.

    The years are a list given by the caller, so the table of windows is broadcast whatever the records' number.
    """
    windows = F.broadcast(fiscal_windows(records.sparkSession, years, lookahead))
    dated = records.withColumn("_filed", X.any_date(F.col("date_filed")))
    return dated.join(windows, F.col("_filed").between(F.col("first_day"), F.col("last_day"))).drop("_filed", "first_day", "last_day")


def fiscal_counts(records: DataFrame, years: Sequence[int], lookahead: int = LOOKAHEAD) -> DataFrame:
    """fiscal_year, cik_count, filing_count."""
    return in_fiscal_windows(records, years, lookahead).groupBy("fiscal_year").agg(F.count_distinct("cik_padded").alias("cik_count"), F.count("*").alias("filing_count"))


def dedupe_accessions(records: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """One record for every accession number, the last in the given order; blank numbers are dropped."""
    w = Window.partitionBy("accession_number").orderBy(*order)
    there = records.where("accession_number IS NOT NULL AND trim(accession_number) <> ''")
    return there.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def download_status(records: DataFrame, targets: Sequence[int], exists: Column, failed: Column) -> DataFrame:
    """Adds status: failed_download, missing_fiscal_metadata, skipped_outside_target_fy, skipped_exists or downloaded,
    the first that holds. records need fiscal_year."""
    fy = F.col("fiscal_year")
    status = F.when(failed, "failed_download").when(fy.isNull(), "missing_fiscal_metadata").when(~fy.isin([int(t) for t in targets]), "skipped_outside_target_fy")
    return records.withColumn("status", status.when(exists, "skipped_exists").otherwise("downloaded"))


STATUSES = ("downloaded", "skipped_exists", "missing_fiscal_metadata", "failed_download", "skipped_outside_target_fy")


def status_report(statuses: DataFrame) -> DataFrame:
    """Counts of each status by fiscal year, and in total (fiscal_year null and is_total true)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return statuses.rollup("fiscal_year").agg(F.grouping("fiscal_year").cast("boolean").alias("is_total"), *counts)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The union with the first row of each key in the given order: put the latest first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_ids(asked: DataFrame, column: str, tickers: DataFrame) -> DataFrame:
    """Adds cik: numeric ids are padded, others looked up as tickers (ticker, cik), case ignored, the smallest cik of a
    ticker; null if neither works."""
    first = tickers.groupBy(F.upper(F.btrim("ticker")).alias("_t")).agg(F.min(X.cik(F.col("cik"))).alias("_looked_up"))
    number = X.cik(F.col(column))
    joined = asked.join(first, F.when(number.isNull(), F.upper(F.btrim(F.col(column)))) == F.col("_t"), "left")
    return joined.withColumn("cik", F.coalesce(number, F.col("_looked_up"))).drop("_t", "_looked_up")


def tickers_to_ciks(tickers: DataFrame) -> DataFrame:
    """ticker, ciks: all ids of a ticker, ascending."""
    return tickers.groupBy(F.upper(F.btrim("ticker")).alias("ticker")).agg(F.array_sort(F.collect_set(X.cik(F.col("cik")))).alias("ciks"))
