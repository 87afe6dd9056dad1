"""Corpus analytics around validators: case names, verdict reports and page labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How a corpus names its cases, and how a finding ends with its clause.
CASE_NAME = r"(?i)([0-9]+(?:-[0-9]+)*)-t([0-9]+)-(pass|fail)-([a-z])\.pdf$"
CLAUSE = r"([0-9]+(?:\.[0-9]+)+)\s*$"


def case_of(path: Column) -> Column:
    """struct(clause, test, expected_pass, variant) of a case file's name, null if it is none."""
    part = lambda i: F.regexp_extract(path, CASE_NAME, i)
    made = F.struct(F.translate(part(1), "-", ".").alias("clause"), part(2).cast("int").alias("test"), (F.lower(part(3)) == "pass").alias("expected_pass"), part(4).alias("variant"))
    return F.when(path.rlike(CASE_NAME), made)


def clause_key(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CLAUSE, 1), F.lit(""))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, compliant, failed array<struct<clause, test>>) of XML reports: one `job` a file, in which a missing
    validation report counts as not compliant without clauses; failed rules are distinct."""
    schema = "item struct<name:string>, validationReport struct<_isCompliant:boolean,details:struct<rule:array<struct<_clause:string,_testNumber:int,_status:string>>>>"
    jobs = spark.read.format("xml").option("rowTag", "job").schema(schema).load(path)
    rules = F.coalesce(F.col("validationReport.details.rule"), F.array().cast("array<struct<_clause:string,_testNumber:int,_status:string>>"))
    failed = F.array_distinct(F.transform(F.filter(rules, lambda r: r["_status"] == "failed"), lambda r: F.struct(r["_clause"].alias("clause"), r["_testNumber"].alias("test"))))
    return jobs.select(F.regexp_extract("item.name", r"([^/\\]*)$", 1).alias("file_name"), F.coalesce("validationReport._isCompliant", F.lit(False)).alias("compliant"), F.array_sort(failed).alias("failed"))


def conflicting(verdicts: DataFrame) -> DataFrame:
    """File names that two reports judge differently."""
    return verdicts.groupBy("file_name").agg(F.count_distinct(F.struct("compliant", "failed")).alias("n")).where("n > 1").select("file_name")


def _roman(n: Column) -> Column:
    out = F.lit("")
    rest = n
    for value, text in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out = F.concat(out, F.repeat(F.lit(text), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def page_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages (doc_id, page_idx) with the label of the range of greatest start at or before the page; ranges: doc_id,
    start, style (D, R, r, A, a or null), prefix, first. Pages before the first range count from 1."""
    marks = ranges.select("doc_id", F.col("start").alias("page_idx"), F.lit(0).alias("kind"), F.struct("start", "style", "prefix", "first").alias("range"))
    both = pages.select("doc_id", "page_idx", F.lit(1).alias("kind")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("page_idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("r", F.last("range", True).over(w)).where("kind = 1")
    n = F.when(F.col("r").isNull(), F.col("page_idx") + 1).otherwise(F.col("page_idx") - F.col("r.start") + F.coalesce("r.first", F.lit(1))).cast("int")
    letter = F.repeat(F.char(F.lit(65) + (n - 1) % 26), F.floor((n - 1) / 26).cast("int") + 1)
    style = F.when(F.col("r").isNull(), "D").otherwise(F.col("r.style"))
    number = F.when(style == "D", n.cast("string")).when(style == "R", _roman(n)).when(style == "r", F.lower(_roman(n))).when(style == "A", letter).when(style == "a", F.lower(letter)).otherwise("")
    return at.select("doc_id", "page_idx", F.concat(F.coalesce("r.prefix", F.lit("")), number).alias("label"))
