"""Payroll files read with a record of what did not parse.

Lines with too few or too many fields are kept as they are, and every cell whose text is not of the
column's type is named. `payroll.load_payroll` makes such cells null without a word; `accepted` gives the same rows,
less the damaged lines. Everything is decided row by row, in one pass over the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stipendia.functions.scalars import parsed_date
from stipendia.schema import RAW_TYPES
from stipendia.sources.payroll import conform, snake
from stipendia.sources.sinks import write_table

LINE, FAULTS = "_line", "_faults"
DATES = ["agency_start_date"]


def _fields(line: Column) -> Column:
    """Fields of a line: separators outside quotes, and one."""
    return F.length(F.regexp_replace(line, r'"(""|[^"])*"|[^,]', "")) + 1


def _fault(column: str, reason: str, condition: Column) -> Column:
    found = F.struct(F.lit(column).alias("column_name"), F.lit(reason).alias("reason"))
    return F.when(condition, found)


def checked(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """All records as text, with the damaged line (else null) and the list of faults (empty if there are none).

    Column names come from the header; files without one need `names`. Blank text is a missing value, not a fault. A
    damaged line has the faults of the line only, because its cells may be those of other columns.
    """
    header = names is None
    found = spark.read.csv(path, header=True, escape='"').columns if header else names
    columns = [snake(c) for c in found]
    schema = StructType([StructField(c, StringType()) for c in [*columns, LINE]])
    # Pruned columns would not be counted, and a line with too many or too few would pass.
    text = spark.read.options(
        header=header, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=LINE,
        columnPruning=False, enforceSchema=True).schema(schema).csv(path)
    line, wanted = F.col(LINE), len(columns)
    faults = [
        _fault("line", "missing fields", line.isNotNull() & (_fields(line) < wanted)),
        _fault("line", "extra fields", line.isNotNull() & (_fields(line) > wanted)),
        _fault("line", "unreadable", line.isNotNull() & (_fields(line) == wanted)),
    ]

    def bad(column: str, parsed: Column) -> Column:
        return line.isNull() & parsed.isNull() & (F.trim(F.col(column)) != "")

    for c in columns:
        kind = RAW_TYPES.get(c, "string")
        if kind != "string":
            faults.append(_fault(c, f"not {kind}", bad(c, F.col(c).try_cast(kind))))
        if c in DATES:
            faults.append(_fault(c, "not a date", bad(c, parsed_date(F.col(c)))))
    return text.withColumn(FAULTS, F.filter(F.array(*faults), lambda f: f.isNotNull()))


def accepted(checks: DataFrame, strict: bool = False) -> DataFrame:
    """Records of whole lines with their types; `strict` leaves out records with any fault."""
    # Spark doesn't read the column of damaged lines alone, so lines are told by their faults.
    whole = F.size(FAULTS) == 0 if strict else ~F.exists(FAULTS, lambda f: f["column_name"] == "line")
    return conform(checks.where(whole).drop(LINE, FAULTS))


def rejected(checks: DataFrame) -> DataFrame:
    """Records with a fault, as text, for the quarantine table."""
    return checks.where(F.size(FAULTS) > 0)


def quarantine(checks: DataFrame, path: str) -> None:
    """The rejected records as a table, to be read again when the file is mended."""
    write_table(rejected(checks), path)


def fault_counts(checks: DataFrame) -> DataFrame:
    """Records by column and reason; a record with several faults counts for each."""
    each = checks.select(F.explode(FAULTS).alias("fault"))
    return each.groupBy("fault.column_name", "fault.reason").agg(F.count("*").alias("records"))
