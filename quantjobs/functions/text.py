"""Column functions for localized numbers, dates and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(c: Column) -> Column:
    """``R$ 1.234,56`` and ``1234.56`` as a decimal; null where it is no number. A trailing minus or parentheses negate."""
    s = F.regexp_replace(F.trim(c), r"[R$\s\x{00A0}]", "")
    negative = s.rlike(r"^\(.*\)$|-$|^-")
    s = F.regexp_replace(s, r"[()\-+]", "")
    s = F.when(s.contains(","), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(s)
    v = F.when(s.rlike(r"^[0-9]+(\.[0-9]*)?$"), s).try_cast("decimal(18,4)")
    return F.when(negative, -v).otherwise(v).cast("decimal(18,4)")


def parse_date(c: Column) -> Column:
    """dd/mm/yyyy, dd/mm/yy, dd-mm-yyyy and yyyy-mm-dd as dates; null for anything else."""
    s = F.replace(F.trim(c), F.lit("-"), F.lit("/"))
    parts = F.split(s, "/")
    year = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    iso = F.when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))).when(s.rlike(r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$"), F.concat_ws("-", year, F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")))
    return F.to_date(F.try_to_timestamp(iso))


def plain(c: Column) -> Column:
    """Upper case, punctuation as single spaces."""
    return F.trim(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", " "))
