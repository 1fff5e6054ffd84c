"""Scalar functions over text, dates, JSON and arrays."""
from pyspark.sql import Column, functions as F

from tidemark.operators.sessions import local_wall

# SIC divisions as (letter, name, first and last two-digit major group).
SIC_DIVISIONS = (
    ("A", "Agriculture, Forestry and Fishing", 1, 9),
    ("B", "Mining", 10, 14),
    ("C", "Construction", 15, 17),
    ("D", "Manufacturing", 20, 39),
    ("E", "Transportation, Communications, Electric, Gas and Sanitary Services", 40, 49),
    ("F", "Wholesale Trade", 50, 51),
    ("G", "Retail Trade", 52, 59),
    ("H", "Finance, Insurance and Real Estate", 60, 67),
    ("I", "Services", 70, 89),
    ("J", "Public Administration", 91, 99),
)


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def pad_cik(col) -> Column:
    """F1."""
    return F.lpad(_c(col).cast("bigint").cast("string"), 10, "0")


ACCESSION = r"^\d{10}-\d{2}-\d{6}$"


def accession_dir(col) -> Column:
    """F2. The directory form of a well-shaped accession, else null."""
    return F.when(F.rlike(_c(col), F.lit(ACCESSION)), F.replace(_c(col), F.lit("-"), F.lit("")))


def item_numbers(col) -> Column:
    """F3. Sorted distinct item numbers found in free text; empty for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(r"\b(\d\.\d{2})\b"), F.lit(1))))


MASTER_NAME = r"edgar/data/(\d+)/(\d{10}-\d{2}-\d{6})\.txt"


def split_master_name(col) -> Column:
    """F4. (cik, accession) of an index file name; null where the name has another shape."""
    name = _c(col)
    fits = F.rlike(name, F.lit("^" + MASTER_NAME + "$"))
    return F.when(fits, F.struct(F.lpad(F.regexp_extract(name, MASTER_NAME, 1), 10, "0").alias("cik"), F.regexp_extract(name, MASTER_NAME, 2).alias("accession")))


# Corporate suffixes that carry no identity.
COMPANY_SUFFIX_PATTERN = r"[,.]?\s*(inc|incorporated|corp|corporation|co|ltd|llc)\.?\s*$"


def norm_company(col) -> Column:
    """F5. Lower-case trimmed name without a trailing corporate suffix."""
    return F.trim(F.regexp_replace(F.lower(F.trim(_c(col))), COMPANY_SUFFIX_PATTERN, ""))


def sic_division(col) -> Column:
    """F6. Division letter of a four-digit SIC code; null outside the table."""
    group = F.when(F.rlike(_c(col), F.lit(r"^\d{4}$")), F.substring(_c(col), 1, 2).cast("int"))
    out = F.lit(None).cast("string")
    for letter, _, low, high in SIC_DIVISIONS:
        out = F.when(group.between(low, high), letter).otherwise(out)
    return out


def sic_division_name(letter) -> Column:
    out = F.lit(None).cast("string")
    for key, name, _, _ in SIC_DIVISIONS:
        out = F.when(_c(letter) == key, name).otherwise(out)
    return out


def sector_group(division) -> Column:
    """F7. D, I or other; a division the grouping does not name is null."""
    d = _c(division)
    return F.when(d.isin("D", "I"), d).when(d.isin("B", "E", "F", "G"), "other")


def row_digest(*cols) -> Column:
    """F8. Content hash of a row: columns in name order, nulls kept apart from empty text."""
    named = sorted(cols)
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in named]), 256)


def seed_for(base: int, *cols) -> Column:
    """F9. Base plus the first 15 hex digits of a content hash (15 so that it stays inside a bigint)."""
    return F.lit(base) + F.conv(F.substring(F.sha2(F.concat_ws("|", *[_c(c).cast("string") for c in cols]), 256), 1, 15), 16, 10).cast("bigint")


def hash_draw(modulo, *parts) -> Column:
    """A portable draw in 0..modulo-1 from the first 8 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[_c(p).cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint") % modulo


def local_day(ts, zone) -> Column:
    """F10."""
    return F.to_date(local_wall(_c(ts), zone))


def local_minute(ts, zone) -> Column:
    return F.date_format(local_wall(_c(ts), zone), "HH:mm")


def quarter_label(day) -> Column:
    return F.concat(F.year(_c(day)).cast("string"), F.lit("Q"), F.quarter(_c(day)).cast("string"))


def local_midnight(day, zone) -> Column:
    return F.to_utc_timestamp(_c(day).cast("timestamp"), zone)


def filing_available(accepted, filed, zone) -> Column:
    """F11. Acceptance plus two minutes, not before local midnight of the filing date; null when accepted at or after 17:30 local."""
    local = local_wall(_c(accepted), zone)
    late = F.hour(local) * 60 + F.minute(local) >= 1050
    return F.when(~late, F.greatest(_c(accepted) + F.expr("interval 2 minutes"), local_midnight(filed, zone)))


def release_available(published, precision, zone) -> Column:
    """F12. A minute later; a release dated by day only is available at the next local midnight."""
    p = _c(published)
    nxt = local_midnight(F.date_add(F.to_date(local_wall(p, zone)), 1), zone)
    return F.when(_c(precision) == "day", nxt).otherwise(p + F.expr("interval 1 minute"))


def feature_cutoff(open_utc, minutes=15) -> Column:
    """F13. The clock features are frozen at: some minutes before the scheduled open."""
    return _c(open_utc) - F.make_dt_interval(mins=F.lit(minutes))


def json_field(col, path, dtype="string") -> Column:
    """F14. A typed value from a JSON text."""
    return F.get_json_object(_c(col), path).cast(dtype)


def first_present(*cols) -> Column:
    """F15. First non-null value and the name of the column it came from."""
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in cols])
    return F.struct(F.coalesce(*[F.col(c) for c in cols]).alias("value"), source.alias("field"))
