"""Derivations of one row, as Column functions without UDFs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
# Labels and short labels of document types, and the folder root in displayed paths.
TYPE_LABELS = {"CUSTOMER_PO": "Customer PO", "VENDOR_INVOICE": "Vendor Invoice", "VENDOR_DC": "Vendor DC", "COMPANY_INVOICE": "Company Invoice", "COMPANY_DC": "Company DC", "POD": "Proof of Delivery"}
TYPE_CODES = {"CUSTOMER_PO": "PO", "VENDOR_INVOICE": "VI", "VENDOR_DC": "VD", "COMPANY_INVOICE": "CI", "COMPANY_DC": "CD", "POD": "POD"}
FOLDER_ROOT = "/nas/cases"


def strip(x: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_opportunity(x: Column) -> Column:
    """443, SKY443, sky-443 and SKY-443 become SKY-443; anything else is stripped and upper-cased; null and empty stay."""
    v = F.upper(strip(x))
    return F.when(x.isNull() | (x == ""), x).when(v.rlike(r"(?U)^\d+$"), F.concat(F.lit("SKY-"), v)).when(v.rlike(r"(?U)^SKY\d+$"), F.regexp_replace(v, "^SKY", "SKY-")).otherwise(v)


def optional(x: Column) -> Column:
    """Stripped; null where nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def file_id(checksum: Column) -> Column:
    """A positive bigint out of a hex checksum: its first 15 digits."""
    return F.conv(F.substring(checksum, 1, 15), 16, 10).cast("long")


def camel(name: str) -> str:
    """The client's name of a column: case_id becomes caseId."""
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def response_json(df, *columns: str) -> Column:
    """The row as the client's JSON, nulls included."""
    return F.to_json(F.struct(*[df[c].alias(camel(c)) for c in columns]), {"ignoreNullFields": "false"})


def normalize_filename(x: Column) -> Column:
    """Spaces to underscores, and the last part of a path of either slash."""
    return F.element_at(F.split(F.replace(x, F.lit(" "), F.lit("_")), r"[/\\]"), -1)


def stored_filename(key: Column, name: Column) -> Column:
    """Eight hex digits of the key's hash before the name, so that a rerun gives the same name."""
    return F.concat(F.substring(F.md5(key), 1, 8), F.lit("_"), F.replace(name, F.lit(" "), F.lit("_")))


def megabytes(size: Column) -> Column:
    """Rounded half to even to two places; nothing is 0."""
    return F.coalesce(F.bround(size / F.lit(float(MIB)), 2), F.lit(0.0))


def rotated(rotation: Column, degrees: Column) -> Column:
    return F.pmod(F.coalesce(rotation, F.lit(0)) + degrees, F.lit(360))


def folder_path(case_id: Column, month: Column, number: Column) -> Column:
    """Null without a case."""
    return F.concat(F.lit(f"{FOLDER_ROOT}/"), case_id, F.lit("/"), month, F.lit("/SO-"), number)


def storage_path(base: Column, case_id: Column, month: Column, number: Column, kind: Column, name: Column) -> Column:
    """Null where number or month is missing, which is an error to report."""
    return F.concat(base, F.lit("/"), case_id, F.lit("/"), month, F.lit("/SO-"), number, F.lit("/"), kind, F.lit("/"), name)


def is_month(x: Column) -> Column:
    number = F.substring(x, 6, 2).try_cast("int")
    return F.coalesce(x.rlike(r"^\d{4}-\d{2}$") & number.between(1, 12), F.lit(False))


def month_label(month: Column, long: bool = False) -> Column:
    return F.date_format(F.to_date(month, "yyyy-MM"), "MMMM yyyy" if long else "MMM yyyy")


def month_of(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def size_label(size: Column) -> Column:
    kb, mb = F.format_string("%.1f KB", size / F.lit(1024.0)), F.format_string("%.1f MB", size / F.lit(float(MIB)))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < MIB, kb).otherwise(mb)


def kilobytes_label(size: Column) -> Column:
    return F.format_string("%.1f KB", size / F.lit(1024.0))


def date_label(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def datetime_label(at: Column) -> Column:
    return F.date_format(at, "MMM d, hh:mm a")


def _mapped(x: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(F.try_element_at(table, x), x)


def type_label(kind: Column) -> Column:
    return _mapped(kind, TYPE_LABELS)


def type_code(kind: Column) -> Column:
    return _mapped(kind, TYPE_CODES)


def short_number(number: Column) -> Column:
    return F.right(number, F.lit(6))


def details_preview(details: Column) -> Column:
    return F.substring(details, 1, 100)


def action_class(action: Column) -> Column:
    has = action.contains
    return F.when(has("CREATED"), "created").when(has("DELETED"), "deleted").when(has("UPDATED") | has("ROTATED"), "changed").otherwise("other")


def status_class(status: Column) -> Column:
    return F.when(status == "OPEN", "green").when(status == "IN_PROGRESS", "yellow").otherwise("gray")


def case_number(prefix: Column, n: Column) -> Column:
    """At least four digits; more where they are needed."""
    return F.concat(prefix, F.format_string("%04d", n))


def case_suffix(case_id: Column) -> Column:
    """The number after the last dash; null if there is none."""
    return F.element_at(F.split(case_id, "-"), -1).try_cast("int")
