"""Text normalisation, identifiers, clinical class labels, path handling: all plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FractionalType, IntegralType

UNRECOGNIZED = "unrecognized"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_meal_type(c) -> Column:
    s = F.regexp_replace(F.lower(F.trim(_c(c))), r"\s+", " ")
    return (F.when(_c(c).isNull(), F.lit(None).cast("string"))
            .when(s.isin("breakfast", "lunch", "dinner"), s)
            .when(s.rlike(r"^snacks?( ?[0-9]+)?$"), F.lit("snack"))
            .otherwise(F.lit(UNRECOGNIZED)))


def parse_numeric(c) -> Column:
    """Leading number of an annotated laboratory string."""
    return F.regexp_extract(_c(c), r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def is_annotated(c) -> Column:
    """The text holds a number followed by something else."""
    return parse_numeric(c).isNotNull() & ~_c(c).rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$")


def classify_a1c(v) -> Column:
    v = _c(v)
    return F.when(v < 5.7, "healthy").when(v <= 6.4, "pre-diabetes").when(v > 6.4, "t2d")


def classify_fasting_glucose(v) -> Column:
    v = _c(v)
    return F.when(v < 100, "healthy").when(v < 126, "pre-diabetes").when(v >= 126, "t2d")


def participant_number(c) -> Column:
    return F.regexp_extract(_c(c), r"([0-9]+)\s*$", 1).try_cast("bigint")


def id_number(c, kind: DataType) -> Column:
    """The number of an identifier cell: an integer as it is, a whole float as its integer and no other, text by its trailing digits."""
    c = _c(c)
    if isinstance(kind, IntegralType):
        return c.cast("bigint")
    if isinstance(kind, FractionalType):
        return F.when(c == F.floor(c), c.try_cast("bigint"))
    return participant_number(c.cast("string"))


def canonical_id(c) -> Column:
    """3.0 and '3' are one spelling; zero padding and letter case stay distinct."""
    t = F.trim(_c(c).cast("string"))
    return F.when(t.rlike(r"^([1-9][0-9]*|0)[.]0+$"), F.regexp_replace(t, r"[.]0+$", "")).otherwise(t)


def timestamp_shape(c) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(_c(c).cast("string"), "[0-9]", "d"), "[A-Za-z]", "a"), 1, 40)


def name_tokens(path) -> Column:
    """Distinct lower-case letter runs of a file's base name without its extension."""
    base = F.regexp_replace(F.regexp_extract(_c(path), r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.array_distinct(F.filter(F.split(F.lower(base), "[^a-z]+"), lambda t: F.length(t) > 0))


# fixed values: file classes, name hints and participant-like names
TABULAR = ("csv", "tsv", "parquet")
IMAGES = ("jpg", "jpeg", "png", "heic", "heif", "bmp", "gif", "tiff", "tif")
DOCS = ("md", "txt", "pdf", "docx", "yaml", "yml", "rtf")
DOC_HINT = r"(?i)(readme|license|licence|codebook|dictionary|metadata|documentation|methods|protocol|consent|changelog)"
PARTICIPANT_DIR = r"(?i)^(cgmacros[-_]?[0-9]+|subject[-_]?[0-9]+|participant[-_]?[0-9]+|p[0-9]{2,4}|s[0-9]{2,4}|[0-9]{2,4})$"
PARTICIPANT_STEM = r"(?i)^(cgmacros|subject|participant|p|s)[-_]?[0-9]+$"


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def file_class(path) -> Column:
    e = extension(path)
    name = F.regexp_extract(_c(path), r"([^/\\]*)$", 1)
    return (F.when(e.isin(*TABULAR), "tabular").when(e.isin(*IMAGES), "image").when(e.isin(*DOCS) | name.rlike(DOC_HINT), "doc").otherwise("other"))


def redact_path(path, folders: Column | None = None) -> Column:
    """Participant folders and participant-named files are replaced; both separators are understood, '/' is written.

    A part is a participant's wherever it stands if it names a participant folder: the path's own top folder, or one of `folders` (an array)."""
    parts = F.filter(F.split(F.regexp_replace(_c(path), r"\\", "/"), "/"), lambda p: p != "")
    last = F.size(parts) - 1
    top = F.when((last > 0) & F.element_at(parts, 1).rlike(PARTICIPANT_DIR), F.element_at(parts, 1))

    def one(p, i):
        stem, ext = F.regexp_replace(p, r"\.[^.]*$", ""), F.regexp_extract(p, r"(\.[^.]*)$", 1)
        own = F.coalesce(p == top, F.lit(False))
        if folders is not None:
            own = own | (F.array_contains(folders, p) & p.rlike(PARTICIPANT_DIR))
        return (F.when(own, F.lit("<participant_id>"))
                .when((i == last) & stem.rlike(PARTICIPANT_STEM), F.concat(F.lit("<participant_file>"), ext)).otherwise(p))
    return F.array_join(F.transform(parts, one), "/")
