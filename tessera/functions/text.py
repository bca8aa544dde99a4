"""Value rules of records as Column expressions: white space, case, numbers, lists, measurements, escapes and redaction.

Texts follow the rules of crawled data: white space is all Unicode white space and the byte order mark, null stays null, and
a value that a rule can't read comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{FEFF}]"
TRUE_WORDS, FALSE_WORDS = ("yes", "true", "1", "available"), ("no", "false", "0", "unavailable")
# Currency marks and codes that a price may carry.
CURRENCY_MARKS = "$€£¥"
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR", "BRL")
# Grams and millimetres in a unit.
MASS = {"g": 1.0, "kg": 1000.0, "oz": 28.349523125, "lb": 453.59237}
LENGTH = {"mm": 1.0, "cm": 10.0, "m": 1000.0}
# Words that headers and fields share too often to tell anything.
STOP_WORDS = ("the", "and", "or", "for", "when", "present", "string", "number", "value", "record", "records", "page", "field")
# Shapes of secrets.
SECRETS = (
    r"\bsk-[a-zA-Z0-9]{20,}\b",
    r"(?i)\bBearer\s+[a-zA-Z0-9._-]{20,}\b",
    r"\bey[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b",
    r"\bsk_live_[a-zA-Z0-9]{20,}\b",
    r"\bsk_test_[a-zA-Z0-9]{20,}\b",
    r"\bor-[a-zA-Z0-9]{20,}\b",
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(as_column(text), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column | str) -> Column:
    """Ends stripped, and each run of white space as one space."""
    return strip(F.regexp_replace(as_column(text), rf"(?U){SPACE}+", " "))


def title_case(text: Column | str) -> Column:
    """Each word, by any white space, with its first letter upper and the rest lower."""
    words = F.regexp_extract_all(as_column(text), F.lit(rf"(?U){SPACE}+|[^\s\x{{FEFF}}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))), "")


def normalize_text(text: Column | str, *, trim: bool = True, squeeze: bool = True, casing: str = "preserve") -> Column:
    out = as_column(text)
    out = strip(out) if trim else out
    out = F.regexp_replace(out, rf"(?U){SPACE}+", " ") if squeeze else out
    return {"lower": F.lower, "upper": F.upper, "title": title_case, "preserve": lambda x: x}[casing](out)


def normalize_enum(value: Column | str, synonyms: dict[str, list[str]]) -> Column:
    """The name whose synonyms hold the value exactly, else the value."""
    value, pairs = as_column(value), {s: name for name, all_of in synonyms.items() for s in all_of}
    if not pairs:
        return value
    return F.coalesce(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[value], value)


def amount(text: Column | str) -> Column:
    """The number in a price: one leading mark, the first currency code and commas dropped; 0 if nothing is left; else null."""
    value = strip(as_column(text))
    value = F.regexp_replace(value, rf"^[{CURRENCY_MARKS}]\s*", "")
    code = "|".join(CURRENCY_CODES)
    value = strip(F.replace(F.regexp_replace(value, rf"(?is)^(.*?)(?:{code})(.*)$", "$1$2"), F.lit(","), F.lit("")))
    plain = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(value == "", F.lit(0.0)).when(plain, value.try_cast("double"))


def fixed_places(number: Column, places: int) -> Column:
    """Rounded half up on the exact binary value, so 1.005 has 1.00."""
    exact = number.cast("decimal(38, 18)")
    return F.round(exact, places).cast("double")


def normalize_currency(text: Column | str, places: int = 2) -> Column:
    """The amount as text with so many places, or the text as it is."""
    number = amount(text)
    return F.when(number.isNotNull(), F.round(number, places).cast(f"decimal(38, {places})").cast("string")).otherwise(as_column(text))


def normalize_boolean(text: Column | str, true_words: tuple[str, ...] = TRUE_WORDS, false_words: tuple[str, ...] = FALSE_WORDS) -> Column:
    """`true` or `false` for words of the lists in any case, else the text."""
    low = F.lower(as_column(text))
    return F.when(low.isin(*true_words), F.lit("true")).when(low.isin(*false_words), F.lit("false")).otherwise(as_column(text))


def normalize_list(text: Column | str, separator: str = ",") -> Column:
    """Stripped items between separators, which are literal; empty items stay."""
    return F.transform(F.split(as_column(text), rf"\Q{separator}\E"), strip)


def normalize_measurement(text: Column | str, unit: str | None = None) -> Column:
    """Struct of value and unit, in the unit asked for where both are masses or both lengths; null if it is no measurement."""
    text = as_column(text)
    number = F.regexp_extract(text, r"(?U)^\s*(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*$", 1).try_cast("double")
    own = F.lower(F.regexp_extract(text, r"(?U)^\s*(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*$", 2))
    value, shown = number, own
    for table in (MASS, LENGTH):
        if unit and unit.lower() in table:
            factor = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[own]
            converted = number * factor / F.lit(table[unit.lower()])
            value = F.when(factor.isNotNull(), F.round(converted, 9)).otherwise(number)
            shown = F.when(factor.isNotNull(), F.lit(unit.lower())).otherwise(own)
    return F.when(number.isNotNull(), F.struct(value.alias("value"), shown.alias("unit")))


def key_text(value: Column | str) -> Column:
    """A value as a key for matching: null as the empty text, texts stripped and in lower case."""
    return F.lower(strip(F.coalesce(as_column(value).cast("string"), F.lit(""))))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in lower case; 1 for equal texts, 0 if only one is empty."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def match_words(text: Column | str) -> Column:
    """Distinct words for comparing headers with fields."""
    low = F.regexp_replace(F.lower(as_column(text)), "organisation", "organization")
    words = F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def csv_cell(text: Column | str) -> Column:
    """A CSV cell: quoted where it holds a comma, a quote or a line feed; guarded by a tab where a spreadsheet would read a formula."""
    text = F.coalesce(as_column(text), F.lit(""))
    doubled = F.replace(text, F.lit('"'), F.lit('""'))
    formula = text.rlike(r"^[=+\-@]")
    quoted = formula | F.contains(text, F.lit(",")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n"))
    guarded = F.when(formula, F.concat(F.lit("\t"), doubled)).otherwise(doubled)
    return F.when(quoted, F.concat(F.lit('"'), guarded, F.lit('"'))).otherwise(text)


def redact(text: Column | str, patterns: tuple[str, ...] = SECRETS) -> Column:
    out = as_column(text)
    for pattern in patterns:
        out = F.regexp_replace(out, pattern, "[REDACTED]")
    return out


def redact_map(values: Column | str, patterns: tuple[str, ...] = SECRETS) -> Column:
    return F.transform_values(as_column(values), lambda _, v: redact(v, patterns))


def canonical_json(text: Column | str) -> Column:
    """JSON text with sorted keys, the same for equal values; null for what is no JSON."""
    return F.to_json(F.try_parse_json(as_column(text)))


def infer_type(text: Column | str) -> Column:
    """The logical type of a JSON value: array, object, boolean, number, url, currency or string (null: string)."""
    json = F.try_parse_json(as_column(text))
    kind = F.schema_of_variant(json)
    value = F.try_variant_get(json, "$", "string")
    return (
        F.when(kind.startswith("ARRAY"), F.lit("array"))
        .when(kind.startswith("OBJECT"), F.lit("object"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit("number"))
        .when(value.rlike(r"(?i)^https?://"), F.lit("url"))
        .when(value.rlike(rf"^\s*[{CURRENCY_MARKS}]\s*\d[\d,]*(\.\d+)?\s*$|^\s*\d[\d,]*(\.\d+)?\s*(?:{'|'.join(CURRENCY_CODES)})\s*$"), F.lit("currency"))
        .otherwise(F.lit("string"))
    )


def meaningful(text: Column | str) -> Column:
    """Whether a JSON value tells anything: a text with more than white space, a number, a boolean, or a list or object with such a member."""
    leaves = F.regexp_replace(canonical_json(text), r'"(?:[^"\\]|\\.)*"\s*:', "")
    told = F.regexp_replace(leaves, r'(?U)"(?:[\s\x{FEFF}]|\\[tnrfb])*"', "")
    return F.coalesce(told.rlike(r'["\d]|true|false'), F.lit(False))


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(as_column(text)) / 4)
