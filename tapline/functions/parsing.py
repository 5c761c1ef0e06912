"""Parsing and coercion of sensor values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
ANY_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ISO_OFFSET = r"[0-9]{2}:?[0-9]{2}.*([+-][0-9]{2}:?[0-9]{2})$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def evaluated(df, keep: list[str], computed: dict[str, Column]):
    """Columns ``keep`` and the computed ones, each computed once per row.

    Catalyst copies the definition of a column into every filter and expression above it. Parsing
    chains are long, so the copies grow beyond what can be compiled; a one-row generator stops it.
    """
    projected = df.select(*keep, *[v.alias(f"_e_{k}") for k, v in computed.items()])
    row = F.struct(*[F.col(f"`_e_{k}`").alias(k) for k in computed])
    return projected.select(*keep, F.inline(F.array(row)))


def present(value: Column) -> Column:
    """Null for the absent markers: null, empty text and a dash."""
    return F.when((value != "") & (value != "-"), value)


def field(raw: Column | str, name: str) -> Column:
    """Value of a map key, null when the key is missing."""
    return F.try_element_at(_col(raw), F.lit(name))


def first_present(raw: Column | str, *names: str) -> Column:
    """First alias whose value is present."""
    return F.coalesce(*[present(field(raw, n)) for n in names])


def strict_int(value: Column) -> Column:
    """Whole numbers only: ``+5`` parses, ``12.5`` and ``80/tcp`` give null, booleans give 0/1."""
    text = value.cast("string")
    lowered = F.lower(F.trim(text))
    return (
        F.when(lowered == "true", F.lit(1).cast("long"))
        .when(lowered == "false", F.lit(0).cast("long"))
        .when(text.rlike(STRICT_INTEGER), F.trim(text).try_cast("long"))
    )


def present_int(raw: Column | str, name: str) -> Column:
    return strict_int(present(field(raw, name)))


def total_count(raw: Column | str, direct: str, first: str, second: str) -> Column:
    """The direct counter, else the sum of the two directional ones, else null."""
    d, a, b = (present_int(raw, n) for n in (direct, first, second))
    either = F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.when(first_present(raw, direct).isNotNull(), d).otherwise(either)


def total_count_invalid(raw: Column | str, direct: str, first: str, second: str) -> Column:
    """First present counter value that is not a whole number, else null."""
    bad = lambda n: F.when(present_int(raw, n).isNull(), first_present(raw, n))
    return F.when(first_present(raw, direct).isNotNull(), bad(direct)).otherwise(
        F.coalesce(bad(first), bad(second))
    )


def parse_ts(value: Column) -> Column:
    """UTC timestamp from epoch text (to the microsecond) or ISO-8601 text with an offset.

    Text without an offset gives null; see ``ts_reject`` for the reason.
    """
    text = F.trim(value)
    exact = F.round(text.try_cast("decimal(26,9)") * F.lit(1_000_000), 0).cast("long")
    scaled = F.round(text.try_cast("double") * F.lit(1e6), 0).cast("long")
    micros = F.when(text.rlike(DECIMAL_NUMBER), exact).when(text.rlike(ANY_NUMBER), scaled)
    zoned = F.regexp_replace(text, "Z$", "+00:00")
    iso = F.when(zoned.rlike(ISO_OFFSET), zoned.try_cast("timestamp"))
    return F.coalesce(F.timestamp_micros(micros), iso)


def ts_reject(value: Column) -> Column:
    """Reason a timestamp is refused, null when it parses."""
    text = F.trim(value)
    naive = text.try_cast("timestamp_ntz").isNotNull() & ~F.regexp_replace(text, "Z$", "+00:00").rlike(ISO_OFFSET)
    return (
        F.when(parse_ts(value).isNotNull(), F.lit(None).cast("string"))
        .when(naive, F.lit("Timestamp must include timezone information"))
        .otherwise(F.concat(F.lit("Invalid timestamp: '"), value, F.lit("'")))
    )


def flag_marker(value: Column) -> Column:
    """Boolean of a t/f marker, null when it is neither."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("t", "true", "1"), F.lit(True)).when(text.isin("f", "false", "0"), F.lit(False))


def truthy(value: Column) -> Column:
    """Lenient sensor flag: only the usual yes-words are true."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "t", "true", "yes", "y"), F.lit(False))


def clean_numeric(value: Column | str) -> Column:
    """Finite double; null, NaN and infinities become 0. Bad text raises, as ANSI casts do."""
    number = _col(value).cast("double")
    # one comparison leaves out all three: a null is not true, and NaN is above infinity
    return F.when(F.abs(number) < float("inf"), number).otherwise(F.lit(0.0))


def to_number_or_zero(value: Column | str) -> Column:
    """Lenient coercion: whatever is not a number becomes 0."""
    number = _col(value).try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)


# --- collection literals stored as text -------------------------------------------------------

_QUOTED_OR_BARE = r"""'([^']*)'|"([^"]*)"|([^\s,\[\]{}()'":]+)"""


def literal_kind(text: Column) -> Column:
    """set, list, dict or none for a literal such as ``{'A','PTR'}`` or ``[60, 300]``."""
    t = F.trim(text)
    return (
        F.when(t.isin("set()"), F.lit("set"))
        .when(t.rlike(r"^\{\s*\}$") | t.rlike(r"^\{[^{}]*:[^{}]*\}$"), F.lit("dict"))
        .when(t.rlike(r"^\{.*\}$"), F.lit("set"))
        .when(t.rlike(r"^(\[.*\]|\(.*\))$"), F.lit("list"))
        .when(t == "None", F.lit("none"))
    )


def literal_items(text: Column) -> Column:
    """Elements of a flat literal as strings, in written order, quotes removed."""
    t = F.trim(text)
    body = F.when(t == "set()", F.lit("")).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
    tokens = F.regexp_extract_all(body, F.lit(_QUOTED_OR_BARE), F.lit(0))
    return F.transform(tokens, lambda x: F.regexp_replace(x, r"""^(['"])(.*)\1$""", "$2"))


def literal_count(text: Column, unparsed: int = 1) -> Column:
    """Length of a collection literal. Sets count distinct elements, dicts their keys.

    ``unparsed`` is the count for text that is no literal: 1 in the research form, 0 in the scoring
    form.
    """
    t = F.trim(text)
    items = literal_items(t)
    keys = F.regexp_count(t, F.lit(":"))
    return (
        F.when(t.isNull() | t.isin("", "set()", "{}", "None", "nan"), F.lit(0))
        .when(literal_kind(t) == "dict", keys)
        .when(literal_kind(t) == "set", F.size(F.array_distinct(items)))
        .when(literal_kind(t) == "list", F.size(items))
        .when(t.rlike(ANY_NUMBER) | t.rlike(r"""^(['"]).*\1$"""), F.lit(1))
        .otherwise(F.lit(unparsed))
        .cast("int")
    )


def ttl_values(text: Column, lenient: bool = True) -> Column:
    """Numbers of a TTL list literal. ``lenient`` falls back to every number found in the text."""
    is_list = literal_kind(text) == "list"
    parsed = F.transform(literal_items(text), lambda x: x.try_cast("double"))
    parsed = F.filter(parsed, lambda x: x.isNotNull())
    found = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double")
    )
    empty = F.array().cast("array<double>")
    return F.when(is_list, parsed).otherwise(F.coalesce(found, empty) if lenient else empty)


def ttl_features(text: Column, lenient: bool = True) -> dict[str, Column]:
    """min, max, range and count of a TTL list; the scoring form counts distinct values."""
    values = ttl_values(text, lenient)
    low = F.coalesce(F.array_min(values), F.lit(0.0))
    high = F.coalesce(F.array_max(values), F.lit(0.0))
    counted = F.size(values if lenient else F.array_distinct(values))
    return {"ttl_min": low, "ttl_max": high, "ttl_range": high - low, "ttl_unique_count": counted}


def rr_types(text: Column) -> Column:
    """Distinct record types of a set, list or tuple literal; anything else is empty."""
    is_group = literal_kind(text).isin("set", "list")
    return F.when(is_group, F.array_distinct(literal_items(text))).otherwise(F.array().cast("array<string>"))


def rr_flags(text: Column) -> dict[str, Column]:
    types = rr_types(text)
    out = {
        f"is_{t}_record": F.array_contains(types, t).cast("int") for t in ("A", "PTR", "TXT", "AAAA")
    }
    out["rr_type_count"] = F.size(types)
    return out


def canonical_value(text: Column) -> Column:
    """Order-free text form of a collection literal, so equal sets and dicts compare equal."""
    t = F.trim(text)
    kind = literal_kind(t)
    items = literal_items(t)
    pairs = F.transform(
        F.split(F.substring(t, F.lit(2), F.length(t) - 2), r"\s*,\s*"),
        lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"\s*:\s*", ":"), "[\"']", ""),
    )
    ordered = lambda tag, a: F.concat(F.lit(tag + "("), F.array_join(a, "|"), F.lit(")"))
    return (
        F.when(t.isNull() | (t == "None"), F.lit("__NONE__"))
        .when(kind == "set", ordered("SET", F.array_sort(F.array_distinct(items))))
        .when(t.rlike(r"^\{\s*\}$"), F.lit("DICT()"))
        .when(kind == "dict", ordered("DICT", F.array_sort(pairs)))
        .when(kind == "list", ordered("LIST", items))
        .otherwise(t)
    )


def canonical_key(*columns: Column | str) -> Column:
    """Row key over canonical forms. Compare the text; hash it only to speed a join up."""
    return F.to_json(F.array(*[canonical_value(_col(c).cast("string")) for c in columns]))


def pattern_key(*columns: Column | str, decimals: int = 6) -> Column:
    """Row key over rounded numbers; negative zero equals zero."""
    return F.to_json(F.array(*[F.round(_col(c).cast("double"), decimals) + F.lit(0.0) for c in columns]))
