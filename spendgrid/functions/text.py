"""Names, fiscal codes, classification codes, units and display formats as Column expressions.

Null inputs give null unless a docstring says otherwise. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Every letter that Unicode decomposes into one other letter and combining marks (U+0300 to U+036F), and that letter in lower case."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c.lower()) if not "\u0300" <= x <= "\u036f")
        if len(plain) == 1 and plain != c and c == c.lower():
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLDED_FROM, FOLDED_TO = _folding()
# Legal forms of Romanian companies, and the lead-in that is not a form.
LEGAL_FORMS = ("srl", "sa", "sca", "snc", "scs", "pfa", "ra")
LEAD_INS = ("sc",)
# The weights of the fiscal code's check digit.
CHECK_WEIGHTS = (7, 5, 3, 2, 1, 7, 5, 3, 2)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_PLACEHOLDER = "[email redactat]"
NO_NAME = "(fără nume)"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_wide(c: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold_text(c: Column) -> Column:
    """Lower case without diacritics: precomposed letters (Latin, Greek, Cyrillic) by a table made from Unicode, then combining marks. Letters that
    Unicode does not decompose, such as đ, ł and ø, stay."""
    return F.regexp_replace(F.translate(F.lower(c), FOLDED_FROM, FOLDED_TO), r"[̀-ͯ]", "")


def name_tokens(c: Column) -> Column:
    """Words of a folded name: dots join ("S.R.L." is one word), other punctuation separates."""
    plain = F.regexp_replace(F.regexp_replace(fold_text(c), r"\.", ""), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda t: t != "")


def normalized_name(c: Column) -> Column:
    """The words of a name that identify it, in order: without legal forms and lead-ins, with numbers and places."""
    drop = F.array(*map(F.lit, LEGAL_FORMS + LEAD_INS))
    return F.array_join(F.filter(name_tokens(c), lambda t: ~F.array_contains(drop, t)), " ")


def legal_form(c: Column) -> Column:
    """The first legal form among a name's words, or null."""
    forms = F.array(*map(F.lit, LEGAL_FORMS))
    return F.try_element_at(F.filter(name_tokens(c), lambda t: F.array_contains(forms, t)), F.lit(1))


def first_ordinal(c: Column) -> Column:
    """The first "nr <digits>" of a normalized name, as text, or null."""
    return blank_to_null(F.regexp_extract(c, r"(?<![0-9A-Za-z_])nr\s+(\d+)(?![0-9A-Za-z_])", 1))


_ENTITY = r"(?isU)^(RO?)?\s*([0-9]{2,10})(?![0-9A-Za-z_])[\s-]*(.+)$"


def entity_code(c: Column) -> Column:
    """The fiscal code that leads an organisation string such as "RO21255449 S.C. X S.R.L.", as written, or null."""
    t = trim_wide(c)
    return blank_to_null(F.concat(F.regexp_extract(t, _ENTITY, 1), F.regexp_extract(t, _ENTITY, 2)))


def entity_name(c: Column) -> Column:
    """What follows that code; the whole trimmed string if none leads it."""
    t = trim_wide(c)
    return F.when(t.rlike(_ENTITY), trim_wide(F.regexp_extract(t, _ENTITY, 3))).otherwise(t)


def fiscal_code(c: Column) -> Column:
    """A fiscal code in canonical form: upper case, alphanumeric, no RO/R prefix, no leading zeros; null becomes ''."""
    plain = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    return F.regexp_replace(F.regexp_replace(plain, "^RO?", ""), "^0+", "")


def fiscal_code_valid(c: Column) -> Column:
    """Whether 2 to 10 digits end in their check digit: weighted sum of the nine before, times 10 mod 11, 10 counts as 0."""
    shaped = F.coalesce(c.rlike("^[0-9]{2,10}$"), F.lit(False))
    digits = F.lpad(F.when(shaped, c).otherwise("00"), 10, "0")
    digit = lambda i: F.substring(digits, i, 1).cast("int")
    total = sum((digit(i + 1) * w for i, w in enumerate(CHECK_WEIGHTS)), F.lit(0))
    return shaped & ((total * 10 % 11 % 10) == digit(10))


def cpv_code(c: Column) -> Column:
    """The classification code NNNNNNNN-D that leads a string, or null."""
    return blank_to_null(F.regexp_extract(c, r"^\s*([0-9]{8}-[0-9])(?![0-9A-Za-z_])", 1))


def cpv_of(text: Column, locale_key: Column) -> Column:
    """The code of a classification object: its key if that is a code, else what leads its text."""
    return F.coalesce(cpv_code(locale_key), cpv_code(text))


def unit_key(c: Column) -> Column:
    """A unit of measure as a look-up key: folded, single spaces, trimmed."""
    return trim_wide(F.regexp_replace(fold_text(c), r"(?U)\s+", " "))


def county_key(c: Column) -> Column:
    return trim_wide(fold_text(c))


def scrub_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, EMAIL_PLACEHOLDER)


def display_name(c: Column) -> Column:
    """A name without the fiscal code before it; the trimmed whole if nothing is left, a placeholder for null or blank."""
    t = trim_wide(c)
    return F.coalesce(blank_to_null(trim_wide(F.regexp_replace(t, r"(?i)^(RO?)?\s*[0-9]{2,10}(?![0-9A-Za-z_])[\s-]*", ""))), blank_to_null(t), F.lit(NO_NAME))


def trigrams(c: Column) -> Column:
    """Distinct letter trigrams of a string's lower-case words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """|A and B| / |A or B| of the trigram sets; 0 if both are empty."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def _ro_number(c: Column, places: int) -> Column:
    return F.translate(F.format_number(c, places), ",.", ".,")


def format_ron(c: Column) -> Column:
    """An amount in lei for people: "21,4 mld. lei", "351,3 mil. lei" or whole lei; a dash for null and NaN."""
    v = c.cast("double")
    text = F.when(F.abs(v) >= 1e9, F.concat(_ro_number(v / 1e9, 1), F.lit(" mld. lei"))).when(F.abs(v) >= 1e6, F.concat(_ro_number(v / 1e6, 1), F.lit(" mil. lei"))).otherwise(F.concat(_ro_number(v, 0), F.lit(" lei")))
    return F.when(v.isNull() | F.isnan(v), F.lit("—")).otherwise(text)


def gap_label(minutes: Column) -> Column:
    """A gap in minutes as minutes, hours or days."""
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.round(minutes / 60).cast("int").cast("string"), F.lit(" h"))).otherwise(F.concat(F.round(minutes / 1440).cast("int").cast("string"), F.lit(" zile")))


def external_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), c.cast("string"))


def external_number(c: Column) -> Column:
    """The number of an id such as "da:123"; null if it is none."""
    return F.split_part(c, F.lit(":"), F.lit(2)).try_cast("long")


def query_url(base: str, **parameters: Column) -> Column:
    """base with parameters, percent-encoded, in the order given."""
    parts = [F.concat(F.lit(("?" if i == 0 else "&") + k + "="), F.url_encode(v.cast("string"))) for i, (k, v) in enumerate(parameters.items())]
    return F.concat(F.lit(base), *parts)
