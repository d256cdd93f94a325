"""Semi-structured payloads: deep redaction and hashes of canonical JSON, Arrow-batched."""

from __future__ import annotations

import hashlib
import json
import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EMAIL, EMAIL_PLACEHOLDER

# Keys that never enter the archive, whole or by pattern.
REMOVED_KEYS = ("assignedCAUser", "assignedSupplierUser")
REMOVED_PATTERNS = (r"^contact(person)?$", "email", "phone", "fax", "mobile")
_removed = re.compile("|".join([*(f"^{k}$" for k in REMOVED_KEYS), *(f"(?i:{p})" for p in REMOVED_PATTERNS)]))
_email = re.compile(EMAIL)


def redacted(value):
    """A JSON value without denied keys at any depth and with e-mail addresses in texts replaced; idempotent."""
    match value:
        case dict():
            return {k: redacted(v) for k, v in value.items() if not _removed.search(k)}
        case list():
            return [redacted(v) for v in value]
        case str():
            return _email.sub(EMAIL_PLACEHOLDER, value)
        case _:
            return value


def _number(x: float) -> str:
    """A finite number with the digits that tell it apart: whole numbers without a point, exponents only beyond 21 digits or below 1e-6."""
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = repr(x).partition("e")
    if power and -7 < int(power) < 0:
        return format(Decimal(repr(x)), "f")
    if not power:
        return digits
    return f"{digits.removesuffix('.0')}e{int(power):+d}"


def canonical(value) -> str:
    """JSON with keys in order (by UTF-16 units) at every depth, arrays as they are, no spaces; numbers and texts as browsers write them."""
    match value:
        case dict():
            inner = (f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass")))
            return "{" + ",".join(inner) + "}"
        case list():
            return "[" + ",".join(map(canonical, value)) + "]"
        case float():
            return _number(value) if math.isfinite(value) else "null"
        case int() if not isinstance(value, bool) and abs(value) >= 2**53:
            return _number(float(value))
        case _:
            return json.dumps(value, ensure_ascii=False)


def _redact_all(payload: pd.Series) -> pd.DataFrame:
    def one(text: str | None):
        try:
            form = canonical(redacted(json.loads(text)))
        except (TypeError, ValueError, OverflowError):
            return None, None
        return form, hashlib.sha256(form.encode()).hexdigest()

    return pd.DataFrame([one(x) for x in payload], columns=["redacted", "content_hash"])


def redact_and_hash(payload: Column) -> Column:
    """Of each JSON text a struct of the redacted payload in canonical form and its SHA-256; both null if it is no JSON."""
    return F.pandas_udf(_redact_all, "redacted string, content_hash string")(payload)
