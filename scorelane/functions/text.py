"""Column functions for text, canonical JSON, hashes and small statistics."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SYMBOLS = "ABCDEFGHIJKLMNOP"
Z95 = 1.959963984540054


def squeeze(text: Column) -> Column:
    """White space runs (Unicode) become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), r"^ | $", "")


@F.pandas_udf(StringType())
def casefolded(texts: pd.Series) -> pd.Series:
    """Case-folded text with white space squeezed; JVM functions have no full case folding."""
    return texts.map(lambda t: None if t is None else " ".join(t.casefold().split()))


@F.pandas_udf(StringType())
def nfkc_casefolded(texts: pd.Series) -> pd.Series:
    """As casefolded, after NFKC normalisation."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def _fields(struct: Column, *names: str) -> Column:
    return F.named_struct(*[x for n in names for x in (F.lit(n), struct[n])])


def sorted_options(options: Column) -> Column:
    """Options by id, each with its keys in alphabetical order."""
    return F.array_sort(F.transform(options, lambda o: _fields(o, "id", "label", "description")))


def canonical_request(context: Column, question: Column, options: Column) -> Column:
    """JSON of a request that doesn't depend on the order of its options; null descriptions stay."""
    ordered = F.transform(sorted_options(options), lambda o: _fields(o, "description", "id", "label"))
    return F.to_json(F.named_struct(F.lit("context"), context, F.lit("options"), ordered, F.lit("question"), question), {"ignoreNullFields": "false"})


@F.pandas_udf(StringType())
def _reencoded(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: None if p is None else json.dumps(json.loads(p), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def canonical(payload: Column) -> Column:
    """A JSON text with the keys of every object in order, written as Python does (control characters, numbers)."""
    return _reencoded(payload)


def request_hash(context: Column, question: Column, options: Column, control_safe: bool = False) -> Column:
    """SHA-256 of the canonical request.

    JSON writers differ in the letters of escaped control characters; ``control_safe`` re-encodes
    payloads in Python for texts that may hold such characters.
    """
    payload = canonical_request(context, question, options)
    return F.sha2(_reencoded(payload) if control_safe else payload, 256)


@F.pandas_udf(StringType())
def _rewritten(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: None if p is None else json.dumps(json.loads(p), ensure_ascii=False, separators=(",", ":")))


def prompt(context: Column, question: Column, options: Column, control_safe: bool = False) -> Column:
    """A request as JSON in the order given, options under letters, and the answer line."""
    shown = F.transform(options, lambda o, i: F.struct(F.substring(F.lit(SYMBOLS), i + 1, F.lit(1)).alias("symbol"), o["label"].alias("label"), o["description"].alias("description")))
    body = F.to_json(F.struct(context.alias("context"), question.alias("question"), shown.alias("options")), {"ignoreNullFields": "false"})
    return F.concat(_rewritten(body) if control_safe else body, F.lit("\nAnswer:\n"))


def rank(namespace: str, seed: int, *parts: Column) -> Column:
    """Hex digest that orders rows for a deterministic selection."""
    return F.sha2(F.concat_ws(":", F.lit(namespace), F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def opaque_id(prefix: str, *parts: Column) -> Column:
    """A name that shows nothing of its parts: a prefix and the digest of the prefix and the parts as a JSON list."""
    return F.concat(F.lit(f"{prefix}-"), F.sha2(F.to_json(F.array(F.lit(prefix), *[p.cast("string") for p in parts])), 256))


def split_slot(digest: Column) -> Column:
    """Split of a hex digest by its value modulo 8: four of train, one of development and of calibration, two of test."""
    names = F.array(*map(F.lit, ["train"] * 4 + ["development", "calibration"] + ["test"] * 2))
    return F.element_at(names, (F.conv(F.right(digest, F.lit(1)), 16, 10).cast("int") % 8) + 1)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def sha256_hex(value: Column) -> Column:
    """A digest of 64 hex digits in lower case; null if it isn't one."""
    return F.when(value.rlike("^[0-9A-Fa-f]{64}$"), F.lower(value))


def confidence_bin(p: Column, bins: int = 10) -> Column:
    """Number of the half-open bin [i / bins, (i + 1) / bins) of p, the last one closed, by comparison."""
    return sum((p >= F.lit(i / bins)).cast("int") for i in range(1, bins))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval, kept within 0 and 1; null without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits.cast("double") / n
    z2 = Z95 * Z95
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def python_digest(value: object) -> str:
    """SHA-256 of the canonical JSON of a Python value."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: What a message may not show, and what stands in its place, in order.
REDACTED = [
    (r"""(?iU)(https?://)(?:[^\s<>"'/?#]*@)?([^\s<>"'?#]*?)(?:[?#][^\s<>"']*?)?([.,;:!?)\]}]*)(?=[\s<>"']|$)""", "$1$2$3"),
    (r"(?iU)\b(authorization\s*[:=]\s*)(?:bearer|basic)\s+[^\s,;)}\]]+", "$1[REDACTED]"),
    (r"""(?iU)\b(?:[\w.-]*(?:token|secret|password|passwd)|api[_-]?key|authorization)\s*[:=]\s*(?:"[^"]*"|'[^']*'|[^\s,;)}\]]+)""", "[REDACTED]"),
    (r"(?iU)\b(bearer|basic)\s+[^\s,;)}\]]+", "$1 [REDACTED]"),
    (r"(?U)\bhf_[A-Za-z0-9_-]+\b", "[REDACTED]"),
]


def redacted(message: Column, most: int = 2000) -> Column:
    """A message without users and queries of URLs, headers, assigned secrets, bearer and basic words and hub tokens, cut to ``most`` characters."""
    for pattern, to in REDACTED:
        message = F.regexp_replace(message, pattern, to)
    return F.left(message, F.lit(most))


def left_padded(ids: Column, width: int, pad: int) -> tuple[Column, Column, Column]:
    """Ids filled up on the left, the mask of real ids, and positions that start at zero after the filling."""
    gap = F.greatest(F.lit(width) - F.size(ids), F.lit(0))
    zeros = F.array_repeat(F.lit(0), gap)
    positions = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.greatest(i - gap, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(pad), gap), ids), F.concat(zeros, F.transform(ids, lambda _: F.lit(1))), positions
