"""Column functions X01-X14: names, URLs, text, squashing functions, date parts, order prices."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# X01
def safe_name(col) -> Column:
    """Lower-case name with blanks and hyphens as underscores."""
    return F.lower(F.translate(_c(col), " -", "__"))


# X02
def url_host(col) -> Column:
    """Network location of a URL in lower case; port and user info stay in."""
    host = F.regexp_extract(_c(col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


# X03
def text_id(col) -> Column:
    return F.substring(F.sha2(F.coalesce(_c(col), F.lit("")), 256), 1, 24)


# X04
def keyword_hit(col, keywords) -> Column:
    """True where any keyword occurs in the lower-cased text; missing text is no hit."""
    words = sorted(keywords)
    if not words:
        return F.lit(False)
    pattern = "|".join(re.escape(w) for w in words)
    return F.coalesce(F.lower(_c(col)).rlike(pattern), F.lit(False))


# X05
def weighted_sum(weights: dict) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(name)
    return total


# X06
def article_text(title, body, max_chars: int | None = None) -> Column:
    """``title. body`` as model input, whole unless a model with a limited input asks for a cut."""
    text = F.trim(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(". "), F.coalesce(_c(body), F.lit(""))))
    return text if max_chars is None else F.substring(text, 1, max_chars)


# X07
def clip(col, low=None, high=None) -> Column:
    """Bounds a value and keeps NULL as NULL (least/greatest alone would drop it)."""
    c = _c(col)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def gain(col) -> Column:
    return clip(col, low=0.0)


def loss(col) -> Column:
    return -clip(col, high=0.0)


# X08
def interpolate(col, knots, values) -> Column:
    """Straight lines between knots, held flat outside."""
    c = _c(col)
    out = F.when(c <= knots[0], F.lit(float(values[0])))
    for x0, x1, y0, y1 in zip(knots, knots[1:], values, values[1:]):
        out = out.when(c <= x1, y0 + (c - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(c.isNotNull(), F.lit(float(values[-1])))


# X09
def softmax(logits, temperature: float = 1.0) -> list[Column]:
    """One share per logit; equal shares if the sum is not a positive number."""
    cols = [_c(x) / F.lit(float(temperature)) for x in logits]
    top = F.greatest(*cols)
    parts = [F.exp(x - top) for x in cols]
    total = sum(parts[1:], parts[0])
    return [F.coalesce(F.try_divide(p, total), F.lit(1.0 / len(cols))) for p in parts]


# X10
def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


# X11
def argmax_label(pairs) -> Column:
    """Label of the largest value; the earlier label wins a tie."""
    top = F.greatest(*[_c(v) for _, v in pairs])
    out = None
    for label, value in pairs:
        hit = _c(value) == top
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


# X12
def month_key(col) -> Column:
    return F.date_format(_c(col), "yyyy-MM")


def is_friday(col) -> Column:
    return F.dayofweek(_c(col)) == 6


# X13
def nested(col, default="") -> Column:
    return F.coalesce(_c(col), F.lit(default))


# X14
def limit_price(last, side, buffer) -> Column:
    """Price moved against the order by the buffer, on a 0.05 grid, halves to even."""
    b = _c(buffer) if isinstance(buffer, (str, Column)) else F.lit(float(buffer))
    moved = _c(last) * F.when(F.upper(_c(side)) == "BUY", 1.0 + b).otherwise(1.0 - b)
    return F.rint(moved * 20.0) / 20.0


def product_type(strategy) -> Column:
    s = _c(strategy)
    return (
        F.when(s == "MOMENTUM_CASH", "DELIVERY")
        .when(s == "MEAN_REV_DERIV", "CARRYFORWARD")
        .otherwise("INTRADAY")
    )


def hash_uniform(*parts) -> Column:
    """Number in [0, 1) fixed by its inputs: the first 32 bits of an md5.

    Resampling uses this instead of a seeded generator, so a lost task draws
    the same numbers again and another engine can repeat them.
    """
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, also where ``use`` reads it inside a lambda (a column would be computed again at each step there)."""
    return F.get(F.transform(F.array(value), use), 0)
