"""Scalar Column functions.

All are built-in expressions, so they run inside whole-stage codegen (or, for
higher-order functions, JVM-side interpreted lambdas) -- never Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values used by the link classification (K6).
IMAGE_SUFFIXES = (".gif", ".bmp", ".png", ".svg", ".jpg", ".tif", ".tiff", ".ico", ".jpeg")
INTERNAL_HOST_MARK = "/stackoverflow.com"
# Entropy floor (K1) and message length cap.
ENTROPY_FLOOR = 1e-10
MAX_MSG_LEN = 4094
# Significance verdicts of the permutation test.
VERDICT_HIGH = "highly significant"
VERDICT_SIG = "significant"
VERDICT_NONE = "not significant"
# Split hash parameters (C4): a portable integer hash so SQL engines agree.
_HASH_MOD = 2147483648
_HASH_MUL = 1103515245
_HASH_ADD = 12345


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def x_log_x(x, thrs: float = ENTROPY_FLOOR) -> Column:
    """K1: -x * log2(max(x, thrs))."""
    x = _c(x)
    return -x * F.log2(F.greatest(x, F.lit(thrs)))


def entropy(arr) -> Column:
    """K2: sum of K1 over an array of topic weights."""
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, v: acc + x_log_x(v))


def first_argmax(arr) -> Column:
    """H3/K4: 0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def split_hash_unit(id_col, seed: int = 0) -> Column:
    """Uniform value in [0,1) from an integer id (portable integer arithmetic)."""
    h = F.pmod(F.pmod(_c(id_col).cast("bigint"), F.lit(_HASH_MOD)) * F.lit(_HASH_MUL)
               + F.lit(_HASH_ADD + seed), F.lit(_HASH_MOD))
    return h / F.lit(float(_HASH_MOD))


def split_tag(id_col, test_fraction: float = 0.15, val_fraction: float = 0.15, seed: int = 0) -> Column:
    """C4: 0 train with P=1-test-val, 1 validation with P=val, 2 test with P=test.

    Deterministic per id (the reference draws at random; see README)."""
    u = split_hash_unit(id_col, seed)
    return (F.when(u < 1.0 - test_fraction - val_fraction, 0)
            .when(u < 1.0 - test_fraction, 1).otherwise(2).cast("int"))


def link_type(address, internal_mark: str = INTERNAL_HOST_MARK) -> Column:
    """K6: image suffix first, then internal (leading '/' or host mark), else std."""
    a = F.lower(_c(address))
    is_img = F.lit(False)
    for suf in IMAGE_SUFFIXES:
        is_img = is_img | a.endswith(suf)
    return (F.when(is_img, "img")
            .when(a.startswith("/") | (F.instr(a, internal_mark) > 0), "internal")
            .otherwise("std"))


def int_from_text(txt, cut_suffix: int = 0) -> Column:
    """K8: integer from text with thousands commas, optional suffix cut; bad -> null."""
    t = F.trim(_c(txt))
    if cut_suffix:
        t = F.substring(t, F.lit(1), F.greatest(F.length(t) - cut_suffix, F.lit(0)))
    return F.trim(F.regexp_replace(t, ",", "")).try_cast("int")


def cosine(a, b) -> Column:
    """Dot / (|a| |b|); a zero norm gives null (the reference gives NaN)."""
    a, b = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v))
    return F.try_divide(dot, na * nb)


def va_index(observed, mean, std) -> Column:
    """d = (x-mean)/std, d / sqrt(d^2 + 1)."""
    d = F.try_divide(_c(observed) - _c(mean), _c(std))
    return d / F.sqrt(d * d + F.lit(1.0))


def verdict(quantile) -> Column:
    """Significance verdict from the ECDF quantile."""
    q = _c(quantile)
    return (F.when((q > 0.975) | (q < 0.025), VERDICT_HIGH)
            .when((q > 0.95) | (q < 0.05), VERDICT_SIG)
            .otherwise(VERDICT_NONE))


def truncate_msg(msg) -> Column:
    """Keep the first 4094 characters."""
    return F.substring(_c(msg), 1, MAX_MSG_LEN)


def file_stamp(ts) -> Column:
    """%Y_%m_%d__%H_%M_%S stamp."""
    return F.date_format(_c(ts), "yyyy_MM_dd__HH_mm_ss")


def composite_key(*names: str) -> Column:
    """Sorted ``name:value`` pairs joined by ';'."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{n}:"), F.col(n).cast("string")) for n in sorted(names)])


def parse_ask_date(txt) -> Column:
    """C3: 'yyyy-MM-dd HH:mm:ssZ' -> date; failure -> null."""
    return F.to_date(F.try_to_timestamp(_c(txt), F.lit("yyyy-MM-dd HH:mm:ssX")))


def normalise(arr) -> Column:
    """Divide an array by its sum; zero sum gives nulls."""
    a = _c(arr)
    s = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(a, lambda v: F.try_divide(v, s))
