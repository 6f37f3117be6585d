"""Column expressions over site and level counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest site count that the 16-bit storage of methylomes holds.
U16 = 65535


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_reads(m="n_meth", u="n_unmeth") -> Column:
    return _column(m) + _column(u)


def wmean(m="n_meth", u="n_unmeth") -> Column:
    """Weighted mean level; 0.0 without reads."""
    return _column(m) / F.greatest(F.lit(1), n_reads(m, u))


def wmean_or(min_reads: int, missing: float | None = None, m="n_meth", u="n_unmeth") -> Column:
    """``wmean`` where there are ``min_reads`` or more, else ``missing`` (null or, as matrices have it, -1.0)."""
    return F.when(n_reads(m, u) >= min_reads, wmean(m, u)).otherwise(F.lit(missing).cast("double"))


def matrix_wmeans(matrix: DataFrame, keys: list[str], has_covered: bool = False, min_reads: int = 1) -> DataFrame:
    """Weighted means of a wide matrix whose columns besides ``keys`` are, for each sample, methylated and unmethylated reads, and covered sites if ``has_covered``.

    A mean's column is named by the sample's first one, without the suffix _M; null below ``min_reads``.
    """
    values = [c for c in matrix.columns if c not in keys]
    width = 3 if has_covered else 2
    if len(values) % width:
        raise ValueError(f"{len(values)} columns aren't {width} for each sample")
    means = [wmean_or(min_reads, None, f"`{m}`", f"`{u}`").alias(m.removesuffix("_M")) for m, u in zip(values[::width], values[1::width], strict=True)]
    return matrix.select(*keys, *means)


def fit_u16(value: Column, other: Column) -> Column:
    """``value`` of a pair, rescaled so that the larger of the two is 65535 if it is beyond that."""
    top = F.greatest(value, other)
    return F.when(top > U16, F.round(value / top * U16)).otherwise(value).cast("int")


def decoded_meth(level: Column, reads: Column) -> Column:
    """Methylated reads of a fraction and a number of reads, half away from zero."""
    return F.round(level * reads).cast("int")


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9_]+$"), F.lit(False))


def name_from_path(path: Column) -> Column:
    """The file's name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def genome_from_path(path: Column) -> Column:
    """The genome's name of a FASTA file; null if the suffix isn't one of FASTA's."""
    found = F.regexp_extract(F.substring_index(path, "/", -1), r"^(.+?)\.(?:fa|faa|fasta)(?:\.gz)?$", 1)
    return F.when(found != "", found)


def g6_fraction(wide: Column) -> Column:
    """Six significant digits of a double from 1e-4 to 1 in whole numbers; null beyond, and near ties, which need all of its decimals."""
    out = F.lit(None).cast("string")
    for places in (9, 8, 7, 6):
        scaled = wide * float(10**places)
        digits = F.floor(scaled + 0.5)
        text = F.when(digits == 10**places, F.lit("1")).otherwise(F.concat(F.lit("0."), F.rtrim(F.lpad(digits.cast("string"), places, "0"), F.lit("0"))))
        # A product is off by far less than 1e-6, so other halves are told surely.
        sure = F.when(F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6, text)
        out = F.when(wide >= 10.0 ** (5 - places), sure).otherwise(out)
    return F.when(wide <= 1, out)


def fmt_g6(x: Column) -> Column:
    """Six significant digits as C's %g prints a 32-bit float: no trailing zeros, an exponent below 1e-4.

    Exact decimal ties are rounded half to even, on the decimal expansion of the float.
    """
    wide = F.abs(x.cast("float").cast("double"))
    digits = F.floor(F.log10(F.when(wide > 0, wide).otherwise(F.lit(1.0)))).cast("int")
    exact = wide.cast("decimal(38,30)")
    plain = F.lit(None).cast("double")
    for e in range(-5, 6):
        plain = F.when(digits == e, F.bround(exact, 5 - e).cast("double")).otherwise(plain)
    shown = F.format_string("%.6g", F.coalesce(plain, wide))
    text = F.regexp_replace(shown, r"(\.[0-9]*?)0+(?=$|e)", "$1")
    text = F.when(wide == 0, F.lit("0")).otherwise(F.coalesce(g6_fraction(wide), F.regexp_replace(text, r"\.(?=$|e)", "")))
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def element(kind: str, m="n_meth", u="n_unmeth", covered: Column | str | None = None, min_reads: int = 0) -> Column:
    """One level as text: counts ``m u [c]``, classic ``score reads [c]``, or a score with NA for too few reads."""
    extra = [_column(covered).cast("string")] if covered is not None and kind != "scores" else []
    if kind == "counts":
        return F.concat_ws("\t", _column(m).cast("string"), _column(u).cast("string"), *extra)
    if kind == "classic":
        return F.concat_ws("\t", fmt_g6(wmean(m, u)), n_reads(m, u).cast("string"), *extra)
    return F.when(n_reads(m, u) >= min_reads, fmt_g6(wmean(m, u))).otherwise(F.lit("NA"))


def row_name(cols: list[str], sep: str = ".") -> Column:
    """Names of ranges: chrom.start.stop or chrom.start."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])
