"""Text functions as column expressions."""

from pyspark.sql import Column, functions as F

from logloom.fixed import ANSI_CODE, STAT_ALIASES


def strip_ansi(text: Column) -> Column:
    """Drop colour codes."""
    return F.regexp_replace(text, F.lit(ANSI_CODE), F.lit(""))


def truncate(text: Column, n: int) -> Column:
    """One line, at most ``n`` characters, then ``...``."""
    flat = F.regexp_replace(F.translate(text, "\n", " "), F.lit("\r"), F.lit(""))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("..."))).otherwise(flat)


def truncate_total(text: Column, n: int) -> Column:
    """N11, total-length form: the dots count towards ``n``."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n - 3)), F.lit("...")))


def slug(title: Column, today: Column) -> Column:
    """Lower-case words joined by ``-``, with a date at the end."""
    words = F.translate(F.lower(title), " _", "--")
    kept = F.regexp_replace(words, F.lit(r"[^\p{L}\p{Nd}-]"), F.lit(""))
    joined = F.regexp_replace(F.regexp_replace(kept, F.lit("-+"), F.lit("-")), F.lit("^-|-$"), F.lit(""))
    dated = F.concat(joined, F.lit("-"), F.date_format(today, "yyyy-MM-dd"))
    return F.when(joined.rlike(r"\d{4}-\d{2}-\d{2}"), joined).otherwise(dated)


def one_decimal(x: Column) -> Column:
    """Text of a number from 1 on with one decimal, rounded from its exact binary
    value (1.15 is stored a little below and gives 1.1; 1.25 goes to the even 1.2).
    """
    whole = F.floor(x)
    tenths = ((x - whole) * F.lit(float(1 << 52))).cast("bigint") * F.lit(10)
    digit, left = F.shiftright(tenths, 52), tenths.bitwiseAND(F.lit((1 << 52) - 1))
    half = F.lit(1 << 51)
    up = (left > half) | ((left == half) & (digit % 2 == 1))
    total = whole * F.lit(10) + digit + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))


def format_bytes(n: Column) -> Column:
    """1024 steps, one decimal."""
    text = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", start=1):
        scale = 1 << (10 * power)
        scaled = F.concat(one_decimal(n / F.lit(float(scale))), F.lit(f" {unit}B"))
        text = F.when(n >= F.lit(scale), scaled).otherwise(text)
    return text


def normalize_stat(name: str) -> str:
    """N14 for a call argument; unknown names mean Sum."""
    for stat, names in STAT_ALIASES.items():
        if name in names:
            return stat
    return "Sum"


def normalize_stat_column(name: Column) -> Column:
    """N14 for a column."""
    out = F.lit("Sum")
    for stat, names in STAT_ALIASES.items():
        out = F.when(name.isin(names), F.lit(stat)).otherwise(out)
    return out


def split_log_field(log: Column) -> Column:
    """The group in ``account:group``, else NULL."""
    return F.get(F.split(log, ":", 2), F.lit(1))


def json_type(value: Column) -> Column:
    """Type of a JSON value as Spark spells it: STRING, BIGINT, DECIMAL(3,2), OBJECT<…>, …"""
    return F.schema_of_variant(value)


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def is_container(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def double_text(value: Column) -> Column:
    """Text of a floating-point JSON number: whole numbers without a point, no exponent."""
    real = value.try_cast("double")
    fixed_point = F.regexp_replace(real.try_cast("decimal(38,17)").cast("string"), F.lit(r"\.?0+$"), F.lit(""))
    whole = F.when((real == F.floor(real)) & (F.abs(real) < 1e18), real.try_cast("bigint").cast("string"))
    return F.coalesce(whole, fixed_point, value.try_cast("string"))


def sample_value(value: Column, kind: Column | None = None) -> Column:
    """Short text of a JSON scalar; numbers as ``%g``."""
    kind = json_type(value) if kind is None else kind
    real = value.try_cast("double")
    whole = F.when((real == F.floor(real)) & (F.abs(real) < 1e18), real.try_cast("bigint").cast("string"))
    return (
        F.when(kind.isin("STRING", "BIGINT", "BOOLEAN"), value.try_cast("string"))
        .when(kind == "VOID", F.lit("null"))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.coalesce(whole, _go_g(real)))
        .otherwise(F.to_json(value))
    )


def _go_g(real: Column) -> Column:
    """Shortest form; exponent only below 1e-4 or from 1e21 on."""
    shortest = real.cast("string")
    size = F.abs(real)
    plain = F.regexp_replace(real.try_cast("decimal(38,17)").cast("string"), F.lit(r"\.?0+$"), F.lit(""))
    mantissa = F.regexp_replace(F.substring_index(shortest, "E", 1), F.lit(r"\.0$"), F.lit(""))
    power = F.substring_index(shortest, "E", -1).try_cast("int")
    digits = F.lpad(F.abs(power).cast("string"), 2, "0")
    wide = F.when(F.abs(power) > 99, F.abs(power).cast("string")).otherwise(digits)
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(mantissa, sign, wide)
    return (
        F.when((size >= 1e21) | (size < 1e-4), F.coalesce(scientific, shortest))
        .when(shortest.contains("E"), F.coalesce(plain, shortest))
        .otherwise(shortest)
    )
