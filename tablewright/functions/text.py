"""Scalar column expressions over text: normalisation, numbers, units, labels, mentions.

All are built-in expressions on the JVM; those in :func:`let` run there as a lambda that isn't compiled. Patterns and word lists that results depend
on are marked as fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four ASCII separators.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"
# Fixed values.
NULL_SPELLINGS = ["", "-", "--", "—", "–", "N/A", "NA", "null", "None"]
CURRENCIES = ["RMB", "CNY", "USD", "HKD"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
PERIOD_WORDS = ["year", "month", "quarter", "period", "ended", "as of"]
UNIT_TOKENS = ["人民币百万元", "人民币千元", "人民币万元", "百万元", "千元", "万元", "亿元", "人民币", "million", "billion", "thousand", "yuan", "rmb", "cny", "usd", "hkd", "元"]
HTML_UNIT_MARKERS = ["单位：", "单位:", "Unit:", "Unit："]
KINDS = [
    ("growth", ["同比", "增幅", "增长率", "growth", "increase", "yoy"]),
    ("rate", ["毛利率", "利润率", "比率", "率", "margin", "rate", "ratio"]),
    ("revenue", ["营业收入", "收入", "revenue", "sales"]),
    ("cash_flow", ["现金流", "cash flow", "cash"]),
    ("profit", ["利润", "profit", "income"]),
]
POINTERS = ["该", "上述", "上文", "图中", "this", "the"]
MENTIONED = [
    ("growth", ["增幅", "增长率", "同比增长", "increase", "growth"]),
    ("rate", ["比率", "毛利率", "利润率", "率", "margin", "rate", "ratio"]),
    ("revenue", ["营业收入", "收入", "revenue", "sales"]),
    ("cash_flow", ["现金流", "经营现金流", "cash flow", "cash"]),
    ("amount", ["金额", "数值", "amount", "figure", "value"]),
]
FINANCIAL_TERMS = ["revenue", "income", "asset", "liabil", "equity", "cash", "expense", "profit", "loss", "debt", "operating", "balance", "financial", "资产负债表", "利润表", "现金流量表", "财务报表", "所有者权益", "股东权益", "营业收入", "营业成本", "货币资金", "净资产", "负债", "资产", "权益", "现金", "收入", "利润", "成本", "费用", "财务", "会计"]
CONFIDENCE_SIGNALS = ["table_unit", "period_header", "row_label", "source_evidence", "peer_period_values"]
# End of fixed values.

#: A text that is a number as it stands, or after a currency's code; most cells are, and need none of the steps that others do.
_PLAIN = r"^[0-9]+(?:\.[0-9]+)?\z"
_CODED = rf"^(?:{'|'.join(CURRENCIES)}) ?[0-9]+(?:\.[0-9]+)?\z"
#: What no number has: a character that no number is written with, or two letters behind a digit.
_NEVER = r"[^0-9.+\-a-fhikmnrstuyA-FHIKMNRSTUY()（）,，%％￥¥$*†‡\x01\p{IsWhite_Space}\x1c-\x1f]|[0-9][,， %％￥¥$]*[A-Za-z]{2}"
_NUMBER = r"^(\x01?[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity)))$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it; keeps expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; null as the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), SPACE, " "))


def slugify_name(c: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits as ``_``; ``table`` if nothing is left."""
    slug = F.btrim(F.regexp_replace(F.lower(normalize_text(c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.when(slug == "", "table").otherwise(slug)


def first_text(*columns: Column | str) -> Column:
    """The first text that isn't empty after normalisation; empty if all are."""
    return F.coalesce(*[F.nullif(normalize_text(c), F.lit("")) for c in columns], F.lit(""))


def safe_int(c: Column | str, default: int) -> Column:
    """A whole number of at least 1; ``default`` for anything else."""
    number = F.trim(_col(c).cast("string")).try_cast("int")
    return F.when(number.isNotNull(), F.greatest(number, F.lit(1))).otherwise(default)


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def parse_cell(c: Column) -> Column:
    """:func:`parse_number` of a column or a lambda's variable, which it names several times."""
    return F.when(c.rlike(_PLAIN), c.try_cast("double")).when(c.rlike(_CODED), F.substring(c, 4, 1 << 30).try_cast("double")).when(c.rlike(_NEVER), F.lit(None)).otherwise(parse_number(c))


def parse_number(c: Column | str) -> Column:
    """The number that a cell shows, as a double, or null.

    Parentheses (half or full width, also mixed) mean negative, an opening one alone too if a digit
    follows. Separators, spaces, percent and currency signs go, then a leading currency code, then
    trailing footnote marks. Percentages aren't scaled. Digits with underscores and full-width digits
    aren't numbers.
    """
    if isinstance(c, str):
        return parse_cell(F.col(c))
    # Each step refers to the one before once, so the expression stays small. \x01 marks a negative.
    text = F.regexp_replace(normalize_text(c), r"^[(（](.*)[)）]$", "\x01$1")
    text = F.regexp_replace(text, r"^[(（](?=.*\p{Nd})", "\x01")
    text = F.translate(text, ",， %％￥¥$", "")
    text = F.regexp_replace(text, rf"^(\x01?)(?i:{'|'.join(CURRENCIES)})", "$1")
    text = F.regexp_extract(F.regexp_replace(text, r"[*†‡]+$", ""), _NUMBER, 1)
    text = F.regexp_replace(F.regexp_replace(text, r"^\x01-", "+"), r"^\x01\+?", "-")
    return text.try_cast("double")


def looks_like_period(c: Column | str) -> Column:
    text = F.lower(normalize_text(c))
    return text.rlike(rf"(?U)\b({'|'.join(MONTHS)})[a-z]*\b") | text.rlike(rf"(?U)\b({'|'.join(PERIOD_WORDS)})\b")


def looks_numeric(c: Column | str) -> Column:
    """Would a reader take the cell for a number? Period labels aren't numbers."""
    if isinstance(c, str):
        return F.when(F.col(c).rlike(_PLAIN) | F.col(c).rlike(_CODED), True).otherwise(looks_numeric(F.col(c)))
    text = normalize_text(c)
    priced = text.rlike(rf"(?iU)[$￥¥%％]|\b({'|'.join(CURRENCIES)})\b")
    compact = F.regexp_replace(F.regexp_replace(text, r"(?U)[\s,，$￥¥%％()（）*†‡+\-—–]", ""), f"^(?i)({'|'.join(CURRENCIES)})", "")
    shape = compact.rlike(r"^\p{Nd}+(\.\p{Nd}+)?$") | priced | text.rlike(r"^[\p{Nd}OoIl.,，()（）+\-—–\s$￥¥%％]+$")
    return has_digit(text) & ~looks_like_period(text) & shape


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(normalize_text(F.regexp_extract(text, pattern, group)), F.lit(""))


def unit_from_text(c: Column | str) -> Column:
    """A unit in running text: after the Chinese marker, a currency with a scale, or an RMB phrase; else empty."""
    text = normalize_text(c)
    marked = _found(text, r"单位 ?[:：] ?([^,，。；;\n]+)", 1)
    priced = _found(text, r"(?i)(RMB|CNY|USD|HKD)\s*(thousand|million|billion|yuan|元|千元|万元|百万元)", 0)
    worded = _found(text, r"人民币[^,，。；;\n]*(元|千元|万元|百万元)", 0)
    return F.coalesce(marked, priced, worded, F.lit(""))


def html_unit(c: Column | str) -> Column:
    """The word after the first unit marker that the text has, markers in order; else empty."""
    text = normalize_text(c)
    tail = lambda m: F.trim(F.substring(text, F.locate(m, text) + len(m), 1 << 30))
    word = reduce(lambda rest, m: F.when(F.contains(text, F.lit(m)), F.substring_index(tail(m), " ", 1)).otherwise(rest), reversed(HTML_UNIT_MARKERS), F.lit(""))
    return F.btrim(word, F.lit(" ,，;；。"))


def year_from_text(c: Column | str) -> Column:
    """The first 19xx or 20xx; else empty."""
    return F.regexp_extract(_col(c), r"((?:20|19)\d{2})", 1)


def contains_ci(c: Column | str, token: Column | str) -> Column:
    """Case-insensitive containment of normalised texts; an empty token is in every text."""
    return F.contains(F.lower(normalize_text(c)), F.lower(normalize_text(token)))


def safe_ratio(n: Column, d: Column) -> Column:
    return F.when(d <= 0, 1.0).otherwise(n / F.nullif(d, F.lit(0)))


def fix_ocr_digits(c: Column | str) -> Column:
    return F.translate(_col(c), "OoIl", "0011")


def unit_tokens(c: Column | str) -> Column:
    """The known unit tokens that a text names, longest first."""
    text = normalize_text(c)
    ordered = sorted(UNIT_TOKENS, key=lambda t: (-len(t), UNIT_TOKENS.index(t)))
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)) | F.contains(F.lower(text), F.lit(t)), t) for t in ordered]))


def strip_context_unit(c: Column | str, units: Column | str) -> Column:
    """A cell without the units that its context names; null if the context names none or nothing is left.

    Longer tokens are tried first at each place. Latin tokens go at word borders only, without case.
    """
    ordered = sorted(UNIT_TOKENS, key=lambda t: (-len(t), UNIT_TOKENS.index(t)))
    named = let(F.lower(normalize_text(units)), lambda text: F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), t) for t in ordered])))
    # The named tokens stand behind the cell, where the one pattern of all tokens looks for what it found: a pattern of each row's own would be compiled each time.
    latin, other = ("|".join(t for t in ordered if t.isascii() == kind) for kind in (True, False))
    first = "".join(dict.fromkeys(x for t in ordered for x in (t[0], t[0].upper())))
    pattern = rf"(?siU)(?=(?-i:[{first}]))(?:\b({latin})\b(?=.*\x02[^\x02]*\|\1\|[^\x02]*$)|({other})(?=.*\x02[^\x02]*\|\2\|[^\x02]*$))"

    def without(behind: Column) -> Column:
        left = F.regexp_replace(F.concat(_col(c), behind), pattern, "")
        return let(left, lambda text: F.substring(text, F.lit(1), F.length(text) - F.length(behind)))

    cut = let(F.array_join(named, "|"), lambda p: F.when(p != "", let(F.concat(F.lit("\x02|"), p, F.lit("|")), without)))
    return let(normalize_text(cut), lambda left: F.when(left != "", left))


def metric_kind(label: Column | str, period: Column | str, title: Column | str) -> Column:
    """The kind of figure by the first rule whose words occur in label, period or title."""
    return let(F.lower(normalize_text(F.concat_ws(" ", normalize_text(label), normalize_text(period), normalize_text(title)))), kind_of)


def kind_of(text: Column) -> Column:
    """:func:`metric_kind` of a lower-cased text, which is named once a word."""
    rule = lambda words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return reduce(lambda rest, k: F.when(rule(k[1]), k[0]).otherwise(rest), reversed(KINDS), F.lit("amount"))


def reference_mentions(c: Column | str) -> Column:
    """array<struct<kind, phrase>>: each distinct pointing phrase, by kind, then by its first place."""
    text = normalize_text(c)
    pointer = "|".join(POINTERS)

    def found(kind: str, words: list[str]) -> Column:
        phrases = F.regexp_extract_all(text, F.lit(rf"(?i)(?:{pointer})\s*(?:{'|'.join(words)})"), F.lit(0))
        return F.transform(F.array_distinct(phrases), lambda p: F.struct(F.lit(kind).alias("kind"), normalize_text(p).alias("phrase")))

    per_kind = [found(kind, words) for kind, words in MENTIONED]
    return F.array_distinct(F.concat(*per_kind))


def financial_relevance(text: Column) -> Column:
    """Quarter points for each financial term in lower-cased ``text``, at most 1."""
    hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in FINANCIAL_TERMS])
    return F.round(F.least(F.lit(1.0), hits / 4), 4)


def repair_confidence(used: Column, base: Column | float) -> Column:
    """``base`` and 0.04 for each of five signals in ``used``, at most 0.98."""
    base = F.lit(base) if isinstance(base, float) else base
    n = reduce(lambda a, b: a + b, [F.array_contains(used, s).cast("int") for s in CONFIDENCE_SIGNALS])
    return F.round(F.least(F.lit(0.98), base + 0.04 * n), 2)


def risk_rank(c: Column | str) -> Column:
    return F.when(_col(c) == "low", 0).when(_col(c) == "high", 2).otherwise(1)


def input_slug(index: Column, path: Column, url: Column, role: Column) -> Column:
    """``input_NN_`` and the file name's stem as a slug, the role if that is empty."""
    name = F.regexp_extract(F.coalesce(F.nullif(path, F.lit("")), F.nullif(url, F.lit("")), F.format_string("input_%d", index)), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    slug = F.btrim(F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.format_string("input_%02d_%s", index, F.coalesce(F.nullif(slug, F.lit("")), role))


def nearest_rank(values: Column, q: float) -> Column:
    """The element at round((n-1)q), halves to even, of an array sorted here; null if it is empty."""
    s = F.sort_array(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.bround((F.size(s) - 1) * F.lit(q), 0) + 1).cast("int")))
