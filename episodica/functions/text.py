"""Text and category functions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The full format of an ATC code, and the CKD stages that keep their own category.
FULL_ATC = r"^\w\d{2}\w{2}\d{2}"
CKD_STAGES = ["N181", "N182", "N183", "N184", "N185"]
CKD_OTHER = "N189"


def parse_number(text: Column) -> Column:
    """First number in a text, null if there is none; grouping commas are dropped."""
    plain = F.regexp_replace(text, ",", "")
    return F.regexp_extract(plain, r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|-?\.\d+)", 1).try_cast("double")


def parse_ts(text: Column, *formats: str) -> Column:
    """First format that fits, as a zone-free timestamp."""
    tried = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tried).cast("timestamp_ntz")


def code_part(code: Column, start: int, length: int | None = None) -> Column:
    """Substring from a 1-based start; without a length, to the end."""
    return F.substring(code, start, length if length is not None else 2147483647)


def atc_level2(atc: Column) -> Column:
    return code_part(atc, 1, 3)


def strip_chars(text: Column, chars: str) -> Column:
    """Remove every occurrence of the given characters."""
    return F.translate(text, chars, "")


def sentence(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def prettify(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Apply regular-expression replacements one after the other."""
    for pattern, replacement in pairs:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def feature_title(feature: Column) -> Column:
    """Feature name as the title of a figure panel."""
    # fixed values: the replacements, in order
    words = prettify(feature, [("n_", "No. "), ("icd", "ICD"), ("atc", "ATC"), ("_", " ")])
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 2147483647))


def split_to(df: DataFrame, col: str, sep: str, names: Sequence[str]) -> DataFrame:
    """Split one text column into named columns; sep is taken literally."""
    parts = F.split(F.col(col), r"\Q" + sep + r"\E")
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def reverse_text(text: Column) -> Column:
    return F.reverse(text)


def concat_unique(value: Column, sep: str = ", ") -> Column:
    """Aggregate: the distinct values of a group (a code vocabulary, not free rows), sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def dose(strength: Column, volume: Column) -> Column:
    return strength * volume


def dose_unit(unit: Column) -> Column:
    """mg/ml times a volume is mg; other units are lowered."""
    return F.when(unit == "mg/ml", "mg").otherwise(F.lower(unit))


def ckd_stage(code: Column) -> Column:
    """N181..N185 stay, any other kidney code becomes N189."""
    return F.when(code.isin(*CKD_STAGES), code).otherwise(F.lit(CKD_OTHER))


def cut(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval (breaks[i], breaks[i+1]] that holds the value; infinite ends allowed."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per interval")
    out = None
    for upper, label in zip(breaks[1:], labels):
        test = value <= F.lit(float(upper))
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(value > F.lit(float(breaks[0])), out)


def rate_flag(r: Column, t: Column, at_least: float) -> Column:
    """1 if r/t reaches the rate. With t = 0: 1 if r > 0, null if r = 0 too."""
    reached = (r / F.when(t != 0, t) >= at_least).cast("int")
    return F.when(t == 0, F.when(r > 0, 1)).otherwise(reached)


def clamp(value: Column, lo, hi) -> Column:
    """The value, or the bound it is beyond; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))


def json_num(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).cast("double")


def json_choice(distribution: Column, value: Column) -> Column:
    """Decode a categorical parameter: the value is an index into attributes.choices; others are shown as text."""
    choices = F.from_json(F.get_json_object(distribution, "$.attributes.choices"), "array<string>")
    decoded = F.get(choices, value.cast("int"))
    return F.when(distribution.contains("Categorical"), decoded).otherwise(value.cast("string"))


def yes_no(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), "yes").otherwise("no")


def redact(text: Column, lo: int = 1, hi: int = 4) -> Column:
    """Replace a cell whose leading count is lo..hi by '<hi+1'."""
    count = F.split(text, " ").getItem(0).try_cast("int")
    return F.when(count.between(lo, hi), F.lit(f"<{hi + 1}")).otherwise(text)
