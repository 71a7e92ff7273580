"""Label and category expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telvane.functions.scalars import col

# Spellings that mean "benign".
NORMAL_NAMES = ["0", "normal", "benign", "safe", "legitimate"]
NORMAL_CLASS_SPELLINGS = [
    "0", "0.0", "Normal", "normal", "NORMAL", "Benign", "benign", "BENIGN", "legitimate", "safe",
]
NORMAL_BINARY_SPELLINGS = ["0", "Normal", "normal", "NORMAL", "Benign", "benign", "BENIGN"]

# Columns searched for labels and categories, in order.
LABEL_COLUMNS = ["label", "Label", " Label", "binary_label", "class"]
LABEL_FALLBACK_COLUMNS = ["attack_cat", "attack_type", "Attack", "Normal/Attack", "target"]
CATEGORY_COLUMNS = ["attack_cat", "attack_type", "Attack", "Label", " Label", "class"]
GENERIC_LABEL_COLUMNS = [
    "label", "class", "attack", "category", "attack_type", "target", "intrusion", "anomaly", "type",
]


def folded(c: Column | str) -> Column:
    return F.lower(F.trim(col(c).cast("string")))


def is_benign_name(c: Column | str) -> Column:
    """Exact benign spelling (trimmed, case-folded); null is not benign."""
    return F.coalesce(folded(c).isin(NORMAL_NAMES), F.lit(False))


def binary_from_text(c: Column | str) -> Column:
    """0 for a benign spelling or any text containing 'normal'/'benign'; null counts as normal."""
    text = F.coalesce(folded(c), F.lit("normal"))
    benign = text.isin(NORMAL_NAMES) | text.contains("normal") | text.contains("benign")
    return F.when(benign, 0).otherwise(1)


def binary_from_number(c: Column | str) -> Column:
    return F.when(F.coalesce(col(c).try_cast("double"), F.lit(0.0)) > 0, 1).otherwise(0)


def binary_from_class(c: Column | str, numeric: bool) -> Column:
    """Class label to 0/1: any non-zero integer, or any text outside the seven benign spellings."""
    if numeric:
        return F.when(col(c) != 0, 1).otherwise(0)
    return F.when(col(c).cast("string").isin(NORMAL_BINARY_SPELLINGS), 0).otherwise(1)


def category(label: Column | str, name: Column | str | None) -> Column:
    """Category forced to 'Normal' on label 0; 'Unknown' for null names, 'Attack' without a name column."""
    other = F.lit("Attack") if name is None else F.coalesce(col(name).cast("string"), F.lit("Unknown"))
    return F.when(col(label) == 0, "Normal").otherwise(other)


def composite_category(attack: Column | str, flags: dict[str, Column | str], prefix: str = "HAI") -> Column:
    """'Normal', '<prefix>_P1_P3' for the raised sub-flags, '<prefix>_System' when none is raised."""
    raised = F.concat_ws("_", *[F.when(col(c).cast("int") == 1, F.lit(name)) for name, c in flags.items()])
    return (
        F.when(F.coalesce(col(attack).cast("int"), F.lit(0)) == 0, "Normal")
        .when(raised == "", f"{prefix}_System")
        .otherwise(F.concat(F.lit(f"{prefix}_"), raised))
    )
