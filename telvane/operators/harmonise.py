"""Mapping heterogeneous flow tables onto the unified schema: one projection per source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telvane.functions import labels as L
from telvane.functions.scalars import digest, digest_number, hash_mod
from telvane.operators import vocab as V
from telvane.schema import FEATURES, SEED


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def normalise_headers(df: DataFrame, lower: bool = True, underscores: bool = True) -> DataFrame:
    """Strip, lower-case and underscore the column names; metadata only."""

    def fix(name: str) -> str:
        name = name.strip()
        name = name.lower() if lower else name
        return name.replace(" ", "_") if underscores else name

    return df.toDF(*[fix(c) for c in df.columns])


def name_positional(df: DataFrame) -> DataFrame:
    """Name the columns of a headerless connection-record table by position.

    Tables narrower than the known layout get f0..fN plus the two trailing names.
    """
    width = len(df.columns)
    if width >= len(V.KDD_COLUMNS):
        return df.toDF(*V.KDD_COLUMNS, *df.columns[len(V.KDD_COLUMNS):])
    if "attack_type" in df.columns:
        return df
    return df.toDF(*[f"f{i}" for i in range(width - 2)], "attack_type", "difficulty_level")


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Apply the renames whose source exists, as one projection; a replaced target is dropped."""
    hit = {s: t for s, t in renames.items() if s in df.columns}
    replaced = set(hit.values()) - set(hit)
    return df.select(*[quoted(c).alias(hit.get(c, c)) for c in df.columns if c in hit or c not in replaced])


def taxonomy_table(df: DataFrame) -> DataFrame:
    rows = [(name, cat, 0 if name == "normal" else 1) for name, cat in V.KDD_TAXONOMY.items()]
    return df.sparkSession.createDataFrame(rows, "__name string, __cat string, __label int")


def with_taxonomy(df: DataFrame, name: str = "attack_type") -> DataFrame:
    """attack_cat and label by attack name; unlisted names are ('Unknown', 1).

    The lookup table has 40 fixed rows, so it is always broadcast.
    """
    default_cat, default_label = V.TAXONOMY_DEFAULT
    keyed = df.withColumn(name, F.lower(F.trim(quoted(name))))
    return (
        keyed.join(F.broadcast(taxonomy_table(df)), keyed[name] == F.col("__name"), "left")
        .withColumn("attack_cat", F.coalesce("__cat", F.lit(default_cat)))
        .withColumn("label", F.coalesce("__label", F.lit(default_label)))
        .drop("__name", "__cat", "__label")
    )


def protocol_code(c: Column | str) -> Column:
    pairs = [F.lit(v) for item in V.PROTOCOL_CODES.items() for v in item]
    c = quoted(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(c)), F.lit(0))


def synthetic_feature(feature: str, row_id: str, seed: int = SEED) -> Column:
    """A stand-in value for a feature the source lacks, decided by the row key alone.

    Same value for any partitioning. Normal values come from two uniforms
    (Box-Muller) and are folded to be non-negative.
    """
    kind, a, b = V.FEATURE_DEFAULTS[feature]
    hexed = digest(f"{seed}:{feature}", row_id)
    u1 = (digest_number(hexed, 1) + F.lit(0.5)) / F.lit(4294967296.0)
    u2 = (digest_number(hexed, 9) + F.lit(0.5)) / F.lit(4294967296.0)
    if kind == "uniform":
        return F.lit(a) + F.lit(b - a) * u1
    if kind == "integer":
        return F.floor(F.lit(float(a)) + F.lit(float(b - a)) * u1).cast("double")
    drawn = F.abs(F.lit(a) + F.lit(b) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2))
    return F.floor(drawn).cast("double") if kind == "whole normal" else drawn


def device_number(row_id: str, devices: int = 20) -> Column:
    return F.format_string("device_%03d", hash_mod(devices, row_id, seed="device"))


def complete(df: DataFrame, row_id: str = "row_id", devices: int = 20) -> DataFrame:
    """Add what the unified schema needs and the source lacks: features, label, category, device."""
    missing = {f: synthetic_feature(f, row_id) for f in FEATURES if f not in df.columns}
    extra: dict[str, Column] = dict(missing)
    if "label" not in df.columns:
        extra["label"] = F.lit(0)
    if "attack_cat" not in df.columns:
        extra["attack_cat"] = F.lit("Normal")
    if "device_id" not in df.columns:
        extra["device_id"] = device_number(row_id, devices)
    return df.withColumns(extra) if extra else df


def harmonise_kdd(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Connection records by position: taxonomy, renames, protocol code over the renamed column."""
    keys = [c for c in df.columns if c == row_id]
    named = name_positional(df.drop(*keys)) if not keys else _named_with_key(df, row_id)
    if "attack_type" in named.columns:
        named = with_taxonomy(named)
    else:
        named = named.withColumn("attack_cat", F.lit("Unknown")).withColumn("label", F.lit(0))
    out = rename_columns(named, V.KDD_RENAMES)
    if "protocol_type" in out.columns:
        out = out.withColumn("protocol_distribution", protocol_code("protocol_type"))
    return complete(out, row_id)


def _named_with_key(df: DataFrame, row_id: str) -> DataFrame:
    others = [c for c in df.columns if c != row_id]
    named = name_positional(df.select(*[quoted(c) for c in others]))
    return df.select(*[quoted(o).alias(n) for o, n in zip(others, named.columns)], quoted(row_id))


def harmonise_kdd_csv(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Connection records with a header: the label column is one of four names."""
    df = normalise_headers(df, underscores=False)
    source = next((c for c in V.KDD_CSV_LABELS if c in df.columns), None)
    if source:
        named = with_taxonomy(df.withColumn("attack_type", quoted(source).cast("string")))
        normal = F.coalesce(F.col("attack_type") == "normal", F.lit(False))
        df = named.withColumn("label", F.when(normal, 0).otherwise(1))
    return complete(rename_columns(df, V.KDD_RENAMES), row_id)


def harmonise_cic(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Flow-meter CSV: ten renames, label 0 only for BENIGN."""
    out = rename_columns(normalise_headers(df, lower=False, underscores=False), V.CIC_RENAMES)
    if "label" in out.columns:
        benign = F.coalesce(F.upper(F.trim(F.col("label").cast("string"))) == "BENIGN", F.lit(False))
        out = out.withColumn("label", F.when(benign, 0).otherwise(1))
    else:
        out = out.withColumn("label", F.lit(0))
    return complete(out.withColumn("attack_cat", F.when(F.col("label") == 0, "Normal").otherwise("Attack")), row_id)


def harmonise_rt_iot(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Flow-meter export with dotted names; label from attack_type, else from a 0/1 label."""
    out = rename_columns(normalise_headers(df, underscores=False), V.RT_IOT_RENAMES)
    if "attack_type" in out.columns:
        normal = F.coalesce(F.col("attack_type") == "Normal", F.lit(False))
        out = out.withColumn("attack_cat", F.col("attack_type")).withColumn("label", F.when(normal, 0).otherwise(1))
    elif "label" in out.columns:
        out = out.withColumn("attack_cat", F.when(F.col("label") == 0, "Normal").when(F.col("label") == 1, "Attack"))
    else:
        out = out.withColumn("label", F.lit(0)).withColumn("attack_cat", F.lit("Normal"))
    return complete(out, row_id)


def harmonise_unsw(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Flow records whose label and category keep their names."""
    return complete(rename_columns(df, V.UNSW_RENAMES), row_id)


def find_label_column(columns: list[str]) -> str | None:
    return next((c for c in L.GENERIC_LABEL_COLUMNS if c in columns), None)


def is_binary_column(df: DataFrame, column: str) -> bool:
    """True if no non-null value differs from 0 and 1; one aggregate, no distinct list."""
    text = F.trim(quoted(column).cast("string"))
    other = F.max(F.when(text.isNotNull() & ~text.isin("0", "1", "0.0", "1.0"), 1).otherwise(0))
    return df.agg(other.alias("other")).first()["other"] != 1


def label_generic(df: DataFrame) -> DataFrame:
    """label and attack_cat from whichever of nine columns exists first."""
    source = find_label_column(df.columns)
    if source is None:
        return df.withColumn("label", F.lit(0)).withColumn("attack_cat", F.lit("Normal"))
    if is_binary_column(df, source):
        out = df.withColumn("label", F.coalesce(quoted(source).try_cast("double").cast("int"), F.lit(0)))
        return out.withColumn("attack_cat", F.when(F.col("label") == 0, "Normal").otherwise("Attack"))
    return df.withColumns(
        {
            "attack_cat": F.coalesce(quoted(source).cast("string"), F.lit("nan")),
            "label": F.when(L.is_benign_name(quoted(source)), 0).otherwise(1),
        }
    )


def positional_renames(df: DataFrame, exclude: set[str]) -> dict[str, str]:
    """i-th missing feature <- i-th numeric column, leaving labels and keys alone."""
    numeric = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]
    return {numeric[i]: f for i, f in enumerate(FEATURES) if f not in df.columns and i < len(numeric)}


def harmonise_generic(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Best effort for an unknown table: find the label, take numeric columns by position."""
    df = normalise_headers(df)
    source = find_label_column(df.columns)
    labelled = label_generic(df)
    keep_out = {c for c in ("label", source, row_id) if c}
    return complete(rename_columns(labelled, positional_renames(labelled, keep_out)), row_id)


def infer_labels(df: DataFrame, out: str = "y") -> DataFrame:
    """0/1 label from the first label column present: numbers by sign, text by benign spellings."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    for name in L.LABEL_COLUMNS:
        if name in df.columns:
            rule = L.binary_from_number if name in numeric else L.binary_from_text
            return df.withColumn(out, rule(quoted(name)))
    for name in L.LABEL_FALLBACK_COLUMNS:
        if name in df.columns:
            return df.withColumn(out, L.binary_from_text(quoted(name)))
    raise ValueError("no label column found")


def infer_categories(df: DataFrame, label: str = "y", out: str = "category") -> DataFrame:
    name = next((c for c in L.CATEGORY_COLUMNS if c in df.columns), None)
    return df.withColumn(out, L.category(label, quoted(name) if name else None))


def unified(df: DataFrame) -> DataFrame:
    """Exactly the unified columns and types; absent optional ones become null."""
    from telvane.schema import UNIFIED_SCHEMA

    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in UNIFIED_SCHEMA.fields
        ]
    )


def append_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; missing columns become null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
