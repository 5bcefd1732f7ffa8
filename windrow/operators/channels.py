"""Channel labels: normal form, allowlist, classes, canonical set and projection.

A file has a few dozen labels, so these work on the label array of the file's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.fixed_values import ELECTRODES, NON_EEG_LABELS


def normalise(label: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", ""))


def is_scalp(label: Column) -> Column:
    """Whether a normalised label is a pair of two different known electrodes."""
    a = F.regexp_extract(label, r"^([A-Z0-9]+)-([A-Z0-9]+)$", 1)
    b = F.regexp_extract(label, r"^([A-Z0-9]+)-([A-Z0-9]+)$", 2)
    return a.isin(ELECTRODES) & b.isin(ELECTRODES) & (a != b)


def classify(labels: Column) -> dict[str, Column]:
    """Kept (normalised, first occurrence), duplicate, non_eeg and unrecognised (as written)."""
    norm = F.transform(labels, normalise)
    tagged = F.transform(
        labels,
        lambda raw, i: F.struct(
            raw.alias("raw"),
            normalise(raw).alias("norm"),
            is_scalp(normalise(raw)).alias("scalp"),
            (F.array_position(norm, normalise(raw)) == i + 1).alias("first"),
        ),
    )
    pick = lambda cond, field: F.transform(F.filter(tagged, cond), lambda s: s[field])
    known = lambda s: s["norm"].isin(NON_EEG_LABELS)
    return {
        "kept": pick(lambda s: s["scalp"] & s["first"], "norm"),
        "duplicate": pick(lambda s: s["scalp"] & ~s["first"], "raw"),
        "non_eeg": pick(lambda s: ~s["scalp"] & known(s), "raw"),
        "unrecognised": pick(lambda s: ~s["scalp"] & ~known(s), "raw"),
    }


def with_classes(files: DataFrame, labels: str = "labels") -> DataFrame:
    return files.withColumns(classify(F.col(labels)))


def project(kept: Column, canonical: list[str], on_missing: str = "skip_file") -> dict[str, Column]:
    """``selected`` labels in canonical order and the ``missing`` ones.

    skip_file selects nothing when one is missing; fill_nan keeps the whole canonical layout.
    """
    wanted = F.array(*[F.lit(c) for c in canonical])
    missing = F.filter(wanted, lambda c: ~F.array_contains(kept, c))
    have = F.filter(wanted, lambda c: F.array_contains(kept, c))
    if on_missing == "skip_file":
        selected = F.when(F.size(missing) == 0, have).otherwise(F.array().cast("array<string>"))
    else:
        selected = wanted
    return {"selected": selected, "missing": missing}


def presence(files: DataFrame, kept: str = "kept") -> DataFrame:
    """Files and share of files that carry each kept label, most common first."""
    n = files.agg(F.count(F.lit(1)).alias("n_all")).withColumn("k", F.lit(0))
    return (
        files.select(F.explode(F.array_distinct(kept)).alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .withColumn("k", F.lit(0))
        .join(n, "k")
        .select("label", "n_files", (F.col("n_files") / F.col("n_all")).alias("frac"))
        .orderBy(F.col("n_files").desc(), "label")
    )


def canonical_set(files: DataFrame, min_presence: float = 0.95, kept: str = "kept") -> DataFrame:
    """Labels present in enough files, by falling count then name."""
    return presence(files, kept).where(F.col("frac") >= min_presence)
