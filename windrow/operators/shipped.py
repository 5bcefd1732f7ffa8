"""Stored models as column expressions.

A fitted model becomes a table of nodes (or of weights) and one row of facts: its kind, the feature columns in order,
their medians, the hash of the extraction that made the features, and the version of this format. Scoring reads
the table as one row of arrays and walks the trees, or sums the weighted columns, with built-in functions
alone; the plan holds no Python. A model is refused where a column is missing or the extraction differs.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators import fold_fits as ff

VERSION = 1
NODES = "at int, root boolean, feature int, cut double, absent_left boolean, left int, value double"
FACTS = "version int, kind string, base double, depth int, columns array<string>, medians array<double>, extraction_hash string, n_rows long"


def nodes_of(kind: str, body, facts: ff.Facts, first: int) -> tuple[list[tuple], float, int]:
    """Rows of ``NODES`` numbered from ``first``, the base score, and the deepest tree's levels.

    Nodes below splits that were taken back are left out; a split's children stay side by side.
    """
    base, groups = 0.0, []
    if kind == "hgb":
        parts, base = body
        groups = [(t, v, 1) for t, v in parts]
    else:
        groups = [body]
    rows, depth = [], 0
    for t, values, roots in groups:
        left = t["left"]
        level = np.where(np.arange(len(left)) < roots, 0, -1)
        for k in range(len(left)):
            if level[k] >= 0 and left[k] >= 0:
                level[left[k] : left[k] + 2] = level[k] + 1
        place = first + np.cumsum(level >= 0) - 1
        for k in np.flatnonzero(level >= 0).tolist():
            feature, cut, below = -1, None, -1
            if left[k] >= 0:
                feature, bin_, below = int(t["feature"][k]), int(t["cut"][k]), int(place[left[k]])
                if kind == "rf":  # the last fine bin of the coarse one
                    bin_ = ((bin_ + 1) * ff.BINS - 1) // ff.FOREST_BINS
                edges = facts.edges[feature]
                cut = float(edges[bin_]) if bin_ < len(edges) else float("inf")
            rows.append((int(place[k]), k < roots, feature, cut, bool(t["absent_left"][k]), below, float(values[k])))
        first += int((level >= 0).sum())
        depth = max(depth, int(level.max()))
    return rows, base, depth


def linear_rows(body) -> list[tuple]:
    """Weights as nodes: the weight of each column on its own scale, the intercept last."""
    mean, spread, beta = body
    own = beta[:-1] / spread
    return [(k, False, -1, None, False, -1, float(w)) for k, w in enumerate([*own, beta[-1] - (own * mean).sum()])]


def ship(
    rows: DataFrame, columns: list[str], name: str, seed: int, extraction_hash: str, path: str, uid: str = "window_uid", params: dict | None = None
) -> None:
    """Fit one model on all rows and store it under ``path``."""
    fit, spark = ff.Fit(0, name, tuple((params or {}).items())), rows.sparkSession
    models, facts = ff.fitted(rows, columns, F.array(F.lit(True)), F.array(F.lit(0).cast("tinyint")), 1, [fit], seed, uid)[:2]
    nodes, base, depth, kind = [], 0.0, 0, name
    for r in models.orderBy("part").collect():  # the model: of bounded size by its parameters
        body, kind = pickle.loads(r["body"]), r["kind"]
        if kind == "constant":
            base = float(body)
        elif kind == "logreg":
            nodes = linear_rows(body)
        else:
            more, base, deep = nodes_of(kind, body, facts, len(nodes))
            nodes, depth = nodes + more, max(depth, deep)
    spark.createDataFrame(nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    medians = [float(m) for m in facts.median[0]]
    row = (VERSION, kind, base, depth, list(columns), medians, extraction_hash, int(facts.rows[0]))
    spark.createDataFrame([row], FACTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


ARRAYS = ("root", "feature", "cut", "absent_left", "left", "value")


def stored_model(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Facts of a stored model, and its nodes as one row of arrays in their order."""
    facts = spark.read.schema(FACTS).parquet(f"{path}/facts").head().asDict()
    if facts["version"] != VERSION:
        raise ValueError(f"model of format {facts['version']}, not {VERSION}")
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
    listed = nodes.agg(F.array_sort(F.collect_list(F.struct("at", *ARRAYS))).alias("n"))
    part = lambda c: F.transform("n", lambda x: x[c]).alias(c)
    return facts, listed.select(F.struct(*[part(c) for c in ARRAYS]).alias("model"))


def score_of(facts: dict, model: Column, values: Column) -> Column:
    """The score of a row whose features are the array ``values``, null where absent; built-in functions only."""
    kind, base, medians = facts["kind"], facts["base"], F.array(*[F.lit(m) for m in facts["medians"]])
    if kind == "constant":
        return F.lit(base)
    filled = F.zip_with(values, medians, lambda x, m: F.coalesce(x, m))
    if kind == "logreg":
        terms = F.zip_with(F.slice(model["value"], 1, len(facts["medians"])), filled, lambda w, x: w * x)
        return 1 / (1 + F.exp(-F.aggregate(terms, F.element_at(model["value"], -1), lambda a, x: a + x)))
    x = filled if kind == "rf" else values

    def down(at: Column) -> Column:
        value, child = F.get(x, F.get(model["feature"], at)), F.get(model["left"], at)
        goes_left = F.when(value.isNull(), F.get(model["absent_left"], at)).otherwise(value <= F.get(model["cut"], at))
        return F.when(child < 0, at).otherwise(child + F.when(goes_left, 0).otherwise(1))

    levels = F.sequence(F.lit(1), F.lit(max(1, facts["depth"])))
    roots = F.filter(F.transform(model["root"], lambda r, k: F.when(r, k).otherwise(-1)), lambda k: k >= 0)
    leaves = F.transform(roots, lambda r: F.aggregate(levels, r, lambda at, _: down(at)))
    total = F.aggregate(leaves, F.lit(0.0), lambda a, at: a + F.get(model["value"], at))
    return 1 / (1 + F.exp(-(total + F.lit(base)))) if kind == "hgb" else total


def score_with(rows: DataFrame, path: str, extraction_hash: str) -> DataFrame:
    """Rows without the features, with the ``score`` of the model stored under ``path``."""
    facts, model = stored_model(rows.sparkSession, path)
    if facts["extraction_hash"] != extraction_hash:
        raise ValueError(f"extraction_mismatch: the model was fitted on {facts['extraction_hash']}, not {extraction_hash}")
    absent = [c for c in facts["columns"] if c not in rows.columns]
    if absent:
        raise ValueError(f"schema_mismatch: missing {absent}")
    x = [F.col(f"`{c}`").cast("double") for c in facts["columns"]]
    values = F.array(*[F.when(~F.isnan(v), v) for v in x])
    names = [F.col(f"`{c}`") for c in rows.columns if c not in set(facts["columns"])]
    held = rows.select(*names, values.alias("__x"), model.scalar().alias("__model"))
    return held.withColumn("score", score_of(facts, F.col("__model"), F.col("__x"))).drop("__x", "__model")
