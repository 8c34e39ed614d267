"""Model preparation: stratified split, imputation, encoding, scaling, weights
(survey L1-L6, S12-S14, S17, S18).

Fitted statistics are one-row aggregates (their size is the column count), and
every fitted transform is a plain SQL expression stage, so the resulting
``PipelineModel`` persists and scores without Python UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.operators.ranking import rank_within_groups


def stratified_split(df: DataFrame, fractions: Sequence[tuple[str, float]], label: str = "churn_flag",
                     key: str = "customer_id", seed: int = 42) -> DataFrame:
    """Reproducible stratified split. Inside each class rows are ordered
    by ``md5(key || seed)``; the first ``ceil(n_c * f)`` go to the first named
    part, the next ``ceil(n_c * f)`` to the second, the rest to the last part.
    Ranking uses range-partitioned numbering, so a class holding half the table
    is not gathered into one task. A row without a label raises an error."""
    known = F.when(F.col(label).isNull(), F.raise_error(F.lit(f"{label} is null: a stratified split needs a label")))
    df = df.withColumn(label, known.otherwise(F.col(label)).cast(df.schema[label].dataType))
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    ranked = rank_within_groups(df.withColumn("_h", h), label, [F.col("_h"), F.col(key)], "_rk",
                                count_col="_n", count_if=F.lit(True))
    names = [name for name, _ in fractions]
    expr = None
    edge = F.lit(0)
    for name, frac in fractions[:-1]:
        edge = edge + F.ceil(F.col("_n") * F.lit(float(frac)))
        expr = F.when(F.col("_rk") <= edge, name) if expr is None else expr.when(F.col("_rk") <= edge, name)
    expr = expr.otherwise(names[-1]) if expr is not None else F.lit(names[-1])
    return ranked.withColumn("split", expr).drop("_h", "_rk", "_n")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the most frequent value per string column (smallest on
    ties). Values are counted by (column, value) with map-side combine, so no
    task ever holds the values of a column."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("kv")
    counts = df.select(kv).select("kv.*").where(F.col("value").isNotNull()).groupBy("column", "value").count()
    best = counts.groupBy("column").agg(F.min_by("value", F.struct((-F.col("count")).alias("c"), "value")).alias("mode"))
    return best.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in cols])


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    if not cols:
        return {}
    row = modes(df, cols).first()
    return {c: row[c] for c in cols}


def median_values(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per numeric column, as the reference's imputer (a column without values has none)."""
    from churnlab.operators.ranking import exact_percentiles
    return {r["column"]: r["q0"] for r in exact_percentiles(df, cols, [0.5]).collect()} if cols else {}


def _fill_stage(fills: dict[str, str]) -> SQLTransformer:
    def lit(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    filled = ", ".join(f"coalesce(`{c}`, {lit(v)}) AS `{c}__filled`" for c, v in fills.items())
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def population_scaling(df: DataFrame, cols: Sequence[str], suffix: str = "__scaled") -> SQLTransformer:
    """(x - mean) / population std as a fitted SQL stage (std 0 -> 1, as sklearn)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}|m"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}|s")]
    row = df.agg(*aggs).first()
    parts = []
    for c in cols:
        m = row[f"{c}|m"] or 0.0
        s = row[f"{c}|s"] or 0.0
        s = s if s > 0 else 1.0
        parts.append(f"(CAST(`{c}` AS DOUBLE) - {m!r}D) / {s!r}D AS `{c}{suffix}`")
    return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")


def fit_preprocessor(train: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], scale: bool = False,
                     features_col: str = "features") -> PipelineModel:
    """L2/L3: numeric -> exact median impute [-> population
    standardize]; string -> mode fill -> alphabetical index (unseen values kept
    as an extra last index) -> one-hot dropping that last slot, so an unseen
    category becomes all zeros (``handle_unknown='ignore'``)."""
    stages = []
    num_out = [f"{c}__imp" for c in num_cols]
    if num_cols:
        medians = median_values(train, num_cols)
        filled = ", ".join(f"coalesce(nullif(CAST(`{c}` AS DOUBLE), double('NaN')), {medians.get(c, 0.0)!r}D) AS `{o}`"
                           for c, o in zip(num_cols, num_out))
        stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
    cat_vec = []
    if cat_cols:
        stages.append(_fill_stage(mode_values(train, cat_cols)))
        idx = [f"{c}__idx" for c in cat_cols]
        cat_vec = [f"{c}__ohe" for c in cat_cols]
        stages.append(StringIndexer(inputCols=[f"{c}__filled" for c in cat_cols], outputCols=idx,
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        # The indexer's metadata ends with its "__unknown" label; dropLast removes
        # exactly that slot, so an unseen category encodes as all zeros.
        stages.append(OneHotEncoder(inputCols=idx, outputCols=cat_vec, dropLast=True))
    pre = Pipeline(stages=stages).fit(train)
    if scale and num_cols:
        scaler = population_scaling(pre.transform(train), num_out)
        num_final = [f"{c}__scaled" for c in num_out]
        stages_fitted = list(pre.stages) + [scaler]
    else:
        num_final = num_out
        stages_fitted = list(pre.stages)
    assembler = VectorAssembler(inputCols=num_final + cat_vec, outputCol=features_col, handleInvalid="keep")
    return PipelineModel(stages=stages_fitted + [assembler])


def feature_names(df: DataFrame, features_col: str = "features") -> list[str]:
    """Names of the assembled vector slots, from the ML attribute metadata."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs += group
    names = [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]
    return [n.replace("__imp__scaled", "").replace("__imp", "").replace("__ohe_", "=") for n in names]


def adaptive_scaling(df: DataFrame, cols: Sequence[str], key: str = "customer_id") -> DataFrame:
    """L4: per column, 'amount' in the name -> log1p then standardize; else any
    1.5 IQR outlier -> robust (x - median) / IQR; else standardize (population
    std). Pass 1: quartiles, medians, outlier counts and log moments in one
    aggregate; pass 2: expressions. Columns keep their names (B4)."""
    from churnlab.operators.ranking import exact_percentiles
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}|mean"), F.stddev_pop(x).alias(f"{c}|std"), F.avg(F.log1p(x)).alias(f"{c}|lmean"),
                 F.stddev_pop(F.log1p(x)).alias(f"{c}|lstd")]
    qs = exact_percentiles(df, cols, [0.25, 0.5, 0.75])
    wide_q = qs.groupBy().pivot("column", list(cols)).agg(F.first(F.struct("q0", "q1", "q2")))
    wide_q = wide_q.select(*[F.col(c)[k].alias(f"{c}|{n}") for c in cols
                             for k, n in (("q0", "q1"), ("q1", "med"), ("q2", "q3"))])
    stats = df.agg(*aggs).crossJoin(wide_q)
    outl = df.crossJoin(F.broadcast(stats)).agg(*[
        F.count_if((F.col(c) < F.col(f"{c}|q1") - 1.5 * (F.col(f"{c}|q3") - F.col(f"{c}|q1")))
                   | (F.col(c) > F.col(f"{c}|q3") + 1.5 * (F.col(f"{c}|q3") - F.col(f"{c}|q1")))).alias(f"{c}|out")
        for c in cols])
    s = stats.crossJoin(outl)
    out = df.select(key, *cols).crossJoin(F.broadcast(s))

    def nz(v):
        return F.when(v == 0, F.lit(1.0)).otherwise(v)
    exprs = {}
    for c in cols:
        x = F.col(c).cast("double")
        if "amount" in c.lower():
            e = (F.log1p(x) - F.col(f"{c}|lmean")) / nz(F.col(f"{c}|lstd"))
        else:
            robust = (x - F.col(f"{c}|med")) / nz(F.col(f"{c}|q3") - F.col(f"{c}|q1"))
            standard = (x - F.col(f"{c}|mean")) / nz(F.col(f"{c}|std"))
            e = F.when(F.col(f"{c}|out") > 0, robust).otherwise(standard)
        exprs[c] = F.round(e, 6)
    return out.select(key, *[exprs[c].alias(c) for c in cols])


def dummy_levels(df: DataFrame, cat_cols: Sequence[str], most: int = 1000) -> dict[str, list]:
    """Sorted levels of each categorical column; more than ``most`` raise an error, since each becomes a column."""
    out = {}
    for c in cat_cols:
        values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} levels")
        out[c] = values
    return out


def dummies(df: DataFrame, cat_cols: Sequence[str], key: str = "customer_id",
            levels: dict[str, list] | None = None) -> DataFrame:
    """One 0/1 column per category except the alphabetically first.
    ``levels`` fixes the categories (those of the training part); otherwise they
    are read from ``df``."""
    out = [F.col(key)]
    levels = levels or dummy_levels(df, cat_cols)
    for c in cat_cols:
        for v in levels[c][1:]:
            out.append((F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}"))
    return df.select(*out)


def class_weights(df: DataFrame, label: str = "churn_flag", mode: str | float = "balanced",
                  factor: float = 1.0, out: str = "weight") -> DataFrame:
    """Weight column. ``balanced``: n / (2 n_c); ``ratio``: negatives /
    positives x factor for class 1; a number: that weight for class 1."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))
    x = df.crossJoin(F.broadcast(counts))
    y = F.col(label) == 1
    if mode == "balanced":
        w = F.when(y, F.col("_n") / (2.0 * F.col("_p"))).otherwise(F.col("_n") / (2.0 * (F.col("_n") - F.col("_p"))))
    elif mode == "ratio":
        w = F.when(y, (F.col("_n") - F.col("_p")) / F.col("_p") * F.lit(float(factor))).otherwise(F.lit(1.0))
    else:
        w = F.when(y, F.lit(float(mode))).otherwise(F.lit(1.0))
    return x.withColumn(out, w.cast("double")).drop("_n", "_p")
