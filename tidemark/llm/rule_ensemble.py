"""Quality classifier as a sparse rule ensemble compiled into Spark columns.

Text statistics are built-in column expressions.  On a bounded sample of
labelled rows a small random forest is grown; every path from a root to a
node becomes a conjunctive rule (``statistic <= cut`` / ``> cut``); a lasso
logistic regression over all rules keeps few of them; the score is a column
expression again, so scoring is a map-only native job over whole texts.

Cases: a null or empty text has zero statistics and is scored like any
other; with no labelled row the score is 0.5, with a single label value it
is that value; an empty table gives an empty result; repeated rows get equal
scores; statistics live under names of their own, and only the id and the
text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_texts

Condition = tuple[str, bool, float]  # statistic, is above the cut, cut
Rule = tuple[Condition, ...]


def _count(pattern: str) -> Column:
    """Characters of the text left when runs that match ``pattern`` are taken out."""
    return F.length(F.regexp_replace("text", pattern, "")).cast("double")


def statistics(df: DataFrame) -> DataFrame:
    """``df`` (with a column ``text``, not null) plus one double column per statistic."""
    counted = df.select(
        "*",
        F.length("text").cast("double").alias("n_chars"),
        F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "").alias("words"),
        F.split("text", "\n").alias("lines"),
        _count(r"[^#*$%&|<>]+").alias("n_symbols"),
        _count(r"[^!?]+").alias("n_marks"),
        _count(r"\P{Lu}+").alias("n_upper"),
        _count(r"[^0-9]+").alias("n_digits"),
    ).select(
        "*",
        F.size("words").cast("double").alias("n_words"),
        F.size(F.array_distinct("words")).cast("double").alias("n_distinct"),
        F.size("lines").cast("double").alias("n_lines"),
        F.size(F.array_distinct("lines")).cast("double").alias("n_distinct_lines"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    ready = {
        "words": F.col("n_words"),
        "word_length": share("n_chars", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        # Long texts repeat more words by chance; this share falls more slowly with length.
        "distinct_root": share("n_distinct", "root_words"),
        "distinct_lines": share("n_distinct_lines", "n_lines"),
        "words_a_line": share("n_words", "n_lines"),
        "symbols": share("n_symbols", "n_words"),
        "marks": share("n_marks", "n_words"),
        "upper": share("n_upper", "n_chars"),
        "digits": share("n_digits", "n_chars"),
    }
    return counted.withColumn("root_words", F.sqrt("n_words")).select(*df.columns, *(c.alias(f"s_{n}") for n, c in ready.items()))


STATS = ["words", "word_length", "distinct_share", "distinct_root", "distinct_lines", "words_a_line", "symbols", "marks", "upper", "digits"]


@dataclass
class RuleModel:
    """Intercept and weighted rules over the statistics."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """P(label 1) over the columns of :func:`statistics`."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def _holds(rule: Rule) -> Column:
    out = None
    for name, above, cut in rule:
        one = F.col(f"s_{name}") > cut if above else F.col(f"s_{name}") <= cut
        out = one if out is None else out & one
    return out


def tree_rules(model) -> list[Rule]:
    """Distinct conjunctions on the paths from each root to each inner node and leaf."""
    found: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            found[tuple(sorted(set(path)))] = None
        if node.subtreeDepth() > 0:
            split = node.split()
            name, cut = STATS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, False, cut)))
            walk(node.rightChild(), (*path, (name, True, cut)))

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found)


def fit_rules(
    documents: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    train: Column | None = None,
    sample_rows: int = 6000,
    trees: int = 12,
    depth: int = 3,
    lasso: float = 2e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows (hash order of the id)."""
    spark = documents.sparkSession
    sample = labelled_texts(documents, labels, label_col, train, sample_rows, id_col, text_col)
    rows = statistics(sample.select("key", "y", F.coalesce("text", F.lit("")).alias("text"))).select("key", "y", *(f"s_{s}" for s in STATS)).collect()
    rows = sorted(rows, key=lambda r: tuple(r))
    seen = {r.y for r in rows}
    if len(seen) < 2:
        p = min(max(float(next(iter(seen), 0.5)), 1e-6), 1 - 1e-6)
        return RuleModel(math.log(p / (1 - p)))
    # The bounded sample comes back as one small table, in an order that reruns repeat.
    table = spark.createDataFrame([(float(r.y), *map(float, r[2:])) for r in rows], ["y", *STATS]).coalesce(1)
    table = VectorAssembler(inputCols=STATS, outputCol="x").transform(table).select("y", "x").cache()
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=7)
    rules = tree_rules(forest.fit(table))
    table.unpersist()
    if not rules:
        p = sum(r.y for r in rows) / len(rows)
        return RuleModel(math.log(p / (1 - p)))
    place = {s: i + 2 for i, s in enumerate(STATS)}
    fires = lambda r: [float(all((r[place[n]] > cut) == above for n, above, cut in rule)) for rule in rules]
    fired = spark.createDataFrame([(float(r.y), Vectors.dense(fires(r))) for r in rows], ["y", "x"]).coalesce(1).cache()
    fit = LogisticRegression(labelCol="y", featuresCol="x", regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(fired)
    fired.unpersist()
    kept = [(rule, float(w)) for rule, w in zip(rules, fit.coefficients.toArray()) if abs(w) > 1e-6]
    return RuleModel(float(fit.intercept), kept)


def score(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, P(label 1), of every whole text."""
    texts = df.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return statistics(texts).select(F.col("key").alias(id_col), model.column().alias("score"))
