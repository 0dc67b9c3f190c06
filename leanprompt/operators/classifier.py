"""The phrase classifier: tiered TF-IDF vocabulary, balanced multinomial logistic regression, inference and metrics by joins.

A model is two small tables: vocabulary(term, idx, idf) and coefficients(label, idx, w), the intercept with idx -1. They are
broadcast by the optimizer while small (MOST_TERMS bounds what fit() keeps) and joined by sort otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LEAST_KNOWN, KEEP, VETO, PROPOSE = 2, "IMPORTANT", 0.75, 0.90
LEAST_WEIGHT = 0.01
GRID = {"ngrams": (1, 2), "sublinear": (False, True), "bigram_df": (1, 2, 3), "C": (1.0, 2.0, 4.0, 8.0, 16.0)}
MOST_TERMS = 1 << 18


@dataclass(frozen=True)
class Settings:
    ngrams: int = 2
    sublinear: bool = True
    bigram_df: int = 2
    C: float = 8.0


@dataclass
class Model:
    vocabulary: DataFrame
    coefficients: DataFrame
    settings: Settings = field(default_factory=Settings)

    def save(self, path: str) -> None:
        """Weights too small to move a decision are dropped and figures rounded: idf to 6 places, weights to 5."""
        self.vocabulary.select("term", "idx", F.round("idf", 6).alias("idf")).write.mode("overwrite").parquet(f"{path}/vocabulary")
        small = (F.col("idx") >= 0) & (F.abs("w") < LEAST_WEIGHT)
        self.coefficients.where(~small).select("label", "idx", F.round("w", 5).alias("w")).write.mode("overwrite").parquet(f"{path}/coefficients")
        spark = self.vocabulary.sparkSession
        spark.createDataFrame([(self.settings.ngrams, self.settings.sublinear, self.settings.bigram_df, self.settings.C)], "ngrams int, sublinear boolean, bigram_df int, C double").write.mode("overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark, path: str) -> Model:
        s = spark.read.parquet(f"{path}/settings").first()
        return Model(spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/coefficients"), Settings(s["ngrams"], s["sublinear"], s["bigram_df"], s["C"]))


def tokens(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores, with apostrophes inside, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9_']*(?<=[A-Za-z0-9_])"), F.lit(0))


def features(text: Column, ngrams: int) -> Column:
    """Words, and runs of up to ngrams words joined by a space."""
    t = tokens(text)
    runs = [t]
    for n in range(2, ngrams + 1):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: i <= F.size(t) - n + 1)
        runs.append(F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")))
    return F.concat(*runs)


def counts(rows: DataFrame, ngrams: int) -> DataFrame:
    """(id, term, n) of rows(id, text)."""
    return rows.select("id", F.explode(features(F.col("text"), ngrams)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def fit_vocabulary(rows: DataFrame, settings: Settings) -> DataFrame:
    """(term, idx, idf): words of any document, longer runs of at least bigram_df of them; idf = ln((1 + N) / (1 + df)) + 1.
    idx follows the terms' order. Of more than MOST_TERMS terms the commonest stay."""
    n = rows.count()
    df = counts(rows, settings.ngrams).groupBy("term").agg(F.count("*").alias("df"))
    df = df.where(~F.col("term").contains(" ") | (F.col("df") >= settings.bigram_df)).orderBy(F.desc("df"), "term").limit(MOST_TERMS)
    return df.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(rows: DataFrame, vocabulary: DataFrame, settings: Settings) -> DataFrame:
    """(id, idx, value) of unit length for each id with at least LEAST_KNOWN known terms, repeats included."""
    known = counts(rows, settings.ngrams).join(vocabulary, "term")
    tf = 1 + F.log("n") if settings.sublinear else F.col("n").cast("double")
    raw = known.select("id", "idx", "n", (tf * F.col("idf")).alias("v"))
    sizes = raw.groupBy("id").agg(F.sum("n").alias("known"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).where((F.col("known") >= LEAST_KNOWN) & (F.col("norm") > 0))
    return raw.join(sizes, "id").select("id", "idx", (F.col("v") / F.col("norm")).alias("value"))


def classify(rows: DataFrame, model: Model) -> DataFrame:
    """(id, label, confidence, keep, removable, veto, propose) of rows(id, text); rows that abstain are left out.

    Scores are a softmax of W x + b, shifted by its maximum; the first label of the greatest wins.
    """
    x = vectors(rows, model.vocabulary, model.settings)
    weights, bias = model.coefficients.where("idx >= 0"), model.coefficients.where("idx < 0").select("label", F.col("w").alias("b"))
    sums = x.join(weights, "idx").groupBy("id", "label").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    every = x.select("id").distinct().join(F.broadcast(bias))  # as many rows as labels: four
    z = every.join(sums, ["id", "label"], "left").select("id", "label", (F.col("b") + F.coalesce("s", F.lit(0.0))).alias("z"))
    per = z.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", "z"))).alias("all"), F.max("z").alias("top"))
    mass = F.aggregate("all", F.lit(0.0), lambda s, e: s + F.exp(e["z"] - F.col("top")))
    scores = F.transform("all", lambda e: F.struct(e["label"].alias("label"), (F.exp(e["z"] - F.col("top")) / F.col("mass")).alias("p")))
    out = per.withColumn("mass", mass).withColumn("scores", scores)
    best = F.array_max(F.transform("scores", lambda e: e["p"]))
    out = out.withColumn("confidence", best).withColumn("label", F.element_at(F.filter("scores", lambda e: e["p"] == F.col("confidence")), 1)["label"])
    keep = F.coalesce(F.element_at(F.filter("scores", lambda e: e["label"] == KEEP), 1)["p"], F.lit(0.0))
    return out.withColumn("keep", keep).select("id", "label", "confidence", "keep", (1 - F.col("keep")).alias("removable"), (F.col("keep") >= VETO).alias("veto"), (1 - F.col("keep") >= PROPOSE).alias("propose"), "scores")


def train(rows: DataFrame, settings: Settings | None = None) -> Model:
    """A model of rows(id, text, label). Classes are balanced by weights; regularised by 1 / (C N), not standardised."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    settings = settings or Settings()
    vocabulary = fit_vocabulary(rows, settings).persist()
    size = vocabulary.count()
    sparse = F.udf(lambda pairs: Vectors.sparse(size, sorted((int(p["idx"]), float(p["value"])) for p in pairs)), VectorUDT())
    x = vectors(rows, vocabulary, settings).groupBy("id").agg(sparse(F.collect_list(F.struct("idx", "value"))).alias("features")).join(rows.select("id", "label"), "id")
    known = {r["label"]: r["count"] for r in x.groupBy("label").count().collect()}
    labels = sorted(known)
    n = sum(known.values())
    code, weight = F.lit(0.0), F.lit(1.0)
    for k, name in enumerate(labels):
        code = F.when(F.col("label") == name, float(k)).otherwise(code)
        weight = F.when(F.col("label") == name, n / (len(labels) * known[name])).otherwise(weight)
    lr = LogisticRegression(regParam=1.0 / (settings.C * max(1, n)), standardization=False, weightCol="weight", family="multinomial", maxIter=300)
    fitted = lr.fit(x.withColumn("label", code).withColumn("weight", weight))
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    flat = [(name, -1, float(b[k])) for k, name in enumerate(labels)] + [(name, j, float(v)) for k, name in enumerate(labels) for j, v in enumerate(w[k]) if v]
    return Model(vocabulary, rows.sparkSession.createDataFrame(flat, "label string, idx int, w double"), settings)


def folds(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """rows with a fold from 0 to k - 1, in equal parts of each label by an order by hash."""
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id")) - 1
    return rows.withColumn("fold", F.pmod(place, F.lit(k)))


def confusion(pairs: DataFrame) -> DataFrame:
    """(label, predicted, n) of pairs(label, predicted)."""
    return pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def metrics(pairs: DataFrame) -> DataFrame:
    """Of pairs(label, predicted): (name, precision, recall, f1, n) by label, and their macro and weighted means; accuracy
    and the accuracy of keeping or dropping alone in rows of those names, as f1 is null there."""
    c = confusion(pairs).persist()
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = c.groupBy("label").agg(F.sum("n").alias("n"), F.sum(hit).alias("hits"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = actual.join(said, "label", "full").select(F.col("label").alias("name"), ratio(F.coalesce("hits", F.lit(0)), F.coalesce("said", F.lit(0))).alias("precision"), ratio(F.coalesce("hits", F.lit(0)), F.coalesce("n", F.lit(0))).alias("recall"), F.coalesce("n", F.lit(0)).alias("n"))
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("name", "precision", "recall", "f1", "n")
    total = F.sum("n").alias("n")
    macro = each.agg(F.avg("precision"), F.avg("recall"), F.avg("f1"), total).toDF("precision", "recall", "f1", "n").select(F.lit("macro").alias("name"), "*")
    weighted = each.agg(*[F.sum(F.col(x) * F.col("n")) / F.sum("n") for x in ("precision", "recall", "f1")], total).toDF("precision", "recall", "f1", "n").select(F.lit("weighted").alias("name"), "*")
    keep = (F.col("label") == KEEP) == (F.col("predicted") == KEEP)
    none = F.lit(None).cast("double")
    acc = lambda name, fits: c.agg((F.sum(F.when(fits, F.col("n")).otherwise(0)) / F.sum("n")).alias("r"), total).select(F.lit(name).alias("name"), none.alias("precision"), F.col("r").alias("recall"), none.alias("f1"), "n")
    return each.unionByName(macro).unionByName(weighted).unionByName(acc("accuracy", F.col("label") == F.col("predicted"))).unionByName(acc("keep-drop", keep))


def keep_drop_accuracy(test: DataFrame, model: Model) -> float:
    """The share of test(id, text, label) rightly kept or dropped; rows that abstain are kept."""
    got = test.join(classify(test, model).select("id", F.col("label").alias("predicted")), "id", "left")
    fits = (F.col("label") == KEEP) == (F.coalesce("predicted", F.lit(KEEP)) == KEEP)
    return got.agg(F.avg(fits.cast("double"))).first()[0] or 0.0


def search(rows: DataFrame, k: int = 5, grid: dict | None = None) -> list[tuple[Settings, float, float]]:
    """(settings, mean, deviation) of the grid by k-fold accuracy of keeping or dropping, best first: the higher mean to three
    places, then the smaller deviation, the higher bigram floor, the smaller C. The vocabulary is fitted within each fold."""
    grid, out = grid or GRID, []
    parts = folds(rows, k).persist()
    for values in product(*grid.values()):
        s = Settings(**dict(zip(grid, values)))
        each = [keep_drop_accuracy(parts.where(F.col("fold") == f), train(parts.where(F.col("fold") != f), s)) for f in range(k)]
        mean = sum(each) / k
        out.append((s, mean, (sum((x - mean) ** 2 for x in each) / k) ** 0.5))
    return sorted(out, key=lambda r: (-round(r[1], 3), r[2], -r[0].bigram_df, r[0].C))


def compare(rows: DataFrame, extra: DataFrame, splits: int = 25, settings: Settings | None = None) -> tuple[float, float, bool]:
    """Mean and deviation, over splits, of what training on `extra` too adds to held-out accuracy of keeping or dropping,
    and whether to promote it: if the mean is above zero by more than its deviation."""
    deltas = []
    for seed in range(splits):
        parts = folds(rows, 4, seed)
        held, base = parts.where("fold = 0"), parts.where("fold > 0").select("id", "text", "label")
        more = base.unionByName(extra.select((-F.col("id") - 1).alias("id"), "text", "label"))
        deltas.append(keep_drop_accuracy(held, train(more, settings)) - keep_drop_accuracy(held, train(base, settings)))
    mean = sum(deltas) / len(deltas)
    spread = (sum((d - mean) ** 2 for d in deltas) / len(deltas)) ** 0.5
    return mean, spread, mean > spread
