"""Quality rules: fixed limits, then robust multivariate outliers by minimum covariance determinant.

Everything is DataFrame expressions. A text's statistics come from its own row. Four of them are
transformed so that ordinary texts have a spread of their own: word length, the odds of a character not
being a letter, the odds of a word being a new one, and the number of words, all as logs. They are taken
from the median of their language and source, in its median deviations, and a short text, which says less
about its rates, counts less.

The estimate of a group is the mean and covariance of the `CORE` share of its texts whose covariance has
the least determinant. Three starts (no correlation, the covariance of the coordinates drawn in by tanh,
that of their directions) are each improved by steps that keep the closest texts and estimate anew, which
never raises the determinant, and the one with the least is taken. Its distances are brought to the
median of chi-square, texts within the 97.5 % quantile estimate once more, and a text is rejected if its
squared Mahalanobis distance from that estimate exceeds the chi-square quantile of `CUTOFF`. A coordinate
without spread in a group is left out of the group's distance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import erfc, exp, pi, sqrt
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralog.sources.scratch import broadcast_if_small, stage

SYMBOLS = "[#*$%&|<>]"
FEW_WORDS = 50
REPEAT_PERCENT = 50

CORE = 0.75
STEPS = 4
STARTS = 3
# Chance that a normal text is rejected. Statistics of real texts have longer tails than normal ones.
CUTOFF = 1e-12
# Smaller groups of a language are put together, and small languages too.
LEAST_GROUP = 50
# Words at which a text's own rates count as much as its group's.
FULL_SAY = 400.0
# Distances are counted in bins of this relative width to find the closest texts of a group.
BIN = 0.01
# Variance under which a coordinate has no spread, and what keeps a matrix from being singular: rounding only.
EPSILON = 1e-9

Z = ("z0", "z1", "z2", "z3")
T = ("t0", "t1", "t2", "t3")
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def chi_square(chance: float, degrees: int) -> float:
    """The value that chi-square with 1 to 4 degrees exceeds with this chance."""

    def above(x: float) -> float:
        if degrees % 2:
            return erfc(sqrt(x / 2)) + (sqrt(2 * x / pi) * exp(-x / 2) if degrees == 3 else 0.0)
        return exp(-x / 2) * (1 + x / 2 if degrees == 4 else 1.0)

    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = ((low + high) / 2, high) if above((low + high) / 2) > chance else (low, (low + high) / 2)
    return high


def by_dims(chance: float) -> Column:
    """The chi-square quantile for the number of live coordinates in column `dims`; a distance without any is 0."""
    return F.coalesce(*[F.when(F.col("dims") == k, F.lit(chi_square(chance, k))) for k in range(1, 5)], F.lit(1.0))


def statistics(text: Column) -> dict[str, Column]:
    """Steps of the base statistics as named expressions, each on top of those before it."""
    blanks = " \t\n\u000b\f\r"
    words = F.split(F.btrim(text, F.lit(blanks)), "[\\x20\\x09-\\x0D]+")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "words": F.when(F.length(F.btrim(text, F.lit(blanks))) == 0, F.array().cast("array<string>")).otherwise(words),
        "lines": lines,
    }


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(triples: Column) -> Column:
    """Words in three-word windows that occur more than once, from the windows' hashes in order.

    The windows are sorted by hash; those with an equal neighbour are repeated. Going through their
    places in order, each one covers three words less those the one before it covers.
    """

    def places(placed: Column) -> Column:
        same = lambda k, x: F.get(placed, k)["h"] == x["h"]  # noqa: E731  NULL beyond the ends
        return F.transform(F.filter(placed, lambda x, k: F.coalesce(same(k - 1, x), F.lit(False)) | F.coalesce(same(k + 1, x), F.lit(False))), lambda x: x["i"])

    found = let(F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)
    return F.aggregate(
        F.sort_array(found), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"])


def base_table(docs: DataFrame) -> DataFrame:
    """`doc_id, lang, source`, the base statistics of every row, and its letters and distinct words. A NULL text has no word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumns(statistics(F.col("text")))
    n = F.size("words")
    triple = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    rows = rows.withColumn("triples", triple)
    return rows.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # Most texts repeat no window; a set of the hashes tells so before anything is sorted.
        F.when(F.size(F.array_distinct("triples")) == F.size("triples"), F.lit(0).cast("long")).otherwise(
            repeated_words(F.col("triples"))).alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


def transformed(base: DataFrame) -> DataFrame:
    """Four coordinates of each text, and `say`, how much its length lets them count."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    other, letters, new = F.col("word_chars") - F.col("n_letters"), F.col("n_letters"), F.col("n_distinct")
    return base.withColumns({
        "z0": F.log((F.col("word_chars") + 1) / n),
        "z1": F.log((other + 1) / (letters + 1)),
        "z2": F.log((new + 1) / (n - new + 1)),
        "z3": F.log(n),
        "say": F.sqrt(n / (n + FULL_SAY)),
    })


def _inverse(c: dict[tuple[int, int], Column]) -> tuple[dict[tuple[int, int], Column], Column]:
    """Inverse and determinant of a symmetric positive 4x4 matrix of columns, by eliminating one coordinate after another."""
    a = {(i, j): c[min(i, j), max(i, j)] for i in range(4) for j in range(4)}
    determinant = F.lit(1.0)
    for k in range(4):
        pivot = a[k, k]
        determinant = determinant * pivot
        b = {}
        for i in range(4):
            for j in range(4):
                if i == k and j == k:
                    b[i, j] = -1 / pivot
                elif i == k or j == k:
                    b[i, j] = a[i, j] / pivot
                else:
                    b[i, j] = a[i, j] - a[i, k] * a[k, j] / pivot
        a = b
    return {(i, j): -a[i, j] for i, j in PAIRS}, determinant


def estimates(rows: DataFrame, key: str) -> DataFrame:
    """`m*`, `p*`, `det`, `dims` by `key`: mean, inverse covariance and its determinant, and how many coordinates have a spread.

    Sums come first, so tasks combine before the shuffle. A coordinate without spread takes no part.
    """
    sums = rows.groupBy(key).agg(
        F.count("*").alias("n"), *[F.sum(t).alias(f"s_{t}") for t in T],
        *[F.sum(F.col(T[i]) * F.col(T[j])).alias(f"q{i}{j}") for i, j in PAIRS])
    means = sums.select(key, *[(F.col(f"s_{t}") / F.col("n")).alias(f"m{i}") for i, t in enumerate(T)],
                        *[(F.col(f"q{i}{j}") / F.col("n")).alias(f"q{i}{j}") for i, j in PAIRS])
    spread = means.select(key, *[f"m{i}" for i in range(4)], *[(F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"v{i}{j}") for i, j in PAIRS])
    live = [F.col(f"v{i}{i}") > EPSILON for i in range(4)]
    kept = {(i, j): F.when(live[i] & live[j], F.col(f"v{i}{j}") * (1 + EPSILON if i == j else 1)).otherwise(1.0 if i == j else 0.0) for i, j in PAIRS}
    covariances = stage(spread.select(key, *[f"m{i}" for i in range(4)], *[v.alias(f"c{i}{j}") for (i, j), v in kept.items()],
                                      *[x.cast("int").alias(f"live{i}") for i, x in enumerate(live)]), "covariances")
    inverse, determinant = _inverse({(i, j): F.col(f"c{i}{j}") for i, j in PAIRS})
    return stage(covariances.select(
        key, *[f"m{i}" for i in range(4)], *[(v * F.col(f"live{i}") * F.col(f"live{j}")).alias(f"p{i}{j}") for (i, j), v in inverse.items()],
        determinant.alias("det"), reduce(add, [F.col(f"live{i}") for i in range(4)]).alias("dims")), "estimates")


def deviations(passed: DataFrame) -> DataFrame:
    """Median `c*` of each group's coordinates, and the median deviation `d*` from it, by how much the texts say."""
    medians = stage(passed.groupBy("group").agg(*[F.percentile_approx(z, 0.5, 1000).alias(f"c{i}") for i, z in enumerate(Z)]), "medians")
    off = [((F.col(z) - F.col(f"c{i}")) * F.col("say")).alias(T[i]) for i, z in enumerate(Z)]
    near = passed.join(broadcast_if_small(medians), "group").select("group", *off)
    spread = near.groupBy("group").agg(*[F.percentile_approx(F.abs(t), 0.5, 1000).alias(f"d{i}") for i, t in enumerate(T)])
    return stage(medians.join(spread, "group"), "deviations")


def in_deviations(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """`t*`: coordinates from their group's median, by how much the text says, in median deviations of that."""
    return rows.join(broadcast_if_small(scales), "group", "left").select(
        *rows.columns, *[((F.col(z) - F.col(f"c{i}")) * F.col("say") / F.when(F.col(f"d{i}") > 0, F.col(f"d{i}") * 1.4826).otherwise(1.0)).alias(T[i]) for i, z in enumerate(Z)])


def starts(members: DataFrame) -> DataFrame:
    """First estimates around the median by `key`, the group and the number of the start."""
    length = F.sqrt(reduce(add, [F.col(t) * F.col(t) for t in T]))
    drawn = members.select("group", F.explode(F.array(*[
        F.struct(F.lit(k).alias("start"), *[c.alias(f"u{i}") for i, c in enumerate(columns)]) for k, columns in (
            (1, [F.tanh(t) for t in T]), (2, [F.when(length > 0, F.col(t) / length).otherwise(0.0) for t in T]))])).alias("s"))
    shaped = estimates(drawn.select(F.concat_ws("#", "group", "s.start").alias("key"), *[F.col(f"s.u{i}").alias(t) for i, t in enumerate(T)]), "key")
    plain = members.select("group").distinct().select(
        F.concat_ws("#", "group", F.lit(0)).alias("key"), *[F.lit(1.0 if i == j else 0.0).alias(f"p{i}{j}") for i, j in PAIRS])
    return stage(shaped.select("key", *[f"p{i}{j}" for i, j in PAIRS]).unionByName(plain).withColumns({f"m{i}": F.lit(0.0) for i in range(4)}), "estimates")


def with_distance(rows: DataFrame, estimate: DataFrame, key: str) -> DataFrame:
    """Rows with `d2`, their squared Mahalanobis distance from their group's estimate, and with the estimate's `dims`."""
    off = [F.col(t) - F.col(f"m{i}") for i, t in enumerate(T)]
    d2 = reduce(add, [F.col(f"p{i}{j}") * off[i] * off[j] * (1 if i == j else 2) for i, j in PAIRS])
    more = ["dims"] if "dims" in estimate.columns else []
    return rows.join(broadcast_if_small(estimate), key, "left").withColumn("d2", F.greatest(d2, F.lit(0.0))).select(*rows.columns, "d2", *more)


def brought_to_chi_square(members: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate with `p*` such that the median distance of the group's texts is that of chi-square."""
    median = with_distance(members, estimate, "group").groupBy("group").agg(F.percentile_approx("d2", 0.5, 1000).alias("middle"))
    factor = F.when(F.col("middle") > 0, by_dims(0.5) / F.col("middle")).otherwise(1.0)
    return stage(estimate.join(broadcast_if_small(stage(median, "middles")), "group").select(
        "group", "dims", *[f"m{i}" for i in range(4)], *[(F.col(f"p{i}{j}") * factor).alias(f"p{i}{j}") for i, j in PAIRS]), "estimates")


def closest(rows: DataFrame, key: str) -> DataFrame:
    """The `CORE` share of each group with the smallest `d2`, to the width of a bin."""
    binned = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-3) / BIN).cast("long"))
    counted = binned.groupBy(key, "bin").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy(key).orderBy("bin")
    total = Window.partitionBy(key)
    edges = counted.select(key, "bin", F.sum("n").over(up_to).alias("up_to"), F.sum("n").over(total).alias("total")).where(
        F.col("up_to") >= F.ceil(F.col("total") * CORE)).groupBy(key).agg(F.min("bin").alias("edge"))
    return binned.join(broadcast_if_small(stage(edges, "edges")), key).where("bin <= edge").drop("bin", "edge", "d2")


def robust_estimates(members: DataFrame) -> DataFrame:
    """`group`, `m*`, `p*`, `dims`: the estimate of each group of `members` (`group`, `t*`)."""
    tried = members.select(F.explode(F.array(*[F.concat_ws("#", "group", F.lit(k)) for k in range(STARTS)])).alias("key"), *T)
    estimate = starts(members)
    for _ in range(STEPS):
        estimate = estimates(closest(with_distance(tried, estimate, "key").drop("dims"), "key"), "key")
    # More live coordinates first: a matrix without one has no smaller determinant for it.
    least = estimate.withColumn("group", F.regexp_replace("key", "#[0-9]+$", "")).groupBy("group").agg(
        F.min(F.struct((-F.col("dims")).alias("back"), "det", "key")).alias("best")).select("group", F.col("best.key").alias("key"))
    raw = brought_to_chi_square(members, stage(estimate.join(least, "key").drop("key", "det"), "least-determinants"))
    within = with_distance(members, raw, "group").where(F.col("d2") <= by_dims(0.025)).drop("d2", "dims")
    return brought_to_chi_square(members, estimates(within, "group"))


def judge(docs: DataFrame) -> DataFrame:
    """`doc_id`, the base statistics, `base_failed`, `kept` for every row.

    A text fails the base rules with fewer than 50 words, so NULL and empty ones do, or with over half
    of its words in repeated windows. `kept` also needs a distance within the cutoff in the text's
    group, the pair of language and source; NULL is a group of its own. The small groups of a language
    are judged as one, and small languages together; if even those are few, rows are kept if they pass
    the base rules. Repeated rows are judged alike and count as often as they occur in the estimates. An
    empty table gives no rows.
    """
    base = base_table(docs).withColumn(
        "base_failed", (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    base = stage(base, "quality-statistics")
    rows = transformed(base).withColumn("group", F.to_json(F.array("lang", "source")))  # keeps NULL apart from any text
    for wider in (F.to_json(F.array("lang")), F.lit("[]")):
        sizes = rows.where("not base_failed").groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_GROUP).select("group", F.lit(True).alias("large"))
        rows = rows.join(broadcast_if_small(stage(sizes, "large-groups")), "group", "left").withColumn(
            "group", F.when(F.col("large"), F.col("group")).otherwise(wider)).drop("large")
    passed = rows.where("not base_failed").select("group", *Z, "say")
    large = passed.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_GROUP).select("group")
    passed = stage(passed.join(broadcast_if_small(stage(large, "large-groups")), "group"), "quality-coordinates")
    scales = deviations(passed)
    members = stage(in_deviations(passed, scales).select("group", *T), "quality-members")
    judged = with_distance(in_deviations(rows, scales), robust_estimates(members), "group")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= by_dims(CUTOFF), F.lit(True))).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept. Rows that share an id stay if one of them is kept; without an id, all stay."""
    rejected = judge(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(broadcast_if_small(stage(rejected, "rejected")), "doc_id", "left_anti")
