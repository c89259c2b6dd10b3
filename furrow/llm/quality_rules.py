"""Quality rules: a learned decision list over text statistics, all in native expressions.

Statistics are computed inside the row with higher-order functions. The list is learned by
sequential covering on a bounded sample of labelled rows: grow a conjunction of thresholds by
information gain on two thirds of the sample, prune it on the last third, keep it if it is
precise enough there, take away what it covers, and go on. What an imprecise rule covers takes no
further part in growing, so a signal behind a noisy one is still found. Each step is one small aggregation,
of which only counts a feature and threshold reach the driver. The list is then one ordered
CASE expression, and as such interpretable.

Null text has no words and fails the base rule; so do empty texts. Very long texts are judged whole,
in their row. Repeated rows and rows with equal or null ids are judged alone; labels of one id that
differ count as bad. Of equally good literals the first feature's and highest threshold wins. Without
labels of both kinds the list is empty and only the base rule holds; an empty table gives an empty
one. Columns that clash with those made here keep their values in ``keep_good``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK_JAVA, scratch, stored

#: Bound of the labelled sample: rows with the lowest hashes of their ids.
FIT_ROWS = 20_000
THRESHOLDS, MOST_RULES, MOST_LITERALS = 12, 12, 3
#: Bytes of sampled texts in a task.
SAMPLE_BYTES = 2_000_000
#: A rule must be this precise on the pruning sample and cover so many bad rows there.
PRECISION, COVER = 0.98, 5
SEPARATORS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Hashes of windows are sorted with their positions; equal neighbours mark both positions; the
    words they cover are summed from the gaps between marked positions."""

    def marked(s: Column) -> Column:
        same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1).h == x.h)) | (F.get(s, i + 1).h == x.h))
        return F.sort_array(F.transform(same, lambda x: x.i))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc.n + F.least(F.lit(3), p - acc.last)).alias("n"))
        return F.aggregate(at, zero, step, lambda acc: acc.n)

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    found = let(words, lambda w: F.when(F.size(w) > 3, covered(let(F.sort_array(windows(w)), marked))).otherwise(F.lit(0)))
    return found.cast("long")


def statistics(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """The column ``carry`` and the statistics of each whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    length = F.length(t)
    without = lambda some: length - F.length(F.translate(t, some, ""))
    words = F.filter(F.split(t, WORD_BREAK_JAVA), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    return docs.select(
        carry,
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        F.length(F.translate(t, SEPARATORS, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        without("!?").cast("long").alias("n_shouts"),
        without(UPPER).cast("long").alias("n_upper"),
    ).select(carry, "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", "n_shouts", "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What thresholds are set on: shares in percent, and lengths."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols_per_100_words": 100 * F.col("n_symbols") / words,
        "repeats_per_100_words": 100 * F.col("n_repeat_words") / words,
        "dup_lines_per_100_words": 100 * F.col("n_dup_lines") / words,
        "shouts_per_100_words": 100 * F.col("n_shouts") / words,
        "upper_per_100_chars": 100 * F.col("n_upper") / chars,
        "chars_per_word": F.col("word_chars") / words,
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def _all(rule: list[Literal], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column(values)
    return out


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(stats: DataFrame, labels: DataFrame) -> list[list[Literal]]:
    """Ordered conjunctions that mark bad rows. ``stats``: doc_id and features; ``labels``: doc_id, bad."""
    names = list(features())
    rows = stats.join(labels, "doc_id").select("bad", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("part"), *names)
    rows = stored(rows, "labelled")
    values = {f: F.col(f) for f in names}
    cuts = rows.agg(*(F.percentile(f, [(i + 1) / (THRESHOLDS + 1) for i in range(THRESHOLDS)]).alias(f) for f in names), *(F.max(F.when(F.col("bad") == 0, F.col(f))).alias(f"_hi_{f}") for f in names)).first()
    if cuts is None or cuts[names[0]] is None:
        return []
    limits = {f: sorted({*cuts[f], *([cuts[f"_hi_{f}"]] if cuts[f"_hi_{f}"] is not None else [])}) for f in names}
    grown, held, rules = F.col("part") < 2, F.col("part") == 2, []

    def counts(where: Column) -> dict[tuple[str, int], tuple[int, int]]:
        """Bad and good rows by feature and the thresholds that it exceeds."""
        bins = F.array(*(F.struct(F.lit(f).alias("f"), sum((F.col(f) > F.lit(c)).cast("int") for c in limits[f]).alias("bin")) for f in names))
        table = rows.where(where).select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        return {(r.f, r.bin): (r.p, r.n) for r in table.collect()}  # features times thresholds

    def widest(rule: list[Literal]) -> list[Literal]:
        """Lower bounds moved up, half way to the bad rows that the rule covers."""
        low = rows.where(_all(rule, values) & (F.col("bad") == 1)).agg(*(F.min(f).alias(f) for f in names)).first()
        return [Literal(x.feature, True, (x.threshold + low[x.feature]) / 2) if x.above else x for x in rule]

    left = fresh = F.lit(True)  # not covered by a rule; nor by one that was grown and turned down
    for _ in range(2 * MOST_RULES):
        if len(rules) == MOST_RULES:
            break
        rule: list[Literal] = []
        while len(rule) < MOST_LITERALS:
            found = counts(grown & left & fresh & _all(rule, values))
            p0 = sum(p for (f, _), (p, _n) in found.items() if f == names[0])
            n0 = sum(n for (f, _), (_p, n) in found.items() if f == names[0])
            if p0 < COVER or not n0:  # too few bad rows are left to grow from
                break
            best, literal = 0.0, None
            for f in names:
                p = n = 0
                for i in range(len(limits[f]) - 1, -1, -1):
                    more = found.get((f, i + 1), (0, 0))
                    p, n = p + more[0], n + more[1]
                    for above, (q, m) in ((True, (p, n)), (False, (p0 - p, n0 - n))):
                        if q + m < p0 + n0 and (g := _gain(p0, n0, q, m)) > best + 1e-9:
                            best, literal = g, Literal(f, above, limits[f][i])
            if literal is None:
                break
            rule.append(literal)
        if not rule:
            break
        tests = [F.sum(F.when(held & left & _all(rule[: k + 1], values), v)).alias(f"_{k}{s}") for k in range(len(rule)) for s, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
        got = rows.agg(*tests).first()
        score = [(got[f"_{k}p"] or 0, got[f"_{k}n"] or 0) for k in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in score]
        k = max(range(len(rule)), key=lambda k: (worth[k], -k))
        p, n = score[k]
        if p < COVER or p < PRECISION * (p + n):
            # another signal may lie behind this one: grow the next rule elsewhere
            fresh = fresh & ~_all(rule, values)
            continue
        rules.append(widest(rule[: k + 1]))
        left = left & ~_all(rules[-1], values)
    return rules


def sample(labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """The ``most`` labelled ids of lowest hash: doc_id, bad."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> list[list[Literal]]:
    with scratch(docs.sparkSession):
        chosen = stored(sample(labels), "sample")
        # written before any expression over texts, which Spark would otherwise move below the join
        rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), "sample-texts")  # FIT_ROWS ids at most
        # few rows of a large file each: dealt out anew by their bytes
        bytes_ = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        spread = rows.repartition(max(1, -(-bytes_ // SAMPLE_BYTES)))
        stats = statistics(spread).where(~base_failed()).select("doc_id", *(v.alias(f) for f, v in features().items()))
        return learn(stats, F.broadcast(chosen))


def verdict(rules: list[list[Literal]]) -> Column:
    """The ordered list as one expression: the first rule that fits rejects."""
    values, out = features(), F.when(base_failed(), False)
    for rule in rules:
        out = out.when(_all(rule, values), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    rules = fit(docs, labels)
    reason = F.when(base_failed(), "base")
    for rule in rules:
        reason = reason.when(_all(rule, features()), " and ".join(map(str, rule)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return statistics(docs).select(*columns, base_failed().alias("base_failed"), verdict(rules).alias("kept"), reason.alias("reason"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the list keeps, judged row by row."""
    rules = fit(docs, labels)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return statistics(whole, "_row").where(verdict(rules)).select("_row.*")
