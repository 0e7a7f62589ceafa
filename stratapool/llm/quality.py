"""Quality rules: learned decision lists, DataFrame functions only on the main path.

``statistics`` computes a document's counts inside Spark's own expressions; nothing is exploded or
shuffled. ``learn`` fits an ordered list of threshold conjunctions by sequential covering: a rule is
grown from each feature on two thirds of the labelled statistics by information gain, pruned on the rest, kept if it
is precise enough, and what it covers is taken out before the next one. ``DecisionList.verdict`` is
the list as one ordered CASE expression.

The list is fitted on at most ``sample`` labelled ids, those of the smallest hash, one text each (the
smallest); only their statistics come to the driver. Without labels the list is empty and keeps
everything. Null and empty texts have no words, and all counts 0. Repeated rows stay; an empty table
gives an empty one. Windows of three words are sorted by a 64-bit hash and their place, and windows of
equal hash count as equal only if their words are, whatever the text's length. A text's arrays are held
by one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]+"
SAMPLE = 4000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's columns, less those that clash, and STATS, all long."""
    keep = [c for c in df.columns if c not in STATS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    base = df.select(*[F.col(c) for c in keep], text.alias("_t"), F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK)).otherwise(F.array().cast("array<string>")).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    base = base.select(*keep, "_t", "_w", lines.alias("_l"), F.size("_w").cast("long").alias("n_words"))
    hashed = F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")),
        lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
    )
    base = base.withColumn("_h", F.sort_array(hashed))

    def same(x: Column, other: Column) -> Column:
        words = F.lit(True)
        for k in range(3):
            words = words & (F.get("_w", x["i"] + k) == F.get("_w", other["i"] + k))
        return F.coalesce((x["h"] == other["h"]) & words, F.lit(False))

    found = F.sort_array(F.transform(F.filter("_h", lambda x, i: same(x, F.get("_h", i - 1)) | same(x, F.get("_h", i + 1))), lambda x: x["i"].cast("long")))
    zero = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(found, zero, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["at"])).alias("n")), lambda a: a["n"])
    return base.select(
        *keep,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: Features of the rules: (numerator, denominator); a denominator of 0 counts as 1.
FEATURES = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") if b is None else F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


def features_of(row) -> dict[str, float]:
    return {n: float(row[a]) if b is None else row[a] / max(row[b], 1) for n, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def holds(self, x: dict[str, float]) -> bool:
        return x[self.name] >= self.limit if self.above else x[self.name] < self.limit

    def column(self) -> Column:
        return feature(self.name) >= self.limit if self.above else feature(self.name) < self.limit


@dataclass
class DecisionList:
    """Rules in order, each a conjunction; a row that no rule covers is kept."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def keeps(self, x: dict[str, float]) -> bool:
        return not any(all(t.holds(x) for t in r) for r in self.rules)

    def verdict(self) -> Column:
        out = None
        for r in self.rules:
            c = r[0].column()
            for t in r[1:]:
                c = c & t.column()
            out = F.when(c, F.lit(False)) if out is None else out.when(c, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{t.name} {'>=' if t.above else '<'} {t.limit:.4g}" for t in r) for r in self.rules) or "keep all"


def _best_test(bad: list[dict], good: list[dict], names: list[str]) -> tuple[float, Test | None]:
    """The test of the largest gain: covered bad rows times the rise of the log of precision."""
    p, n = len(bad), len(good)
    before, best = math.log2(p / (p + n)), (0.0, None)
    for name in names:
        rows = sorted([(x[name], 1) for x in bad] + [(x[name], 0) for x in good])
        seen_p = seen_n = 0
        for k, (v, is_bad) in enumerate(rows):
            if k and v > rows[k - 1][0] and seen_p + seen_n:
                limit = (v + rows[k - 1][0]) / 2
                for a, b, above in ((seen_p, seen_n, False), (p - seen_p, n - seen_n, True)):
                    if a and (gain := a * (math.log2(a / (a + b)) - before)) > best[0] + 1e-9:
                        best = (gain, Test(name, above, limit))
            seen_p, seen_n = seen_p + is_bad, seen_n + 1 - is_bad
    return best


def learn(rows: list[tuple[dict[str, float], bool]], precision: float = 0.97, least: int = 5, max_rules: int = 24, max_tests: int = 4) -> DecisionList:
    """rows: (features, is good), in a fixed order. Every third row is for pruning."""
    left, out, names = list(rows), DecisionList(), list(FEATURES)
    while len(out.rules) < max_rules:
        grow = [r for i, r in enumerate(left) if i % 3]
        prune = left[::3]
        bad, good, grown = [x for x, ok in grow if not ok], [x for x, ok in grow if ok], []
        if not bad or not good:
            break
        for first in names:  # one rule grown from each feature; the first test is on that feature
            rule, p, n = [], bad, good
            while p and n and len(rule) < max_tests:
                _, t = _best_test(p, n, names if rule else [first])
                if t is None:
                    break
                rule = [*rule, t]
                p, n = [x for x in p if t.holds(x)], [x for x in n if t.holds(x)]
                grown.append(rule)
        if not grown:
            break

        def score(r: list[Test]) -> tuple[bool, float, int, int]:
            """If it is precise enough on all rows; its worth on the rows for pruning; what it covers; the shorter the better."""
            every, hit = ([ok for x, ok in rs if all(t.holds(x) for t in r)] for rs in (left, prune))
            fine = every.count(False) >= max(least, precision * len(every))
            return fine, (hit.count(False) - hit.count(True)) / len(hit) if hit else -1.0, every.count(False), -len(r)

        rule = max(grown, key=score)
        if not score(rule)[0]:
            break
        out.rules.append(tuple(rule))
        left = [(x, ok) for x, ok in left if not all(t.holds(x) for t in rule)]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, **options) -> DecisionList:
    prepare(docs.sparkSession)
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_good"))
    some = own.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    one = rows.groupBy("_id", "_good").agg(F.min("_text").alias("_text"))
    got = statistics(one, "_text").select("_id", "_good", *STATS).collect()  # at most ``sample`` rows of counts
    got.sort(key=lambda r: str(r["_id"]))
    return learn([(features_of(r), bool(r["_good"])) for r in got], **options)


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS, base_failed, kept) for each row."""
    s = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").drop("_text")
    return s.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict())
