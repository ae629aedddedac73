"""Quality rules as a learned decision list.

Sequential covering over labelled documents: a rule grows one threshold condition at a time by information gain on two
thirds of the labelled rows, is pruned on the other third, and is kept if it is precise enough on all rows that are left;
the rows that it covers are set aside, and the next rule is grown from the rest. The rules are a Spark conditional expression in their
order, over statistics that are Spark expressions as well, so applying them needs neither Python nor a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import col, fresh, read

#: Labelled rows that the rules are learned from, at most: those of smallest hash of the identifier.
MOST_LABELLED = 6000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a number that is never NULL; NULL counts as the empty text, whose shares are 0."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    per = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, r"\n"), lambda w: F.trim(w) != "")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    return {
        "n_words": n_words,
        "word_length": per(chars, n_words),
        "symbol_share": per(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:'\"()-]")).cast("double"), chars),
        "upper_share": per(F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double"), chars),
        "digit_share": per(F.regexp_count(t, F.lit(r"\p{Nd}")).cast("double"), chars),
        "distinct_word_share": per(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_line_share": per(F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "words_per_line": per(n_words, n_lines),
    }


@dataclass(frozen=True)
class Rule:
    """Holds where each (statistic, is over, threshold) does: value > threshold, else value <= threshold."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, over, at in self.conditions:
            out = out & (stats[name] > F.lit(at) if over else stats[name] <= F.lit(at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if o else '<='} {t:.6g}" for n, o, t in self.conditions)


def _held(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, over, at in conditions:
        out &= x[:, j] > at if over else x[:, j] <= at
    return out


def _grow(x: np.ndarray, bad: np.ndarray, thresholds: list[np.ndarray], most: int) -> list[tuple[int, bool, float]]:
    rule: list[tuple[int, bool, float]] = []
    in_rule = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int(bad[in_rule].sum()), int((~bad[in_rule]).sum())
        if n == 0 or p == 0:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for j, cuts in enumerate(thresholds):
            v, b = x[in_rule, j], bad[in_rule]
            pos, neg = np.sort(v[b]), np.sort(v[~b])
            for over in (False, True):
                cp, cn = np.searchsorted(pos, cuts, "right"), np.searchsorted(neg, cuts, "right")
                if over:
                    cp, cn = len(pos) - cp, len(neg) - cn
                gain = np.where(cp > 0, cp * (np.log2(np.maximum(cp, 1e-9) / np.maximum(cp + cn, 1e-9)) - base), -1.0)
                i = int(np.argmax(gain)) if len(gain) else -1
                if i >= 0 and gain[i] > best[0]:
                    best = (float(gain[i]), (j, over, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        in_rule = _held(x, rule)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], min_precision: float = 0.9, min_covered: int = 5, most_rules: int | None = None, most_conditions: int = 5, cuts: int = 200) -> list[Rule]:
    """The decision list for rows x of statistics, bad where a row's label is low. Rows 2, 5, 8 ... prune the rules. Of
    conditions of equal gain the first counts, by the order of statistics, then "at most" before "over", then thresholds.

    Learning ends with the first rule that is less precise than min_precision or covers fewer bad rows than min_covered;
    most_rules ends it sooner, if it is given. A rule has at most most_conditions conditions, which keeps it readable: more
    would only split off rows that a further rule may cover. Where a statistic has more values than cuts, its thresholds are
    so many quantiles."""
    test = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while most_rules is None or len(rules) < most_rules:
        grow, prune = left & ~test, left & test
        if bad[grow].sum() < min_covered:
            break
        thresholds = []
        for j in range(x.shape[1]):
            v = np.unique(x[grow, j])
            v = v if len(v) <= cuts else np.unique(np.quantile(v, np.linspace(0, 1, cuts)))
            thresholds.append((v[:-1] + v[1:]) / 2)
        rule = _grow(x[grow], bad[grow], thresholds, most_conditions)
        best, worth = None, -2.0
        for k in range(len(rule), 0, -1):  # drops final conditions as long as that doesn't lose on the pruning rows
            c = _held(x[prune], rule[:k])
            p, n = int(bad[prune][c].sum()), int((~bad[prune][c]).sum())
            if p + n and (p - n) / (p + n) >= worth:
                best, worth = rule[:k], (p - n) / (p + n)
        if best is None:
            break
        c = _held(x[left], best)
        precision = float(bad[left][c].mean()) if c.any() else 0.0
        if precision < min_precision or bad[left][c].sum() < min_covered:
            break
        rules.append(Rule(tuple((names[j], over, at) for j, over, at in best), precision))
        left &= ~_held(x, best)
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The statistics of at most so many labelled documents, and whether each is of low quality (label 0)."""
    chosen = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).select(col(id_col).alias("id"), col(label_col).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(most)
    stats = statistics(F.col("text"))
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    pdf = rows.select("id", "label", *(c.alias(n) for n, c in stats.items())).toPandas().sort_values(["id", "label", *stats], kind="stable")
    return pdf[list(stats)].to_numpy(float), pdf["label"].to_numpy() == 0, list(stats)


def learn_rules(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> list[Rule]:
    """The decision list; empty if there are too few labelled documents of either kind, or none. Labels that are NULL, or
    whose identifier is, don't count; NULL and empty texts have all statistics 0. A label counts for each row with its
    identifier, of which there are as many as an identifier is repeated."""
    x, bad, names = labelled_statistics(docs, labels, most_labelled, id_col, text_col, label_col)
    return learn(x, bad, names, **how)


def decisions(docs: DataFrame, rules: list[Rule], text_col: str, name: str) -> DataFrame:
    """docs with the number, from 1, of the first rule that a document meets; 0 if it meets none."""
    stats = statistics(col(text_col))
    used = sorted({n for r in rules for n, _, _ in r.conditions})
    cols = dict(zip(used, fresh([*docs.columns, name], *used)))
    rows = docs.select("*", *(stats[n].alias(cols[n]) for n in used))
    out = F.lit(0)
    for i in range(len(rules) - 1, -1, -1):
        out = F.when(rules[i].column({n: F.col(c) for n, c in cols.items()}), F.lit(i + 1)).otherwise(out)
    return rows.select(*(col(c) for c in docs.columns), out.cast("int").alias(name))


def classify(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, keep) for each row; rule as in decisions(), keep where it is 0.

    NULL and empty texts have all statistics 0 and are judged like any other. Repeated rows each appear. Without rules
    all rows are kept."""
    return decisions(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), rules, "text", "rule").selectExpr("doc_id", "rule", "rule = 0 AS keep")


def quality_filter(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, columns as they were, whatever their names. NULL and empty texts are judged by
    statistics that are all 0; repeated rows share their fate; no rows give no rows."""
    (name,) = fresh(docs.columns, "rule_")
    kept = decisions(docs, rules, text_col, name).where(F.col(name) == 0)
    return kept.select(*(col(c) for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify() of all documents, by rules learned from labels."""
    docs = read(spark, sf_dir, "documents")
    return classify(docs, learn_rules(docs, read(spark, sf_dir, "labels")))
