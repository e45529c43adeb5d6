"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of each whole text are built-in expressions. From a bounded sample of labelled statistics, sequential
covering learns an ordered list of rules: grow a conjunction of thresholds by information gain on two thirds of the
sample, prune its last conditions on the other third, keep the rule if it is precise enough there, take away what
it covers, and go on. The list becomes one ordered Spark conditional expression (CASE WHEN ... THEN reject).

Null and empty texts have no words: they fail the base rule and are not kept. Rows are judged alone, so repeated rows
and ties are judged alike; null ids are judged like others; columns that a call adds replace those of the same name.
An empty table gives an empty table; without usable labels the list is empty and the base rule alone decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

SYMBOLS = r"[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SAMPLE_ROWS = 4000


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _repeats(words: Column) -> Column:
    """Words that stand in a three-word window which the text has at least twice."""

    def covered(keys: Column) -> Column:
        rows = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(rows, j)["k"] == e["k"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(rows, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))
            gaps = lambda at: F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
            return F.aggregate(_let(at, gaps), F.lit(0), lambda a, g: a + g)

        return _let(rows, twice)

    # the last two windows are short, and so equal to no other; _let, as a pushed filter would split the text for each word
    keys = lambda words: F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(_let(words, keys), lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered(keys)).otherwise(F.lit(0)))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and a column for each statistic."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    left = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    first = {"\u0001words": words_of(text), "\u0001lines": lines}
    words, lines = F.col("\u0001words"), F.col("\u0001lines")
    made = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": left(SYMBOLS),
        "n_upper": left("[A-Z]"),
        "n_bangs": left("[!?]"),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeats(words),
    }
    out = docs.drop(*made).withColumns(first)
    return out.withColumns({k: v.cast("long") for k, v in made.items()}).drop(*first)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules set thresholds on: shares, which do not depend on a text's length, and the length."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "bangs_per_word": per("n_bangs", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.bound) is self.above

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.bound:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects; what none rejects is accepted."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def _cases(self, values: list[Column], otherwise: Column) -> Column:
        cols = features()
        case = None
        for rule, value in zip(self.rules, values, strict=True):
            both = F.lit(True)
            for c in rule:
                both = both & ((cols[c.feature] >= c.bound) if c.above else (cols[c.feature] < c.bound))
            case = F.when(both, value) if case is None else case.when(both, value)
        return otherwise if case is None else case.otherwise(otherwise)

    def accepts(self) -> Column:
        return self._cases([F.lit(False)] * len(self.rules), F.lit(True))

    def reason(self) -> Column:
        return self._cases([F.lit(" and ".join(map(str, rule))) for rule in self.rules], F.lit(None).cast("string"))

    def accepts_row(self, row: dict) -> bool:
        return not any(all(c.holds(row) for c in rule) for rule in self.rules)


def learn(rows: list[dict], *, precision: float = 0.75, least: int = 5, conditions: int = 3, most_rules: int = 12, bins: int = 40) -> DecisionList:
    """A decision list that rejects rows with `bad`; rows hold the features and, as `fold`, a number from 0 to 2."""
    if not rows:
        return DecisionList()
    names = [k for k in rows[0] if k not in ("bad", "fold")]
    bounds = {}
    for k in names:
        values = sorted({r[k] for r in rows})
        bounds[k] = values if len(values) <= bins else sorted({values[i * len(values) // bins] for i in range(1, bins)} | {values[1]})
    grow, prune = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]]
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < most_rules:
        rule: list[Condition] = []
        inside = grow
        while len(rule) < conditions:
            p, n = sum(r["bad"] for r in inside), sum(not r["bad"] for r in inside)
            if not p or not n:
                break
            now, best = math.log2(p / (p + n)), (1e-9, None)
            for k in names:
                # counts of each bin, then of all rows at or above each bound
                marks = bounds[k]
                bad, good = [0] * (len(marks) + 1), [0] * (len(marks) + 1)
                for r in inside:
                    lo, hi, v = 0, len(marks), r[k]
                    while lo < hi:
                        mid = (lo + hi) // 2
                        if marks[mid] <= v:
                            lo = mid + 1
                        else:
                            hi = mid
                    (bad if r["bad"] else good)[lo] += 1
                pa, na = p, n
                for j, bound in enumerate(marks):
                    pa, na = pa - bad[j], na - good[j]
                    for above, pp, nn in ((True, pa, na), (False, p - pa, n - na)):
                        if pp >= least:
                            gain = pp * (math.log2(pp / (pp + nn)) - now)
                            if gain > best[0]:
                                best = (gain, Condition(k, above, float(bound)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [r for r in inside if best[1].holds(r)]
        if not rule:
            break

        def worth(part: list[Condition]) -> tuple[float, int]:
            hit = [r["bad"] for r in prune if all(c.holds(r) for c in part)]
            return ((sum(hit) + 1) / (len(hit) + 2), sum(hit))

        short = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda part: (round(worth(part)[0], 2), worth(part)[1], -len(part)))
        hit = [r["bad"] for r in prune if all(c.holds(r) for c in short)]
        both = [r["bad"] for r in rows if all(c.holds(r) for c in short)]
        if not hit or sum(hit) < precision * len(hit) or sum(both) < precision * len(both) or sum(both) < least:
            break
        rules.append(tuple(short))
        grow, prune = ([r for r in part if not all(c.holds(r) for c in short)] for part in (grow, prune))
        rows = [r for r in rows if not all(c.holds(r) for c in short)]
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learns from at most sample_rows labelled documents, those with the smallest hashes of their ids.

    A label of 0 is bad; null labels and ids are left out; of contradicting labels the smallest counts, of
    repeated ids one text is taken.
    """
    key = F.col(f"`{id_col}`")
    label = labels.select(key.alias("\u0001id"), F.col(f"`{label_col}`").alias("\u0001label")).dropna()
    label = label.groupBy("\u0001id").agg(F.min("\u0001label").alias("\u0001label"))
    label = label.orderBy(F.xxhash64("\u0001id"), "\u0001id").limit(sample_rows)
    some = docs.select(key.alias("\u0001id"), F.col(f"`{text_col}`").alias("text"))
    some = some.join(F.broadcast(label), "\u0001id")  # sample_rows rows at most
    fold = F.pmod(F.xxhash64("\u0001id", F.lit(7)), F.lit(3)).cast("int").alias("fold")
    named = features()
    columns = [(F.col("\u0001label") == 0).alias("bad"), fold, base_failed().alias("failed"), *[v.alias(k) for k, v in named.items()]]
    got = statistics(some).select("\u0001id", *columns).collect()
    rows = {r["\u0001id"]: {k: r[k] for k in ("bad", "fold", *named)} for r in sorted(got) if not r["failed"]}
    return learn(list(rows.values()))


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """docs with statistics, base_failed, kept, and the rule that rejected."""
    stats = statistics(docs, text_col)
    return stats.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & rules.accepts(), "rule": rules.reason()})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, load(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")


QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL: dict[str, str] = {}
