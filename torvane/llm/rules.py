"""Quality rules by weak supervision: rules vote good, bad or abstain, and expectation-maximisation weighs them.

Each rule is a column expression over counts of one text. Rows are grouped by their votes, of which there are at most
3 ** rules, so the counts of all documents reach the driver as that many rows; EM fits how often each rule
votes how on good documents and on each kind of bad ones, and the posterior becomes a column expression again. Bad
documents are of as many kinds as there are rules, each starting as what one rule is made for: rules for different
faults seldom agree, so a single bad class would take most of their votes for noise. Documents are handled by DataFrame functions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.llm.shared import cut, release

#: Words of a window whose repetition counts.
WINDOW = 5
ROUNDS = 40
BLANKS = r"[\x20\x09-\x0D]+"
GOOD, BAD, ABSTAIN = 1, -1, 0

#: Where EM starts: the chance that a rule that votes votes bad, on a document without its fault and with it; and pseudo-rows behind them.
SOUND, FAULTY = 0.03, 0.95
WEIGHT = 20.0
#: Share of good documents at the start; the kinds of bad ones share the rest.
PRIOR = 0.8


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at, of every row (doc_id, text); see judge()."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = docs.withColumn("w", F.array_remove(F.split("text", BLANKS), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda marks: F.length("text") - F.length(F.regexp_replace("text", marks, ""))
    out = words.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]+").cast("long"),
        "n_upper": count(r"\p{Lu}+").cast("long"),
        "n_marks": count(r"[!?]+").cast("long"),
        "lines": lines,
        # hashes of the windows that start at each word but the last few
        "h": F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(F.col("w")[i + d] for d in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")),
    })
    out = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "h", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    m = F.size("sorted")
    twins = F.zip_with(F.slice("sorted", F.lit(1), m - 1), F.slice("sorted", F.lit(2), m - 1), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("starts", F.when(F.col("sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(twins))))).drop("h", "sorted")
    s = F.size("starts")
    steps = F.zip_with(F.slice("starts", F.lit(2), s - 1), F.slice("starts", F.lit(1), s - 1), lambda y, x: F.least(F.lit(WINDOW), y - x))
    repeated = F.when(F.col("starts").isNotNull(), WINDOW + F.aggregate(steps, F.lit(0), lambda a, x: a + x)).otherwise(0)
    return out.select("*", repeated.cast("long").alias("n_repeat_words")).drop("starts")


def default_rules() -> dict[str, Column]:
    """Votes by name. Ratios are cross-multiplied, so that no division meets a zero."""
    n, c = F.col("n_words"), F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    return {
        "length": vote(n < 10, n >= 20),
        "word_length": vote((c("word_chars") < 2 * n) | (c("word_chars") > 14 * n), (c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n)),
        "symbols": vote(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        "upper": vote(10 * c("n_upper") > 3 * c("word_chars"), 100 * c("n_upper") <= 15 * c("word_chars")),
        "marks": vote(5 * c("n_marks") > n, 25 * c("n_marks") <= n),
        "lines": vote(2 * c("n_dup_lines") > c("n_lines"), 20 * c("n_dup_lines") <= c("n_lines")),
        "repeats": vote(100 * c("n_repeat_words") > 20 * n, 100 * c("n_repeat_words") <= 5 * n),
    }


Model = tuple[list[float], list[list[float]]]


def _start(rules: int) -> Model:
    kinds = [[SOUND] * rules, *([FAULTY if j == k else SOUND for j in range(rules)] for k in range(rules))]
    return [PRIOR, *([(1 - PRIOR) / rules] * rules)], kinds


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> Model:
    """Shares of the kinds of documents, the good ones first, and by kind and rule the chance of a bad vote among its votes; patterns: (votes, rows)."""
    shares, table = first_shares, first = _start(rules)
    for _ in range(ROUNDS if patterns else 0):
        bad, cast = ([[0.0] * rules for _ in table] for _ in range(2))
        mass = [0.0] * len(table)
        for votes, rows in patterns:
            for k, p in enumerate(kinds_of(shares, table, votes)):
                mass[k] += p * rows
                for j, v in enumerate(votes):
                    bad[k][j] += p * rows * (v == BAD)
                    cast[k][j] += p * rows * (v != ABSTAIN)
        whole = sum(mass) + WEIGHT
        shares = [(m + WEIGHT * s) / whole for m, s in zip(mass, first_shares, strict=True)]
        table = [[(bad[k][j] + WEIGHT * first[k][j]) / (cast[k][j] + WEIGHT) for j in range(rules)] for k in range(len(table))]
    return shares, table


def kinds_of(shares: list[float], table, votes: tuple[int, ...]) -> list[float]:
    """Posterior of each kind; a rule that abstains says nothing."""
    logs = [math.log(s) + sum(math.log(b if v == BAD else 1 - b) for b, v in zip(own, votes, strict=True) if v != ABSTAIN) for s, own in zip(shares, table, strict=True)]
    top = max(logs)
    each = [math.exp(x - top) for x in logs]
    return [x / sum(each) for x in each]


def posterior(shares: list[float], table, votes: tuple[int, ...]) -> float:
    return kinds_of(shares, table, votes)[0]


def judge(docs: DataFrame, *, rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality) of all documents (doc_id, text).

    Words stand between white space; word_chars are their code points, n_symbols the characters #*$%&|<> of the text,
    n_dup_lines its lines with a word that equal an earlier one, n_repeat_words the words in windows of five that the
    text has twice or more (windows are compared by 64-bit hashes). base_failed: fewer than 10 words, or more than a
    fifth of them repeated. quality is the posterior that EM gives; kept if it reaches threshold and base_failed isn't
    set. A null text has no words, and so fails; a null doc_id is kept as it is; repeated rows count as often as they
    occur, get the same verdict and are each returned; other columns are ignored; an empty table gives no rows.
    """
    rules = default_rules() if rules is None else rules
    names = [f"vote_{x}" for x in rules]
    voted = cut(measures(docs).withColumns(dict(zip(names, (v.cast("byte") for v in rules.values()), strict=True))))
    patterns = voted.groupBy(*names).count().collect()  # at most 3 ** rules
    shares, table = fit(sorted((tuple(r[:-1]), r[-1]) for r in patterns), len(names))
    odds = F.lit(0.0)  # of each bad kind against the good one
    for share, own in zip(shares[1:], table[1:], strict=True):
        x = F.lit(math.log(share / shares[0]))
        for name, bad, good in zip(names, own, table[0], strict=True):
            x = x + F.when(F.col(name) == BAD, math.log(bad / good)).when(F.col(name) == GOOD, math.log((1 - bad) / (1 - good))).otherwise(0.0)
        odds = odds + F.exp(x)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (1 / (1 + odds)).alias("quality"))
    out = cut(out.select(*out.columns[:-1], (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality"))
    release(voted)
    return out
