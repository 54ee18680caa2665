"""Quality rules as a short-circuit cascade, with DataFrame operations only.

A rule is a named SQL condition that rejects, over measures of a text.  ``plan`` estimates on a sample what each rule costs and rejects and
orders the rules by rejections per cost, each among the rows that the rules before it leave; ``verdict`` is one nested expression in
this order.  A measure is computed where the first rule that needs it is reached, once a row, and the array of words is handed on
from rule to rule; a row that is rejected computes nothing more.  The order changes what a run costs, never what is kept.

The sample is a hash of ids over the whole table, texts of any length among them; costs are units of work per character and word (measured
once, see ``COSTS``), not wall-clock times, so one table has one order, and ``rejected_by`` is reproducible.

Repeated 5-word windows are found inside a row: windows are 64-bit hashes in an array, which is sorted only if it is not distinct, so
no row is exploded or shuffled and a text costs n log n.

Defined cases: null text has no words and is rejected; nulls elsewhere, repeated rows and other columns are carried through; ``features`` and
``cascade`` replace columns that bear the name of what they add, ``keep_good`` returns all columns as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, about, on which costs and selectivities are estimated; never more than four times as many.
SAMPLE_ROWS = 512

# White space, and the characters counted as symbols.
SPACE = r" \t\n\u000B\u000C\r"
SYMBOLS = "#*$%&|<>"

TEXT = "coalesce(text, '')"
WORDS = rf"IF(trim(BOTH '{SPACE}' FROM {TEXT}) = '', cast(array() AS array<string>), split(trim(BOTH '{SPACE}' FROM {TEXT}), '[\\x20\\x09-\\x0D]+'))"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(words: str, k: int = 5) -> str:
    """SQL for the number of words in windows of ``k`` words that occur at least twice in the array ``words``."""
    window = ", ".join(["w", *[f"{words}[i + {j}]" for j in range(1, k)]])
    hashes = f"IF(size({words}) < {k}, cast(array() AS array<bigint>), transform(slice({words}, 1, size({words}) - {k - 1}), (w, i) -> xxhash64({window})))"
    places = "sort_array(filter(transform(s, (e, i) -> IF(e.h <=> get(s, i - 1).h OR e.h <=> get(s, i + 1).h, e.i, NULL)), x -> x IS NOT NULL))"
    covered = f"aggregate(transform(p, (x, i) -> least({k}, coalesce(get(p, i + 1) - x, {k}))), 0L, (a, x) -> a + x)"
    slow = _let("s", "sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))", _let("p", places, covered))
    return _let("h", hashes, f"IF(size(array_distinct(h)) = size(h), 0L, {slow})")


LINES = rf"filter(split({TEXT}, '\n'), l -> trim(BOTH '{SPACE}' FROM l) <> '')"

#: SQL of every measure; the first ones read the array ``ws`` of words, which is made once a row.
OF_WORDS: dict[str, str] = {
    "n_words": "cast(size(ws) AS bigint)",
    "word_chars": "cast(length(array_join(ws, '')) AS bigint)",
    "n_repeat_words": repeated_words("ws"),
}
MEASURES = OF_WORDS | {
    "n_symbols": f"cast(length({TEXT}) - length(regexp_replace({TEXT}, '[{SYMBOLS}]+', '')) AS bigint)",
    "n_dup_lines": _let("ls", LINES, "cast(size(ls) - size(array_distinct(ls)) AS bigint)"),
    "n_capitals": f"cast(length({TEXT}) - length(regexp_replace({TEXT}, '[A-Z]+', '')) AS bigint)",
}
#: Nanoseconds a character and a word of each measure, and of making ``ws``; only their proportions matter.
COSTS = {"ws": (15, 75), "n_words": (0, 0), "word_chars": (0, 60), "n_repeat_words": (0, 470), "n_symbols": (19, 0), "n_dup_lines": (7, 0), "n_capitals": (18, 0)}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``reject`` holds; ``needs`` are the measures it reads."""

    name: str
    reject: str
    needs: tuple[str, ...]


BASE = (
    Rule("too_few_words", "n_words < 10", ("n_words",)),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words", ("n_words", "n_repeat_words")),
)
RULES = (
    *BASE,
    Rule("symbols", "100 * n_symbols > 30 * n_words", ("n_words", "n_symbols")),
    Rule("capitals", "100 * n_capitals > 50 * word_chars", ("word_chars", "n_capitals")),
    Rule("word_length", "word_chars > 20 * n_words", ("n_words", "word_chars")),
)
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, names: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """``docs`` with the measures ``names``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("skarn_row"), "text")  # no name of the caller's is in the way
    of_words = [n for n in names if n in OF_WORDS]
    if of_words:
        packed = packed.withColumn("skarn_measures", F.expr(_let("ws", WORDS, f"struct({', '.join(f'{OF_WORDS[n]} AS {n}' for n in of_words)})")))
    return packed.select("skarn_row.*", *[F.expr(f"skarn_measures.{n}" if n in OF_WORDS else MEASURES[n]).alias(n) for n in names])


@dataclass(frozen=True)
class Estimate:
    """Mean cost (nanoseconds) and share of rejected rows, among the sampled rows that the rules before leave."""

    rule: Rule
    cost: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.cost


def _steps(needs: Sequence[str], have: frozenset[str]) -> list[str]:
    """Measures, and ``ws`` in front of the first that reads it, still to be made."""
    new = [n for n in needs if n not in have]
    return ["ws"] * (any(n in OF_WORDS for n in new) and "ws" not in have) + new


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> list[Estimate]:
    """The rules with their estimates, in the order of the cascade; rules that reject nothing more in the sample come last, cheapest first."""
    every = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.select("text").where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(every)) == 0).limit(4 * SAMPLE_ROWS)
    names = sorted({n for r in rules for n in (*r.needs, "n_words")})
    tested = [F.coalesce(F.expr(r.reject), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    rows = features(sample, names).select(F.length(F.expr(TEXT)).alias("chars"), F.col("n_words").alias("words"), *tested).collect() if rules else []

    left, order, have, rest = rows, [], frozenset(), list(enumerate(rules))
    while rest:

        def estimate(item: tuple[int, Rule]) -> Estimate:
            k, rule = item
            steps = _steps(rule.needs, have)  # noqa: B023
            cost = sum(COSTS[s][0] * r.chars + COSTS[s][1] * r.words for r in left for s in steps) / max(len(left), 1)  # noqa: B023
            return Estimate(rule, 1.0 + cost, sum(r[2 + k] for r in left) / max(len(left), 1))  # noqa: B023

        best = min(rest, key=lambda item: (lambda e: (-e.gain, e.cost, e.rule.name))(estimate(item)))
        order.append(estimate(best))
        have |= {*_steps(best[1].needs, have), *best[1].needs}
        left = [r for r in left if not r[2 + best[0]]]
        rest.remove(best)
    return order


def verdict(order: Sequence[Rule], have: Sequence[str] = ()):
    """Name of the first rule in ``order`` that rejects, else null; ``have`` are measures that are columns already."""

    def nested(k: int, have: frozenset[str]) -> str:
        if k == len(order):
            return "cast(NULL AS string)"
        rule = order[k]
        steps = _steps(rule.needs, have)
        body = f"IF({rule.reject}, '{rule.name}', {nested(k + 1, have | {*steps})})"
        for name in reversed(steps):
            body = _let(name, WORDS if name == "ws" else (OF_WORDS | MEASURES)[name], body)
        return body

    return F.expr(nested(0, frozenset(have)))


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with the measures of ``SHOWN``, ``rejected_by`` (null for kept rows), ``base_failed`` and ``kept``; other measures are made only where a rule needs them."""
    measured = features(docs.drop("rejected_by", "base_failed", "kept"), SHOWN)
    base = F.expr(" OR ".join(f"({r.reject})" for r in BASE))
    out = measured.withColumn("rejected_by", verdict([e.rule for e in plan(docs, rules)], SHOWN))
    return out.withColumn("base_failed", base).withColumn("kept", F.expr("rejected_by IS NULL AND NOT base_failed"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    packed = docs.select(F.struct("*").alias("skarn_row"), "text")
    return packed.where(verdict([e.rule for e in plan(docs, rules)]).isNull()).select("skarn_row.*")
