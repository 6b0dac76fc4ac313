"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule reads measures of the text. Where documents are filtered, a text's words are cut once, every other measure is part of
the rule's own expression, and the rules stand in one CASE: a text that one of them rejects meets no later one, and what
only later ones read of it is never computed. Their order comes from a sample: each rule's selectivity is counted on it, its cost is summed from the sizes of
the sample's texts at the rule's price per character, line and word (PRICES, measured once on one core), and rules go by
smoothed rejection per cost. So costs are those of rows, not of a job's start, and the order is the same in every run. The
order moves time only: what is kept is the same in any order; rejected_by names the first rule met.

Where all measures are wanted (judge), those are computed for every row, and the rules' other inputs lazily.

Defined cases: null and blank texts have no word, so the base rules reject them; words are runs of anything but ASCII
white space, of whole texts, however long; lines end at line feeds only; repeated rows are judged alike; an empty table
gives an empty result and the rules' given order; other columns are passed by, whatever their names. Five-word windows
are compared by a 64-bit hash of their words' 64-bit hashes (in a text of 100,000 words, two differ and agree with a
probability below 1e-9, in one of a million words below 1e-7).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbin.llm.common import let, restored, shielded, words

WINDOW = 5
WORD = r"[^\x20\x09-\x0D]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rows of the sample on which selectivities are counted and sizes summed (about).
SAMPLE_ROWS = 2000


def _repeated(hashes: Column) -> Column:
    """Words that lie in windows found twice or more, from the words' hashes."""

    def spread(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["g"] == x["g"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["g"] == x["g"])))
        places = F.sort_array(F.transform(let(ranked, twice), lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    n = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(n <= WINDOW, 0).otherwise(let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(spread(g))))


class OfText:
    """The measures as expressions over a text (not null), each computed where it is read."""

    def __init__(self, text: Column):
        self.text = text

    @property
    def n_words(self) -> Column:
        return F.regexp_count(self.text, F.lit(f"{WORD}+")).cast("long")

    @property
    def word_chars(self) -> Column:
        return F.length(F.regexp_replace(self.text, r"[\x20\x09-\x0D]+", "")).cast("long")

    @property
    def n_symbols(self) -> Column:
        return (F.length(self.text) - F.length(F.translate(self.text, "#*$%&|<>", ""))).cast("long")

    @property
    def lines(self) -> Column:
        return F.filter(F.split(self.text, "\n"), lambda x: x.rlike(WORD))

    @property
    def n_lines(self) -> Column:
        return F.size(self.lines).cast("long")

    @property
    def n_dup_lines(self) -> Column:
        return let(self.lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")

    @property
    def n_repeat_words(self) -> Column:
        return let(F.transform(words(self.text), lambda w: F.xxhash64(w)), _repeated).cast("long")

    @property
    def letters(self) -> Column:
        return F.length(F.regexp_replace(self.text, r"[^\p{L}]+", ""))

    @property
    def bullets(self) -> Column:
        return F.regexp_count(self.text, F.lit("(?md)^[ \\t]*[-*\u2022] "))


class OfRow(OfText):
    """The same where MEASURES and n_lines are columns already; the others stay expressions over the text."""

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines = (property(lambda self, m=m: F.col(f"_{m}")) for m in [*MEASURES, "n_lines"])


class OfWords(OfText):
    """The same where a text's words, their number and characters are at hand."""

    def __init__(self, text: Column, all_words: Column, base: Column):
        super().__init__(text)
        self.all_words, self.base = all_words, base

    n_words = property(lambda self: self.base["n_words"])
    word_chars = property(lambda self: self.base["word_chars"])
    n_repeat_words = property(lambda self: let(F.transform(self.all_words, lambda w: F.xxhash64(w)), _repeated).cast("long"))


@dataclass(frozen=True)
class Rule:
    """Rejects where the condition on the measures holds; reads: the measures it computes, the dear ones last."""

    name: str
    rejects: Callable[[OfText], Column] = field(compare=False)
    reads: tuple[str, ...]


def both(a: Column, b: Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(a, b) with each computed once."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: of(s["a"], s["b"]))


BASE = [
    Rule("few_words", lambda m: m.n_words < 10, ("n_words",)),
    Rule("repeated_words", lambda m: both(m.n_repeat_words, m.n_words, lambda r, n: 100 * r > 20 * n), ("n_words", "n_repeat_words")),
]
RULES = [
    Rule("few_letters", lambda m: 2 * m.letters < m.word_chars, ("letters", "word_chars")),
    Rule("bullet_lines", lambda m: both(m.bullets, m.n_lines, lambda b, n: 10 * b > 9 * n), ("bullets", "n_lines")),
    Rule("dup_lines", lambda m: both(m.n_dup_lines, m.n_lines, lambda d, n: (d > 2) & (100 * d > 30 * n)), ("n_dup_lines", "n_lines")),
    Rule("symbols", lambda m: both(m.n_symbols, m.n_words, lambda s, n: 100 * s > 30 * n), ("n_symbols", "n_words")),
    Rule("word_length", lambda m: both(m.word_chars, m.n_words, lambda c, n: (c < 2 * n) | (c > 20 * n)), ("word_chars", "n_words")),
]
#: Nanoseconds of each measure by character and by word.
PRICES = {"n_words": (12, 30), "word_chars": (10, 30), "n_symbols": (9, 0), "n_lines": (6, 3), "n_dup_lines": (7, 3), "n_repeat_words": (10, 700), "letters": (14, 30), "bullets": (12, 0)}


def order(documents: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by rejection per cost, both from a sample of about so many rows, spread by a hash of doc_id."""
    n = documents.count()
    if not n:
        return rules
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // rows))) == 0)
    m = OfText(F.col("_text"))
    sizes = [F.count("*").alias("n"), F.sum(F.length("_text")).alias("chars"), F.sum(m.n_words).alias("words")]
    got = d.agg(*sizes, *[F.count_if(r.rejects(m)).alias(f"r{k}") for k, r in enumerate(rules)]).first()

    def worth(k: int) -> float:
        cost = sum(PRICES[x][0] * (got["chars"] or 0) + PRICES[x][1] * (got["words"] or 0) for x in rules[k].reads)
        return (got[f"r{k}"] + 1) / (got["n"] + 2) / (cost + 1)

    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-worth(k), rules[k].name))]


def verdict(rules: list[Rule], m: OfText) -> Column:
    """The first rule that rejects, else null; later rules are not evaluated."""
    case = F
    for rule in rules:
        case = case.when(rule.rejects(m), rule.name)
    return case.otherwise(None) if rules else F.lit(None).cast("string")


def first_rejecting(text: Column, ordered: list[Rule]) -> Column:
    """verdict() of a text: its words, which most rules read, are cut once; all else is computed as rules are met."""

    def judged(w: Column) -> Column:
        base = F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"))
        return let(base, lambda b: verdict(ordered, OfWords(text, w, b)))

    return let(words(text), judged)


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, _text (null: empty), and as columns MEASURES and n_lines of every row."""
    start = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    split = start.select("doc_id", "_text", words(F.col("_text")).alias("_words"), OfText(F.col("_text")).lines.alias("_lines"))
    return split.select(
        "doc_id",
        "_text",
        F.size("_lines").cast("long").alias("_n_lines"),
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        OfText(F.col("_text")).n_symbols.alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        let(F.transform("_words", lambda w: F.xxhash64(w)), _repeated).cast("long").alias("_n_repeat_words"),
    )


def judge(documents: DataFrame, rules: list[Rule] = RULES, ordered: list[Rule] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, kept and rejected_by of every row."""
    m = OfRow(F.col("_text"))
    by = verdict([*BASE, *(order(documents, rules) if ordered is None else ordered)], m)
    failed = BASE[0].rejects(m) | BASE[1].rejects(m)
    rows = measured(documents.select("doc_id", "text"))
    rows = rows.select("doc_id", *[F.col(f"_{x}").alias(x) for x in MEASURES], failed.alias("base_failed"), by.alias("rejected_by"))
    return rows.select("doc_id", *MEASURES, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def kept_documents(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with their own columns."""
    ordered = order(documents.select("doc_id", "text"), [*BASE, *rules])
    rows, names = shielded(documents)
    return restored(rows.where(first_rejecting(F.coalesce(F.col(names["text"]), F.lit("")), ordered).isNull()), names)


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from w)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
r as (select doc_id, sum(least(5, coalesce(i - p, 5))) as n from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from c where c > 1) group by doc_id),
m as (
  select w.doc_id, t, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
    length(regexp_replace(t, '[^\p{L}]', '', 'g')) as letters,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•] '))) as bullets
  from w left join r on r.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 2 * letters < word_chars or 10 * bullets > 9 * n_lines
    or (n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines) or 100 * n_symbols > 30 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from m
"""
