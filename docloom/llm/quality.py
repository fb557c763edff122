"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule is (name, measure, low, high): a text passes while low <= measure <= high. All measures are
Spark expressions over the text, so the verdict is one narrow projection with no shuffle.

Null or empty text: all counts are 0 and the base rule (n_words < 50) rejects it. Very long texts are counted whole, in
time in proportion to their words but for one sort where windows repeat. Ties, repeated rows, null ids and other columns
play no part: each row is judged alone and extra columns are left out. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, only

#: The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "are", "be", "this", "from", "by", "or", "an",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour", "sur", "pas", "avec", "en", "au",
    "der", "die", "das", "und", "ist", "von", "nicht", "mit", "ein", "eine", "sich", "den", "dem", "zu", "auf",
    "el", "los", "las", "y", "del", "por", "con", "una", "su", "para", "se", "al",
)


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict beyond the base rule. Measures are keys of ``measures()``.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.4),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
)


def words_of(text: Column) -> Column:
    """Maximal runs without the six white-space characters, in order."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more, the first occurrence included.

    Texts whose windows are all distinct (the common case) end after one hash-set pass; the others
    sort (window, position) once and measure the union of the repeated windows.
    """

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["w"] == F.get(s, k + 1)["w"]) | (x["w"] == F.get(s, k - 1)["w"]))
            at = F.array_sort(F.transform(F.filter(again, lambda x: x.isNotNull()), lambda x: x["i"]))
            return let(
                at,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get(p, k - 1), F.lit(3)))),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
            )

        return let(ordered, of_sorted)

    # Distinct hashes prove distinct windows; equal hashes are only a reason to look at the words.
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    suspicious = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    triples = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when((F.size(words) >= 3) & suspicious, let(triples, covered)).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that rules may name; ``df`` keeps its own columns."""
    raw = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(raw, SPACES, "")
    lines = F.filter(F.split(raw, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counted = df.select(
        "*",
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(raw) - F.char_length(F.translate(raw, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(x, lambda y: F.substring(F.ltrim(y), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullets"),
            ),
        ).alias("_lines"),
        let(
            words_of(F.col(text)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("_words"),
    )
    flat = counted.select("*", "_lines.*", "_words.*").drop("_lines", "_words")
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_words").cast("double")), F.lit(0.0))
    per_line = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_lines").cast("double")), F.lit(0.0))
    return flat.select(
        "*",
        per_word("word_chars").alias("mean_word_chars"),
        F.coalesce(F.try_divide(F.col("n_symbols").cast("double"), F.col("word_chars").cast("double")), F.lit(0.0)).alias("symbol_ratio"),
        per_word("n_stop").alias("stop_ratio"),
        per_line("n_dup_lines").alias("dup_line_ratio"),
        per_line("n_bullets").alias("bullet_line_ratio"),
    )


def passes(rules=RULES) -> Column:
    """The rule table as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict &= F.col(rule.measure) >= F.lit(float(rule.low))
        if rule.high is not None:
            verdict &= F.col(rule.measure) <= F.lit(float(rule.high))
    return verdict


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: counts, ratios, ``base_failed``, ``failed_rules`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~passes([r]), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return (
        measures(only(df, doc_id=id_col, text=text_col))
        .drop("text")
        .select("*", base.alias("base_failed"), failed.alias("failed_rules"))
        .select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
    )


def oracle(rules=RULES) -> str:
    """The same projection for DuckDB, built from the same rule table."""
    checks = [f"{r.measure} >= {float(r.low)}" for r in rules if r.low is not None] + [f"{r.measure} <= {float(r.high)}" for r in rules if r.high is not None]
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
wins as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win
  from (select rid, words, unnest(range(1, len(words) - 1)) as i from d where len(words) >= 3)),
rep as (select rid, i, count(*) over (partition by rid, win) as c from wins),
cov as (select rid, count(distinct i + k) as n from rep, (values (0), (1), (2)) as t(k) where c > 1 group by rid),
m as (
  select d.doc_id, len(words)::bigint as n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         len(list_filter(lines, lambda y: regexp_matches(y, '^ *[-*•]')))::bigint as n_bullets,
         len(list_filter(words, lambda w: lower(w) in ({stop})))::bigint as n_stop,
         coalesce(cov.n, 0)::bigint as n_repeat_words
  from d left join cov using (rid)),
r as (
  select *, coalesce(word_chars::double / nullif(n_words, 0), 0) as mean_word_chars,
         coalesce(n_symbols::double / nullif(word_chars, 0), 0) as symbol_ratio,
         coalesce(n_stop::double / nullif(n_words, 0), 0) as stop_ratio,
         coalesce(n_dup_lines::double / nullif(n_lines, 0), 0) as dup_line_ratio,
         coalesce(n_bullets::double / nullif(n_lines, 0), 0) as bullet_line_ratio,
         (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and {' and '.join(checks) or 'true'}) as kept
from r"""
