"""Quality rules: a threshold table compiled into one native Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for with as was it on be by are at from this have or an which "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se "
    "el los del las por con para una su al lo como más o pero sus le ha y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high (a missing bound does not bind)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The table. Measures are SQL over the counts of `measured`; ratios guard empty texts.
RULES = (
    Rule("words", "n_words", 50, None),
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", None, 0.10),
    Rule("exclamations_per_word", "n_exclamations / greatest(n_words, 1)", None, 0.30),
    Rule("letter_share", "n_letters / greatest(word_chars, 1)", 0.60, None),
    Rule("duplicate_line_share", "n_dup_lines / greatest(n_lines, 1)", None, 0.50),
    Rule("ellipsis_line_share", "n_ellipsis_lines / greatest(n_lines, 1)", None, 0.30),
    Rule("bullet_line_share", "n_bullet_lines / greatest(n_lines, 1)", None, 0.90),
    Rule("repeated_word_share", "n_repeat_words / greatest(n_words, 1)", None, 0.50),
    Rule("stop_word_share", "n_stop_words / greatest(n_words, 1)", 0.02, None),
)


#: Columns that the operator adds.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_letters", "n_ellipsis_lines", "n_bullet_lines", "n_stop_words", "base_failed", "kept")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression of the whole table."""
    out = F.lit(True)
    for r in rules:
        value = F.expr(r.measure)
        if r.low is not None:
            out = out & (value >= F.lit(float(r.low)))
        if r.high is not None:
            out = out & (value <= F.lit(float(r.high)))
    return out


def measured(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and the counts that the table speaks of, all from built-in functions.

    Windows of three words are told apart by 64-bit hashes. Texts without a repeated window,
    nearly all clean ones, never reach the sort that places the repeats.
    """
    t = "coalesce(`__text`, '')"
    d = documents.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    d = d.withColumns({
        "__w": F.expr(f"regexp_extract_all({t}, '{WORD_RE}', 0)".replace("\\", "\\\\")),
        "__l": F.expr(f"filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
    })
    d = d.withColumn("__h", F.expr("if(size(__w) < 3, array(), transform(slice(__w, 1, size(__w) - 2), (w, i) -> xxhash64(w, __w[i + 1], __w[i + 2])))"))
    d = d.withColumn("__s", F.expr("if(size(array_distinct(__h)) = size(__h), cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(__h, (h, i) -> struct(h as h, i as i))))"))
    d = d.withColumn("__d", F.expr("if(size(__s) = 0, cast(array() as array<int>), sort_array(transform(filter(__s, (s, k) -> coalesce(get(__s, k - 1).h = s.h, false) or coalesce(get(__s, k + 1).h = s.h, false)), s -> s.i)))"))
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    return d.select(
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)],
        F.expr("cast(size(__w) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(__w, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(regexp_count({t}, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(__l) - size(array_distinct(__l)) as bigint)").alias("n_dup_lines"),
        F.expr("if(size(__d) = 0, 0L, aggregate(__d, struct(0L as n, -3 as last), (a, x) -> struct(a.n + least(3, x - a.last) as n, x as last), a -> a.n))").alias("n_repeat_words"),
        F.expr("cast(size(__l) as bigint)").alias("n_lines"),
        F.expr(f"cast(length({t}) - length(replace({t}, '!', '')) as bigint)").alias("n_exclamations"),
        F.expr(f"cast(length({t}) - regexp_count({t}, '[\\\\x00-@\\\\x5B-`{{-\\\\x7F]') as bigint)").alias("n_letters"),
        F.expr("cast(size(filter(__l, x -> x rlike '(\\\\.\\\\.\\\\.|\\u2026)[\\\\x20\\\\x09-\\\\x0D]*$')) as bigint)").alias("n_ellipsis_lines"),
        F.expr("cast(size(filter(__l, x -> x rlike '^[\\\\x20\\\\x09-\\\\x0D]*[-*\\u2022]')) as bigint)").alias("n_bullet_lines"),
        F.expr(f"if(size(__w) < 50, 0L, cast(size(filter(__w, w -> lower(w) in ({stop}))) as bigint))").alias("n_stop_words"),
    )


def quality_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base_failed and kept of every row.

    A null text has no words: base_failed. Null ids and repeated rows pass through row by
    row. Empty table: no rows. Columns of documents other than keep and text are not read;
    keep may not name a measure.
    """
    own = {f.lower() for f in MEASURES}
    if clash := [c for c in keep if c.lower() in own]:
        raise ValueError(f"kept columns named like measures: {clash}")
    m = measured(documents, text, keep)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of documents that the table keeps, with all their columns, whatever their
    names. A null, empty or short text goes; repeated rows are each judged alike. Empty table:
    no rows."""
    names = documents.columns
    inner = tuple(f"c{i}" for i in range(len(names)))
    judged = quality_rules(documents.toDF(*inner), rules, f"c{names.index(text)}", inner)
    # a generator instead of a filter: a filter would be pushed below the projections, and
    # their expressions with it, once for each use
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return judged.select(*inner, once.alias("once")).select(*inner).toDF(*names)
