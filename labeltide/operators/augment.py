"""Training-data augmentation.

The reference documents three augmentation kinds and reads the files they
produce.  "Protected" tokens are a lexicon table ``(token)``; lookups are
joins against it (stored, so broadcast only if its bytes allow), never Python sets.
A text without tokens has no ends: it yields nothing.
Tokens are whitespace tokens (``str.split`` semantics); output text joins
them with single spaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import stored
from .layout import keep_where
from .prepare import union_datasets

def _lexicon(lexicon: DataFrame, token_col: str) -> DataFrame:
    """The distinct lexicon, stored once, so the planner knows its bytes."""
    return stored(lexicon.select(F.col(token_col).alias("__lex")).distinct(), "lexicon")


def _flag(stored_lexicon: DataFrame, flag: str) -> DataFrame:
    return stored_lexicon.select(F.col("__lex").alias(f"{flag}_tok"), F.lit(True).alias(flag))


def _with_end_flags(df: DataFrame, text_col: str, lexicon: DataFrame, token_col: str) -> DataFrame:
    t = df.withColumn("__toks", tokens(F.col(text_col)))
    t = t.withColumn("__first", F.try_element_at("__toks", F.lit(1))).withColumn("__last", F.try_element_at("__toks", F.lit(-1)))
    checked = _lexicon(lexicon, token_col)
    a = _flag(checked, "__pf")
    b = _flag(checked, "__pl")
    t = t.join(a, F.col("__first") == F.col("__pf_tok"), "left")
    t = t.join(b, F.col("__last") == F.col("__pl_tok"), "left")
    return (t.withColumn("__pf", F.coalesce("__pf", F.lit(False)))
            .withColumn("__pl", F.coalesce("__pl", F.lit(False)))
            .drop("__pf_tok", "__pl_tok"))


# --------------------------------------------------------------------- G1
def augment_drop(df: DataFrame, text_col: str, protected: DataFrame,
                 token_col: str = "token", min_tokens: int = 5) -> DataFrame:
    """Rows with more than ``min_tokens`` tokens lose their first and last token.

    Each end is dropped independently unless it is protected; a row where
    both ends are protected yields nothing.  Other columns (label) are kept.
    """
    t = _with_end_flags(df, text_col, protected, token_col)
    t = keep_where(t, (F.size("__toks") > min_tokens) & ~(F.col("__pf") & F.col("__pl")))
    start = F.when(F.col("__pf"), F.lit(1)).otherwise(F.lit(2))
    stop = F.size("__toks") - F.when(F.col("__pl"), F.lit(0)).otherwise(F.lit(1))
    kept = F.slice("__toks", start, stop - start + 1)
    return t.withColumn(text_col, F.array_join(kept, " ")).select(*df.columns)


# --------------------------------------------------------------------- G2
def augment_replace(df: DataFrame, text_col: str, protected: DataFrame,
                    substitutes: DataFrame, token_col: str = "token",
                    substitute_col: str = "substitute", min_tokens: int = 2) -> DataFrame:
    """Rows with more than ``min_tokens`` tokens get first and last token replaced.

    An end is replaced when it is not protected and the substitution table
    has an entry for it; rows where nothing changed are not emitted.
    """
    t = _with_end_flags(df, text_col, protected, token_col)
    subs = stored(substitutes.select(F.col(token_col).alias("__st"), F.col(substitute_col).alias("__sv")), "substitutes")
    s1 = subs.select(F.col("__st").alias("__s1t"), F.col("__sv").alias("__s1"))
    s2 = subs.select(F.col("__st").alias("__s2t"), F.col("__sv").alias("__s2"))
    t = t.join(s1, F.col("__first") == F.col("__s1t"), "left")
    t = t.join(s2, F.col("__last") == F.col("__s2t"), "left")
    new_first = F.when(~F.col("__pf") & F.col("__s1").isNotNull(), F.col("__s1"))
    new_last = F.when(~F.col("__pl") & F.col("__s2").isNotNull(), F.col("__s2"))
    t = t.withColumn("__nf", new_first).withColumn("__nl", new_last)
    t = keep_where(t, (F.size("__toks") > min_tokens)
                   & (F.col("__nf").isNotNull() | F.col("__nl").isNotNull()))
    n = F.size("__toks")
    middle = F.slice("__toks", F.lit(2), F.greatest(n - 2, F.lit(0)))
    text = F.array_join(F.concat(F.array(F.coalesce("__nf", "__first")), middle,
                                 F.array(F.coalesce("__nl", "__last"))), " ")
    return t.withColumn(text_col, text).select(*df.columns)


# --------------------------------------------------------------------- G3
def augment_generate(df: DataFrame, text_col: str, label_col: str, id_col: str,
                     additions: DataFrame, protected: DataFrame, relabel: str,
                     token_col: str = "token") -> DataFrame:
    """Append two tokens per row from ``additions(id, tok1, tok2)``.

    If either appended token is protected the label becomes ``relabel``.
    ``additions`` is keyed by the row id; it is joined, not broadcast.
    """
    add = additions.select(F.col(id_col), F.col("tok1").alias("__a1"), F.col("tok2").alias("__a2"))
    t = df.join(add, id_col, "inner")
    checked = _lexicon(protected, token_col)
    a = _flag(checked, "__p1")
    b = _flag(checked, "__p2")
    t = t.join(a, F.col("__a1") == F.col("__p1_tok"), "left").join(
        b, F.col("__a2") == F.col("__p2_tok"), "left")
    hit = F.coalesce(F.col("__p1"), F.lit(False)) | F.coalesce(F.col("__p2"), F.lit(False))
    text = F.array_join(F.concat(tokens(F.col(text_col)), F.array("__a1", "__a2")), " ")
    return (t.withColumn(text_col, text)
            .withColumn(label_col, F.when(hit, F.lit(relabel)).otherwise(F.col(label_col)))
            .select(*df.columns))


def bigram_table(df: DataFrame, text_col: str, top: int = 50) -> DataFrame:
    """(token, next, n): each token's ``top`` most frequent successors (ties: by the successor)."""
    toks = tokens(F.col(text_col))
    rest = F.greatest(F.size(toks) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(toks, F.lit(1), rest), F.slice(toks, F.lit(2), rest))
    each = df.select(F.explode(pairs).alias("p")).select(F.col("p.0").alias("token"), F.col("p.1").alias("next"))
    counts = each.groupBy("token", "next").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "next"))
    return counts.withColumn("__k", place).where(F.col("__k") <= top).drop("__k")


def draw_next(rows: DataFrame, id_col: str, from_col: str, bigrams: DataFrame, out_col: str, seed: int | str) -> DataFrame:
    """``rows`` (distinct ``id_col``) with ``out_col``: a successor of ``from_col``, drawn by its count.

    Efraimidis-Spirakis: of a token's successors the one with the smallest exponential key
    -ln(u) / n, where u comes from the MD5 of id, seed and successor; so reruns agree and no
    state is kept.  A token that nothing follows is repeated.
    """
    digits = F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)), "next")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    drawn = (rows.select(id_col, from_col).join(bigrams, F.col(from_col) == F.col("token"))
             .groupBy(id_col).agg(F.min(F.struct((-F.log(u) / F.col("n")).alias("key"), "next")).alias("__best")))
    best = drawn.select(F.col(id_col).alias("__id"), F.col("__best.next").alias("__next"))
    return rows.join(best, F.col(id_col) == F.col("__id"), "left").withColumn(out_col, F.coalesce("__next", from_col)).drop("__id", "__next")


# --------------------------------------------------------------------- G4
def with_augmented(base: DataFrame, extra: Sequence[DataFrame],
                   names: Sequence[str] | None = None) -> DataFrame:
    """Base rows plus augmented rows, tagged by ``source`` and ``source_rank``."""
    frames = [base, *extra]
    names = list(names) if names else ["base"] + [f"augment{i}" for i in range(1, len(frames))]
    return union_datasets(frames, names)
