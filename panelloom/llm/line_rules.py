"""Line-first cleaning with DataFrame functions only: op9.

Each line with a word is judged by rules: it ends no sentence; it is navigation (many bars, or a phrase of site menus);
it is boilerplate (a phrase of notices); most of its words carry symbol runs; it shouts. Lines that fail go, and a
document that loses more than `most_lost` percent of its lines' characters is rejected, as are those that fail the
base rules (fewer than 50 words, or more than half of the words in three-word windows found twice or more).

All work is done within a row, without a shuffle. Repeated windows are found by sorting: each window's hash and place
make one number, equal windows are then neighbours, and their words are compared.

Defined results: null text is empty; texts without words fail the base rules; a null id is kept as it is; repeated rows
yield a row each; other columns are not looked at; an empty table yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: A sentence ends: a mark, closing quotes or brackets, then white space or the end.
SENTENCE_END = r"[.!?…:;]['\")\]»”’]*([\x20\x09-\x0D]|$)"
SYMBOL_RUN = r"[#*$%&<>=~^_]{3}"
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|log ?out|sign (in|up)|search|next( page)?|previous( page)?|back to top|skip to (main )?content|site ?map"
    r"|contact( us)?|about( us)?|share( this)?|read more|load more|click here|print this page)[.!?:]?[\x20\x09-\x0D]*$"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|uses? cookies|accept (all )?cookies|privacy policy|terms (of use|of service|and conditions)"
    r"|enable javascript|subscribe to our newsletter|powered by wordpress|lorem ipsum|page not found)"
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _line_fails(line: Column) -> Column:
    n = _count(line, WORD + "+")
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    navigation = ((bars >= 2) & (bars * 5 >= n)) | line.rlike(NAVIGATION)
    symbols = _count(line, SYMBOL_RUN) * 10 > n * 3
    shouting = (_count(line, "!!") * 10 > n * 3) | ((n >= 3) & (line == F.upper(line)) & (line != F.lower(line)))
    return ~line.rlike(SENTENCE_END) | navigation | line.rlike(BOILERPLATE) | symbols | shouting


def clean_lines(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50, most_lost: int = 50) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed, n_chars_lost,
    kept, text): counts of the whole input text; text: the lines that stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = frame.select(
        F.col(id_col).alias("__id"),
        text.alias("__t"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("__w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("__l"),
    )
    n = F.size("__w").cast("long")
    # so many hash values leave space for the place
    room = F.expr("9223372036854775807 div greatest(__n, 1) - 2")
    numbers = F.transform(
        F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 2, F.lit(0))),
        lambda w, i: F.pmod(F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)), F.col("__room")) * F.col("__n") + i,
    )
    counted = (
        split.withColumn("__n", n)
        .withColumn("__room", room)
        .withColumn("__s", F.sort_array(numbers))
        .withColumn("__f", F.filter("__l", _line_fails))
    )

    def same(p: Column, q: Column) -> Column:
        """Whether two numbers stand for equal windows."""
        i, j = F.pmod(p, F.col("__n")).cast("int"), F.pmod(q, F.col("__n")).cast("int")
        equal = F.expr("true")
        for k in range(3):
            equal = equal & (F.get("__w", i + k) == F.get("__w", j + k))
        return (p - F.pmod(p, F.col("__n")) == q - F.pmod(q, F.col("__n"))) & equal

    def neighbour(p: Column, i: Column) -> Column:
        before, after = F.get("__s", i - 1), F.get("__s", i + 1)
        return F.coalesce(same(p, before), F.lit(False)) | F.coalesce(same(p, after), F.lit(False))

    twice = F.sort_array(F.transform(F.filter("__s", neighbour), lambda p: F.pmod(p, F.col("__n"))))
    marked = counted.withColumn("__p", twice)
    repeated = F.aggregate(
        "__p",
        F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("c")),
        lambda a, p: F.struct((p + 3).alias("e"), (a["c"] + p + 3 - F.greatest(a["e"], p)).alias("c")),
        lambda a: a["c"],
    )
    letters = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    out = marked.select(
        F.col("__id").alias(id_col),
        F.col("__n").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _count(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size("__f").cast("long").alias("n_lines_removed"),
        letters("__f").alias("n_chars_lost"),
        letters("__l").alias("__all"),
        F.array_join(F.filter("__l", lambda x: ~_line_fails(x)), "\n").alias("text"),
    )
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    out = out.withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_chars_lost") * 100 <= F.col("__all") * most_lost)).drop("__all")
