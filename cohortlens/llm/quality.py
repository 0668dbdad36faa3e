"""Line-first cleaning rules.

Each line of a text is judged first: punctuation (no sentence mark at the end of
any word, or mostly doubled marks), symbols, navigation (separators as words)
and boilerplate (short licence, copyright, cookie or script notices).  Failing
lines are removed; a document that loses more than ``MAX_LOSS`` of its word
characters that way is rejected, and so is one that fails the base rules (under
10 words, or over a fifth of its words in repeated 5-word windows).

Everything is a projection of one row: no shuffle, no Python.  Repeated windows
are looked for exactly, by sorting the windows of a text that has any.

Defined cases: null text counts as empty; a text without words fails the base
rules; equal windows and lines (ties) count each; a text is judged whole, in memory
that grows with its length; repeated rows, a null doc_id and extra columns make no
difference to a row's result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, kept_columns, table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS = 0.5
WINDOW = 5
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules of a line, as patterns that Java and RE2 read alike.
SENTENCE_END = r"[.!?:;\x{2026}][\"')\]\x{201D}\x{00BB}]*([\x20\x09-\x0D]|$)"
SHOUT = r"[!?]{2,}"
SYMBOL_RUN = r"[#*$%&|<>~^=_{}]+"
SEPARATOR_WORD = r"(^|[\x20\x09-\x0D])[|>/\x{00BB}\x{203A}\x{2022}\x{00B7}]+[\x20\x09-\x0D]"
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright|licen[sc]ed under|released under the|creative commons|terms of (use|service)|privacy policy|"
    r"cookie|javascript|lorem ipsum|click here|sign up|log ?in|newsletter|powered by|skip to content)"
)
BOILERPLATE_WORDS = 30


def _chars(x: Column) -> Column:
    """Code points that are no ASCII white space."""
    return F.length(F.translate(x, SPACE, ""))


def line_fails(x: Column) -> Column:
    """Whether a line with at least one word fails a rule."""
    n = F.regexp_count(x, F.lit(WORD))
    return (
        ~F.regexp_like(x, F.lit(SENTENCE_END))
        | (F.regexp_count(x, F.lit(SHOUT)) * 10 > n * 3)
        | (F.regexp_count(x, F.lit(SYMBOL_RUN)) * 10 > n * 3)
        | (F.regexp_count(F.concat(x, F.lit(" ")), F.lit(SEPARATOR_WORD)) * 20 > n * 3)
        | ((n <= BOILERPLATE_WORDS) & F.regexp_like(x, F.lit(BOILERPLATE)))
    )


def clean_lines(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, loss, kept and clean_text (what is left of the text)."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    d = kept_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select("doc_id", "text", words.alias("words"), F.split("text", "\n", -1).alias("lines"))
    grams = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.array_join(F.slice("words", i, F.lit(WINDOW)), " ")),
    ).otherwise(F.array().cast("array<string>"))
    d = d.select(
        "doc_id",
        "text",
        "lines",
        F.size("words").cast("bigint").alias("n_words"),
        grams.alias("grams"),
        F.filter("lines", lambda x: F.regexp_like(x, F.lit(WORD))).alias("full"),
    )
    marked = F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"),
        F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<g:string,i:int>>"))
    failed = F.filter("full", line_fails)
    d = d.select("doc_id", "text", "lines", "n_words", "full", marked.alias("marked"), failed.alias("failed"))
    twice = F.filter(
        "marked",
        lambda x, i: F.coalesce(x.g == F.get("marked", i - 1)["g"], F.lit(False)) | F.coalesce(x.g == F.get("marked", i + 1)["g"], F.lit(False)),
    )
    d = d.select("doc_id", "text", "lines", "n_words", "full", "failed", F.sort_array(F.transform(twice, lambda x: x.i)).alias("starts"))
    steps = F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW))))
    d = d.select(
        "doc_id",
        "n_words",
        "lines",
        _chars(F.col("text")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_repeat_words"),
        _chars(F.array_join("failed", "")).cast("bigint").alias("lost_chars"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    clean = F.array_join(F.filter("lines", lambda x: ~(F.regexp_like(x, F.lit(WORD)) & line_fails(x))), "\n")
    d = d.withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * F.lit(MAX_LOSS))
    return d.withColumn("kept", kept).withColumn("clean_text", clean).drop("lines")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return clean_lines(table(spark, sf_dir, "documents")).select(*cols)


_LINE = rf"""(not regexp_matches(line, '{SENTENCE_END.replace("'", "''")}')
      or len(regexp_extract_all(line, '{SHOUT}')) * 10 > nw * 3
      or len(regexp_extract_all(line, '{SYMBOL_RUN}')) * 10 > nw * 3
      or len(regexp_extract_all(line || ' ', '{SEPARATOR_WORD}')) * 20 > nw * 3
      or (nw <= {BOILERPLATE_WORDS} and regexp_matches(line, '{BOILERPLATE}')))"""

OP8_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
s as (select doc_id, len(w) as n, unnest(range(1, len(w) - {WINDOW - 2})) as i, w from d where len(w) >= {WINDOW}),
g as (select doc_id, n, i, count(*) over (partition by doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) as c from s),
st as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nx from g where c > 1),
r as (select doc_id, sum(least({WINDOW}, coalesce(nx - i, {WINDOW})))::bigint as n_repeat from st group by doc_id),
l0 as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
l as (select doc_id, line, len(regexp_extract_all(line, '{WORD}')) as nw, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as nc from l0),
lf as (select doc_id, count(*) - count(distinct line) as n_dup, coalesce(sum(nc) filter ({_LINE}), 0) as lost from l where nw > 0 group by doc_id),
b as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines,
    coalesce(n_repeat, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
  from d left join r on d.doc_id = r.doc_id left join lf on d.doc_id = lf.doc_id),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and lost <= word_chars * {MAX_LOSS}::double as kept from f
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": OP8_SQL}
