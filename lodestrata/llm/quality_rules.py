"""Quality rules with adaptive thresholds.

Native: DataFrame and SQL expressions only. Measures of each text are built-in expressions over its own row. Spark's
approximate percentiles are mergeable quantile sketches: each task sketches the measures of its rows by language and source,
and merged sketches of some kilobytes for each of the groups are all that is shuffled. A document is rejected where a measure
lies beyond its group's fence, of those documents that the base rules keep; groups of few of these have the fence of all. A fence
is `spread` times the distance between quartiles above the third one. Where three quarters of a group have one value (no
symbols, no repeated lines), quartiles say nothing, and the fence is where the sketched quantiles from there up first jump:
half way between the clean documents and the others, which is another place in each group. A least distance from the third
quartile guards both against groups without any spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Quantiles that a group's sketch is asked for: both quartiles, and each hundredth from the third one up.
QUANTILES = [0.25, *(k / 100 for k in range(75, 101))]
#: Measures and the least distance of a fence from the third quartile, so that groups of nearly equal texts keep theirs.
MEASURES = {"symbol_ratio": 0.02, "dup_line_ratio": 0.34, "repeat_ratio": 0.16, "word_length": 0.5}


def with_measures(docs: DataFrame, carried: list[str]) -> DataFrame:
    """doc (the carried columns as one, so that none clashes with others), lang, source, n_words, word_chars, n_symbols, n_lines
    (with words), n_dup_lines and n_repeat_words. Null texts have no words."""
    docs = docs.select(F.struct(*(F.col(f"`{x}`") for x in carried)).alias("doc"), "lang", "source", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = F.col("text")
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    out = docs.withColumn("_words", words)
    n = F.size("_words")
    # hashes of all windows of five words with their starts, in order of the hashes
    window = F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(*(F.try_element_at("_words", i + k) for k in range(5))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "_lines": lines,
        "_windows": F.when(n >= 6, window).otherwise(F.array().cast("array<bigint>")),
    })
    out = out.drop("_words").withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_sorted": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.arrays_zip(F.col("_windows").alias("h"), F.sequence(F.lit(1), F.greatest(F.size("_windows"), F.lit(1))).alias("i")))),
    })
    hash_at = lambda i: F.try_element_at("_sorted", i)["h"]  # noqa: E731  from 1; null beyond the end
    twice = F.filter("_sorted", lambda x, k: (x["h"] == hash_at(k + 2)) | ((k > 0) & (x["h"] == hash_at(F.greatest(k, F.lit(1))))))
    out = out.drop("_lines", "_windows").withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate("_twice", F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")))
    out = out.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long"))
    # a generator of one row: conditions on the measures stay above it, else Spark would put the expressions into each of them
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return out.select("doc", "lang", "source", F.inline(F.array(F.struct(*names))))


def _ratios(out: DataFrame) -> DataFrame:
    per = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(y), F.lit(0)), F.lit(0.0))
    return out.withColumns({"symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")})


def _fence(q: Column, spread: float, least: float) -> Column:
    """From QUANTILES of a measure."""
    low, third = q[0], q[1]
    jump = lambda i: F.when(q[i] - q[i - 1] > 2 * least, (q[i] + q[i - 1]) / 2)
    first_jump = F.coalesce(*(jump(i) for i in range(2, len(QUANTILES))), F.lit(0.0))
    return F.greatest(third + spread * (third - low), F.when(third == low, first_jump), third + F.lit(least))


def thresholds(measured: DataFrame, spread: float, least_docs: int, accuracy: int) -> DataFrame:
    """lang, source and a fence for each measure."""
    quantiles = lambda x: F.percentile_approx(x, QUANTILES, accuracy)
    groups = measured.groupBy("lang", "source").agg(F.count("*").alias("n"), *(quantiles(m).alias(m) for m in MEASURES))
    overall = measured.agg(*(quantiles(m).alias(f"all_{m}") for m in MEASURES))
    # one row for all beside each group
    own = groups.join(F.broadcast(overall)).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(F.when(F.col("n") >= least_docs, F.col(m)).otherwise(F.col(f"all_{m}")).alias(m) for m in MEASURES))
    return own.select("g_lang", "g_source", *(_fence(F.col(m), spread, least).alias(f"max_{m}") for m, least in MEASURES.items()))


def _judged(docs: DataFrame, carried: list[str], spread: float, least_docs: int, accuracy: int) -> DataFrame:
    measured = materialize(_ratios(with_measures(docs, carried)), "measures")  # taken once, for the sketches and for the verdicts
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fences = thresholds(measured.where(~failed), spread, least_docs, accuracy)
    out = measured.join(fences, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    beyond = " or ".join(f"coalesce({m} > max_{m}, false)" for m in MEASURES)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.expr(beyond))


VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(docs: DataFrame, spread: float = 6.0, least_docs: int = 30, accuracy: int = 10_000) -> DataFrame:
    """All columns of docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in windows of five words that the text has twice.
    Null texts have no words and fail. Null languages and sources are groups of their own. Repeated rows are judged each;
    further columns stay, whatever their names, but for those named like the verdict's, which are replaced; an empty table
    gives an empty result."""
    out = _judged(docs, docs.columns, spread, least_docs, accuracy)
    return out.select(*(F.col("doc")[x].alias(x) for x in docs.columns if x not in VERDICT), *VERDICT)


def kept_rows(docs: DataFrame, spread: float = 6.0, least_docs: int = 30, accuracy: int = 10_000) -> DataFrame:
    """The rows that judge() keeps, with the columns of docs as they are, whatever their names."""
    return _judged(docs, docs.columns, spread, least_docs, accuracy).where("kept").select(*(F.col("doc")[x].alias(x) for x in docs.columns))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return _judged(docs, ["doc_id"], 6.0, 30, 10_000).select("doc.doc_id", *VERDICT)
