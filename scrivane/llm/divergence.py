"""Distribution divergence: Jensen-Shannon distance from the document's language.

Each text gets two histograms: character classes, and the common words of its
language with all other words as one class. A document's references are the sums of
the histograms of its language's other documents, over all of them; it is never held
against itself. Where fewer than LEAST_DOCUMENTS others are there, the character classes
are held against those of all other documents, and the words are not judged. A document
is kept unless a distance exceeds its limit; both limits are widened for short texts by a
slack / sqrt(words), and texts under GUARD_WORDS words are not judged by distance at all.

Everything is Spark expressions on one row, plus one small sum per language.

Nulls and the like: a null or empty text has no words and fails the base rules; very
long texts count whole; a null or unlisted language is judged by the common words of all
listed languages, with references of its own documents; a row without any other row to
be held against is kept if the base rules pass; rows that repeat count each time; an
empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm.common import words_of, write_table

# Frequent words of each language.
COMMON = {
    "de": "auf aus das dem den der des die ein eine einen für ist mit nicht sich und von zu zum".split(),
    "en": "a and are as at be by for from he in is it of on that the this to was with".split(),
    "es": "con de del el en es la las los no para por que se su un una y".split(),
    "fr": "au dans de des du elle en est et la le les par pas pour que qui sur un une".split(),
}
#: Classes counted by pattern; white space, other characters beyond ASCII (by their extra bytes) and the rest follow.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": r"[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]"}
SYMBOLS = "[#*$%&|<>]"
#: Words that the base rules ask for, words that a distance asks for, and other documents that a language's reference asks for.
MIN_WORDS, GUARD_WORDS, LEAST_DOCUMENTS = 20, 30, 20
REPEAT_WINDOW = 8
SALTS = 64
#: A limit is its base plus its slack / sqrt(words).
CHAR_LIMIT, CHAR_SLACK, WORD_LIMIT, WORD_SLACK = 0.16, 1.1, 0.2, 1.2


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _count(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern)) - 1).cast("bigint")


def repeat_words(words: Column, n: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words under windows of `width` words that stand twice or more in the text."""
    def covered(p: Column) -> Column:
        twice = F.filter(p, lambda s, i: F.coalesce(F.get(p, i - 1).h == s.h, F.lit(False)) | F.coalesce(F.get(p, i + 1).h == s.h, F.lit(False)))
        return _let(F.array_sort(F.transform(twice, lambda s: s.at)), lambda q: F.aggregate(
            F.transform(q, lambda x, i: F.when(i == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(q, i - 1)))), F.lit(0), lambda a, b: a + b,
        ))

    hashes = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))
    some = _let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), covered),
    ).otherwise(F.lit(0)))
    return F.when(n >= width, some).otherwise(F.lit(0)).cast("bigint")


def _common_counts(words: Column, lang: Column) -> Column:
    every = sorted({w for ws in COMMON.values() for w in ws})
    listed = F.lit(None)
    spelled = lambda ws: [*ws, *[w.capitalize() for w in ws]]
    found = F.filter(words, lambda w: w.isin(spelled(every)))
    as_array = lambda ws: F.array(*[F.array(F.lit(w), F.lit(w.capitalize())) for w in ws])
    listed = as_array(every)
    for name, ws in COMMON.items():
        listed = F.when(lang == name, as_array(ws)).otherwise(listed)
    return _let(found, lambda f: F.transform(listed, lambda w: (2 * F.size(f) - F.size(F.array_remove(f, F.get(w, 0))) - F.size(F.array_remove(f, F.get(w, 1)))).cast("bigint")))


def counted(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common): all counts of a text."""
    base = docs.select(F.col(id).alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = base.withColumn("words", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda l: F.translate(l, " \t\x0b\x0c\r", "") != "")
    sized = split.select(
        "id", "lang", "t", "words", F.size("words").alias("n"), F.length("t").cast("bigint").alias("chars"), F.octet_length("t").cast("bigint").alias("bytes"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), _let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
        *[_count(F.col("t"), p).alias(c) for c, p in CLASSES.items()],
    )
    named = [F.col(c) for c in CLASSES]
    space, wide = F.col("chars") - F.col("word_chars"), F.least(F.col("bytes") - F.col("chars"), F.col("chars"))
    rest = F.greatest(F.col("chars") - space - wide - sum(named[1:], named[0]), F.lit(0))
    out = sized.select(
        "id", "lang", F.col("n").cast("bigint").alias("n_words"), "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines",
        repeat_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
        F.array(*named, space, wide, rest).alias("classes"), _common_counts(F.col("words"), F.col("lang")).alias("found"),
    )
    others = F.col("n_words") - F.aggregate("found", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return out.withColumn("common", F.concat("found", F.array(others))).drop("found")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms; 0 if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(s: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: _let(F.struct((x / s.p).alias("x"), (y / s.q).alias("y"), ((x / s.p + y / s.q) / 2).alias("m")), lambda v: (term(v.x, v.m) + term(v.y, v.m)) / 2))
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)))

    return _let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda s: F.when((s.p > 0) & (s.q > 0), of(s)).otherwise(F.lit(0.0)))


def references(counts: DataFrame) -> DataFrame:
    """(lang, documents, ref_classes, all_classes, ref_common): elementwise sums over all documents of a language, and of all; one small row each."""
    summed = lambda c: counts.select("lang", F.posexplode(c)).groupBy("lang", "pos").agg(F.sum("col").alias("n"), F.count(F.lit(1)).alias("documents"))
    listed = lambda c, name: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("n")))), lambda s: s.n).alias(name)
    classes = summed("classes").withColumn("every", F.sum("n").over(Window.partitionBy("pos")))
    classes = classes.groupBy("lang").agg(F.max("documents").alias("documents"), listed("n", "ref_classes"), listed("every", "all_classes"))
    return classes.join(summed("common").groupBy("lang").agg(listed("n", "ref_common")), "lang")


def without(whole: Column, own: Column) -> Column:
    return F.zip_with(whole, own, lambda x, y: x - y)


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", guard_words: int = GUARD_WORDS, least_documents: int = LEAST_DOCUMENTS, char_limit: float = CHAR_LIMIT, char_slack: float = CHAR_SLACK, word_limit: float = WORD_LIMIT, word_slack: float = WORD_SLACK) -> DataFrame:
    """(id, base counts, base_failed, char_distance, word_distance, kept) for every row."""
    counts = write_table(counted(docs, id, text, lang), "counts")
    # A language may hold most rows: its one reference row is copied to SALTS keys.
    refs = references(counts).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    thin = F.col("documents") <= least_documents  # its own is among them
    far = salted.join(refs, ["lang", "_salt"]).select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        distance(F.col("classes"), without(F.when(thin, F.col("all_classes")).otherwise(F.col("ref_classes")), F.col("classes"))).alias("char_distance"),
        F.when(thin, F.lit(0.0)).otherwise(distance(F.col("common"), without(F.col("ref_common"), F.col("common")))).alias("word_distance"),
    )
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    near = (F.col("char_distance") <= char_limit + F.lit(char_slack) / root) & (F.col("word_distance") <= word_limit + F.lit(word_slack) / root)
    return far.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") < guard_words) | near)).withColumnRenamed("id", id)
