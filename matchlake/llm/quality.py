"""Quality rules by distribution divergence, in DataFrame operations only.

Each text gives a histogram of character classes and one of its language's common words. The references are the same
histograms summed over all texts of a language. A text is rejected when the Jensen-Shannon distance to its reference is
too large and the text is long enough for the distance to mean something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import SPACE, words_of, written

# Common words by language; a text of another language, or none, is compared with all languages' texts.
COMMON_WORDS = {
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine", "er"],
    "en": ["the", "of", "and", "in", "is", "to", "was", "for", "with", "by", "that", "this", "on", "are", "from", "it"],
    "es": ["de", "la", "el", "los", "del", "las", "un", "por", "con", "una", "su", "para", "que", "no", "se", "lo"],
    "fr": ["de", "la", "le", "les", "des", "et", "est", "un", "une", "en", "dans", "par", "sur", "que", "pas", "du"],
}
EVERY = sorted({w for words in COMMON_WORDS.values() for w in words})
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: What may stand around a common word, and letters that count as small ones.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _repeat_words(hashes: str) -> Column:
    """Words covered by windows whose hash occurs twice or more; `ordered` has (hash, place) sorted."""
    return F.expr(f"""
        aggregate(transform({hashes}, (p, i) -> least({WINDOW}, coalesce(get({hashes}, i + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)""")


def features(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, group (a language with a reference, else 'other'), base counts, the two histograms and the common words of every whole text."""
    base = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                     F.when(F.col(lang).isin(list(COMMON_WORDS)), F.col(lang)).otherwise("other").alias("group"))
    step = base.select("doc_id", "group", F.length("text").alias("n_chars"), words_of(F.col("text")).alias("words"),
                       F.when(F.instr("text", "\n") > 0, F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).alias("lines"),
                       F.regexp_replace("text", "[a-z]+", "").alias("no_lower"))
    step = step.select("doc_id", "group", "n_chars", "words", "no_lower",
                       F.coalesce((F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), F.lit(0)).alias("n_dup_lines"),
                       F.regexp_replace("no_lower", SPACE, "").alias("no_space"),
                       F.filter(F.transform("words", lambda w: F.btrim(F.translate(w, UPPER, LOWER), F.lit(MARKS))), lambda w: w.isin(EVERY)).alias("listed"),
                       F.expr(f"CASE WHEN size(words) >= {WINDOW + 1} THEN transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) END").alias("hashes"))
    step = step.select("*", F.regexp_replace("no_space", "[A-Z]+", "").alias("no_letters"),
                       F.expr("CASE WHEN size(hashes) > size(array_distinct(hashes)) THEN array_sort(transform(hashes, (h, i) -> struct(h, i))) END").alias("ordered"))
    step = step.select("*", F.regexp_replace("no_letters", "[0-9]+", "").alias("no_digits"),
                       F.expr("array_sort(transform(filter(ordered, (s, i) -> get(ordered, i - 1).h = s.h OR get(ordered, i + 1).h = s.h), s -> s.i))").alias("twice"))
    rest = F.regexp_replace("no_digits", r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", "")
    step = step.select("*", rest.alias("no_ascii"), F.length(F.regexp_replace("no_digits", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))

    def cut(longer: str, shorter: str) -> Column:
        return (F.length(longer) - F.length(shorter)).cast("long")

    spaces = cut("no_lower", "no_space")
    listed = F.create_map(*[x for g, words in COMMON_WORDS.items() for x in (F.lit(g), F.array(*map(F.lit, words)))])
    wanted = F.coalesce(listed[F.col("group")], F.array(*map(F.lit, EVERY)))
    step = step.withColumn("wanted", wanted)
    counts = F.transform("wanted", lambda r: F.size(F.filter("listed", lambda w: w == r)).cast("long"))
    return step.select(
        "doc_id", "group", F.size("words").cast("long").alias("n_words"), (F.col("n_chars") - spaces).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        F.coalesce(_repeat_words("twice"), F.lit(0)).alias("n_repeat_words"),
        F.array((F.col("n_chars") - F.length("no_lower")).cast("long"), spaces, cut("no_space", "no_letters"), cut("no_letters", "no_digits"),
                F.col("n_symbols"), cut("no_digits", "no_ascii") - F.col("n_symbols"), F.length("no_ascii").cast("long")).alias("chars"),
        F.array_append(counts, (F.size("words") - F.size("listed")).cast("long")).alias("common"), "listed")


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of equal length; null if either is empty."""
    return F.expr(f"""
        CASE WHEN aggregate({p}, 0D, (a, x) -> a + x) > 0 AND aggregate({q}, 0D, (a, x) -> a + x) > 0 THEN
        sqrt(greatest(0D, aggregate(zip_with(
            transform({p}, x -> x / aggregate({p}, 0D, (a, y) -> a + y)), transform({q}, x -> x / aggregate({q}, 0D, (a, y) -> a + y)),
            (x, y) -> (CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0D END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0D END) / 2),
            0D, (a, x) -> a + x))) END""")


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = 50,
                  max_char_distance: float = 0.28, max_word_distance: float = 0.60) -> DataFrame:
    """Base counts, both distances and the verdict for every row.

    - null, empty or blank text: no words, base_failed, not kept. Unknown or null lang: compared with the texts of all languages.
    - texts of fewer than min_words words: no verdict by distance; base_failed alone decides.
    - repeated rows each get the same result; an empty table gives an empty result; other columns are ignored.
    """
    counted = written(features(df, key, text, lang), "quality-features")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # One reference by language, five at most, and one of all texts; each sums every text that passes the base rules.
    clean = counted.where(~base_failed)
    summed = (clean.where("group <> 'other'").select("group", F.posexplode(F.concat("chars", "common")).alias("at", "n"))
              .groupBy("group", "at").agg(F.sum("n").alias("n")))
    classes = 7
    named = (summed.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("all"))
             .select("group", F.expr(f"transform(slice(all, 1, {classes}), x -> x.n)").alias("ref_chars"),
                     F.expr(f"transform(slice(all, {classes + 1}, size(all)), x -> x.n)").alias("ref_common")))
    words = clean.select(F.explode("listed").alias("word")).groupBy("word").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("of"))
    pooled = clean.agg(F.array(*[F.coalesce(F.sum(F.col("chars")[i]), F.lit(0)) for i in range(classes)]).alias("ref_chars"), F.coalesce(F.sum(F.element_at("common", -1)), F.lit(0)).alias("rest"))
    # two single rows
    pooled = pooled.crossJoin(words).select(F.lit("other").alias("group"), "ref_chars", F.array(*[F.coalesce(F.col("of")[w], F.lit(0)) for w in EVERY], "rest").alias("ref_common"))
    reference = named.unionByName(pooled)
    judged = (counted.join(F.broadcast(reference), "group", "left")
              .withColumn("char_distance", _distance("chars", "ref_chars")).withColumn("word_distance", _distance("common", "ref_common")))
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                         (~base_failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance")
