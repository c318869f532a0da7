"""Line-first cleaning and document rules, in DataFrame expressions only.

Each line of a text is judged by itself. A line with a word fails as

* punctuation: more than a tenth of its characters are symbols of ``#*$%&|<>``, or it shouts: it has two
  "!!" or more, or at least 20 cased letters and none of them small;
* navigation: it has two " | " separators or more, ends in "|", or is a trail of " > " or " » " steps;
* boilerplate: it holds one of the fixed phrases of cookie, script and subscription notices.

"!!", navigation and boilerplate are signs, looked for in every line whatever its length: a pair of "!!", of separators or of
steps, a last "|", and a phrase are one sign each, and a line fails that has one for each ``SIGN_LENGTH`` (200) characters or
part of them. So one sign is enough in a menu or notice, an article on one long line may mention one, and a
long line of notices fails.

Lines that fail are removed. A document is rejected if more than half of its word characters go with
them, or by the base rule: fewer than 50 words, or more than half of its words in repeated three-word
windows. Lines without a word are neither judged nor counted, and stay where they are.

Null text counts as a text without words (base rule: rejected). Line and word counts are exact for texts
of any length: nothing is cut, and all work grows with n log n of the words of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
MOST_REMOVED = 0.5  # of the word characters

# Phrases that mark a line as boilerplate.
BOILERPLATE = [
    "accept all cookies",
    "all cookies",
    "cookie policy",
    "cookie settings",
    "enable javascript",
    "javascript is disabled",
    "javascript must be enabled",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
]

SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "[^#*$%&|<>]+"
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

# Characters that one sign of navigation or boilerplate speaks for.
SIGN_LENGTH = 200
PHRASE = "|".join(sorted(BOILERPLATE))

# Bits for the place of a word in a sort key; longer texts are sorted by structs.
PLACE_BITS = 24


def _length_left(text: Column, removed: str) -> Column:
    return F.char_length(F.regexp_replace(text, removed, ""))


def _pairs(line: Column, mark: str) -> Column:
    return F.floor(F.regexp_count(line, F.lit(mark)) / 2)


def line_fails(line: Column) -> Column:
    """Whether a line is removed (null for none). Signs of navigation and boilerplate are weighed against its length."""
    letters = F.char_length(F.regexp_replace(line, "[^A-Za-z]+", ""))
    capitals = ~line.rlike("[a-z]") & (letters >= 20)
    symbols = _length_left(line, SYMBOLS) * 10 > F.char_length(line)
    small = F.lower(line)
    phrase = F.lit(False)
    for words in BOILERPLATE:
        phrase = phrase | F.contains(small, F.lit(words))
    # Most lines have no sign, which is seen without counting.
    cries = F.when(F.contains(line, F.lit("!!")), _pairs(line, "!!")).otherwise(0)
    bars = F.when(
        F.contains(line, F.lit("|")),
        _pairs(line, " \\| ") + line.rlike("\\|[\\x20\\x09-\\x0D]*\\z").cast("int"),
    ).otherwise(0)
    trail = F.when(F.contains(line, F.lit(">")) | F.contains(line, F.lit("»")), _pairs(line, " [>»] ")).otherwise(0)
    boilerplate = F.when(phrase, F.regexp_count(small, F.lit(PHRASE))).otherwise(0)
    signs = cries + bars + trail + boilerplate
    return symbols | capitals | ((signs > 0) & (signs * SIGN_LENGTH >= F.char_length(line)))


def _window(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _beside_equal(items: Column, key) -> Column:
    """The items of a sorted array whose neighbour before or after has an equal key."""
    return F.filter(items, lambda e, i: (key(e) == key(F.get(items, i - 1))) | (key(e) == key(F.get(items, i + 1))))


def judge(docs: DataFrame) -> DataFrame:
    """Two structs a row: ``row``, the columns of ``docs``, and ``quality`` with ``n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, kept_chars, clean_text, base_failed, kept``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    all_lines = F.split(text, "\n")
    trimmed = F.btrim(text, F.lit(SPACE_CHARACTERS))
    # Steps, so that each array is computed once.
    step = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)).alias("words"),
        all_lines.alias("all_lines"),
        (F.char_length(text) - _length_left(text, WORD)).alias("word_chars"),
        _length_left(text, SYMBOLS).alias("n_symbols"),
    )
    words = F.col("words")
    step = step.withColumn(
        "windows", F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    )
    # No rule fails a line without a word.
    step = step.withColumn("lines", F.filter("all_lines", lambda line: line.rlike(WORD)))
    step = step.withColumn("good_lines", F.filter("all_lines", lambda line: ~line_fails(line)))
    # Three-word windows that may be repeated: the high bits of the hash with the place in the low bits sort
    # as plain numbers, and equal high bits come to stand side by side.
    low = (1 << PLACE_BITS) - 1
    packed = F.sort_array(F.transform("windows", lambda i: _window(words, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))
    step = step.withColumn("packed", F.when(F.size(words) <= low, packed))
    candidates = F.transform(
        _beside_equal(F.col("packed"), lambda e: F.shiftright(e, PLACE_BITS)), lambda e: e.bitwiseAND(F.lit(low)).cast("int")
    )
    # Those that are, by the whole hash.
    step = step.withColumn("candidates", F.coalesce(candidates, "windows"))
    step = step.withColumn(
        "keyed", F.array_sort(F.transform("candidates", lambda i: F.struct(_window(words, i).alias("h"), i.alias("i"))))
    )
    step = step.withColumn("places", F.sort_array(F.transform(_beside_equal(F.col("keyed"), lambda e: e["h"]), lambda e: e["i"])))
    # Each covers three words, less where the next is nearer.
    covered = F.aggregate(
        F.col("places"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda state, i: F.struct((state["n"] + F.least(F.lit(3), i - state["last"])).alias("n"), i.alias("last")),
        lambda state: state["n"],
    )
    clean = F.array_join("good_lines", "\n")
    step = step.select(
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        clean.alias("clean_text"),
    ).withColumn("kept_chars", (F.char_length("clean_text") - _length_left(F.col("clean_text"), WORD)).cast("bigint"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    lost = F.col("word_chars") - F.col("kept_chars") > F.col("word_chars") * MOST_REMOVED
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "clean_text"]
    judged = F.struct(*names, failed.alias("base_failed"), (~failed & ~lost).alias("kept"))
    # As the output of a generator the verdict is computed once: a filter on it would otherwise be pushed below
    # all steps, with their expressions repeated in it.
    return step.select("row", F.explode(F.array(judged)).alias("quality"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, their text without the lines that failed; other columns are kept."""
    row = F.col("row").withField("text", F.col("quality.clean_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("quality.clean_text").cast(docs.schema["n_chars"].dataType))
    return judge(docs).where("quality.kept").select(row.alias("row")).select("row.*")
