"""Line-first cleaning: lines that fail a rule go, then documents that lost too much text go.

Only DataFrame functions are used. Everything about a text is found within its own row, so nothing is shuffled."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Document rules (fixed values of the contract).
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30
SYMBOLS = r"[^#*$%&|<>]+"

#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "terms of use", "privacy policy", "cookies", "javascript", "lorem ipsum",
    "click here", "subscribe to our", "powered by",
)
SEPARATORS = "|»•·"


@dataclass(frozen=True)
class Rules:
    #: Punctuation: shares of a line's words.
    max_symbols: float = 0.3  # symbols #*$%&<> a word
    max_shouts: float = 0.3  # ! a word
    min_open_words: int = 3  # a line with no end mark and fewer words fails, if it isn't the only one
    #: Navigation: separators a word, from two separators on.
    max_separators: float = 0.2
    #: Words that equal the word before them, as a share, in lines of ten words or more.
    max_stutter: float = 0.3
    #: Boilerplate: phrases make up at least this share of a line's characters, or stand in a line of so few words.
    min_phrases: float = 0.15
    short_line: int = 8
    #: A document goes that keeps less than this share of its word characters.
    min_kept: float = 0.6


def _count(text: Column, other: str) -> Column:
    """Characters left when runs of others are taken out."""
    return F.char_length(F.regexp_replace(text, other, ""))


def _repeated_words(w: Column) -> Column:
    """Words in WINDOW-word windows that are found twice or more in the text, by 64-bit window hashes.

    Window hashes are folded from pairs of halves: 1, 2, 4, 8 words. Only texts in which a hash of four words
    comes twice go on to eight, and only those with a window twice are looked at place by place."""

    def covered(flagged: Column) -> Column:  # starts of such windows, ascending: each covers up to the next one
        steps = F.transform(flagged, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(flagged, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def starts(s: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))

    def places(h: Column) -> Column:
        several = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(starts(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(several)

    def paired(h: Column, k: int) -> Column:
        return F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))

    def eight(h4: Column) -> Column:
        return F.when(F.size(F.array_distinct(h4)) == F.size(h4), F.lit(0)).otherwise(let(paired(h4, 4), places))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, lambda h: let(paired(h, 1), lambda h2: let(paired(h2, 2), eight))))


def _gates(text: Column) -> Column:
    """Cheap tests of what a rule needs somewhere in the text to fail any line: they spare most lines the costly rules and change no verdict."""
    low = F.lower(text)
    some = lambda t, xs: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in xs])
    return let(_count(text, SYMBOLS), lambda n: F.struct(n.alias("n_symbols"), (n > 0).alias("symbols"), ((n > 0) | some(text, SEPARATORS[1:])).alias("separators"), some(low, BOILERPLATE).alias("boilerplate")))


def _stutter(w: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: a == b), lambda same: same))


def _fails(line: Column, w: Column, alone: Column, gate: Column, r: Rules) -> Column:
    """Whether a line of words w breaks a rule."""
    n = F.size(w)
    phrases = "|".join(BOILERPLATE)

    def boilerplate(low: Column) -> Column:
        found = F.char_length(low) - F.char_length(F.regexp_replace(low, phrases, ""))
        return (found > 0) & ((n <= r.short_line) | (found >= F.char_length(low) * r.min_phrases))

    return (
        (gate["symbols"] & (_count(line, r"[^#*$%&<>]+") > n * r.max_symbols))
        | (F.contains(line, F.lit("!")) & (_count(line, "[^!]+") > F.greatest(F.lit(1.0), n * r.max_shouts)))
        | (~alone & (n < r.min_open_words) & ~line.rlike(r"[.!?:;,…。！？\"'”’)\]][\x20\x09-\x0D]*\z"))
        | (gate["separators"] & let(_count(line, f"[^{SEPARATORS}]+"), lambda k: (k >= 2) & (k >= n * r.max_separators)))
        | ((n >= 10) & (_stutter(w) >= n * r.max_stutter))
        | (gate["boilerplate"] & let(F.lower(line), boilerplate))
    )


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_dropped", "kept_chars", "clean_text", "kept")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines_dropped,
    kept_chars, clean_text and kept.

    Lines are judged first: one goes that breaks a rule of punctuation, navigation or boilerplate or equals an
    earlier line with words; lines without words go too. Then a document is rejected (kept is false) if it fails the
    base rules or keeps less than rules.min_kept of its word characters. A null text counts as empty, has no words
    and is rejected, with a null clean_text. Each row is judged alone, whatever its other columns hold; columns of these
    names are replaced. Long texts cost memory in proportion to one text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in docs.columns if c not in (*OUT, "_r")]
    chars = lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x))
    total = lambda rows, c: F.aggregate(rows, F.lit(0), lambda a, x: a + x[c])
    single = ~text.rlike("[\\x09\\x0B-\\x0D]|\\x20\\x20")  # single spaces alone separate words: a split without a pattern does
    spaced = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))
    parsed = lambda x, one: let(F.when(one, let(F.btrim(x), spaced)).otherwise(words(x)), lambda w: F.struct(x.alias("line"), w.alias("w"), chars(w).alias("chars")))

    def judged(full: Column, gate: Column) -> Column:
        lines = F.array_distinct(F.transform(full, lambda x: x["line"]))

        def result(first: Column) -> Column:
            alone = F.size(full) == 1
            good = F.filter(first, lambda x: ~_fails(x["line"], x["w"], alone, gate, rules))
            every = F.flatten(F.transform(full, lambda x: x["w"]))
            return let(good, lambda g: F.struct(
                total(F.transform(full, lambda x: F.struct(F.size(x["w"]).alias("n"))), "n").cast("long").alias("n_words"), total(full, "chars").cast("long").alias("word_chars"), (F.size(full) - F.size(first)).cast("long").alias("n_dup_lines"),
                let(every, _repeated_words).cast("long").alias("n_repeat_words"), (F.size(full) - F.size(g)).cast("long").alias("lines_dropped"), total(g, "chars").cast("long").alias("kept_chars"),
                F.transform(g, lambda x: x["line"]).alias("good"), gate["n_symbols"].alias("n_symbols"),
            ))

        return let(lines, lambda ls: let(F.when(F.size(ls) == F.size(full), full).otherwise(F.transform(ls, lambda x: parsed(x, F.lit(False)))), result))

    lines = let(single, lambda one: F.filter(F.transform(F.split(text, "\n"), lambda x: parsed(x, one)), lambda x: F.size(x["w"]) > 0))
    found = let(F.struct(lines.alias("full"), _gates(text).alias("gate")), lambda p: judged(p["full"], p["gate"]))
    # one generated row, which no filter on the verdict is pushed through: else each text would be judged again for the filter
    df = docs.select(*own, F.explode(F.array(found)).alias("_r"))
    r = F.col("_r")
    n, repeat = r["n_words"], r["n_repeat_words"]
    base = (n < MIN_WORDS) | (repeat * 100 > n * MAX_REPEATED_PERCENT)
    kept = ~base & (r["kept_chars"] >= r["word_chars"] * rules.min_kept)
    return df.select(
        *own, n.alias("n_words"), r["word_chars"].alias("word_chars"), r["n_symbols"].cast("long").alias("n_symbols"), r["n_dup_lines"].alias("n_dup_lines"), repeat.alias("n_repeat_words"),
        base.alias("base_failed"), r["lines_dropped"].alias("lines_dropped"), r["kept_chars"].alias("kept_chars"),
        F.when(F.col("text").isNotNull(), F.array_join(r["good"], "\n")).alias("clean_text"), kept.alias("kept"),
    )
