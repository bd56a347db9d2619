"""Line-first quality rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, TOKEN, bind, indices, lower_ascii, set_apart

#: A line made of nothing but these, and marks between them, is navigation (compared in lower case).
NAVIGATION = (
    *("home", "menu", "login", "log in", "sign in", "sign up", "subscribe", "share this", "click here", "read more", "next page", "previous page", "back to top", "skip to content"),
    *("startseite", "anmelden", "registrieren", "weiterlesen", "nach oben", "accueil", "connexion", "lire la suite", "haut de page", "inicio", "iniciar sesión", "leer más", "volver arriba"),
)
#: A line of at most short_words words that holds one of these is boilerplate.
BOILERPLATE = (
    *("all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "javascript is disabled", "enable javascript", "lorem ipsum"),
    *("alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés", "politique de confidentialité", "todos los derechos reservados", "política de privacidad"),
)
#: Marks that prose has few words with, marks between the links of a menu, and the end of a sentence.
SYMBOL = r"[#*$%&|<>~^\\={}@_+]"
LINKING = "|»›·•→"
LETTER = r"[A-Za-z0-9]|[^\x00-\x7F]"
SENTENCE_END = r"""[.!?…。！？;:]['")\]»”’]*$"""


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    #: Percent of words in repeated 3-word windows beyond which a document fails.
    most_repeated: int = 50
    #: Lines of fewer words aren't judged by shares.
    judged_words: int = 3
    #: Percent of a line's words that hold a symbol, from which on it fails.
    symbol_words: int = 30
    #: A line fails with two link marks or more, if they are so many percent of its words.
    link_marks: int = 20
    #: Percent of a line's ASCII letters that are capitals, beyond which it fails (from shouted_words words on).
    most_capitals: int = 60
    shouted_words: int = 5
    #: Lines of judged_words to short_paragraph words must end as a sentence does; a longer one is prose even where it breaks off.
    short_paragraph: int = 50
    short_words: int = 8
    #: Percent of a document's words in failed lines beyond which it is rejected.
    most_lost: int = 60


def navigation_pattern() -> str:
    links = "|".join(NAVIGATION)
    return rf"^\W*({links})(\W+({links}))*\W*$"


def line_fails(line: Column, n: Column, rules: Rules) -> Column:
    """Whether a line of n > 0 words is navigation, boilerplate, shouted, full of symbols, without a letter or digit, or a fragment."""
    trimmed = F.btrim(line, F.lit(SPACE))
    count = lambda marks: F.regexp_count(line, F.lit(f"[{marks}]"))
    symbols = (n >= rules.judged_words) & (F.regexp_count(line, F.lit(SYMBOL + TOKEN[:-1] + "*")) * 100 >= n * rules.symbol_words)
    menu = bind(count(LINKING), lambda links: (links >= 2) & (links * 100 >= n * rules.link_marks))
    shouted = (n >= rules.shouted_words) & bind(count("A-Z"), lambda c: (c >= rules.shouted_words) & (c * 100 > (c + count("a-z")) * rules.most_capitals))
    fragment = n.between(rules.judged_words, rules.short_paragraph) & ~F.rlike(trimmed, F.lit(SENTENCE_END))
    phrases = (n <= rules.short_words) & F.rlike(lower_ascii(line), F.lit(navigation_pattern() + "|" + "|".join(BOILERPLATE)))
    return phrases | fragment | menu | shouted | symbols | ~F.rlike(line, F.lit(LETTER))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that a text holds twice or more."""

    def count(grams: Column) -> Column:
        # Windows sorted by hash bring equal ones together; each that equals a neighbour is repeated.
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = bind(
            placed,
            lambda s: F.filter(
                F.transform(
                    indices(F.size(s)),
                    lambda k: F.when((F.get(s, k - 1)["g"] == s[k]["g"]) | (F.get(s, k + 1)["g"] == s[k]["g"]), s[k]["i"]),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    def grams(w: Column) -> Column:
        return F.transform(indices(F.size(w) - 2), lambda i: F.xxhash64(w[i], F.lit(" "), w[i + 1], F.lit(" "), w[i + 2]))

    return bind(grams(words), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(count(g))).cast("long")


def judge_quality(docs: DataFrame, rules: Rules = Rules(), into: str = "_q") -> DataFrame:
    """All columns of docs (text) with a struct `into`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words (words in lines that go),
    clean_text (the lines that stay, joined by \\n) and kept.

    Lines come first: each is judged alone by line_fails(), and one that equals an earlier line of its text goes too, as do blank ones. A document that fails
    the base rules, or loses more than most_lost percent of its words with its lines, isn't kept.

    Everything is computed within a row: no shuffle, and no rows of an empty table. A null or empty text has no words, so it fails, and its clean_text is
    empty; equal rows get equal results. An input column of the name `into` is replaced, and no other name matters.
    """
    rows, _, given, back = set_apart(docs, into)
    cut = rows.select("*", F.coalesce(given, F.lit("")).alias("text")).select(
        *rows.columns,
        F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("symbols"),
        (F.char_length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).alias("solid"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")).alias("wordy"),
        F.split("text", "\n", -1).alias("lines"),
        F.regexp_extract_all("text", F.lit(TOKEN), 0).alias("words"),
    )
    counted = F.filter(
        F.transform(F.array_distinct("lines"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(TOKEN)).alias("n"))),
        lambda x: x["n"] > 0,
    )
    judged = cut.select(
        *rows.columns,
        F.size("words").cast("long").alias("n_words"),
        "wordy",
        F.col("solid").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        counted.alias("distinct"),
    ).select("*", F.filter("distinct", lambda x: ~line_fails(x["line"], x["n"], rules)).alias("stay"))
    base = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeated)
    lost = F.col("n_words") - F.aggregate("stay", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    verdict = judged.select("*", (F.col("wordy") - F.size("distinct")).cast("long").alias("n_dup_lines"), base.alias("base_failed"), lost.alias("lost_words"))
    q = F.struct(
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words"),
        F.array_join(F.transform("stay", lambda x: x["line"]), "\n").alias("clean_text"),
        (~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * rules.most_lost)).alias("kept"),
    )
    return back(verdict, q)
