"""Quality rules, line first: lines are judged and removed, then documents that lose too much text. DataFrame functions only.

Each line with a word meets punctuation, navigation and boilerplate rules (`line_fails`). A failing line goes, and so does a line that
repeats an earlier one. A document stays unless the base rules fail (too short; too many words in repeated windows) or
its failing and repeated lines hold more than `most_lost` of its words.

Everything about a document is computed within its own row, so there is no shuffle and no group that could be hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, let

SYMBOLS = r"[#*$%&|<>]"
#: Fixed phrases of legal and technical notices, by language, looked for without case in lines of at most 30 words.
NOTICES = {
    "en": ["lorem ipsum", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "uses cookies", "enable javascript", "copyright ©", "(c) 19", "(c) 20"],
    "de": ["alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies"],
    "fr": ["tous droits réservés", "mentions légales", "politique de confidentialité", "utilise des cookies"],
    "es": ["todos los derechos reservados", "aviso legal", "política de privacidad", "utiliza cookies"],
}
#: Fixed phrases that ask the reader to do something on the page, by language: without case, at the beginning of a line of at most 6 words.
ACTIONS = {
    "en": ["click here", "read more", "sign up", "log in to", "login to", "subscribe to our"],
    "de": ["hier klicken", "weiterlesen", "jetzt anmelden", "newsletter abonnieren"],
    "fr": ["cliquez ici", "lire la suite", "abonnez-vous"],
    "es": ["haga clic aquí", "leer más", "suscríbase"],
}
#: Separators of menus and breadcrumbs.
NAVIGATION = r"\||»|›|→|·|•"
MARKS = r"[#*$%&|<>{}~^=\\]|!"
ADDRESS = r"https?://|www\."
PUNCTUATION = r"\p{P}"


def begins_with(low: Column, by_language: dict[str, list[str]]) -> Column:
    """Whether a lower-case line begins with one of the phrases, marks and white space aside."""
    bare = F.regexp_replace(low, r"^[\P{L}]+", "")
    return let(bare, lambda own: reduce(lambda a, b: a | b, [F.startswith(own, F.lit(p)) for words in by_language.values() for p in words], F.lit(False)))


def has_phrase(low: Column, by_language: dict[str, list[str]]) -> Column:
    """Whether a lower-case line has one of the phrases."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for words in by_language.values() for p in words], F.lit(False))


def line_fails(line: Column, notices: dict[str, list[str]] | None = None, actions: dict[str, list[str]] | None = None) -> Column:
    """Whether a line (with at least one word) breaks a rule.

    Punctuation: symbols, or exclamation marks, for a fifth of the words or more; nearly all letters capital in five words or more; 20 words
    or more without any punctuation mark of any script. Navigation: menu separators for a fifth of the words or more, or addresses for a third. Boilerplate: a
    phrase of a notice in a line of at most 30 words, or a line of at most 6 that begins by asking for an action. Repetition: ten words or more of
    which under a quarter are different."""
    notices, actions = NOTICES if notices is None else notices, ACTIONS if actions is None else actions

    def rules(n: Column, low: Column) -> Column:
        count = lambda pattern: F.regexp_count(line, F.lit(pattern))
        different = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({WORD})"))))
        return (
            (5 * count(MARKS) >= n)
            | (5 * count(NAVIGATION) >= n)
            | ((n >= 5) & (count(r"\p{Lu}{2}") > 4 * count(r"\p{Ll}{2}")))
            | ((n >= 20) & ~line.rlike(PUNCTUATION))
            | (line.contains("http") | line.contains("www.")) & (3 * count(ADDRESS) >= n)
            | ((n <= 30) & has_phrase(low, notices))
            | ((n <= 6) & begins_with(low, actions))
            | ((n >= 10) & (4 * different < n))
        )

    return let(F.regexp_count(line, F.lit(WORD)), lambda n: let(F.lower(line), lambda low: rules(n, low)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines_that_stay(text: Column) -> Column:
    """The lines with a word that break no rule and equal no earlier line, in order."""
    lines = F.array_distinct(F.filter(lines_of(text), lambda l: l.rlike(WORD)))
    return F.filter(lines, lambda l: ~line_fails(l))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(lines_of(text), lambda l: l.rlike(WORD)), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def n_repeat_words(words: Column, window: int = 8) -> Column:
    """Words covered by windows of so many words that the text has twice or more, the first occurrence included.

    Windows are told apart by a 64-bit hash of their words' 64-bit hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def covered(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - window + 1)
        marks = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(window)]))

        def count(m: Column) -> Column:
            by_mark = F.array_sort(F.transform(m, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

            def places(s: Column) -> Column:
                same = lambda x, i: F.when(i >= 0, F.coalesce(F.get(s, i)["x"] == x["x"], F.lit(False))).otherwise(False)
                repeated = F.filter(F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda i: i.isNotNull())
                ordered = F.array_sort(repeated)
                start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
                return F.aggregate(ordered, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

            return F.when(F.size(F.array_distinct(m)) == F.size(m), 0).otherwise(let(by_mark, places))

        return F.when(F.size(h) <= window, 0).otherwise(let(marks, count))

    return let(hashes, covered).cast("long")


def judged(docs: DataFrame, most_lost: float = 0.4, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost.

    A null or empty text has no words and fails the base rules. n_lost: words in lines that are removed. Repeated rows and null ids are judged
    each; other columns are not looked at. An empty table gives an empty one."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})")))
    long = lambda c: c.cast("long")
    counts = base.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
        long(F.size("words") - F.aggregate(lines_that_stay(F.col("text")), F.lit(0), lambda a, l: a + F.regexp_count(l, F.lit(WORD)))).alias("n_lost"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    return counts.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost") <= most_lost * F.col("n_words")))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """docs' rows and columns: the documents that are kept, without the lines that fail or repeat.

    A text that loses no words is left as it is; from others blank lines go too. n_chars, where docs has it, follows the text. Other
    columns stay as they are, whatever their names. Repeated rows stay repeated."""
    packed = docs.select(F.struct("*").alias("doc_id"), "text")
    rows = judged(packed, **options).where("kept").select(F.col("doc_id").alias("row"), "n_lost")
    text = F.when(F.col("n_lost") > 0, F.array_join(lines_that_stay(F.col("row.text")), "\n")).otherwise(F.col("row.text"))
    rows = rows.select("row", text.alias("new"))
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    for i, c in enumerate(docs.columns):
        if c == "text":
            columns[i] = F.col("new").alias("text")
        elif c == "n_chars":
            columns[i] = F.when(F.col("new") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("new").cast(dict(docs.dtypes)[c])).alias(c)
    return rows.select(*columns)
