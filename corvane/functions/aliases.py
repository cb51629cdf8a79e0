"""Aliases: short forms in brackets, known and transliterated names, and names that are nearly spelt alike."""

import hashlib
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import terms
from corvane.functions.text import QUERY_TOKEN, alias_form, let

#: A long name with a short form in brackets: a fixed pattern.
BRACKETED = r"([A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9\s-]{2,80}?)\s*\(([A-Za-zА-Яа-яЁё0-9-]{2,16})\)"
#: Everything before a short form that its long name may be part of, read in one pass: the pattern above is then tried on this piece alone.
LETTERS = r"A-Za-zА-Яа-яЁё0-9\s-"
BEFORE = rf"(?<![{LETTERS}])[{LETTERS}]{{3,}}+\([A-Za-zА-Яа-яЁё0-9-]{{2,16}}\)"
#: Tokens whose names a task remembers, before it forgets them all.
REMEMBERED = 1 << 18
#: Tokens that are compared with the names at once.
AT_ONCE = 4096
CODES = {**terms.SEED_ALIASES, **terms.TRANSLATED_ALIASES}


def refs(text: Column) -> Column:
    """array<struct<alias, canonical_hint>> of `long name (SHORT)`; the hint is the last 80 characters of the long name."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BEFORE), F.lit(0))
    found = F.filter(pieces, lambda p: p.rlike(BRACKETED))
    hint = lambda x: F.btrim(F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), -80, 80), F.lit(" -"))
    return F.transform(found, lambda p: F.struct(F.regexp_extract(p, BRACKETED, 2).alias("alias"), hint(F.regexp_extract(p, BRACKETED, 1)).alias("canonical_hint")))


def judged(found: Column) -> Column:
    """refs -> array<struct<value, reason_codes, confidence>>: forms of two letters are ambiguous; one with another expansion just before conflicts.

    The forms are sorted, so that equal ones are neighbours, and put in order again."""

    def one(r: Column, last: Column) -> Column:
        conflict = F.coalesce((last["low"] == r["low"]) & (last["means"] != r["means"]), F.lit(False))
        brief = F.length(r["alias"]) <= 2
        codes = F.array_compact(F.array(F.when(brief, "ambiguous_alias"), F.when(conflict, "conflicting_values")))
        confidence = F.when(conflict, 0.56).when(brief, 0.58).otherwise(0.76)
        return F.struct(r["at"].alias("at"), F.concat(r["alias"], F.lit(" -> "), r["hint"]).alias("value"), codes.alias("reason_codes"), confidence.alias("confidence"))

    keyed = lambda r, i: F.struct(F.lower(r["alias"]).alias("low"), i.alias("at"), F.lower(r["canonical_hint"]).alias("means"), r["alias"].alias("alias"), r["canonical_hint"].alias("hint"))
    compared = let(F.array_sort(F.transform(found, keyed)), lambda rows: F.transform(rows, lambda r, i: one(r, F.get(rows, i - 1))))
    return F.transform(F.array_sort(compared), lambda r: F.struct(r["value"].alias("value"), r["reason_codes"].alias("reason_codes"), r["confidence"].alias("confidence")))


def listed(text: Column, names: dict[str, str], confidence: float) -> Column:
    """The names that the text contains, as candidates."""
    row = lambda a, c: F.struct(F.lit(f"{a} -> {c}").alias("value"), F.array(F.lit("schema_candidate")).alias("reason_codes"), F.lit(confidence).alias("confidence"))
    return F.array_compact(let(alias_form(text), lambda low: F.array(*[F.when(F.contains(low, F.lit(a)), row(a, c)) for a, c in names.items()])))


def transliterated(text: Column) -> Column:
    """Cyrillic letters in Latin script."""
    out = F.lower(text)
    for letter, latin in terms.LONG_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return alias_form(F.translate(out, *terms.LETTERS))


def latin(word: str) -> str:
    """`transliterated` of a constant."""
    table = str.maketrans({**terms.LONG_LETTERS, **{c: terms.LETTERS[1][i : i + 1] for i, c in enumerate(terms.LETTERS[0])}})
    return " ".join(word.lower().translate(table).split())


def choices() -> list[str]:
    return list(dict.fromkeys([*CODES, *CODES.values()]))


def tokens_of(text: Column, least: int) -> Column:
    """array<string>: the distinct tokens of at least so many characters, in order: the tokens that are compared with names. They have neither blanks nor other dashes: in lower case they are in `alias_form`."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUERY_TOKEN)), lambda t: F.length(t) >= least)
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.lower(t))))


def matchers(names: list[str]) -> list[tuple[str, SequenceMatcher]]:
    """Each name with a matcher that has read it."""
    return [(name, SequenceMatcher(None, "", name)) for name in names]


def best_match(token: str, tried: list[tuple[str, SequenceMatcher]], least: int = 1) -> tuple[str | None, int]:
    """The first name of the highest similarity, in hundredths of the share of matching characters, from `least` on. Names too long or short for it aren't compared."""
    best, score = None, least - 1
    for name, matcher in tried:
        both = len(token) + len(name)
        if not both or round(2.0 * min(len(token), len(name)) / both * 100) <= score:
            continue
        matcher.set_seq1(token)
        if round(matcher.quick_ratio() * 100) > score and (own := round(matcher.ratio() * 100)) > score:
            best, score = name, own
    return best, score


def in_reach(tokens: list[str], names: list[str], least: int) -> np.ndarray:
    """Whether any name has so many characters in common with a token, in any order, that their ratio may reach `least`: the bound of `quick_ratio`, for many tokens at once."""
    letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(names))))}
    width = len(letters) + 1

    def counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        places = np.array([letters.get(c, 0) for w in words for c in w], dtype=np.int64)
        own = np.bincount(np.repeat(np.arange(len(words)) * width, sizes) + places, minlength=len(words) * width)
        return own.reshape(len(words), width)[:, 1:].clip(0, 255).astype(np.uint8), sizes

    (own, sizes), (known, lengths) = counts(tokens), counts(names)
    reached = np.zeros(len(tokens), dtype=bool)
    for i in range(len(names)):
        common = np.minimum(own, known[i]).sum(axis=1, dtype=np.int64)
        reached |= 200 * common >= (least - 0.5 - 1e-6) * (sizes + lengths[i])
    return reached


def named(tokens: Column, find: Callable[[list[str]], Iterator[dict | None]]) -> Column:
    """tokens -> array<struct<value, confidence>>: what find gives for a text's tokens, in their order, without those that it gives nothing for.

    Distinct tokens are found once, and remembered over batches; of the others, which are most, no object is made for each text."""
    kind = pa.struct([("value", pa.string()), ("confidence", pa.float64())])

    @F.arrow_udf("array<struct<value: string, confidence: double>>")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found: dict[str, dict | None] = {}
        for batch in batches:
            if len(found) > REMEMBERED:
                found = {}
            coded = pc.list_flatten(batch).dictionary_encode()
            every = coded.dictionary.to_pylist()
            new = [t for t in every if t not in found]
            for at in range(0, len(new), AT_ONCE):
                part = new[at : at + AT_ONCE]
                found.update(zip(part, find(part), strict=True))
            codes = coded.indices.to_numpy()
            hit = np.array([found[t] is not None for t in every], dtype=bool)[codes]
            sizes = np.bincount(pc.list_parent_indices(batch).to_numpy()[hit], minlength=len(batch))
            values = pa.array([found[t] for t in every], kind).take(pa.array(codes[hit]))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    return near(tokens)


def fuzzy(tokens: Column, threshold: int = 88) -> Column:
    """tokens -> array<struct<value, confidence>>: names of which a token is a slip of spelling."""
    names = choices()

    def find(part: list[str]) -> Iterator[dict | None]:
        tried = matchers(names)
        for token, reached in zip(part, in_reach(part, names, threshold), strict=True):
            name, score = best_match(token, tried, threshold) if reached else (None, 0)
            yield {"value": f"{token} -> {CODES.get(name, name)}", "confidence": round(score / 100, 2)} if name and score >= threshold and token != name else None

    return named(tokens, find)


def vector(text: Column, dimensions: int = 64) -> Column:
    """array<double> of length 1: counts of the text's two- and three-letter parts, between two blanks at each end, by their hash."""
    grams = lambda padded, n: F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
    both = let(F.concat(F.lit("  "), alias_form(text), F.lit("  ")), lambda padded: F.concat(grams(padded, 2), grams(padded, 3)))
    buckets = F.transform(both, lambda g: F.conv(F.substring(F.sha1(g), 1, 8), 16, 10).cast("long") % dimensions)
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    counts = let(buckets, lambda own: F.transform(places, lambda d: F.size(F.filter(own, lambda b: b == d)).cast("double")))
    return unit(counts, lambda x: x)


def unit(values: Column, shown: Callable[[Column], Column]) -> Column:
    """A vector scaled to length 1."""
    norm = lambda own: F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x))
    return let(values, lambda own: let(norm(own), lambda n: F.transform(own, lambda x: shown(x / n))))


def hash_vector(text: Column, dimensions: int) -> Column:
    """array<double> of length 1, rounded to six digits, out of the bytes of numbered digests of the text: the same text has the same vector.

    The digests are made in the JVM; their bytes are read as pairs of hexadecimal digits."""
    rounds = -(-dimensions // 32)
    body = F.coalesce(text, F.lit(""))
    digits = F.concat(*[F.sha2(F.concat(F.lit(f"{i}:"), body), 256) for i in range(rounds)])
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    values = let(digits, lambda d: F.transform(places, lambda i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0))
    return unit(values, lambda x: F.round(x, 6))


@lru_cache(1 << 16)
def hashed(gram: str) -> int:
    return int(hashlib.sha1(gram.encode()).hexdigest()[:8], 16)


def spelling_vectors(names: list[str], dimensions: int = 64) -> np.ndarray:
    """`vector` of constants, as rows."""
    padded = [f"  {name}  " for name in names]
    places = np.array([hashed(p[i : i + n]) % dimensions for p in padded for n in (2, 3) for i in range(len(p) - n + 1)], dtype=np.int64)
    rows = np.repeat(np.arange(len(names)) * dimensions, [2 * len(p) - 3 for p in padded])
    out = np.bincount(rows + places, minlength=len(names) * dimensions).reshape(len(names), dimensions).astype(float)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def alike(tokens: Column, threshold: float = 0.72) -> Column:
    """tokens -> array<struct<value, confidence>>: the name whose spelling vector is nearest, from the threshold on."""
    names = choices()
    matrix = spelling_vectors(names)

    def find(part: list[str]) -> Iterator[dict | None]:
        cosines = spelling_vectors(part) @ matrix.T
        for token, i, score in zip(part, cosines.argmax(axis=1), cosines.max(axis=1), strict=True):
            own = names[i]
            yield {"value": f"{token} -> {CODES.get(own, own)}", "confidence": round(float(score), 2)} if score >= threshold and token != own else None

    return named(tokens, find)


def known(text: Column) -> Column:
    """array<struct<value, reason_codes, confidence>>: bracketed, known and transliterated names."""
    latin_names = {latin(c): c for c in terms.TRANSLATED_ALIASES.values()}
    return F.concat(judged(refs(text)), listed(text, CODES, 0.66), listed(text, latin_names, 0.62))


def spelt(found: Column) -> Column:
    """What `fuzzy` and `alike` find, as candidates in the shape of `known`."""
    return F.transform(found, lambda a: F.struct(a["value"].alias("value"), F.array(F.lit("schema_candidate")).alias("reason_codes"), a["confidence"].alias("confidence")))


def every_alias(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, value, reason_codes, confidence): bracketed, known, transliterated, nearly spelt and alike names, each value once a row of df, the first of them."""
    t = F.col(text)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), key, known(t).alias("_known"), fuzzy(tokens_of(t, 4)).alias("_near"), alike(tokens_of(t, 3)).alias("_alike"))
    kinds = (F.col("_known"), spelt(F.col("_near")), spelt(F.col("_alike")))
    parts = [rows.select("_row", key, F.lit(i).alias("_kind"), F.posexplode(c).alias("_pos", "a")).select("_row", key, "_kind", "_pos", "a.*") for i, c in enumerate(kinds)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = every.groupBy("_row", key, F.lower("value").alias("_low")).agg(F.min_by(F.struct("value", "reason_codes", "confidence"), F.struct("_kind", "_pos")).alias("a"))
    return first.select(key, "a.*")
