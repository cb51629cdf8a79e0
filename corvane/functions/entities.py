"""What texts name: entities, domain values, places, relations, claims, intents and interests. Each is a Column over one text."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import terms
from corvane.functions.quantities import ANY_QUANTITY
from corvane.functions.text import distinct_in_order, let, sentences, snippet

#: Chemical symbols as words of their own, dates and names with initials: fixed patterns, each after a look at the character that it can begin with.
SUBSTANCE = rf"(?=[A-Z[^\x00-\x7F]])(?=[{''.join(sorted({s[0] for s in terms.SUBSTANCES}))}])(?U)\b(?:{'|'.join(terms.SUBSTANCES)})\b"
DATE = r"(?=[0-9])(?U)\b(?:19|20)[0-9]{2}\b|\b[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}\b"
EXPERT = r"(?=[A-Z[^\x00-\x7F]])(?=[А-ЯЁA-Z])(?U)\b[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ]\.){1,2}|\b[A-Z][a-z]+(?:\s+[A-Z]\.){1,2}"
YEAR = r"(?=[12])(?U)\b(?:19|20)[0-9]{2}\b"


def body(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def among(text: Column, words: list[str]) -> Column:
    """array<string>: the words that the text contains, without case, in the order of the list."""
    return let(F.lower(body(text)), lambda low: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))


def any_of(text: Column, words: list[str]) -> Column:
    return let(F.lower(body(text)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words], F.lit(False)))


def named(text: Column, names: dict[str, str]) -> Column:
    """array<string>: the distinct names whose words the text contains."""
    found = lambda low: F.array(*[F.when(F.contains(low, F.lit(word)), name) for word, name in names.items()])
    return F.array_distinct(F.array_compact(let(F.lower(body(text)), found)))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(body(text), F.lit(pattern), F.lit(0))


def first_that_fits(text: Column, words: dict[str, list[str]], default: str) -> Column:
    return reduce(lambda out, key: F.when(any_of(text, words[key]), key).otherwise(out), reversed(words), F.lit(default))


def document_places(text: Column) -> Column:
    return named(text, terms.DOCUMENT_PLACES)


def places(text: Column) -> Column:
    return named(text, terms.PLACES)


def place_bucket(text: Column) -> Column:
    """struct<bucket, country>: domestic, foreign or unknown, the first that the text names."""
    bucket = F.when(any_of(text, terms.DOMESTIC), "domestic").when(any_of(text, terms.FOREIGN), "foreign").otherwise("unknown")
    country = F.when(bucket == "domestic", "Россия").when(bucket == "foreign", "зарубежная практика").otherwise("")
    return F.struct(bucket.alias("bucket"), country.alias("country"))


def years(text: Column) -> Column:
    return F.transform(matches(text, YEAR), lambda y: y.cast("int"))


def entities(text: Column) -> Column:
    """array<string>: chemical symbols, then processes, then places that the text names as they are spelt; distinct without case."""
    names = [*dict.fromkeys(terms.PLACES.values())]
    spelt = let(F.lower(body(text)), lambda low: F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, F.lower(n))))
    return distinct_in_order(F.concat(matches(text, SUBSTANCE), among(text, terms.PROCESSES), spelt))


def domain_values(text: Column, parts: Column | None = None) -> dict[str, Column]:
    """Ten kinds of values, each array<string>, distinct without case. parts: the text's sentences where they are known already."""
    parts = sentences(text) if parts is None else parts
    found = {
        "material": among(text, terms.MATERIALS),
        "substance": matches(text, SUBSTANCE),
        "process": among(text, terms.PROCESSES),
        "equipment": among(text, terms.EQUIPMENT),
        "property": among(text, terms.PROPERTIES),
        "date": matches(text, DATE),
        "geography": places(text),
        "expert": matches(text, EXPERT),
        "source": F.when(any_of(text, terms.SOURCES), F.array(snippet(text))).otherwise(F.array().cast("array<string>")),
        "conclusion": F.filter(parts, lambda s: any_of(s, terms.CONCLUSIONS)),
    }
    return {kind: distinct_in_order(values) for kind, values in found.items()}


def relation(text: Column, named: Column | None = None) -> Column:
    """`first related_to second` of the first two entities (named, where they are known already), where the text has a word for a relation; else null."""
    first = lambda found: F.concat(F.get(found, F.lit(0)), F.lit(" related_to "), F.get(found, F.lit(1)))
    return let(entities(text) if named is None else named, lambda found: F.when((F.size(found) >= 2) & any_of(text, terms.RELATIONS), first(found)))


def has_conflict(text: Column) -> Column:
    return any_of(text, terms.CONFLICTS)


def needs_unit_check(text: Column) -> Column:
    return ~any_of(text, list(terms.UNITS))


def has_quantity(text: Column) -> Column:
    return body(text).rlike(ANY_QUANTITY)


def is_claim(sentence: Column) -> Column:
    return any_of(sentence, terms.CLAIMS) | has_quantity(sentence)


def purpose(source_type: Column, title: Column, text: Column) -> Column:
    """A document's purpose by the words in its source type, title and first 2000 characters."""
    return first_that_fits(F.concat_ws(" ", body(source_type), body(title), F.substring(body(text), 1, 2000)), terms.PURPOSES, "unknown")


def intent(question: Column) -> Column:
    return first_that_fits(question, terms.INTENTS, "evidence_lookup")


def query_terms(question: Column) -> Column:
    return F.concat(among(question, terms.PROCESSES), among(question, terms.QUERY_TERMS))


def source_types(question: Column) -> Column:
    return named(question, terms.SOURCE_TYPES)


def time_constraint(question: Column) -> Column:
    """struct<relative_years, start_year, end_year>: `последние n лет`, else a range of years, else nulls."""
    low = F.lower(body(question))
    last = F.nullif(F.regexp_extract(low, r"последн(?:ие|их|ими)?\s+([0-9]+)\s+лет", 1), F.lit("")).try_cast("int")
    ends = [F.nullif(F.regexp_extract(low, r"(20[0-9]{2})\s*[-–—]\s*(20[0-9]{2})", i), F.lit("")).try_cast("int") for i in (1, 2)]
    return F.struct(last.alias("relative_years"), *[F.when(last.isNull(), y).alias(n) for y, n in zip(ends, ("start_year", "end_year"), strict=True)])


def interests(text: Column) -> Column:
    """array<struct<label, weight, source_terms>>: vocabularies whose words the text has, 0.35 and 0.1 a word up to 1; and each formula at 0.8."""
    kinds = {"materials": terms.MATERIALS, "processes": terms.PROCESSES, "equipment": terms.EQUIPMENT, "properties": terms.PROPERTIES, "geography": list(terms.PLACES)}

    def one(label: str, words: list[str]) -> Column:
        found = F.sort_array(among(text, words))
        weight = F.least(F.lit(1.0), 0.35 + 0.1 * F.size(found))
        return F.when(F.size(found) > 0, F.struct(F.lit(label).alias("label"), weight.alias("weight"), F.slice(found, 1, 8).alias("source_terms")))

    formulas = F.transform(matches(text, SUBSTANCE), lambda f: F.struct(F.concat(F.lit("substance:"), f).alias("label"), F.lit(0.8).alias("weight"), F.array(f).alias("source_terms")))
    return F.concat(F.array_compact(F.array(*[one(label, words) for label, words in kinds.items()])), formulas)
