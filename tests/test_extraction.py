"""Extraction with every kind of alias, against the aliases of each text and the extraction without them."""

from corvane.functions import aliases
from corvane.operators import planning

TEXTS = [
    ("d1", "s1", "Nickel flotation (NF) reached 5 mg/l of nikel. Nickel flotation (NF) again, with coppr and kuchnoe vyschelachivanie."),
    ("d1", "s2", "We recommend flotatsiya of medi and nikel; electroextraction (EE) must rise to 7 %."),
    ("d2", "s1", "Nikel (Ni) and Copper (Cu) are leached, coppr too, by slagg."),
    ("d2", "s2", ""),
    ("d3", "s1", None),
]


def rows(found):
    return {(r.document, r.kind, r.value.lower(), r.status): (r.span, r.value, r.confidence, tuple(r.reason_codes)) for r in found.collect()}


def test_every_alias_is_extracted_once(spark):
    spans = spark.createDataFrame(TEXTS, "document string, span string, text string")
    plain = rows(planning.extracted(spans, "span", "text", "document", most=10_000))
    found = rows(planning.extracted(spans, "span", "text", "document", most=10_000, nearly_spelt=True))
    assert {k: v for k, v in found.items() if k[1] != "alias"} == {k: v for k, v in plain.items() if k[1] != "alias"}
    want = {}
    for document in ("d1", "d2", "d3"):
        own = spans.where(f"document = '{document}'")
        for a in sorted(aliases.every_alias(own, "text", "span").collect(), key=lambda a: a.span):
            codes, status = list(a.reason_codes), "candidate" if a.reason_codes else "confirmed"
            if status == "confirmed" and a.confidence < 0.72:
                codes, status = ["low_confidence"], "candidate"
            want.setdefault((document, "alias", a.value.lower(), status), (a.span, a.confidence, tuple(codes)))
    assert {k: (s, c, r) for k, (s, _, c, r) in found.items() if k[1] == "alias"} == want
    assert {k for k in plain if k[1] == "alias"} < set(want)  # and more than without
    spelt = aliases.fuzzy(aliases.tokens_of(spans["text"], 4))
    near = {a.value.lower() for r in spans.select(spelt.alias("f")).collect() for a in r.f or []}
    assert near and near <= {k[2] for k in want}


def test_nothing_to_extract(spark):
    spans = spark.createDataFrame([], "document string, span string, text string")
    assert planning.extracted(spans, "span", "text", "document", nearly_spelt=True).count() == 0


def test_texts_are_read_once(spark):
    """The rerank makes no index of all tokens for five of them, and interests are computed once a row, whatever reads them."""
    from corvane.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert {f.rsplit("/", 1)[1] for f in QUERIES["t03_rerank"](spark, sf).inputFiles()} == {"documents.parquet"}
    plan = QUERIES["x45_interests"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substance:") == 1


def long_texts(spark, folder):
    """Two texts of more than 80 tokens that come before the slips in order, one text of many short forms, one of a sentence, one empty, one null."""
    many = " ".join(f"a{i:03}x" for i in range(200))
    forms = " ".join(f"Long name number {i} (LN{i})." for i in range(150))
    rows = [(0, f"{many} nikel coppr and flotatsiya with slagg too"), (1, f"вода {many} обессоливанне выщелачиванье zolotoo"), (2, forms), (3, "Nikel flotattion."), (4, ""), (5, None)]
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def compared(spark, folder):
    """(doc_id, value) of every slip and of every alike name, by loops over all tokens and names."""
    import re
    from difflib import SequenceMatcher

    from corvane.functions.text import QUERY_TOKEN
    from corvane.plans.extraction import notes

    names, slips, alike = aliases.choices(), set(), set()
    vectors = aliases.spelling_vectors(names)
    for row in notes(spark, folder).collect():
        for token in {t.lower() for t in re.findall(QUERY_TOKEN, row.note)}:
            scores = [round(SequenceMatcher(None, token, n).ratio() * 100) for n in names]
            best = names[scores.index(max(scores))]
            if len(token) >= 4 and max(scores) >= 88 and best != token:
                slips.add((row.doc_id, f"{token} -> {aliases.CODES.get(best, best)}"))
            cosines = (vectors @ aliases.spelling_vectors([token])[0]).tolist()
            best = names[cosines.index(max(cosines))]
            if len(token) >= 3 and max(cosines) >= 0.72 and best != token:
                alike.add((row.doc_id, f"{token} -> {aliases.CODES.get(best, best)}"))
    return slips, alike


def test_v17_compares_every_token_and_cuts_nothing(spark, tmp_path):
    from corvane.plans.queries import QUERIES

    folder = long_texts(spark, tmp_path)
    found = {(r.document, r.value) for r in QUERIES["v17_every_alias"](spark, folder).where("kind = 'alias'").collect()}
    slips, alike = compared(spark, folder)
    assert slips | alike <= found and {(0, "slagg -> шлак"), (1, "обессоливанне -> обессоливание")} <= slips
    assert {(2, f"LN{i} -> Long name number {i}") for i in range(150)} <= found


def test_x14_compares_every_token(spark, tmp_path):
    from corvane.plans.queries import QUERIES

    folder = long_texts(spark, tmp_path)
    rows = QUERIES["x14_all_aliases"](spark, folder).collect()
    slips, alike = compared(spark, folder)
    found = {(r.doc_id, r.value) for r in rows}
    assert slips | alike <= found and len(found) == len(rows) and (1, "обессоливанне -> обессоливание") in slips and {(2, f"LN{i} -> Long name number {i}") for i in range(150)} <= found


def test_x17_compares_every_token(spark, tmp_path):
    from corvane.plans.queries import QUERIES

    folder = long_texts(spark, tmp_path)
    found = [(r.doc_id, r.value) for r in QUERIES["x17_fuzzy_aliases"](spark, folder).collect()]
    slips, _ = compared(spark, folder)
    assert sorted(found) == sorted(slips) and (1, "обессоливанне -> обессоливание") in slips


def test_slips_out_of_reach_are_none():
    """The bound that many tokens are held against at once leaves out no token that a name is near to, and most others."""
    import random

    rng, names = random.Random(6), aliases.choices()
    tokens = [n[:k] + rng.choice(["", "a", "ё", "q", "%"]) + n[k + rng.randint(0, 1) :] for n in names for k in range(len(n) + 1)] + names
    tokens += ["".join(rng.choices("abdeilnorstавинот-%", k=rng.randint(1, 12))) for _ in range(2000)] + ["", "n" * 700]
    tried = aliases.matchers(names)
    for least in (60, 88):
        near = [aliases.best_match(t, tried, least)[0] is not None for t in tokens]
        reached = aliases.in_reach(tokens, names, least)
        assert all(r for n, r in zip(near, reached, strict=True) if n) and sum(near) <= sum(reached)
    assert sum(reached) < len(tokens) / 2
