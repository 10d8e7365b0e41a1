from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lumenmart.functions import text
from lumenmart.operators import contracts, facts, intents, phrases, resolve
from lumenmart.operators.fact_patterns import Pattern
from tests.builders import day

CATALOG = [
    ("sony-a7-iii", "Camera", "Sony", "Alpha A7", "III", "sony-e"), ("sony-a7-iv", "Camera", "Sony", "Alpha A7", "IV", "sony-e"), ("nikon-z6-iii", "Camera", "Nikon", "Z6", "III", "nikon-z"),
    ("sigma-24-70", "Lens", "Sigma", "24-70mm f/2.8 DG DN", "Art", "sony-e"), ("sigma-24-70-ii", "Lens", "Sigma", "24-70mm f/2.8 DG DN", "II Art", "sony-e"),
    ("dji-rs-4", "Gimbal", "DJI", "RS 4", "", "none"),
]
ALIASES = [
    ("a7 iv", "sony-a7-iv"), ("a7 iii", "sony-a7-iii"), ("sigma 24-70 dg dn ii", "sigma-24-70-ii"), ("sigma 24-70 dg dn", "sigma-24-70"), ("dji rs 4", "dji-rs-4"), ("z6 iii", "nikon-z6-iii"),
]


@pytest.fixture(scope="module")
def recognized(spark):
    cases = {
        "plain": ("Sony A7 IV come nuova", "vendo corpo"), "negated": ("Sony A7 IV, non A7 III", ""), "kit": ("Sony A7 IV + Sigma 24-70 DG DN II + DJI RS 4", ""),
        "spelling": ("Vendo alpha 7 iv", ""), "compatible": ("Cage compatible with A7 IV", ""), "id": ("codice sony-a7-iv", ""), "chair": ("wooden chair", "old"),
        "conflict": ("Sony A7 IV", "la mia A7 III va bene"), "two bodies": ("Sony A7 IV e Nikon Z6 III", ""), "first series": ("Sigma 24-70 DG DN prima serie", ""), "second series": ("Sigma 24-70 DG DN II", ""), "numeric": ("Sony A7 4 corpo", ""),
        "words": ("Sigma zoom 24 70mm f2 8 DG DN contemporary", ""),
    }
    listings = spark.createDataFrame([(key, *value) for key, value in cases.items()], "listing_id string, title string, description string")
    catalog = spark.createDataFrame(CATALOG, "product_id string, category string, brand string, model string, version string, native_mount string")
    aliases = spark.createDataFrame(ALIASES, "alias string, product_id string")
    ranked, chosen = resolve.recognize(listings, catalog, aliases)
    return {r.listing_id: r for r in chosen.collect()}, {(r.listing_id, r.product_id): r for r in ranked.collect()}


def test_plain_alias_with_title_and_version(recognized):
    chosen, ranked = recognized
    assert chosen["plain"].product_id == "sony-a7-iv" and ranked["plain", "sony-a7-iv"].score == 100


def test_negated_product_is_left_out(recognized):
    chosen, ranked = recognized
    assert chosen["negated"].product_id == "sony-a7-iv" and ("negated", "sony-a7-iii") not in ranked


def test_kit_keeps_the_leading_camera(recognized):
    assert recognized[0]["kit"].product_id == "sony-a7-iv" and recognized[0]["kit"].structure == "kit"
    assert ("kit", "sigma-24-70") not in recognized[1] or recognized[1]["kit", "sigma-24-70"].score < recognized[1]["kit", "sigma-24-70-ii"].score


def test_spelling_compatible_and_id(recognized):
    chosen, ranked = recognized
    assert chosen["spelling"].product_id == "sony-a7-iv" and ranked["spelling", "sony-a7-iv"].match_type == "normalized_alias"
    assert chosen["compatible"].product_id is None
    assert ranked["id", "sony-a7-iv"].match_type == "exact_product_id"


def test_generations_are_told_apart(recognized):
    chosen, ranked = recognized
    assert chosen["first series"].product_id == "sigma-24-70" and chosen["second series"].product_id == "sigma-24-70-ii"
    assert ("second series", "sigma-24-70") not in ranked
    assert chosen["numeric"].product_id == "sony-a7-iv" and ranked["numeric", "sony-a7-iv"].match_type == "normalized_alias"


def test_words_alone_never_reach_the_primary_threshold(recognized):
    chosen, ranked = recognized
    kinds = {row.match_type for (listing, _), row in ranked.items() if listing == "words"}
    assert kinds == {"token_match"} and chosen["words"].product_id is None


def test_unknown_and_ambiguous(recognized):
    chosen, _ = recognized
    assert chosen["chair"].product_id is None and chosen["chair"].recognition_confidence == 0
    assert chosen["conflict"].product_id is None and chosen["conflict"].ambiguous
    assert chosen["two bodies"].product_id is None and chosen["two bodies"].ambiguous


def test_title_bonus_and_agreement(spark):
    columns = "listing_id string, product_id string, match_type string, base int, title_match boolean, description_match boolean, version_match boolean, generic boolean, second_near boolean, second_generation boolean, mounts array<string>, mount string, first_series boolean"
    row = lambda title, description: ("l", "p", "token_match", 60, title, description, False, False, False, False, [], "x", False)
    scores = [r.score for r in resolve.score(spark.createDataFrame([row(False, True), row(True, False), row(True, True)], columns)).collect()]
    assert scores == [60, 65, 68]


def test_contained_needles_match_brute_force(spark):
    texts = {"a": "xxabcdefghijyy", "b": "short abc", "c": "nothing", "d": "abcdefghzz abcdefghij"}
    needles = {"n1": "abcdefghij", "n2": "abc", "n3": "abcdefgh", "n4": "zz", "n5": "q"}
    found = phrases.contained_needles(
        spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t", spark.createDataFrame(list(needles.items()), "key string, needle string"))
    expected = {(t, n) for t, body in texts.items() for n, needle in needles.items() if needle in body}
    assert {(r.id, r.entry.key) for r in found.collect()} == expected


def test_redaction_matches_python_patterns(spark):
    samples = [
        "Sony A7 60k scatti, mail a.b@c.it o +39 333 1234567", "pay 4111 1111 1111 1111 now", "token = abc123 qualità", "abito in via Roma 12, Milano", "serie 12345678 12345678",
        "nothing private, 60 000 scatti", "ê.92@mail.example.com", "è3331234567", "x 1234-5678-9012-3456-7890-12 y",
    ]
    def python(value):
        for _, pattern in text.PRIVATE_PATTERNS:
            value = re.sub(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""), "[removed]", value)
        return value
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", text.redact(F.col("t")).alias("r")).collect()
    assert [(r.t, r.r) for r in rows] == [(s, python(s)) for s in samples]


def test_documents_redact_like_python(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", text.redact(F.col("text")).alias("r")).collect()
    for row in documents:
        value = row.text
        for _, pattern in text.PRIVATE_PATTERNS:
            value = re.sub(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""), "[removed]", value)
        assert row.r == value


def test_spans_slice_back_to_the_source(spark):
    source = "12 tre 4567, x 89 senza 1000000"
    found = spark.createDataFrame([(source,)], "t string").select(text.matches_with_spans(F.col("t"), r"(\d)\d*", 1).alias("m")).first().m
    assert [(m.start, m.end, m.found) for m in found] == [(m.start(), m.end(), m.group(0)) for m in re.finditer(r"(\d)\d*", source)]
    assert all(source[m.start:m.end] == m.found and m.part == m.found[0] for m in found)


def test_feed_price(spark):
    rows = spark.createDataFrame([("price € 1.234,50",), ("about 1.234,50",), ("€ 10 or € 12",), ("€ 5",)], "t string")
    values = [r[0] for r in rows.select(text.feed_price(F.col("t"), ["€", "EUR"], ",", ".")).collect()]
    assert values == [1234.5, None, None, 5.0]


def test_canonical_url(spark):
    rows = spark.createDataFrame([("https://a.it/x?utm_source=1&b=2&REF=z#top",), ("https://a.it/x?ref=1",), ("ftp://a.it",), ("http://u:p@a.it/",)], "u string")
    assert [r[0] for r in rows.select(text.canonical_url(F.col("u"))).collect()] == ["https://a.it/x?b=2", "https://a.it/x", None, None]


def analyzed(spark, *texts, category="Camera"):
    frame = spark.createDataFrame([(str(i), *t, category) for i, t in enumerate(texts)], "id string, title string, description string, category string")
    return facts.analyze(frame, F.lit("2026-08-01").cast("date")).orderBy("id").collect()


def test_italian_listing_facts(spark):
    row = analyzed(spark, ("Sony A7 IV", "con circa 60k scatti, fattura presente, scatola originale e tre batterie originali Sony. Garanzia fino al 31/12/2027, ancora perfettamente funzionante"))[0]
    assert (row.x_shutter_count, row.x_invoice_available, row.x_original_box_available, row.x_warranty_until) == (60000, True, True, day("2027-12-31"))
    assert row.x_accessories == ["Sony original battery"] * 3 and row.x_claims == ["perfettamente funzionante"]


def test_conflicts_and_negations(spark):
    rows = analyzed(
        spark, ("a", "30k scatti, shutter count: 45000"), ("b", "senza graffi, presenta graffi"), ("c", "Display rotto. Perfettamente funzionante, nessun difetto"),
        ("d", "warranty until March 2027"), ("e", "ancora tre mesi di garanzia"), ("f", "fattura presente ma senza fattura"))
    assert rows[0].x_shutter_count is None and "conflicting shutter" in rows[0].x_warnings
    assert rows[1].x_defects == []
    assert [d.category for d in rows[2].x_defects] == ["electronic_damage"] and rows[2].x_confidence == 100 - 20 - 20 - 10
    assert rows[3].x_warranty_until == day("2027-03-31") and rows[4].x_warranty_until == day("2026-11-01")
    assert rows[5].x_invoice_available is None


def test_fact_spans_point_into_the_text(spark):
    row = analyzed(spark, ("Nikon Z6", "manca copriobiettivo, 12.345 scatti, 2 NP-FZ100 originali, DJI RS 3 Pro"))[0]
    assert row.x_facts and all(row.x_text[f.start:f.end] == f.found for f in row.x_facts)
    assert row.x_accessories == ["Sony original NP-FZ100 battery"] * 2 + ["DJI RS 3 Pro gimbal"] and row.x_defects[0].affected_component == "copriobiettivo"


def test_merge_repeats(spark):
    row = spark.range(1).select(facts.merge_repeats(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("a"), F.lit("c"))).alias("m")).first()
    assert row.m == ["A", "b", "a", "c"]


def test_intents(spark):
    rows = spark.createDataFrame([("aiuto",), ("confronta A e B, quanto vale?",), ("ciao",)], "t string").select(intents.intent(F.col("t")).alias("i")).collect()
    assert [(r.i.intent, r.i.confidence) for r in rows] == [("HELP", 95), ("COMPARE_PRODUCTS", 85), ("UNSUPPORTED", 25)]


def test_contract_rows(spark):
    rows = spark.createDataFrame([("1", " ", "12", "x"), ("2", "ok", "a", "2026-02-30")], "k string, name string, n string, d string")
    found = contracts.violations(rows, "t", F.col("k"), [contracts.required("name"), contracts.typed("n", "int"), contracts.typed("d", "date")])
    assert {(r.row_key, r.field, r.rule) for r in found.collect()} == {("1", "name", "required"), ("1", "d", "not date"), ("2", "n", "not int"), ("2", "d", "not date")}
    assert contracts.header(["a", "c"], ["a", "b"]) == [("b", "missing column"), ("c", "unknown column")]
    overlap = spark.createDataFrame([(["Sony"], ["sony", "x"])], "a array<string>, b array<string>")
    assert contracts.violations(overlap, "t", F.lit("1"), [contracts.disjoint("a", "b")]).count() == 1


def test_unmatched_terms(spark):
    listings = spark.createDataFrame([("1", "Nikon ZG III body", ""), ("2", "cage compatible Nikon x", ""), ("3", "old thing", "")], "listing_id string, title string, description string")
    catalog = spark.createDataFrame([("Nikon",), ("Sony",)], "brand string")
    assert {(r.listing_id, r.term) for r in resolve.unmatched_terms(listings, catalog).collect()} == {("1", "nikon zg iii body")}


def test_fuzzy_matches_equal_a_scan_of_all_products(spark):
    from difflib import SequenceMatcher

    products = [("p1", "Brand 17", "red widget"), ("p2", "Brand 17", "red gear"), ("p3", "Brand 4", "cold anvil x100"), ("p4", "Other", "red widget")]
    texts = ["brand 17 red vidget", "brand 17 red wigdet gear", "nothing here", "cold anvil x10 brand 4", "big brand 17 red gea for sale", "other red widgets"]
    catalog = spark.createDataFrame([(*row, "") for row in products], "product_id string, brand string, model string, version string")
    frame = spark.createDataFrame([(t, t) for t in texts], "text_id string, normalized string").withColumn("tokens", resolve.product_words(F.col("normalized")))
    found = {(r.text_id, r.product_id): r.ratio for r in resolve.fuzzy_matches(frame, catalog).collect()}
    words = lambda value: {w for w in value.split() if len(w) > 1 and w not in text.IGNORED_WORDS}
    expected = {}
    for body in texts:
        for key, brand, model in products:
            display = f"{brand} {model}".lower()
            distinctive = any(len(w) >= 3 and any(c.isdigit() for c in w) for w in words(display))
            if len(words(display) & words(body)) < 2 or not (brand.lower() in body or distinctive):
                continue
            parts, size = body.split(), max(2, len(display.split()))
            best = max(SequenceMatcher(None, display, " ".join(parts[i:i + size])).ratio() for i in range(len(parts)))
            if best >= 0.82:
                expected[body, key] = best
    assert expected and found == pytest.approx(expected)


def test_headers_of_files(spark, tmp_path):
    from lumenmart.operators import contracts
    for name, text in (("good", "a,b\n1,2\n"), ("swapped", "b,a\n"), ("short", "a\n"), ("odd", '"a", b ,c\n'), ("empty", "")):
        (tmp_path / f"{name}.csv").write_text(text)
    found = {(r.row_key.rsplit("/", 1)[1], r.field, r.rule) for r in contracts.header_violations(spark, str(tmp_path), "t", ["a", "b"], True).collect()}
    assert found == {("swapped.csv", "b", "column order"), ("short.csv", "b", "missing column"), ("odd.csv", "c", "unknown column"),
                     ("empty.csv", "a", "missing column"), ("empty.csv", "b", "missing column")}


def test_similarity_equals_the_block_ratio(spark):
    import random
    from difflib import SequenceMatcher
    from lumenmart.functions.similarity import may_reach, similarity

    draw = random.Random(7)
    pick = lambda longest: "".join(draw.choice("ab cde1é") for _ in range(draw.randint(0, longest)))
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("aaaa", "aa"), ("abxcd", "abcd"), ("red widget", "widget red")]
    for _ in range(150):
        left, right = pick(20), []
        for letter in left:
            kind = draw.random()
            right += [] if kind < 0.08 else [pick(1), letter] if kind < 0.16 else [letter]
        pairs += [(left, "".join(right)), (left, pick(20))]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", similarity(F.col("a"), F.col("b")).alias("ratio"), may_reach(F.col("a"), F.col("b"), 0.82).alias("may")).collect()
    for row in rows:
        assert row.ratio == pytest.approx(SequenceMatcher(None, row.a, row.b).ratio(), abs=1e-12), row
        assert row.may or row.ratio < 0.82, row
    assert any(not row.may for row in rows)


def test_fuzzy_matching_stays_out_of_python(spark):
    frame = spark.createDataFrame([("t", "brand 17 red vidget")], "text_id string, normalized string").withColumn("tokens", resolve.product_words(F.col("normalized")))
    catalog = spark.createDataFrame([("p", "Brand 17", "red widget", "")], "product_id string, brand string, model string, version string")
    plan = resolve.fuzzy_matches(frame, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_entries_that_begin_alike_are_indexed_apart(spark):
    names = [f"sony alpha camera body {i:03d} series kit" for i in range(120)] + ["sony", "sony alpha", "kit"]
    index, sizes = phrases.needle_index(spark.createDataFrame([(n,) for n in names * 2], "needle string"))
    assert index.count() == len(names) and sizes == [3, 4, 8]
    assert index.groupBy("key").count().agg(F.max("count")).first()[0] <= 2
    by_words, _ = phrases.phrase_index(spark.createDataFrame([(n,) for n in names], "phrase string"))
    assert by_words.groupBy("key").count().agg(F.max("count")).first()[0] == 1

    bodies = [f"my {n} for sale, {m}" for n, m in zip(names, reversed(names))] + ["", "sony alpha camera body", "xkity", "sonyalpha"]
    texts = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    needles = spark.createDataFrame([(n, i) for i, n in enumerate(names + names[:3] + [""])], "needle string, number int")
    found = {(r.id, r.entry.number) for r in phrases.contained_needles(texts, "id", "body", needles).collect()}
    assert found == {(t, i) for t, body in enumerate(bodies) for i, n in enumerate(names + names[:3]) if n in body}

    worded = phrases.with_words(texts, "body")
    entries = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "phrase string, number int")
    hits = {(r.id, h.entry.number) for r in phrases.phrase_hits(worded, "id", entries).collect() for h in r.hits}
    plain = [f" {' '.join(body.replace(',', ' ').split())} " for body in bodies]
    assert hits == {(t, i) for t, body in enumerate(plain) for i, n in enumerate(names) if f" {n} " in body}


def test_no_needles_and_no_phrases(spark):
    texts = phrases.with_words(spark.createDataFrame([(1, "some text")], "id int, body string"), "body")
    assert phrases.contained_needles(texts, "id", "body", spark.createDataFrame([], "needle string, n int")).count() == 0
    assert phrases.phrase_hits(texts, "id", spark.createDataFrame([("",)], "phrase string")).count() == 0


def test_strict_source_files(spark, tmp_path):
    import json
    from lumenmart.operators import contracts
    good = {name: "x" for name in contracts.SOURCE_KEYS} | {"source_type": "JSON_FEED", "segment": "NEW", "country": "IT", "currency": "EUR", "mapping": {"price_extraction": {"currency_code": "EUR"}}}
    files = {
        "good": json.dumps({"sources": [good, good | {"source_id": "y"}]}, indent=1), "empty_list": '{"sources": []}', "array": "[]", "broken": '{"sources": [',
        "no_list": '{"sources": {"a": 1}, "more": 2}',
        "bad": json.dumps({"sources": [3, good, good, {k: v for k, v in good.items() if k != "notes"} | {"source_id": "z", "Notes": ""},
                                       good | {"source_id": "w", "mapping": [1], "country": "it"}]}),
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body)
    found = {(r.row_key.rsplit("/", 1)[1], r.field, r.rule) for r in contracts.source_file_violations(spark, str(tmp_path)).collect()}
    assert found == {
        ("array.json#0", "", "not an object"), ("broken.json#0", "", "not an object"), ("no_list.json#0", "more", "unknown key"), ("no_list.json#0", "sources", "not an array"),
        ("bad.json#1", "", "not an object"), ("bad.json#3", "source_id", "repeated id"), ("bad.json#4", "notes", "missing key"), ("bad.json#4", "Notes", "unknown key"),
        ("bad.json#5", "mapping", "not an object"), ("bad.json#5", "country", "two capitals"),
    }


def test_fact_rows_equal_python_matches(spark):
    texts = ["no match", "", "12 and 3456, 78\u00017890 \U0001f4f7 55", "a\u0001b 1", "\u0001", "7" * 5000 + " x " + "é1 " * 300, None]
    table = [Pattern("digits", "number", r"\d+", 80), Pattern("word", "word", r"[a-z]+\b", 70)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r.id, r.name, r.start_position, r.end_position, r.source_text) for r in facts.fact_rows(frame, "id", F.col("t"), table).collect()}
    want = {
        (i, p.name, m.start(), m.end(), m.group())
        for i, t in enumerate(texts) for p in table for m in re.finditer(p.expression, t or "", re.I)
    }
    assert got == want


def test_repeated_texts_are_read_once_with_the_same_facts(spark):
    cases = [
        (1, "Camera", "a7", "20k scatti, con fattura"), (2, "Camera", "a7", "20k scatti, con fattura"), (3, "Lens", "a7", "20k scatti, con fattura"),
        (4, None, None, None), (5, "", "", ""), (6, "Camera", "ab", "c"), (7, "Camera", "a", "bc"), (8, "Lens", "x\u0001", "graffi sulla lente posteriore"),
    ]
    rows = spark.createDataFrame(cases, "id int, category string, title string, description string")
    names = ("x_shutter_count", "x_invoice_available", "x_defects", "x_missing", "x_confidence")
    as_of = F.lit("2026-08-01").cast("date")
    once = facts.analyze_once(rows, as_of, names)
    assert sorted(map(repr, once.select("id", *names).collect())) == sorted(map(repr, facts.analyze(rows, as_of).select("id", *names).collect()))
    assert "Deduplicate" in once._jdf.queryExecution().analyzed().toString()


def test_companion_words_lose_no_match(spark):
    found = [
        "shutter count: 5000", "garanzia fino al 1/2/2027", "warranty until 3/4/2028", "ancora 6 mesi di garanzia", "remaining two months warranty", "acquistata due mesi fa con garanzia italiana",
        "fattura presente", "con fattura", "ricevuta disponibile", "scontrino disponibile", "Invoice included", "proof of purchase", "senza fattura", "fattura smarrita", "no receipt",
        "scatola originale", "confezione originale", "imballo originale", "original box", "complete packaging", "senza scatola", "scatola non inclusa", "no original box", "pari al nuovo",
        "usata pochissimo", "perfettamente funzionante", "nessun difetto", "nessun graffio", "senza graffi", "no scratches", "senza funghi", "nessun fungo", "no fungus", "lente frontale crepata",
        "elemento frontale incrinato", "cracked front glass", "graffi evidenti sulla lente frontale", "deep scratches on front element", "graffio sulla lente posteriore", "scratch on the rear element",
        "presenta graffi", "has scratches", "lente frontale danneggiata", "damaged front element", "elemento posteriore danneggiato", "damaged rear element", "lieve polvere interna", "light internal dust",
        "display rotto", "schermo danneggiato", "display broken", "schermo damaged", "piccolo graffio sulla scocca", "small graffio sulla body", "2 Sony NP-FZ100 batterie", "due patona batteries",
        *[f"Rode VM2 {item}" for item in "charger,caricatore,grip,cage,filter,filtro,bag,borsa,strap,tracolla,microphone,microfono,monitor,flash,gimbal,memory card,scheda di memoria,lens hood,paraluce,adapter,adattatore".split(",")],
    ]
    patterns = [p for group in (facts.P.SHUTTER, facts.P.CLAIMS, facts.P.NEGATED, facts.P.DEFECTS, facts.P.ACCESSORIES) for p in group] + [
        value for name, value in vars(facts.P).items() if isinstance(value, Pattern)]
    frame = spark.createDataFrame(list(enumerate(found)), "id int, t string")
    cut = lambda *rest: F.transform(facts.cuts(F.col("t"), patterns, *rest), lambda c: F.coalesce(F.size(c["pieces"]), F.lit(1)) > 1)
    got = frame.select("id", cut().alias("all"), cut(F.lower("t"), F.lit(False)).alias("quick")).collect()
    assert [found[r.id] for r in got if not any(r["all"])] == [] and [found[r.id] for r in got if r["all"] != r["quick"]] == [] and [r.id for r in got if r["all"] != r["quick"]] == []
    seen = {p.name for r in got for p, hit in zip(patterns, r["all"]) if hit}
    assert set(facts.P.COMPANIONS) <= seen and len({p.name for p in patterns} - set(facts.P.KEYWORDS)) == 0


def test_recognition_works_out_words_and_spellings_once(spark, monkeypatch):
    staged, stage = [], resolve.stage
    monkeypatch.setattr(resolve, "stage", lambda frame: staged.append(set(frame.columns)) or stage(frame))
    listings = spark.createDataFrame([("x", "Sony A7 IV", "corpo")], "listing_id string, title string, description string")
    catalog = spark.createDataFrame(CATALOG, "product_id string, category string, brand string, model string, version string, native_mount string")
    _, chosen = resolve.recognize(listings, catalog, spark.createDataFrame(ALIASES, "alias string, product_id string"))
    assert chosen.first().product_id == "sony-a7-iv"
    assert sum("raw_words" in columns for columns in staged) == 1 and sum({"phrase", "label"} <= columns for columns in staged) == 1


def test_unmatched_terms_reads_each_title_once(spark, monkeypatch):
    from lumenmart.plans import resolve_queries
    from lumenmart.plans.registry import Tables

    given, read = [], resolve.unmatched_terms
    monkeypatch.setattr(resolve, "unmatched_terms", lambda listings, *more: given.append(listings) or read(listings, *more))
    tables = Tables(spark, "/root/testdata/sf0.001")
    counts = {r.term: r.listings for r in resolve_queries.unmatched_terms(tables).collect()}
    titles = resolve_queries.titled(tables)
    (texts,) = given
    assert texts.count() == titles.select("title").distinct().count() < titles.count()
    per_listing = read(titles, tables.part.select(F.col("p_brand").alias("brand")))
    assert set(counts) <= {r.term for r in per_listing.select("term").distinct().collect()}
    assert 0 < sum(counts.values()) <= titles.count()
