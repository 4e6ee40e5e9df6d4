"""Cases that the operators once left out."""

import random

from ragloom.llm import decontamination, quality, urlfilter


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_decontamination_finds_short_items_among_rare_words(spark):
    rng = random.Random(21)
    common = prose(rng, 60).split()
    items = [" ".join(rng.sample(common, n)) for n in (4, 7, 16, 16, 30)]
    noise = [prose(rng, 150) + " " + " ".join(rng.choices(common, k=60)) for _ in range(60)]
    held = [" ".join([*prose(rng, 40 + 3 * i).split(), item, *prose(rng, 40).split()]) for i, item in enumerate(items)]
    long = prose(rng, 8000)
    texts = [*noise, *held, prose(rng, 50) + " " + long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([*enumerate(items), (9, long), (8, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert {*((60 + i, i) for i in range(len(items))), (65, 9)} <= found
    assert {d for d, i in found if i in (2, 3, 4, 9)} <= {62, 63, 64, 65}
    alone = docs.where("doc_id = 61")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(alone, benchmark).collect()] == [(61, 1)]


def test_decontamination_blocks_hold_no_more_windows_than_the_rank():
    items = decontamination._items([{"item_id": i, "text": prose(random.Random(i), n)} for i, n in enumerate([500] * 40 + [5] * 9 + [9000])])
    blocks = list(decontamination._blocks(items))
    assert all(0 < len(windows) <= decontamination.RANK for _, windows in blocks)
    assert sum(len(windows) for _, windows in blocks) == len(decontamination._item_windows(items))


def test_quality_judges_sources_of_symbols_and_small_sources(spark):
    rng = random.Random(22)
    code = lambda words: " ".join(w + rng.choice(["", "", "#", "$"]) for w in prose(rng, words).split())
    rows = [("en", "prose", prose(rng, rng.randint(80, 300))) for _ in range(120)] + [("en", "code", code(rng.randint(80, 300))) for _ in range(60)]
    junk = "$$$ ### *** %% " * 40
    rows += [("en", "code", junk + prose(rng, 100)), ("en", "junk", junk + prose(rng, 100)), ("xx", "lone", junk + prose(rng, 100))]
    docs = spark.createDataFrame([(i, t, lang, source) for i, (lang, source, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert len(got) == 183 and all(r["distance2"] is not None for r in got.values())
    assert sum(got[i]["kept"] for i in range(180)) > 170
    assert not any(got[i]["kept"] for i in (180, 181, 182))


def test_page_links_reads_every_form_of_a_canonical_tag(spark):
    html = [
        '<LINK REL="CANONICAL" HREF="http://x.org/0">', '<link href="http://x.org/1" rel="alternate canonical">', "<link rel='a canonical b' href='http://x.org/2'>",
        '<link rel=canonical href="http://x.org/3"><link rel="canonical" href="http://y.org/3">', '<link rel="noncanonical" href="http://x.org/4"><link rel="canonical-x" href="/4">', '<link rel=canonical href=http://x.org/5>',
    ]
    pages = spark.createDataFrame([(f"http://p.org/{i}p", h) for i, h in enumerate(html)], "url string, html string")
    found = {(r["src"], r["dst"]) for r in urlfilter.page_links(pages).collect()}
    assert found == {(f"p.org/{i}p", f"x.org/{i}") for i in (0, 1, 2, 3, 5)} | {("p.org/3p", "y.org/3")}
