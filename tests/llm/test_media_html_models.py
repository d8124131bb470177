import hashlib
import io
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmark.llm import html_text, language, media, mixing


@pytest.mark.parametrize("height,width", [(1, 1), (3, 64), (8, 9), (40, 13)])
def test_formats_and_area_resize(height, width):
    samples = np.random.default_rng(height).integers(0, 256, (height, width, 3)).astype(np.uint8)
    assert (media.decode(media.encode_ppm(samples)) == samples).all()
    assert (media.decode(media.encode_bmp(samples)) == samples).all()
    grey = media.grey(samples)
    tile = media.area_resize(grey, 8, 9)
    for i in range(8):
        for j in range(9):
            total = Fraction(0)
            for y in range(height):
                rows = min(Fraction(height * (i + 1), 8), y + 1) - max(Fraction(height * i, 8), y)
                for x in range(width) if rows > 0 else ():
                    columns = min(Fraction(width * (j + 1), 9), x + 1) - max(Fraction(width * j, 9), x)
                    total += rows * columns * int(grey[y, x]) if columns > 0 else 0
            assert tile[i, j] == int(total / Fraction(height * width, 72))


def test_other_netpbm_kinds():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 3\n0 3").tolist() == [[0, 255]]
    assert media.decode(b"P5 2 1 255\n\x07\x09").tolist() == [[7, 9]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]


def test_text_media_round_trip(docs, rows, no_docs):
    found = {}
    for r in media.text_media(docs).mapInArrow(media._digest, media.DIGEST).collect():
        found[r["doc_id"]] = r
    for i, text, *_ in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-16:])
        stored = media.encode_ppm(np.frombuffer(padded, np.uint8).reshape(-1, 64, 3))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        tile = np.load(io.BytesIO(r["tile"]))
        bits = [int(tile[y, x + 1] > tile[y, x]) for y in range(8) for x in range(8)]
        assert int(r["feature"], 16) == int("".join(map(str, bits)), 2) and len(r["feature"]) == 16
    assert media.text_media(no_docs).mapInArrow(media._digest, media.DIGEST).collect() == []


def test_sizes_without_pixels_or_data_and_wide_samples(spark):
    bad = [b"P5 99999999999999999999 1 255\n", b"P5 0 0 255\n", b"P6 0 3 255\nabc", b"P2 2 1 9\n1", b"P5 2 2 70000\nabcdefgh", media.encode_bmp(np.zeros((1, 1, 3), np.uint8)).replace(b"\x01\0\0\0\x01\0\0\0\x01", b"\0\0\0\0\x01\0\0\0\x01")]
    found = media.tiles(spark.createDataFrame(list(enumerate(bad)), "id int, file binary"), "id", "file").collect()
    assert len(found) == len(bad) and all(r["height"] is None and r["tile"] is None and r["feature"] is None for r in found)
    assert media.decode(b"P5 2 1 65535\n\xff\xff\x80\x00").tolist() == [[255, 127]]


def test_tiles_of_unreadable_files(spark):
    files = [(1, media.encode_ppm(np.zeros((2, 2, 3), np.uint8))), (2, None), (3, b""), (4, b"P6 9 9 255\nshort"), (5, b"BMxx")]
    found = {r["id"]: r for r in media.tiles(spark.createDataFrame(files, "id int, file binary"), "id", "file").collect()}
    assert found[1]["height"] == 2 and all(found[i]["tile"] is None for i in (2, 3, 4, 5))


PROSE = "The first of these was that it would not be so easy to find what they had in the house, and the other was that all of it was gone by then."
PAGES = [
    (f"<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy {PROSE}</div>"
     f"<article><h1>Title &amp; more</h1><p>{PROSE}<p><b>Bold</b>  two\n lines<br>end</p><aside>{PROSE}</aside><ul><li>item</li></ul></article>"
     f"<div id=comments><p>{PROSE}</p></div><footer>&copy; x</footer>", f"Title & more {PROSE} Bold two lines end item"),
    (f"<body><div class='menu'><a href=a>a</a></div><h2>Head</h2><p>{PROSE} {PROSE}</p><p>Short.</p><p>{PROSE}</p><p><a href=b>many links {PROSE[:60]}</a></p>"
     f"<form>{PROSE}</form><!-- {PROSE} --></body>", f"Head {PROSE} {PROSE} Short. {PROSE}"),
    ("<main><p>tiny</p></main><p>out</p>", "tiny"), ("<p>tiny</p>", ""), ("", ""), (None, ""), ("no tags at all", ""), ("<", ""), ("<p", ""), ("<script>never closed", ""),
]


def test_main_text(spark):
    rows = [(i, "u", html) for i, (html, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0]), (0, "u", PAGES[0][0])]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert len(found) == len(rows)
    for r in found:
        want = PAGES[r["page_id"] or 0][1]
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_page_is_linear():
    page = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    assert html_text.main_text(page).count("The first") == 5000


def test_runs_against_brute_force():
    table = language.letters()
    texts = ["", "ab", "a b", "  a", "!!", "Éa, b.", "x" * 5, " ", "a", ""]
    for text, n in zip(texts, language.runs(texts)[1]):
        c = [int(table[ord(x)]) for x in text + "  "]
        grams = [c[i : i + k] for i in range(len(text)) for k in (1, 2, 3) if i + k <= len(c)]
        good = [g for g in grams if g != [32] and not any(a == b == 32 for a, b in zip(g, g[1:]))]
        assert n == len(good)
    assert language.runs(["ab"])[0].tolist() == language.runs(["AB!"])[0].tolist()[:5]


def language_rows():
    import random

    rng = random.Random(1)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["schr", "ung", "eit"], "cc": ["ção", "lh", "nos"]}
    return [(i, " ".join("".join(rng.choices(sounds[g], k=3)) for _ in range(rng.randrange(3, 40))), g) for i in range(240) for g in [rng.choice(list(sounds))]]


def test_language_is_learnt_and_held_out_rows_are_predicted(spark):
    rows = language_rows()
    odd = [(1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", None), (None, "katomi katomi", None), (1003, "katomi tokami", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("held_out", F.lit("clash"))
    found = language.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + len(odd)
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in by_id.items() if r["held_out"]} - {1000, 1001, 1002, 1003} == set(held)
    truth = {i: g for i, _, g in rows}
    assert sum(by_id[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[None]["lang_pred"] == "aa" == by_id[1003]["lang_pred"]
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_without_training_rows(spark, no_docs):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.identify(docs).collect()] == [(1, False, "und", 0.0)]
    assert language.identify(no_docs).collect() == []


def test_regularised_leader_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    model = language.Ftrl(50, 2, l1=1.0)
    for _ in range(400):
        label = int(rng.integers(2))
        model.learn(np.array([label, *rng.integers(2, 50, 3)]), np.ones(4), label)
    w = model.weights()
    assert w[0, 0] > 0 > w[0, 1] and (w[2:] == 0).mean() > 0.5
    logits = np.array([[2.0, 0.0]] * 100)
    labels = np.array([0] * 73 + [1] * 27)
    t = language.temperature(logits, labels)
    assert language.softmax(logits / t)[0, 0] == pytest.approx(0.73, abs=0.01)


def test_descent_meets_reachable_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    target = np.array([0.6, 0.3, 0.1])
    steps = mixing.descend(rows, target, budget=50_000.0)
    rate = mixing.replay(p, steps)
    assert (rate >= 0).all() and np.abs((rate * n) @ p - target * 50_000).max() < 0.001 * n.sum()


def mixing_rows():
    rng = np.random.default_rng(2)
    kinds = {"good": ["river", "stone", "light", "house"], "bad": ["spam%%%", "click###", "buy&&&", "now***"]}
    out = []
    for i in range(300):
        kind = "good" if rng.random() < 0.5 else "bad"
        out.append((i, " ".join(rng.choice(kinds[kind] + ["and", "the"], 30)), kind))
    return out


def test_mixing_moves_domain_totals_to_the_targets(spark):
    rows = mixing_rows()
    odd = [(900, None), (901, ""), (None, "river stone"), (5, rows[5][1])]
    docs = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string").withColumn("rate", F.lit("clash"))
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 2] + [(None, "bad"), (7, None), (9, "zzz")], "doc_id long, domain string")
    found = mixing.mix(docs, labels, {"good": 0.9, "bad": 0.1}).collect()
    assert len(found) == len(rows) + len(odd)
    kind = {i: k for i, _, k in rows}
    total = {"good": 0.0, "bad": 0.0}
    for r in found:
        assert r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1
        if r["doc_id"] in kind:
            total[kind[r["doc_id"]]] += r["rate"] * r["n_tokens"]
    assert total["good"] / sum(total.values()) == pytest.approx(0.9, abs=0.05)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (900, 901)} == {0}


def test_mixing_without_labels_or_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, domain string")
    found = mixing.mix(docs, none, {}).collect()
    assert len(found) == docs.count() and all(r["rate"] == pytest.approx(1.0) for r in found)
    assert mixing.mix(no_docs, none, {"a": 1.0}).collect() == []


def test_self_closed_drawings_and_formulas_swallow_nothing():
    line = "The text that is in this block and that was there before it is as long as it has to be for the rules to keep it."
    for tag in ('<svg class="x"/>', "<math />", "<svg><path/></svg>"):
        assert html_text.main_text(f"<body><article><p>{line}</p>{tag}<p>{line}</p></article></body>").count("The text") == 2
    assert html_text.main_text(f"<article><p>{line}</p><script/><p>{line}</p></article>").count("The text") == 1


HILL = "When the wind came up from the west and over the hill we had to go home by another way than that which we took before, and it was late. "


@pytest.mark.parametrize("page,want", [
    (f"<div class='page with-sidebar'><nav><a>x</a></nav><article><h1>Title</h1><p>{HILL}</p></article><div class=sidebar>{HILL}</div></div>", "Title " + HILL),
    (f"<div class='layout has-sidebar sidebar-layout'><article><p>{HILL}</p></article></div>", HILL),
    (f"<form id=aspnetForm><div>{HILL}</div></form>", HILL),
    (f"<div id=nav-wrapper><p>{HILL}</p><p>short one</p></div>", HILL + "short one"),
    (f"<article><p>{HILL}</p><section class=comments><article class=comment>{HILL * 3}</article></section></article>", HILL),
    (f"<div class=sidebar><article><p>A teaser of forty signs and the rest of it.</p></article></div><main><p>{HILL * 2}</p></main>", HILL * 2),
])
def test_a_wrapper_never_empties_an_article(page, want):
    assert html_text.main_text(page) == want.strip()


def test_without_an_article_the_rules_and_both_neighbours_decide():
    links = "<li><a href=a>one link of a menu</a></li><li><a href=b>another link of it</a></li>"
    noise = "x7 q9 " * 40
    page = f"<ul>{links}</ul><div>Home</div><ul>{links}</ul><p>Heading</p><p>{HILL}</p><p>Then.</p><p>{HILL}</p><p>{noise}</p><p>Imprint</p>"
    assert html_text.main_text(page) == f"Heading {HILL}Then. {HILL}".strip()
    labels = [html_text.first_pass(b, False, False, True) for b in html_text.measure(html_text.blocks(page))]
    assert labels == [0, 0, None, 0, 0, None, 1, None, 1, 0, None]


def test_a_language_without_a_list_keeps_its_long_blocks():
    text = "Слово дня было сказано и записано. " * 6
    assert html_text.main_text(f"<ul><li><a>меню</a></li></ul><div>{text}</div>") == text.strip()


@pytest.mark.parametrize("piece", ["<a ", "<p x='", "<div>", "</x>", "<div></x>", "<script>", "<!--x", "< ", "<svg>", "<![CDATA[", "<div class='ad'>t"])
def test_a_megabyte_of_unclosed_markup_takes_linear_time(piece):
    import time

    took = []
    for size in (100_000, 1_000_000):
        began = time.process_time()
        html_text.main_text(piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.02) and took[1] < 6


def test_mixing_stage_with_clashing_names_nulls_and_no_rows(spark, no_docs, tmp_path):
    """Copies follow the rates; rows without doc_id stay once, and no name of a column matters."""
    docs = spark.createDataFrame([(i, f"good words here number {i} " * 20) for i in range(60)] + [(None, "no id"), (61, None), (5, "a repeated row")], "doc_id long, text string")
    for c in ("copies", "copies__", "copy__", "copy", "times", "named", "c0", "n_tokens", "domain"):
        docs = docs.withColumn(c, F.lit("clash"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)] + [(None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = mixing.stage_mixing(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(r["doc_id"] is None for r in rows) == 1 and {r["copies__"] for r in rows} == {"clash"}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, mixing.label_domains(spark.read.parquet(f"{tmp_path}/labels.parquet")), mixing.TARGETS).groupBy("doc_id").agg(F.max("copies").alias("copies")).collect()}
    assert all(sum(r["doc_id"] == i for r in rows) == n * (2 if i == 5 else 1) for i, n in copies.items() if i is not None)
    assert mixing.stage_mixing(spark, no_docs, str(tmp_path)).collect() == []


def test_targets_out_of_reach_end_the_descent(spark):
    rows = spark.createDataFrame([(100, [0.9, 0.1]) for _ in range(50)], "n_tokens long, posterior array<double>")
    steps = mixing.descend(rows, np.array([0.0, 1.0]))
    assert len(steps) < mixing.ROUNDS


def test_shapes_are_those_of_each_character_in_turn():
    rng = random.Random(21)
    signs = ["a", "Z", "é", "中", "7", "²", "½", "\n", "\t", "!", "-", "\x00", "🙂", "\u0301"]
    for piece in ["", "word", "word.", "a1b22", "--!!", *("".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(2000))]:
        out = ""
        for c in piece:
            c = "a" if c.isalpha() else "0" if c.isdigit() else c
            if c != out[-1:]:
                out += c
        assert mixing.shape(piece) == out
