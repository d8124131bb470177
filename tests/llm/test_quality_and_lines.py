import random
import re
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from groundmark.llm import fertility, line_dedup
from groundmark.llm.tokens import sentence_table, vocabulary

WORDS = "people town there when were old new near far here big of this was other some that not same rest long enough rules".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "s"]) for _ in range(n))


WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + i for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for i in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_base_counts_against_brute_force(docs, rows):
    found = fertility.features(docs).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found)
    assert got == sorted((str(i), *base(t)) for i, t, *_ in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_metrics_against_the_library(docs, rows):
    codec = sentence_table(vocabulary("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in fertility.features(docs).collect()}
    for i, text, *_ in rows:
        ids = codec.processor.encode(text or "", num_threads=1)
        r = found[i]
        if not ids:
            assert r["chars_per_piece"] is None
            continue
        n = len(ids)
        entropy = -sum(c / n * log(c / n) for c in Counter(ids).values()) / log(n) if n > 1 else 1.0
        assert r["chars_per_piece"] == pytest.approx(len(text) / n)
        assert r["fallback_share"] == pytest.approx(sum(codec.processor.is_byte(x) for x in ids) / n)
        assert r["entropy_share"] == pytest.approx(entropy, abs=1e-9)


def test_a_document_out_of_band_is_rejected_and_like_ones_stay(spark):
    rng = random.Random(8)
    good = [(i, prose(rng, 120), "en") for i in range(40)]
    noise = [(100, " ".join(f"q{c}x{d}%$#z" for c in "bcdfghjk" for d in "lmnpqrstv"), "en")]
    docs = spark.createDataFrame(good + noise, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in fertility.judge(docs).collect()}
    assert not kept[100] and all(kept[i] for i, *_ in good)


def test_quality_of_nothing_and_scripts(no_docs):
    assert fertility.judge(no_docs).collect() == []
    assert [fertility.script(x) for x in ("", "123", "abc ж", "жжж a", "中文", "ελ")] == ["none", "none", "latin", "cyrillic", "han", "greek"]


def test_quality_stage_keeps_columns(spark, docs):
    out = fertility.stage_quality(spark, docs, "")
    assert out.columns == docs.columns
    want = {r["doc_id"] for r in fertility.judge(docs).filter("kept and doc_id is not null").collect()}
    assert {r["doc_id"] for r in out.collect()} == want


def similar(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= int(0.2 * max(len(a), len(b)) + 1e-9)


LONG = "when the wind came up from the west and over the hill we had to go home by another way than that which we took before"


def line_rows():
    return [
        (1, LONG + "\nfirst\n\nsomething else that is not like any of the other lines here at all"),
        (2, "second only\n" + LONG.upper() + "\nfirst"),
        (3, LONG.replace("hill", "hills") + "\nthird\n" + LONG.title()),
        (4, None), (5, ""), (6, "\n\n"), (None, LONG), (7, "  first  \nlast line of its own"), (7, "  first  \nlast line of its own"),
    ]


def test_equal_and_similar_lines_stay_once(spark):
    docs = spark.createDataFrame(line_rows(), "doc_id long, text string").withColumn("n_lost", F.lit("clash"))
    found = line_dedup.dedup_lines(docs).collect()
    by_id = {r["doc_id"]: r["text"] for r in found}
    assert len(found) == len(line_rows())
    assert by_id[1] == line_rows()[0][1]
    assert by_id[2] == "second only"
    assert by_id[3] == "third"
    assert by_id[4] is None and by_id[5] == "" and by_id[6] == "\n\n"
    assert by_id[None] == LONG
    assert by_id[7] == "last line of its own"


def test_links_are_all_pairs_that_share_a_key_and_are_similar(spark):
    """Against brute force over all pairs: groups are joined by similar lines, and hold all similar lines within the blocks' guarantee."""
    import itertools

    rng = random.Random(4)
    lines = []
    for _ in range(12):
        base_line = [rng.choice(LONG.split()) + str(rng.randrange(30)) for _ in range(30)]
        for _ in range(8):
            line = list(base_line)
            for k in rng.sample(range(30), rng.randrange(3)):
                line[k] = "changed" + str(rng.randrange(5))
            lines.append(" ".join(line))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    known = {r["doc_id"]: r for r in line_dedup.classes(docs).withColumn("k", line_dedup._keys(F.col("fp"))).collect()}
    place = {t: min(i for i, x in enumerate(lines) if x == t) for t in lines}
    pairs = list(itertools.combinations(sorted(place.values()), 2))
    near = {(i, j) for i, j in pairs if similar(lines[i], lines[j])}
    for i, j in pairs:
        if ((known[i]["fp"] ^ known[j]["fp"]) % 2**64).bit_count() <= line_dedup.BLOCKS - line_dedup.EQUAL:
            assert set(known[i]["k"]) & set(known[j]["k"])
    found = {tuple(sorted((r["a"]["doc_id"], r["b"]["doc_id"]))) for r in line_dedup.links(docs, line_dedup.classes(docs)).collect()}
    assert found and found <= near
    groups = lambda links: {frozenset(x) for x in joined(links, place.values())}
    assert groups(found) == groups(near)


def joined(links, nodes):
    group = {x: {x} for x in nodes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return group.values()


def test_recall_over_all_pairs_of_the_documents(spark):
    """Of all pairs of distinct lines of the smallest table with an edit similarity of 0.8, at least nine in ten end in one group."""
    import duckdb
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = line_dedup.classes(docs)
    texts = {(r["h1"], r["h2"]): r["norm"] for r in line_dedup.lines(docs).collect()}
    keys, norms = list(texts), list(texts.values())
    letters = sorted({c for x in norms for c in x})
    counts = np.array([[x.count(c) for c in letters] for x in norms])
    size = counts.sum(axis=1)
    maybe = []
    for i in range(len(norms) - 1):  # no edit distance is below the letters that one line has more of
        more = np.maximum(counts[i + 1 :] - counts[i], 0).sum(axis=1)
        less = np.maximum(counts[i] - counts[i + 1 :], 0).sum(axis=1)
        maybe += [(i, i + 1 + j) for j in np.flatnonzero(5 * np.maximum(more, less) <= np.maximum(size[i + 1 :], size[i]))]
    con = duckdb.connect()
    import pyarrow as pa

    pairs = pa.table({"i": [i for i, _ in maybe], "j": [j for _, j in maybe], "x": [norms[i] for i, _ in maybe], "y": [norms[j] for _, j in maybe]})  # noqa: F841
    near = con.execute("select i, j from pairs where 5 * levenshtein(x, y) <= greatest(length(x), length(y))").fetchall()
    assert len(near) >= 20
    links = [((r["a"]["h1"], r["a"]["h2"]), (r["b"]["h1"], r["b"]["h2"])) for r in line_dedup.links(docs, known).collect()]
    group = {}
    for g in joined(links, keys):
        group |= dict.fromkeys(g, id(g))
    assert sum(group[keys[i]] == group[keys[j]] for i, j in near) >= 0.9 * len(near)


def test_majority_of_word_hashes(spark):
    docs = spark.createDataFrame([(1, "One two  two three")], "doc_id long, text string")
    hashes = [r[0] % 2**64 for r in spark.sql("select xxhash64(w) from values ('one'), ('two'), ('two'), ('three') t(w)").collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert line_dedup.classes(docs).first()["fp"] % 2**64 == want


def test_methods_of_the_classes_are_small_enough_to_be_compiled(spark, capsys):
    """The JVM interprets methods of over 8000 bytes."""
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has no code yet
    line_dedup.classes(docs).explain("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_bands_are_the_least_hashes_of_word_pairs(spark):
    """A line of each length around the seven words of a row, against the same by array functions of one row."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 2, 6, 7, 8, 13, 14, 15, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = F.transform(F.expr("concat(array(null), split(text, ' '), array(null))"), lambda w: F.xxhash64(w))
    pairs = F.zip_with(F.slice(hashes, 1, F.size(hashes) - 1), F.slice(hashes, 2, F.size(hashes) - 1), lambda a, b: F.xxhash64(a, b))
    ordered = lambda mask: F.transform(pairs, lambda h: h.bitwiseXOR(F.lit(mask)))
    least = [F.array_min(ordered(mask)) for mask in line_dedup.MASKS]
    bands = [F.xxhash64(F.lit(b), *least[b * line_dedup.ORDERS : (b + 1) * line_dedup.ORDERS]) for b in range(line_dedup.BANDS_OF_PAIRS)]
    want = {r["doc_id"]: r["bands"] for r in docs.select("doc_id", F.array(*bands).alias("bands")).collect()}
    assert {r["doc_id"]: r["bands"] for r in line_dedup.classes(docs).collect()} == want


def test_alignment_never_costs_less_than_the_edit_distance(spark):
    rng = random.Random(7)
    words = [rng.choice(LONG.split()) for _ in range(40)] + ["x" * 70]
    rows = []
    for _ in range(60):
        x = [rng.choice(words) for _ in range(rng.randrange(1, 15))]
        y = [w for w in x if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            y.insert(rng.randrange(len(y) + 1), rng.choice(words))
        rows.append((" ".join(x), " ".join(y)))
    found = spark.createDataFrame(rows, "x string, y string").select("*", F.split("x", " ").alias("xw"), F.split("y", " ").alias("yw"), F.levenshtein("x", "y").alias("d"))
    found = found.select("x", "y", "d", line_dedup._aligned().alias("cost")).collect()
    assert all(r["cost"] >= r["d"] for r in found)
    assert sum(r["cost"] <= r["d"] + 3 for r in found) > len(found) // 2


def test_tabs_and_returns_at_the_ends_of_lines(spark):
    docs = spark.createDataFrame([(1, "Some line\r\nother"), (2, "\tsome line\nother \x0b"), (3, "\r\n\t")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {1: "Some line\r\nother", 2: "", 3: "\r\n\t"}


def test_a_line_of_many_documents_and_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "OFTEN", 5)
    rows = [(i, "the same line in all of them\n" + f"{LONG} with number {i}") for i in range(40)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: t if i == 0 else "" for i, t in rows}


def test_line_dedup_of_odd_and_no_rows(spark, docs, no_docs):
    out = line_dedup.stage_line_dedup(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_long_lines_count_all_words(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70_000)))], "doc_id long, text string")
    hashes = [r[0] % 2**64 for r in spark.range(70_000).select(F.xxhash64(F.concat(F.lit("w"), F.col("id").cast("string")))).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert line_dedup.classes(docs).first()["fp"] % 2**64 == want


def test_classes_of_repeated_rows(spark):
    line = " ".join(f"w{i}" for i in range(23))
    docs = spark.createDataFrame([(1, line), (2, line), (2, line), (2, line), (3, None), (4, " ")], "doc_id long, text string")
    found = line_dedup.classes(docs).collect()
    assert [(r["doc_id"], r["pos"], r["n"], r["size"]) for r in found] == [(1, 0, 4, len(line))]


def test_edited_lines_are_found_as_by_brute_force(spark):
    import itertools

    rng = random.Random(6)
    lines = []
    for n in (6, 10, 20, 27, 50):
        for _ in range(8):
            line = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(n)]
            edited = list(line)
            for k in rng.sample(range(n), max(1, n // 10)):
                edited[k] = "".join(rng.choice("xyz") for _ in range(6))
            lines += [" ".join(line), " ".join(edited)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    close = {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if 5 * abs(len(lines[i]) - len(lines[j])) <= max(len(lines[i]), len(lines[j])) and similar(lines[i], lines[j])}
    want = {(i, i + 1) for i in range(0, len(lines), 2)}
    assert close == want
    lost = {r["doc_id"] for r in line_dedup.dedup_lines(docs).filter("n_lost > 0").collect()}
    assert lost <= {j for _, j in want}
    recall = {n: sum(16 * k + 2 * i + 1 in lost for i in range(8)) for k, n in enumerate((6, 10, 20, 27, 50))}
    assert min(recall[n] for n in (10, 20, 27, 50)) == 8 and recall[6] >= 6


def test_rows_without_or_with_one_doc_id_follow_their_own_verdict(spark):
    rng = random.Random(9)
    good = [prose(rng, 120) for _ in range(6)]
    docs = spark.createDataFrame([*((i, t, "en") for i, t in enumerate(good[:4])), (None, good[4], "en"), (None, "too short", "en"), (0, "too short", "en"), (9, good[5], None)], "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in fertility.stage_quality(spark, docs, "").collect()) == sorted(good)


def test_a_third_of_a_language_as_noise_is_rejected(spark):
    """Bands come from the inner fifth of a group, so noise on one side does not widen them."""
    rng = random.Random(10)
    good = [(i, prose(rng, 120), "en") for i in range(60)]
    noise = [(100 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz#$%&") for _ in range(9)) for _ in range(80)), "en") for i in range(30)]
    kept = {r["doc_id"]: r["kept"] for r in fertility.judge(spark.createDataFrame(good + noise, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in noise)


def test_no_clean_row_is_lost_in_groups_of_any_size(spark):
    rng = random.Random(12)
    sizes = {"a": 5, "b": 5, "c": 12, "d": 50, "e": 300, None: 20}
    rows = [(i, prose(rng, rng.choice((60, 120, 400))), lang) for i, lang in enumerate(x for x, n in sizes.items() for _ in range(n))]
    found = fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("not kept and not base_failed").collect()
    assert found == []


def test_quality_stage_with_a_clashing_column_and_no_rows(spark, no_docs):
    docs = spark.createDataFrame([(1, "some words " * 3, "en", "mine")], "doc_id long, text string, lang string, _quality_row string")
    assert fertility.stage_quality(spark, docs, "").columns == docs.columns
    assert fertility.stage_quality(spark, no_docs, "").collect() == []


def test_no_similar_pair_of_short_lines_is_left_out(spark):
    """Against all pairs of lines of up to `SHORT` characters, which differ in lengths and share most letters."""
    import itertools

    rng = random.Random(31)
    lines = {"the.", "sthe.", "enou.", "anou.", "and!! ornd.", "and ornd.", "é", "abcd", "abcde"}
    for n in (4, 5, 7, 8, 9, 10, 11, 12, 13, 14):
        for _ in range(5):
            base = [rng.choice("abcdefgh ") for _ in range(n)]
            for _ in range(3):
                for _ in range(2):
                    base[rng.randrange(n)] = rng.choice(["x", "", "yz"])
                lines.add("".join(base).strip())
    lines = sorted(x for x in lines if 0 < len(x) <= line_dedup.SHORT)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(lines), 2) if similar(x, y)}
    found = {tuple(sorted((r["a"]["doc_id"], r["b"]["doc_id"]))) for r in line_dedup.links(docs, line_dedup.classes(docs)).collect()}
    assert len(want) > 20 and found == want


def test_similar_lines_of_a_band_are_joined_whatever_its_chief_is(spark):
    import itertools

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    lines = []
    for _ in range(40):
        base = rng.sample(words, 12)
        for _ in range(12):
            line = list(base)
            for k in rng.sample(range(12), rng.randrange(5)):
                line[k] = rng.choice(words)
            lines.append(" ".join(line))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    known = {r["doc_id"]: r for r in line_dedup.classes(docs).collect()}
    near = {(i, j) for i, j in itertools.combinations(sorted(known), 2) if set(known[i]["bands"]) & set(known[j]["bands"]) and similar(lines[i], lines[j])}
    near = {(i, j) for i, j in near if ((known[i]["fp"] ^ known[j]["fp"]) % 2**64).bit_count() <= line_dedup.BAND_BITS}
    found = [(r["a"]["doc_id"], r["b"]["doc_id"]) for r in line_dedup.links(docs, line_dedup.classes(docs)).collect()]
    groups = list(joined(found, known))
    assert near and all(any({i, j} <= g for g in groups) for i, j in near)
    assert all(similar(lines[i], lines[j]) for i, j in found)


def test_long_lines_are_similar_by_their_edit_distance(spark):
    """Letters that come and go with blanks cost the alignment of words more than they are edits."""
    rng = random.Random(13)
    line = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(200)]
    other = [x if k % 8 else x[:3] + " " + x[3:] + " y" for k, x in enumerate(line)]
    other[40:40] = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5)]
    docs = spark.createDataFrame([(1, " ".join(line)), (2, " ".join(other))], "doc_id long, text string")
    pairs = line_dedup.classes(docs).select(F.struct("h1", "h2", "doc_id", "pos").alias("x"))
    pairs = pairs.alias("p").join(pairs.alias("q"), F.col("p.x.doc_id") < F.col("q.x.doc_id")).select(F.col("p.x").alias("a"), F.col("q.x").alias("b"))
    assert similar(" ".join(line), " ".join(other)) and line_dedup.verify(docs, pairs).count() == 1
