import random

import pytest

#: Texts with the cases that every operator must bear: null, empty, blank, ties, repeats, odd white space, long.
ODD = [
    None, "", " ", "\n\n", "one", "one", "A b  c\n\nd ", " lead and trail ", "tab\tand\x0bvt\rcr\x0cff", "special <|endoftext|> inside <s> </s>",
    "naïve café über straße ñandú", "中文 没有 空格的长文本", "🙂 emoji 🙂🙂", "\x00 nul \x1c fs\x85nel\xa0nbsp", "▁ mark ▁▁ marks", "#*$ %&| <>",
    "a " * 5000, "x" * 20000,
]
WORDS = "the and of to in a is that it was for on with as his they be at one have this from or had by word but what some we can out other were all there when up use your how said".split()


def prose(rng, n):
    lines, line = [], []
    for i in range(n):
        line.append(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]))
        if rng.random() < 0.05:
            lines.append(" ".join(line))
            line = []
    return "\n".join([*lines, " ".join(line)])


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): odd texts, prose, copies; ids out of order, one null, one repeated row."""
    rng = random.Random(5)
    texts = ODD + [prose(rng, rng.choice((5, 60, 200, 1500))) for _ in range(40)]
    texts += [texts[25], texts[26] + " and one more", texts[27].replace("the", "thee", 1)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    out = [(i * 3, t, rng.choice(["en", "fr", None]), "s", None) for i, t in zip(order, texts)]
    return [*out, (None, "no id here " * 20, "en", None, 3), out[30]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those that operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("rank", "n_tokens", "fp", "component", "length", "kept", "grp", "lost", "copies", "h1", "bucket"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
