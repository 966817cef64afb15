"""Rows that the operators' tests share."""

#: Names that the operators use inside, as extra columns of the input.
CLASHES = ["fp", "digest", "row", "_bucket", "bucket", "key", "shard", "epoch", "_l0", "_tokens", "tail", "toxic", "_id", "length", "piece", "sequence_id", "kept", "best", "to", "node", "root", "_keep", "score", "word", "c", "n"]

WORDS = "the quick brown fox jumps over a lazy dog and runs away from seven very angry bees near old mill".split()


def sentence(k: int, n: int = 40) -> str:
    return " ".join(WORDS[(k * 7 + i * i * (k + 3)) % len(WORDS)] for i in range(n))


LONG = " ".join(f"word{i % 977} é{i % 31}," for i in range(60_000))  # about 700,000 characters

MESSY = [
    (1, "Hello  World", "en", "a"),
    (2, "HelloWorld", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t\n\x0b", "de", "b"),
    (6, sentence(1), "en", "a"),
    (7, sentence(1), "en", "a"),
    (8, sentence(1) + "!", "en", "c"),
    (9, sentence(2), "fr", "c"),
    (9, sentence(2), "fr", "c"),
    (9, sentence(3), "fr", "c"),
    (None, sentence(4), "es", "a"),
    (None, sentence(4), "es", "a"),
    (10, "日本語のテキスト <|endoftext|> ½ don't Ünïcödé 🙂 x", "de", "d"),
    (11, LONG, "en", "a"),
    (14, "ctl \x00\x01a\x1cb \x7f. é\x1f\x85<|endoftext|>'s", "en", "a"),
    (12, sentence(5).upper(), None, None),
    (-13, sentence(5), "en", "a"),
]


def frame(spark, rows, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df
