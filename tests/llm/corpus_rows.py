from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    T.StructField("row", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("key", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("copies", T.LongType()),
])
LONG = "the quick brown fox jumps over the lazy dog " * 3000

TEXTS = [
    (1, "The quick brown fox and the dog", "en", "a"), (2, "the quick brown fox and the dog", "en", "b"), (3, "THE QUICK brown fox and the dog", None, None),
    (4, None, "en", "a"), (5, "", "de", "a"), (6, "  \n ", "fr", "b"), (7, LONG, "en", "c"), (8, LONG.upper(), "en", "c"), (9, LONG + "x", "en", None),
    (10, "1234 5678 !!", "en", "b"), (None, "die Katze und der Hund sind im Haus", "de", "a"), (None, None, None, None),
    (11, "une maison et un chat dans le jardin", "fr", "d"), (11, "une maison et un chat dans le jardin", "fr", "d"), (11, "Éa É é", "fr", "d"),
    (12, "word", "en", "e"), (13, "two words", "en", "e"), (14, "a\tb\x0bc\x1cd e  f\r\n\n\ng", "en", "a"), (15, "I'll don't 's 12 x² <|endoftext|>", "en", "a"),
]


def plain(df):
    return [tuple(r) for r in df.collect()]
