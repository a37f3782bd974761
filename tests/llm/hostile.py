"""Rows that every operator has to take: nulls, empty and long texts, repeats, clashing names."""

LONG = "the cat, the dog. " * 6000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again. It's 42 o'clock!"),
    (2, "the quick brown fox jumps over the lazy dog, again and again. It's 42 o'clock!"),
    (3, ""),
    (4, None),
    (5, " \t\n\x0b\x0c\r "),
    (6, LONG),
    (7, "Straße ÉTÉ ΣΑΣ İstanbul naïve é  x y \x1c\x85 <|endoftext|>tail <|ENDOFTEXT|> 😀a. é, ﬁ"),
    (8, "a b"),
    (8, "a b"),
    (None, "null id text with a few more words than the ten that are asked for here"),
    (None, "null id text with a few more words than the ten that are asked for here"),
    (9, "x" * 70000),
    (10, "one line\none line\none line\n\n  \nother line"),
    (8, "same id, another text"),
    (11, "mail joe.doe@mail.example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (275) 555-5927 now"),
]
NAMES = "doc_id bigint, text string, id string, h int, pos int, word string, n int, m int, fp string, c0 int, component int, r int"


def hostile(spark, extra=()):
    rows = [(i, t, "x", 1, 2, "w", 3, 4, "f", 5, 6, 7) for i, t in [*TEXTS, *extra]]
    return spark.createDataFrame(rows, NAMES)


def empty(spark):
    return spark.createDataFrame([], NAMES)


def texts(extra=()):
    return [(i, t or "") for i, t in [*TEXTS, *extra]]
