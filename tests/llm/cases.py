"""Texts and rows that every operator must take: nulls, empty and very long texts, repeated rows, clashing column names."""

LONG = "lorem ipsum dolor " * 20_000
AWKWARD = [None, "", " ", "\n\n", "a", "naïve café 日本語 🙂", "x<|endoftext|>y", "a  b   c \t d\x0b\x0ce ", LONG, "a" * 5000]
#: Names that the operators use inside.
EXTRA = ", row_number int, bucket string, text_hash string, key string, word_hashes int, host int, bands string, p string, label_id int, node string"
EXTRA_VALUES = (7, "x", "y", "z", 1, 2, "b", "p", 3, "n")


def documents(spark, texts, ids=None, extra=False):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) + (EXTRA_VALUES if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + (EXTRA if extra else ""))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
