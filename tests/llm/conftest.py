import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, fp string, keep string, size string, _id string, h string"

LONG = " ".join(f"w{k * 7919 % 100003}" for k in range(30_000))
SHARED = "this passage of well over four hundred bytes turns up in more than one document " * 7


def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and names that operators might use themselves."""
    line = "a line that several documents share, long enough"
    texts = [
        (1, "One two three four five six seven eight nine ten eleven.\n" + line, "en", "a"),
        (2, "Another text of its own.\n" + line + "\n  " + line.upper() + "  \nend", "en", "a"),
        (3, line + "\n" + line + "\nshort\nshort\nshort", "en", "b"),
        (3, line + "\n" + line + "\nshort\nshort\nshort", "en", "b"),
        (4, None, "fr", None),
        (5, "", None, None),
        (6, " \t\n\x0b ", "fr", "c"),
        (None, line + " and a null id", None, "b"),
        (7, LONG, "en", "c"),
        (8, "x" + SHARED + "y", "en", "d"),
        (9, "zz " + SHARED, "en", "d"),
        (9, "zz other text, same id " + SHARED[:300], "en", None),
        (10, "é" * 500 + "ñ" * 10 + "é" * 500, "es", "a"),
        (11, "123 456 !!! ---", "de", "a"),
        (12, "ab " * 400, "en", "b"),
        (13, LONG.replace("w1 ", "v1 ", 1), "en", "c"),
    ]
    return [(i, t, la, s, len(t) if t is not None else None, None, "fp", "k", "9", None, "h") for i, t, la, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs():
    return [(r[0], r[1]) for r in rows()]
