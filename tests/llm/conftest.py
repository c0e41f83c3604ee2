import pytest

#: doc_id, text, lang, source, n_chars and columns whose names operators use themselves
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string, ids string, "
    "kept string, size string, pos string, secret_spans string, lang_pred string, _key string"
)
WORDS = "the quick brown fox jumps over a lazy dog while seven Zebras ate 12 grapes in Köln today".split()


def rows_of(pairs):
    """(doc_id, text, lang, source) as full rows."""
    return [(i, t, la, s, None if t is None else len(t), *["x"] * 9) for i, t, la, s in pairs]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(WORDS[k % len(WORDS)] + str(k % 7) for k in range(30_000))
    found = rows_of(
        [
            (5, " ".join(WORDS), "en", "a"),
            (5, " ".join(WORDS), "en", "a"),
            (7, " ".join(WORDS), None, "a"),
            (2, None, "en", None),
            (3, "", "de", "b"),
            (4, " \t\n", None, "b"),
            (None, "Der Hund läuft über die Straße", "de", None),
            (None, None, None, None),
            (9, long, "en", "c"),
            (8, "x" * 40_000 + "7" * 20_000, "en", "c"),
            (1, "Σίσυφος é ÀÉ 𝒳𝒴   <|endoftext|>it's", "fr", "b"),
            (6, "+++ --- 123", "es", "a"),
        ]
    )
    return spark.createDataFrame(found, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
