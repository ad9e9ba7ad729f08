import pytest

LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000)) + "."
PROSE = "The quick brown fox jumps over the lazy dog near the old river bank, while seven small birds watch from a tall tree."


@pytest.fixture(scope="session")
def rows():
    """Awkward documents: (doc_id, text, lang, source, n_chars, row)."""
    texts = [None, "", " \n\t ", "one", PROSE, PROSE, PROSE.replace("  ", " ") + " ", LONG, LONG, "ünï cödé ✓ 漢字 <|endoftext|> 's\x1c\x85 x", "a\n b  c\r\n\td", "No no no."]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t), f"r{i}") for i, t in enumerate(texts)]
    out += [(4, PROSE, None, "s1", 1, "again"), (None, PROSE, "en", None, None, None), (None, None, None, None, None, None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("u", "s", "h", "i", "k", "n", "size", "taken", "maybe", "t", "word", "fp", "node", "kept", "_gone", "label.x")})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
