import pytest


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """A frame written as a table and read again, over a few files, as the operators get theirs."""

    def write(rows, schema, files=3):
        path = str(tmp_path_factory.mktemp("table") / "t.parquet")
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return write


#: Columns whose names the operators use themselves.
CLASH = ", size int, shard int, row int, key string, n int, words string, _row int, _order int, slice int, next int"


@pytest.fixture(scope="session")
def odd_documents(stored):
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i * 7919 % 1009}x" for i in range(60_000))
    texts = [None, "", " \t\n", "one", "a b c d e f g", "a b c d e f g", long, "über 日本 語 🙂 é x", "nul\x00 \x85mid   x"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s", None, ""][i % 3], None, *[i] * 10) for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s", 5, *[None] * 10), (3, "one", None, None, 1, *[1] * 10), (3, "one", None, None, 1, *[1] * 10)]
    rows += [(40, "one", "en", "t", 3, *[1] * 10)]
    rows = [r[:5] + tuple(str(x) if k in (3, 5) and x is not None else x for k, x in enumerate(r[5:])) for r in rows]
    return stored(rows, "doc_id long, text string, lang string, source string, n_chars long" + CLASH)


@pytest.fixture(scope="session")
def no_documents(stored):
    return stored([], "doc_id long, text string, lang string, source string, n_chars long" + CLASH)
