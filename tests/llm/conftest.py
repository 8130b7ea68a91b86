import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs with the table's other columns."""
    def make(rows, parts=3, extra=False):
        full = [(i, t, "en", f"s{(i or 0) % 2}", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        if extra:       # names that operators use inside or return
            df = df.selectExpr("*", "'x' AS fp", "1 AS _doc", "2 AS _hash", "'y' AS places", "3 AS component_id", "4 AS kept", "5 AS label",
                               "6 AS n_tokens", "7 AS sequence_id", "8 AS _keep")
        return df
    return make


#: Nulls, empty texts, ties, repeated rows, odd white space, special strings, one very long text.
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c d e"), (6, "a b c d e"), (None, "a b c d e"), (7, "x " * 30000),
        (8, "é ü ß 日本 😀 <|endoftext|> <|startoftext|>"), (9, "A\nB\n\nC \r\n D"), (10, "don't I'LL we're 1234 ... ?!"),
        (11, "ab" * 20000), (12, " lead and trail "), (13, "é É İ.")]
