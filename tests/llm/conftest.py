import pytest

CLASHING = ["_node", "node", "size", "label", "target", "source_size", "c_before", "before", "bin", "salt", "words", "nth", "row", "root", "key", "g", "unit", "part", "score", "_low", "id", "line", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, source) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), *CLASHING) for d, t, s in rows], SCHEMA)

    return make


def words(seed: int, n: int, vocabulary: int = 4000) -> str:
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "One two.", "b"), (4, "One two.", "b"), (None, "One two.", "b"), (5, words(0, 30_000), "b"), (6, "é ñ 漢字 \U0001f600", "c")]
