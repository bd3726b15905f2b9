import pytest

WORDS = ("the of and to in is with for on as by at from this that are was be it or heron marsh willow river stone bridge "
         "lantern orchard meadow harbour copper silver engine valley winter summer garden window letter market").split()


@pytest.fixture()
def make_docs(spark):
    """Documents with extra columns whose names clash with result columns."""
    def build(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "src0", None if t is None else len(t), "extra", -1.0, ["x"]) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "items string, score double, spans array<string>")
    return build


@pytest.fixture()
def prose():
    """Random text of n words from a seed."""
    import random

    def build(n, seed, vocabulary=WORDS):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) + str(r.randint(0, 30)) for _ in range(n))
    return build
