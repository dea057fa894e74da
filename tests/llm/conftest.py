import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is on Thé a1 b2 ünder x".split()


def text_of(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, near copies."""
    rnd = random.Random(5)
    base = [text_of(rnd, n) for n in (3, 40, 60, 300, 12000)]
    rows = [(k, t, "en", "s1") for k, t in enumerate(base)]
    rows += [(10 + k, t, "en", "s1") for k, t in enumerate(base)]  # exact copies
    rows += [(20, base[3].replace("the", "of", 3), "de", None), (21, base[3] + " more words", None, "s2")]
    rows += [(30, None, "en", "s1"), (31, "", "en", "s1"), (32, " \n\t", None, None), (33, "one", "en", "s3"), (34, "one", "en", "s3")]
    rows += [(None, base[1], "en", "s1"), (None, None, None, None), (2, base[2], "en", "s1"), (40, "ONE two", "en", "s3")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def clashing(edge_documents):
    """The same rows with columns named like those the operators use inside."""
    names = ("id", "n", "label", "component_id", "kept", "key", "bytes", "start", "length", "spans", "n_words", "host", "path", "turns", "rank", "a.b")
    return edge_documents.select("*", *[F.lit(k).alias(name) for k, name in enumerate(names)])
