import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

PASSAGE = " ".join(f"word{i}" for i in range(60))


def sample():
    """(doc_id, text) with copies, near copies, a shared passage, odd and empty texts."""
    body = " ".join(f"tok{i * 7 % 97}x{i % 11}" for i in range(300))
    near = body.split(" ")
    near[150] = "changed"
    rows = [
        (3, body),
        (1, body + " tail"),
        (2, " ".join(near)),
        (9, body),
        (4, f"start of it {PASSAGE} and then some more that is its own"),
        (5, f"{PASSAGE}\n{PASSAGE} twice within one text {PASSAGE}"),
        (6, "aa bb"),
        (7, "AA\tbb"),
        (8, "one two three four five six"),
        (10, ""),
        (11, None),
        (12, " \n\t "),
        (13, "naïve café ümlaut 日本語 \x00 text with a null byte and sigma ΑΣ ΑΣ. it's 3.14!"),
        (14, "x" * 5000),
        (15, "ab " * 4000),
        (16, "# a\n# a\n\n# b\n# a\n" * 3),
        (20, "mail me at first.last@mail.example.com or call +1 (551) 555-0826 now, ip 10.0.0.256 10.20.30.40 card 4242 4242 4242 4242"),
        (21, "4242424242424242 then 4242424242424241 and 1.2.3.4.5 +12 a@b a@b.c"),
    ]
    for i in range(30, 60):
        # a chain of texts, each near to the next
        w = [f"c{j}" for j in range(100)]
        for j in range((i - 30) % 15):
            w[j * 5] = f"z{i}_{j}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The sample with further columns whose names operators use too."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, block string, copy int, hits string, kept boolean"
    out = [(i, t, ("en", "xx", None)[i % 3], ("a", "b", None)[i % 3], len(t or ""), 0, "b", 1, "h", False) for i, t in rows]
    return spark.createDataFrame(out, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
