import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    """Texts with copies, near copies, shared passages and odd cases."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghijklmnoprstuvéß", k=r.randint(1, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage = say(60)
    base = [say(r.randint(60, 300)) for _ in range(25)]
    near = [" ".join(w if r.random() > 0.004 else "changed" for w in t.split(" ")) for t in base[:8]]
    shared = [f"{say(40)}\n{passage} {say(50)}" for _ in range(5)]
    odd = [
        None, "", " ", "\n\n\t", "one", "Word", "WORD", "a b c", "x " * 500, "| # | " * 80, "line\n" * 70, say(34), say(35), "\x1c tab\x0bfeed\x0c\u00a0nbsp",
        "<|endoftext|> special <|startoftext|>x", "don't they'LL 's 3.14", "é" * 3000, say(4000), (say(40) + " ") * 3, "🙂 \U0001f600 ﬁ Σας ΑΣ",
    ]
    texts = base + near + base[:5] + shared + odd + ["", None]
    return [(i, t, r.choice(["en", "fr", None]), r.choice(["src0", "src1", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
