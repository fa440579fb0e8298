import os
import random

import pytest

pytest.importorskip("alnquant.llm")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def model():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path


def corpus(seed=1, n=40, vocab=30):
    """(doc_id, text): copies, near copies, shared passages, empty, null and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    words = [word() for _ in range(vocab)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = []
    for d in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 30, 120]))]
        if d % 4 == 1:
            k = rng.randint(0, len(t))
            t[k:k] = passage[rng.randint(0, 20) :]
        if d % 5 == 2 and docs:
            t = (rng.choice(docs)[1] or "").split(" ")
            if d % 2:
                t[rng.randrange(len(t))] = "changed"
        docs.append((d, rng.choice([" ", " ", "\n"]).join(t)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "x" * 3000), (n + 3, "x" * 3000)]
