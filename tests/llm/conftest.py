import random

import pytest

WORDS = "the of and in to a is that for it as was with be by on not he his but at are this have from or had an they which one you".split()
EXTRA = "part int, row string, n_words string, code string, fp string, h string, cell string, source_id long"


def prose(rng, n, vocabulary=None):
    """n words with odd separators, capitals and letters beyond ASCII."""
    vocabulary = vocabulary or [*WORDS, "Élan", "straße", "naïve", "數", "a b", "x-y", "Z9"]
    gaps = [" "] * 12 + ["\n", "\t", "  ", "\x0b", "\r\n"]
    return "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))


def make_texts(seed=3):
    rng = random.Random(seed)
    shared, texts = prose(rng, 60), []
    for k in range(40):
        texts.append(prose(rng, rng.choice([1, 3, 8, 30, 90])))
    texts += [f"{prose(rng, 20)} {shared} {prose(rng, 9)}" for _ in range(6)]
    copy = prose(rng, 120)
    texts += [copy] * 5 + [copy.replace(" the ", " The ", 1), copy + " more words here"]
    texts += [None, None, "", "", " \n\t", "one", "one", "ONE", " ", "<|endoftext|> and </s>", "é" * 50, prose(rng, 20_000), (prose(rng, 12) + "\n") * 40]
    return texts


def documents(spark, texts, ids=None):
    """A documents table with null ids and sources, repeated rows and columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["web", "web", "web", "books", None, "code.example.com"]
    rows = [(i, t, ["en", "fr", None][k % 3], sources[k % 6], len(t or ""), k, "r", "n", "c", "f", "h", "c", k) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """All texts under ids of their own, then two repeated rows and two rows without an id."""
    return documents(spark, [*texts, texts[3], texts[3], texts[5], None], [*range(len(texts)), 3, 3, None, None]).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
