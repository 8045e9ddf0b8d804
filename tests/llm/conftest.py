import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, hi string"


def _words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages and lines, nulls, empty and long texts, odd white space, repeated rows."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéfghijklmnoßpqrstuvwxyz") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    passage, line = _words(rng, 90, vocabulary), "A Common line, shared by many"
    texts = [None, "", " ", "\n\n", "one", "x" * 3000, "ab" * 2000, "word " * 300, passage, passage + "\n" + line]
    for k in range(60):
        body = _words(rng, rng.choice([3, 18, 19, 20, 21, 60, 200]), vocabulary)
        if k % 3 == 0:
            body += "\n" + line.upper() + " \t"
        if k % 5 == 0:
            body = body[:len(body) // 2] + " " + passage + "\x0b\x0c\r " + body[len(body) // 2:]
        texts.append(body)
    texts += [texts[20], texts[20], texts[33] + " tail", "start " + texts[33], _words(rng, 20000, vocabulary)]
    base = texts[40].split()
    for k in range(8):
        near = list(base)
        near[k % len(near)] = "changed%d" % k
        texts.append(" ".join(near))
    rows = [(i * 3 % 1000 + i, t, "en" if i % 2 else None, "s%d" % (i % 4) if i % 9 else None, len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows += [rows[9], rows[25]]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
