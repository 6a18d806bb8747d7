import random

import pytest

#: Names that the operators use inside; they must pass through or be passed over.
CLASH = "n long, node long, h long, site string, page string, doc string, size long, rank long, part long, skey string, blob string, line string"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source): nulls, empty and long texts, repeated rows, copies, odd white space."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "Tu", "é", "ß", "x1"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    base = prose(120)
    near = " ".join(w if k % 40 else "zz" for k, w in enumerate(base.split(" ")))
    rows = [(k, prose(rng.randint(1, 60)), rng.choice("abc")) for k in range(20, 60)]
    rows += [(1, base, "a"), (2, base, "b"), (3, near, "a"), (4, near + " tail", None), (5, None, "a"), (6, "", "b"), (7, "   \n\t ", "c"), (8, prose(20_000), "a")]
    rows += [(None, "no id here at all " * 3, "a"), (9, "one two", None), (9, "one two", None), (10, "one  two", "a"), (11, "ONE two", "a"), (12, "a\x0bb\x0cc d e", "a")]
    rows += [(13, "w w w w w w w w w w " * 5, "a"), (14, "LOUD WORDS " * 20, "b"), (15, "x### y### " * 15, "c"), (16, "line again\n" * 9, "c"), (17, "hi<|endoftext|> and <|endoftext|>  two", "b")]
    rows += [(100 + k, f"All rights reserved\n{prose(30)}\nsee our shop", "a") for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    """The odd rows as documents, with columns of clashing names."""
    extra = [(1, 2, 3, "s", "p", "d", 4, 5, 6, "k", "b", "l")] * len(odd_rows)
    rows = [(i, t, "en", s, None if t is None else len(t), *x) for (i, t, s), x in zip(odd_rows, extra)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
