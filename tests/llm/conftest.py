import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as a table of documents with columns whose names clash with those operators use inside."""

    def make(rows, **more):
        kinds = "doc_id long, text string, n long, comp long, row long, word string, score double, text_ string"
        return spark.createDataFrame([(i, t, 1, 2, 3, "w", 0.5, "x") for i, t in rows], kinds)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, empty, null and odd ones: (doc_id, text)."""
    import random

    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(30, 60))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(6)]
    for i in range(25):
        w = base[1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 99))
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, "One  TWO"), (305, "É\u0000x y z a b"), (None, "null id text here it is"), (0, base[0])]
    return rows
