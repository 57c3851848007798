"""Documents that are odd: nulls, empty, very long, ties, repeats, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, __n long"

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows(rng: random.Random | None = None) -> list[tuple]:
    rng = rng or random.Random(5)
    long = "\n".join(prose(rng, 30) for _ in range(700))
    texts = [None, "", " \n\t ", "one", "one two", "a b c", "ÄÖ ẞ łąka 漢字 \U0001f600 x", "don't STOP now then", prose(rng, 40), prose(rng, 40), long, ("ab " * 3000).strip(), "x" * 20000]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src9", "src12", None]), len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(8, rows[8][1], "en", "src1", 1), (9, rows[9][1], "en", "src1", 1), (None, rows[9][1], "fr", None, 1), (None, None, None, None, None)]
    same = prose(rng, 60)
    rows += [(100 + i, same, "en", "src1", len(same)) for i in range(30)]
    return [(*r, "k", "f", 7) for r in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
