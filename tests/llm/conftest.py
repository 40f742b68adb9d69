"""Small tables with everything that may go wrong in them."""

import random

import pytest

EXTRA = "score double, n long, rep long, token string, digest string, class int, bucket long, x string, kind int, a long, b long, n_chars long, `offset` long, rank int, predicted int, held_out string, toxic int"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"
WORDS = {
    "en": "the of and to in is that for it was on are as with they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    out = []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        t = prose(rng, lang, rng.randint(6, 120))
        if i % 6 == 1:
            t += " idiotical scumbag " + t[:40]
        if i % 10 == 2:
            t += f" mail a.b{i}@mail{i}.example.org or 10.0.{i}.7 or +1 (415) 555-{1000 + i} card 4111 1111 1111 1111 ok"
        out.append([i, t, lang, f"s{i % 4}"])
    base = out[50][1] + " " + prose(rng, "en", 200)
    for j in range(8):  # near copies
        w = base.split()
        w[5 * j] = "edited"
        out.append([100 + j, " ".join(w), "en", "s0"])
    out += [[120 + j, base, "en", "s0"] for j in range(5)]  # exact copies
    out += [[130, None, None, None], [131, "", "en", None], [132, " \n\t ", None, "s1"], [133, "one two", "en", "s1"], [134, "one  two", "en", "s1"], [135, "!!! ... ###", "en", "s1"]]
    out += [[None, base, "en", "s0"], [None, None, None, None], [None, base, "en", "s0"]]
    out += [out[3][:], out[3][:]]  # repeated rows
    out.append([140, prose(rng, "en", 30000), "en", "s2"])  # a very long text
    out.append([141, "a" * 150_000, "en", "s2"])
    out.append([142, "日本語 текст ñandú É́ \x00 <|endoftext|>   it's 12ab", None, "s2"])
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    n = SCHEMA.count(",") + 1
    return spark.createDataFrame([tuple(r + [None] * (n - 4)) for r in texts], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark, texts):
    rows = [(r[0], 1, int("scumbag" in (r[1] or ""))) for r in texts if r[0] is not None] + [(None, 1, 1), (7, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
