"""Documents with everything that an operator must stand: nulls, empty and very long texts, ties, repeated rows, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, slot int, `a.b` int, bucket string"


def odd_rows():
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "ho") for b in ("ran", "tel", "sim", "pol", "vek")]
    prose = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(20, 80))) for _ in range(12)]
    texts = [None, "", " \n\t ", "?!", "one", *prose, prose[0], prose[1] + " extra", "x" * 5000, (prose[2] + "\n") * 40, "éß \U0001f600   \x1c naïve\x85 " + prose[3], 'password = "abcdef1234567890" and ' + prose[4]]
    rows = [(i, t, ("en", "de", None)[i % 3], ("hot", "hot", None, "s1", "s2")[i % 5], len(t or ""), "n", 1, 2, None) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, prose[5], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (7, prose[9], "en", "hot", 3, "n", 1, 2, "b")]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)
