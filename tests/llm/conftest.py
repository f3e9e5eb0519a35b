import random

import pytest

#: Texts that every operator must survive: nulls, empty and blank ones, long ones, ties, odd characters.
ODD = [None, "", " ", "\n\n\n", "word", "a b c", "one two three four", "ÄÖ ß 😀 \u00a0x", "x" * 5000, "la " * 400, "a b c d e f " * 50, "<|endoftext|> #*$%&|<>", "l1\nl2\nl3\nl1\nl2\nl3\n\nl1\nl2\nl3"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts and random ones with copies, null ids and sources, repeated rows and clashing extra columns."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = ODD + [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(40)]
    for t in texts[-20:]:
        cut = t.split()
        cut[r.randrange(len(cut))] = "zz"
        texts = [*texts, " ".join(cut), t]
    rows = [(i, t, r.choice(["src1", "src2", "Src3", None]), "x", "y", 1, "k") for i, t in enumerate(texts)]
    rows += [rows[3], rows[20], rows[20], (None, texts[20], None, "x", "y", 1, "k"), (None, None, "src1", "x", "y", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, kept string, fp int, `key` string")
