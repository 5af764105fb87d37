"""Small inputs with every odd case, and plain versions of what the operators compute."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, k1 long, label string"


def odd_docs(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, a null id, and columns with clashing names."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6)))
    prose = [" ".join(word() for _ in range(60)) for _ in range(4)]
    long = "\n".join(" ".join(word() for _ in range(40)) for _ in range(2000))
    texts = [None, "", " \n\t ", "one", prose[0], prose[0], prose[1], prose[1] + " tail", prose[2], long, long + " end", "a b c d e", "A\u00a0b  c\r\n\x1c d", "<|endoftext|> ▁ x 中文 🙂"]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "r", 0.5, i, "l") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, prose[3], None, None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
